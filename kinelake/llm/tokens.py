"""Token ids of whole texts with a public tokenizer, through a cache of its results for parts of words."""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa

from kinelake.llm.common import LOWER, coded_words, ragged, text_blocks

#: Word parts whose ids are remembered by a worker; beyond it the cache starts anew. It bounds memory only.
CACHE_WORDS = 1_000_000
_loaded: dict[str, "WordTokenizer"] = {}
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_AFTER_QUOTE = np.zeros(256, bool)
_AFTER_QUOTE[list(b"strvmldSTRVMLD")] = True


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> list[str]:
    """The character by which byte-level vocabularies write each byte: itself if visible in Latin-1, else from 256 on in order."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


def _plain_letter(code: int) -> bool:
    """A letter of the Latin, Greek or Cyrillic blocks that lower-casing and composition leave a single letter."""
    c = chr(code)
    low = c.lower()
    # Capital sigma is left out: its lower case depends on its place.
    return (0xC0 <= code < 0x250 or 0x386 <= code < 0x530) and code != 0x3A3 and unicodedata.category(c)[0] == "L" and len(low) == 1 and unicodedata.category(low)[0] == "L" and unicodedata.is_normalized("NFC", c) and unicodedata.is_normalized("NFC", low)


class WordTokenizer:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    For a vocabulary that lower-cases, drops white space and merges within runs of letters, single digits and runs of
    other characters, those runs are found for all texts at once, and the library's model gets each distinct run
    once. Texts with special tokens, apostrophe endings or characters other than ASCII and common letters go to the
    library whole, and so do all texts of any other vocabulary.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_run = self._merges_within_runs(spec)
        self.written = byte_characters()
        self.plain: dict[int, bool] = {}
        self._forget()

    def _forget(self):
        self.known = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.text = np.zeros(0, np.uint8)
        self.text_first = np.zeros(1, np.int64)

    @staticmethod
    def _merges_within_runs(spec: dict) -> bool:
        normal = [(x["type"], x.get("content")) for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        cut = steps[0] if steps else {}
        special = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens", []))
        return special and normal == [("NFC", None), ("Replace", " "), ("Lowercase", None)] and (cut.get("type"), cut.get("behavior"), cut.get("invert")) == ("Split", "Removed", True) and cut["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and [(x["type"], x["add_prefix_space"], x["use_regex"]) for x in steps[1:]] == [("ByteLevel", False, False)]

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts data[starts[k]:ends[k]], one text after the other, and how many each has."""
        whole = self._needs_library(data, starts, ends) if self.by_run else np.ones(len(starts), bool)
        if not self.by_run:
            return self._by_library([bytes(data[s:e]).decode() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
        ids, counts = self._by_runs(data, starts, ends)
        if not whole.any():
            return ids, counts
        bounds = np.concatenate([[0], np.cumsum(counts)])
        out, n = [], counts.copy()
        at = 0
        for k in np.flatnonzero(whole).tolist():
            own = np.array(self.library.encode(data[starts[k] : ends[k]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
            out += [ids[at : bounds[k]], own]
            at, n[k] = bounds[k + 1], len(own)
        return np.concatenate([*out, ids[at:]]), n

    def _by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = [np.array(e.ids, np.uint32) for e in self.library.encode_batch(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *out]), np.array([len(x) for x in out], np.int64)

    def _needs_library(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The texts of which runs alone don't tell the ids."""
        at = [np.flatnonzero((data[:-1] == 39) & _AFTER_QUOTE[data[1:]]), np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))] if len(data) > 1 else []
        lead = np.flatnonzero(data >= 192)
        if len(lead):
            b = data[np.minimum(lead[:, None] + np.arange(2), len(data) - 1)].astype(np.int64)
            code = np.where(b[:, 0] < 224, (b[:, 0] & 31) << 6 | b[:, 1] & 63, 0xFFFFFF)
            distinct, which = np.unique(code, return_inverse=True)
            for c in distinct.tolist():
                if c not in self.plain:
                    self.plain[c] = c < 0x800 and _plain_letter(c)
            at.append(lead[~np.array([self.plain[c] for c in distinct.tolist()])[which]])
        out = np.zeros(len(starts), bool)
        for x in at:
            out[np.searchsorted(starts, x, "right") - 1] = True
        return out & (ends > starts)

    def _by_runs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = LOWER[data]
        kind = _KIND[low]
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
        new = np.ones(len(kind), bool)
        new[1:] = kind[1:] != kind[:-1]
        new |= kind == _DIGIT
        new[starts[ends > starts]] = True
        edge = np.append(np.flatnonzero(new), len(kind))
        begin, end = edge[:-1], edge[1:]
        used = kind[begin] != _SPACE
        begin, end = begin[used], end[used]
        which, hashes, first = coded_words(low, begin, end)
        slot = self._slots(hashes, low, begin[first], end[first])[which]
        each = self.first[slot + 1] - self.first[slot]
        before = np.concatenate([[0], np.cumsum(each)])
        run = np.append(np.searchsorted(begin, starts), len(begin))
        return self.ids[ragged(self.first[slot], each)], before[run[1:]] - before[run[:-1]]

    def _slots(self, hashes: np.ndarray, low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The slots of distinct runs; runs not seen before are encoded. A known run has the hash and the bytes."""
        if len(self.known) + len(hashes) > CACHE_WORDS:
            self._forget()
        at = np.searchsorted(self.known, hashes)
        out = np.full(len(hashes), -1, np.int64)
        inside = np.flatnonzero(at < len(self.known))
        inside = inside[self.known[at[inside]] == hashes[inside]]
        slot = self.slot[at[inside]]
        length = end[inside] - begin[inside]
        fits = length == self.text_first[slot + 1] - self.text_first[slot]
        inside, slot, length = inside[fits], slot[fits], length[fits]
        differs = low[ragged(begin[inside], length)] != self.text[ragged(self.text_first[slot], length)]
        wrong = np.zeros(len(inside), bool)
        wrong[np.repeat(np.arange(len(inside)), length)[differs]] = True
        out[inside[~wrong]] = slot[~wrong]
        fresh = np.flatnonzero(out < 0)
        if len(fresh):
            made = [self._run(low[begin[k] : end[k]].tobytes()) for k in fresh.tolist()]
            length = np.array([len(x) for x in made])
            out[fresh] = slots = len(self.first) - 1 + np.arange(len(fresh))
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in made for i in x), np.uint32, int(length.sum()))])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(length)])
            size = end[fresh] - begin[fresh]
            self.text = np.concatenate([self.text, low[ragged(begin[fresh], size)]])
            self.text_first = np.concatenate([self.text_first, self.text_first[-1] + np.cumsum(size)])
            order = np.argsort(hashes[fresh])
            place = np.searchsorted(self.known, hashes[fresh][order])
            self.known = np.insert(self.known, place, hashes[fresh][order])
            self.slot = np.insert(self.slot, place, slots[order])
        return out

    def _run(self, run: bytes) -> list[int]:
        if run[0] < 128 and run.isalnum() and run.isascii():
            text = run.decode()
        else:
            try:
                text = run.decode().lower()
            except UnicodeDecodeError:  # part of a text that goes to the library whole
                return []
            text = "".join(self.written[b] for b in text.encode())
        return [t.id for t in self.model.tokenize(text)]


def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker and file."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def encoded_blocks(batch: pa.RecordBatch, column: str, path: str, limit: int = 1 << 20):
    """Yields (first row, rows, ids, counts) for runs of rows of about ``limit`` bytes of text; null is empty."""
    for first, data, starts, ends in text_blocks(batch, column, limit):
        yield first, len(starts), *tokenizer(path).encode(data, starts, ends)
