"""Words that a weak hash would take for each other, and words that share a hash, in all operators that compare hashes."""

import numpy as np
import pyarrow as pa
import pytest

from kinelake.llm import common, decontamination, jaccard, packing, token_files, tokens
from tests.llm.conftest import table, words
from tests.llm.test_documents import brute, found
from tests.llm.test_groups import linked_components
from tests.llm.test_tokens import PATH, check_packing, library

SWAP = str.maketrans("ab", "ba")


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(SWAP)
    return word


PAIRS = [(thue_morse(n), thue_morse(n).translate(SWAP)) for n in (64, 1024, 2048, 4096)]


@pytest.fixture(params=["as it is", "all long words share a hash"])
def weak(request, monkeypatch):
    """Also with a hash that can't tell longer words apart: bytes then have to."""
    if request.param != "as it is":
        whole = common.word_hashes

        def poor(data, begin, end):
            return np.where(end - begin > 8, np.uint64(5), whole(data, begin, end))

        for module in (common, jaccard):
            monkeypatch.setattr(module, "word_hashes", poor)
        tokens._loaded.clear()
        yield True
        tokens._loaded.clear()
    else:
        yield False


def test_hashes_differ():
    many = [w.encode() for pair in PAIRS for w in pair] + [bytes([a, b, *([c] * n)]) for a in range(1, 20) for b in range(1, 20) for c in (0, 97) for n in (0, 5, 6, 7, 30, 61, 62, 63, 64)]
    assert len(set(common.hash_words(many).tolist())) == len(set(many))
    joined = b"".join(many)
    end = np.cumsum([len(w) for w in many])
    assert (common.word_hashes(np.frombuffer(joined, np.uint8), end - [len(w) for w in many], end) == np.array([common.hash_words([w])[0] for w in many])).all()


def test_words_are_numbered_by_their_bytes(rng, weak):
    some = [bytes(rng.integers(97, 99, rng.integers(1, 100)).astype(np.uint8)) for _ in range(300)]
    many = [some[k] for k in rng.integers(0, 300, 3000)]
    end = np.cumsum([len(w) for w in many])
    which, hashes, first = common.coded_words(np.frombuffer(b"".join(many), np.uint8), end - [len(w) for w in many], end)
    assert [many[first[k]] for k in which] == many and len(first) == len(set(many)) == len(hashes)
    assert (hashes == common.hash_words([many[k] for k in first])).all() if not weak else True


def test_tokens(weak):
    texts = [w + " x " + v for w, v in PAIRS] + [v for _, v in PAIRS] + [w for w, _ in PAIRS] + [words(30, k) for k in range(20)]
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    out = []
    for _, _, ids, counts in tokens.encoded_blocks(batch, "text", PATH, 3000):
        bounds = np.concatenate([[0], np.cumsum(counts)])
        out += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert out == [library(t) for t in texts]


def test_packing_and_token_files(spark):
    rows = [(k, w) for k, w in enumerate([w for pair in PAIRS for w in pair] + [f"{w} {v}" for w, v in PAIRS])]
    check_packing(packing.pack_documents(table(spark, rows).coalesce(1), capacity=128).collect(), rows, 128)
    got = token_files.read_token_files(spark, token_files.write_token_files(table(spark, rows).coalesce(1))).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in got) == [(i, library(t) + [2]) for i, t in rows]


def test_decontamination(spark):
    rows = [(k, f"one {w} two {v} three {w}") for k, (w, v) in enumerate(PAIRS)] + [(10 + k, f"{v} {v}") for k, (_, v) in enumerate(PAIRS)]
    items = [(k, w) for k, (w, _) in enumerate(PAIRS)] + [(100 + k, f"{v} three {w}") for k, (w, v) in enumerate(PAIRS)]
    assert found(spark, rows, items) == brute(rows, items)


def test_terms_that_share_a_hash(weak):
    text = " ".join(f"{w} {v}" for w, v in PAIRS).encode()
    segment = decontamination.make_segment(np.array([1]), np.array([False]), np.frombuffer(text, np.uint8), np.array([0]), np.array([len(text)]))
    asked = [w.encode() for pair in PAIRS for w in pair] + [b"none", b"a" * 64]
    number = segment.numbers(asked, common.hash_words(asked))
    assert len(set(number[:8].tolist())) == 8 and number[8:].tolist() == [-1, -1]
    assert [segment.positions[segment.term_first[t] : segment.term_first[t + 1]].tolist() for t in number[:8]] == [[k] for k in range(8)]


def test_jaccard(spark):
    rows = [(2 * k + j, " ".join([w] * 3)) for k, pair in enumerate(PAIRS) for j, w in enumerate(pair)] + [(20, PAIRS[0][0]), (21, PAIRS[0][1])]
    got = sorted(tuple(r) for r in jaccard.jaccard_groups(table(spark, rows), percent=90, width=3).select("doc_id", "n_shingles", "component_id").collect())
    assert got == sorted(linked_components(rows, 90, 3)) == [(i, 1, i) for i, _ in rows]
