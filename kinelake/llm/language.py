"""Language identification with error-correcting output codes over byte n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinelake.llm.common import LOWER, in_batches, text_blocks

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
#: Letters of ASCII and all bytes of longer characters; anything else is one kind of gap.
_CLASS = LOWER.copy()
_CLASS[[b for b in range(128) if not chr(b).isalpha()]] = 32


@dataclass
class CodeModel:
    """Codewords (languages x bits of +1 and -1), the bits' n-gram weights, biases and reliabilities, and a scale."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    scale: float


def codewords(n: int) -> np.ndarray:
    """A code for n classes: all different two-way splits for up to 7 classes, else 8 * ceil(log2 n) + 7 fixed random ones."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        splits = np.arange(1, 1 << (n - 1))
        return np.where(splits[None, :] >> np.arange(n)[:, None] & 1, 1, -1).astype(np.int8)
    random = np.random.default_rng(1)
    bits = 8 * int(np.ceil(np.log2(n))) + 7
    best, apart = None, -1
    for _ in range(64):  # the code whose nearest two words are farthest apart
        code = np.where(random.random((n, bits)) < 0.5, 1, -1).astype(np.int8)
        code = code[:, np.abs(code.sum(axis=0, dtype=int)) < n]
        gaps = (code.shape[1] - code.astype(int) @ code.T) // 2 + np.eye(n, dtype=int) * bits
        if gaps.min() > apart:
            best, apart = code, int(gaps.min())
    return best


def gram_buckets(data: np.ndarray) -> np.ndarray:
    """Hash buckets of all byte n-grams of a text, lower-cased in ASCII, of each order in turn."""
    b = _CLASS[data].astype(np.uint32)
    out = []
    for n in ORDERS:
        if len(b) >= n:
            h = np.full(len(b) - n + 1, n * 0x165667B1 & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                h = (h ^ b[k : k + len(h)]) * _FACTORS[k]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            out.append((h >> np.uint32(17)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def train_codes(docs: DataFrame, label: str = "lang", smoothing: float = 0.5) -> CodeModel:
    """Learn from every row of docs (text, label) whose label isn't null.

    Counts of n-grams by language are summed in Spark; only languages x 32768 sums reach the driver, whatever the
    input's size. A bit's classifier weighs an n-gram by the log-ratio of its mean probability in the languages whose
    codeword has +1 there to that in the others. Null and empty texts add nothing. Without any labelled row the model
    has no language and predicts ``und``.
    """

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            for first, data, starts, ends in text_blocks(batch, "text"):
                for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                    own = total.setdefault(names[first + k], np.zeros(BUCKETS, np.int64))
                    own += np.bincount(gram_buckets(data[s:e]), minlength=BUCKETS)
        for name, own in total.items():
            used = np.flatnonzero(own)
            yield pa.record_batch([pa.array([name] * len(used), pa.string()), pa.array(used), pa.array(own[used])], names=["lang", "gram", "n"])

    labelled = docs.filter(F.col(label).isNotNull()).select("text", F.col(label).cast("string").alias("lang"))
    sums = labelled.transform(in_batches, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sums["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    counts[sums["lang"].map({x: k for k, x in enumerate(languages)}).to_numpy(int), sums["gram"].to_numpy(int)] = sums["n"]
    return fit_codes(languages, counts, smoothing)


def fit_codes(languages: list[str], counts: np.ndarray, smoothing: float = 0.5) -> CodeModel:
    """The model from the languages' n-gram counts."""
    codes = codewords(len(languages))
    share = (counts + smoothing) / (counts + smoothing).sum(axis=1, keepdims=True)
    bits = codes.shape[1]
    if len(languages) < 2:
        return CodeModel(languages, codes, np.zeros((BUCKETS, bits), np.float32), np.ones(bits), np.ones(bits), 1.0)
    weights = np.zeros((BUCKETS, bits), np.float32)
    bias, trust = np.zeros(bits), np.zeros(bits)
    for b in range(bits):
        one = codes[:, b] > 0
        weights[:, b] = np.log(share[one].mean(axis=0)) - np.log(share[~one].mean(axis=0))
        expected = share @ weights[:, b]
        low, high = expected[one].min(), expected[~one].max()
        bias[b] = -(low + high) / 2
        trust[b] = max((low - high) / 2, 1e-3)
    return CodeModel(languages, codes, weights, bias, trust / trust.sum(), float(4 / np.median(trust)))


def decode(model: CodeModel, margins: np.ndarray) -> tuple[int, float, float]:
    """The language with the least weighted logistic loss, its share of belief, and its lead over the second."""
    loss = np.logaddexp(0, -model.codes * (model.scale * margins)[None, :]) @ model.trust
    belief = np.exp(-model.codes.shape[1] * (loss - loss.min()))
    belief /= belief.sum()
    best = int(loss.argmin())
    rest = np.delete(belief, best)
    return best, float(belief[best]), float(belief[best] - (rest.max() if len(rest) else 0))


def identify(docs: DataFrame, model: CodeModel, lead: float = 0.2, with_text: bool = True) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous added, from the whole text and nothing else.

    A bit's margin is the mean weight of the text's n-grams, less its threshold; loss-weighted decoding picks the
    nearest codeword. Texts that are null or have no letter get ``und``, score 0, ambiguous. A document is ambiguous
    where the best language leads the second by less than ``lead``. Ties go to the first language by name; repeated
    rows get equal answers; empty tables give no rows; columns of docs with these names are replaced. Without
    ``with_text`` the texts aren't sent back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x bits floats
    result = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    kept = docs.drop("lang_pred", "score", "ambiguous")

    def predict(batches):
        own = shared.value
        for batch in batches:
            for first, data, starts, ends in text_blocks(batch, "text"):
                names, scores, unsure = [], [], []
                for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                    text = data[s:e]
                    if not own.languages or not _has_letter(text):
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        unsure.append(True)
                        continue
                    grams = gram_buckets(text)
                    if len(grams) > 2000:
                        total = np.bincount(grams, minlength=BUCKETS).astype(np.float32) @ own.weights
                    else:
                        total = own.weights[grams].sum(axis=0)
                    best, belief, ahead = decode(own, total / len(grams) + own.bias)
                    names.append(own.languages[best])
                    scores.append(min(1.0, max(0.0, belief)))
                    unsure.append(ahead < lead)
                rows = batch.slice(first, len(starts))
                rows = rows if with_text else rows.drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())], names=[*rows.schema.names, "lang_pred", "score", "ambiguous"])

    return kept.transform(in_batches, predict, T.StructType([f for f in kept.schema.fields if with_text or f.name != "text"] + result))


def _has_letter(data: np.ndarray) -> bool:
    head = data[:4096]
    if ((head >= 97) & (head <= 122) | (head >= 65) & (head <= 90)).any() or ((data >= 97) & (data <= 122) | (data >= 65) & (data <= 90)).any():
        return True
    return any(map(str.isalpha, data.tobytes().decode("utf-8", "ignore")))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """The documents that training never sees: crc32 of the id as text leaves 1 when divided by 3."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")), F.lit(0)) % 3 == 1
