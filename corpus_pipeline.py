"""A corpus from documents to packed token sequences, stage by stage.

All stages take empty tables, null values in any column, repeated rows and texts of any length. They read doc_id and text
(language also lang, secrets also n_chars) and hand on all other columns as they are, whatever their names; none is sampled or cut. Stages
that drop rows tell them apart by a row number of 64 bits, made of a row's place in its file; of n rows some n x dropped / 2^64
that aren't meant share one and go too, which is far less than one below 10^9.
"""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm.common import FILTER_BITS, bit_filter, discard, maybe, stored
from kinelake.llm.decontamination import build_index, phrase_matches
from kinelake.llm.jaccard import jaccard_groups
from kinelake.llm.language import identify, train_codes
from kinelake.llm.packing import pack_documents
from kinelake.llm.secrets import fit, labelled_samples, redact, scan


def _names(docs: DataFrame) -> dict[str, str]:
    """Names for the columns of docs that no operator's own columns have: c0, c1 and so on, and text."""
    return {c: c if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)}


def _plain(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`").alias(name) for c, name in _names(docs).items()], *more)


def _restored(plain: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, under their names, from what an operator made of its plain form."""
    return plain.select(*[F.col(name).alias(c) for c, name in _names(docs).items()])


def _numbered(docs: DataFrame) -> DataFrame:
    """The plain form of docs with a row number, the same whenever it's read: of the file and the row's place there."""
    try:
        about = docs.metadataColumn("_metadata")
        return _plain(docs, F.xxhash64(about["file_path"], about["row_index"]).alias("number"))
    except AnalysisException:  # not a table of files
        return _numbered(stored(docs, "rows"))


def _without(docs: DataFrame, numbered: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without the rows of these numbers.

    Rows that a filter of fixed size tells apart from these stay where they are. Only the others, which are these and a
    few more, are joined to the numbers, so that texts needn't be shuffled however many rows go.
    """
    dropped = stored(rows.select("number"), "dropped")
    place = lambda c: F.col(c).bitwiseAND(F.lit(FILTER_BITS - 1))
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(dropped.select(place("number").alias("place"))))

    @F.pandas_udf("boolean")
    def unsure(places: pd.Series) -> pd.Series:
        return pd.Series(maybe(bits.value, places.to_numpy()))

    marked = numbered.withColumn("unsure", unsure(place("number")))
    staying = marked.filter(~F.col("unsure")).drop("unsure", "number")
    others = marked.filter("unsure").drop("unsure").join(dropped, "number", "left_anti").drop("number")
    return _restored(staying.unionAll(others), docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts, texts without a letter and ambiguous ones go."""
    model = train_codes(docs)
    return _restored(identify(_plain(docs), model).filter(~F.col("ambiguous")), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their 5-word shingles, directly or through others, one row.

    It has the least doc_id (a null one if there is no other); of several such rows, equal ones too, it is that of the
    least row number. Documents without words link with nothing and stay.
    """
    numbered = _numbered(docs)
    texts = numbered.select(F.col(_names(docs)["doc_id"]).alias("doc_id"), "text", "number")
    groups = stored(jaccard_groups(texts, percent=80, width=5, key="number").filter("component IS NOT NULL").select("component", "doc_id", "number"), "groups")
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "number")).alias("first"))
    kept = stored(first.select("first.number"), "kept")
    return _without(docs, numbered, groups.join(kept, "number", "left_anti"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of ten consecutive words (or all, if fewer) of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    numbered = _numbered(docs)
    found = phrase_matches(build_index(numbered.select(F.col("number").alias("doc_id"), "text")), items, window=10)
    return _without(docs, numbered, found.filter(F.size("matches") > 0).select(F.col("doc_id").alias("number")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of each secret; n_chars counts what a changed text has then. Null texts stay null."""
    found = scan(docs.select(F.struct("*").alias("row"), "text"), *fit(labelled_samples(docs)))
    out = found.withColumn("clean", redact(F.col("text"), F.col("spans")))
    changed = {"text": F.col("clean"), "n_chars": F.when(F.size("spans") > 0, F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, packed into sequences of at most 4096 tokens."""
    return pack_documents(docs, capacity=4096, end_id=1)


STAGES = [("language_id", language), ("jaccard_join", near_copies), ("decontamination", benchmark_passages), ("secret_scan", secrets), ("packing", packing)]
#: Markov models and tokenizers have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
            discard(before)
    return docs
