"""The corpus pipeline, stage by stage, against brute force."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from kinelake.llm.common import stored
from tests.llm.conftest import table, words
from tests.llm.test_documents import brute
from tests.llm.test_groups import linked_components
from tests.llm.test_secrets import base
from tests.llm.test_tokens import check_packing


def test_stages(spark, tmp_path, awkward):
    item = words(30, 4242)
    rows = list(awkward) + [(100 + k, words(60, k)) for k in range(40)] + [(200 + k, words(60, k)) for k in range(0, 40, 4)] + [(300, words(40, 7) + " " + item), (301, "12345"), (302, words(20, 8) + " token = abcdef012345678999 end")]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = table(spark, rows)
    seen = {}
    for name, stage in pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()] if "text" in docs.columns else []
        docs = stored(stage(spark, docs, f"file://{tmp_path}"), name)
        seen[name] = (before, docs.collect(), docs.columns)
    before, after, columns = seen["language_id"]
    assert {r["doc_id"] for r in after} == {i for i, _ in before} - {1, 2, 3, 301}
    before, after, _ = seen["jaccard_join"]
    kept = sorted((r["doc_id"] for r in after), key=repr)
    one_each = {c for i, n, c in linked_components(before, 80, 5) if n}  # here each group has an id, or is a text without one
    assert kept == sorted([*one_each, *(i for i, n, _ in linked_components(before, 80, 5) if not n)], key=repr)
    before, after, _ = seen["decontamination"]
    assert sorted((r["doc_id"] for r in after), key=repr) == sorted((i for i, _, hit, _ in brute(before, [(1, item)]) if not hit), key=repr)
    before, after, _ = seen["secret_scan"]
    texts = {r["doc_id"]: r for r in after}
    assert len(after) == len(before)
    for i, t in before:
        assert ("[SECRET]" in texts[i]["text"]) >= bool(base(t))
        assert texts[i]["n_chars"] == len(texts[i]["text"])
    before, after, columns = seen["packing"]
    check_packing(after, before, 4096)
    assert all(seen[n][2] == ["doc_id", "text", "lang", "source", "n_chars"] for n in list(seen)[:-1])


def test_rows_are_dropped_by_themselves(spark, tmp_path):
    """Passages are found without doc_id too, and a clean row stays whose doc_id a dropped row has."""
    item = words(30, 4242)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    clean, copied, other, null = words(60, 1), words(60, 2), words(60, 3), words(60, 4)
    docs = table(spark, [(None, words(40, 7) + " " + item), (None, null), (1, copied), (2, copied), (2, other), (3, item), (3, clean)])
    kept = pipeline.near_copies(spark, docs, f"file://{tmp_path}")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.filter("text NOT LIKE '%" + item + "'").collect()) == sorted([(0, null), (1, copied), (2, other), (3, clean)])
    assert kept.count() == 6
    kept = pipeline.benchmark_passages(spark, docs, f"file://{tmp_path}")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(0, null), (1, copied), (2, copied), (2, other), (3, clean)])


@pytest.mark.parametrize("stored_first", [False, True])
def test_one_row_of_each_group_stays(spark, stored_first):
    """Equal rows, rows with one id, and rows without an id: one of each group, that with the least id if there is one."""
    text, other, alone = words(60, 1), words(60, 2), words(60, 3)
    rows = [(5, text), (5, text), (None, text), (None, other), (None, other + " more"), (None, other), (7, alone), (8, None), (8, None), (9, " "), (None, "")]
    docs = table(spark, rows).repartition(4)
    docs = stored(docs, "documents") if stored_first else docs
    kept = sorted(((r["doc_id"], r["text"]) for r in pipeline.near_copies(spark, docs, "").collect()), key=repr)
    assert len(kept) == 7 and (5, text) in kept and (7, alone) in kept
    assert [t for i, t in kept if i is None and t] in ([other], [other + " more"])
    assert sorted(repr(k) for k in kept if not (k[1] or "").strip()) == sorted(map(repr, [(8, None), (8, None), (9, " "), (None, "")]))


def _shuffled(plan) -> int:
    """Rows with a text that the exchanges of a plan that has run wrote."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return _shuffled(plan.executedPlan())
    if "QueryStage" in plan.nodeName():
        return _shuffled(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if plan.nodeName() == "Exchange" and "text" in list(plan.schema().fieldNames()) else 0
    return own + sum(_shuffled(plan.children().apply(k)) for k in range(plan.children().size()))


def test_rows_that_stay_are_not_shuffled(spark, tmp_path):
    """Where too many rows go to send them to all tasks, the texts of the others still aren't moved."""
    item = words(30, 4242)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = stored(table(spark, [(k, words(40, k) + (" " + item if k % 10 == 0 else "")) for k in range(300)]), "documents")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = pipeline.benchmark_passages(spark, docs, f"file://{tmp_path}")
        assert sorted(r["doc_id"] for r in kept.collect()) == [k for k in range(300) if k % 10]
        assert 30 <= _shuffled(kept._jdf.queryExecution().executedPlan()) < 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_large_rows_are_written_in_small_groups(spark, tmp_path):
    """Row groups of few large rows keep to their size, though Parquet's writers look at it every hundred rows by default."""
    import glob

    import pyarrow.parquet as pq

    rows = spark.range(0, 40, 1, 1).select(F.sha2(F.col("id").cast("string"), 512).alias("k")).select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(8000)), lambda i: F.sha2(F.concat("k", i.cast("string")), 512)), "").alias("text"))
    [file] = glob.glob(f"{stored(rows, 'large', 4 << 20).stored_at.removeprefix('file://')}/*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert meta.num_rows == 40 and max(meta.row_group(k).column(0).total_compressed_size for k in range(meta.num_row_groups)) < 6 << 20


def test_other_columns_stay_as_they_are(spark, tmp_path):
    """Columns by the names that operators use for their own come back with their values."""
    spark.createDataFrame([(1, words(30, 4242))], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    names = ["score", "lang_pred", "ambiguous", "__row", "number", "row", "c0", "component", "spans", "kind", "clean", "n", "class", "a.b", "segment"]
    docs = table(spark, [(k, words(60, k) + (" token = abcdef012345678999" if k == 2 else "")) for k in range(4)])
    docs = stored(docs.select(F.col("doc_id").alias("first"), "*", *[(F.col("doc_id") * 1000 + j).alias(c) for j, c in enumerate(names)]), "documents")
    for name, stage in pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, f"file://{tmp_path}"), name)
        assert docs.columns == ["first", "doc_id", "text", "lang", "source", "n_chars", *names]
        assert sorted(tuple(r)[6:] for r in docs.collect()) == [tuple(1000 * k + j for j in range(len(names))) for k in range(4)]
    assert pipeline.packing(spark, docs, "").count() == 4


def test_nothing(spark, tmp_path):
    """Empty tables go through all stages; so do documents without text."""
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for rows in ([], [(1, None), (None, "")]):
        docs = table(spark, rows)
        for name, stage in pipeline.STAGES:
            docs = stored(stage(spark, docs, f"file://{tmp_path}"), name)
        assert docs.collect() == []
