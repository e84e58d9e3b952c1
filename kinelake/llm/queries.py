"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinelake.llm.secrets import PATTERNS, fit, labelled_samples, scan, written

    docs = _table(spark, sf_dir, "documents")
    found = scan(docs.select("doc_id", "text"), *fit(labelled_samples(docs))).drop("text")
    base = F.filter("spans", lambda s: s["kind"] < len(PATTERNS))
    return found.select(
        "doc_id",
        *[F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def _of_kind(k: int):
    return lambda s: s["kind"] == k


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinelake.llm.licences import scan_licences, train_licences

    docs = _table(spark, sf_dir, "documents")
    families = F.array_sort(F.array_distinct(F.transform("notices", lambda n: n["family"])))
    return scan_licences(docs, train_licences(docs)).select("doc_id", "n_paragraphs", F.size("notices").cast("long").alias("n_notices"), F.array_join(families, ",").alias("families"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinelake.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), capacity=4096, end_id=1)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinelake.llm.token_files import digest_token_files, write_token_files

    return digest_token_files(spark, write_token_files(_table(spark, sf_dir, "documents"), end_id=2))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinelake.llm.decontamination import build_index, phrase_matches

    index = build_index(_table(spark, sf_dir, "documents"))
    return digest_matches(phrase_matches(index, _table(spark, sf_dir, "benchmark"), window=10))


def digest_matches(found: DataFrame) -> DataFrame:
    """Counts and digests of the matches of each document."""
    spans = F.array_sort(F.transform("matches", lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))

    def cover(acc, m):
        fresh = F.greatest(F.lit(0).cast("long"), m["stop"] - F.greatest(m["start"], acc["reach"]))
        return F.struct((acc["n"] + fresh).alias("n"), F.greatest(acc["reach"], m["stop"]).alias("reach"))

    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"].cast("string"))))
    return found.select(
        "doc_id", "n_words",
        F.aggregate(spans, zero, cover, lambda acc: acc["n"]).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("matches") > 0).alias("contaminated"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinelake.llm.language import held_out, identify, train_codes

    docs = _table(spark, sf_dir, "documents")
    model = train_codes(docs.filter(~held_out()))
    found = identify(docs.select("doc_id", "text"), model, with_text=False)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinelake.llm.neighbours import build_graph, search

    vectors = _table(spark, sf_dir, "embeddings")
    queries = vectors.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return search(build_graph(vectors), queries, k=20)


def op8_warc_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinelake.llm.archives import convert, read_back, to_arc

    return read_back(convert(to_arc(_table(spark, sf_dir, "pages")), least=1000))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinelake.llm.chat import format_chats

    chats = format_chats(_table(spark, sf_dir, "conversations"))
    return chats.select("conv_id", "n_turns", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinelake.llm.jaccard import jaccard_groups

    return jaccard_groups(_table(spark, sf_dir, "documents"), percent=90, width=3)


def op11_exact_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinelake.llm.inner_products import top_products

    vectors = _table(spark, sf_dir, "embeddings")
    return top_products(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20, scale=64.0)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinelake.llm.merkle import leaf_digest, manifest, verify

    more = F.col("n_chars").cast("decimal(20,0)") + 1  # a count that was tampered with, in the documents that 7 divides the checksum of
    tampered = leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), more, F.col("text"))
    claim = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, tampered)
    found = verify(manifest(_table(spark, sf_dir, "documents"), claim=claim))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    proof = F.array_join(F.transform("proof", lambda d: F.lower(F.hex(d))), "")
    return found.select("doc_id", text("leaf"), text("subroot"), text("root"), F.sha2(proof.cast("binary"), 256).alias("proof_sha256"), text("folded_root"), "verified")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinelake.llm.infilling import fill_in_middle, restore

    digest = lambda text: F.sha2(text.cast("binary"), 256)
    made = fill_in_middle(_table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_licence_scan, op3_best_fit_packing, op4_token_files, op5_decontamination, op6_language_id, op7_nearest_neighbours, op8_warc_conversion, op9_chat_formatting, op10_jaccard_join, op11_exact_top_products, op12_merkle_manifest, op13_fill_in_middle)}
_LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TOKENS = "regexp_extract_all(" + _LOW + r", '[^\x20\x09-\x0D]+')"
_COUNTED = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
#: crc32 of an id's digits, a bit at a time.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
            lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))))"""
ORACLE: dict[str, str] = {
    "op5_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
        i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
        iw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g
               FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM i WHERE len(w) > 0)),
        dw AS (SELECT doc_id, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g
               FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw))),
        m AS (SELECT doc_id, k, n, item_id FROM dw JOIN iw USING (n, g)),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op10_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_TOKENS.format("text")} AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                                           ELSE list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' ')) END) AS g FROM d),
        u AS (SELECT doc_id, unnest(g) AS x FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * i >= 90 * (len(sa.g) + len(sb.g) - i)),
        r(node, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node)
        SELECT doc_id, len(g) AS n_shingles, component_id FROM s JOIN (SELECT node AS doc_id, min(c) AS component_id FROM r GROUP BY node) USING (doc_id)""",
    "op8_warc_conversion": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS last FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
        FROM m""",
    "op9_chat_formatting": """
        WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
                   FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM t),
        p AS (SELECT a.conv_id, a.place, sha256(string_agg(sha256(b.role || chr(1) || b.text), ',' ORDER BY b.place)) AS h
              FROM o a JOIN o b ON a.conv_id = b.conv_id AND b.place <= a.place GROUP BY a.conv_id, a.place),
        w AS (SELECT conv_id, max(place) AS n, max_by(h, place) AS h FROM p GROUP BY conv_id),
        k AS (SELECT n, h, min(conv_id) AS conv_id FROM w GROUP BY n, h),
        proper AS (SELECT DISTINCT p.place AS n, p.h FROM p JOIN w USING (conv_id) WHERE p.place < w.n),
        kept AS (SELECT k.conv_id, k.n FROM k ANTI JOIN proper USING (n, h)),
        r AS (SELECT o.conv_id, count(*) AS n_turns, string_agg('<|im_start|>' || mark(o.role) || chr(10) || mark(o.text) || '<|im_end|>' || chr(10), '' ORDER BY o.place) AS text
              FROM o SEMI JOIN kept USING (conv_id) GROUP BY o.conv_id)
        SELECT conv_id, n_turns, length(text) AS n_chars, sha256(text) AS text_sha256 FROM r""".replace("mark(o.role)", "replace(replace(o.role, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>')").replace("mark(o.text)", "replace(replace(o.text, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>')"),
    "op11_exact_top_products": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score FROM v q, v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""",
    "op12_merkle_manifest": f"""
        WITH RECURSIVE d AS (SELECT doc_id, lang, n_chars, {_COUNTED.format("doc_id")} || {_COUNTED.format("source")} || {_COUNTED.format("lang")} AS head, {_COUNTED.format("text")} AS tail FROM documents),
        v AS (SELECT doc_id, lang, sha256(head || {_COUNTED.format("n_chars")} || tail) AS leaf, sha256(head || {_COUNTED.format("(n_chars + 1)")} || tail) AS other FROM d),
        l AS (SELECT doc_id, lang, leaf, CASE WHEN crc(doc_id::VARCHAR) % 7 = 0 THEN other ELSE leaf END AS claim,
                     row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS w FROM v),
        n(lang, lev, i, d, w) AS (SELECT lang, 0, i, leaf, w FROM l
            UNION ALL SELECT lang, any_value(lev) + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), any_value(w + 1) // 2 FROM n WHERE w > 1 GROUP BY lang, i // 2),
        s AS (SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j, count(*) OVER () AS k FROM n WHERE w = 1),
        t(lev, i, d, w) AS (SELECT 0, j, subroot, k FROM s
            UNION ALL SELECT any_value(lev) + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), any_value(w + 1) // 2 FROM t WHERE w > 1 GROUP BY i // 2),
        c(doc_id, leaf, lang, j, lev, i, w, top, d, proof) AS (
            SELECT doc_id, leaf, l.lang, j, 0, i, w, w = 1, claim, '' FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang
            UNION ALL SELECT c.doc_id, c.leaf, c.lang, c.j, c.lev + 1, c.i // 2, (c.w + 1) // 2, (c.w + 1) // 2 = 1,
                   sha256(CASE WHEN c.i % 2 = 0 THEN c.d || coalesce(n.d, '') ELSE n.d || c.d END), c.proof || coalesce(n.d, '')
            FROM c LEFT JOIN n ON n.lang IS NOT DISTINCT FROM c.lang AND n.lev = c.lev AND n.i = xor(c.i, 1) WHERE NOT c.top),
        f(doc_id, leaf, lang, lev, i, w, d, proof) AS (
            SELECT c.doc_id, c.leaf, c.lang, 0, c.j, s.k, c.d, c.proof FROM c JOIN s ON c.lang IS NOT DISTINCT FROM s.lang WHERE c.top
            UNION ALL SELECT f.doc_id, f.leaf, f.lang, f.lev + 1, f.i // 2, (f.w + 1) // 2,
                   sha256(CASE WHEN f.i % 2 = 0 THEN f.d || coalesce(t.d, '') ELSE t.d || f.d END), f.proof || coalesce(t.d, '')
            FROM f LEFT JOIN t ON t.lev = f.lev AND t.i = xor(f.i, 1) WHERE f.w > 1)
        SELECT f.doc_id, leaf, subroot, r.d AS root, sha256(proof) AS proof_sha256, f.d AS folded_root, f.d = r.d AS verified
        FROM f JOIN s ON f.lang IS NOT DISTINCT FROM s.lang, (SELECT d FROM t WHERE w = 1) r WHERE f.w = 1""".replace("crc(doc_id::VARCHAR)", _CRC),
    "op13_fill_in_middle": """
        WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
        h AS (SELECT *, len(u) AS n, ('0x' || s[1:8])::UBIGINT AS h1, ('0x' || s[9:16])::UBIGINT AS h2, ('0x' || s[25:32])::UBIGINT AS h4 FROM u),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
                     CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p""",
}
