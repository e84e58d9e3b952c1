"""Secret scans: patterns, and character Markov models of random strings against ordinary identifiers.

Everything here is DataFrame functions; no row passes through Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The pattern, the group that carries the value, and the least length of that value, by kind in order.
PATTERNS = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
#: A pattern with the same matches of sufficient length, where the pattern itself matches nearly anything.
_LONG = {"hex": r"[0-9a-f]{16,}"}
#: What can be a secret of no known pattern: runs of these characters of this length at least.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = (*PATTERNS, "markov")
#: States of the Markov models: the characters of candidates, and 0 for any other.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1
#: The least number of array elements that are folded in one go; more are folded in blocks of the square root of their number.
BLOCK = 64


def labelled_samples(docs: DataFrame, words: int = 20_000, strings: int = 4_000, documents: int = 1_000) -> DataFrame:
    """Labelled training samples (sample, label): 1 for random strings, 0 for ordinary words and identifiers.

    Random strings are digests in base 64 and hexadecimal, a fixed set. Ordinary ones are the distinct words of at
    least four letters of ``documents`` documents, chosen by a hash of their text, alone and joined as identifiers are;
    ``words`` bounds them. These bounds are for fitting the models; scans cover everything.
    """
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")).cast("binary"), 512)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), r"\s", "")
    random = docs.sparkSession.range(strings).select(F.when(F.col("id") % 4 < 3, base64).otherwise(digest).alias("sample"), F.lit(1).alias("label"))
    hashed = docs.filter(F.col("text").isNotNull()).select("text", F.xxhash64("text").alias("h"))
    least = hashed.groupBy(F.pmod("h", F.lit(documents))).agg(F.min("h").alias("h"))
    chosen = hashed.filter(F.col("h").isin([r["h"] for r in least.select("h").collect()])).select("text").distinct()
    word = chosen.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z]{4,}"), F.lit(0))).alias("w")).distinct().orderBy(F.xxhash64("w"), "w").limit(words)
    low = F.lower("w")
    forms = F.array(F.col("w"), F.upper("w"), F.concat(low, F.lit("_"), low), F.concat(low, F.lit("-"), low), F.concat(low, F.lit("/"), low), F.concat(low, F.initcap("w")), F.concat(low, F.lit("="), low), F.concat(low, F.lit("_1"), F.lit("2")))
    return random.unionByName(word.select(F.explode(forms).alias("sample"), F.lit(0).alias("label")))


def _states(token: Column) -> Column:
    """The states of a string's characters, in order."""
    codes = F.array(*[F.lit(ALPHABET.find(chr(k)) + 1) for k in range(128)])
    # One character after the other; what isn't ASCII lies beyond the table.
    return F.transform(F.split(token, ""), lambda c: F.coalesce(F.get(codes, F.ascii(c)), F.lit(0)))


def _transitions(token: Column) -> Column:
    """Each pair of neighbouring states, as one number. The string has two characters at least."""

    def pairs(states: Column) -> Column:
        n = F.size(states) - 1
        return F.zip_with(F.slice(states, 1, n), F.slice(states, 2, n), lambda a, b: a * STATES + b)

    # A lambda holds the states, which else would be made for each use.
    return F.get(F.transform(F.array(_states(token)), pairs), 0)


def train_models(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios of character transitions, random over ordinary, as a flat table of states by states.

    Transitions of samples (sample, label) are counted in Spark; two tables of 68 by 68 at most reach the driver. Null
    and one-character samples have none. Without samples of a class its transitions are uniform.
    """
    pairs = samples.filter(F.length("sample") > 1).select("label", F.explode(_transitions(F.col("sample"))).alias("p"))
    counts = {label: [smoothing] * STATES**2 for label in (0, 1)}
    for r in pairs.groupBy("label", "p").count().collect():
        counts[int(bool(r["label"]))][r["p"]] += r["count"]
    table = [0.0] * STATES**2
    for a in range(STATES):
        total = {label: sum(counts[label][a * STATES : (a + 1) * STATES]) for label in counts}
        for k in range(a * STATES, (a + 1) * STATES):
            table[k] = math.log(counts[1][k] / total[1]) - math.log(counts[0][k] / total[0])
    return table


def fit(samples: DataFrame, held: int = 5) -> tuple[list[float], float]:
    """The table of ratios, and the least mean ratio of a secret, chosen on samples that the table hasn't seen.

    One sample of ``held``, by hash, is left out of a first table, which scores it. The mean lies half way between what
    all but a thousandth of the ordinary samples stay below and what all but a hundredth of the random ones exceed; 0.5
    where either class is missing. The table that is returned is of all samples.
    """
    out = F.pmod(F.xxhash64("sample"), F.lit(held)) == 0
    table = train_models(samples.filter(~out))
    scored = samples.filter(out & (F.length("sample") >= 20)).select("label", (likelihood_ratio(F.col("sample"), table) / (F.length("sample") - 1)).alias("mean"))
    low, high = scored.agg(F.percentile(F.when(F.col("label") == 0, F.col("mean")), 0.999), F.percentile(F.when(F.col("label") == 1, F.col("mean")), 0.01)).first()
    return train_models(samples), 0.5 if low is None or high is None else (low + high) / 2


def _ratios(table: list[float]) -> Column:
    return F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")


def likelihood_ratio(token: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of a string, summed over its transitions."""
    ratios = _ratios(table)
    return F.when(F.length(token) > 1, F.aggregate(_transitions(token), F.lit(0.0), lambda acc, k: acc + F.get(ratios, k))).otherwise(0.0)


def best_window(token: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of a string (total), and that of the part of it where it is largest (sum, of transitions first to last - 1)."""
    ratios = _ratios(table)
    zero = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("total"), F.lit(0.0).alias("run"), F.lit(0).alias("begin"), F.lit(0.0).alias("sum"), F.lit(0).alias("first"), F.lit(0).alias("last"))

    def add(acc: Column, k: Column) -> Column:
        ratio = F.get(ratios, k)
        fresh = acc["run"] <= 0
        run = F.when(fresh, ratio).otherwise(acc["run"] + ratio)
        begin = F.when(fresh, acc["at"]).otherwise(acc["begin"])
        more = run > acc["sum"]
        return F.struct(
            (acc["at"] + 1).alias("at"), (acc["total"] + ratio).alias("total"), run.alias("run"), begin.alias("begin"),
            F.when(more, run).otherwise(acc["sum"]).alias("sum"), F.when(more, begin).otherwise(acc["first"]).alias("first"), F.when(more, acc["at"] + 1).otherwise(acc["last"]).alias("last"),
        )

    return F.when(F.length(token) > 1, F.aggregate(_transitions(token), zero, add))


def _blocks(items: Column) -> Column:
    """Numbers of blocks of an array's elements; block k is _block(items, k)."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(items) - 1) / _block_size(items)).cast("int")))


def _block_size(items: Column) -> Column:
    return F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(F.size(items)))).cast("int")


def _block(items: Column, k: Column) -> Column:
    return F.slice(items, k * _block_size(items) + 1, _block_size(items))


def _runs(text: Column, pattern: str, kind: int) -> Column:
    """All leftmost, non-overlapping matches as (start, kind, end, match), in code points.

    The pieces between matches tell where these are; texts that can't match skip both. Lengths are added up in blocks, as
    an array that grows by one element at a time is copied each time.
    """
    p = F.lit(pattern)
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")
    lengths = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0)), lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("match")))  # the last gap has no match

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["match"])
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["match"].alias("match"))
        return F.when(x["match"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out")))

    def placed(items: Column) -> Column:
        parts = F.transform(_blocks(items), lambda k: F.aggregate(_block(items, k), F.struct(F.lit(0).alias("at"), empty.alias("out")), add))
        return F.get(F.transform(F.array(parts), shifted), 0)

    def shifted(parts: Column) -> Column:
        sums = F.aggregate(parts, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
        moved = F.zip_with(parts, F.slice(sums, 1, F.size(parts)), lambda x, by: F.transform(x["out"], lambda m: F.struct((m["start"] + by).alias("start"), m["kind"].alias("kind"), (m["end"] + by).alias("end"), m["match"].alias("match"))))
        return F.flatten(moved)

    return F.when(text.rlike(pattern), F.get(F.transform(F.array(lengths), placed), 0)).otherwise(empty)


def _blanked(text: Column, pattern: str, value) -> Column:
    """The text with spaces in the place of each match whose value is long enough, which keeps all places."""
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, h: F.concat(g, F.when(h.isNull(), "").when(value(h), F.repeat(F.lit(" "), F.length(h))).otherwise(h)))
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


def _fresh(name: str, columns: list[str]) -> str:
    """The name, longer if a column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def scan(docs: DataFrame, table: list[float], mean: float = 0.5, total: float = 12.0, column: str = "spans") -> DataFrame:
    """docs with ``column`` added: array of (start, kind, end) in code points, by start, then kind; kind indexes KINDS.

    The patterns' matches whose value is long enough come whole. What is left, once these are blanked kind by kind, has
    runs of secret-like characters; those of at least 20 are added whole where the log-likelihood ratio of random over
    ordinary is at least ``total``, and ``mean`` a transition, or else their best part where the same holds for it and it
    has 20 characters. Null and empty texts have no spans; equal rows get equal spans; an empty table gives no rows; a
    column of docs of the same name is replaced, and no other. Time grows with a text's length, and with the power 1.5
    of its matches.
    """
    out = docs.drop(column)
    columns = out.columns
    name = {k: _fresh(f"__{k}", columns) for k in (*PATTERNS, "left", "markov")}
    text = F.coalesce(F.col("text"), F.lit(""))

    def long_enough(kind: str):
        pattern, group, least = PATTERNS[kind]
        return lambda match: F.length(F.regexp_extract(match, pattern, group) if group else match) >= least

    def matches(k: int, kind: str) -> Column:
        value = long_enough(kind)
        return F.transform(F.filter(_runs(text, _LONG.get(kind, PATTERNS[kind][0]), k), lambda m: value(m["match"])), _bare)

    out = out.withColumns({name[kind]: matches(k, kind) for k, kind in enumerate(PATTERNS)} | {name["left"]: text})
    for kind, (p, _, _) in PATTERNS.items():
        out = out.withColumn(name["left"], F.when(F.size(name[kind]) > 0, _blanked(F.col(name["left"]), _LONG.get(kind, p), long_enough(kind))).otherwise(F.col(name["left"])))

    def scored(m: Column) -> Column:
        whole = lambda w: (w["total"] >= total) & (w["total"] >= mean * w["at"])
        part = lambda w: (w["sum"] >= total) & (w["sum"] >= mean * (w["last"] - w["first"])) & (w["last"] - w["first"] >= 19)
        span = lambda w: F.when(whole(w), _bare(m)).when(part(w), F.struct((m["start"] + w["first"]).alias("start"), m["kind"].alias("kind"), (m["start"] + w["last"] + 1).alias("end")))
        return F.get(F.transform(F.array(best_window(m["match"], table)), span), 0)

    odd = F.filter(F.transform(_runs(F.col(name["left"]), CANDIDATE, len(PATTERNS)), scored), lambda x: x.isNotNull())
    out = out.withColumn(name["markov"], odd)
    spans = F.array_sort(F.concat(*[F.col(name[k]) for k in KINDS]))
    return out.withColumn(column, spans).select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{column}`"))


def _bare(m: Column) -> Column:
    return F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, overlapping ones as one, replaced by a mark. Null stays null.

    Spans are taken in blocks, each with its part of the text, as any piece of a string is found by counting from its start.
    """

    def part(k: Column, items: Column) -> Column:
        begin = F.coalesce(F.array_max(F.transform(F.slice(items, 1, k * _block_size(items)), lambda s: s["end"])), F.lit(0))
        last = F.coalesce(F.array_max(F.transform(_block(items, k), lambda s: s["end"])), F.lit(0))
        end = F.when((k + 1) * _block_size(items) >= F.size(items), F.length(text)).otherwise(F.greatest(begin, last))
        own = F.struct(begin.alias("begin"), F.substring(text, begin + 1, end - begin).alias("text"))
        return F.get(F.transform(F.array(own), lambda x: filled(_block(items, k), x)), 0)

    def filled(items: Column, own: Column) -> Column:
        def add(acc: Column, s: Column) -> Column:
            before = F.substring(own["text"], acc["at"] - own["begin"] + 1, s["start"] - acc["at"])
            grown = F.when(s["start"] >= acc["at"], F.concat(acc["out"], before, F.lit(mark))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), grown.alias("out"))

        start = F.struct(own["begin"].alias("at"), F.lit("").alias("out"))
        return F.aggregate(items, start, add, lambda acc: F.concat(acc["out"], F.substring(own["text"], acc["at"] - own["begin"] + 1, F.length(own["text"]))))

    return F.when(F.size(spans) > 0, F.array_join(F.transform(_blocks(spans), lambda k: part(k, spans)), "")).otherwise(text)
