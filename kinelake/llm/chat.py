"""Chat formatting: logged snapshots of growing conversations collapse to the longest ones, which are then rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.llm.common import stored

#: Turns of a conversation that are summed before blocks are.
BLOCK_TURNS = 256
_SUMS = ("h0", "h1", "h2", "h3")


def _turn_hashes(place: Column, role: Column, text: Column) -> dict[str, Column]:
    """Four independent 40-bit hashes of a turn at its place; sums of millions of them stay within a long."""
    return {name: F.shiftrightunsigned(F.xxhash64(F.lit(k), place, role, text), 24) for k, name in enumerate(_SUMS)}


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """A row per turn: conv_id, place (from 1), and h0 to h3, hashes of the conversation up to that turn.

    Turns (conv_id, turn, role, text) are ordered by turn (null first), then role and text. Rows that repeat a whole turn
    count once; null role or text is empty; rows without conv_id belong to no conversation and are left out.
    A hash is the sum of hashes of (place, role, text), so it rolls on from turn to turn. Places and sums are first taken
    over blocks of turns and then over the blocks, so that one very long conversation is dealt to many tasks.
    """
    clean = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kept = clean.select("conv_id", "turn", F.xxhash64("role").alias("role"), F.sha2(F.col("text").cast("binary"), 256).alias("text")).distinct()
    kept = kept.withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    key = ["conv_id", "block"]
    inner = Window.partitionBy(*key).orderBy("turn", "role", "text")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = kept.groupBy(*key).agg(F.count("*").alias("n")).select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    placed = kept.join(sizes, key).select(*key, "turn", "role", "text", (F.col("earlier") + F.row_number().over(inner)).alias("place"))
    hashed = placed.withColumns(_turn_hashes(F.col("place"), F.col("role"), F.col("text"))).drop("role", "text")
    sums = hashed.groupBy(*key).agg(*[F.sum(h).alias(h) for h in _SUMS]).select(*key, *[F.coalesce(F.sum(h).over(before), F.lit(0)).alias(f"{h}_before") for h in _SUMS])
    running = Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return hashed.join(sums, key).select("conv_id", "place", *[(F.col(f"{h}_before") + F.sum(h).over(running)).alias(h) for h in _SUMS])


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """The conversations that are no prefix of a longer one, one of equal ones: conv_id, n_turns.

    Of equal conversations the smallest conv_id stays. An anti-join drops those whose whole hash is the hash of a
    proper prefix of another. An empty table gives no rows.
    """
    prefixes = stored(prefix_hashes(turns), "prefixes")  # a row of numbers per turn, used three times
    length = prefixes.groupBy("conv_id").agg(F.max("place").alias("n_turns"), *[F.max_by(h, "place").alias(h) for h in _SUMS])
    whole = length.groupBy("n_turns", *_SUMS).agg(F.min("conv_id").alias("conv_id"))
    longer = prefixes.join(length.select("conv_id", "n_turns"), "conv_id").filter(F.col("place") < F.col("n_turns"))
    proper = longer.select(F.col("place").alias("n_turns"), *_SUMS).distinct()
    return whole.join(proper, ["n_turns", *_SUMS], "left_anti").select("conv_id", "n_turns")


def render(turns: DataFrame, kept: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """The kept conversations as one text each: conv_id, n_turns, text.

    A turn is start, role, line break, text, end, line break. Start and end marks that occur in a role or text get a
    space after their first character, so that contents can't close a turn.
    """

    def plain(c: str) -> Column:
        out = F.coalesce(F.col(c), F.lit(""))
        for mark in (start, end):
            out = F.replace(out, F.lit(mark), F.lit(f"{mark[:1]} {mark[1:]}"))
        return out

    own = turns.join(kept, "conv_id", "left_semi").select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("raw"), plain("role").alias("shown"), plain("text").alias("text"))
    order = [F.col("turn"), F.xxhash64("role").alias("r"), F.sha2(F.col("raw").cast("binary"), 256).alias("t")]
    line = F.concat(F.lit(start), "shown", F.lit("\n"), "text", F.lit(end), F.lit("\n"))
    texts = own.select("conv_id", *order, line.alias("line")).groupBy("conv_id").agg(F.collect_set(F.struct("turn", "r", "t", "line")).alias("lines"))
    return texts.select("conv_id", F.size("lines").cast("long").alias("n_turns"), F.array_join(F.transform(F.array_sort("lines"), lambda x: x["line"]), "").alias("text"))


def format_chats(turns: DataFrame) -> DataFrame:
    """Maximal conversations of turns (conv_id, turn, role, text), rendered."""
    return render(turns, maximal_conversations(turns))
