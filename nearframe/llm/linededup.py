"""Repeated runs of lines by prefix doubling over line-ID sequences, in DataFrame functions only.

The suffixes of all documents' line sequences are grouped by their first 1, 2, 4, ... lines: these groups are the
intervals of the suffix array whose longest common prefix is at least h lines, and each is named by its first
place (by doc_id, then place).  A doubling step refines an interval by the name that the suffix h lines on has; suffixes that
stand alone drop out, and doubling ends when all do or their texts end.  Going down again through the levels gives
each place the length of the longest run that an earlier place has too: of an interval at depth d, those that agree
on 2^j lines more with an earlier member go on from d + 2^j; all others, and the first of each such part in its place,
stay at d for the next smaller step.  Runs that no run one line earlier contains are maximal; their later copies go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearframe.llm.common import Scratch, bound, prepare

PLACE = ["k1", "k2", "seq"]


def _blank(x: Column) -> Column:
    return F.translate(x, " \t\r", "") == ""


def _intervals(found: DataFrame) -> DataFrame:
    """Intervals of the column name with their first place, where there are two different places at least."""
    place = F.struct(*PLACE)
    return found.groupBy("name").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("name", "first")


def _refine(level: DataFrame, step: int, scratch: Scratch) -> DataFrame:
    """From intervals by h lines to intervals by h + step lines (step <= h): k1, k2, seq, first."""
    ahead = Window.partitionBy("k1", "k2").orderBy("seq").rangeBetween(step, step)
    pairs = level.withColumn("ahead", F.first("first").over(ahead)).where("ahead is not null")
    pairs = scratch.write(pairs.select(*PLACE, F.struct("first", "ahead").alias("name")), "pairs")
    # written: a join with an aggregate's output can't be split where one name is very common
    intervals = scratch.write(_intervals(pairs), "intervals")
    out = scratch.write(pairs.join(intervals, "name").select(*PLACE, "first"), "level")
    scratch.drop(pairs, intervals)
    return out


def _entering(level: DataFrame, deeper: DataFrame | None, depth: int) -> DataFrame:
    """What has its longest earlier copy from this depth on, below the next level, and the first of each interval."""
    if deeper is not None:
        level = level.join(deeper.where(F.struct(*PLACE) > F.col("first")).select(*PLACE), PLACE, "left_anti")
    return level.select(*PLACE, "first", F.lit(depth).cast("long").alias("d"), (F.struct(*PLACE) > F.col("first")).alias("own"))


def _extend(state: DataFrame, level: DataFrame, step: int, scratch: Scratch) -> DataFrame:
    """One step down: state and level in intervals (d, first); own: rows that look for their longest earlier copy."""
    there = level.select("k1", "k2", F.col("seq").alias("at"), F.col("first").alias("ahead"))
    tried = state.withColumn("at", F.col("seq") + F.col("d")).join(there, ["k1", "k2", "at"], "left").drop("at")
    tried = scratch.write(tried.withColumn("name", F.struct("d", "first", "ahead")), "tried")
    intervals = scratch.write(_intervals(tried.where("ahead is not null")).withColumnRenamed("first", "new"), "intervals")
    met = tried.join(intervals, "name", "left").select(*PLACE, "first", "d", "own", "new")
    mine = F.struct(*PLACE)
    # later members go on; the first of a part stays in its place, and goes on as what the others are copies of
    here = F.when(F.col("new").isNotNull() & (mine > F.col("new")), F.array(F.lit(True))).when(F.col("new").isNotNull(), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    split = met.withColumn("on", F.explode(here))
    out = split.select(
        *PLACE, F.when(F.col("on"), F.col("new")).otherwise(F.col("first")).alias("first"), F.when(F.col("on"), F.col("d") + step).otherwise(F.col("d")).alias("d"),
        (F.col("own") & (~F.col("on") | (mine > F.col("new")))).alias("own"),
    )
    out = scratch.write(out, "state")
    scratch.drop(tried, intervals)
    return out


def repeated_runs(levels: list[DataFrame], min_lines: int, scratch: Scratch) -> DataFrame:
    """(k1, k2, seq, lines): maximal runs of min_lines or more that an earlier place has too; levels: by 1, 2, 4, ... lines."""
    state: DataFrame | None = None
    for j in range(len(levels) - 1, -1, -1):
        if state is not None:
            state = _extend(state, levels[j], 1 << j, scratch)
        if (2 << j) > min_lines:  # what enters below can't reach min_lines
            new = _entering(levels[j], levels[j + 1] if j + 1 < len(levels) else None, 1 << j)
            state = scratch.write(new if state is None else state.union(new), "entered")
    if state is None:
        return levels[0].where("false").select(*PLACE, F.lit(0).cast("long").alias("lines"))
    later = state.where((F.col("own")) & (F.col("d") >= min_lines)).groupBy(*PLACE).agg(F.max("d").alias("lines"))
    before = F.max("lines").over(Window.partitionBy("k1", "k2").orderBy("seq").rangeBetween(-1, -1))
    return later.withColumn("before", before).where("before is null or before <> lines + 1").drop("before")


def later_copies(docs: DataFrame, min_lines: int, min_chars: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, seq) of lines to delete, and the runs (k1, k2, seq, lines); docs: k1, k2, text; seq counts lines that are not blank."""
    lines = docs.select("k1", "k2", F.posexplode(F.filter(F.split("text", "\n", -1), lambda x: ~_blank(x))).alias("seq", "line"))
    named = scratch.write(
        lines.select(
            "k1", "k2", F.col("seq").cast("long").alias("seq"), F.length("line").alias("chars"),
            F.struct(F.xxhash64("line").alias("id"), F.hash("line").alias("check")).alias("name"),
        ),
        "lines",
    )
    once = scratch.write(_intervals(named), "intervals")
    first = scratch.write(named.join(once, "name").select(*PLACE, "chars", "first"), "level")
    scratch.drop(named, once)
    later = F.struct(*PLACE) > F.col("first")
    single = first.where(later & (F.col("chars") >= min_chars)).select(*PLACE)
    levels = [first.select(*PLACE, "first")]
    while not levels[-1].isEmpty():
        levels.append(_refine(levels[-1], 1 << (len(levels) - 1), scratch))
    runs = scratch.write(repeated_runs(levels[: max(1, len(levels) - 1)], min_lines, scratch), "runs")
    # runs of a document can overlap: each begins where those before it have ended
    end = F.max(F.col("seq") + F.col("lines")).over(Window.partitionBy("k1", "k2").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    start = F.greatest(F.col("seq"), F.coalesce(end, F.lit(0)))
    parts = runs.select("k1", "k2", start.alias("s"), (F.col("seq") + F.col("lines") - 1).alias("e")).where("s <= e")
    return single.union(parts.select("k1", "k2", F.explode(F.sequence("s", "e")).alias("seq"))), runs


def dedup_lines(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_lines: int = 3, min_chars: int = 40) -> DataFrame:
    """Deletes later copies of runs of min_lines lines or more, and of single lines of min_chars characters.

    Adds n_lines (lines that are not blank), n_removed, kept (the text without the deleted lines), runs
    array<struct<start,lines>> (maximal runs that an earlier place has too, places count lines that are not blank); columns
    of these names are replaced.  Lines are split at \\n and compared exactly; blank lines (blanks, tabs, carriage
    returns) take no part in runs and stay.  The first copy, by doc_id and then place, stays.  A null text counts as
    empty; rows without an id come first; rows equal in id and text are one document and fare alike; of rows
    that repeat an id with different texts the order is arbitrary but fixed.  An empty table gives an empty table.
    """
    spark = df.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "lines")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    k1, k2 = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63))).alias("k1"), F.xxhash64(F.lit(10), text).alias("k2")
    gone, found = later_copies(df.select(k1, k2, text.alias("text")), min_lines, min_chars, scratch)
    run = F.struct(F.col("seq").alias("start"), "lines")
    both = gone.select("k1", "k2", "seq", F.lit(None).cast(found.select(run.alias("r")).schema["r"].dataType).alias("run")).union(found.select("k1", "k2", F.lit(None).cast("long").alias("seq"), run.alias("run")))
    per_doc = scratch.write(both.groupBy("k1", "k2").agg(F.collect_set("seq").alias("gone"), F.sort_array(F.collect_list("run")).alias("found")), "gone")
    added = ["n_lines", "n_removed", "kept", "runs"]
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in added]
    own = df.select(F.struct(*rest).alias("row"), k1, k2, text.alias("whole"))
    joined = own.join(per_doc, ["k1", "k2"], "left")

    def result(lines: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(lines) - 1)

        def cut(used: Column) -> Column:
            drop = F.transform("gone", lambda s: F.get(used, s.cast("int")))
            kept = F.array_join(F.transform(F.array_except(every, drop), lambda i: F.get(lines, i)), "\n")
            return F.struct(
                F.size(used).cast("long").alias("n_lines"),
                F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_removed"),
                F.when(F.col("gone").isNull(), F.col("whole")).otherwise(kept).alias("kept"),
                F.coalesce("found", F.array().cast(per_doc.schema["found"].dataType)).alias("runs"),
            )

        return bound(F.filter(every, lambda i: ~_blank(F.get(lines, i))), cut)

    # a generator of one row, so that a caller's filter on the result does not compute it once more
    return joined.select("row", F.inline(F.array(bound(F.split("whole", "\n", -1), result)))).select("row.*", *added)
