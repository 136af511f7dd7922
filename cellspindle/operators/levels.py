"""Running levels along coordinates: the base of depth, peaks and flattening.

Events (entity, position, change) are summed per position; levels are counted inside coordinate bins on top of the
totals of the bins before, so no task holds a whole chromosome.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BIN_BITS = 16


def step_levels(ranges: DataFrame, keys: Sequence[str], lo: str, hi: str, keep_flat: bool = False) -> DataFrame:
    """(keys, lo, hi, level): how many half-open ranges [lo, hi) cover each stretch between two breakpoints.

    Stretches of level 0 between ranges are left out. With ``keep_flat`` a breakpoint stays where the level does not
    change. Null keys are values of their own; ranges that are null or not longer than 0 are ignored.
    """
    events = (
        ranges.select(F.struct(*keys).alias("key"), F.col(lo).alias("a"), F.col(hi).alias("b"))
        .where("b > a")
        .selectExpr("key", "inline(array(struct(a as pos, 1L as d), struct(b as pos, -1L as d)))")
        .withColumn("bin", F.shiftright("pos", BIN_BITS))
        .groupBy("key", "bin", "pos")
        .agg(F.sum("d").alias("d"))
    )
    if not keep_flat:
        events = events.where("d != 0")
    along = Window.partitionBy("key").orderBy("bin")
    bins = (
        events.groupBy("key", "bin")
        .agg(F.sum("d").alias("t"), F.min("pos").alias("first"))
        .select(
            "key",
            "bin",
            F.coalesce(F.sum("t").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
            F.lead("first").over(along).alias("next_first"),
        )
    )
    # each bin gets the level it begins with as a row before its first, and the next bin's first position as one after its last
    around = bins.selectExpr("key", "bin", "inline(array(struct(null as pos, base as d, false as last), struct(next_first as pos, 0L as d, true as last)))").where("not last or pos is not null")
    inside = Window.partitionBy("key", "bin").orderBy(F.asc_nulls_first("pos"))
    return (
        events.select("key", "bin", "pos", "d", F.lit(False).alias("last"))
        .unionAll(around)
        .withColumns({"level": F.sum("d").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "hi": F.lead("pos").over(inside)})
        .where("pos is not null and not last and hi is not null and level > 0")
        .select("key.*", F.col("pos").alias("lo"), "hi", "level")
    )
