"""Continuous periods and gaps of overlapping intervals, per entity (problem 1).

Starts and ends are ranked independently: with S(p) starts and E(p) ends at or before position p, the i-th smallest
end p closes a period exactly when the (i+1)-th smallest start lies beyond it, that is when S(p) = E(p) = i; a start
opens one when all earlier starts have been closed. The boundaries found that way alternate, so each one pairs with
the next: open-close is a period, close-open is a gap.

Scale: events are pre-aggregated to one row per entity and position before the ranking, and ranks are counted inside
coordinate bins (at most 2**bin_bits positions each, whatever the input) on top of the totals of the bins before, so
an entity that holds a third of all rows is spread over all its bins. No task ever holds an entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RESULT = ("kind", "lo", "hi")


def strand_key(strand: Column) -> Column:
    """`+` and `-` stay, every other value and null become `.`."""
    return F.when(strand.isin("+", "-"), strand).otherwise(F.lit("."))


def periods_and_gaps(
    df: DataFrame,
    entity: Sequence[str] | dict[str, Column],
    start: str = "bed_start",
    end: str = "bed_end",
    bin_bits: int = 16,
) -> DataFrame:
    """One row per maximal union of overlapping or touching intervals (`period`) and per stretch between two (`gap`).

    ``entity`` names the grouping columns, or maps result names to expressions.
    Defined cases: rows with a null, negative, reversed or empty coordinate are ignored; a null entity column is a
    value of its own; repeated rows and ties change nothing; an empty table gives no rows; other columns of ``df``,
    whatever their names, are not looked at. Result: the entity columns, ``kind``, ``lo``, ``hi`` (end exclusive).
    """
    named = entity if isinstance(entity, dict) else {c: df[c] for c in entity}
    events = (
        df.select(F.struct(*[c.alias(n) for n, c in named.items()]).alias("e"), df[start].alias("s"), df[end].alias("t"))
        .where("s >= 0 and t > s")
        .selectExpr("e", "inline(array(struct(s as pos, 1L as ns, 0L as ne), struct(t as pos, 0L as ns, 1L as ne)))")
        .withColumn("bin", F.shiftright("pos", bin_bits))
    )
    ranked = events.groupBy("e", "bin", "pos").agg(F.sum("ns").alias("ns"), F.sum("ne").alias("ne"))
    before = Window.partitionBy("e").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        ranked.groupBy("e", "bin")
        .agg(F.sum("ns").alias("bs"), F.sum("ne").alias("be"))
        .select(
            "e",
            "bin",
            F.coalesce(F.sum("bs").over(before), F.lit(0)).alias("s0"),
            F.coalesce(F.sum("be").over(before), F.lit(0)).alias("e0"),
        )
    )
    # what earlier bins hold stands as a row before each bin's first, so that no join is needed
    carried = bins.select("e", "bin", F.lit(None).cast("int").alias("pos"), F.col("s0").alias("ns"), F.col("e0").alias("ne"))
    inside = Window.partitionBy("e", "bin").orderBy(F.asc_nulls_first("pos"))
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    bounds = (
        ranked.select("e", "bin", F.col("pos").cast("int").alias("pos"), "ns", "ne")
        .unionAll(carried)
        .withColumns({"n_begun": F.sum("ns").over(running), "n_ended": F.sum("ne").over(running)})
        .withColumn("closes", F.col("n_begun") == F.col("n_ended"))
        .where("pos is not null and (closes or n_begun - ns = n_ended - ne)")
        .select("e", "bin", "pos", "closes")
        .withColumns({"before": F.lag("pos").over(inside), "hi": F.lead("pos").over(inside)})
    )
    # the last boundary of a bin pairs with the first one of the next bin that has any: two rows a bin
    edges = bounds.where("before is null or hi is null").withColumn("next", F.lead("pos").over(Window.partitionBy("e").orderBy("bin", "pos")))
    across = edges.where("hi is null and next is not null").select("e", "pos", "closes", F.col("next").alias("hi"))
    pairs = bounds.where("hi is not null").select("e", "pos", "closes", "hi").unionAll(across)
    return pairs.select("e.*", F.when(F.col("closes"), "gap").otherwise("period").alias("kind"), F.col("pos").alias("lo"), "hi")


def bed_periods(bed: DataFrame) -> DataFrame:
    """Periods and gaps of each (track, chrom, strand) of a BED table; rows without chrom are ignored."""
    return periods_and_gaps(
        bed.where(bed["chrom"].isNotNull()),
        {"track": bed["track"], "chrom": bed["chrom"], "strand": strand_key(bed["strand"])},
    )
