"""Best representative of each duplicate group (problem 5).

``voted_values`` is the method in full: fields are unpivoted to long rows, the votes of all records (trust times recency
decay) are summed per normalised value, ``max_by`` chooses the winners, and they are pivoted back to one row per group.

The problem itself ranks records strictly (checked, then quality, then recency, then id), so that one better record
outvotes any number of others, which no sum of weights reproduces. ``winners`` therefore gives each field's choice to
``max_by`` over that rank, in one aggregate, and unpivots the winners.

Scale: winners are associative, so the map side reduces each group and field to one row before the shuffle; a group that
holds a third of all rows travels as a few rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\r\n\u000b\u000c"
FIELDS = ("mapq", "cigar", "gn", "re", "sp")
GROUP = ("chrom", "pos", "cb", "ur")


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def code(c: Column) -> Column:
    """A barcode or UMI as compared: upper case, no outer blanks, no final hyphen plus digits."""
    return F.regexp_replace(F.upper(stripped(c)), r"-[0-9]+\z", "")


def filled(field: str) -> Column:
    if field == "mapq":
        return F.col(field).isNotNull() & (F.col(field) != 255)
    return F.col(field).isNotNull() & ~stripped(F.col(field)).isin("", ".", "*", "NA")


def rank() -> Column:
    """Higher is better; null and negative qualities are equal and last, null times last, smaller ids first."""
    return F.struct(
        F.coalesce(F.col("checked") == 1, F.lit(False)).alias("c"),
        F.when(F.col("qual") >= 0, F.col("qual")).otherwise(-1).alias("q"),
        F.col("seen_at").alias("t"),
        F.bitwise_not(F.col("rcd_id")).alias("i"),
    )


def members(rcd: DataFrame) -> DataFrame:
    """The records that can belong to a group, with their normalised group columns."""
    return rcd.where(_usable()).select("chrom", "pos", code(F.col("cb")).alias("cb"), code(F.col("ur")).alias("ur"), "rcd_id", *FIELDS, rank().alias("rank"))


def _usable() -> Column:
    return (
        (F.coalesce(F.col("flag"), F.lit(0)).bitwiseAND(256 | 512 | 2048) == 0)
        & F.col("chrom").isNotNull()
        & F.col("pos").isNotNull()
        & (stripped(F.col("cb")) != "")
        & (stripped(F.col("ur")) != "")
    )


def winners(rcd: DataFrame, fields: Sequence[str] = FIELDS, values: bool = True) -> DataFrame:
    """One row per group of two or more: the group columns, n_member, keep_id, and ``won``: field -> (from_id[, value]).

    All fields are reduced in one aggregate, so that the long rows (group, field, winner) exist only after the shuffle.
    """
    own = lambda f: F.struct(F.col("rcd_id").alias("from_id"), *([F.col(f).cast("string").alias("value")] if values else []))
    best = members(rcd).groupBy(*GROUP).agg(
        F.count("*").alias("n_member"),
        F.max("rank").alias("first"),
        *[F.max_by(own(f), F.when(filled(f), F.col("rank"))).alias(f"_{f}") for f in fields],
    )
    won = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("v")) for f in fields]), lambda e: e["v"].isNotNull())
    return best.where("n_member > 1").select(*GROUP, "n_member", F.bitwise_not(F.col("first.i")).alias("keep_id"), F.map_from_entries(won).alias("won"))


def field_sources(rcd: DataFrame) -> DataFrame:
    """(keep_id, field, from_id): for each group and field the record that fills it; no row where none does.

    Defined cases: a record with null or blank cb or ur, or null chrom or pos, is in no group; a null flag has no bits
    set; repeated rows are members each; equal records are parted by the smaller id; empty table: no rows; further
    columns are not looked at.
    """
    return winners(rcd, values=False).select("keep_id", F.explode("won").alias("field", "v")).select("keep_id", "field", "v.from_id")


def survivors(rcd: DataFrame) -> DataFrame:
    """One row per group: group columns, n_member, keep_id and the filled fields (null where no record has one)."""
    got = winners(rcd)
    return got.select(
        *GROUP, "n_member", "keep_id", *[(F.col("won")[f]["value"].cast("int") if f == "mapq" else F.col("won")[f]["value"]).alias(f) for f in FIELDS]
    )


def voted_values(rcd: DataFrame, fields: Sequence[str] = FIELDS, checked_trust: int = 8, decay_days: int = 32) -> DataFrame:
    """(group columns, fields): for each group of two or more the value of each field with the most votes, null without any.

    Fields are unpivoted to long rows; every record that has a field votes for its normalised value (without outer
    blanks, in upper case) with its trust times the decay of its age, and the votes for a value are summed; of equal
    sums the smallest value wins. Trust is the quality sum plus one (null and negative ones count 0), ``checked_trust``
    times that of a checked record. A vote is halved for each ``decay_days`` days it is older (by date) than the newest record
    of the table, to a sixteenth at most, which an unknown age has too. Votes are whole numbers, so sums are exact.

    Defined cases as in ``field_sources``. Votes for a value are summed on the map side, so that a group or a value that
    holds a third of all rows travels as a few rows a task.
    """
    quality = F.when(F.col("qual") > 0, F.col("qual")).otherwise(0).cast("bigint") + 1
    trust = quality * F.when(F.coalesce(F.col("checked") == 1, F.lit(False)), checked_trust).otherwise(1)
    newest = rcd.agg(F.max("seen_at").alias("newest"))  # one row
    age = F.floor(F.date_diff("newest", "seen_at") / decay_days)
    steps = F.coalesce(F.least(age, F.lit(4)), F.lit(4)).cast("int")
    vote = (trust * F.element_at(F.array(*[F.lit(2**k) for k in (4, 3, 2, 1, 0)]), steps + 1)).alias("vote")
    own = rcd.crossJoin(F.broadcast(newest)).where(_usable())
    cells = F.array_compact(F.array(F.struct(F.lit("").alias("field"), F.lit("").alias("value")), *[F.when(filled(f), F.struct(F.lit(f).alias("field"), F.upper(stripped(F.col(f).cast("string"))).alias("value"))) for f in fields]))
    long = own.select("chrom", "pos", code(F.col("cb")).alias("cb"), code(F.col("ur")).alias("ur"), vote, F.inline(cells))
    sums = long.groupBy(*GROUP, "field", "value").agg(F.sum("vote").alias("votes"), F.count("*").alias("n"))
    best = sums.groupBy(*GROUP, "field").agg(F.min_by("value", F.struct(-F.col("votes"), F.col("value"))).alias("value"), F.max("n").alias("n"))
    pick = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    wide = best.groupBy(*GROUP).agg(F.max(F.when(F.col("field") == "", F.col("n"))).alias("n_member"), *[pick(f).alias(f) for f in fields])
    return wide.where("n_member > 1").select(*GROUP, "n_member", *[F.col(f).cast("int").alias(f) if f == "mapq" else F.col(f) for f in fields])
