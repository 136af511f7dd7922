"""Interval algebra over (chrom, start 0-based, end exclusive, strand, name)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellspindle.operators.levels import step_levels
from cellspindle.operators.periods import periods_and_gaps

BIN = 16_384
# Parts of a crowded bin, its pairs of rows from which on it is crowded, and pairs of a part from which on it is sliced.
PARTS, CROWDED, SLICE = 128, 4e6, 5e8


def _bins(lo: Column, hi: Column, size: int) -> Column:
    return F.sequence(F.floor(lo / size), F.floor((hi - 1) / size))


def overlap_join(
    left: DataFrame, right: DataFrame, left_on: tuple[str, str, str] = ("chrom", "start", "end"), right_on: tuple[str, str, str] = ("chrom", "start", "end"), how: str = "inner", size: int = BIN, counted: DataFrame | None = None
) -> DataFrame:
    """Pairs of overlapping half-open intervals, or the left rows with (``semi``) or without (``anti``) one.

    The intervals are spread over fixed bins and joined on (chrom, bin); a pair that shares several bins is kept in the
    first of them. For ``semi`` and ``anti`` each distinct left interval is looked up once, and no pair leaves the join. Column names of the
    two sides must differ, except that the right side's interval columns may be renamed by ``right_on``. Null or empty
    intervals overlap nothing. Adaptive execution splits bins of many bytes, not those of many pairs: for ``inner``, with
    ``counted`` (the left rows, or others that lie alike) crowded bins are cut into parts, and into slices of the left rows
    where parts are crowded. The rows of a side grow with
    its bins, which the planner's estimates leave out, so no side is broadcast.
    """
    lc, ls, le = left_on
    rc, rs, re = right_on
    r = right.where(F.col(re) > F.col(rs)).select("*", F.explode(_bins(F.col(rs), F.col(re), size)).alias("_rbin"))
    r = r.withColumnsRenamed({rc: "_rc", rs: "_rs", re: "_re"}) if how != "inner" or {rc, rs, re} & set(left.columns) else r.withColumns({"_rc": F.col(rc), "_rs": F.col(rs), "_re": F.col(re)})
    bins = F.when(F.col(le) > F.col(ls), _bins(F.col(ls), F.col(le), size))
    hit = (F.col("_rs") < F.col(le)) & (F.col("_re") > F.col(ls))
    if how == "inner":
        l = left.select("*", F.explode(bins).alias("_lbin"))  # noqa: E741
        if counted is not None:
            crowded = F.broadcast(_crowded(counted.select(F.col(lc).alias("_hc"), F.floor(F.col(ls) / size).alias("_hbin")), r.select("_rc", "_rbin")))
            return _join_parts(l, r, crowded, left_on, size, hit)
        first = F.greatest(F.floor(F.col(ls) / size), F.floor(F.col("_rs") / size)) == F.col("_lbin")
        return l.join(r.hint("merge"), (F.col(lc) == F.col("_rc")) & (F.col("_lbin") == F.col("_rbin")) & hit & first).drop("_lbin", "_rbin", "_rc")
    if how not in ("semi", "anti"):
        raise ValueError(how)
    r = r.select("_rc", "_rs", "_re", "_rbin")
    # a left interval may span several bins: it is hit if any of them is; distinct intervals are looked up once
    found = (
        left.select(F.col(lc).alias("_lc"), F.col(ls).alias("_ls"), F.col(le).alias("_le"), bins.alias("_lbins"))
        .distinct()
        .withColumn("_lbin", F.explode("_lbins"))
        .join(r.hint("merge"), (F.col("_lc") == F.col("_rc")) & (F.col("_lbin") == F.col("_rbin")) & (F.col("_rs") < F.col("_le")) & (F.col("_re") > F.col("_ls")), "left_semi")
        .select("_lc", "_ls", "_le")
        .distinct()
    )
    return left.join(found, (F.col(lc) == F.col("_lc")) & (F.col(ls) == F.col("_ls")) & (F.col(le) == F.col("_le")), f"left_{how}")


def _crowded(left: DataFrame, right: DataFrame) -> DataFrame:
    """(_hc, _hbin, _n): the bins of many pairs, at most as many as a genome has bins, and the slices of each of their parts."""
    lefts = left.where("_hc is not null and _hbin is not null").groupBy("_hc", "_hbin").agg(F.count("*").cast("double").alias("a"))
    rights = right.groupBy("_rc", "_rbin").agg(F.count("*").cast("double").alias("b"))
    pairs = lefts.join(rights.hint("merge"), (F.col("_hc") == F.col("_rc")) & (F.col("_hbin") == F.col("_rbin"))).withColumn("pairs", F.col("a") * F.col("b"))
    return pairs.where(F.col("pairs") > CROWDED).select("_hc", "_hbin", F.least(F.ceil(F.col("pairs") / PARTS / SLICE), F.lit(1024)).cast("int").alias("_n"))


def _join_parts(l: DataFrame, r: DataFrame, crowded: DataFrame, left_on: tuple[str, str, str], size: int, hit: Column) -> DataFrame:  # noqa: E741
    """The inner join over bins, and in crowded ones over their parts and slices; a pair is kept in its first bin and part."""
    lc, ls, le = left_on
    part = max(1, size // PARTS)

    def parts(df: DataFrame, c: str, b: str, lo: Column, hi: Column) -> DataFrame:
        both = df.join(crowded, (F.col(c) == F.col("_hc")) & (F.col(b) == F.col("_hbin")), "left").drop("_hc", "_hbin")
        begin, end = F.greatest(lo, F.col(b) * size), F.least(hi, (F.col(b) + 1) * size)
        return both.withColumn("_part", F.explode(F.when(F.col("_n").isNotNull(), _bins(begin, end, part)).otherwise(F.array(F.lit(-1).cast("bigint")))))

    hashed = [c for c, kind in l.dtypes if "map<" not in kind]
    ours = parts(l, lc, "_lbin", F.col(ls), F.col(le)).withColumn("_slice", F.when(F.col("_n") > 1, F.pmod(F.xxhash64(*hashed), F.col("_n")).cast("int")).otherwise(0)).drop("_n")
    theirs = parts(r, "_rc", "_rbin", F.col("_rs"), F.col("_re")).withColumnRenamed("_part", "_rpart").withColumn("_rslice", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
    at = F.greatest(F.col(ls), F.col("_rs"))
    first = (F.floor(at / size) == F.col("_lbin")) & ((F.col("_part") == -1) | (F.floor(at / part) == F.col("_part")))
    keys = (F.col(lc) == F.col("_rc")) & (F.col("_lbin") == F.col("_rbin")) & (F.col("_part") == F.col("_rpart")) & (F.col("_slice") == F.col("_rslice"))
    return ours.join(theirs.hint("merge"), keys & hit & first).drop("_lbin", "_rbin", "_rc", "_part", "_rpart", "_slice", "_rslice")


def expand(df: DataFrame, up: int, down: int, stranded: bool = True) -> DataFrame:
    """Widen by ``up`` bases before and ``down`` after; with a `-` strand the sides swap. Starts stop at 0."""
    minus = F.coalesce(F.col("strand") == "-", F.lit(False)) if stranded else F.lit(False)
    return df.withColumns(
        {
            "start": F.greatest(F.col("start") - F.when(minus, down).otherwise(up), F.lit(0)).cast("int"),
            "end": (F.col("end") + F.when(minus, up).otherwise(down)).cast("int"),
        }
    )


def shrink(df: DataFrame, up: int, down: int, stranded: bool = True) -> DataFrame:
    """The opposite of ``expand``; rows that vanish are left out."""
    minus = F.coalesce(F.col("strand") == "-", F.lit(False)) if stranded else F.lit(False)
    inner = df.withColumns({"start": (F.col("start") + F.when(minus, down).otherwise(up)).cast("int"), "end": (F.col("end") - F.when(minus, up).otherwise(down)).cast("int")})
    return inner.where(F.col("end") > F.col("start"))


def distinct_regions(df: DataFrame, with_name: bool = False) -> DataFrame:
    """One row per (chrom, start, end, strand[, name]); the smallest name stands for the others."""
    keys = ["chrom", "start", "end", "strand"]
    if with_name:
        return df.select(*keys, "name").distinct()
    return df.groupBy(*keys).agg(F.min("name").alias("name"))


def merge(df: DataFrame, stranded: bool = True, by_name: bool = False, gap: int = 0, min_length: int = 0) -> DataFrame:
    """(chrom, start, end, name, strand): unions of regions no more than ``gap`` apart (touching ones included).

    The name is that of the region with the smallest (start, end, name); unstranded unions have the strand `.`.
    """
    strand = F.coalesce(F.col("strand"), F.lit(".")) if stranded else F.lit(".")
    rows = df.select("chrom", "start", (F.col("end") + gap).cast("int").alias("end"), "name", strand.alias("strand"))
    keys = ["chrom", "strand", *(["name"] if by_name else [])]
    unions = periods_and_gaps(rows, keys, "start", "end").where("kind = 'period'").select(*keys, F.col("lo").alias("start"), (F.col("hi") - gap).cast("int").alias("end"))
    unions = unions.where(F.col("end") - F.col("start") >= min_length)
    if by_name:
        return unions.select("chrom", "start", "end", "name", "strand")
    first = rows.where("start >= 0 and end > start").groupBy("chrom", "strand", "start").agg(F.min_by("name", F.struct("end", "name")).alias("name"))
    return unions.join(first, ["chrom", "strand", "start"], "left").select("chrom", "start", "end", "name", "strand")


def flatten(df: DataFrame) -> DataFrame:
    """(chrom, start, end, name, strand): disjoint pieces of the regions of one strand and name, cut at every breakpoint."""
    keys = ["chrom", "strand", "name"]
    pieces = step_levels(df, keys, "start", "end", keep_flat=True)
    return pieces.select("chrom", F.col("lo").alias("start"), F.col("hi").alias("end"), "name", "strand")


def union_regions(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
