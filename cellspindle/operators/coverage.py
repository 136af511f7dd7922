"""Per-base depth, covered bases, peaks and ATAC fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellspindle.functions import cigar, flags
from cellspindle.operators import intervals
from cellspindle.operators.filters import min_mapq, tag
from cellspindle.operators.levels import step_levels


def aligned_ranges(df: DataFrame, least_mapq: int = 20, cell: Column | None = None, umi: Column | None = None, stranded: bool = True) -> DataFrame:
    """(chrom, strand, cell, umi, start, end) of aligned bases, 0-based and half-open; deletions and skips are not covered."""
    rows = min_mapq(df.where(flags.passes("depth") & F.col("chrom").isNotNull() & F.col("pos").isNotNull()), least_mapq)
    nothing = F.lit(None).cast("string")
    return rows.select(
        "chrom",
        (flags.read_strand() if stranded else F.lit(".")).alias("strand"),
        (nothing if cell is None else cell).alias("cell"),
        (nothing if umi is None else umi).alias("umi"),
        F.inline(cigar.covered(F.col("pos"), F.col("cigar"))),
    ).select("chrom", "strand", "cell", "umi", (F.col("lo") - 1).alias("start"), F.col("hi").alias("end"))


def depth(df: DataFrame, least_mapq: int = 20, cell: Column | None = None, umi: Column | None = None, stranded: bool = True, groups: DataFrame | None = None) -> DataFrame:
    """(chrom, strand, cell, lo, hi, level): runs of equal depth, [lo, hi) 0-based; depth 0 is left out.

    With ``umi`` a base counts each UMI once. ``groups`` (barcode, group) replaces cells by their group, unknown ones by
    `others`. The input is reduced to two events a range; it is never exploded to bases.
    """
    rows = aligned_ranges(df, least_mapq, cell, umi, stranded)
    if cell is not None:
        rows = rows.where("cell is not null")
    if groups is not None:
        names = groups.toDF("cell", "grp").where("cell is not null")
        rows = rows.join(names, "cell", "left").withColumn("cell", F.coalesce("grp", F.lit("others"))).drop("grp")
    if umi is not None:
        once = step_levels(rows.where("umi is not null"), ["chrom", "strand", "cell", "umi"], "start", "end")
        rows = once.select("chrom", "strand", "cell", F.col("lo").alias("start"), F.col("hi").alias("end"))
    return step_levels(rows, ["chrom", "strand", "cell"], "start", "end")


def per_base(runs: DataFrame) -> DataFrame:
    """(chrom, pos 1-based, strand, cell, level) of runs of depth."""
    return runs.select("chrom", F.explode(F.sequence(F.col("lo") + 1, F.col("hi"))).alias("pos"), "strand", "cell", "level")


def depth_in_regions(runs: DataFrame, regions: DataFrame, zeros: bool = False) -> DataFrame:
    """(chrom, pos, strand, cell, level) of the bases inside regions; with ``zeros`` bases without depth have 0.

    A base of two overlapping regions is given once.
    """
    area = intervals.merge(regions.select("chrom", "start", "end", F.lit(None).cast("string").alias("name"), F.lit(".").alias("strand")), stranded=False)
    area = area.select(F.col("chrom").alias("c"), F.col("start").alias("s"), F.col("end").alias("e"))
    hit = intervals.overlap_join(runs, area, ("chrom", "lo", "hi"), ("c", "s", "e"))
    inside = hit.select("chrom", "strand", "cell", "level", F.greatest("lo", "_rs").cast("int").alias("lo"), F.least("hi", "_re").cast("int").alias("hi"))
    bases = per_base(inside)
    if not zeros:
        return bases
    every = area.select(F.col("c").alias("chrom"), F.explode(F.sequence(F.col("s") + 1, F.col("e"))).alias("pos"))
    return every.join(bases, ["chrom", "pos"], "left").withColumn("level", F.coalesce("level", F.lit(0)))


def covered_bases(df: DataFrame, least_depth: int = 1, cell: Column | None = None, least_mapq: int = 20, regions: DataFrame | None = None) -> DataFrame:
    """(cell, n): bases where both strands together reach ``least_depth``, per cell, in the regions where given."""
    runs = depth(df, least_mapq, tag("CB") if cell is None else cell, stranded=False).where(F.col("level") >= least_depth)
    if regions is None:
        return runs.groupBy("cell").agg(F.sum(F.col("hi") - F.col("lo")).alias("n"))
    return depth_in_regions(runs, regions).groupBy("cell").agg(F.count("*").alias("n"))


def call_peaks(df: DataFrame, cutoff: int = 10, gap: int = 50, min_length: int = 50, least_mapq: int = 20, listed: DataFrame | None = None, umi: Column | None = None) -> DataFrame:
    """(chrom, start, end, name, strand): runs of bases with a depth above the cutoff, joined over gaps, long enough."""
    rows = df
    if listed is not None:
        rows = rows.withColumn("_k", tag("CB")).join(listed.select(F.col(listed.columns[0]).alias("_k")).distinct(), "_k", "left_semi").drop("_k")
    high = depth(rows, least_mapq, umi=umi).where(F.col("level") > cutoff)
    return intervals.merge(high.select("chrom", F.col("lo").alias("start"), F.col("hi").alias("end"), F.lit(None).cast("string").alias("name"), "strand"), gap=gap, min_length=min_length)


def fragment_span(pos: Column, cigar_text: Column, size: Column, shift: bool) -> tuple[Column, Column]:
    """0-based half-open span of a pair's fragment: leftwards sizes count back from the end; cut sites shift +4 and -5."""
    begin = pos - 1
    end = cigar.end_position(pos, cigar_text)
    up, down = (4, 5) if shift else (0, 0)
    start = F.when(size > 0, begin + up).when(size < 0, end + size + up).otherwise(begin)
    stop = F.when(size > 0, begin + size - down).when(size < 0, end - down).otherwise(end)
    return F.greatest(start, F.lit(0)).cast("int"), stop.cast("int")


def fragments(df: DataFrame, least_mapq: int = 20, shift: bool = True, listed: DataFrame | None = None, blacklist: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(chrom, start, end, barcode, dup): distinct fragments and how often each was seen.

    First or single reads only; secondary, supplementary and unmapped rows do not count. Empty fragments and those longer
    than ``most`` are left out, as are barcodes not listed and fragments that overlap the blacklist.
    """
    rows = min_mapq(df.where(flags.passes("fragments") & F.col("chrom").isNotNull() & F.col("pos").isNotNull() & tag("CB").isNotNull()), least_mapq)
    start, stop = fragment_span(F.col("pos"), F.col("cigar"), F.coalesce("tlen", F.lit(0)), shift)
    spans = rows.select("chrom", start.alias("start"), stop.alias("end"), tag("CB").alias("barcode")).where("start < end")
    if most is not None:
        spans = spans.where(F.col("end") - F.col("start") <= most)
    if listed is not None:
        spans = spans.join(listed.select(F.col(listed.columns[0]).alias("barcode")).distinct(), "barcode", "left_semi")
    out = spans.groupBy("chrom", "start", "end", "barcode").agg(F.count("*").alias("dup"))
    return intervals.overlap_join(out, blacklist, how="anti") if blacklist is not None else out


def cut_sites(frags: DataFrame) -> DataFrame:
    """(barcode, n): distinct fragments of each barcode."""
    return frags.groupBy("barcode").agg(F.count("*").alias("n"))


def peak_matrix(frags: DataFrame, peaks: DataFrame) -> DataFrame:
    """(chrom, start, end, barcode, n): fragments of each barcode that overlap a peak, whatever their duplicates."""
    p = peaks.select(F.col("chrom").alias("pc"), F.col("start").alias("ps"), F.col("end").alias("pe")).distinct()
    hit = intervals.overlap_join(frags, p, right_on=("pc", "ps", "pe"), counted=frags)
    return hit.groupBy("chrom", F.col("_rs").alias("start"), F.col("_re").alias("end"), "barcode").agg(F.count("*").alias("n"))


