"""Feature by cell counting and per-barcode attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellspindle.functions import flags, tags
from cellspindle.operators.filters import genome_bin, min_mapq, tag


def _events(df: DataFrame, cell: Column, features: Column, umi: Column | None, least_mapq: int, keep_duplicates: bool, listed: DataFrame | None) -> DataFrame:
    rows = min_mapq(df.where(flags.passes("count_with_duplicates" if keep_duplicates else "count")), least_mapq)
    out = rows.select(cell.alias("cell"), features.alias("features"), (umi if umi is not None else F.lit(None).cast("string")).alias("umi"), tag("RE").alias("re"))
    out = out.where("cell is not null and size(features) > 0")
    if umi is not None:
        out = out.where("umi is not null")
    if listed is not None:
        out = out.join(listed.select(F.col(listed.columns[0]).alias("cell")).distinct(), "cell", "left_semi")
    return out


def count_matrix(
    df: DataFrame,
    cell: Column | None = None,
    features: Column | None = None,
    umi: Column | None = None,
    least_mapq: int = 20,
    keep_duplicates: bool = False,
    listed: DataFrame | None = None,
    one_hit: bool = False,
    types: str | None = None,
) -> DataFrame:
    """(feature, cell, n): distinct UMIs, or reads where no UMI is given, of each feature and cell.

    A read counts for every feature of its list, once for each. ``one_hit`` leaves out reads with several features,
    ``types`` those of other region types; ``listed`` keeps the cells of its first column. Defaults: tags CB and GN.
    """
    rows = _events(df, tag("CB") if cell is None else cell, tags.values(tag("GN")) if features is None else features, umi, least_mapq, keep_duplicates, listed)
    if one_hit:
        rows = rows.where("size(features) = 1")
    if types is not None:
        rows = rows.where(F.col("re").isin(*types))
    exploded = rows.select("cell", "umi", F.explode("features").alias("feature"))
    return exploded.groupBy("feature", "cell").agg((F.count_distinct("umi") if umi is not None else F.count("*")).alias("n"))


def velocity_matrix(df: DataFrame, cell: Column | None = None, features: Column | None = None, umi: Column | None = None, least_mapq: int = 20) -> DataFrame:
    """(feature, cell, total, spliced, unspliced, spanning) of distinct UMIs.

    Intronic reads are unspliced, reads over an exon and an intron unspliced and spanning; spliced is what is left of
    the total. Ambiguous, intergenic and unknown reads do not count.
    """
    rows = _events(df, tag("CB") if cell is None else cell, tags.values(tag("GN")) if features is None else features, tag("UR") if umi is None else umi, least_mapq, False, None)
    rows = rows.where(~F.coalesce("re", F.lit("U")).isin("U", "V", "I")).select("cell", "umi", "re", F.explode("features").alias("feature"))
    return (
        rows.groupBy("feature", "cell")
        .agg(
            F.count_distinct("umi").alias("total"),
            F.count_distinct(F.when(F.col("re").isin("N", "C"), F.col("umi"))).alias("unspliced"),
            F.count_distinct(F.when(F.col("re") == "C", F.col("umi"))).alias("spanning"),
        )
        .select("feature", "cell", "total", (F.col("total") - F.col("unspliced")).alias("spliced"), "unspliced", "spanning")
    )


def attributes(df: DataFrame, names: Sequence[str], cell: str = "CB", distinct: bool = False, every: bool = False, groups: tuple[str, Sequence[str]] | None = None, listed: DataFrame | None = None) -> DataFrame:
    """Per barcode: `Raw` reads and for each tag the reads that have it (``distinct``: its distinct values).

    ``groups`` (tag, values) gives the columns `<value>_<tag>` instead; ``every`` counts only reads with all tags.
    Barcodes of ``listed`` without reads have zeros; without a list every barcode seen is a row.
    """
    rows = df.where(flags.passes("attributes")).select(tag(cell).alias("barcode"), *[tag(n).alias(n) for n in names], *([tag(groups[0]).alias("_group")] if groups else []))
    rows = rows.where("barcode is not null")
    if every:
        rows = rows.dropna(subset=list(names))
    count = lambda c: (F.count_distinct(c) if distinct else F.count(c))
    if groups:
        cells = [count(F.when(F.col("_group") == v, F.col(n))).alias(f"{v}_{n}") for v in groups[1] for n in names]
    else:
        cells = [count(F.col(n)).alias(n) for n in names]
    out = rows.groupBy("barcode").agg(F.count("*").alias("Raw"), *cells)
    if listed is None:
        return out
    keys = listed.select(F.col(listed.columns[0]).alias("barcode")).where("barcode is not null").distinct()
    return keys.join(out, "barcode", "left").na.fill(0)


def bin_matrix(df: DataFrame, sizes: Sequence[int], cell: Column | None = None, least_mapq: int = 10, stranded: bool = False) -> DataFrame:
    """(size, feature, cell, n) of reads per genome window and cell, for several window sizes in one pass."""
    rows = min_mapq(df.where(flags.passes("depth") & F.col("pos").isNotNull()), least_mapq).withColumn("cell", tag("CB") if cell is None else cell).where("cell is not null")
    named = F.array(*[F.struct(F.lit(s).alias("size"), genome_bin(s, stranded).alias("feature")) for s in sizes])
    return rows.select("cell", F.inline(named)).groupBy("size", "feature", "cell").agg(F.count("*").alias("n"))


def bin_totals(matrix: DataFrame) -> DataFrame:
    """(size, cell, n): the reads of each cell over all windows of a size."""
    return matrix.groupBy("size", "cell").agg(F.sum("n").alias("n"))


def barcode_distribution(df: DataFrame, cell: Column | None = None) -> DataFrame:
    """(barcode, n) by falling number of reads."""
    return df.select((tag("CB") if cell is None else cell).alias("barcode")).where("barcode is not null").groupBy("barcode").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "barcode")


def read_report(df: DataFrame) -> DataFrame:
    """(metric, value) of an alignment table in one pass."""
    primary = flags.passes("attributes") & (F.coalesce(F.col("flag"), F.lit(0)).bitwiseAND(flags.SUPPLEMENTARY) == 0)
    metrics = {
        "records": F.count("*"),
        "reads": F.count_if(primary),
        "mapped": F.count_if(primary & ~flags.has(flags.UNMAPPED)),
        "reverse": F.count_if(primary & flags.has(flags.REVERSE) & ~flags.has(flags.UNMAPPED)),
        "secondary": F.count_if(flags.has(flags.SECONDARY)),
        "failed_quality": F.count_if(flags.has(flags.QCFAIL)),
        "with_barcode": F.count_if(tag("CB").isNotNull()),
        "annotated": F.count_if(tag("GN").isNotNull()),
    }
    wide = df.agg(*[c.cast("bigint").alias(m) for m, c in metrics.items()])
    return wide.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*metrics))).alias("metric", "value"))


def annotation_report(df: DataFrame, group: Column | None = None) -> DataFrame:
    """(group, re, n): reads per region type, by group where one is given."""
    return df.groupBy((F.lit("all") if group is None else group).alias("group"), tag("RE").alias("re")).agg(F.count("*").alias("n"))
