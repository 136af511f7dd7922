"""Row filters and projections over alignment tables (columns as in SAM, `tags` a map)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellspindle.functions import flags, seq, tags
from cellspindle.operators import intervals

# Letters of the region type tag.
REGION_TYPES = {"exon": "E", "splice": "S", "intron": "N", "exon_intron": "C", "antisense": "A", "antisense_intron": "B", "ambiguous": "V", "intergenic": "I", "exclude": "X", "intron_retain": "R", "unknown": "U"}


def min_mapq(df: DataFrame, least: int) -> DataFrame:
    """Rows of at least this mapping quality; an unknown (null) one counts as 0."""
    return df.where(F.coalesce("mapq", F.lit(0)) >= least)


def tag(name: str) -> Column:
    """A tag's value; an empty one is missing."""
    return F.nullif(F.col("tags")[name], F.lit(""))


def require_tags(df: DataFrame, names: Sequence[str], every: bool = True) -> DataFrame:
    """Rows that carry all (or any) of the tags."""
    present = [tag(n).isNotNull() for n in names]
    out = present[0]
    for p in present[1:]:
        out = out & p if every else out | p
    return df.where(out)


def pick(df: DataFrame, names: Sequence[str], listed: DataFrame | None = None, least_mapq: int = 0) -> DataFrame:
    """Rows with all the tags and, with a list, whose first tags are a row of it.

    The list's columns are compared with as many tags as there are columns and tags; its repeats do not matter.
    """
    rows = min_mapq(require_tags(df.where(flags.passes("pick")), names), least_mapq)
    if listed is None:
        return rows
    k = min(len(listed.columns), len(names))
    keys = [f"_k{i}" for i in range(k)]
    wanted = listed.select(*[F.col(c).alias(x) for c, x in zip(listed.columns, keys, strict=False)]).distinct()
    return rows.withColumns({x: tag(n) for n, x in zip(names, keys, strict=False)}).join(wanted, keys, "left_semi").drop(*keys)


def region_types(df: DataFrame, letters: str, name: str = "RE") -> DataFrame:
    return df.where(tag(name).isin(*letters))


def one_hit(df: DataFrame, name: str = "GN") -> DataFrame:
    """Rows whose feature list has exactly one entry."""
    return df.where(F.size(tags.values(tag(name))) == 1)


def base_quality(df: DataFrame, least_mean: float = 0, most_n: int | None = None, first_bases: int = 15, first_least: float | None = None) -> DataFrame:
    """Reads by mean quality, number of N, and mean quality of the first bases; reads without qualities pass the quality tests only at 0."""
    rows = df.where(F.coalesce(seq.quality_mean(F.col("qual")), F.lit(0.0)) >= least_mean)
    if most_n is not None:
        rows = rows.where(F.length("seq") - F.length(F.replace(F.upper("seq"), F.lit("N"), F.lit(""))) <= most_n)
    if first_least is not None:
        rows = rows.where(F.coalesce(seq.quality_mean(F.substring("qual", 1, first_bases)), F.lit(0.0)) >= first_least)
    return rows


def outside(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows (chrom, start, end) that overlap no region of a blacklist."""
    return intervals.overlap_join(df, regions, how="anti")


def split_contig(df: DataFrame, contig: str) -> tuple[DataFrame, DataFrame]:
    """Rows on one contig (mitochondrial reads) and all others."""
    on = F.coalesce(F.col("chrom") == contig, F.lit(False))
    return df.where(on), df.where(~on)


def extract(df: DataFrame, names: Sequence[str], with_name: bool = False, every: bool = False, least_mapq: int = 0) -> DataFrame:
    """Tags as columns; a missing one is `.`. Rows without any (``every``: without all) of them are left out."""
    rows = require_tags(min_mapq(df.where(flags.passes("pick")), least_mapq), names, every)
    return rows.select(*(["qname"] if with_name else []), *[F.coalesce(tag(n), F.lit(".")).alias(n) for n in names])


def to_reads(df: DataFrame, names: Sequence[str] = (), every: bool = False) -> DataFrame:
    """(name, seq, qual) of alignments as sequenced: reverse ones are turned back, tags go into the name.

    With ``every`` rows that miss a tag are left out. Rows without a sequence are left out; a missing quality is null.
    """
    rows = df.where(F.col("seq").isNotNull() & (F.col("seq") != "*") & flags.passes("attributes"))
    if every:
        rows = require_tags(rows, names)
    back = flags.has(flags.REVERSE)
    return rows.select(
        tags.name_with_tags(F.col("qname"), {n: tag(n) for n in names}).alias("name"),
        F.when(back, seq.revcomp(F.col("seq"))).otherwise(F.col("seq")).alias("seq"),
        F.when(back, F.reverse("qual")).otherwise(F.nullif(F.col("qual"), F.lit("*"))).alias("qual"),
    )


def add_tags(df: DataFrame, constants: dict[str, str]) -> DataFrame:
    """Set constant tags, replacing those that are there."""
    new = F.create_map(*[F.lit(x) for kv in constants.items() for x in kv])
    old = F.map_filter(F.coalesce("tags", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*constants))
    return df.withColumn("tags", F.map_concat(old, new))


def names_to_tags(df: DataFrame, name: str = "qname") -> DataFrame:
    """Move tags kept in a read's name to the tag map; the name loses them."""
    return df.withColumns({"tags": tags.name_tags(F.col(name)), name: tags.read_id(F.col(name))})


def species(df: DataFrame, binding: DataFrame, name: str = "SP") -> DataFrame:
    """Tag each row with the species of its chromosome; ``binding`` (chrom, species) has one row per chromosome."""
    found = df.join(binding.select("chrom", F.col("species").alias("_species")), "chrom", "left")
    entry = F.when(F.col("_species").isNotNull(), F.create_map(F.lit(name), F.col("_species"))).otherwise(F.create_map().cast("map<string,string>"))
    return found.withColumn("tags", F.map_concat(F.map_filter("tags", lambda k, _: k != name), entry)).drop("_species")


def genome_bin(size: int, stranded: bool = True) -> Column:
    """Feature name `chrom[:bin]/strand` of an alignment; size 0 names the chromosome alone."""
    where = F.col("chrom") if size == 0 else F.concat("chrom", F.lit(":"), F.floor((F.col("pos") - 1) / size).cast("string"))
    return F.concat(where, F.lit("/"), flags.read_strand()) if stranded else where


def spatial_bin(x: Column, y: Column, size: int) -> Column:
    """Two numeric coordinate tags rounded down to a grid, joined by a tab; null where one is no number."""
    down = lambda c: (F.floor(c.try_cast("bigint") / size) * size).cast("string")
    return F.concat(down(x), F.lit("\t"), down(y))
