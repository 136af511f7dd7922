"""Tags: the FASTQ+ name codec, promotion of tags to columns, multi-valued tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "|||"


def read_id(name: Column) -> Column:
    """The name without its tags, without a leading @ or > and without what follows white space."""
    first = F.regexp_extract(name, r"\A[@>]?(\S*)", 1)
    return F.split(first, r"\|\|\|", 2)[0]


def name_tags(name: Column) -> Column:
    """Map of the tags in a FASTQ+ name `id|||CB:Z:ACGT|||UR:Z:TTTT`; the last of repeated tags wins."""
    parts = F.split(F.regexp_extract(name, r"\A(\S*)", 1), r"\|\|\|")
    fields = F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.rlike(r"\A[A-Za-z][A-Za-z0-9]:[A-Za-z]:"))
    entry = lambda p: F.struct(F.substring(p, 1, 2).alias("key"), F.substring(p, F.lit(6), F.length(p)).alias("value"))
    kept = F.filter(fields, lambda p: ~F.exists(_after(fields, p), lambda q: F.substring(q, 1, 2) == F.substring(p, 1, 2)))
    return F.map_from_entries(F.transform(F.array_distinct(kept), entry))


def _after(fields: Column, p: Column) -> Column:
    at = F.array_position(fields, p).cast("int")
    return F.slice(fields, at + 1, F.greatest(F.size(fields) - at, F.lit(0)))


def name_with_tags(name: Column, tags: dict[str, Column]) -> Column:
    """Append `|||TAG:Z:value`; a null value adds nothing, a tag already in the name is replaced."""
    out = name
    for tag, value in tags.items():
        bare = F.regexp_replace(out, rf"\|\|\|{tag}:[A-Za-z]:(?:(?!\|\|\|)\S)*", "")
        out = F.when(value.isNull(), out).otherwise(F.concat(bare, F.lit(f"{SEPARATOR}{tag}:Z:"), value))
    return out


def with_tags(df: DataFrame, tags: Sequence[str], source: str = "tags") -> DataFrame:
    """Promote map entries to columns; empty values count as missing."""
    return df.withColumns({t.lower(): F.nullif(F.col(source)[t], F.lit("")) for t in tags})


def values(multi: Column) -> Column:
    """Parts of a `;` or `,` joined value, without empty ones and repeats."""
    return F.array_distinct(F.filter(F.split(multi, "[;,]"), lambda v: v != ""))
