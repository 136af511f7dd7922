"""User functions over read blocks, and counting over unbounded input."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellspindle.functions import tags
from cellspindle.operators.filters import tag


def block_ids(df: DataFrame, names: Sequence[str], order: str = "record_no", partition: str = "file_no") -> DataFrame:
    """Number the runs of consecutive reads that share their tags, within each input file."""
    key = F.struct(*[name_tag(n) for n in names])
    along = Window.partitionBy(partition).orderBy(order)
    fresh = F.coalesce(key != F.lag(key).over(along), F.lit(True)).cast("int")
    return df.withColumn("_fresh", fresh).withColumn("block", F.sum("_fresh").over(along)).drop("_fresh")


def name_tag(name: str) -> Column:
    """A tag kept in the name of a read."""
    return tags.name_tags(F.col("name"))[name]


def apply_to_blocks(reads: DataFrame, names: Sequence[str], function: Callable[[pd.DataFrame], pd.DataFrame], least: int = 1, keep_small: bool = False, slice_rows: int | None = None) -> DataFrame:
    """Run a function on each block of reads (name, seq, qual) that share tags; its reads get the block's tags back.

    Blocks with fewer than ``least`` reads are dropped, or with ``keep_small`` passed through. The function sees a whole
    block, so a block must fit a task; with ``slice_rows`` larger blocks are handed over in slices of about that size.
    Reads without one of the tags are in no block.
    """
    keys = [f"_{n}" for n in names]
    rows = reads.select("name", "seq", "qual", *[name_tag(n).alias(k) for n, k in zip(names, keys, strict=True)]).dropna(subset=keys)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = rows.join(sizes, keys)
    part = [*keys]
    if slice_rows:
        rows = rows.withColumn("_slice", F.pmod(F.xxhash64("name", "seq"), F.greatest(F.ceil(F.col("_n") / slice_rows), F.lit(1))))
        part.append("_slice")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        out = function(pdf[["name", "seq", "qual"]].reset_index(drop=True))
        return out.reindex(columns=["name", "seq", "qual"]).assign(**{k: first[k] for k in keys})

    schema = ", ".join(["name string", "seq string", "qual string", *[f"{k} string" for k in keys]])
    done = rows.where(F.col("_n") >= least).groupBy(*part).applyInPandas(run, schema)
    if keep_small:
        done = done.unionByName(rows.where(F.col("_n") < least).select("name", "seq", "qual", *keys))
    return done.select(tags.name_with_tags(F.col("name"), {n: F.col(k) for n, k in zip(names, keys, strict=True)}).alias("name"), "seq", "qual")


def running_counts(stream: DataFrame, time: str = "loaded_at", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(window, cell, n) of an unbounded alignment table: reads per barcode and window, late rows up to ``late``.

    Works on streaming and static tables alike; rows without a time or barcode are left out.
    """
    rows = stream.withColumn("cell", tag("CB")).where(F.col("cell").isNotNull() & F.col(time).isNotNull())
    counted = rows.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "cell").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "cell", "n")


def first_deliveries(stream: DataFrame, keys: Sequence[str] = ("qname", "flag", "chrom", "pos"), time: str = "loaded_at", late: str = "7 days") -> DataFrame:
    """An unbounded alignment table without the rows delivered again within ``late``."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
