"""Per-key results when a few keys hold most rows (problem 3).

Rows are range-partitioned on the composite (key, secondary order) with Spark's sampled quantiles, so a heavy key is
cut into as many slices as its share of the rows needs and every task gets about the same number of rows. Each slice
then gives one partial state per key (the map-side half of the aggregation runs inside the slice), and the partial
states that lie on both sides of a boundary are stitched by the final half, which sees at most one row per key and
slice. Only the key and the order column travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sliced(df: DataFrame, key: Column, order: Column, partitions: int | None = None, distinct_order: bool = False) -> DataFrame:
    """(key, ord[, tie]) range-partitioned by them; rows whose key is null or empty have no key and are left out.

    Rows of one key and order are parted by their place in the input, so that ties too are cut into slices; where the
    order has no ties (``distinct_order``) that place need not travel.
    """
    rows = df.select(key.alias("key"), order.alias("ord"), *([] if distinct_order else [F.monotonically_increasing_id().alias("tie")])).where("key != ''")
    return rows.repartitionByRange(partitions, *rows.columns) if partitions else rows.repartitionByRange(*rows.columns)


def per_key_summary(df: DataFrame, key: Column, order: Column, partitions: int | None = None, distinct_order: bool = False) -> DataFrame:
    """(key, n_record, first_order, last_order) of every key.

    Defined cases: null and empty keys are no keys; null orders count as records and are ignored for first and last;
    repeated rows count each time; ties in the order do not matter; an empty table gives no rows; clashing names in
    ``df`` do no harm, since only the two expressions are read.
    """
    return (
        sliced(df, key, order, partitions, distinct_order)
        .groupBy("key")
        .agg(F.count("*").alias("n_record"), F.min("ord").alias("first_order"), F.max("ord").alias("last_order"))
    )


def per_key_runs(df: DataFrame, key: Column, order: Column, step: int, partitions: int | None = None) -> DataFrame:
    """Runs of each key: consecutive orders no more than ``step`` apart. (key, n_record, n_run, longest_step).

    Order-dependent, so it shows the stitching: inside a slice the steps come from ``lag``; the step across a slice
    boundary comes from the last order of the key's slice before, taken from the boundary states (one row per key and
    slice). A row with a null order counts as a record and belongs to no run. Empty table: no rows.
    """
    part = sliced(df, key, order, partitions).withColumn("slice", F.spark_partition_id())
    within = Window.partitionBy("key", "slice").orderBy("ord")
    states = (
        part.withColumn("d", F.col("ord") - F.lag("ord").over(within))
        .groupBy("key", "slice")
        .agg(
            F.count("*").alias("n"),
            F.min("ord").alias("lo"),
            F.max("ord").alias("hi"),
            F.count_if(F.col("d") > step).alias("breaks"),
            F.max("d").alias("d"),
        )
    )
    across = Window.partitionBy("key").orderBy("slice")
    carried = F.last("hi", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    return (
        states.withColumn("jump", F.col("lo") - carried)
        .groupBy("key")
        .agg(
            F.sum("n").alias("n_record"),
            (F.sum("breaks") + F.count_if(F.col("jump") > step) + F.max(F.col("lo").isNotNull().cast("int"))).cast("bigint").alias("n_run"),
            F.greatest(F.max("d"), F.max("jump")).alias("longest_step"),
        )
    )


def barcode_counts(alignments: DataFrame) -> DataFrame:
    """(cb, n_record) of each barcode in `tags['CB']`, known to the whitelist or not."""
    return per_key_summary(alignments, alignments["tags"]["CB"], alignments["aln_id"], distinct_order=True).select(F.col("key").alias("cb"), "n_record")
