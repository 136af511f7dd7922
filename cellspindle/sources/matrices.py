"""Count matrices as MEX folders (barcodes, features, matrix), written and read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellspindle.session import materialize


def _numbered(values: DataFrame, column: str) -> DataFrame:
    """1-based ordinals in byte order; the numbering counts inside range partitions, on top of the ones before."""
    parts = values.distinct().repartitionByRange(column).sortWithinPartitions(column).withColumn("_p", F.spark_partition_id())
    parts = materialize(parts, "ordinals")
    offsets = parts.groupBy("_p").agg(F.count("*").alias("n"))
    offsets = offsets.select("_p", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(column))
    return parts.withColumn("_i", own).join(offsets, "_p").select(column, (F.col("_i") + F.col("_o")).alias(f"{column}_no"))


def write_matrix(matrix: DataFrame, folder: str, values: Sequence[str] = ("n",), files: Sequence[str] = ("matrix",)) -> None:
    """Folder with `barcodes.tsv`, `features.tsv` and one `<file>.mtx` for each value column, all compressed text.

    Each is a folder of parts in order. A matrix begins with its header lines; only counts above 0 are written.
    """
    features, cells = _numbered(matrix.select("feature"), "feature"), _numbered(matrix.select("cell"), "cell")
    named = materialize(matrix.join(features, "feature").join(cells, "cell").select("feature_no", "cell_no", *values), "matrix")
    text = lambda d, name: d.write.mode("overwrite").option("compression", "gzip").text(f"{folder}/{name}")
    text(features.orderBy("feature_no").select("feature"), "features.tsv")
    text(cells.orderBy("cell_no").select("cell"), "barcodes.tsv")
    shape = features.agg(F.count("*").alias("nf")).crossJoin(cells.agg(F.count("*").alias("nc")))  # one row each
    for value, file in zip(values, files, strict=True):
        rows = named.where(F.col(value) > 0)
        head = shape.crossJoin(rows.agg(F.count("*").alias("k"))).select(F.lit(0).alias("a"), F.lit(0).alias("b"), F.concat_ws("\n", F.lit("%%MatrixMarket matrix coordinate integer general"), F.lit("% written by cellspindle"), F.concat_ws(" ", "nf", "nc", "k")).alias("line"))
        body = rows.select(F.col("feature_no").alias("a"), F.col("cell_no").alias("b"), F.concat_ws(" ", "feature_no", "cell_no", value).alias("line"))
        text(head.unionByName(body).orderBy("a", "b").select("line"), f"{file}.mtx")


def read_matrix(spark: SparkSession, folder: str, files: Sequence[str] = ("matrix",)) -> DataFrame:
    """(feature, cell, one column per file) of a folder written by ``write_matrix`` or of single compressed files.

    Repeated feature names get `_1`, `_2`, ... from the second on.
    """
    def names(stem: str, column: str) -> DataFrame:
        lines = _ordered(spark, f"{folder}/{stem}.tsv", column)
        rank = F.row_number().over(Window.partitionBy(column).orderBy(f"{column}_no"))
        return lines.withColumn("_k", rank).withColumn(column, F.when(F.col("_k") == 1, F.col(column)).otherwise(F.concat_ws("_", column, F.col("_k") - 1))).drop("_k")

    out = None
    for file in files:
        f = spark.read.text(f"{folder}/{file}.mtx*").where(~F.col("value").startswith("%")).select(F.split("value", " ").alias("f"), F.monotonically_increasing_id().alias("_i"))
        head = f.agg(F.min_by("f", "_i").alias("_h"), F.min("_i").alias("_first"))  # one row: the size line
        body = f.crossJoin(F.broadcast(head)).where("_i != _first").select(F.col("f")[0].cast("bigint").alias("feature_no"), F.col("f")[1].cast("bigint").alias("cell_no"), F.col("f")[2].cast("bigint").alias(file))
        out = body if out is None else out.join(body, ["feature_no", "cell_no"], "full")
    return out.join(names("features", "feature"), "feature_no").join(names("barcodes", "cell"), "cell_no").select("feature", "cell", *[F.coalesce(f, F.lit(0)).alias(f) for f in files])


def _ordered(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(column, column_no): lines numbered in file order; the parts of a folder follow each other by name."""
    lines = spark.read.text(f"{path}*").select(F.split("value", "\t")[0].alias(column), F.input_file_name().alias("_f"), F.monotonically_increasing_id().alias("_i"))
    at = F.row_number().over(Window.partitionBy("_f").orderBy("_i"))
    sizes = lines.groupBy("_f").agg(F.count("*").alias("n"))
    before = sizes.select("_f", F.coalesce(F.sum("n").over(Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return lines.withColumn("_k", at).join(before, "_f").select(column, (F.col("_k") + F.col("_o")).alias(f"{column}_no"))


def dense(matrix: DataFrame, cells: Sequence[str], value: str = "n") -> DataFrame:
    """feature by cell table; the cells to show are named, so the pivot needs no pass of its own."""
    return matrix.groupBy("feature").pivot("cell", list(cells)).agg(F.sum(value)).na.fill(0)
