"""Error-tolerant whitelist lookups.

All lookups are equi-joins on derived keys (the string itself, its one-position masks, or the pieces it is cut into), so they
scale with both sides; the planner broadcasts a whitelist only where its measured size allows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspindle.functions import seq


def distinct_list(listed: DataFrame) -> DataFrame:
    """(entry) of the list's first column, without nulls, blanks and repeats."""
    return listed.select(F.col(listed.columns[0]).alias("entry")).where("entry != ''").distinct()


def exact(queries: DataFrame, listed: DataFrame, query: str = "query") -> DataFrame:
    """The rows whose value is in the list."""
    return queries.join(distinct_list(listed).withColumnRenamed("entry", query), query, "left_semi")


def one_mismatch(values: DataFrame, listed: DataFrame) -> DataFrame:
    """(query, entry, exact) of the distinct values of a one-column table that match the list with at most one mismatch.

    An exact match comes first. Otherwise the masks of the query are tried from the left, and the first one that belongs
    to a single entry decides; a mask shared by two entries is ambiguous and decides nothing. No match: no row.
    """
    entries = distinct_list(listed)
    asked = values.select(F.col(values.columns[0]).alias("query")).where("query is not null").distinct()
    matched = asked.join(entries, asked["query"] == entries["entry"], "left")
    sure = matched.where("entry is not null").select("query", "entry", F.lit(True).alias("exact"))
    masked = entries.select("entry", F.explode(seq.masks(F.col("entry"))).alias("m")).select("entry", "m.mask")
    unique = masked.groupBy("mask").agg(F.min("entry").alias("entry"), F.count("*").alias("n")).where("n = 1").drop("n")
    open_ = matched.where("entry is null").select("query", F.explode(seq.masks(F.col("query"))).alias("m")).select("query", "m.i", "m.mask")
    near = open_.join(unique, "mask").groupBy("query").agg(F.min_by("entry", "i").alias("entry")).withColumn("exact", F.lit(False))
    return sure.unionByName(near)


def edit_distance(values: DataFrame, listed: DataFrame, most: int = 1, method: str = "hamming") -> DataFrame:
    """(query, entry, distance) of the values with exactly one list entry within ``most`` edits.

    Exact at every length: an entry is cut into ``most + 1`` pieces, of which one at least is untouched by ``most`` edits,
    so that the value holds it at its place, or with insertions and deletions up to ``most`` places beside it. Values
    and entries are joined on (length of the entry, number of the piece, its text). ``method``: `hamming`, `levenshtein`,
    or `both` (hamming, then levenshtein where hamming found nothing).
    """
    if method == "both":
        first = edit_distance(values, listed, most, "hamming")
        rest = values.select(F.col(values.columns[0]).alias("query")).join(first, "query", "left_anti")
        return first.unionByName(edit_distance(rest, listed, most, "levenshtein"))
    shift = 0 if method == "hamming" else most
    begin = lambda i: F.floor(i * F.col("size") / (most + 1)).cast("int")
    piece = lambda c, i, d: F.struct(F.lit(i).alias("i"), F.substring(c, begin(i) + d + 1, begin(i + 1) - begin(i)).alias("text"))
    entries = distinct_list(listed).withColumn("size", F.length("entry"))
    cut = entries.select("entry", "size", F.inline(F.array(*[piece(F.col("entry"), i, 0) for i in range(most + 1)])))
    asked = values.select(F.col(values.columns[0]).alias("query")).where("query != ''").distinct()
    sized = asked.select("query", F.explode(F.sequence(F.length("query") - shift, F.length("query") + shift)).alias("size")).join(entries.select("size").distinct(), "size", "left_semi")
    places = F.array_distinct(F.array(*[F.when(begin(i) + d >= 0, piece(F.col("query"), i, d)) for i in range(most + 1) for d in range(-shift, shift + 1)]))
    pairs = sized.select("query", "size", F.inline(F.array_compact(places))).join(cut, ["size", "i", "text"]).select("query", "entry").distinct()
    distance = seq.hamming(F.col("query"), F.col("entry")) if method == "hamming" else F.levenshtein("query", "entry")
    near = pairs.withColumn("distance", distance).where(F.col("distance") <= most)
    return near.groupBy("query").agg(F.min("entry").alias("entry"), F.min("distance").alias("distance"), F.count("*").alias("n")).where("n = 1").drop("n")


def corrected(df: DataFrame, column: str, listed: DataFrame, mismatches: int = 0, new: str = "corrected") -> DataFrame:
    """``df`` with the list entry of a column's value; null where it has none."""
    if mismatches == 0:
        found = distinct_list(listed).select(F.col("entry").alias("_query"), F.col("entry").alias(new))
    elif mismatches == 1:
        found = one_mismatch(df.select(column), listed).select(F.col("query").alias("_query"), F.col("entry").alias(new))
    else:
        found = edit_distance(df.select(column), listed, mismatches).select(F.col("query").alias("_query"), F.col("entry").alias(new))
    return df.join(found, F.col(column) == F.col("_query"), "left").drop("_query")
