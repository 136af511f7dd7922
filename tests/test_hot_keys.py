import random
from collections import defaultdict

from pyspark.sql import functions as F

from cellspindle.operators.hot_keys import barcode_counts, per_key_runs, per_key_summary, sliced

SCHEMA = "aln_id long, tags map<string,string>, key string, ord int, n_record int"


def test_cases(spark):
    data = [(1, {"CB": "A"}), (2, {"CB": "A"}), (2, {"CB": "A"}), (3, {"CB": ""}), (4, {}), (5, None), (None, {"CB": "B"})]
    df = spark.createDataFrame([(i, t, "clash", 1, 9) for i, t in data], SCHEMA)
    assert {tuple(r) for r in barcode_counts(df).collect()} == {("A", 3), ("B", 1)}
    assert barcode_counts(df.limit(0)).count() == 0


def test_runs_are_stitched(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(40)}", rng.choice([7, 900, rng.randrange(100_000)])) for _ in range(5000)]
    df = spark.createDataFrame(data, "k string, o long")
    got = {r.key: tuple(r)[1:] for r in per_key_runs(df, df.k, df.o, 100, partitions=7).collect()}
    by = defaultdict(list)
    for k, o in data:
        by[k].append(o)
    for k, v in by.items():
        v.sort()
        steps = [b - a for a, b in zip(v, v[1:], strict=False)]
        assert got[k] == (len(v), 1 + sum(s > 100 for s in steps), max(steps) if steps else None)


def test_heavy_key_is_split(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 10 < 9, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    sizes = [r["count"] for r in sliced(df, F.col("k"), F.col("id"), 8).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2.5 * 40_000 / 8
    tied = sliced(df, F.lit("one"), F.lit(None).cast("int"), 8).groupBy(F.spark_partition_id()).count().collect()
    assert len(tied) == 8 and max(r["count"] for r in tied) < 2.5 * 40_000 / 8
    top = per_key_summary(df, df.k, df.id, 8).where("key = 'hot'").first()
    assert (top.n_record, top.first_order) == (36_000, 0)
