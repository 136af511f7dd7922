import random

import pytest
from pyspark.sql import functions as F

from cellspindle.operators import intervals

REGION = "chrom string, start int, end int, name string, strand string"


def regions(spark, *rows):
    return spark.createDataFrame(list(rows), REGION)


def spans(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or ("chrom", "start", "end", "strand"))).collect())


def test_merge_touching(spark):
    df = regions(spark, ("c", 1, 5, "a", "+"), ("c", 5, 8, "b", "+"), ("c", 6, 7, None, "-"), ("c", 10, 12, None, "+"))
    assert spans(intervals.merge(df)) == [("c", 1, 8, "+"), ("c", 6, 7, "-"), ("c", 10, 12, "+")]
    assert spans(intervals.merge(df, stranded=False)) == [("c", 1, 8, "."), ("c", 10, 12, ".")]
    assert spans(intervals.merge(df, stranded=False, gap=2)) == [("c", 1, 12, ".")]
    assert spans(intervals.merge(df), "start", "name")[0] == (1, "a")


def test_merge_twice_changes_nothing(spark):
    rng = random.Random(2)
    df = regions(spark, *[("c", a := rng.randrange(5000), a + rng.randrange(1, 60), None, rng.choice("+-")) for _ in range(300)])
    once = intervals.merge(df)
    assert spans(intervals.merge(once)) == spans(once)


def test_flatten(spark):
    df = regions(spark, ("c", 0, 10, "n", "+"), ("c", 5, 15, "n", "+"), ("c", 15, 20, "n", "+"), ("c", 3, 4, "m", "+"))
    assert spans(intervals.flatten(df)) == [("c", 0, 5, "+"), ("c", 3, 4, "+"), ("c", 5, 10, "+"), ("c", 10, 15, "+"), ("c", 15, 20, "+")]


def test_expand_and_shrink(spark):
    df = regions(spark, ("c", 3, 10, None, "-"), ("c", 3, 10, None, None))
    assert sorted((r.start, r.end) for r in intervals.expand(df, 5, 1).collect()) == [(0, 11), (2, 15)]
    assert [(r.start, r.end) for r in intervals.shrink(df, 4, 2).collect()] == [(5, 6), (7, 8)]


@pytest.mark.parametrize("size", [7, 1000])
def test_overlaps_equal_brute_force(spark, size):
    rng = random.Random(3)
    make = lambda n: [(rng.choice("ab"), a := rng.randrange(3000), a + rng.choice([0, 1, 20, 900])) for _ in range(n)]
    left, right = make(80), make(60)
    l = spark.createDataFrame([(i, *x) for i, x in enumerate(left)], "i int, chrom string, start int, end int")  # noqa: E741
    r = spark.createDataFrame([(j, *x) for j, x in enumerate(right)], "j int, rc string, rs int, re int")
    want = {(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if x[0] == y[0] and x[1] < y[2] and y[1] < x[2] and x[1] < x[2] and y[1] < y[2]}
    got = [(x.i, x.j) for x in intervals.overlap_join(l, r, right_on=("rc", "rs", "re"), size=size).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    hit = {i for i, _ in want}
    renamed = r.select(F.col("rc").alias("chrom"), F.col("rs").alias("start"), F.col("re").alias("end"))
    assert {x.i for x in intervals.overlap_join(l, renamed, how="semi", size=size).collect()} == hit
    assert {x.i for x in intervals.overlap_join(l, renamed, how="anti", size=size).collect()} == set(range(80)) - hit


def test_null_intervals_overlap_nothing(spark):
    l = regions(spark, (None, 1, 5, None, None), ("c", None, 5, None, None), ("c", 2, 3, None, None))  # noqa: E741
    r = regions(spark, ("c", 0, 9, None, None))
    assert intervals.overlap_join(l, r, how="semi").count() == 1
    assert intervals.overlap_join(l, r, how="anti").count() == 2


def test_distinct(spark):
    df = regions(spark, ("c", 1, 2, "b", "+"), ("c", 1, 2, "a", "+"), ("c", 1, 2, "a", "-"))
    assert intervals.distinct_regions(df).count() == 2
    assert intervals.distinct_regions(df, with_name=True).count() == 3
    assert intervals.union_regions([df, df.drop("name")]).count() == 6


@pytest.mark.parametrize("size", [7, 1000])
def test_crowded_bins_equal_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(intervals, "CROWDED", 2)
    monkeypatch.setattr(intervals, "SLICE", 0.5)
    rng = random.Random(4)
    make = lambda n: [(rng.choice("ab"), a := rng.randrange(-50, 2000), a + rng.choice([0, 1, 20, 900])) for _ in range(n)]
    left, right = make(80), make(60)
    l = spark.createDataFrame([(i, *x, {"k": "v"}) for i, x in enumerate(left)], "i int, chrom string, start int, end int, m map<string,string>")  # noqa: E741
    r = spark.createDataFrame([(j, *x) for j, x in enumerate(right)], "j int, rc string, rs int, re int")
    want = {(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if x[0] == y[0] and x[1] < y[2] and y[1] < x[2] and x[1] < x[2] and y[1] < y[2]}
    got = [(x.i, x.j) for x in intervals.overlap_join(l, r, right_on=("rc", "rs", "re"), size=size, counted=l).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_peaks_in_crowded_bins(spark, monkeypatch):
    from cellspindle.operators import coverage

    monkeypatch.setattr(intervals, "CROWDED", 2)
    frags = spark.createDataFrame([("c", 0, 900, "x", 1), ("c", 10, 20, "x", 2), ("c", 890, 900, "y", 1)], "chrom string, start int, end int, barcode string, dup long")
    peaks = spark.createDataFrame([("c", 5, 895), ("c", 5, 895), ("c", 0, 10)], "chrom string, start int, end int")
    found = coverage.peak_matrix(frags, peaks)
    assert "_part" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r)[1:] for r in found.collect()) == [(0, 10, "x", 1), (5, 895, "x", 2), (5, 895, "y", 1)]


def test_overlap_query_cuts_crowded_bins(spark):
    from cellspindle.plans import genomics

    found = genomics.QUERIES["overlap_join"](spark, "/root/testdata/sf0.001")
    assert "_part" in found._jdf.queryExecution().executedPlan().toString()
