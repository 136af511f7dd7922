import random

from pyspark.sql import functions as F

from cellspindle.operators.levels import step_levels
from cellspindle.operators.periods import bed_periods, periods_and_gaps

SCHEMA = "track string, chrom string, bed_start int, bed_end int, strand string, lo int, bin int, e string"


def rows(*items):
    return [(t, c, a, b, s, 7, 7, "x") for t, c, a, b, s in items]


def brute(items):
    groups = {}
    for k, a, b in items:
        if a is not None and b is not None and 0 <= a < b:
            groups.setdefault(k, []).append((a, b))
    out = set()
    for k, v in groups.items():
        v.sort()
        lo, hi = v[0]
        for a, b in v[1:]:
            if a <= hi:
                hi = max(hi, b)
            else:
                out |= {(k, "period", lo, hi), (k, "gap", hi, a)}
                lo, hi = a, b
        out.add((k, "period", lo, hi))
    return out


def test_defined_cases(spark):
    df = spark.createDataFrame(
        rows(
            ("t", "c", 1, 5, "+"),
            ("t", "c", 5, 8, "+"),
            ("t", "c", 10, 12, "+"),
            ("t", "c", 10, 12, "+"),
            ("t", "c", 6, 7, "-"),
            ("t", "c", 3, 4, "weird"),
            ("t", "c", 9, 10, None),
            (None, "c", 1, 2, "+"),
            ("t", None, 1, 2, "+"),
            ("t", "c", -1, 2, "+"),
            ("t", "c", 5, 5, "+"),
            ("t", "c", 9, 3, "+"),
            ("t", "c", None, 3, "+"),
        ),
        SCHEMA,
    )
    got = {tuple(r) for r in bed_periods(df).collect()}
    assert got == {
        ("t", "c", "+", "period", 1, 8),
        ("t", "c", "+", "gap", 8, 10),
        ("t", "c", "+", "period", 10, 12),
        ("t", "c", "-", "period", 6, 7),
        ("t", "c", ".", "period", 3, 4),
        ("t", "c", ".", "gap", 4, 9),
        ("t", "c", ".", "period", 9, 10),
        (None, "c", "+", "period", 1, 2),
    }


def test_empty(spark):
    assert bed_periods(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_hot_entity_over_many_bins(spark):
    rng = random.Random(4)
    items = [("hot" if i % 3 else f"k{rng.randrange(9)}", a := rng.randrange(0, 40_000), a + rng.choice([1, 2, 30, 5000])) for i in range(3000)]
    df = spark.createDataFrame(items, "k string, s int, t int")
    for bits in (4, 10, 16):
        got = {tuple(r) for r in periods_and_gaps(df, ["k"], "s", "t", bin_bits=bits).collect()}
        assert got == brute(items)


def test_levels_sum_to_lengths(spark):
    rng = random.Random(5)
    items = [(rng.choice("ab"), a := rng.randrange(300_000), a + rng.randrange(1, 90_000)) for _ in range(300)]
    runs = step_levels(spark.createDataFrame(items, "k string, s int, t int"), ["k"], "s", "t")
    assert runs.agg(F.sum((F.col("hi") - F.col("lo")) * F.col("level"))).first()[0] == sum(b - a for _, a, b in items)
