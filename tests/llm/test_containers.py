import random
from collections import Counter

from pyspark.sql import functions as F

from cellspindle.llm import containers
from cellspindle.llm.containers import best_configuration, fill_containers, fill_report, plan_containers, plan_checks


def test_knapsack():
    import numpy as np

    assert best_configuration(np.array([3, 5]), np.array([3.0, 5.1]), 11) == {3: 2, 5: 1}


def test_plan_places_everything():
    rng = random.Random(3)
    for sizes in ([rng.randrange(1, 101) for _ in range(30_000)], [34] * 9_000 + [33] * 9_000 + [60] * 5_000, [100] * 5, [1], []):
        histogram = Counter(sizes)
        plan = plan_containers(histogram, 100, rounds=400, last=500)
        placed = Counter()
        for config, n in plan:
            assert sum(s * k for s, k in config.items()) <= 100
            for s, k in config.items():
                placed[s] += k * n
        assert placed == histogram
        if len(sizes) > 10_000 and max(histogram) <= 100 and len(histogram) > 50:
            assert sum(n for _, n in plan) <= 1.01 * -(-sum(sizes) // 100) + 1


def test_fill(spark):
    rng = random.Random(5)
    items = [(i, rng.choice([0, None, 1, 7, 40, 99, 100, 101, 250, 1000])) for i in range(3000)] + [(7, 40), (7, 40), (None, 3), (5, -2)]
    df = spark.createDataFrame([(i, n, "clash", 1) for i, n in items], "doc_id long, n_tokens int, container string, size int")
    out = fill_containers(df, 100, slice_rows=200).cache()
    full = out.groupBy("container").agg(F.sum("size").alias("s")).where("container is not null")
    assert full.agg(F.max("s")).first()[0] <= 100
    assert full.agg(F.max("container")).first()[0] == full.count() - 1
    got = Counter((r.doc_id, r.size) for r in out.collect())
    want = Counter()
    for i, n in items:
        n = max(n or 0, 0)
        for _ in range(n // 100):
            want[i, 100] += 1
        if n % 100 or not n:
            want[i, n % 100] += 1
    assert got == want
    assert out.where("size = 0 and container is not null").count() == 0
    report = fill_report(out, 100).first()
    assert report.n_container >= report.n_least and report.n_token == sum(max(n or 0, 0) for _, n in items)


def test_empty(spark):
    out = fill_containers(spark.createDataFrame([], "doc_id long, n_tokens int"))
    assert out.count() == 0 and fill_report(out).first().n_container == 0


def test_program_runs_at_every_size(monkeypatch):
    rest = []
    best_fit = containers._best_fit
    monkeypatch.setattr(containers, "_best_fit", lambda left, capacity: rest.append(dict(left)) or best_fit(left, capacity))
    rng = random.Random(11)
    histogram = Counter(rng.randrange(200, 701) for _ in range(20_000))
    plan = plan_containers(histogram)
    placed = Counter()
    for config, n in plan:
        assert sum(s * k for s, k in config.items()) <= 1024
        for s, k in config.items():
            placed[s] += k * n
    assert placed == histogram
    assert sum(s * n for s, n in rest[0].items()) <= len(histogram) * 1024 and sum(rest[0].values()) < 2_000
    assert sum(n for _, n in plan) < sum(n for _, n in best_fit(histogram, 1024))


def test_rest_is_bounded_when_scarce_sizes_outnumber_the_rounds(monkeypatch):
    rest = []
    best_fit = containers._best_fit
    monkeypatch.setattr(containers, "_best_fit", lambda left, capacity: rest.append(dict(left)) or best_fit(left, capacity))
    histogram = {s: 1 for s in range(1, 60)} | {900: 5_000}
    plan_containers(histogram, rounds=5)
    assert sum(s * n for s, n in rest[0].items()) <= len(histogram) * 1024


def test_checks_see_faults(spark):
    sizes = spark.createDataFrame([(1, 6), (2, 4), (3, 25), (4, 0), (5, None)], "doc_id long, n_tokens int")
    row = plan_checks(sizes, fill_containers(sizes, 10), 10).first()
    assert tuple(row) == (5, 2, 0, 0, 0, 0, True)
    bad = spark.createDataFrame([(1, 0, 3, 0), (1, 1, 3, 1), (2, 0, 4, 4), (3, 0, 25, 1), (4, 0, 0, None), (5, 0, 0, None)], "doc_id long, piece int, size int, container long")
    assert tuple(plan_checks(sizes, bad, 10).first()) == (5, 2, 1, 1, 2, 0, True)
    assert tuple(plan_checks(sizes.limit(0), bad.limit(0), 10).first()) == (0, 0, 0, 0, 0, 0, True)
