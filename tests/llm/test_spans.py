import random

from cellspindle.llm.spans import RunHasher, read_spans, shared_part, shared_spans

READS = "read_id long, seq string, h1 long, src string, pos int"


def brute(reads, known, w):
    where = {}
    for i, s in reads:
        for k in range(len(s or "") - w + 1):
            where.setdefault(s[k : k + w], set()).add(i)
    for s in known:
        for k in range(len(s or "") - w + 1):
            where.setdefault(s[k : k + w], set()).add("known")
    out = set()
    for i, s in reads:
        hit = {p for k in range(len(s or "") - w + 1) if len(where[s[k : k + w]]) > 1 for p in range(k, k + w)}
        for p in hit:
            if p - 1 not in hit:
                q = p
                while q in hit:
                    q += 1
                out.add((i, p, q))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(7)
    pool = ["".join(rng.choice("ACGTNacgt") for _ in range(60)) for _ in range(6)]
    reads = [(i, "".join(rng.choice([rng.choice(pool), "".join(rng.choice("ACGT") for _ in range(25)), rng.choice(pool)[:41]]) for _ in range(rng.randrange(4)))) for i in range(60)]
    reads += [(60, None), (61, ""), (62, "A" * 300), (63, "A" * 45), (64, "é" * 40 + "漢字" * 30), (65, "漢字" * 25), (66, pool[0]), (66, pool[0])]
    known = [pool[1][:50], None, "GATTACA"]
    df = spark.createDataFrame([(i, s, 1, "x", 2) for i, s in reads], READS)
    k = spark.createDataFrame([(s,) for s in known], "dict string")
    assert {tuple(r) for r in read_spans(df, k).collect()} == brute(reads, known, 40)
    assert read_spans(df.limit(0), k).count() == 0
    assert {tuple(r) for r in shared_spans(df, df.read_id, df.seq, width=7).collect()} == brute(reads, [], 7)


def test_hot_run_is_salted(spark):
    reads = [(i, "ACGTTGCA" * 6) for i in range(400)] + [(1000, "T" * 39)]
    df = spark.createDataFrame(reads, "read_id long, seq string")
    assert {tuple(r) for r in shared_spans(df, df.read_id, df.seq, salts=4).collect()} == {(i, 0, 48) for i in range(400)}


def test_very_long_text(spark):
    rng = random.Random(1)
    long = "".join(rng.choices("ACGT", k=700_000))
    df = spark.createDataFrame([(1, long), (2, long[262_100:262_200]), (3, long[-40:])], "read_id long, seq string")
    got = {tuple(r) for r in shared_spans(df, df.read_id, df.seq).collect()}
    assert got == {(1, 262_100, 262_200), (1, 699_960, 700_000), (2, 0, 100), (3, 0, 40)}


def test_share(spark):
    df = spark.createDataFrame([(1, "ACGT" * 15), (2, "ACGT" * 12), (3, "G" * 50), (4, None)], "read_id long, seq string")
    got = {tuple(r) for r in shared_part(df, spark.createDataFrame([], "dict string")).collect()}
    assert got == {(1, 60, 60), (2, 48, 48), (3, 50, 0), (4, None, 0)}


def test_hashes_of_equal_runs_agree():
    import numpy as np

    codes = np.frombuffer(b"abcabcabd", np.uint8).astype(np.uint64)
    h1, h2 = RunHasher(3, 20)(codes)
    assert h1[0] == h1[3] and h2[0] == h2[3] and len({*h1.tolist()}) == 4
