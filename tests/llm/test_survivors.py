import datetime

from cellspindle.llm.survivors import field_sources, survivors, voted_values

SCHEMA = "rcd_id long, flag int, chrom string, pos int, mapq int, cigar string, cb string, ur string, gn string, re string, sp string, qual int, dup int, checked int, seen_at timestamp, field string, v int, won int"
T = datetime.datetime


def rows(spark, *items):
    base = dict(flag=0, chrom="c", pos=1, mapq=None, cigar=None, cb="AC", ur="GG", gn=None, re=None, sp=None, qual=None, dup=0, checked=None, seen_at=None, field="x", v=1, won=1)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple((dict(base, rcd_id=i) | r)[n] for n in names) for i, r in enumerate(items, 1)], SCHEMA)


def test_order(spark):
    df = rows(
        spark,
        {"qual": 9, "gn": "late", "seen_at": T(2024, 1, 2)},
        {"qual": 9, "gn": "first", "seen_at": T(2024, 1, 3)},
        {"qual": 5, "checked": 1, "gn": " NA ", "mapq": 255},
        {"qual": -4, "checked": 1, "cigar": "4M", "sp": "."},
        {"qual": None, "checked": 1, "cigar": "5M", "seen_at": T(2030, 1, 1)},
        {"qual": 99, "checked": 0, "mapq": 0},
    )
    assert {tuple(r) for r in field_sources(df).collect()} == {(3, "gn", 2), (3, "cigar", 5), (3, "mapq", 6)}
    top = survivors(df).first()
    assert (top.n_member, top.keep_id, top.mapq, top.cigar, top.gn, top["re"], top.sp) == (6, 3, 0, "5M", "first", None, None)


def test_members(spark):
    df = rows(
        spark,
        {"cb": " ac-1 ", "ur": "gg\t", "re": "E"},
        {"cb": "AC-22", "re": "N"},
        {"cb": "AC-x", "re": "E"},
        {"flag": 256, "re": "E"},
        {"flag": None, "cb": "  "},
        {"cb": None},
        {"chrom": None},
        {"pos": None},
        {"pos": 2, "re": "E"},
    )
    assert {tuple(r) for r in field_sources(df).collect()} == {(1, "re", 1)}


def test_ties_nulls_and_empty(spark):
    df = rows(spark, {"re": "E"}, {"re": "N"}, {"pos": 5}, {"pos": 5})
    assert {tuple(r) for r in field_sources(df).collect()} == {(1, "re", 1)}
    assert survivors(df).count() == 2
    assert field_sources(df.limit(0)).count() == 0
    assert survivors(df.limit(0)).count() == 0


def test_hot_group(spark):
    df = rows(spark, *[{"qual": i % 97, "gn": f"g{i}" if i == 50 else None, "checked": 0} for i in range(3000)])
    assert {tuple(r) for r in field_sources(df).collect()} == {(97, "gn", 51)}


def test_votes(spark):
    """Two weaker votes for one spelling outvote a stronger one; checked records count more, old ones less."""
    now, old = T(2024, 6, 1), T(2023, 1, 1)
    df = rows(
        spark,
        {"qual": 30, "gn": "A", "re": "E", "seen_at": now, "sp": "NA"},
        {"qual": 20, "gn": " b", "re": "N", "seen_at": now, "checked": 1},
        {"qual": 20, "gn": "B ", "re": "E", "seen_at": now},
        {"qual": 90, "gn": "C", "re": "E", "seen_at": old},
        {"pos": 2, "gn": "D"},
        {"pos": 3, "gn": "y"},
        {"pos": 3, "gn": "x"},
        {"pos": 4},
        {"pos": 4},
    )
    got = {r.pos: (r.n_member, r.gn, r["re"], r.sp, r.mapq) for r in voted_values(df).collect()}
    assert got == {1: (4, "B", "N", None, None), 3: (2, "X", None, None, None), 4: (2, None, None, None, None)}
    assert voted_values(df.limit(0)).count() == 0
