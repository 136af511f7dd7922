"""Hand cases of the alignment operators."""

from cellspindle.functions import cigar, numbers, seq, tags
from cellspindle.operators import counting, coverage, filters, molecules, read_structure, whitelist
from cellspindle.operators.filters import tag
from pyspark.sql import functions as F

ALN = "aln_id long, qname string, flag int, chrom string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,string>"


def aln(spark, *rows):
    base = dict(qname="q", flag=0, chrom="c", pos=1, mapq=60, cigar="10M", rnext="*", pnext=0, tlen=0, seq="ACGTACGTAC", qual="IIIIIIIIII", tags={})
    return spark.createDataFrame([tuple((dict(base, aln_id=i) | r)[k.split()[0]] for k in ALN.replace("map<string,string>", "map").split(", ")) for i, r in enumerate(rows)], ALN)


def test_count(spark):
    df = aln(
        spark,
        {"tags": {"CB": "1", "GN": "G1;G2", "UR": "A"}},
        {"tags": {"CB": "1", "GN": "G1", "UR": "A"}},
        {"tags": {"CB": "1", "GN": "G1", "UR": "B"}},
        {"tags": {"CB": "1", "GN": "G1", "UR": "Z"}, "mapq": None},
        {"tags": {"CB": "1", "GN": "G1", "UR": "Y"}, "flag": 1024},
        {"tags": {"CB": "", "GN": "G1", "UR": "Y"}},
        {"tags": None},
    )
    assert {tuple(r) for r in counting.count_matrix(df, umi=tag("UR")).collect()} == {("G1", "1", 2), ("G2", "1", 1)}
    assert {tuple(r) for r in counting.count_matrix(df, umi=tag("UR"), one_hit=True).collect()} == {("G1", "1", 2)}
    assert counting.count_matrix(df.limit(0)).count() == 0


def test_velocity(spark):
    df = aln(spark, *[{"tags": {"CB": "1", "GN": "G", "UR": u, "RE": r}} for u, r in (("1", "E"), ("2", "N"), ("3", "C"), ("4", "V"))])
    assert tuple(counting.velocity_matrix(df).first()) == ("G", "1", 3, 1, 2, 1)


def test_attributes(spark):
    df = aln(spark, *[{"tags": {"CB": "1", **t}} for t in ({"GN": "G1"}, {"GN": "G1"}, {})])
    assert tuple(counting.attributes(df, ["GN"]).first()) == ("1", 3, 2)
    assert tuple(counting.attributes(df, ["GN"], distinct=True).first()) == ("1", 3, 1)


def test_rmdup(spark):
    t = {"CB": "1", "UR": "A"}
    df = aln(spark, {"qual": "+" * 10, "tags": t}, {"qual": "5" * 10, "tags": t}, {"qual": "5" * 10, "tags": t}, {"tags": {}}, {"flag": 4, "tags": {}}, {"flag": 256, "tags": t}, {"qual": None, "pos": 9, "tags": t})
    assert sorted(r.aln_id for r in molecules.remove_duplicates(df).collect()) == [1, 4, 6]
    assert {r.aln_id: r.flag for r in molecules.mark_duplicates(df).collect()} == {0: 1024, 1: 0, 2: 1024, 4: 4, 6: 0}


def test_umi_clusters(spark):
    counts = {"AAAA": 5, "AAAT": 2, "AATT": 1, "GGGG": 3}
    df = aln(spark, *[{"tags": {"CB": "1", "GN": "g", "UR": u}} for u, n in counts.items() for _ in range(n)])
    for distance in (1, 2):
        got = {r.umi: r.corrected for r in molecules.umi_clusters(df, distance=distance).collect()}
        assert got == {"AAAA": "AAAA", "AAAT": "AAAA", "AATT": "AAAA", "GGGG": "GGGG"}
    done = molecules.correct_umis(df).groupBy(F.col("tags")["UB"]).count().collect()
    assert {r[0]: r[1] for r in done} == {"AAAA": 8, "GGGG": 3}


def test_one_gene_per_umi(spark):
    genes = [("G1", "AAAA", 5), ("G2", "AAAA", 2), ("G1", "CCCC", 2), ("G2", "CCCC", 2)]
    df = aln(spark, *[{"tags": {"CB": "1", "GN": g, "UR": u}} for g, u, n in genes for _ in range(n)])
    assert [tuple(r) for r in molecules.one_gene_per_umi(molecules.umi_clusters(df)).collect()] == [("1", "G1", "AAAA", 5)]


def test_fusion(spark):
    df = aln(spark, *[{"tags": {"CB": "1", "UR": u, "GN": g}} for u, g in (("A", "x"), ("A", "y"), ("A", "z"), ("A", "p;q"), ("B", "x"))])
    assert tuple(molecules.fusion_candidates(df).first()) == ("1", "A", "x;y;z", "x|y;x|z;y|z")


def test_depth(spark):
    df = aln(spark, {"pos": 1, "tags": {"CB": "1", "UR": "u"}}, {"pos": 6, "tags": {"CB": "1", "UR": "u"}})
    base = {r.pos: r.level for r in coverage.per_base(coverage.depth(df)).collect()}
    assert base == {p: 1 if p < 6 or p > 10 else 2 for p in range(1, 16)}
    once = coverage.depth(df, umi=tag("UR"))
    assert [(r.lo, r.hi, r.level) for r in once.collect()] == [(0, 15, 1)]
    skipped = aln(spark, {"cigar": "2S3M2D1M4N2M2I1M"})
    assert sorted((r.lo, r.hi) for r in coverage.depth(skipped).collect()) == [(0, 3), (5, 6), (10, 13)]
    zero = coverage.depth_in_regions(coverage.depth(df), spark.createDataFrame([("c", 12, 17)], "chrom string, start int, end int"), zeros=True)
    assert {r.pos: r.level for r in zero.collect()} == {13: 1, 14: 1, 15: 1, 16: 0, 17: 0}


def test_fragments(spark):
    df = aln(spark, {"flag": 0x63, "pos": 101, "tlen": 50, "tags": {"CB": "1"}}, {"flag": 0x63, "pos": 101, "tlen": 50, "tags": {"CB": "1"}})
    row = lambda **k: tuple(coverage.fragments(df, **k).first())
    assert row() == ("c", 104, 145, "1", 2)
    assert row(shift=False) == ("c", 100, 150, "1", 2)
    assert coverage.fragments(df, most=10).count() == 0
    black = spark.createDataFrame([("c", 140, 150)], "chrom string, start int, end int")
    assert coverage.fragments(df, blacklist=black).count() == 0
    assert coverage.cut_sites(coverage.fragments(df)).first().n == 1


def test_peaks(spark):
    df = aln(spark, *[{"pos": p, "cigar": "60M"} for p in (1, 1, 1, 80, 80, 80)])
    assert [(r.start, r.end) for r in coverage.call_peaks(df, cutoff=2).collect()] == [(0, 139)]
    assert coverage.call_peaks(df, cutoff=3).count() == 0


def test_masks(spark):
    listed = spark.createDataFrame([("AAAA",), ("CCCC",), ("CCCG",), (None,), ("",)], "b string")
    asked = spark.createDataFrame([("AAAT",), ("CCCC",), ("CCCT",), ("AATT",), (None,), ("A",)], "q string")
    assert {(r.query, r.entry, r.exact) for r in whitelist.one_mismatch(asked, listed).collect()} == {("AAAT", "AAAA", False), ("CCCC", "CCCC", True)}


def test_edit_distance(spark):
    listed, asked = spark.createDataFrame([("CGATCGTCAG",)], "b string"), spark.createDataFrame([("GATCGTCAGC",)], "q string")
    assert whitelist.edit_distance(asked, listed, 1, "levenshtein").count() == 0
    assert whitelist.edit_distance(asked, listed, 2, "levenshtein").first().entry == "CGATCGTCAG"
    assert whitelist.edit_distance(asked, listed, 2, "both").first().distance == 2


def test_rules(spark):
    reads = spark.createDataFrame([("@r1/1 x", "AAAATTCCACGT", "IIIIIIIIIIII"), ("r2", "GGGGTTCCACGN", "IIIIIIIIII!!"), ("r3", "TTTTTTCCACGT", "IIIIIIIIIIII")], "name string, r1_seq string, r1_qual string")
    lists = {"w": spark.createDataFrame([("AAAC",), ("GGGG",)], "b string")}
    rules = read_structure.parse_rules("CR,R1:1-4,w,CB,1;CR,R1:5-6;UR,R1:7-8;R1,R1:9-")
    got = {tuple(r) for r in read_structure.apply_segments(reads, rules, lists.__getitem__).collect()}
    assert got == {("r1/1|||CR:Z:AAAATT|||UR:Z:CC|||CB:Z:AAAC", "ACGT", "IIII", "corrected"), ("r2|||CR:Z:GGGGTT|||UR:Z:CC|||CB:Z:GGGG", "ACGN", "II!!", "exact")}
    assert read_structure.apply_segments(reads, rules, lists.__getitem__, drop_n=True).count() == 1
    assert read_structure.apply_segments(reads, rules, lists.__getitem__, least_quality=25).count() == 1
    report = read_structure.parse_report(read_structure.apply_segments(reads, rules, lists.__getitem__, keep_failed=True))
    assert {tuple(r) for r in report.collect()} == {("exact", 1), ("corrected", 1), ("failed", 1)}


def test_structure():
    config = read_structure.lenient_json('{"cell barcode tag":"CB", // c\n"cell barcode":[{"location":"R1:1-16",}],"UMI":{"location":"R1:17-28",},"read 1":{"location":"R2:1-91",},}')
    segments, lists = read_structure.structure_segments(config)
    assert [(s.tag, s.mate, s.start, s.end) for s in segments] == [("CB", 1, 1, 16), ("UR", 1, 17, 28), ("R1", 2, 1, 91)] and lists == {}
    assert read_structure.parse_rules(read_structure.PRESETS["C4"])[1].corrected == "CB"


def test_functions(spark):
    row = lambda *c: tuple(spark.range(1).select(*c).first())
    assert row(seq.bases_from_hex(F.lit("0123")), seq.revcomp(F.lit("ACGTN")), seq.hamming(F.lit("AC"), F.lit("AT"))) == ("AACAGATAAA", "NACGT", 1)
    name = F.lit("id|||CB:Z:AC|||UR:Z:G:T|||CB:Z:GG x|||ZZ:Z:no")
    assert row(tags.read_id(name), tags.name_tags(name)) == ("id", {"UR": "G:T", "CB": "GG"})
    assert row(tags.name_with_tags(F.lit("id|||CB:Z:AC|||UR:Z:G"), {"CB": F.lit("TT"), "XX": F.lit(None)})) == ("id|||UR:Z:G|||CB:Z:TT",)
    assert row(tags.values(F.lit("a;b,,a"))) == (["a", "b"],)
    assert [tuple(b) for b in row(cigar.blocks(F.lit(5), F.lit("2S3M1I2D4M100N6M")))[0]] == [(5, 13), (114, 119)]
    assert row(cigar.read_offset(F.lit(5), F.lit("2S3M1I4M"), F.lit(8)), cigar.read_offset(F.lit(5), F.lit("2M3D2M"), F.lit(8))) == (7, None)
    assert (numbers.memory_size("1K"), numbers.genome_size("1K"), numbers.genome_size("2.5m")) == (1024, 1000, 2_500_000)


def test_filters(spark):
    df = aln(spark, {"tags": {"CB": "1", "GN": "g"}}, {"tags": {"CB": "2"}}, {"flag": 512, "tags": {"CB": "1", "GN": "g"}}, {"chrom": None, "tags": {"CB": ""}})
    listed = spark.createDataFrame([("1", "g"), ("1", "g")], "a string, b string")
    assert [r.aln_id for r in filters.pick(df, ["CB", "GN"], listed).collect()] == [0]
    assert sorted(r.aln_id for r in filters.pick(df, ["CB"]).collect()) == [0, 1]
    assert {tuple(r) for r in filters.extract(df, ["CB", "GN"]).collect()} == {("1", "g"), ("2", ".")}
    mito, rest = filters.split_contig(df, "c")
    assert (mito.count(), rest.count()) == (3, 1)
    assert filters.names_to_tags(aln(spark, {"qname": "r|||CB:Z:A"})).select("qname", "tags").first() == ("r", {"CB": "A"})
    turned = filters.to_reads(aln(spark, {"flag": 16, "seq": "AACG", "qual": "ABCD"})).first()
    assert (turned.seq, turned.qual) == ("CGTT", "DCBA")


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_finds_all(spark):
    """Every length, short ones and single letters too, against brute force."""
    import random

    r = random.Random(3)
    word = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    entries = sorted({word(n) for n in (1, 2, 8, 8, 10, 10, 16, 20, 20) for _ in range(4)})

    def worn(w, e):
        for _ in range(e):
            i = r.randrange(len(w) + 1)
            w = r.choice([w[:i] + r.choice("ACGT") + w[i:], w[:i] + w[i + 1 :], w[:i] + r.choice("ACGT") + w[i + 1 :]])
        return w

    queries = sorted({worn(w, e) for w in entries for e in (0, 1, 2, 2, 3)} - {""})
    asked, listed = (spark.createDataFrame([(x,) for x in xs], "v string") for xs in (queries, entries))
    for most in (1, 2):
        for method, distance in (("levenshtein", _edits), ("hamming", lambda a, b: sum(x != y for x, y in zip(a, b, strict=True)) if len(a) == len(b) else 99)):
            near = {q: [w for w in entries if distance(q, w) <= most] for q in queries}
            want = {(q, ws[0], distance(q, ws[0])) for q, ws in near.items() if len(ws) == 1}
            assert {tuple(x) for x in whitelist.edit_distance(asked, listed, most, method).collect()} == want
