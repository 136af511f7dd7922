import pytest
from test_operators import aln

from cellspindle.operators import genes

FEATURE = "chrom string, source string, feature string, start int, end int, strand string, gene_id string, gene_name string, transcript_id string"


def model(spark, *rows):
    return spark.createDataFrame([("c", "s", f, a, b, s, g, g.lower(), t) for f, a, b, s, g, t in rows], FEATURE)


@pytest.fixture(scope="module")
def two_exons(spark):
    return model(spark, ("exon", 101, 200, "+", "G", "T"), ("exon", 301, 400, "+", "G", "T"))


@pytest.mark.parametrize(
    ("pos", "cigar", "flag", "want"),
    [
        (120, "61M", 0, "E"),
        (150, "51M100N50M", 0, "S"),
        (190, "41M", 0, "C"),
        (220, "61M", 0, "N"),
        (150, "51M109N41M", 0, "V"),
        (120, "61M", 16, "A"),
        (220, "61M", 16, "B"),
        (120, "61M", 16 | 128, "E"),
        (500, "10M", 0, "I"),
        (150, "201M", 0, "R"),
        (150, "51M100N150M", 0, "I"),
        (120, "10M2D49M", 0, "E"),
    ],
)
def test_read_types(spark, two_exons, pos, cigar, flag, want):
    row = genes.annotate_reads(aln(spark, {"pos": pos, "cigar": cigar, "flag": flag}), two_exons, introns=True, antisense=True).first()
    assert row.re == want
    assert row.gn == (["g"] if want in "ESRNC" else None)
    assert row["at"] == (["g"] if want in "AB" else None)


def test_details(spark):
    m = model(spark, ("exon", 101, 200, "+", "G", "T"), ("exon", 301, 400, "+", "G", "T"), ("exon", 101, 200, "+", "G", "U"), ("exon", 230, 260, "+", "G", "U"), ("exon", 301, 400, "+", "G", "U"), ("gene", 90, 500, "-", "H", None), ("exon", 90, 500, "-", "H", "V"))
    row = genes.annotate_reads(aln(spark, {"pos": 101, "cigar": "100M100N50M"}), m).first()
    assert row.re == "S" and row.tx == ["T"] and row.jc == ["c:200-301/+/g"]
    assert row.ex == ["c:101-200/+/g", "c:301-400/+/g"] and row.tss == ["g:101/+"] and row["er"] is None


def test_unmapped_and_empty(spark, two_exons):
    df = aln(spark, {"flag": 4, "pos": None, "cigar": None, "chrom": None}, {"pos": 120, "cigar": None}, {"pos": 120})
    assert [r.aln_id for r in genes.annotate_reads(df, two_exons).collect()] == [2]
    assert genes.annotate_reads(df, two_exons.limit(0)).first().re == "I"


def test_made_records(spark):
    m = model(spark, ("exon", 30, 40, "-", "G", "T"), ("exon", 10, 20, "-", "G", "T"), ("CDS", 12, 18, "-", "G", "T"))
    got = [(r.feature, r.start, r.end) for r in genes.normalised(m).collect()]
    assert got == [("gene", 10, 40), ("transcript", 10, 40), ("exon", 10, 20), ("CDS", 12, 18), ("exon", 30, 40)]
    assert {r.metric: r.value for r in genes.summary(m).collect()} == {"genes_forward": 0, "genes_reverse": 1, "genes_coding": 1, "transcripts": 1, "exons": 2, "gene_bases": 31, "exon_bases": 22}
    assert [tuple(r) for r in genes.to_regions(m, "gene").collect()] == [("c", 9, 40, "g", "-")]


def test_region_types(spark):
    m = model(spark, ("exon", 1001, 1200, "+", "G", "T"), ("CDS", 1101, 1200, "+", "G", "T"), ("exon", 1301, 1400, "+", "G", "T"), ("CDS", 1301, 1350, "+", "G", "T"))
    cases = {
        (1010, 1050, "+"): "utr5",
        (1110, 1150, "+"): "exon",
        (1360, 1390, "+"): "utr3",
        (1150, 1350, "+"): "multiexons",
        (1190, 1220, "+"): "exonintron",
        (1220, 1260, "+"): "intron",
        (1220, 1260, "-"): "antisense_intron",
        (1010, 1050, "-"): "antisense_utr5",
        (990, 1500, "."): "whole_gene",
        (400, 500, "."): "upstream",
        (2000, 2100, "."): "downstream",
        (400, 500, "-"): "antisense_upstream",
        (900, 1050, "."): "upstream",
        (5000, 5100, "."): "intergenic",
    }
    df = spark.createDataFrame([(i, "c", a, b, s) for i, (a, b, s) in enumerate(cases)], "row_id int, chrom string, start int, end int, strand string")
    got = {r.row_id: r.type for r in genes.annotate_bed(df, m).collect()}
    assert got == dict(enumerate(cases.values()))


def test_several_genes(spark):
    m = model(spark, ("exon", 101, 200, "+", "G", "T"), ("exon", 151, 300, "+", "H", "U"))
    df = spark.createDataFrame([(1, "c", 159, 180, "+")], "row_id int, chrom string, start int, end int, strand string")
    row = genes.annotate_bed(df, m).first()
    assert (row.type, row.genes) == ("multigenes", ["g", "h"])


def test_rescue(spark, two_exons):
    df = aln(
        spark,
        {"qname": "r", "flag": 0, "pos": 900, "seq": "AACG", "qual": "ABCD", "cigar": "4M"},
        {"qname": "r", "flag": 256 | 16, "pos": 120, "seq": "*", "qual": "*", "cigar": "4M"},
        {"qname": "s", "flag": 256, "pos": 130, "cigar": "4M"},
    )
    types = genes.annotate_reads(df, two_exons, ignore_strand=True)
    rows = {r.aln_id: r for r in genes.rescue_multimappers(df, types).collect()}
    assert (rows[1].flag, rows[1].mapq, rows[1].seq, rows[1].qual, rows[1].tags) == (16, 255, "CGTT", "DCBA", {"MM": "1"})
    assert (rows[0].flag, rows[0].mapq, rows[0].seq) == (256, 0, "*")
    assert rows[2].flag == 256 and rows[2].mapq == 60


def test_variants(spark):
    v = spark.createDataFrame([("c", 12, ["A", "G"], "b1"), ("c", 14, ["C", "CTT"], None), ("c", 16, ["GA", "G"], None)], "chrom string, pos int, alleles array<string>, block string")
    df = aln(
        spark,
        {"pos": 10, "cigar": "10M", "seq": "TTGTCTGATT"},  # 12 G
        {"pos": 10, "cigar": "5M2I5M", "seq": "TTATCTTTGATT"},  # 14 C>CTT
        {"pos": 10, "cigar": "7M1D3M", "seq": "TTATCTGTTT"},  # 16 GA>G
        {"pos": 10, "cigar": "10M", "seq": "TTNTCTGATT"},
        {"pos": 100, "cigar": "10M"},
    )
    got = {r.aln_id: r.vr for r in genes.variants_on_reads(df, v).collect()}
    assert got == {0: "c:12A>G/+", 1: "c:14C>CTT/+", 2: "c:16GA>G/+"}
    both = {r.aln_id: r.vr for r in genes.variants_on_reads(df, v, with_reference=True).collect()}
    assert both[3] == "c:14C=/+;c:16GA=/+"
    assert genes.variants_on_reads(df.where("aln_id = 0"), v, phased=True).first().vr == "b1:1/+"


def test_named_regions(spark):
    r = spark.createDataFrame([("c", 100, 200, "p", None), ("c", 150, 160, None, "+"), ("c", 150, 160, "m", "-")], "chrom string, start int, end int, name string, strand string")
    assert genes.annotate_regions(aln(spark, {"pos": 152}), r).first().names == "c:150-160/+;p"
    assert genes.annotate_regions(aln(spark, {"pos": 141, "cigar": "10M9N2M"}), r).first().names == "c:150-160/+;p"
    assert genes.annotate_regions(aln(spark, {"pos": 141, "cigar": "10M10N2M"}), r).first().names == "p"


def test_flattened_exons(spark):
    m = model(spark, ("exon", 1, 10, "+", "G", "T"), ("exon", 6, 15, "+", "G", "U"))
    assert sorted((r.start, r.end) for r in genes.flattened_exons(m).collect()) == [(0, 5), (5, 10), (10, 15)]


def test_models_are_not_broadcast(spark, two_exons, tmp_path):
    df = spark.createDataFrame([(1, "c", 159, 180, "+")], "row_id int, chrom string, start int, end int, strand string")
    two_exons.write.parquet(str(tmp_path / "m"))
    found = genes.annotate_bed(df, spark.read.parquet(str(tmp_path / "m")))
    assert broadcasts(plan(found)) == "" and found.first().type == "exon"


def test_report_broadcasts_nothing(spark, two_exons, tmp_path):
    spark.createDataFrame([(1, "c", 159, 180, "+"), (2, "c", 210, 230, "+")], "row_id int, chrom string, start int, end int, strand string").write.parquet(str(tmp_path / "r"))
    two_exons.write.parquet(str(tmp_path / "m"))
    df = spark.read.parquet(str(tmp_path / "r"))
    found = genes.type_report(genes.annotate_bed(df, spark.read.parquet(str(tmp_path / "m"))), df)
    assert broadcasts(plan(found)) == "" and {tuple(r) for r in found.collect()} == {("exon", 1, 21), ("intron", 1, 20)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def broadcasts(text):
    """Lines of the joins that broadcast a side, but for the short table of crowded bins."""
    return "\n".join(x for x in text.split("\n") if "BroadcastHashJoin" in x and "_hbin" not in x)


def test_variants_meet_pieces_of_reads(spark):
    """A read's whole span, skips included, met every variant before; now only its aligned pieces do."""
    v = spark.createDataFrame([("c", 12, ["A", "G"]), ("c", 2000, ["A", "G"]), ("c", 4015, ["CA", "C"])], "chrom string, pos int, alleles array<string>")
    df = aln(spark, {"pos": 10, "cigar": "2S6M4000N6M1D2M", "seq": "NNTTATCTTCTATGTT"})
    found = genes.variants_on_reads(df, v, with_reference=True)
    assert "q#" in plan(found) and found.first().vr == "c:12A=/+"


def test_types_without_details(spark, two_exons, monkeypatch):
    from cellspindle.operators import intervals

    monkeypatch.setattr(intervals, "CROWDED", 0)
    df = aln(spark, *[{"pos": 90 + 7 * i, "cigar": "20M", "flag": 16 * (i % 2)} for i in range(20)], {"pos": 150, "cigar": "51M100N50M"})
    types, full = genes.read_types(df, two_exons), genes.annotate_reads(df, two_exons)
    assert "_part" in plan(full) and "collect_list" in plan(full) and "collect_list" not in plan(types)
    assert sorted((r.aln_id, r.re) for r in types.collect()) == sorted((r.aln_id, r.re) for r in full.collect())
