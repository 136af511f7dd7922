import pytest

from cellspindle.operators.parse_lines import check_lines, failed_rows, valid_rows
from cellspindle.sources import text

GOOD = ["q1", "0", "chr1", "5", "60", "4M", "*", "0", "0", "ACGT", "FFFF"]
HEAD = [("f", "@HD\tVN:1.6"), ("f", "@SQ\tSN:chr1\tLN:100"), ("f", "@SQ\tLN:9\tSN:odd,name\r"), ("g", "@SQ\tSN:chr2\tLN:7"), ("f", "@CO\tanything \"at all")]


def line(**changes):
    names = "qname flag rname pos mapq cigar rnext pnext tlen seq qual".split()
    f = list(GOOD)
    for k, v in changes.items():
        if k != "tags":
            f[names.index(k)] = v
    return "\t".join([*f, *changes.get("tags", [])])


CASES = [
    (line(), None),
    (line() + "\r", None),
    (line(tags=["NH:i:+3", "XA:A:!", "XF:f:-.5e-3", "XZ:Z:", "XH:H:1aF0", "XB:B:f,1,-2.5e3", "X1:Z:two words"]), None),
    (line(rname="odd,name", rnext="=", tlen="-2147483647"), None),
    (line(seq="*", qual="*", cigar="9S"), None),
    (line(seq="A", qual="*", cigar="*"), None),
    (line(qual='"FFF'), None),
    (line(qual='FF"F'), None),
    ('"q1"' + line()[2:], None),
    (line(tags=['"CO:Z:say ""hi"""']), None),
    (line(tags=['CO:Z:say "hi"']), None),
    (line(flag="000016", pos="2147483647"), None),
    (line(cigar="2M900N2M1H1P"), None),
    (None, "columns"),
    ("", "columns"),
    ("\r", "columns"),
    ("\t".join(GOOD[:10]), "columns"),
    ("@SQ", "columns"),
    (line(rname='"chr1\tchr1"')[:-5], "columns"),
    (line(cigar='"4M\t*"'), "value"),
    (line(rname='"chr1'), "quoting"),
    ('"q1""' + line()[2:], "quoting"),
    ('"q1"x' + line()[2:], "quoting"),
    ('"only', "quoting"),
    (line(tags=['"NH:i:1" ']), "quoting"),
    (line(tags=['CO:Z:"x', '"CO:Z:x']), "quoting"),
    (line(tags=["CO:Z:tab\there"]), "value"),
    (line(qname="q@1"), "value"),
    (line(qname=""), "value"),
    (line(qname="q" * 255), "value"),
    (line(flag="65536"), "value"),
    (line(flag="-1"), "value"),
    (line(flag="99999999999999999999999"), "value"),
    (line(rname="chr2"), "value"),
    (line(rname="="), "value"),
    (line(pos="2147483648"), "value"),
    (line(mapq="256"), "value"),
    (line(mapq=" 6"), "value"),
    (line(cigar="4Q"), "value"),
    (line(cigar=""), "value"),
    (line(cigar="5M"), "value"),
    (line(cigar="99999999999999999999M"), "value"),
    (line(rnext="nowhere"), "value"),
    (line(tlen="+1"), "value"),
    (line(tlen="-2147483648"), "value"),
    (line(seq="AC-T"), "value"),
    (line(qual="FFF"), "value"),
    (line(qual="FF F"), "value"),
    (line(seq="*", qual="FFFF"), "value"),
    (line(tags=[""]), "value"),
    (line(tags=["N:i:1"]), "value"),
    (line(tags=["1N:i:1"]), "value"),
    (line(tags=["NH:i:"]), "value"),
    (line(tags=["NH:i:1.5"]), "value"),
    (line(tags=["XH:H:1AF"]), "value"),
    (line(tags=["XB:B:c"]), "value"),
    (line(tags=["XF:f:nan"]), "value"),
    (line(tags=["XA:A:ab"]), "value"),
]


@pytest.fixture(scope="module")
def lines(spark):
    data = [(-i, f, t, "clash", 0) for i, (f, t) in enumerate(HEAD, 1)] + [(i, "f", t, "clash", 0) for i, (t, _) in enumerate(CASES)]
    return spark.createDataFrame(data, "line_id long, file_id string, str string, errors string, flag int")


@pytest.mark.parametrize("names", [200_000, 1])
def test_reasons(lines, names):
    checked = check_lines(lines, broadcast_names=names, salts=3).cache()
    got = {r.line_id: r.reason for r in failed_rows(checked).collect()}
    assert got == {i: why for i, (_, why) in enumerate(CASES) if why}
    assert valid_rows(checked).count() == sum(why is None for _, why in CASES)


def test_unquoted_values(lines):
    rows = {r.line_id: r for r in valid_rows(check_lines(lines)).collect()}
    assert rows[8].qname == "q1" and rows[8].flag == 0
    assert rows[9].tags == ['CO:Z:say "hi"'] and rows[10].tags == ['CO:Z:say "hi"']


def test_empty_null_and_long(spark):
    schema = "line_id long, file_id string, str string"
    assert check_lines(spark.createDataFrame([], schema)).count() == 0
    long_tag = line(tags=['"CO:Z:' + 'x""' * 60_000 + '"', "ZZ:Z:" + "y" * 100_000])
    many = line(tags=["NH:i:1"] * 5_000)
    torn = line(tags=['"' + "a\t" * 20_000])
    df = spark.createDataFrame([(1, None, "@SQ\tSN:chr1\tLN:5"), (2, None, long_tag), (3, None, many), (4, None, torn), (5, "f", line())], schema)
    assert {(r.line_id, r.reason) for r in failed_rows(check_lines(df)).collect()} == {(4, "quoting"), (5, "value")}


def test_alignments(spark):
    data = [(1, "f", "@SQ\tSN:chr1\tLN:50"), (2, "f", line(qname="r|||CB:Z:AC|||UR:Z:GG", tags=["GN:Z:g", "CB:Z:own"])), (3, "f", line(rname="*", pos="0", cigar="*"))]
    rows = {r.aln_id: r for r in text.alignments(spark.createDataFrame(data, "line_id long, file_id string, str string")).collect()}
    assert rows[2].qname == "r" and rows[2].tags == {"CB": "own", "UR": "GG", "GN": "g"}
    assert rows[3].chrom is None and rows[3].pos is None and rows[3].cigar is None
