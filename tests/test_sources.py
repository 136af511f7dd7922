"""Files: written here by hand, read back, and round trips through the sinks."""

import gzip
import struct
import zlib

import pytest
from test_operators import aln

from cellspindle.operators import genes
from cellspindle.sources import binary, matrices, sinks, text


def put(path, content, packed=False):
    path.write_bytes(gzip.compress(content.encode()) if packed else content.encode())
    return str(path)


def test_fastq(spark, tmp_path):
    one = put(tmp_path / "a_1.fq.gz", "@r1/1 extra\nACGT\n+\nIIII\n@r2/1\nAC\n+r2\n@@\n", True)
    two = put(tmp_path / "a_2.fq", "@r1/2\nTT\n+\nFF\n@r2/2\nGG\n+\nFF\n")
    rows = binary.fastq(spark, [[one], [two]]).orderBy("record_no").collect()
    assert [tuple(r) for r in rows] == [(0, 0, "r1", "ACGT", "IIII", "TT", "FF"), (0, 1, "r2", "AC", "@@", "GG", "FF")]
    mixed = put(tmp_path / "m.fq", "@r|||CB:Z:A/1\nA\n+\nI\n@r|||CB:Z:A/2\nC\n+\nI\n")
    assert [tuple(r)[2:] for r in binary.fastq(spark, [[mixed]], interleaved=True).collect()] == [("r|||CB:Z:A", "A", "I", "C", "I")]
    fasta = put(tmp_path / "s.fa", ">x y\nAC\nGT\n>z\n\n")
    assert [tuple(r)[2:] for r in binary.fastq(spark, [[fasta]]).orderBy("record_no").collect()] == [("x", "ACGT", None), ("z", "", None)]
    assert binary.fastq(spark, [[put(tmp_path / "e.fq", "")]]).count() == 0


@pytest.mark.parametrize("content", ["@r1\nACGT\n+\nII\n", "@r1\nACGT\n", "ACGT\n", "@r9\nTT\n+\nFF\n"])
def test_broken_fastq(spark, tmp_path, content):
    good = put(tmp_path / "g.fq", "@r1\nTT\n+\nFF\n")
    with pytest.raises(Exception):
        binary.fastq(spark, [[good], [put(tmp_path / "b.fq", content)]]).collect()


def bgzf(data):
    out = b""
    for at in [*range(0, len(data), 50), None]:
        part = b"" if at is None else data[at : at + 50]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def record(name, flag, tid, pos, cigar, seq, qual, tags):
    ops = [(int(n) << 4) | "MIDNSHP=X".index(o) for n, o in cigar]
    packed = bytes(("=ACMGRSVTWYHKDBN".index(seq[i]) << 4) | ("=ACMGRSVTWYHKDBN".index(seq[i + 1]) if i + 1 < len(seq) else 0) for i in range(0, len(seq), 2))
    body = struct.pack("<iiBBHHHIiii", tid, pos, len(name) + 1, 60, 0, len(ops), flag, len(seq), tid, pos + 5, 7) + name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + qual + tags
    return struct.pack("<i", len(body)) + body


def test_bam(spark, tmp_path):
    tags = b"CBZACGT\0NHC\x05XSf" + struct.pack("<f", 1.5) + b"REAEXBBs" + struct.pack("<Ihh", 2, -1, 3) + b"XIi" + struct.pack("<i", -70000)
    head = b"BAM\1" + struct.pack("<i", 4) + b"@CO\n" + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    data = head + record("r1", 16, 0, 9, [(2, "S"), (3, "M")], "ACGTN", bytes([30] * 5), tags) + record("r2", 4, -1, -1, [], "", b"", b"")
    (tmp_path / "x.bam").write_bytes(bgzf(data))
    rows = {r.qname: r for r in binary.bam(spark, [str(tmp_path / "x.bam")]).collect()}
    r = rows["r1"]
    assert (r.flag, r.chrom, r.pos, r.mapq, r.cigar, r.rnext, r.pnext, r.tlen, r.seq, r.qual) == (16, "chr1", 10, 60, "2S3M", "=", 15, 7, "ACGTN", "?????")
    assert r.tags == {"CB": "ACGT", "NH": "5", "XS": "1.5", "RE": "E", "XB": "s,-1,3", "XI": "-70000"}
    assert (rows["r2"].chrom, rows["r2"].pos, rows["r2"].seq, rows["r2"].cigar) == (None, None, "*", None)


def test_text_formats(spark, tmp_path):
    bed = put(tmp_path / "a.bed", "#c\ntrack x\n\nc\t1\t5\nc\t2\t6\tn\t.\t-\r\nc\t9\t3\tbad\nc\t0\t0\nd\t1\t2\t*\t7\t.\n")
    assert sorted(tuple(map(str, r)) for r in text.bed(spark, bed).collect()) == [("c", "1", "5", "None", "None", "None"), ("c", "2", "6", "n", "None", "-"), ("d", "1", "2", "None", "7", "None")]
    gtf = put(tmp_path / "a.gtf", '#!x\nc\ts\texon\t10\t20\t.\t-\t.\tgene_id "G"; transcript_id "T"; gene_name "N";\nc\ts\tother\t1\t2\t.\t+\t.\tgene_id "G";\nc\ts\texon\t30\t40\t.\t?\t.\tgene_id H; gene "M"\n')
    got = {(r.gene_id, r.gene_name, r.transcript_id, r.strand) for r in text.gtf(spark, gtf).collect()}
    assert got == {("G", "N", "T", "-"), ("H", "M", None, "+")}
    vcf = put(tmp_path / "a.vcf", "##x\n#CHROM\nc\t5\t.\tA\tG,T\t.\t.\t.\tGT:PGT:PID\t0|1:0|1:b7\nc\t6\t.\tA\t.\t.\t.\t.\nc\t7\t.\tA\t<DEL>\t.\t.\t.\n")
    assert [tuple(r) for r in text.vcf(spark, vcf).collect()] == [("c", 5, ["A", "G", "T"], "b7")]
    fr = put(tmp_path / "f.tsv", "c\t1\t9\tAC\t3\nc\t2\t5\tAC\n")
    assert sorted(tuple(r) for r in text.fragments(spark, fr).collect()) == [("c", 1, 9, "AC", 3), ("c", 2, 5, "AC", 1)]
    bl = put(tmp_path / "b.txt", "#x\nBarcode\nAC grp1\n\nGT\n")
    assert [tuple(r) for r in text.barcode_list(spark, bl).collect()] == [("AC", "grp1"), ("GT", None)]
    assert [tuple(r) for r in text.species_map(spark, put(tmp_path / "s.txt", "c\thuman\n")).collect()] == [("c", "human")]
    with pytest.raises(Exception, match="given twice"):
        text.species_map(spark, put(tmp_path / "t.txt", "c\thuman\nc\tmouse\n")).collect()


def test_sam_round_trip(spark, tmp_path):
    df = aln(spark, {"qname": "a", "pos": 7, "tags": {"CB": "AC", "NH": "3"}}, {"qname": "b", "chrom": None, "pos": None, "cigar": None, "flag": 4})
    contigs = spark.createDataFrame([("c", 100)], "chrom string, length long")
    sinks.write_sam(df, str(tmp_path / "o"), contigs)
    lines = text.sam_lines(spark, str(tmp_path / "o")).withColumn("file_id", __import__("pyspark").sql.functions.lit("o"))
    assert [tuple(r) for r in text.contigs(lines).collect()] == [("c", 100)]
    back = {r.qname: r for r in text.alignments(lines).collect()}
    assert back["a"].pos == 7 and back["a"].tags == {"CB": "AC", "NH": "3"} and back["b"].chrom is None
    both = text.union_sources([df, df], ["x", "y"])
    assert both.groupBy("source").count().count() == 2


def test_matrix_round_trip(spark, tmp_path):
    m = spark.createDataFrame([("g2", "c1", 5, 1), ("g1", "c2", 3, 0), ("g1", "c1", 1, 1)], "feature string, cell string, n long, spliced long")
    matrices.write_matrix(m, str(tmp_path / "m"), ["n", "spliced"], ["matrix", "spliced"])
    parts = sorted((tmp_path / "m" / "matrix.mtx").glob("part*"))
    lines = "".join(gzip.decompress(p.read_bytes()).decode() for p in parts).splitlines()
    assert lines[2:] == ["2 2 3", "1 1 1", "1 2 3", "2 1 5"]
    got = {tuple(r) for r in matrices.read_matrix(spark, str(tmp_path / "m"), ["matrix", "spliced"]).collect()}
    assert got == {("g2", "c1", 5, 1), ("g1", "c2", 3, 0), ("g1", "c1", 1, 1)}
    assert {tuple(r) for r in matrices.dense(m, ["c1", "c2"]).collect()} == {("g1", 1, 3), ("g2", 5, 0)}


def test_sinks(spark, tmp_path):
    reads = spark.createDataFrame([("r", "AC", "II", "GT", "FF")], "name string, seq string, qual string, seq2 string, qual2 string")
    sinks.write_fastq(reads, str(tmp_path / "1"), str(tmp_path / "2"), compressed=False)
    sinks.write_fastq(reads, str(tmp_path / "3"), compressed=False)
    body = lambda n: "".join(p.read_text() for p in sorted((tmp_path / n).glob("part*")))
    assert (body("1"), body("2"), body("3")) == ("@r\nAC\n+\nII\n", "@r\nGT\n+\nFF\n", "@r\nAC\n+\nII\n@r\nGT\n+\nFF\n")
    bed = spark.createDataFrame([("c", 1, 2, None, "+", ["a", "b", "c", "d"], "exon"), ("c", 0, 2, "n", None, None, None)], "chrom string, start int, end int, name string, strand string, genes array<string>, type string")
    sinks.write_bed(bed, str(tmp_path / "b"))
    assert body("b") == "c\t0\t2\tn\t.\t.\t0\t.\t.\nc\t1\t2\t.\t.\t+\t4\ta,...,d\texon\n"
    feats = spark.createDataFrame([("c", "s", "exon", 10, 20, "-", "G", "N", "T")], "chrom string, source string, feature string, start int, end int, strand string, gene_id string, gene_name string, transcript_id string")
    sinks.write_gtf(feats, str(tmp_path / "g"))
    again = genes.normalised(text.gtf(spark, str(tmp_path / "g")))
    assert [r.feature for r in again.collect()] == ["gene", "transcript", "exon"]
    frags = spark.createDataFrame([("c", 5, 9, "A", 1), ("c", 1, 9, "A", 2)], "chrom string, start int, end int, barcode string, dup long")
    sinks.write_fragments(frags, str(tmp_path / "f"))
    assert text.fragments(spark, str(tmp_path / "f")).count() == 2
    sinks.write_table(frags, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).count() == 2
