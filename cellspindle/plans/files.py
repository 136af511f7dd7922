"""Round trips through the file formats: a table is written to the shared folder and read back; the SQL sees the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspindle.operators import counting
from cellspindle.operators.filters import tag
from cellspindle.plans import genomics
from cellspindle.session import folder_files, shared_path, table
from cellspindle.sources import binary, matrices, sinks, text


def _lines(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").text(path)
    return path


def fastq_files(s: SparkSession, d: str) -> DataFrame:
    """Records with a quality as FASTQ, the others as FASTA."""
    whole = F.length("seq") == F.length("qual")
    reads = table(s, d, "read1").select(F.concat(F.lit("r"), "read_id").alias("name"), F.coalesce("seq", F.lit("")).alias("seq"), F.when(whole, F.col("qual")).alias("qual"))
    out = []
    for part in (reads.where("qual is not null"), reads.where("qual is null")):
        path = shared_path(s, "reads.fastq")
        sinks.write_fastq(part, path)
        out.append(binary.fastq(s, [folder_files(s, path)]).select("name", F.col("r1_seq").alias("seq"), F.col("r1_qual").alias("qual")))
    return out[0].unionByName(out[1])


def numbered(s: SparkSession, d: str) -> DataFrame:
    """Alignments that carry their number in a tag, since no format has a column for it."""
    number = F.create_map(F.lit("XN"), F.col("aln_id").cast("string"))
    return genomics.aln(s, d).withColumn("tags", F.map_concat(F.map_filter(F.coalesce("tags", F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull()), number))


def contig_table(s: SparkSession, d: str) -> DataFrame:
    return genomics.aln(s, d).where("chrom is not null").groupBy("chrom").agg((F.max("pos") + 100_000).cast("bigint").alias("length"))


def _read_back(a: DataFrame) -> DataFrame:
    return a.select(F.col("tags")["XN"].cast("bigint").alias("aln_id"), "qname", "flag", "chrom", "pos", "mapq", "cigar", "tlen", "seq", "qual", tag("CB").alias("cb"), tag("GN").alias("gn"))


def sam_files(s: SparkSession, d: str) -> DataFrame:
    path = shared_path(s, "alignments.sam")
    sinks.write_sam(numbered(s, d), path, contig_table(s, d))
    return _read_back(text.alignments(text.sam_lines(s, path).withColumn("file_id", F.lit("one"))))


def bam_files(s: SparkSession, d: str) -> DataFrame:
    path = shared_path(s, "alignments.bam")
    binary.write_bam(numbered(s, d), path, contig_table(s, d))
    return _read_back(binary.bam(s, folder_files(s, path)))


def bed_files(s: SparkSession, d: str) -> DataFrame:
    path = shared_path(s, "regions.bed")
    sinks.write_bed(genomics.regions(s, d), path)
    return text.bed(s, path).select("chrom", "start", "end", "name", "strand")


def gtf_files(s: SparkSession, d: str) -> DataFrame:
    path = shared_path(s, "models.gtf")
    sinks.write_gtf(genomics.models(s, d), path)
    return text.gtf(s, path)


def vcf_files(s: SparkSession, d: str) -> DataFrame:
    v = genomics.variants(s, d)
    record = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), F.col("alleles")[0], F.col("alleles")[1], F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT:PID"), F.concat(F.lit("0|1:"), "pos"))
    return text.vcf(s, _lines(v.select(record.alias("value")), shared_path(s, "variants.vcf"))).select("chrom", "pos", F.col("alleles")[0].alias("ref"), F.col("alleles")[1].alias("alt"), "block")


def fragment_files(s: SparkSession, d: str) -> DataFrame:
    path = shared_path(s, "fragments.tsv")
    sinks.write_fragments(genomics.frags(s, d), path)
    return text.fragments(s, path)


def list_files(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "barcodes").select(F.concat_ws("\t", "barcode", "grp").alias("value"))
    return text.barcode_list(s, _lines(rows.unionAll(s.createDataFrame([("Barcode",), ("# note",), ("",)], "value string")), shared_path(s, "barcodes.tsv")))


def matrix_files(s: SparkSession, d: str) -> DataFrame:
    path = shared_path(s, "matrix")
    matrices.write_matrix(counting.count_matrix(genomics.aln(s, d), umi=tag("UR")), path)
    return matrices.read_matrix(s, path).withColumnRenamed("matrix", "n")


QUERIES = {
    "files_fastq": fastq_files,
    "files_sam": sam_files,
    "files_bam": bam_files,
    "files_bed": bed_files,
    "files_gtf": gtf_files,
    "files_vcf": vcf_files,
    "files_fragments": fragment_files,
    "files_list": list_files,
    "files_matrix": matrix_files,
}

_ALIGNED = """select aln_id, qname, coalesce(flag, 0) as flag, chrom, pos, coalesce(mapq, 255) as mapq, nullif(cigar, '*') as cigar, coalesce(tlen, 0) as tlen, seq_ as seq,
  case when seq_ <> '*' and length(qual) = length(seq_) then qual else '*' end as qual, nullif(tags['CB'], '') as cb, nullif(tags['GN'], '') as gn
from (select *, case when coalesce(seq, '') = '' then '*' else upper(seq) end as seq_ from alignments)"""

SQL = {
    "files_fastq": "select 'r' || read_id as name, coalesce(seq, '') as seq, case when length(seq) = length(qual) then qual end as qual from read1",
    "files_sam": _ALIGNED,
    "files_bam": _ALIGNED,
    "files_bed": f"with {genomics._REGIONS} select chrom, s as start, e as \"end\", case when name not in ('.', '*') then name end as name, case when strand in ('+', '-') then strand end as strand from regions",
    "files_gtf": f"""with {genomics._PART}, f as (select chrom, k, strand, 'gene' as feature, b as s, b + z * 2000 - 1 as e from gene union all select chrom, k, strand, 'transcript', b, b + z * 2000 - 1 from gene
union all select chrom, k, strand, 'exon', s, e from exon union all select x.chrom, x.k, x.strand, 'CDS', s, e from exon x join gene g on g.k = x.k where coding and i in (1, 2))
select chrom, 'part' as source, feature, s as start, e as "end", strand, 'G' || k as gene_id, 'N' || k as gene_name, case when feature <> 'gene' then 'T' || k end as transcript_id from f""",
    "files_vcf": """select chrom, pos, alleles[1] as ref, alleles[2] as alt, cast(pos as varchar) as block
from (select chrom, pos, min([b, translate(b, 'ACGTN', 'CATGA')]) as alleles from (select chrom, pos + 9 as pos, substr(seq, 10, 1) as b from alignments where chrom is not null and pos is not null and length(seq) >= 10) group by 1, 2)""",
    "files_fragments": genomics._FRAGS + 'select chrom, start, "end", barcode, dup from frags',
    "files_list": "select barcode, nullif(grp, '') as grp from barcodes",
    "files_matrix": genomics.SQL["count_matrix"],
}
