"""Text sources: SAM, BED, GTF, VCF, fragments, lists and count matrices. All lazy; lines are split in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspindle.operators import genes, parse_lines


def _fields(spark: SparkSession, path: str | list[str], comment: str = r"\A\s*(?:#|\z)") -> DataFrame:
    lines = spark.read.text(path).withColumn("value", F.regexp_replace("value", r"\r\z", ""))
    return lines.where(~F.col("value").rlike(comment)).select(F.split("value", "\t", -1).alias("f"))


def sam_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file_id, str, line_id) of SAM text files, header lines included; line_id is unique, not dense."""
    return spark.read.text(path).select(F.input_file_name().alias("file_id"), F.col("value").alias("str"), F.monotonically_increasing_id().alias("line_id"))


def contigs(lines: DataFrame, text: str = "str") -> DataFrame:
    """(chrom, length) of the @SQ lines; a repeated name keeps its largest length."""
    sq = lines.where(F.col(text).startswith("@SQ\t"))
    return sq.select(F.regexp_extract(text, r"\tSN:([^\t\r]*)", 1).alias("chrom"), F.regexp_extract(text, r"\tLN:(\d+)", 1).cast("bigint").alias("length")).groupBy("chrom").agg(F.max("length").alias("length"))


def tag_map(fields: Column) -> Column:
    """Map of TAG:TYPE:VALUE columns; types are dropped, the first of repeated tags is kept."""
    named = F.transform(fields, lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, F.lit(6), F.length(t)).alias("value")))
    first = F.filter(named, lambda e, i: ~F.exists(F.slice(named, F.lit(1), i), lambda p: p["key"] == e["key"]))
    return F.map_from_entries(first)


def alignments(lines: DataFrame, line_id: str = "line_id", file_id: str = "file_id", text: str = "str") -> DataFrame:
    """Typed alignment rows of SAM lines; lines that fail to parse are left out (see ``parse_lines.failed_rows``).

    Tags kept in a read's name (`name|||CB:Z:..`) are moved into the tag map.
    """
    from cellspindle.functions import tags

    valid = parse_lines.valid_rows(parse_lines.check_lines(lines, line_id, file_id, text))
    inline = tags.name_tags(F.col("qname"))
    own = tag_map(F.col("tags"))
    return valid.select(
        F.col("line_id").alias("aln_id"),
        tags.read_id(F.col("qname")).alias("qname"),
        "flag",
        F.nullif(F.col("rname"), F.lit("*")).alias("chrom"),
        F.nullif(F.col("pos"), F.lit(0)).alias("pos"),
        "mapq",
        F.nullif(F.col("cigar"), F.lit("*")).alias("cigar"),
        "rnext",
        "pnext",
        "tlen",
        "seq",
        "qual",
        F.map_concat(F.map_filter(inline, lambda k, _: ~F.array_contains(F.map_keys(own), k)), own).alias("tags"),
        "file_id",
    )


def bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(chrom, start, end, name, score, strand) of BED files with three or more columns.

    `.` and `*` are no names, `.` no strand; comments, empty lines, track lines and rows without a valid interval are skipped.
    """
    f = _fields(spark, path, r"\A\s*(?:#|track\b|browser\b|\z)")
    word = lambda i: F.when(~F.get("f", F.lit(i)).isin("", ".", "*"), F.get("f", F.lit(i)))
    rows = f.select(
        F.col("f")[0].alias("chrom"),
        F.get("f", F.lit(1)).try_cast("int").alias("start"),
        F.get("f", F.lit(2)).try_cast("int").alias("end"),
        word(3).alias("name"),
        word(4).alias("score"),
        F.when(F.get("f", F.lit(5)).isin("+", "-"), F.get("f", F.lit(5))).alias("strand"),
    )
    return rows.where("start >= 0 and end > start")


def gtf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Feature rows of GTF files; features of other kinds are skipped, anything but `-` is the forward strand."""
    f = _fields(spark, path)
    attribute = lambda *names: F.nullif(F.coalesce(*[F.nullif(F.regexp_extract(F.get("f", F.lit(8)), rf'(?:\A|;)\s*{n}\s+"?([^";]*)"?', 1), F.lit("")) for n in names]), F.lit(""))
    return f.where(F.col("f")[2].isin(*genes.FEATURES)).select(
        F.col("f")[0].alias("chrom"),
        F.col("f")[1].alias("source"),
        F.col("f")[2].alias("feature"),
        F.col("f")[3].try_cast("int").alias("start"),
        F.col("f")[4].try_cast("int").alias("end"),
        F.when(F.col("f")[6] == "-", "-").otherwise("+").alias("strand"),
        attribute("gene_id").alias("gene_id"),
        attribute("gene_name", "gene").alias("gene_name"),
        attribute("transcript_id").alias("transcript_id"),
    )


def vcf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(chrom, pos, alleles, block) of VCF files; reference-only and symbolic records are skipped.

    ``block`` is the phase set (PID with PGT) of the first sample, null where there is none.
    """
    f = _fields(spark, path)
    keys, sample = F.split(F.get("f", F.lit(8)), ":"), F.split(F.get("f", F.lit(9)), ":")
    at = F.array_position(keys, F.lit("PID")).cast("int")
    return f.where(~F.col("f")[4].isin(".", "") & ~F.col("f")[4].rlike(r"\A<[^,]*>\z")).select(
        F.col("f")[0].alias("chrom"),
        F.col("f")[1].try_cast("int").alias("pos"),
        F.concat(F.array(F.col("f")[3]), F.split(F.col("f")[4], ",")).alias("alleles"),
        F.when(at > 0, F.nullif(F.get(sample, at - 1), F.lit("."))).alias("block"),
    )


def fragments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(chrom, start, end, barcode, dup) of fragment files; a missing fifth column counts as 1."""
    f = _fields(spark, path)
    i = lambda k: F.get("f", F.lit(k)).try_cast("int")
    return f.select(F.col("f")[0].alias("chrom"), i(1).alias("start"), i(2).alias("end"), F.get("f", F.lit(3)).alias("barcode"), F.coalesce(i(4), F.lit(1)).cast("bigint").alias("dup")).where("end > start")


def barcode_list(spark: SparkSession, path: str | list[str], keep_spaces: bool = False) -> DataFrame:
    """(barcode, grp): first column and, where there is one, the second; comments, blanks and a `Barcode` header are skipped."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"\A\s*(?:#|\z)"))
    f = lines.select(F.split("value", "\t" if keep_spaces else r"\s+").alias("f")) if keep_spaces else lines.select(F.split(F.btrim("value"), r"\s+").alias("f"))
    return f.select(F.col("f")[0].alias("barcode"), F.nullif(F.get("f", F.lit(1)), F.lit("")).alias("grp")).where("barcode != 'Barcode'")


def species_map(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(chrom, species); two species for one chromosome are an error when the map is used."""
    f = _fields(spark, path)
    pairs = f.select(F.col("f")[0].alias("chrom"), F.get("f", F.lit(1)).alias("species"))
    two = F.raise_error(F.concat(F.lit("chromosome given twice: "), F.col("chrom")))
    return pairs.groupBy("chrom").agg(F.min("species").alias("species"), F.count("*").alias("n")).select("chrom", F.when(F.col("n") == 1, F.col("species")).otherwise(two).alias("species"))


def union_sources(frames: Sequence[DataFrame], aliases: Sequence[str] | None = None) -> DataFrame:
    """Several alignment tables one after the other, with the alias of each in `source`."""
    named = [f.withColumn("source", F.lit(a)) for f, a in zip(frames, aliases or [str(i) for i in range(len(frames))], strict=True)]
    out = named[0]
    for f in named[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def in_regions(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Alignments over regions, once for each region that they overlap."""
    from cellspindle.functions import cigar
    from cellspindle.operators import intervals

    spans = df.where(F.col("pos").isNotNull()).withColumns({"_from": F.col("pos") - 1, "_to": cigar.end_position(F.col("pos"), F.col("cigar"))})
    r = regions.select(F.col("chrom").alias("_qc"), F.col("start").alias("_qs"), F.col("end").alias("_qe"))
    return intervals.overlap_join(spans, r, ("chrom", "_from", "_to"), ("_qc", "_qs", "_qe")).select(*df.columns)
