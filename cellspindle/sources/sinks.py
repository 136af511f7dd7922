"""Text sinks. Each writes a folder of parts; order is kept where the format needs one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(df: DataFrame, path: str, compressed: bool = False) -> None:
    df.write.mode("overwrite").option("compression", "gzip" if compressed else "none").text(path)


def fastq_lines(df: DataFrame, mate: str = "") -> DataFrame:
    """One row per record: FASTQ, or FASTA where the quality is null."""
    s, q = f"seq{mate}", f"qual{mate}"
    return df.select(F.when(F.col(q).isNull(), F.concat(F.lit(">"), "name", F.lit("\n"), F.col(s))).otherwise(F.concat_ws("\n", F.concat(F.lit("@"), "name"), F.col(s), F.lit("+"), F.col(q))).alias("value"))


def write_fastq(df: DataFrame, path: str, second: str | None = None, compressed: bool = True) -> None:
    """Reads (name, seq, qual[, seq2, qual2]); second mates go to their own folder, or follow their first mates."""
    if second is None and "seq2" in df.columns:
        at = F.concat(F.lit("@"), "name")
        _text(df.select(F.concat_ws("\n", at, "seq", F.lit("+"), "qual", at, "seq2", F.lit("+"), "qual2").alias("value")), path, compressed)
        return
    _text(fastq_lines(df), path, compressed)
    if second:
        _text(fastq_lines(df, "2"), second, compressed)


def sam_text() -> Column:
    """The SAM text of an alignment row; tags of integer values are typed i, others Z."""
    entry = lambda e: F.concat(e["key"], F.when(e["value"].rlike(r"\A[-+]?[0-9]{1,9}\z"), ":i:").otherwise(":Z:"), e["value"])
    tags = F.transform(F.array_sort(F.map_entries(F.coalesce("tags", F.create_map().cast("map<string,string>")))), entry)
    missing = {"qname": "*", "flag": "0", "chrom": "*", "pos": "0", "mapq": "255", "cigar": "*", "rnext": "*", "pnext": "0", "tlen": "0", "seq": "*", "qual": "*"}
    return F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(m)) for c, m in missing.items()], tags)


def write_sam(df: DataFrame, path: str, contigs: DataFrame | None = None, compressed: bool = False) -> None:
    """SAM text, sorted by contig and position where contigs (chrom, length) are given for the header."""
    lines = df.select(sam_text().alias("value"))
    if contigs is not None:
        name = F.concat(F.lit("@SQ\tSN:"), "chrom", F.lit("\tLN:"), F.col("length").cast("string")).alias("value")
        head = contigs.select(F.lit(0).alias("k"), F.col("chrom").alias("c"), F.lit(0).alias("p"), name)
        body = df.select(F.lit(1).alias("k"), F.coalesce("chrom", F.lit("~")).alias("c"), F.coalesce("pos", F.lit(0)).alias("p"), sam_text().alias("value"))
        lines = head.unionByName(body).orderBy("k", "c", "p").select("value")
    _text(lines, path, compressed)


def bed_lines(df: DataFrame) -> DataFrame:
    """Six BED columns; with (genes, type) three more: how many genes, their names (long lists cut in the middle) and the type."""
    word = lambda c: F.coalesce(F.col(c), F.lit("."))
    core = ["chrom", F.col("start").cast("string"), F.col("end").cast("string"), word("name"), word("score") if "score" in df.columns else F.lit("."), word("strand")]
    if "genes" in df.columns:
        n = F.coalesce(F.size("genes"), F.lit(0))
        short = F.when(n > 3, F.concat(F.col("genes")[0], F.lit(",...,"), F.element_at("genes", -1))).when(n > 0, F.array_join("genes", ",")).otherwise(".")
        core += [F.greatest(n, F.lit(0)).cast("string"), short, word("type")]
    return df.select(F.concat_ws("\t", *core).alias("value"))


def write_bed(df: DataFrame, path: str, compressed: bool = False) -> None:
    _text(bed_lines(df.orderBy("chrom", "start", "end", "strand", "name")), path, compressed)


def write_gtf(features: DataFrame, path: str) -> None:
    """Normalised gene models: gene, transcript, parts."""
    from cellspindle.operators import genes

    attribute = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f'{c} "'), F.col(c), F.lit('";')))
    text = F.concat_ws("\t", "chrom", F.coalesce("source", F.lit(".")), "feature", F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("."), F.concat_ws(" ", attribute("gene_id"), attribute("transcript_id"), attribute("gene_name")))
    _text(genes.normalised(features).select(text.alias("value")), path)


def write_fragments(df: DataFrame, path: str) -> None:
    """Fragments sorted by chromosome, start, end and barcode."""
    rows = df.orderBy("chrom", "start", "end", "barcode").select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), "barcode", F.col("dup").cast("string")).alias("value"))
    _text(rows, path, True)


def write_table(df: DataFrame, path: str, separator: str = "\t", header: bool = True) -> None:
    """Tables and reports as separated text."""
    df.write.mode("overwrite").option("header", header).option("sep", separator).csv(path)
