"""Queries of the sequencing operators over the test tables, and their SQL.

Gene models are derived from `part` in the same way on both sides: one gene, transcript and four exons per row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspindle.functions import cigar, seq, tags
from cellspindle.operators import coverage, counting, filters, genes, intervals, molecules, read_structure, whitelist
from cellspindle.operators.filters import tag
from cellspindle.plans import problems
from cellspindle.session import table
from cellspindle.sources import text
from cellspindle.streaming import blocks


def aln(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "alignments")


def regions(s: SparkSession, d: str) -> DataFrame:
    """The valid rows of `bed` as regions."""
    b = table(s, d, "bed").where("chrom is not null and bed_start >= 0 and bed_end > bed_start")
    strand = F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise(F.lit("."))
    return b.select("track", "chrom", F.col("bed_start").alias("start"), F.col("bed_end").alias("end"), F.nullif(F.nullif("name", F.lit(".")), F.lit("")).alias("name"), strand.alias("strand"))


def models(s: SparkSession, d: str) -> DataFrame:
    """Gene model features derived from `part`."""
    p = table(s, d, "part").select(
        F.concat(F.lit("chr"), (F.col("p_partkey") % 22 + 1).cast("string")).alias("chrom"),
        (F.col("p_partkey") * 104729 % 240000000 + 1).cast("int").alias("b"),
        F.col("p_size").alias("z"),
        F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        F.col("p_partkey").cast("string").alias("k"),
        (F.col("p_partkey") % 3 == 0).alias("coding"),
    )
    record = lambda feature, lo, hi: F.struct(F.lit(feature).alias("feature"), lo.cast("int").alias("start"), hi.cast("int").alias("end"))
    b, z = F.col("b"), F.col("z")
    exon = lambda i, f: record(f, b + i * z * 500, b + i * z * 500 + z * 250 - 1)
    parts = F.array(record("gene", b, b + z * 2000 - 1), record("transcript", b, b + z * 2000 - 1), *[exon(i, "exon") for i in range(4)])
    coded = F.when(F.col("coding"), F.array(exon(1, "CDS"), exon(2, "CDS"))).otherwise(F.array().cast("array<struct<feature:string,start:int,end:int>>"))
    rows = p.select("chrom", "strand", "k", F.inline(F.concat(parts, coded)))
    return rows.select(
        "chrom",
        F.lit("part").alias("source"),
        "feature",
        "start",
        "end",
        "strand",
        F.concat(F.lit("G"), "k").alias("gene_id"),
        F.concat(F.lit("N"), "k").alias("gene_name"),
        F.when(F.col("feature") != "gene", F.concat(F.lit("T"), "k")).alias("transcript_id"),
    )


def wide(s: SparkSession, d: str) -> DataFrame:
    """Regions of the first track of each file, widened so that reads meet them."""
    return intervals.expand(regions(s, d), 5000, 5000, False)


def spans(s: SparkSession, d: str) -> DataFrame:
    a = aln(s, d).where("chrom is not null and pos is not null and cigar is not null")
    return a.select("aln_id", F.col("chrom").alias("c"), (F.col("pos") - 1).alias("s"), cigar.end_position(F.col("pos"), F.col("cigar")).alias("e"))


def overlaps(s: SparkSession, d: str, how: str) -> DataFrame:
    left = spans(s, d)
    hit = intervals.overlap_join(left, wide(s, d), ("c", "s", "e"), ("chrom", "start", "end"), how, counted=left)
    return hit.select("aln_id", "track", "start", "end", "strand", "name") if how == "inner" else hit.select("aln_id")


def frags(s: SparkSession, d: str) -> DataFrame:
    return coverage.fragments(aln(s, d), 20)


def raw_reads(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "read1").select("name", F.col("seq").alias("r1_seq"), F.col("qual").alias("r1_qual"))


def barcoded_reads(s: SparkSession, d: str) -> DataFrame:
    """Raw reads rebuilt from the alignments: the cell barcode as it was read, if any, in front of the sequence."""
    cb = F.coalesce(tag("CB"), F.lit(""))
    return aln(s, d).select(F.col("qname").alias("name"), F.concat(cb, "seq").alias("r1_seq"), F.concat(F.repeat(F.lit("F"), F.length(cb)), "qual").alias("r1_qual"))


def bed_types(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "bed").where("chrom is not null and bed_start >= 0 and bed_end > bed_start")
    return genes.annotate_bed(r.select("bed_id", "chrom", F.col("bed_start").alias("start"), F.col("bed_end").alias("end"), "strand"), models(s, d), key="bed_id")


def longest_read(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.loc[[pdf["seq"].str.len().idxmax()]]


def known(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "barcodes")


def cell_values(s: SparkSession, d: str) -> DataFrame:
    return aln(s, d).select(tag("CB").alias("query"))


def mates(s: SparkSession, d: str) -> DataFrame:
    binding = table(s, d, "bed").where("chrom is not null").groupBy("chrom").agg(F.when(F.length("chrom") > 4, "specb").otherwise("speca").alias("species"))
    return filters.species(aln(s, d), binding).select("aln_id", F.col("tags")["SP"].alias("sp"))


def variants(s: SparkSession, d: str) -> DataFrame:
    """Single-base variants derived from the reads: the tenth base of a read at its tenth position, and another base."""
    base = F.substring("seq", 10, 1)
    rows = aln(s, d).where("chrom is not null and pos is not null and length(seq) >= 10")
    rows = rows.select("chrom", (F.col("pos") + 9).alias("pos"), F.array(base, F.translate(base, "ACGTN", "CATGA")).alias("alleles"))
    return rows.groupBy("chrom", "pos").agg(F.min("alleles").alias("alleles"))


def flat_exons(s: SparkSession, d: str) -> DataFrame:
    return genes.flattened_exons(models(s, d))


QUERIES = {
    "count_matrix": lambda s, d: counting.count_matrix(aln(s, d), umi=tag("UR")),
    "count_reads": lambda s, d: counting.count_matrix(aln(s, d)),
    "count_one_hit": lambda s, d: counting.count_matrix(aln(s, d), umi=tag("UR"), one_hit=True),
    "count_exonic": lambda s, d: counting.count_matrix(aln(s, d), umi=tag("UR"), types="ES", listed=known(s, d), keep_duplicates=True),
    "count_chromosomes": lambda s, d: counting.count_matrix(aln(s, d).where("chrom is not null"), features=F.array(filters.genome_bin(0))),
    "count_grid": lambda s, d: counting.count_matrix(aln(s, d).where("pos is not null"), cell=filters.spatial_bin(F.col("pos"), F.col("tlen"), 1_000_000)),
    "velocity": lambda s, d: counting.velocity_matrix(aln(s, d)),
    "attributes": lambda s, d: counting.attributes(aln(s, d), ["UR", "GN"]),
    "attributes_distinct": lambda s, d: counting.attributes(aln(s, d), ["UR", "GN"], distinct=True),
    "attributes_groups": lambda s, d: counting.attributes(aln(s, d), ["UR", "GN"], groups=("RE", ["E", "N"])),
    "attributes_listed": lambda s, d: counting.attributes(aln(s, d), ["UR", "GN"], every=True, listed=known(s, d)),
    "bin_counts": lambda s, d: counting.bin_matrix(aln(s, d), [1_000_000, 50_000_000], stranded=True),
    "bin_totals": lambda s, d: counting.bin_totals(counting.bin_matrix(aln(s, d), [1_000_000, 50_000_000])),
    "barcode_distribution": lambda s, d: counting.barcode_distribution(aln(s, d)),
    "read_report": lambda s, d: counting.read_report(aln(s, d)),
    "annotation_report": lambda s, d: counting.annotation_report(aln(s, d), F.col("chrom")),
    "rmdup": lambda s, d: molecules.remove_duplicates(aln(s, d)).select("aln_id", "chrom", "pos", "flag"),
    "rmdup_mark": lambda s, d: molecules.mark_duplicates(aln(s, d)).select("aln_id", "flag"),
    "umi_clusters": lambda s, d: molecules.umi_clusters(aln(s, d), ["GN"]),
    "umi_correct": lambda s, d: molecules.correct_umis(aln(s, d), ["GN"]).select("aln_id", F.col("tags")["UB"].alias("ub")),
    "umi_one_gene": lambda s, d: molecules.one_gene_per_umi(molecules.umi_clusters(aln(s, d))),
    "fusion_pairs": lambda s, d: molecules.fusion_candidates(aln(s, d).withColumn("tags", F.map_concat(F.map_filter("tags", lambda k, _: k != "UR"), F.create_map(F.lit("UR"), F.substring(tag("UR"), 1, 3)))), most=4),
    "fusion_molecules": lambda s, d: molecules.fusion_candidates(aln(s, d)),
    "sort_reads": lambda s, d: molecules.sort_reads(aln(s, d), ["CB", "UR"], known(s, d)).select("aln_id"),
    "pick": lambda s, d: filters.pick(aln(s, d), ["CB", "GN"], known(s, d).select("barcode"), 20).select("aln_id"),
    "extract": lambda s, d: filters.extract(aln(s, d), ["CB", "UR", "GN"], with_name=True),
    "mean_quality": lambda s, d: filters.base_quality(aln(s, d), 30.0, 2, 15, 20.0).select("aln_id"),
    "to_reads": lambda s, d: filters.to_reads(aln(s, d), ["CB", "UR"], every=True),
    "add_tags": lambda s, d: filters.add_tags(aln(s, d), {"LB": "lib1", "RE": "Z"}).select("aln_id", F.col("tags")["LB"].alias("lb"), F.col("tags")["RE"].alias("re"), F.col("tags")["CB"].alias("cb")),
    "species": mates,
    "hex_bases": lambda s, d: aln(s, d).select("aln_id", seq.bases_from_hex(F.hex("aln_id")).alias("bases")),
    "name_tags": lambda s, d: table(s, d, "read1").select("read_id", tags.read_id(F.col("name")).alias("id"), tags.name_tags(F.col("name"))["SR"].alias("sr")),
    "parse_rules": lambda s, d: read_structure.apply_segments(raw_reads(s, d), read_structure.parse_rules("CR,R1:1-8;CR,R1:9-16;UR,R1:17-26;R1,R1:27-"), lambda n: None, drop_n=True),
    "parse_listed": lambda s, d: read_structure.apply_segments(
        raw_reads(s, d), read_structure.parse_rules("CR,R1:1-5,cells,CB,1;R1,R1:6-30"), lambda n: known(s, d).select(F.substring("barcode", 1, 5).alias("b"))
    ),
    "parse_barcodes": lambda s, d: read_structure.apply_segments(barcoded_reads(s, d), read_structure.parse_rules("CR,R1:1-20,cells,CB,1;R1,R1:21-"), lambda n: known(s, d).select("barcode")),
    "whitelist_exact": lambda s, d: whitelist.exact(cell_values(s, d).distinct(), known(s, d)),
    "whitelist_mismatch": lambda s, d: whitelist.one_mismatch(cell_values(s, d), known(s, d)),
    "whitelist_edit": lambda s, d: whitelist.edit_distance(cell_values(s, d), known(s, d), 2, "levenshtein"),
    "whitelist_edit_short": lambda s, d: whitelist.edit_distance(cell_values(s, d).select(F.substring("query", 1, 10).alias("query")), known(s, d).select(F.substring("barcode", 1, 10).alias("b")), 1, "levenshtein"),
    "bed_merge": lambda s, d: intervals.merge(regions(s, d)).select("chrom", "start", "end", "strand"),
    "bed_merge_gap": lambda s, d: intervals.merge(regions(s, d), stranded=False, gap=500, min_length=300).select("chrom", "start", "end", "strand"),
    "bed_merge_name": lambda s, d: intervals.merge(regions(s, d), by_name=True),
    "bed_expand": lambda s, d: intervals.expand(regions(s, d), 100, 200),
    "bed_flatten": lambda s, d: intervals.flatten(regions(s, d).withColumn("name", F.col("track"))),
    "bed_distinct": lambda s, d: intervals.distinct_regions(regions(s, d)),
    "overlap_join": lambda s, d: overlaps(s, d, "inner"),
    "overlap_semi": lambda s, d: overlaps(s, d, "semi"),
    "overlap_anti": lambda s, d: overlaps(s, d, "anti"),
    "fragments": frags,
    "cut_sites": lambda s, d: coverage.cut_sites(frags(s, d)),
    "peak_matrix": lambda s, d: coverage.peak_matrix(frags(s, d), wide(s, d)),
    "depth": lambda s, d: coverage.depth(aln(s, d)).drop("cell"),
    "depth_cells": lambda s, d: coverage.depth(aln(s, d), cell=tag("CB"), umi=tag("UR"), stranded=False, groups=known(s, d)),
    "covered_bases": lambda s, d: coverage.covered_bases(aln(s, d)),
    "peaks": lambda s, d: coverage.call_peaks(aln(s, d), cutoff=0, gap=50, min_length=70).drop("name"),
    "peaks_deep": lambda s, d: coverage.call_peaks(aln(s, d)).drop("name"),
    "gene_regions": lambda s, d: genes.to_regions(models(s, d), "gene"),
    "exon_regions": lambda s, d: genes.to_regions(models(s, d), "exon", "transcript"),
    "gene_summary": lambda s, d: genes.summary(models(s, d)),
    "annotate_genes": lambda s, d: genes.annotate_reads(aln(s, d), models(s, d), introns=True).select("aln_id", "re", F.array_join("gn", ";").alias("gn")),
    "annotate_regions": lambda s, d: genes.annotate_regions(aln(s, d), intervals.expand(regions(s, d).where("name is not null"), 5000, 5000, False)),
    "annotate_bed": lambda s, d: bed_types(s, d).select("bed_id", "type"),
    "annotate_variants": lambda s, d: genes.variants_on_reads(aln(s, d), variants(s, d), with_reference=True),
    "annotate_exon_bins": lambda s, d: genes.annotate_regions(aln(s, d), flat_exons(s, d)),
    "gene_records": lambda s, d: genes.normalised(models(s, d).where("feature in ('exon', 'CDS')")),
    "region_types": lambda s, d: genes.type_report(bed_types(s, d), table(s, d, "bed").select("bed_id", F.col("bed_start").alias("start"), F.col("bed_end").alias("end")), "bed_id"),
    "reads_in_regions": lambda s, d: text.in_regions(aln(s, d), wide(s, d)).select("aln_id", "chrom", "pos"),
    "depth_in_regions": lambda s, d: coverage.depth_in_regions(coverage.depth(aln(s, d)), regions(s, d)).drop("cell"),
    "rescue": lambda s, d: genes.rescue_multimappers(aln(s, d), genes.read_types(aln(s, d), models(s, d))).select("aln_id", "flag", "mapq"),
    "contigs": lambda s, d: text.contigs(table(s, d, "sam_pool")),
    "sam_alignments": lambda s, d: text.alignments(table(s, d, "sam_pool")).select("aln_id", "qname", "chrom", "pos", F.col("tags")["CB"].alias("cb"), F.col("tags")["GN"].alias("gn")),
    "block_function": lambda s, d: blocks.apply_to_blocks(table(s, d, "read1").where("seq is not null"), ["SR"], longest_read),
    "running_counts": lambda s, d: blocks.running_counts(aln(s, d)),
}

_T = {t: f"nullif(tags['{t}'], '')" for t in ("CB", "UR", "GN", "RE")}
_PARTS = "list_distinct(list_filter(regexp_split_to_array({}, '[;,]'), lambda v: v <> ''))"
_STRAND = "case when ((coalesce(flag, 0) & 16) <> 0) <> ((coalesce(flag, 0) & 128) <> 0) then '-' else '+' end"


def _reads(mask: int, mapq: int, extra: str = "") -> str:
    return f"alignments where coalesce(flag, 0) & {mask} = 0 and coalesce(mapq, 0) >= {mapq} {extra}"


def _features(mask: int = 1028, extra: str = "", features: str | None = None, cell: str | None = None) -> str:
    return f"""
with r as (select {cell or _T["CB"]} as cell, {_T["UR"]} as umi, {_T["RE"]} as re, {features or _PARTS.format(_T["GN"])} as fs from {_reads(mask, 20, extra)}),
f as (select cell, umi, re, fs, unnest(fs) as feature from r where cell is not null)
"""


def _cigar(source: str) -> str:
    """Blocks (split at N) and covered ranges (split at N and D) of the rows of ``source``."""
    return f"""
base as ({source}),
ops as (select aln_id, i, cast(left(x, length(x) - 1) as int) as n, right(x, 1) as op
  from (select aln_id, unnest(l) as x, generate_subscripts(l, 1) as i from (select aln_id, regexp_extract_all(cigar, '[0-9]+[MIDNSHPX=]') as l from base))),
placed as (select *, coalesce(sum(case when op in ('M', 'D', 'N', '=', 'X') then n else 0 end) over (partition by aln_id order by i rows between unbounded preceding and 1 preceding), 0) as off,
  sum(case when op = 'N' then 1 else 0 end) over (partition by aln_id order by i rows unbounded preceding) as blk,
  sum(case when op in ('N', 'D') then 1 else 0 end) over (partition by aln_id order by i rows unbounded preceding) as rng from ops),
reflen as (select aln_id, sum(case when op in ('M', 'D', 'N', '=', 'X') then n else 0 end) as len from placed group by 1),
blocks as (select b.aln_id, chrom, strand, pos + o as lo, pos + h - 1 as hi, row_number() over (partition by b.aln_id order by o) as k, count(*) over (partition by b.aln_id) as nb
  from (select aln_id, blk, min(off) as o, max(off + n) as h from placed where op in ('M', 'D', '=', 'X') group by 1, 2) p join base b using (aln_id)),
covered as (select b.*, pos + o - 1 as s, pos + h - 1 as e from (select aln_id, rng, min(off) as o, max(off + n) as h from placed where op in ('M', '=', 'X') group by 1, 2) p join base b using (aln_id))
"""


def _levels(source: str, keys: str, flat: bool = False) -> str:
    """Runs (lo, hi, level) of the ranges [s, e) of ``source``."""
    return f"""
select {keys}, pos as lo, nxt as hi, level from (
  select {keys}, pos, lead(pos) over (partition by {keys} order by pos) as nxt, sum(d) over (partition by {keys} order by pos rows unbounded preceding) as level
  from (select {keys}, pos, sum(d) as d from (select {keys}, s as pos, 1 as d from {source} union all select {keys}, e, -1 from {source}) group by {keys}, pos {"" if flat else "having sum(d) <> 0"})
) where nxt is not null and level > 0
"""


def _islands(source: str, keys: str, gap: int = 0) -> str:
    return f"""
select {keys}, min(s) as s, max(e) as e from (
  select *, sum(case when so_far is null or s > so_far + {gap} then 1 else 0 end) over (partition by {keys} order by s, e rows unbounded preceding) as g
  from (select *, max(e) over (partition by {keys} order by s, e rows between unbounded preceding and 1 preceding) as so_far from (select distinct {keys}, s, e from {source}))
) group by {keys}, g
"""


_DEPTH = f"select aln_id, chrom, pos, cigar, {_STRAND} as strand, {_T['CB']} as cb, {_T['UR']} as umi from {_reads(1796, 20, 'and chrom is not null and pos is not null')}"
_REGIONS = """regions as (select track, chrom, bed_start as s, bed_end as e, nullif(nullif(name, '.'), '') as name, case when strand in ('+', '-') then strand else '.' end as strand
  from bed where chrom is not null and bed_start >= 0 and bed_end > bed_start)"""
_WIDE = "wide as (select track, chrom, greatest(s - 5000, 0) as s, e + 5000 as e, name, strand from regions)"
_SPANS = "select aln_id, chrom, pos, cigar, '.' as strand from alignments where chrom is not null and pos is not null and cigar is not null"
_SPAN_ROWS = "spans as (select aln_id, chrom, pos - 1 as s, pos - 1 + coalesce(len, 0) as e from base left join reflen using (aln_id))"
_PART = """gene as (select 'chr' || cast(p_partkey % 22 + 1 as varchar) as chrom, cast(p_partkey * 104729 % 240000000 + 1 as int) as b, p_size as z, case when p_partkey % 2 = 0 then '+' else '-' end as strand,
  cast(p_partkey as varchar) as k, p_partkey % 3 = 0 as coding from part),
exon as (select chrom, strand, k, i, b + i * z * 500 as s, b + i * z * 500 + z * 250 - 1 as e from gene, (select unnest(range(4)) as i))"""
_KNOWN = "select distinct barcode as entry from barcodes where barcode <> ''"
_HEX = "strpos('0123456789ABCDEF', c) - 1"

_FRAGS = f"""
with {_cigar(f"select aln_id, chrom, pos, cigar, '.' as strand, coalesce(tlen, 0) as size, {_T['CB']} as barcode from " + _reads(2436, 20, f"and chrom is not null and pos is not null and {_T['CB']} is not null"))},
sp as (select chrom, barcode, size, pos - 1 as s, case when cigar is null then null else pos - 1 + coalesce(len, 0) end as e from base left join reflen using (aln_id)),
fr as (select chrom, barcode, greatest(case when size > 0 then s + 4 when size < 0 then e + size + 4 else s end, 0) as start, case when size > 0 then s + size - 5 when size < 0 then e - 5 else e end as "end" from sp),
frags as (select chrom, start, "end", barcode, count(*) as dup from fr where start < "end" group by all)
"""



def _clusters(block: str) -> str:
    return f"""
with recursive counts as (
  select gn, umi, count(*) as n from (select {block} as gn, {_T["UR"]} as umi from {_reads(3844, 0)}) where gn is not null and umi is not null group by 1, 2
), masks as (
  select gn, umi, i, substr(umi, 1, i - 1) || '_' || substr(umi, i + 1) as m from (select gn, umi, unnest(range(1, length(umi) + 1)) as i from counts)
), edges as (
  select distinct a.gn, a.umi as u, b.umi as v from masks a join masks b on a.gn = b.gn and a.i = b.i and a.m = b.m
), reach(gn, u, v) as (
  select gn, u, v from edges union select r.gn, r.u, e.v from reach r join edges e on r.gn = e.gn and r.v = e.u
), best as (
  select gn, u, v, row_number() over (partition by gn, u order by n desc, v) as k from (select r.gn, r.u, r.v, c.n from reach r join counts c on c.gn = r.gn and c.umi = r.v)
), clusters as (
  select c.gn, c.umi, c.n, b.v as corrected from counts c join best b on b.gn = c.gn and b.u = c.umi and b.k = 1
)
"""


_BED_TYPES = f"""
with {_PART}, r as (select bed_id, chrom, bed_start as s, bed_end as e, strand from bed where chrom is not null and bed_start >= 0 and bed_end > bed_start),
near as (select r.*, g.k, g.strand as gstrand, g.coding, b - 1 as gs, b - 1 + z * 2000 as ge, coalesce(r.strand in ('+', '-') and r.strand <> g.strand, false) as other
  from r join gene g on r.chrom = g.chrom and r.s < b - 1 + z * 2000 + 1000 and r.e > greatest(b - 1001, 0)),
met as (select n.bed_id, n.k, count(*) filter (x.s <= n.e and x.e > n.s) as n_met, bool_or(x.s <= n.s + 1 and x.e >= n.e) as held,
    count(*) filter (n.coding and x.i in (1, 2) and x.s <= n.e and x.e > n.s) as n_cds, coalesce(bool_or(n.coding and x.i in (1, 2) and x.e <= n.s), false) as passed
  from near n join exon x on x.chrom = n.chrom and x.k = n.k group by 1, 2),
plain as (select n.*, case when n.s <= gs and n.e >= ge then 'whole_gene' when n.s >= gs and n.e <= ge then
    case when n_met > 1 then 'multiexons' when n_met = 0 then 'intron' when not held then 'exonintron' when coding and n_cds = 0 then case when passed = (gstrand <> '-') then 'utr3' else 'utr5' end else 'exon' end
    when case when n.s < gs then gs - n.e else n.s - ge end < 1000 then case when (n.s < gs) = (gstrand <> '-') then 'upstream' else 'downstream' end end as t
  from near n join met m on m.bed_id = n.bed_id and m.k = n.k),
typed as (select bed_id, k, case when not other then t when t in ('exon', 'utr3', 'utr5', 'intron', 'upstream', 'downstream') then 'antisense_' || t else 'antisense_complex' end as t from plain where t is not null),
ranked as (select *, list_position({genes.BED_TYPES}, t) as rank from typed),
best as (select *, min(rank) over (partition by bed_id) as best from ranked),
done as (select bed_id, case when count(distinct k) > 1 and any_value(best) <= 10 then 'multigenes' else ({genes.BED_TYPES})[any_value(best)] end as type from best where rank = best or best <= 10 group by 1),
types as (select r.bed_id, coalesce(type, 'intergenic') as type, r.e - r.s as bases from r left join done d on d.bed_id = r.bed_id)
"""
_CLUSTERS = _clusters(_T["GN"])
_MASKED = """
wm as (select entry, substr(entry, 1, i - 1) || 'N' || substr(entry, i + 1) as m from (select entry, unnest(range(1, length(entry) + 1)) as i from w)),
u as (select m, min(entry) as entry from wm group by 1 having count(*) = 1),
qm as (select query, i, substr(query, 1, i - 1) || 'N' || substr(query, i + 1) as m from (select query, unnest(range(1, length(query) + 1)) as i from q where query not in (select entry from w))),
near as (select query, query as entry, true as exact from q where query in (select entry from w) union all select query, arg_min(entry, i), false from qm join u using (m) group by 1)
"""

SQL = {
    "count_matrix": _features() + "select feature, cell, count(distinct umi) as n from f where umi is not null group by 1, 2",
    "count_reads": _features() + "select feature, cell, count(*) as n from f group by 1, 2",
    "count_one_hit": _features() + "select feature, cell, count(distinct umi) as n from f where umi is not null and len(fs) = 1 group by 1, 2",
    "count_exonic": _features(4) + "select feature, cell, count(distinct umi) as n from f where umi is not null and re in ('E', 'S') and cell in (select barcode from barcodes) group by 1, 2",
    "count_chromosomes": _features(extra="and chrom is not null", features=f"[chrom || '/' || {_STRAND}]") + "select feature, cell, count(*) as n from f group by 1, 2",
    "count_grid": _features(extra="and pos is not null", cell="cast(floor(pos / 1000000.0) * 1000000 as bigint)::varchar || chr(9) || cast(floor(tlen / 1000000.0) * 1000000 as bigint)::varchar")
    + "select feature, cell, count(*) as n from f group by 1, 2",
    "velocity": _features()
    + """select feature, cell, count(distinct umi) as total, count(distinct umi) - count(distinct umi) filter (re in ('N', 'C')) as spliced,
  count(distinct umi) filter (re in ('N', 'C')) as unspliced, count(distinct umi) filter (re = 'C') as spanning
from f where umi is not null and coalesce(re, 'U') not in ('U', 'V', 'I') group by 1, 2""",
    "attributes": f"select {_T['CB']} as barcode, count(*) as \"Raw\", count({_T['UR']}) as \"UR\", count({_T['GN']}) as \"GN\" from {_reads(256, 0)} and {_T['CB']} is not null group by 1",
    "attributes_distinct": f"select {_T['CB']} as barcode, count(*) as \"Raw\", count(distinct {_T['UR']}) as \"UR\", count(distinct {_T['GN']}) as \"GN\" from {_reads(256, 0)} and {_T['CB']} is not null group by 1",
    "attributes_groups": f"""select {_T["CB"]} as barcode, count(*) as "Raw", {", ".join(f"count({_T[n]}) filter ({_T['RE']} = '{v}') as \"{v}_{n}\"" for v in "EN" for n in ("UR", "GN"))}
from {_reads(256, 0)} and {_T["CB"]} is not null group by 1""",
    "attributes_listed": f"""select b.barcode, coalesce("Raw", 0) as "Raw", coalesce("UR", 0) as "UR", coalesce("GN", 0) as "GN" from (select distinct barcode from barcodes) b left join
(select {_T["CB"]} as barcode, count(*) as "Raw", count(*) as "UR", count(*) as "GN" from {_reads(256, 0)} and {_T["UR"]} is not null and {_T["GN"]} is not null group by 1) a on a.barcode = b.barcode""",
    "bin_counts": f"""select size, chrom || ':' || cast((pos - 1) // size as varchar) || '/' || {_STRAND} as feature, {_T["CB"]} as cell, count(*) as n
from (select *, unnest([1000000, 50000000]) as size from {_reads(1796, 10)} and pos is not null) where {_T["CB"]} is not null group by all""",
    "bin_totals": f"select size, {_T['CB']} as cell, count(*) as n from (select *, unnest([1000000, 50000000]) as size from {_reads(1796, 10)} and pos is not null) where {_T['CB']} is not null group by all",
    "barcode_distribution": f"select {_T['CB']} as barcode, count(*) as n from alignments where {_T['CB']} is not null group by 1",
    "read_report": f"""select unnest(['records', 'reads', 'mapped', 'reverse', 'secondary', 'failed_quality', 'with_barcode', 'annotated']) as metric, unnest([a, b, c, e, f, g, h, i]) as value from (
select count(*) as a, count(*) filter (fl & 2304 = 0) as b, count(*) filter (fl & 2308 = 0) as c, count(*) filter (fl & 2308 = 0 and fl & 16 <> 0) as e,
  count(*) filter (fl & 256 <> 0) as f, count(*) filter (fl & 512 <> 0) as g, count({_T["CB"]}) as h, count({_T["GN"]}) as i from (select *, coalesce(flag, 0) as fl from alignments))""",
    "annotation_report": f"select chrom as \"group\", {_T['RE']} as re, count(*) as n from alignments group by 1, 2",
    "rmdup": f"""
with r as (select *, {_T["CB"]} as cb, {_T["UR"]} as ur, case when coalesce(qual, '*') in ('*', '') then 0 else list_sum(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)) end as q from {_reads(2816, 0)})
select aln_id, chrom, pos, flag from (select *, row_number() over (partition by chrom, pos, cb, ur order by q desc, aln_id) as k from r where coalesce(flag, 0) & 4 = 0 and chrom is not null and pos is not null and cb is not null and ur is not null) where k = 1
union all select aln_id, chrom, pos, flag from r where coalesce(flag, 0) & 4 <> 0""",
    "umi_clusters": _CLUSTERS + "select gn, umi, n, corrected from clusters",
    "umi_correct": _CLUSTERS
    + f"""select aln_id, corrected as ub from alignments a left join clusters c on nullif(a.tags['GN'], '') = c.gn and nullif(a.tags['UR'], '') = c.umi and coalesce(a.flag, 0) & 3844 = 0""",
    "umi_one_gene": _clusters(f"{_T['CB']} || '|' || {_T['GN']}")
    + """, s as (select split_part(gn, '|', 1) as cb, split_part(gn, '|', 2) as gn, corrected, sum(n) as n from clusters group by 1, 2, 3),
r as (select *, max(n) over (partition by cb, corrected) as top from s), t as (select *, count(*) over (partition by cb, corrected) as ties from r where n = top)
select cb, gn, corrected, n from t where ties = 1""",
    "rmdup_mark": f"""
with r as (select *, {_T["CB"]} as cb, {_T["UR"]} as ur, coalesce(flag, 0) & 4 <> 0 as un, case when coalesce(qual, '*') in ('*', '') then 0 else list_sum(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)) end as q from {_reads(2816, 0)}),
k as (select *, row_number() over (partition by un, chrom, pos, cb, ur order by q desc, aln_id) as k from r where un or (cb is not null and ur is not null))
select aln_id, case when un or (k = 1 and chrom is not null and pos is not null) then flag else coalesce(flag, 0) | 1024 end as flag from k""",
    "fusion_pairs": f"""
with s as (select distinct {_T["CB"]} as cb, substr({_T["UR"]}, 1, 3) as umi, {_T["GN"]} as g from {_reads(768, 0)}), t as (select * from s where cb is not null and umi is not null and g is not null and g not like '%;%'),
k as (select cb, umi from t group by 1, 2 having count(*) between 2 and 4), m as (select cb, umi, string_agg(g, ';' order by g) as genes from t join k using (cb, umi) group by 1, 2),
p as (select a.cb, a.umi, string_agg(a.g || '|' || b.g, ';' order by a.g, b.g) as pairs from t a join t b on a.cb = b.cb and a.umi = b.umi and a.g < b.g join k on k.cb = a.cb and k.umi = a.umi group by 1, 2)
select m.cb, m.umi, genes, pairs from m join p on m.cb = p.cb and m.umi = p.umi""",
    "fusion_molecules": f"""
with s as (select distinct {_T["CB"]} as cb, {_T["UR"]} as umi, {_T["GN"]} as g from {_reads(768, 0)}), t as (select * from s where cb is not null and umi is not null and g is not null and g not like '%;%'),
k as (select cb, umi from t group by 1, 2 having count(*) between 2 and 3), m as (select cb, umi, string_agg(g, ';' order by g) as genes from t join k using (cb, umi) group by 1, 2),
p as (select a.cb, a.umi, string_agg(a.g || '|' || b.g, ';' order by a.g, b.g) as pairs from t a join t b on a.cb = b.cb and a.umi = b.umi and a.g < b.g join k on k.cb = a.cb and k.umi = a.umi group by 1, 2)
select m.cb, m.umi, genes, pairs from m join p on m.cb = p.cb and m.umi = p.umi""",
    "sort_reads": f"select aln_id from alignments where {_T['CB']} in (select barcode from barcodes) and {_T['UR']} is not null",
    "pick": f"select aln_id from {_reads(768, 20)} and {_T['CB']} in (select barcode from barcodes) and {_T['GN']} is not null",
    "extract": f"""select qname, coalesce({_T["CB"]}, '.') as "CB", coalesce({_T["UR"]}, '.') as "UR", coalesce({_T["GN"]}, '.') as "GN" from {_reads(768, 0)}
and ({_T["CB"]} is not null or {_T["UR"]} is not null or {_T["GN"]} is not null)""",
    "mean_quality": """
with q as (select aln_id, seq, list_transform(string_split(qual, ''), lambda c: ascii(c) - 33) as l from alignments where qual <> '' and qual <> '*')
select aln_id from q where list_sum(l) / len(l) >= 30 and length(seq) - length(replace(upper(seq), 'N', '')) <= 2 and list_sum(l[1:15]) / len(l[1:15]) >= 20""",
    "to_reads": f"""select qname || '|||CB:Z:' || {_T["CB"]} || '|||UR:Z:' || {_T["UR"]} as name,
  case when coalesce(flag, 0) & 16 <> 0 then translate(reverse(seq), 'ACGTacgt', 'TGCAtgca') else seq end as seq,
  case when coalesce(flag, 0) & 16 <> 0 then reverse(qual) else nullif(qual, '*') end as qual
from {_reads(256, 0)} and seq is not null and seq <> '*' and {_T["CB"]} is not null and {_T["UR"]} is not null""",
    "add_tags": "select aln_id, 'lib1' as lb, 'Z' as re, tags['CB'] as cb from alignments",
    "species": "select aln_id, case when chrom in (select chrom from bed) then case when length(chrom) > 4 then 'specb' else 'speca' end end as sp from alignments",
    "hex_bases": f"""select aln_id, rpad(array_to_string(list_transform(string_split(to_hex(aln_id), ''), lambda c: substr('ACGT', ({_HEX}) % 4 + 1, 1) || substr('ACGT', ({_HEX}) // 4 + 1, 1)), ''),
  greatest(10, 2 * length(to_hex(aln_id)))::int, 'A') as bases from alignments""",
    "name_tags": "select read_id, regexp_extract(name, '^[@>]?([^|]*)', 1) as id, nullif(regexp_extract(name, '\\|SR:i:([^|]*)', 1), '') as sr from read1",
    "parse_rules": """
with r as (select regexp_extract(name, '^[@>]?([^|]*)', 1) as id, seq, qual from read1)
select id || case when substr(seq, 1, 16) <> '' then '|||CR:Z:' || substr(seq, 1, 16) else '' end || case when substr(seq, 17, 10) <> '' then '|||UR:Z:' || substr(seq, 17, 10) else '' end as name,
  substr(seq, 27) as seq, substr(qual, 27) as qual, 'exact' as status from r where seq is not null and upper(substr(seq, 27)) not like '%N%'""",
    "parse_listed": f"""
with w as (select distinct substr(barcode, 1, 5) as entry from barcodes), r as (select regexp_extract(name, '^[@>]?([^|]*)', 1) as id, seq, qual, substr(seq, 1, 5) as query from read1),
q as (select distinct query from r where query is not null), {_MASKED}
select id || '|||CR:Z:' || query || '|||CB:Z:' || entry as name, substr(seq, 6, 25) as seq, substr(qual, 6, 25) as qual, case when exact then 'exact' else 'corrected' end as status from r join near using (query)""",
    "parse_barcodes": f"""
with w as ({_KNOWN}), raw as (select regexp_extract(qname, '^[@>]?([^|]*)', 1) as id, coalesce({_T["CB"]}, '') as cb, seq, qual from alignments),
r as (select id, cb || seq as seq, repeat('F', length(cb)) || qual as qual, substr(cb || seq, 1, 20) as query from raw),
q as (select distinct query from r where query is not null), {_MASKED}
select id || '|||CR:Z:' || query || '|||CB:Z:' || entry as name, substr(seq, 21) as seq, substr(qual, 21) as qual, case when exact then 'exact' else 'corrected' end as status from r join near using (query)""",
    "whitelist_exact": f"select distinct {_T['CB']} as query from alignments where {_T['CB']} in (select barcode from barcodes)",
    "whitelist_mismatch": f"""
with w as ({_KNOWN}), q as (select distinct {_T["CB"]} as query from alignments where {_T["CB"]} is not null),
{_MASKED} select * from near""",
    "whitelist_edit": f"""
with w as ({_KNOWN}), q as (select distinct {_T["CB"]} as query from alignments where {_T["CB"]} is not null),
p as (select query, entry, levenshtein(query, entry) as distance from q, w where levenshtein(query, entry) <= 2)
select query, min(entry) as entry, min(distance) as distance from p group by 1 having count(*) = 1""",
    "whitelist_edit_short": f"""
with w as (select distinct substr(barcode, 1, 10) as entry from barcodes where barcode <> ''), q as (select distinct substr({_T["CB"]}, 1, 10) as query from alignments where {_T["CB"]} is not null),
p as (select query, entry, levenshtein(query, entry) as distance from q, w where levenshtein(query, entry) <= 1)
select query, min(entry) as entry, min(distance) as distance from p group by 1 having count(*) = 1""",
    "bed_merge": f"with {_REGIONS} select chrom, s as start, e as \"end\", strand from ({_islands('regions', 'chrom, strand')})",
    "bed_merge_gap": f"with {_REGIONS} select chrom, s as start, e as \"end\", '.' as strand from ({_islands('regions', 'chrom', 500)}) where e - s >= 300",
    "bed_merge_name": f"with {_REGIONS} select chrom, s as start, e as \"end\", name, strand from ({_islands('regions', 'chrom, strand, name')})",
    "bed_expand": f"""with {_REGIONS} select track, chrom, greatest(s - case when strand = '-' then 200 else 100 end, 0) as start, e + case when strand = '-' then 100 else 200 end as "end", name, strand from regions""",
    "bed_flatten": f"""with {_REGIONS} select chrom, lo as start, hi as "end", track as name, strand from ({_levels("regions", "chrom, strand, track", True)})""",
    "bed_distinct": f"with {_REGIONS} select chrom, s as start, e as \"end\", strand, min(name) as name from regions group by 1, 2, 3, 4",
    "overlap_join": f"with {_REGIONS}, {_WIDE}, {_cigar(_SPANS)}, {_SPAN_ROWS} select aln_id, track, w.s as start, w.e as \"end\", w.strand, w.name from spans a join wide w on a.chrom = w.chrom and a.s < w.e and w.s < a.e and a.e > a.s",
    "overlap_semi": f"with {_REGIONS}, {_WIDE}, {_cigar(_SPANS)}, {_SPAN_ROWS} select distinct aln_id from spans a join wide w on a.chrom = w.chrom and a.s < w.e and w.s < a.e and a.e > a.s",
    "overlap_anti": f"""with {_REGIONS}, {_WIDE}, {_cigar(_SPANS)}, {_SPAN_ROWS}, hit as (select distinct aln_id from spans a join wide w on a.chrom = w.chrom and a.s < w.e and w.s < a.e and a.e > a.s)
select aln_id from spans where aln_id not in (select aln_id from hit)""",
    "fragments": _FRAGS + "select * from frags",
    "cut_sites": _FRAGS + "select barcode, count(*) as n from frags group by 1",
    "peak_matrix": _FRAGS
    + f""", {_REGIONS}, {_WIDE}, p as (select distinct chrom, s, e from wide)
select p.chrom, p.s as start, p.e as "end", barcode, count(*) as n from frags f join p on f.chrom = p.chrom and f.start < p.e and p.s < f."end" group by all""",
    "depth": f"with {_cigar(_DEPTH)} {_levels('covered', 'chrom, strand')}",
    "depth_cells": f"""with {_cigar(_DEPTH)}, grouped as (select c.chrom, '.' as strand, case when g.barcode is null then 'others' else coalesce(g.grp, 'others') end as cell, umi, s, e
  from covered c left join barcodes g on g.barcode = c.cb where cb is not null and umi is not null),
once as (select chrom, strand, cell, s, e from ({_islands("grouped", "chrom, strand, cell, umi")})) {_levels("once", "chrom, strand, cell")}""",
    "covered_bases": f"with {_cigar(_DEPTH)}, own as (select chrom, cb as cell, s, e from covered where cb is not null) select cell, sum(e - s) as n from ({_islands('own', 'chrom, cell')}) group by 1",
    "peaks": f"with {_cigar(_DEPTH)} select chrom, s as start, e as \"end\", strand from ({_islands('covered', 'chrom, strand', 50)}) where e - s >= 70",
    "peaks_deep": f"""with {_cigar(_DEPTH)}, runs as ({_levels("covered", "chrom, strand")}), deep as (select chrom, strand, lo as s, hi as e from runs where level > 10)
select chrom, s as start, e as "end", strand from ({_islands("deep", "chrom, strand", 50)}) where e - s >= 50""",
    "gene_regions": f"with {_PART} select distinct chrom, b - 1 as start, b + z * 2000 - 1 as \"end\", 'N' || k as name, strand from gene",
    "exon_regions": f"with {_PART} select distinct chrom, s - 1 as start, e as \"end\", 'T' || k as name, strand from exon",
    "gene_summary": f"""with {_PART}, gb as (select chrom, b - 1 as s, b + z * 2000 - 1 as e from gene), eb as (select chrom, s - 1 as s, e from exon)
select 'genes_forward' as metric, count(*) as value from gene where strand = '+' union all select 'genes_reverse', count(*) from gene where strand = '-'
union all select 'genes_coding', count(*) from gene where coding union all select 'transcripts', count(*) from gene
union all select 'exons', count(*) from (select distinct chrom, s, e from exon)
union all select 'gene_bases', sum(e - s) from ({_islands("gb", "chrom")}) union all select 'exon_bases', sum(e - s) from ({_islands("eb", "chrom")})""",
    "annotate_genes": f"""
with {_PART}, {_cigar(f"select aln_id, chrom, pos, cigar, {_STRAND} as strand from alignments where coalesce(flag, 0) & 4 = 0 and chrom is not null and pos is not null")},
ends as (select aln_id, any_value(chrom) as chrom, any_value(strand) as strand, min(lo) as lo, max(hi) as hi from blocks group by 1),
pair as (select r.aln_id, r.strand as rs, g.* from ends r join gene g on r.chrom = g.chrom and g.b <= r.lo and r.hi <= g.b + g.z * 2000 - 1),
kinds as (
  select p.aln_id, p.k as g, p.rs, p.strand as gs, b.k as bk, b.lo, b.hi, max(x.i) filter (x.s <= b.lo and x.e >= b.lo) as i, max(x.i) filter (x.s <= b.hi and x.e >= b.hi) as j,
    min(x.i) filter (x.s <= b.hi and x.e >= b.lo) as t0, max(x.i) filter (x.s <= b.hi and x.e >= b.lo) as t1, max(x.e) as last,
    bool_or(x.s = b.lo) as sb, bool_or(x.e = b.hi) as eb
  from pair p join blocks b on b.aln_id = p.aln_id join exon x on x.chrom = p.chrom and x.k = p.k group by all
), typed as (
  select *, case when i is not null and j is not null then case when i = j then 'E' else 'R' end when t0 is not null then 'C' when lo > last then 'U' else 'N' end as t from kinds
), folded as (
  select a.aln_id, a.g, a.rs, a.gs, case when b.t is null then a.t when a.t = 'R' or b.t = 'R' then 'R'
    when a.t in ('E', 'C') and b.t in ('E', 'C') and b.t0 - a.t1 = 1 and a.eb and b.sb then case when 'C' in (a.t, b.t) then 'C' else 'S' end
    when a.t = 'N' and b.t = 'N' then 'N' else 'V' end as t
  from (select * from typed where bk = 1) a left join (select * from typed where bk = 2) b on a.aln_id = b.aln_id and a.g = b.g
), sided as (
  select aln_id, g, case when rs = gs or t = 'U' then t when t in ('N', 'C') then 'B' else 'A' end as t from folded
), ranked as (
  select *, strpos('SECRNXABVU', t) as r, min(strpos('SECRNXABVU', t)) over (partition by aln_id) as best from sided
), done as (select aln_id, any_value(t) as re, string_agg('N' || g, ';' order by 'N' || g) as gn from ranked where r = best group by 1)
select e.aln_id, coalesce(re, 'I') as re, case when re in ('E', 'S', 'R', 'N', 'C') then gn end as gn from ends e left join done d on d.aln_id = e.aln_id""",
    "annotate_regions": f"""
with {_REGIONS}, {_WIDE}, {_cigar("select aln_id, chrom, pos, cigar, case when coalesce(flag, 0) & 16 <> 0 then '-' else '+' end as strand from alignments where coalesce(flag, 0) & 4 = 0 and chrom is not null and pos is not null")},
hit as (select distinct aln_id, w.name from blocks b join wide w on w.name is not null and b.chrom = w.chrom and b.lo - 1 < w.e and w.s < b.hi and w.strand in ('.', b.strand))
select aln_id, string_agg(name, ';' order by name) as names from hit group by 1""",
    "annotate_bed": _BED_TYPES + "select bed_id, type from types",
    "region_types": _BED_TYPES + "select type, count(*) as n, sum(bases) as bases from types group by 1",
    "sam_alignments": problems.P2_BASE
    + """select line_id as aln_id, regexp_extract(qname, '^>?([^|]*)', 1) as qname, nullif(rname, '*') as chrom, nullif(cast(pos as int), 0) as pos,
  coalesce(substr(list_filter(tags, lambda t: t like 'CB:%')[1], 6), nullif(regexp_extract(qname, '[|]{3}CB:[A-Za-z]:([^|]*)', 1), '')) as cb,
  coalesce(substr(list_filter(tags, lambda t: t like 'GN:%')[1], 6), nullif(regexp_extract(qname, '[|]{3}GN:[A-Za-z]:([^|]*)', 1), '')) as gn
from judged where quoted_well and wide and good""",
    "annotate_variants": f"""
with {_cigar(f"select aln_id, chrom, pos, cigar, seq, {_STRAND} as strand from alignments where coalesce(flag, 0) & 4 = 0 and pos is not null and seq is not null and seq <> '*'")},
v as (select chrom, pos, min([b, translate(b, 'ACGTN', 'CATGA')]) as alleles from (select chrom, pos + 9 as pos, substr(seq, 10, 1) as b from alignments where chrom is not null and pos is not null and length(seq) >= 10) group by 1, 2),
q as (select *, coalesce(sum(case when op in ('M', 'I', 'S', '=', 'X') then n else 0 end) over (partition by aln_id order by i rows between unbounded preceding and 1 preceding), 0) as qoff from placed),
hit as (select b.aln_id, b.chrom, b.strand, v.pos as vpos, v.alleles, substr(b.seq, cast(qoff + v.pos - (b.pos + off) + 1 as int), 1) as own
  from q join base b using (aln_id) join v on v.chrom = b.chrom and v.pos >= b.pos + off and v.pos < b.pos + off + q.n where op in ('M', '=', 'X'))
select aln_id, string_agg(t, ';' order by t) as vr from (select distinct aln_id, chrom || ':' || cast(vpos as varchar) || alleles[1] || case when own = alleles[1] then '=' else '>' || own end || '/' || strand as t
  from hit where list_contains(alleles, own)) group by 1""",
    "annotate_exon_bins": f"""
with {_PART}, parts as (select distinct chrom, strand, 'N' || k as name, s - 1 as s, e from exon), bins as ({_levels("parts", "chrom, strand, name", True)}),
{_cigar("select aln_id, chrom, pos, cigar, case when coalesce(flag, 0) & 16 <> 0 then '-' else '+' end as strand from alignments where coalesce(flag, 0) & 4 = 0 and chrom is not null and pos is not null")},
hit as (select distinct a.aln_id, b.name from blocks a join bins b on a.chrom = b.chrom and a.lo - 1 < b.hi and b.lo < a.hi and b.strand = a.strand)
select aln_id, string_agg(name, ';' order by name) as names from hit group by 1""",
    "gene_records": f"""
with {_PART}, parts as (select chrom, strand, k, 'exon' as feature, s, e from exon union all select x.chrom, x.strand, x.k, 'CDS', s, e from exon x join gene g on g.k = x.k where coding and i in (1, 2)),
ends as (select chrom, strand, k, min(s) as s, max(e) as e from parts group by 1, 2, 3)
select chrom, case when feature in ('gene', 'transcript') then 'made' else 'part' end as source, feature, s as start, e as "end", strand, 'G' || k as gene_id, 'N' || k as gene_name, case when feature <> 'gene' then 'T' || k end as transcript_id
from (select chrom, strand, k, feature, s, e from parts union all select chrom, strand, k, 'gene', s, e from ends union all select chrom, strand, k, 'transcript', s, e from ends)""",
    "reads_in_regions": f"with {_REGIONS}, {_WIDE}, {_cigar(_SPANS)}, {_SPAN_ROWS} select aln_id, a.chrom, pos from spans a join wide w on a.chrom = w.chrom and a.s < w.e and w.s < a.e and a.e > a.s join base using (aln_id)",
    "depth_in_regions": f"""with {_REGIONS}, {_cigar(_DEPTH)}, runs as ({_levels("covered", "chrom, strand")}), area as ({_islands("regions", "chrom")})
select chrom, unnest(range(cast(greatest(lo, s) + 1 as bigint), cast(least(hi, e) + 1 as bigint))) as pos, strand, level from runs join area using (chrom) where lo < e and s < hi""",
    "contigs": "select sn as chrom, max(ln) as length from (select regexp_extract(str, '\\tSN:([^\\t\\r]*)', 1) as sn, cast(regexp_extract(str, '\\tLN:(\\d+)', 1) as bigint) as ln from sam_pool where str like '@SQ' || chr(9) || '%') group by 1",
    "running_counts": f"select date_trunc('day', loaded_at) as window_start, {_T['CB']} as cell, count(*) as n from alignments where loaded_at is not null and {_T['CB']} is not null group by 1, 2",
}
