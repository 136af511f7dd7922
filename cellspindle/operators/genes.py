"""Gene models: normalisation, export to regions, summaries, and annotation of reads and regions with them.

Features: (chrom, source, feature, start, end, strand, gene_id, gene_name, transcript_id), both ends 1-based, inclusive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellspindle.functions import cigar, flags
from cellspindle.operators import intervals
from cellspindle.operators.filters import tag

# Bases of a bin for whole genes and for variants, feature names that are read, and region types by priority.
GENE_BIN, VARIANT_BIN = 65_536, 256
FEATURES = ("gene", "transcript", "exon", "CDS", "UTR", "start_codon", "stop_codon", "five_prime_utr", "three_prime_utr", "5UTR", "3UTR", "inter", "inter_CNS", "intron_CNS")
READ_TYPES = ("S", "E", "C", "R", "N", "X", "A", "B", "V", "U")
BED_TYPES = [
    "unknown", "promoter", "utr3", "utr5", "exon", "multiexons", "exonintron", "whole_gene", "multigenes", "intron", "antisense_utr3",
    "antisense_utr5", "antisense_exon", "antisense_intron", "antisense_complex", "flank", "upstream", "downstream", "antisense_upstream",
    "antisense_downstream", "intergenic", "unknown_chromosome",
]


def genes(features: DataFrame) -> DataFrame:
    """One row per (gene_id, chrom): bounds from the gene record or, without one, from its parts; coding if it has a CDS."""
    own = F.col("feature") == "gene"
    return (
        features.where("gene_id is not null")
        .groupBy("gene_id", "chrom")
        .agg(
            F.coalesce(F.min(F.when(own, F.col("start"))), F.min("start")).alias("start"),
            F.coalesce(F.max(F.when(own, F.col("end"))), F.max("end")).alias("end"),
            F.coalesce(F.min(F.when(own, F.col("strand"))), F.min("strand")).alias("strand"),
            F.coalesce(F.min("gene_name"), F.first("gene_id")).alias("gene_name"),
            F.bool_or(F.col("feature") == "CDS").alias("coding"),
        )
    )


def transcripts(features: DataFrame) -> DataFrame:
    """One row per (transcript_id, gene_id, chrom) with its exons and coding parts in coordinate order."""
    own = F.col("feature") == "transcript"
    part = lambda f: F.array_sort(F.collect_set(F.when(F.col("feature") == f, F.struct("start", "end"))))
    return (
        features.where("transcript_id is not null")
        .groupBy("transcript_id", "gene_id", "chrom")
        .agg(
            F.coalesce(F.min(F.when(own, F.col("start"))), F.min("start")).alias("start"),
            F.coalesce(F.max(F.when(own, F.col("end"))), F.max("end")).alias("end"),
            F.coalesce(F.min(F.when(own, F.col("strand"))), F.min("strand")).alias("strand"),
            part("exon").alias("exons"),
            part("CDS").alias("cds"),
        )
    )


def normalised(features: DataFrame) -> DataFrame:
    """All records in order, with those that were missing: gene, transcript, then its parts."""
    named = genes(features).select("gene_id", "chrom", F.col("gene_name").alias("_name"))
    cols = ["chrom", "source", "feature", "start", "end", "strand", "gene_id", "gene_name", "transcript_id"]
    made = lambda d, feature, tx: d.select("chrom", F.lit("made").alias("source"), F.lit(feature).alias("feature"), "start", "end", "strand", "gene_id", F.lit(None).cast("string").alias("gene_name"), tx)
    absent = lambda d, feature, keys: d.join(features.where(F.col("feature") == feature).select(*keys).distinct(), keys, "left_anti")
    new_genes = made(absent(genes(features), "gene", ["gene_id", "chrom"]), "gene", F.lit(None).cast("string").alias("transcript_id"))
    new_tx = made(absent(transcripts(features), "transcript", ["transcript_id", "gene_id", "chrom"]), "transcript", F.col("transcript_id"))
    every = features.select(*cols).unionByName(new_genes).unionByName(new_tx)
    rank = F.when(F.col("feature") == "gene", 0).when(F.col("feature") == "transcript", 1).otherwise(2)
    joined = every.join(named, ["gene_id", "chrom"], "left").withColumn("gene_name", F.coalesce("gene_name", "_name")).drop("_name")
    return joined.select(*cols).orderBy("chrom", "gene_id", F.coalesce("transcript_id", F.lit("")), rank, "start", "end", "feature")


def to_regions(features: DataFrame, level: str = "gene", name: str | None = "gene") -> DataFrame:
    """(chrom, start 0-based, end, name, strand) of the genes, transcripts, exons or CDS, without repeats."""
    table = normalised(features) if level in ("gene", "transcript") else features
    label = {"gene": F.coalesce("gene_name", "gene_id"), "transcript": F.col("transcript_id"), None: F.lit(None).cast("string")}[name]
    return table.where(F.col("feature") == level).select("chrom", (F.col("start") - 1).cast("int").alias("start"), "end", label.alias("name"), "strand").distinct()


def summary(features: DataFrame) -> DataFrame:
    """(metric, value): genes per strand, coding genes, transcripts, exons, and bases covered by genes and exons."""
    g, t = genes(features), transcripts(features)
    e = features.where("feature = 'exon'").select("chrom", "start", "end").distinct()
    bases = lambda d: intervals.merge(
        d.select("chrom", (F.col("start") - 1).alias("start"), "end", F.lit(None).cast("string").alias("name"), F.lit(".").alias("strand")), stranded=False
    ).agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("value"))
    rows = [
        g.agg(F.count_if(F.col("strand") != "-").alias("genes_forward"), F.count_if(F.col("strand") == "-").alias("genes_reverse"), F.count_if("coding").alias("genes_coding")).select(
            F.expr("stack(3, 'genes_forward', genes_forward, 'genes_reverse', genes_reverse, 'genes_coding', genes_coding) as (metric, value)")
        ),
        t.agg(F.count("*").alias("value")).select(F.lit("transcripts").alias("metric"), "value"),
        e.agg(F.count("*").alias("value")).select(F.lit("exons").alias("metric"), "value"),
        bases(g).select(F.lit("gene_bases").alias("metric"), "value"),
        bases(e).select(F.lit("exon_bases").alias("metric"), "value"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _let(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _block_type(b: Column, numbered: Column) -> Column:
    """struct(t, no, last, sb, eb) of a block: its type, the first and last exon it meets, and whether its ends are theirs."""
    touched = F.filter(numbered, lambda x: (x["s"] <= b["hi"]) & (x["e"] >= b["lo"]))
    holds = lambda met, at: F.get(F.filter(met, lambda x: (x["s"] <= at) & (x["e"] >= at)), F.lit(0))["no"]

    def of(met: Column) -> Column:
        none = F.size(met) == 0
        hit, last = F.get(met, F.lit(0)), F.get(met, F.size(met) - 1)
        kind = lambda x: F.when(none, F.when(b["lo"] > F.array_max(F.transform(numbered, lambda e: e["e"])), "U").otherwise("N")).when(x["lo"].isNotNull() & x["hi"].isNotNull(), F.when(x["lo"] == x["hi"], "E").otherwise("R")).otherwise("C")
        return F.struct(
            _let(F.struct(holds(met, b["lo"]).alias("lo"), holds(met, b["hi"]).alias("hi")), kind).alias("t"),
            F.coalesce(hit["no"], F.lit(-9)).alias("no"),
            F.coalesce(last["no"], F.lit(-9)).alias("last"),
            F.coalesce(b["lo"] == hit["s"], F.lit(False)).alias("sb"),
            F.coalesce(b["hi"] == last["e"], F.lit(False)).alias("eb"),
        )

    return _let(touched, of)


def transcript_type(blocks: Column, exons: Column) -> Column:
    """Region type of a read on one transcript, before its strand is looked at.

    One block: exon E, exon and intron C, intron retained R, intron N, unknown U. A following block that begins at the
    start of the next exon, after one that ended at its exon's end, makes a splice S (C stays or becomes C); any other
    mix is ambiguous V; a retained intron decides at once.
    """
    numbered = F.transform(exons, lambda e, i: F.struct(e["start"].alias("s"), e["end"].alias("e"), i.alias("no")))
    kinds = _let(numbered, lambda n: F.transform(blocks, lambda b: _block_type(b, n)))
    state = lambda t, no, eb, done: F.struct(t.alias("t"), no.cast("int").alias("no"), eb.alias("eb"), done.alias("done"))
    begin = state(F.lit(None).cast("string"), F.lit(-9), F.lit(False), F.lit(False))

    def step(a: Column, k: Column) -> Column:
        next_exon = a["t"].isin("E", "S", "C") & k["t"].isin("E", "C") & (k["no"] - a["no"] == 1) & a["eb"] & k["sb"]
        return (
            F.when(a["done"], a)
            .when(k["t"] == "R", state(F.lit("R"), k["no"], k["eb"], F.lit(True)))
            .when(a["t"].isNull(), state(k["t"], k["last"], k["eb"], F.lit(False)))
            .when(next_exon, state(F.when((a["t"] == "C") | (k["t"] == "C"), "C").otherwise("S"), k["last"], k["eb"], F.lit(False)))
            .when((a["t"] == "N") & (k["t"] == "N"), a)
            .otherwise(state(F.lit("V"), k["no"], k["eb"], F.lit(True)))
        )

    return F.aggregate(kinds, begin, step, lambda a: F.coalesce(a["t"], F.lit("U")))


def annotate_reads(
    df: DataFrame,
    features: DataFrame,
    key: str = "aln_id",
    vague: int = 0,
    reverse: bool = False,
    ignore_strand: bool = False,
    introns: bool = False,
    splices: bool = False,
    antisense: bool = False,
    psi: bool = False,
) -> DataFrame:
    """(key, re, gn, gx, tx, at, ex, jc, er, tss) of every mapped read; lists are sorted arrays, null where there is none.

    A gene counts if it contains the whole read, within ``vague`` bases. A gene's type is that of its best transcript, a
    read's that of its best gene; without any it is intergenic, I. Genes are given where their type is the read's, for
    introns only with ``introns``, for exon-intron reads only with ``splices`` or ``introns``, never for ambiguous reads.
    ``antisense`` gives the genes of the other strand in `at`. `ex` holds exons of exonic reads, `jc` junctions, `tss` the
    genes whose transcript begins at the read's 5' end. With ``psi`` a transcript of which a junction leaves out exons
    has the type X, and `er` holds those exons where another transcript of the gene explains the read.
    """
    reads, model = _reads(df, key, reverse), _models(features, vague)
    gaps, skipped = _gaps(), _skipped()
    best_of = _best(reads, model, ignore_strand, psi)
    # only pairs of a read's best type, or that leave out exons, get their details
    typed = _typed(reads.join(best_of.hint("merge"), "key"), model, reads, ignore_strand, psi)
    typed = typed.where((_rank() == F.col("best")) | (F.lit(psi) & (F.col("t") == "X")))
    rank = _rank()
    five = F.when(F.col("strand") == "+", F.col("lo")).otherwise(F.col("hi"))
    begin = F.when(F.col("gstrand") == "+", F.col("ts")).otherwise(F.col("te"))
    exon_name = lambda e: F.concat("chrom", F.lit(":"), e["start"].cast("string"), F.lit("-"), e["end"].cast("string"), F.lit("/"), "gstrand", F.lit("/"), "gene_name")
    touched = F.filter("exons", lambda e: F.exists("blocks", lambda b: (e["start"] <= b["hi"]) & (e["end"] >= b["lo"])))
    junction = lambda x: F.concat("chrom", F.lit(":"), x["from"].cast("string"), F.lit("-"), x["to"].cast("string"), F.lit("/"), "gstrand", F.lit("/"), "gene_name")
    detail = F.struct(
        rank.cast("int").alias("r"),
        "gene_id",
        "gene_name",
        "transcript_id",
        F.transform(touched, exon_name).alias("ex"),
        F.when(F.col("t") == "S", F.transform(gaps, junction)).alias("jc"),
        F.when(F.col("t") == "X", F.transform(skipped, exon_name)).alias("er"),
        F.when((five == begin) & (F.col("strand") == F.col("gstrand")), F.concat("gene_name", F.lit(":"), five.cast("string"), F.lit("/"), "gstrand")).alias("tss"),
    )
    per_read = typed.groupBy("key").agg(F.collect_list(detail).alias("d"), F.first("best").alias("best"))
    best = F.filter("d", lambda x: x["r"] == F.col("best"))
    letter = F.element_at(F.array(*map(F.lit, READ_TYPES)), F.col("best"))
    shown = F.col("re").isin("E", "S", "R") | (F.lit(introns) & (F.col("re") == "N")) | (F.lit(splices or introns) & (F.col("re") == "C"))
    names = lambda f: F.array_sort(F.array_distinct(F.transform("b", lambda x: x[f])))
    joined = lambda f: F.nullif(F.array_sort(F.array_distinct(F.flatten(F.filter(F.transform("b", lambda x: x[f]), lambda v: v.isNotNull())))), F.array().cast("array<string>"))
    tss = F.array_sort(F.array_distinct(F.filter(F.transform("b", lambda x: x["tss"]), lambda v: v.isNotNull())))
    out = per_read.select("key", letter.alias("re"), best.alias("b"), "d")
    explained = F.transform(F.filter("d", lambda x: F.exists("b", lambda y: y["gene_id"] == x["gene_id"])), lambda x: x["er"])
    excluded = F.nullif(F.array_sort(F.array_distinct(F.flatten(F.filter(explained, lambda v: v.isNotNull())))), F.array().cast("array<string>"))
    done = out.select(
        "key",
        "re",
        F.when(shown, names("gene_name")).alias("gn"),
        F.when(shown, names("gene_id")).alias("gx"),
        F.when(shown, names("transcript_id")).alias("tx"),
        F.when(F.lit(antisense) & F.col("re").isin("A", "B"), names("gene_name")).alias("at"),
        F.when(F.col("re").isin("E", "S"), joined("ex")).alias("ex"),
        F.when(F.col("re") == "S", joined("jc")).alias("jc"),
        F.when(shown, excluded).alias("er"),
        F.nullif(tss, F.array().cast("array<string>")).alias("tss"),
    )
    return reads.select("key").join(done.hint("merge"), "key", "left").withColumn("re", F.coalesce("re", F.lit("I"))).withColumnRenamed("key", key)


def read_types(df: DataFrame, features: DataFrame, key: str = "aln_id", vague: int = 0, reverse: bool = False, ignore_strand: bool = False, psi: bool = False) -> DataFrame:
    """(key, re) as of ``annotate_reads``, without the details of any pair."""
    reads = _reads(df, key, reverse)
    # the letter is looked up before the join: of a null index `element_at` is taken for never null
    letter = F.element_at(F.array(*map(F.lit, READ_TYPES)), F.col("best"))
    types = _best(reads, _models(features, vague), ignore_strand, psi).select("key", letter.alias("re"))
    return reads.select("key").join(types.hint("merge"), "key", "left").select(F.col("key").alias(key), F.coalesce("re", F.lit("I")).alias("re"))


def _reads(df: DataFrame, key: str, reverse: bool) -> DataFrame:
    rows = df.where(~flags.has(flags.UNMAPPED) & F.col("chrom").isNotNull() & F.col("pos").isNotNull() & (F.size(cigar.blocks(F.col("pos"), F.col("cigar"))) > 0))
    strand = flags.read_strand()
    strand = F.when(strand == "+", "-").otherwise("+") if reverse else strand
    reads = rows.select(F.col(key).alias("key"), "chrom", strand.alias("strand"), cigar.blocks(F.col("pos"), F.col("cigar")).alias("blocks"))
    return reads.withColumns({"lo": F.get("blocks", F.lit(0))["lo"], "hi": F.get("blocks", F.size("blocks") - 1)["hi"]}).withColumn("from", F.col("lo") - 1)


def _models(features: DataFrame, vague: int) -> DataFrame:
    g = genes(features).select("gene_id", F.col("chrom").alias("gc"), F.col("start").alias("gs"), F.col("end").alias("ge"), F.col("strand").alias("gstrand"), "gene_name")
    t = transcripts(features).where("size(exons) > 0").select("gene_id", F.col("chrom").alias("gc"), "transcript_id", F.col("start").alias("ts"), F.col("end").alias("te"), "exons")
    return g.join(t.hint("merge"), ["gene_id", "gc"]).withColumns({"g0": F.col("gs") - 1 - vague, "g1": F.col("ge") + vague})


def _typed(reads: DataFrame, model: DataFrame, counted: DataFrame, ignore_strand: bool, psi: bool) -> DataFrame:
    """Reads by the transcripts whose gene contains them, with their type; a containing gene holds a read's first base, so that alone is looked up."""
    hits = intervals.overlap_join(reads, model, ("chrom", "from", "lo"), ("gc", "g0", "g1"), size=GENE_BIN, counted=counted).where("hi <= g1")
    other = F.lit(False) if ignore_strand else F.col("strand") != F.col("gstrand")
    left_out = F.lit(psi) & (F.size("blocks") > 1) & (F.size(_skipped()) > 0)
    kind = F.when(~other, F.when(left_out, "X").otherwise(F.col("p"))).when(F.col("p").isin("N", "C"), "B").when(F.col("p") == "U", "U").otherwise("A")
    return hits.withColumn("p", transcript_type(F.col("blocks"), F.col("exons"))).withColumn("t", kind)


def _best(reads: DataFrame, model: DataFrame, ignore_strand: bool, psi: bool) -> DataFrame:
    """(key, best): the rank of each read's best type."""
    return _typed(reads, model, reads, ignore_strand, psi).groupBy("key").agg(F.min(_rank()).cast("int").alias("best"))


def _rank() -> Column:
    return F.array_position(F.array(*map(F.lit, READ_TYPES)), F.col("t"))


def _gaps() -> Column:
    return F.transform(F.slice("blocks", F.lit(2), F.greatest(F.size("blocks") - 1, F.lit(0))), lambda b, i: F.struct(F.get("blocks", i)["hi"].alias("from"), b["lo"].alias("to")))


def _skipped() -> Column:
    """The exons that lie in a gap of the read."""
    return F.filter("exons", lambda e: F.exists(_gaps(), lambda x: (e["start"] > x["from"]) & (e["end"] < x["to"])))


def flattened_exons(features: DataFrame) -> DataFrame:
    """(chrom, start, end, name, strand): disjoint exon bins of each gene."""
    e = features.where("feature = 'exon'").select("chrom", (F.col("start") - 1).alias("start"), "end", F.coalesce("gene_name", "gene_id").alias("name"), "strand").distinct()
    return intervals.flatten(e)


def annotate_regions(df: DataFrame, regions: DataFrame, key: str = "aln_id", ignore_strand: bool = False) -> DataFrame:
    """(key, names): for each mapped read the names of the regions that its blocks overlap, sorted.

    A region without a strand fits both; one without a name is called `chrom:start-end[/strand]`. The second read of a
    pair is not turned around here.
    """
    rows = df.where(~flags.has(flags.UNMAPPED) & F.col("chrom").isNotNull() & F.col("pos").isNotNull())
    blocks = rows.select(F.col(key).alias("key"), "chrom", flags.read_strand(flip_read2=False).alias("strand"), F.inline(cigar.blocks(F.col("pos"), F.col("cigar")))).withColumn("from", F.col("lo") - 1)
    own = F.when(F.col("strand").isin("+", "-"), F.col("strand"))
    label = F.coalesce("name", F.concat("chrom", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.coalesce(F.concat(F.lit("/"), own), F.lit(""))))
    named = regions.select(F.col("chrom").alias("rc"), F.col("start").alias("rs"), F.col("end").alias("re"), own.alias("rstrand"), label.alias("label"))
    hit = intervals.overlap_join(blocks, named, ("chrom", "from", "hi"), ("rc", "rs", "re"))
    if not ignore_strand:
        hit = hit.where("rstrand is null or rstrand = strand")
    return hit.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("label")), ";").alias("names")).withColumnRenamed("key", key)


def annotate_bed(regions: DataFrame, features: DataFrame, up: int = 1000, down: int = 1000, ignore_strand: bool = False, key: str = "row_id") -> DataFrame:
    """(key, type, genes): the position of each region (0-based, half-open) relative to the genes.

    whole_gene if it contains the gene; inside a gene by its transcripts: exon (utr5, utr3 where the transcript is coding
    and no coding part is met), multiexons, exonintron, intron; else upstream or downstream within the flanks. On the
    other strand the antisense types. The first type by priority wins; several genes make `multigenes` unless the best
    type is antisense or a flank. No gene: intergenic.
    """
    r = regions.select(F.col(key).alias("key"), "chrom", F.col("start").alias("s"), F.col("end").alias("e"), F.col("strand").alias("rstrand"))
    g = genes(features).select(F.col("chrom").alias("gc"), "gene_id", "gene_name", (F.col("start") - 1).alias("gs"), F.col("end").alias("ge"), F.col("strand").alias("gstrand"))
    flank = max(up, down)
    t = transcripts(features).where("size(exons) > 0").select("gene_id", F.col("chrom").alias("gc"), "exons", "cds")
    model = g.join(t.hint("merge"), ["gene_id", "gc"], "left").withColumns({"g0": F.greatest(F.col("gs") - flank, F.lit(0)), "g1": F.col("ge") + flank})
    near = intervals.overlap_join(r, model, ("chrom", "s", "e"), ("gc", "g0", "g1"), size=GENE_BIN)
    other = F.lit(False) if ignore_strand else F.coalesce(F.col("rstrand").isin("+", "-") & (F.col("rstrand") != F.col("gstrand")), F.lit(False))
    at = lambda a: F.filter(a, lambda x: (x["start"] <= F.col("e")) & (x["end"] > F.col("s")))
    first = F.get("met", F.lit(0))
    coded = (F.size("cds") > 0) & (F.size(at("cds")) == 0)
    passed = F.exists("cds", lambda x: x["end"] <= F.col("s"))
    utr = F.when(passed == (F.col("gstrand") != "-"), "utr3").otherwise("utr5")
    position = (
        F.when(F.size("met") > 1, "multiexons")
        .when(F.size("met") == 0, "intron")
        .when((first["start"] <= F.col("s") + 1) & (first["end"] >= F.col("e")), F.when(coded, utr).otherwise("exon"))
        .otherwise("exonintron")
    )
    within = F.when(~other, F.col("position")).when(F.col("position").isin("exon", "utr3", "utr5", "intron"), F.concat(F.lit("antisense_"), "position")).otherwise("antisense_complex")
    inside = F.col("exons").isNotNull() & (F.col("s") >= F.col("gs")) & (F.col("e") <= F.col("ge"))
    placed = near.withColumn("met", F.when(inside, at("exons"))).withColumn("position", F.when(inside, position))
    kind = (
        F.when((F.col("s") <= F.col("gs")) & (F.col("e") >= F.col("ge")), F.when(other, "antisense_complex").otherwise("whole_gene"))
        .when((F.col("s") >= F.col("gs")) & (F.col("e") <= F.col("ge")), F.when(inside, within))
        .otherwise(_side(up, down, other))
    )
    every = placed.select("key", "gene_name", kind.alias("type")).where("type is not null")
    order = F.array_position(F.array(*map(F.lit, BED_TYPES)), F.col("type"))
    best = every.withColumn("rank", order).groupBy("key").agg(F.min("rank").alias("rank"), F.collect_set(F.struct("rank", "gene_name")).alias("x"))
    chosen = best.withColumn("genes", F.array_sort(F.array_distinct(F.transform(F.filter("x", lambda v: (v["rank"] == F.col("rank")) | (F.col("rank") <= 10)), lambda v: v["gene_name"]))))
    label = F.when((F.size("genes") > 1) & (F.col("rank") <= 10), "multigenes").otherwise(F.element_at(F.array(*map(F.lit, BED_TYPES)), F.col("rank").cast("int")))
    done = chosen.select("key", label.alias("type"), "genes")
    return r.select("key").join(done.hint("merge"), "key", "left").withColumn("type", F.coalesce("type", F.lit("intergenic"))).withColumnRenamed("key", key)


def _side(up: int, down: int, other: Column) -> Column:
    """upstream or downstream of a gene that the region reaches over or lies beside; null beyond the flank."""
    left = F.col("s") < F.col("gs")
    first = left == (F.col("gstrand") != "-")
    near = F.when(left, F.col("gs") - F.col("e")).otherwise(F.col("s") - F.col("ge")) < F.when(first, up).otherwise(down)
    name = F.when(first, "upstream").otherwise("downstream")
    return F.when(near, F.when(other, F.concat(F.lit("antisense_"), name)).otherwise(name))


def type_report(annotated: DataFrame, regions: DataFrame, key: str = "row_id") -> DataFrame:
    """(type, n, bases) of annotated regions; neither side is broadcast."""
    return annotated.join(regions.select(key, "start", "end").hint("merge"), key).groupBy("type").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"))


def rescue_multimappers(df: DataFrame, types: DataFrame, key: str = "aln_id") -> DataFrame:
    """Promote a read's only exonic hit (E, S or C) if it is a secondary one; its other hits become secondary.

    ``types`` (key, re) comes from ``annotate_reads``. The promoted hit gets quality 255, tag MM:1 and the sequence of
    the primary hit; the others quality 0 and no sequence. Mates are judged apart.
    """
    mate = F.coalesce(F.col("flag"), F.lit(0)).bitwiseAND(flags.READ1 | flags.READ2)
    hits = df.join(types.select(key, "re"), key, "left").withColumn("_mate", mate)
    mapped = ~flags.has(flags.UNMAPPED)
    exonic = mapped & F.coalesce(F.col("re").isin("E", "S", "C"), F.lit(False))
    primary = ~flags.has(flags.SECONDARY) & ~flags.has(flags.SUPPLEMENTARY)
    read = (
        hits.groupBy("qname", "_mate")
        .agg(
            F.count_if(exonic).alias("n_exonic"),
            F.count_if(mapped).alias("n_hit"),
            F.max(F.when(exonic & flags.has(flags.SECONDARY), F.col(key))).alias("winner"),
            F.max(F.when(primary, F.struct(flags.has(flags.REVERSE).alias("rev"), "seq", "qual"))).alias("p"),
        )
        .where("n_exonic = 1 and n_hit > 1 and winner is not null")
    )
    both = hits.join(read, ["qname", "_mate"], "left")
    wins, loses = F.col("winner").isNotNull() & (F.col(key) == F.col("winner")), F.col("winner").isNotNull() & (F.col(key) != F.col("winner"))
    from cellspindle.functions import seq

    turn = F.col("p.rev") != flags.has(flags.REVERSE)
    f = F.coalesce(F.col("flag"), F.lit(0))
    return both.withColumns(
        {
            "seq": F.when(wins, F.when(turn, seq.revcomp(F.col("p.seq"))).otherwise(F.col("p.seq"))).when(loses, F.lit("*")).otherwise(F.col("seq")),
            "qual": F.when(wins, F.when(turn, F.reverse("p.qual")).otherwise(F.col("p.qual"))).when(loses, F.lit("*")).otherwise(F.col("qual")),
            "mapq": F.when(wins, F.lit(255)).when(loses, F.lit(0)).otherwise(F.col("mapq")),
            "tags": F.when(wins, F.map_concat(F.map_filter("tags", lambda k, _: k != "MM"), F.create_map(F.lit("MM"), F.lit("1")))).otherwise(F.col("tags")),
            "flag": F.when(wins, f.bitwiseAND(F.lit(~flags.SECONDARY))).when(loses, f.bitwiseOR(flags.SECONDARY)).otherwise(F.col("flag")),
        }
    ).select(*df.columns)


def variants_on_reads(df: DataFrame, variants: DataFrame, key: str = "aln_id", with_reference: bool = False, phased: bool = False) -> DataFrame:
    """(key, vr): the variants that reads carry, sorted: `chrom:posREF>ALT/strand`, or `chrom:posREF=/strand` with ``with_reference``.

    ``variants`` (chrom, pos 1-based, alleles: reference first[, block]). The bases from the variant's position on are
    compared with every allele and the longest one that fits counts; an insertion needs its inserted bases. With
    ``phased`` the block's name and the allele's number are given instead.
    """
    v = variants.where(F.length(F.col("alleles")[0]) > 0).select(F.col("chrom").alias("vc"), F.col("pos").alias("vpos"), (F.col("pos") - 1).alias("v0"), F.col("pos").alias("v1"), "alleles", *(["block"] if phased else []))
    rows = df.where(~flags.has(flags.UNMAPPED) & F.col("pos").isNotNull() & F.col("seq").isNotNull() & (F.col("seq") != "*"))
    reads = rows.select(F.col(key).alias("key"), "chrom", flags.read_strand().alias("strand"), "pos", "cigar", "seq", F.inline(cigar.segments(F.col("pos"), F.col("cigar")))).withColumn("from", F.col("lo") - 1)
    hit = intervals.overlap_join(reads, v, ("chrom", "from", "hi"), ("vc", "v0", "v1"), size=VARIANT_BIN)
    # only the end of an allele that reaches beyond its piece of the read needs the whole CIGAR
    offset = F.col("q") + F.col("vpos") - F.col("lo")
    behind = F.col("vpos") + F.length(F.col("alleles")[0])
    after = F.when(behind <= F.col("hi"), F.col("q") + behind - F.col("lo")).otherwise(cigar.read_offset(F.col("pos"), F.col("cigar"), behind))
    carried = F.when(F.col("o2").isNotNull(), F.substring("seq", F.col("o"), F.greatest(F.col("o2") - F.col("o"), F.lit(0)))).otherwise(F.substring("seq", F.col("o"), F.length(F.col("alleles")[0])))
    found = hit.withColumns({"o": offset, "o2": after}).withColumn("own", carried).withColumn("n", F.array_position("alleles", F.col("own"))).where("n > 0")
    if not with_reference:
        found = found.where("n > 1")
    place = F.concat("chrom", F.lit(":"), F.col("vpos").cast("string"), F.col("alleles")[0])
    text = F.when(F.col("n") == 1, F.concat(place, F.lit("="))).otherwise(F.concat(place, F.lit(">"), "own"))
    if phased:
        text = F.concat("block", F.lit(":"), (F.col("n") - 1).cast("string"))
    return found.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set(F.concat(text, F.lit("/"), "strand"))), ";").alias("vr")).withColumnRenamed("key", key)


def keep_annotated(df: DataFrame, names: Sequence[str] = ("GN",)) -> DataFrame:
    """Only the reads that carry one of the annotation tags."""
    found = F.lit(False)
    for n in names:
        found |= tag(n).isNotNull()
    return df.where(found)
