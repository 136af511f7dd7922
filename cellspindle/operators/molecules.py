"""Duplicates, UMI correction and fusion candidates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellspindle.functions import flags, seq
from cellspindle.operators.filters import tag


def remove_duplicates(df: DataFrame, names: Sequence[str] = ("CB", "UR"), order: str = "aln_id") -> DataFrame:
    """One alignment per (chrom, pos, tags): that with the largest quality sum, the first by ``order`` among equals.

    Unmapped rows pass; secondary, supplementary and failed rows and mapped rows that miss a tag are dropped. The winner
    is an aggregate, so a key that holds a third of all rows is reduced on the map side.
    """
    rows = df.where(flags.passes("rmdup"))
    mapped = rows.where(~flags.has(flags.UNMAPPED) & F.col("chrom").isNotNull() & F.col("pos").isNotNull())
    for n in names:
        mapped = mapped.where(tag(n).isNotNull())
    best = F.max_by(F.struct(*df.columns), F.struct(seq.quality_sum(F.col("qual")).alias("q"), F.bitwise_not(F.col(order)).alias("o")))
    kept = mapped.groupBy("chrom", "pos", *[tag(n).alias(f"_t{i}") for i, n in enumerate(names)]).agg(best.alias("_row")).select("_row.*")
    return kept.unionByName(rows.where(flags.has(flags.UNMAPPED)))


def mark_duplicates(df: DataFrame, names: Sequence[str] = ("CB", "UR"), order: str = "aln_id") -> DataFrame:
    """All rows that ``remove_duplicates`` looks at; the losers get the duplicate bit. ``order`` must be unique."""
    keep = remove_duplicates(df, names, order).select(order, F.lit(True).alias("_kept"))
    rows = df.where(flags.passes("rmdup"))
    for n in names:
        rows = rows.where(flags.has(flags.UNMAPPED) | tag(n).isNotNull())
    marked = F.when(F.col("_kept"), F.col("flag")).otherwise(F.coalesce(F.col("flag"), F.lit(0)).bitwiseOR(flags.DUPLICATE))
    return rows.join(keep, order, "left").withColumn("flag", marked).drop("_kept")


def _components(umis: list[str], counts: list[int], distance: int) -> list[str]:
    """For each UMI the best supported one of its single-linkage cluster (ties: the smallest)."""
    parent = list(range(len(umis)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if distance == 1:
        first: dict[tuple[int, str], int] = {}
        for i, u in enumerate(umis):
            for k in range(len(u)):
                j = first.setdefault((k, u[:k] + u[k + 1 :]), i)
                parent[root(i)] = root(j)
    else:
        # pieces: two strings within distance e agree on one of e + 1 slices
        buckets: dict[tuple, list[int]] = {}
        for i, u in enumerate(umis):
            cut = [len(u) * k // (distance + 1) for k in range(distance + 2)]
            for k in range(distance + 1):
                mine = buckets.setdefault((len(u), k, u[cut[k] : cut[k + 1]]), [])
                for j in mine:
                    if root(i) != root(j) and sum(a != b for a, b in zip(u, umis[j], strict=True)) <= distance:
                        parent[root(i)] = root(j)
                mine.append(i)
    best: dict[int, int] = {}
    for i in range(len(umis)):
        r = root(i)
        if r not in best or (-counts[i], umis[i]) < (-counts[best[r]], umis[best[r]]):
            best[r] = i
    return [umis[best[root(i)]] for i in range(len(umis))]


def umi_clusters(df: DataFrame, block: Sequence[str] = ("CB", "GN"), umi: str = "UR", distance: int = 1) -> DataFrame:
    """(block tags in lower case, umi, n, corrected): UMIs of a block joined by single linkage within ``distance``.

    Reads are first reduced to (block, UMI, count), so a block's size is bounded by its distinct UMIs; blocks of one UMI
    never leave the JVM.
    """
    keys = [b.lower() for b in block]
    rows = df.where(flags.passes("correct")).select(*[tag(b).alias(k) for b, k in zip(block, keys, strict=True)], tag(umi).alias("umi")).dropna()
    counts = rows.groupBy(*keys, "umi").agg(F.count("*").alias("n")).withColumn("of", F.count("*").over(Window.partitionBy(*keys)))

    schema = ", ".join([*[f"{k} string" for k in keys], "umi string", "n long", "corrected string"])
    several = counts.where("of > 1").drop("of").repartition(*keys).sortWithinPartitions(*keys)
    done = several.mapInArrow(_cluster_rows(len(keys), distance), schema)
    return done.unionByName(counts.where("of = 1").drop("of").withColumn("corrected", F.col("umi")))


def _cluster_rows(n_keys: int, distance: int):
    """Blocks of sorted partitions, one after the other; a block may span batches."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        key: tuple | None = None
        umis: list[str] = []
        counts: list[int] = []
        out: list[tuple] = []

        def close() -> None:
            if key is not None:
                out.extend((*key, u, n, c) for u, n, c in zip(umis, counts, _components(umis, counts, distance), strict=True))

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.string()] * (n_keys + 1) + [pa.int64(), pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=[*names, "corrected"])

        for batch in batches:
            names = batch.schema.names
            for *k, umi, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if tuple(k) != key:
                    close()
                    key, umis, counts = tuple(k), [], []
                umis.append(umi)
                counts.append(n)
            if out:
                yield batch_of()
                out = []
        close()
        if out:
            yield batch_of()

    return rows


def one_gene_per_umi(clusters: DataFrame, cell: str = "cb", gene: str = "gn") -> DataFrame:
    """Of a corrected UMI seen in several genes of a cell only the gene with most reads stays; equal ones all go."""
    support = clusters.groupBy(cell, gene, "corrected").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(cell, "corrected")
    ranked = support.withColumn("top", F.max("n").over(own)).where("n = top").withColumn("ties", F.count("*").over(own))
    return ranked.where("ties = 1").select(cell, gene, "corrected", "n")


def correct_umis(df: DataFrame, block: Sequence[str] = ("CB", "GN"), umi: str = "UR", new: str = "UB", distance: int = 1) -> DataFrame:
    """The alignments with the corrected UMI in tag ``new``; rows outside all blocks stay as they are."""
    keys = [b.lower() for b in block]
    found = umi_clusters(df, block, umi, distance).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("umi").alias("_umi"), "corrected")
    on = [tag(b) == F.col(f"_{k}") for b, k in zip(block, keys, strict=True)] + [tag(umi) == F.col("_umi")]
    entry = F.when(F.col("corrected").isNotNull() & flags.passes("correct"), F.create_map(F.lit(new), F.col("corrected"))).otherwise(F.create_map().cast("map<string,string>"))
    joined = df.join(found, on, "left")
    return joined.withColumn("tags", F.map_concat(F.map_filter("tags", lambda k, _: k != new), entry)).select(*df.columns)


def fusion_candidates(df: DataFrame, cell: str = "CB", umi: str = "UR", gene: str = "GN", most: int = 3) -> DataFrame:
    """(cb, umi, genes, pairs) of molecules with 2 to ``most`` distinct genes; reads with several genes do not count.

    A molecule's genes are cut off at ``most`` + 1 distinct ones before they are gathered, since more make it no candidate.
    """
    rows = df.where(flags.passes("pick")).select(tag(cell).alias("cb"), tag(umi).alias("umi"), tag(gene).alias("gene")).dropna().where(~F.col("gene").contains(";"))
    seen = rows.distinct()
    sizes = seen.groupBy("cb", "umi").agg(F.count("*").alias("k")).where((F.col("k") >= 2) & (F.col("k") <= most))
    genes = seen.join(sizes, ["cb", "umi"]).groupBy("cb", "umi").agg(F.array_sort(F.collect_set("gene")).alias("g"))
    pairs = F.flatten(F.transform("g", lambda a, i: F.transform(F.slice("g", i + 2, F.size("g")), lambda b: F.concat(a, F.lit("|"), b))))
    return genes.select("cb", "umi", F.array_join("g", ";").alias("genes"), F.array_join(pairs, ";").alias("pairs"))


def sort_reads(df: DataFrame, names: Sequence[str], listed: DataFrame | None = None, then: str = "aln_id") -> DataFrame:
    """Reads by the values of their tags in byte order; reads that miss one are left out, as are first tags not listed."""
    rows = df
    for n in names:
        rows = rows.where(tag(n).isNotNull())
    if listed is not None:
        rows = rows.withColumn("_k", tag(names[0])).join(listed.select(F.col(listed.columns[0]).alias("_k")).distinct(), "_k", "left_semi").drop("_k")
    return rows.orderBy(*[tag(n) for n in names], then)
