"""Long exact spans shared between records (problem 4).

Every run of ``width`` consecutive units of a record is hashed (128 bits, rolled with numpy over Arrow batches), the
runs are joined globally on the hash, and what repeated runs cover is reported. For sequences the unit is the
character; all members of a repeated run are covered, not only the later ones, since each record's shared part is asked.

Scale: the runs are first told apart by their anchor, the least hash among the pieces of half the width inside a run.
Equal runs have equal anchors, and neighbouring runs mostly share one, so about a tenth as many anchors as runs travel,
and only runs whose anchor two sources have are hashed and joined themselves. Anchors and hashes are pre-aggregated to
(count, smallest source, largest source) before they travel, so what occurs everywhere costs one row a task. Those that
hold more than a fixed share of all runs are a bounded number by construction; they are broadcast to salt their
occurrences, so that no task gets a whole hot run. No pairs are formed anywhere, and nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellspindle.session import materialize, spread

KNOWN = -(2**63)  # the source of every known sequence
BLOCK = 1 << 18  # units hashed at once
HEAVY_SHARE = 16_384
RUNS = "h1 long, h2 long, src long, pos int"
ANCHORS = "anchor long, src long, lo int, text string"


def _mixed(codes: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64 finaliser: a 64-bit value per unit."""
    x = codes + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RunHasher:
    """Hashes of all runs of ``width`` units of a block, by a prefix sum modulo 2**64."""

    # Two odd multipliers, and the seeds of the units' values.
    LANES = ((0x9E3779B97F4A7C15, 0x51ED270B), (0xC2B2AE3D27D4EB4F, 0x2545F491))

    def __init__(self, width: int, longest: int):
        self.width = width
        n = longest + 1
        self.up, self.down = [], []
        for base, _ in self.LANES:
            inverse = pow(base, -1, 1 << 64)
            for out, b in ((self.up, base), (self.down, inverse)):
                powers = np.full(n, b, np.uint64)
                powers[0] = 1
                out.append(np.cumprod(powers, dtype=np.uint64))

    def __call__(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, w = len(codes), self.width
        hashes = []
        for lane, (_, seed) in enumerate(self.LANES):
            prefix = np.zeros(n + 1, np.uint64)
            np.cumsum(_mixed(codes, seed) * self.up[lane][:n], out=prefix[1:])
            rolled = (prefix[w:] - prefix[:-w]) * self.down[lane][: n - w + 1]
            hashes.append(_mixed(rolled, 0).view(np.int64))
        return hashes[0], hashes[1]


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every ``n`` consecutive values."""
    size = 1
    while 2 * size <= n:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (n - size)], values[n - size :]) if n > size else values


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(texts, sources, offsets) of about BLOCK units; a very long text comes in overlapping pieces."""
    for batch in batches:
        texts: list[str] = []
        sources: list[int] = []
        offsets: list[int] = []
        held = 0
        for source, text, begin in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            for lo in range(0, len(text) - width + 1, BLOCK):
                piece = text[lo : lo + BLOCK + width - 1]
                texts.append(piece)
                sources.append(source)
                offsets.append(begin + lo)
                held += len(piece)
                if held >= BLOCK:
                    yield texts, np.array(sources, np.int64), np.array(offsets, np.int64)
                    texts, sources, offsets, held = [], [], [], 0
        if texts:
            yield texts, np.array(sources, np.int64), np.array(offsets, np.int64)


def _places(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of all texts, and of each run its text, its place among the units and its place in the text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    runs = lengths - width + 1
    of = np.repeat(np.arange(len(texts)), runs)
    step = np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)
    return codes, of, (np.cumsum(lengths) - lengths)[of] + step, step


def _run_rows(width: int):
    """(h1, h2, src, pos) of every run."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = RunHasher(width, 2 * BLOCK + width)
        for texts, sources, offsets in _pieces(batches, width):
            codes, of, at, step = _places(texts, width)
            h1, h2 = hasher(codes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1[at]), pa.array(h2[at]), pa.array(sources[of]), pa.array((step + offsets[of]).astype(np.int32))], names=["h1", "h2", "src", "pos"]
            )

    return rows


def _anchor_rows(width: int, with_text: bool):
    """(anchor, src, lo, text): stretches of runs that follow each other and have one anchor; the text covers them."""
    half = (width + 1) // 2

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = RunHasher(half, 2 * BLOCK + width)
        for texts, sources, offsets in _pieces(batches, width):
            codes, of, at, step = _places(texts, width)
            anchor = _least(hasher(codes)[0], width - half + 1)[at]
            first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])]))
            arrays = [pa.array(anchor[first]), pa.array(sources[of[first]])]
            if with_text:
                last = np.concatenate([first[1:], [len(of)]]) - 1
                lo, hi = step[first], step[last] + width
                cut = [texts[i][a:b] for i, a, b in zip(of[first].tolist(), lo.tolist(), hi.tolist(), strict=True)]
                arrays += [pa.array((lo + offsets[of[first]]).astype(np.int32)), pa.array(cut, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "src", "lo", "text"][: len(arrays)])

    return rows


def _held_twice(keyed: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, n) of the keys that two sources have, written once."""
    both = keyed.groupBy(*keys).agg(F.count("*").alias("n"), F.min("src").alias("a"), F.max("src").alias("b")).where("a < b")
    return materialize(both.select(*keys, "n"), label)


def _of_shared(rows: DataFrame, shared: DataFrame, keys: list[str], heavy: float, salts: int) -> DataFrame:
    """The rows whose keys are shared; keys held more than ``heavy`` times are spread over ``salts`` tasks."""
    hot = F.broadcast(shared.where(F.col("n") > heavy).select(*keys, F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(*[c for c in rows.columns if c not in keys]), F.lit(salts))).otherwise(0).cast("int")
    spread = F.when(F.col("n") > heavy, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted = rows.join(hot, keys, "left").withColumn("salt", salt).drop("hot")
    return salted.join(shared.select(*keys, F.explode(spread).alias("salt")), [*keys, "salt"], "left_semi").drop("salt", *keys)


def shared_spans(
    df: DataFrame, record_id: Column, text: Column, known: DataFrame | None = None, known_text: str = "dict", width: int = 40, salts: int = 32
) -> DataFrame:
    """(record_id, lo, hi): the maximal stretches of each record that lie in runs of ``width`` characters found elsewhere.

    Elsewhere is a record of another id, or a text of ``known``. Characters are compared exactly.
    Defined cases: null and short texts have no runs; a null id is no record; rows repeated under one id are one record;
    a very long text is hashed in overlapping pieces; empty tables give no rows; clashing column names do no harm.
    """
    longer = lambda d: d.where(F.length("text") >= width).select("src", "text", F.lit(0).alias("lo"))
    sources = longer(df.select(record_id.cast("bigint").alias("src"), text.alias("text")).where("src is not null"))
    if known is not None:
        sources = sources.unionAll(longer(known.select(F.lit(KNOWN).cast("bigint").alias("src"), known[known_text].alias("text"))))
    sources = spread(sources)
    heavy = (sources.agg(F.sum(F.length("text") - (width - 1))).first()[0] or 0) / HEAVY_SHARE
    anchors = _held_twice(sources.mapInArrow(_anchor_rows(width, False), "anchor long, src long"), ["anchor"], "anchors")
    stretches = sources.mapInArrow(_anchor_rows(width, True), ANCHORS)
    candidates = materialize(_of_shared(stretches, anchors, ["anchor"], heavy, salts).select("src", "text", "lo"), "stretches")
    runs = candidates.mapInArrow(_run_rows(width), RUNS)
    shared = _held_twice(runs, ["h1", "h2"], "runs")
    hits = _of_shared(runs.where(F.col("src") != KNOWN), shared, ["h1", "h2"], heavy, salts).select("src", "pos")
    return _covered(hits, width)


def _covered(hits: DataFrame, width: int) -> DataFrame:
    """Islands of the positions covered by runs; a record's runs are bounded by its length."""
    order = Window.partitionBy("src").orderBy("pos")
    fresh = F.coalesce(F.col("pos") - F.lag("pos").over(order) > width, F.lit(True)).cast("int")
    return (
        hits.withColumn("fresh", fresh)
        .withColumn("island", F.sum("fresh").over(order))
        .groupBy("src", "island")
        .agg(F.min("pos").alias("lo"), (F.max("pos") + width).cast("int").alias("hi"))
        .select(F.col("src").alias("record_id"), "lo", "hi")
    )


def read_spans(reads: DataFrame, known: DataFrame) -> DataFrame:
    """(read_id, lo, hi) of the reads' stretches of 40 or more characters held elsewhere."""
    return shared_spans(reads, reads["read_id"], reads["seq"], known).withColumnRenamed("record_id", "read_id")


def shared_part(reads: DataFrame, known: DataFrame) -> DataFrame:
    """(read_id, n_chars, n_shared) of every read with a sequence, longest sequence first among rows of one id."""
    held = read_spans(reads, known).groupBy("read_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("n"))
    sizes = reads.where("read_id is not null").groupBy("read_id").agg(F.max(F.length("seq")).alias("n_chars"))
    return sizes.join(held, "read_id", "left").select("read_id", "n_chars", F.coalesce("n", F.lit(0)).alias("n_shared"))
