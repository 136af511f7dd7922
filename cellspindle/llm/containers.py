"""Filling fixed-capacity containers with whole items (problem 7).

The items' sizes form a histogram of at most ``capacity`` rows, whatever the corpus. On it the configuration linear
program (how many containers to fill in which way) is solved by multiplicative weights: sizes still uncovered gain
weight, and the best configuration under the weights is priced by a knapsack dynamic program over the capacity. The
fractional plan is rounded down, what is left over is planned again, and the last few items are placed best fit.

The plan is applied in parallel: every item gets its rank among the items of its size (counted in salted slices, so a
size that holds a third of all items is no single task), and the rank addresses the container.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellspindle.llm.tokens import TOKENIZER, token_sizes
from cellspindle.session import materialize

CAPACITY = 1024
LEAN = 1.3  # more than in proportion, so that of equally full configurations those of large items come first
Plan = list[tuple[dict[int, int], int]]  # (size -> copies, containers filled so)


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> dict[int, int]:
    """Knapsack with repetition: the most valuable multiset of sizes within the capacity."""
    value = np.zeros(capacity + 1)
    taken = np.zeros(capacity + 1, np.int64)
    gain = np.full(capacity + 1, -np.inf)  # of an item by its size; 0 stands for leaving one unit unused
    fits = sizes <= capacity
    gain[sizes[fits]] = worth[fits]
    for c in range(1, capacity + 1):
        sums = value[c - 1 :: -1] + gain[1 : c + 1] if c > 1 else value[:1] + gain[1:2]
        k = int(sums.argmax())
        value[c] = value[c - 1]
        if sums[k] > value[c]:
            value[c], taken[c] = sums[k], k + 1
    picked: Counter[int] = Counter()
    c = capacity
    while c > 0:
        if taken[c]:
            picked[int(taken[c])] += 1
        c -= max(int(taken[c]), 1)
    return dict(picked)


def _fractional(left: dict[int, int], capacity: int, rounds: int, step: float, rate: float) -> list[tuple[dict[int, int], float]]:
    """Configurations with fractional counts; no size is covered more than once over.

    Every round prices the best configuration under the weights and takes ``step`` of what its scarcest size still
    needs; what a size has been covered lowers its weight by the factor exp(-rate * share).
    """
    sizes = np.array(sorted(left), np.int64)
    need = np.array([left[s] for s in sizes], float)
    covered = np.zeros(len(sizes))
    chosen: dict[tuple, float] = {}
    for _ in range(rounds):
        open_ = np.flatnonzero(covered < 0.999)
        if not len(open_):
            break
        weights = sizes[open_] ** LEAN * np.exp(-rate * (covered[open_] - covered[open_].min()))
        config = best_configuration(sizes[open_], weights, capacity)
        at = np.searchsorted(sizes, list(config))
        copies = np.array(list(config.values()))
        x = max(step * ((1 - covered[at]) * need[at] / copies).min(), min(1.0, (need[at] / copies).min()))
        covered[at] += x * copies / need[at]
        key = tuple(config.items())
        chosen[key] = chosen.get(key, 0) + x
    return [(dict(c), x) for c, x in chosen.items()]


def _best_fit(left: dict[int, int], capacity: int) -> Plan:
    """Largest first, each into the fullest container that still takes it."""
    room: dict[int, list[list[int]]] = {}
    sizes: list[int] = []  # the rooms that are there, ascending
    bins: list[list[int]] = []
    for size in sorted(left, reverse=True):
        for _ in range(left[size]):
            i = bisect_left(sizes, size)
            if i == len(sizes):
                own: list[int] = []
                bins.append(own)
                free = capacity - size
            else:
                own = room[sizes[i]].pop()
                free = sizes[i] - size
                if not room[sizes[i]]:
                    del sizes[i]
            own.append(size)
            if free:
                if not room.setdefault(free, []):
                    insort(sizes, free)
                room[free].append(own)
    return [(dict(Counter(b)), n) for b, n in Counter(tuple(b) for b in bins).items()]


def plan_containers(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 2000, step: float = 1.0, rate: float = 3.0, last: int = 0) -> Plan:
    """A plan that places exactly the histogram's items (sizes 1 to ``capacity``).

    A round that places nothing ends the program: it has closed one size or more with each configuration, so with at
    least as many configurations as sizes the rest has fewer containers' worth of items than there are sizes. Up to
    ``last`` items are left to best fit before that.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    plan: Plan = [({capacity: 1}, left.pop(capacity))] if capacity in left else []
    while sum(left.values()) > last:
        placed = 0
        for config, x in _fractional(left, capacity, rounds, step, rate):
            n = min(int(x), *(left.get(s, 0) // k for s, k in config.items()))
            if n:
                plan.append((config, n))
                placed += n
                for s, k in config.items():
                    left[s] -= k * n
        left = {s: n for s, n in left.items() if n}
        if not placed:
            if rounds >= len(left):
                break
            rounds = len(left)
    return plan + _best_fit(left, capacity)


def _addresses(plan: Plan) -> tuple[dict[int, int], np.ndarray, int]:
    """First rank of each size; segments (first rank, first container, copies a container) by rank; containers."""
    by_size: dict[int, list[tuple[int, int, int]]] = {}
    containers = 0
    for config, n in plan:
        for s, k in config.items():
            by_size.setdefault(s, []).append((n * k, containers, k))
        containers += n
    first, rows, rank = {}, [], 0
    for s in sorted(by_size):
        first[s] = rank
        for items, base, k in by_size[s]:
            rows.append((rank, base, k))
            rank += items
    return first, np.array(rows, np.int64).reshape(-1, 3), containers


def fill_containers(sizes: DataFrame, capacity: int = CAPACITY, slice_rows: int = 200_000) -> DataFrame:
    """(doc_id, piece, size, container) of a table (doc_id, n_tokens).

    An item above the capacity is cut into full pieces and a rest; every other item is one piece. Defined cases: items
    of null, zero or negative size take no space: one row with size 0 and container null; repeated rows are items each;
    a null doc_id is an item like any other; empty table: no rows.
    """
    n = F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0))
    pieces = (
        sizes.select("doc_id", n.alias("n"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity).cast("int") - 1, F.lit(0)))))
        .select("doc_id", "piece", F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("size"))
    )
    items = pieces.where("size > 0")
    histogram = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    first, segments, _ = _addresses(plan_containers(histogram, capacity))
    slices = max(1, sum(histogram.values()) // slice_rows)
    salted = items.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)))
    before = Window.partitionBy("size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("size", "slice").agg(F.count("*").alias("n")).select("size", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("size", "slice").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("own", own).join(offsets, ["size", "slice"])
    table = sizes.sparkSession.sparkContext.broadcast((first, segments))

    def address(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, rows = table.value
        base = np.zeros(capacity + 1, np.int64)
        for s, r in begins.items():
            base[s] = r
        for batch in batches:
            size, rank = (batch.column(i).to_numpy() for i in (2, 3))
            rank = rank + base[size]
            at = np.searchsorted(rows[:, 0], rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(rows[at, 1] + (rank - rows[at, 0]) // rows[at, 2])], names=["doc_id", "piece", "size", "container"]
            )

    placed = ranked.select("doc_id", "piece", "size", (F.col("offset") + F.col("own") - 1).alias("rank")).mapInArrow(
        address, "doc_id long, piece int, size int, container long"
    )
    return placed.unionByName(pieces.where("size = 0").withColumn("container", F.lit(None).cast("bigint")))


def measured_and_packed(df: DataFrame, doc_id: Column, text: Column, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes in tokens, and their containers."""
    sizes = materialize(token_sizes(df, doc_id, text, tokenizer), "token-sizes")
    return sizes, fill_containers(sizes, capacity)


def pack_documents(df: DataFrame, doc_id: Column, text: Column, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Containers of the documents' texts, measured in tokens."""
    return measured_and_packed(df, doc_id, text, capacity, tokenizer)[1]


def plan_checks(sizes: DataFrame, placed: DataFrame, capacity: int = CAPACITY, slack: float = 0.01) -> DataFrame:
    """One row that tells whether a packing keeps its promises; ids must be unique.

    n_document and n_empty (those that take no space) count the input through the packing; n_split counts documents of
    ``capacity`` or less in several pieces, n_overfull containers above it, n_number_missing unused container numbers,
    n_token_lost tokens that are in no container; near_least: no more containers than one plus ``slack`` above the bound.
    """
    rows = materialize(placed, "placed")
    per_doc = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    docs = per_doc.agg(F.count("*").alias("n_document"), F.count_if(F.col("size") == 0).alias("n_empty"), F.count_if((F.col("n") > 1) & (F.col("size") <= capacity)).alias("n_split"), F.coalesce(F.sum("size"), F.lit(0)).alias("placed"))
    filled = rows.where("container is not null").groupBy("container").agg(F.sum("size").alias("size"))
    bins = filled.agg(F.count_if(F.col("size") > capacity).alias("n_overfull"), F.count("*").alias("bins"), (F.coalesce(F.max("container") + 1, F.lit(0)) - F.count("*")).alias("n_number_missing"))
    wanted = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("wanted"))
    least = F.ceil(F.col("wanted") / capacity)
    return docs.crossJoin(bins).crossJoin(wanted).select(  # one row each
        "n_document", "n_empty", F.col("n_split").cast("int"), F.col("n_overfull").cast("int"), F.col("n_number_missing").cast("int"), (F.col("wanted") - F.col("placed")).cast("int").alias("n_token_lost"), (F.col("bins") <= least * (1 + slack) + 1).alias("near_least")
    )


def fill_report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(n_container, n_token, n_least, n_unused): n_least is what no packing can go below."""
    return placed.where("container is not null").agg(
        F.countDistinct("container").alias("n_container"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("n_token"),
        F.ceil(F.coalesce(F.sum("size"), F.lit(0)) / capacity).alias("n_least"),
        (F.countDistinct("container") * capacity - F.coalesce(F.sum("size"), F.lit(0))).alias("n_unused"),
    )
