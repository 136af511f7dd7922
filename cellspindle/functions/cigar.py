"""CIGAR expressions. Positions are 1-based; ranges are closed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = ("M", "D", "N", "=", "X")
ALIGNED = ("M", "=", "X")


def operations(cigar: Column) -> Column:
    """array<struct<n int, op string>>; empty for `*`, null for null."""
    return F.transform(
        F.regexp_extract_all(cigar, F.lit("[0-9]+[MIDNSHPX=]"), F.lit(0)),
        lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("n"), F.substring(x, -1, 1).alias("op")),
    )


def reference_length(cigar: Column) -> Column:
    return F.aggregate(operations(cigar), F.lit(0), lambda s, o: s + F.when(o["op"].isin(*REFERENCE), o["n"]).otherwise(0))


def end_position(pos: Column, cigar: Column) -> Column:
    """Last reference position of the alignment."""
    return pos + reference_length(cigar) - 1


def _ranges(pos: Column, cigar: Column, breaks: tuple[str, ...], extends: tuple[str, ...]) -> Column:
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    flush = lambda a: F.when(a["at"] > a["lo"], F.concat(a["out"], F.array(F.struct(a["lo"], (a["at"] - 1).alias("hi"))))).otherwise(a["out"])
    state = lambda at, lo, out: F.struct(at.cast("int").alias("at"), lo.cast("int").alias("lo"), out.cast("array<struct<lo:int,hi:int>>").alias("out"))
    step = lambda a, o: (
        F.when(o["op"].isin(*breaks), state(a["at"] + o["n"], a["at"] + o["n"], flush(a)))
        .when(o["op"].isin(*extends), state(a["at"] + o["n"], a["lo"], a["out"]))
        .otherwise(a)
    )
    return F.aggregate(operations(cigar), state(pos, pos, none), step, flush)


def blocks(pos: Column, cigar: Column) -> Column:
    """Ranges of a read between skips: M, =, X and D extend a block, N ends it, I, S, H and P do not count."""
    return _ranges(pos, cigar, ("N",), ("M", "=", "X", "D"))


def covered(pos: Column, cigar: Column) -> Column:
    """Ranges of aligned bases: deletions and skips are not covered."""
    return _ranges(pos, cigar, ("N", "D"), ALIGNED)


def segments(pos: Column, cigar: Column) -> Column:
    """array<struct<lo, hi, q>>: ranges of bases aligned one to one, with the 1-based offset in the read of their first base."""
    none = F.array().cast("array<struct<lo:int,hi:int,q:int>>")
    state = lambda r, q, out: F.struct(r.cast("int").alias("r"), q.cast("int").alias("q"), out.alias("out"))
    piece = lambda a, o: F.array(F.struct(a["r"].alias("lo"), (a["r"] + o["n"] - 1).cast("int").alias("hi"), a["q"].alias("q")))
    step = lambda a, o: (
        F.when(o["op"].isin(*ALIGNED), state(a["r"] + o["n"], a["q"] + o["n"], F.when(o["n"] > 0, F.concat(a["out"], piece(a, o))).otherwise(a["out"])))
        .when(o["op"].isin("D", "N"), state(a["r"] + o["n"], a["q"], a["out"]))
        .when(o["op"].isin("I", "S"), state(a["r"], a["q"] + o["n"], a["out"]))
        .otherwise(a)
    )
    return F.aggregate(operations(cigar), state(pos, F.lit(1), none), step, lambda a: a["out"])


def read_offset(pos: Column, cigar: Column, at: Column) -> Column:
    """1-based offset in the read of reference position ``at``; null where no base is aligned to it."""
    state = lambda r, q, hit: F.struct(r.cast("int").alias("r"), q.cast("int").alias("q"), hit.cast("int").alias("hit"))
    inside = lambda a, o: (at >= a["r"]) & (at < a["r"] + o["n"])
    step = lambda a, o: (
        F.when(o["op"].isin(*ALIGNED), state(a["r"] + o["n"], a["q"] + o["n"], F.when(inside(a, o), a["q"] + at - a["r"]).otherwise(a["hit"])))
        .when(o["op"].isin("D", "N"), state(a["r"] + o["n"], a["q"], a["hit"]))
        .when(o["op"].isin("I", "S"), state(a["r"], a["q"] + o["n"], a["hit"]))
        .otherwise(a)
    )
    return F.aggregate(operations(cigar), state(pos, F.lit(1), F.lit(None)), step, lambda a: a["hit"])
