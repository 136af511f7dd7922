"""Barcode and read extraction by position: rule strings and JSON read structures."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellspindle.functions import seq, tags
from cellspindle.operators import whitelist


@dataclass(frozen=True)
class Segment:
    tag: str
    mate: int
    start: int  # 1-based
    end: int | None
    listed: str | None = None
    corrected: str | None = None
    mismatches: int = 0
    method: str = "mask"
    quality: str | None = None
    kind: str | None = None

    def of(self, kind: str) -> Column:
        column = F.col(f"r{self.mate}_{kind}")
        length = F.lit(self.end - self.start + 1) if self.end else F.greatest(F.length(column) - self.start + 1, F.lit(0))
        return F.substring(column, F.lit(self.start), length)


_LOCATION = re.compile(r"R([1-4]):(\d+)-(\d*)")


def _location(text: str) -> tuple[int, int, int | None]:
    m = _LOCATION.fullmatch(text.strip())
    if not m or int(m[2]) < 1 or (m[3] and int(m[3]) < int(m[2])):
        raise ValueError(f"not a location: {text!r}")
    return int(m[1]), int(m[2]), int(m[3]) if m[3] else None


def parse_rules(rules: str) -> list[Segment]:
    """Segments of `TAG,R1:a-b[,whitelist[,CORRECTED[,mismatches]]]`, parted by semicolons."""
    out = []
    for rule in filter(None, (r.strip() for r in rules.split(";"))):
        f = [x.strip() for x in rule.split(",")] + [""] * 3
        out.append(Segment(f[0], *_location(f[1]), f[2] or None, f[3] or None, int(f[4] or 0)))
    return out


def lenient_json(text: str) -> dict:
    """JSON with comments and trailing commas."""
    keep = r'("(?:\\.|[^"\\])*")'
    text = re.sub(keep + r"|//[^\n]*|/\*.*?\*/|#[^\n]*", lambda m: m[1] or " ", text, flags=re.S)
    return json.loads(re.sub(keep + r"|,(?=\s*[}\]])", lambda m: m[1] or "", text))


def structure_segments(config: dict) -> tuple[list[Segment], dict[str, list[str]]]:
    """Segments and inline whitelists of a JSON read structure.

    Keys: `cell barcode` (location, distance, white list), `UMI`, `sample barcode`, `read 1`, `read 2`, with the tag
    names in `cell barcode tag`, `cell barcode raw tag`, `UMI tag` and `sample barcode tag`; the base qualities go to the
    tags in `cell barcode raw qual tag`, `sample barcode raw qual tag` and `UMI qual tag`, where given.
    """
    segments, lists = [], {}
    for kind, fallback in (("cell barcode", "CB"), ("sample barcode", "SB"), ("UMI", "UR")):
        parts = config.get(kind) or []
        name = config.get(f"{kind} tag", fallback)
        quality = config.get(f"{kind} raw qual tag") or config.get(f"{kind} qual tag")
        for i, part in enumerate(parts if isinstance(parts, list) else [parts]):
            listed = part.get("white list")
            if listed:
                lists[f"{kind}/{i}"] = listed
            raw = config.get(f"{kind} raw tag", "CR" if listed and name == "CB" else name)
            segments.append(
                Segment(raw if listed else name, *_location(part["location"]), f"{kind}/{i}" if listed else None, name if listed else None, int(part.get("distance", 0)), "edit" if int(part.get("distance", 0)) > 1 else "mask", quality, kind)
            )
    for mate in (1, 2):
        if part := config.get(f"read {mate}"):
            segments.append(Segment(f"R{mate}", *_location(part["location"])))
    return segments, lists


def apply_segments(reads: DataFrame, segments: list[Segment], lists: Callable[[str], DataFrame], least_quality: float = 0, drop_n: bool = False, keep_failed: bool = False, run_code: str | None = None, q30: bool = False) -> DataFrame:
    """(name, seq, qual[, seq2, qual2], status[, q30]) of raw reads (name, r1_seq, r1_qual, ...).

    Segments of one tag are joined in order. A corrected tag is set only if all its segments match their lists, and a
    read with a segment that fails is dropped, or with ``keep_failed`` kept with status `failed`. ``status`` is `exact`
    if every listed segment matched exactly, else `corrected`. ``least_quality`` is the mean quality of the output read,
    ``drop_n`` drops output reads with an N. ``run_code`` is appended to cell barcodes as `-code`. ``q30`` adds the counts
    that ``quality_report`` sums up.
    """
    rows = reads
    plain: dict[str, list[Column]] = {}
    fixed: dict[str, list[Column]] = {}
    good, same = F.lit(True), F.lit(True)
    outputs: dict[str, Segment] = {}
    scores: dict[str, list[Column]] = {}
    for i, s in enumerate(segments):
        if re.fullmatch(r"R[12]", s.tag):
            outputs[s.tag] = s
            continue
        rows = rows.withColumn(f"_s{i}", s.of("seq"))
        plain.setdefault(s.tag, []).append(F.col(f"_s{i}"))
        if s.quality:
            scores.setdefault(s.quality, []).append(s.of("qual"))
        if s.listed:
            if s.method == "edit":
                found = whitelist.edit_distance(rows.select(f"_s{i}"), lists(s.listed), s.mismatches, "both").select(F.col("query").alias("_q"), F.col("entry").alias(f"_c{i}"))
                rows = rows.join(found, F.col(f"_s{i}") == F.col("_q"), "left").drop("_q")
            else:
                rows = whitelist.corrected(rows, f"_s{i}", lists(s.listed), s.mismatches, f"_c{i}")
            good &= F.col(f"_c{i}").isNotNull()
            same &= F.coalesce(F.col(f"_c{i}") == F.col(f"_s{i}"), F.lit(False))
            if s.corrected:
                fixed.setdefault(s.corrected, []).append(F.col(f"_c{i}"))
    named = {t: F.nullif(F.concat(*c), F.lit("")) for t, c in plain.items()} | {t: F.concat(*c) for t, c in fixed.items()}
    if run_code:
        cells = {s.corrected or s.tag for s in segments if s.kind == "cell barcode"} or {"CB"}
        named |= {t: F.concat(named[t], F.lit(f"-{run_code}")) for t in cells & set(named)}
    named |= {t: F.nullif(F.concat(*c), F.lit("")) for t, c in scores.items()}
    main = outputs.get("R1") or Segment("R1", 1, 1, None)
    out = {"name": tags.name_with_tags(tags.read_id(F.col("name")), named), "seq": main.of("seq"), "qual": main.of("qual")}
    if second := outputs.get("R2"):
        out |= {"seq2": second.of("seq"), "qual2": second.of("qual")}
    counts = []
    if q30:
        parts = [(s.kind or s.tag, s) for s in segments if s.tag not in outputs] + [("reads", s) for s in (main, *([second] if second else []))]
        counts = [F.array(*[F.struct(F.lit(k).alias("part"), *_bases(s.of("seq"), s.of("qual"))) for k, s in parts]).alias("q30")]
    result = rows.select(*[c.alias(n) for n, c in out.items()], F.when(~good, "failed").when(same, "exact").otherwise("corrected").alias("status"), *counts)
    if least_quality:
        result = result.where(F.coalesce(seq.quality_mean(F.col("qual")), F.lit(0.0)) >= least_quality)
    if drop_n:
        result = result.where(~F.upper("seq").contains("N"))
    return result if keep_failed else result.where("status != 'failed'")


def _bases(bases: Column, qual: Column) -> tuple[Column, Column]:
    """Number of bases, and of those with a phred+33 quality of 30 or more."""
    good = F.length(F.regexp_replace(qual, r"[^?-~]", ""))
    return F.coalesce(F.length(bases), F.lit(0)).alias("bases"), F.coalesce(good, F.lit(0)).alias("good")


def quality_report(parsed: DataFrame) -> DataFrame:
    """(part, bases, q30) of reads parsed with ``q30`` that did not fail: bases, and those of quality 30 or more, of the
    cell barcodes, sample barcodes, UMIs (rule strings: by tag) and reads."""
    rows = parsed.where("status != 'failed'").select(F.inline("q30"))
    return rows.groupBy("part").agg(F.sum("bases").alias("bases"), F.sum("good").alias("q30"))


def parse_report(parsed: DataFrame) -> DataFrame:
    """(status, n) of parsed reads."""
    return parsed.groupBy("status").agg(F.count("*").alias("n"))


# The layout of one kit: two cell barcode segments and a UMI on read 1, and the whole of read 2. Its barcode list is the caller's file.
PRESETS = {"C4": "CR,R1:1-10,cells,CB,1;CR,R1:11-20,cells,CB,1;UR,R1:21-30;R1,R2:1-"}
