"""Raw SAM lines: valid rows, and apart from them the failing lines with their reason (problem 2).

Every column is loaded as nullable text; casts and constraints are evaluated as columnar rules whose names fill an
error array per line, and lines are split by whether that array is empty. All of it is built-in expressions.

Columns are parted by tabs. A column other than the 11th that begins with a double quote runs to its closing quote.
Lines without such a column (almost all) are split plainly; the others go through a tokenising pattern whose repeats
are possessive, so very long lines neither backtrack nor overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")

# The patterns of a record line.
HEADER = r"\A@[A-Z]{2}\t"
COLUMN = r'(?:"(?:[^"]|"")*+"(?=\t|\z)|(?!")[^\t]*+)'
WELL_QUOTED = rf"\A(?:(?:{COLUMN}\t){{10}}[^\t]*+(?:\t{COLUMN})*+|{COLUMN}(?:\t{COLUMN}){{0,9}}+)\z"
HAS_QUOTED = r'(?:\A|\t)"'
NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
PATTERNS = {
    "qname": r"\A[!-?A-~]{1,254}\z",
    "digits": r"\A[0-9]++\z",
    "tlen": r"\A-?[0-9]++\z",
    "cigar": r"\A(?:\*|(?:[0-9]++[MIDNSHPX=])++)\z",
    "seq": r"\A(?:\*|[A-Za-z=.]++)\z",
    "qual": r"\A[!-~]++\z",
    "tag": rf"\A[A-Za-z][A-Za-z0-9]:(?:A:[!-~]|i:[-+]?[0-9]++|f:{NUMBER}|Z:[ -~]*+|H:(?:[0-9A-Fa-f]{{2}})*+|B:[cCsSiIf](?:,{NUMBER})++)\z",
}


def _quoted_columns(line: Column) -> Column:
    head = F.regexp_extract(line, rf"\A(?:{COLUMN}\t){{10}}", 0)
    rest = F.substring(line, F.length(head) + 1, F.length(line))
    eleventh = F.regexp_extract(rest, r"\A[^\t]*+", 0)
    tail = F.substring(rest, F.length(eleventh) + 1, F.length(rest))
    bare = lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    first = F.transform(F.regexp_extract_all(head, F.lit(rf"({COLUMN})\t"), F.lit(1)), bare)
    last = F.transform(F.regexp_extract_all(tail, F.lit(rf"\t({COLUMN})"), F.lit(1)), bare)
    return F.when(F.length(head) > 0, F.concat(first, F.array(eleventh), last)).otherwise(
        F.transform(F.regexp_extract_all(F.concat(line, F.lit("\t")), F.lit(rf"({COLUMN})\t"), F.lit(1)), bare)
    )


def _reference_names(lines: DataFrame) -> DataFrame:
    """Distinct (file, name) of the SN fields of the @SQ lines."""
    return (
        lines.where(F.col("line").startswith("@SQ\t"))
        .select(F.col("file").alias("sn_file"), F.explode(F.split("line", "\t")).alias("field"))
        .where(F.col("field").startswith("SN:"))
        .select("sn_file", F.expr("substring(field, 4)").alias("sn"))
        .distinct()
    )


def _with_known(records: DataFrame, names: DataFrame, column: str, flag: str, salts: int) -> DataFrame:
    """Left join on (file, name); ``salts`` > 1 splits a hot file over that many tasks."""
    right = names.select(F.col("sn_file"), F.col("sn"), F.lit(True).alias(flag))
    on = [F.col("file").eqNullSafe(F.col("sn_file")), F.col(column) == F.col("sn")]
    if salts > 1:
        right = right.withColumn("sn_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        records = records.withColumn("salt", F.pmod(F.xxhash64("line"), F.lit(salts)).cast("int"))
        on.append(F.col("salt") == F.col("sn_salt"))
    else:
        right = F.broadcast(right)
    return records.join(right, on, "left").drop("sn_file", "sn", "sn_salt", "salt")


def check_lines(
    df: DataFrame, line_id: str = "line_id", file_id: str = "file_id", text: str = "str", broadcast_names: int = 200_000, salts: int = 64
) -> DataFrame:
    """Every record line with its columns as text, its tag columns, and ``errors`` (empty for a valid line).

    Result: line_id, file_id, line, the eleven fields, tags (array of text), errors (array of rule names).
    Header lines are left out; they only give the reference names of their file. The distinct names are counted before
    they are broadcast; above ``broadcast_names`` the lookup is a join salted ``salts`` ways instead.
    Defined cases: a null line has too few columns (`columns`), as has an empty one; a null file is a file of its own;
    repeated lines are judged each time; empty table: no rows; other columns of ``df`` are not looked at.
    """
    lines = df.select(df[line_id].alias("id"), df[file_id].alias("file"), F.regexp_replace(df[text], r"\r\z", "").alias("line"))
    names = _reference_names(lines)
    small = names.limit(broadcast_names + 1).count() <= broadcast_names
    c = {f: F.get("cols", F.lit(i)) for i, f in enumerate(FIELDS)}
    records = (
        lines.where(~F.coalesce(F.col("line").rlike(HEADER), F.lit(False)))
        .withColumn("quoted", F.coalesce(F.col("line").rlike(HAS_QUOTED), F.lit(False)))
        .withColumn("torn", F.col("quoted") & ~F.col("line").rlike(WELL_QUOTED))
        .withColumn("cols", F.when(F.col("torn"), None).when(F.col("quoted"), _quoted_columns(F.col("line"))).otherwise(F.split("line", "\t", -1)))
        .withColumn("short", ~F.col("torn") & (F.coalesce(F.size("cols"), F.lit(0)) < 11))
        .select("id", "file", "line", "torn", "short", *[v.alias(f) for f, v in c.items()], F.expr("slice(cols, 12, greatest(size(cols) - 11, 0))").alias("tags"))
    )
    for column, flag in (("rname", "rname_known"), ("rnext", "rnext_known")):
        records = _with_known(records, names, column, flag, 1 if small else salts)
    errors = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in _value_rules().items()]))
    return records.select(
        F.col("id").alias("line_id"),
        F.col("file").alias("file_id"),
        "line",
        *FIELDS,
        "tags",
        F.when(F.col("torn"), F.array(F.lit("quoting"))).when(F.col("short"), F.array(F.lit("columns"))).otherwise(errors).alias("errors"),
    )


def _value_rules() -> dict[str, Column]:
    """Rule name -> whether the column's value holds."""
    like = lambda f, p: F.col(f).rlike(PATTERNS[p])
    whole = lambda f, top: like(f, "digits") & F.expr(f"try_cast({f} as bigint)").between(0, top)
    top = 2**31 - 1
    used = F.aggregate(
        F.regexp_extract_all("cigar", F.lit("([0-9]+)[MIS=X]"), F.lit(1)), F.lit(0.0), lambda a, n: a + F.coalesce(n.try_cast("double"), F.lit(float("inf")))
    )
    return {
        "qname": like("qname", "qname"),
        "flag": whole("flag", 65535),
        "rname": (F.col("rname") == "*") | F.coalesce("rname_known", F.lit(False)),
        "pos": whole("pos", top),
        "mapq": whole("mapq", 255),
        "cigar": like("cigar", "cigar"),
        "rnext": F.col("rnext").isin("*", "=") | F.coalesce("rnext_known", F.lit(False)),
        "pnext": whole("pnext", top),
        "tlen": like("tlen", "tlen") & F.expr("try_cast(tlen as bigint)").between(-top, top),
        "seq": like("seq", "seq"),
        "qual": (F.col("qual") == "*") | (like("qual", "qual") & (F.col("seq") != "*") & (F.length("seq") == F.length("qual"))),
        "cigar_length": (F.col("cigar") == "*") | (F.col("seq") == "*") | (used == F.length("seq")),
        "tags": F.forall("tags", lambda t: t.rlike(PATTERNS["tag"])),
    }


def valid_rows(checked: DataFrame) -> DataFrame:
    """The lines without errors, cast to the types of a SAM row."""
    ints = {"flag", "pos", "mapq", "pnext", "tlen"}
    return checked.where(F.size("errors") == 0).select(
        "line_id", "file_id", *[F.expr(f"try_cast({f} as int)").alias(f) if f in ints else F.col(f) for f in FIELDS], "tags"
    )


def failed_rows(checked: DataFrame) -> DataFrame:
    """The failing lines: line_id, file_id, line, reason (`quoting`, `columns` or `value`) and the rules that failed."""
    first = F.element_at("errors", 1)
    return checked.where(F.size("errors") > 0).select(
        "line_id", "file_id", "line", F.when(first.isin("quoting", "columns"), first).otherwise(F.lit("value")).alias("reason"), "errors"
    )


def failure_report(checked: DataFrame, summary: DataFrame) -> DataFrame:
    """Per file of ``summary``: lines handed in now, lines that failed now, and what the earlier run reported."""
    now = checked.groupBy("file_id").agg(F.count("*").alias("n_lines"), F.count_if(F.size("errors") > 0).alias("n_failed"))
    old = summary.select("file_id", F.col("n_failed_to_parse").alias("n_reported"))
    return old.join(now, "file_id", "left").select("file_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_failed", F.lit(0)).alias("n_failed"), "n_reported")
