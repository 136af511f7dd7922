"""Queries of the general data problems (1 to 3) and their SQL."""

from __future__ import annotations

from cellspindle.operators import hot_keys, parse_lines, periods
from cellspindle.session import table

QUERIES = {
    "p1_found": lambda s, d: periods.bed_periods(table(s, d, "bed")),
    "p2_found": lambda s, d: parse_lines.failed_rows(parse_lines.check_lines(table(s, d, "sam_pool"))).select("line_id", "reason"),
    "p2_rows": lambda s, d: parse_lines.valid_rows(parse_lines.check_lines(table(s, d, "sam_pool"))),
    "p2_report": lambda s, d: parse_lines.failure_report(parse_lines.check_lines(table(s, d, "sam_pool")), table(s, d, "summary")),
    "p3_found": lambda s, d: hot_keys.barcode_counts(table(s, d, "alignments")),
    "p3_runs": lambda s, d: _runs(table(s, d, "alignments")),
}


def _runs(a):
    return hot_keys.per_key_runs(a, a["tags"]["CB"], a["aln_id"], 1000)


P1 = """
with iv as (
  select distinct track, chrom, case when strand in ('+', '-') then strand else '.' end as strand, bed_start as s, bed_end as t
  from bed where chrom is not null and bed_start >= 0 and bed_end > bed_start
), reach as (
  select *, max(t) over (partition by track, chrom, strand order by s, t rows between unbounded preceding and 1 preceding) as so_far from iv
), islands as (
  select *, sum(case when so_far is null or s > so_far then 1 else 0 end) over (partition by track, chrom, strand order by s, t rows unbounded preceding) as island from reach
), p as (
  select track, chrom, strand, island, min(s) as lo, max(t) as hi from islands group by 1, 2, 3, 4
)
select track, chrom, strand, 'period' as kind, lo, hi from p
union all
select track, chrom, strand, 'gap' as kind, hi as lo, nxt as hi
from (select *, lead(lo) over (partition by track, chrom, strand order by island) as nxt from p) where nxt is not null
"""

# The patterns of a record line, as RE2 has them (no look-ahead, no possessive repeats).
_Q = r'(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)'
_N = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
_TAG = rf"[A-Za-z][A-Za-z0-9]:(?:A:[!-~]|i:[-+]?[0-9]+|f:{_N}|Z:[ -~]*|H:(?:[0-9A-Fa-f][0-9A-Fa-f])*|B:[cCsSiIf](?:,{_N})+)"
_WHOLE = lambda f, top: f"(regexp_full_match({f}, '[0-9]+') and try_cast({f} as hugeint) <= {top})"

P2_BASE = rf"""
with lines as (
  select line_id, file_id, regexp_replace(str, '\r\z', '') as line from sam_pool
), sn as (
  select distinct file_id, substr(x, 4) as sn from (select file_id, unnest(string_split(line, chr(9))) as x from lines where line like '@SQ' || chr(9) || '%') where x like 'SN:%'
), rec as (
  select *, regexp_full_match(line, '(?s)(?:{_Q}\t){{10}}[^\t]*(?:\t{_Q})*|{_Q}(?:\t{_Q}){{0,9}}') as quoted_well,
    regexp_extract(line, '(?s)^(?:{_Q}\t){{10}}') as head
  from lines where line is null or not regexp_matches(line, '^@[A-Z][A-Z]\t')
), cut as (
  select *, regexp_extract(substr(line, length(head) + 1), '(?s)^[^\t]*') as eleventh from rec
), parts as (
  select line_id, file_id, line, quoted_well, length(head) > 0 as wide, eleventh as qual,
    list_transform(regexp_extract_all(head, '(?s)({_Q})\t', 1), lambda v: case when v like '"%' then replace(substr(v, 2, length(v) - 2), '""', '"') else v end) as c,
    list_transform(regexp_extract_all(substr(line, length(head) + length(eleventh) + 1), '(?s)\t({_Q})', 1), lambda v: case when v like '"%' then replace(substr(v, 2, length(v) - 2), '""', '"') else v end) as tags
  from cut
), named as (
  select line_id, file_id, quoted_well, wide, qual, tags, c[1] as qname, c[2] as flag, c[3] as rname, c[4] as pos, c[5] as mapq, c[6] as cigar, c[7] as rnext, c[8] as pnext, c[9] as tlen, c[10] as seq from parts
), judged as (
  select n.*,
    regexp_full_match(qname, '[!-?A-~]+') and length(qname) <= 254
    and {_WHOLE("flag", 65535)} and {_WHOLE("pos", 2147483647)} and {_WHOLE("mapq", 255)} and {_WHOLE("pnext", 2147483647)}
    and (rname = '*' or a.sn is not null) and (rnext in ('*', '=') or b.sn is not null)
    and regexp_full_match(cigar, '\*|(?:[0-9]+[MIDNSHPX=])+')
    and regexp_full_match(tlen, '-?[0-9]+') and abs(try_cast(tlen as hugeint)) <= 2147483647
    and regexp_full_match(seq, '\*|[A-Za-z=.]+')
    and (qual = '*' or (regexp_full_match(qual, '[!-~]+') and seq <> '*' and length(seq) = length(qual)))
    and (cigar = '*' or seq = '*' or coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MIS=X]', 1), lambda v: try_cast(v as hugeint))), 0) = length(seq))
    and len(list_filter(tags, lambda v: not regexp_full_match(v, '{_TAG}'))) = 0 as good
  from named n left join sn a on a.file_id = n.file_id and a.sn = n.rname left join sn b on b.file_id = n.file_id and b.sn = n.rnext
)
"""

P2 = (
    P2_BASE
    + """
select line_id, case when line_null then 'columns' when not quoted_well then 'quoting' when not wide then 'columns' else 'value' end as reason
from (select *, quoted_well is null as line_null from judged) where line_null or not quoted_well or not wide or not coalesce(good, false)
"""
)

P2_REPORT = (
    P2_BASE
    + """
select s.file_id, coalesce(n_lines, 0) as n_lines, coalesce(n_failed, 0) as n_failed, s.n_failed_to_parse as n_reported
from summary s left join (
  select file_id, count(*) as n_lines, count(*) filter (coalesce(not quoted_well or not wide or not coalesce(good, false), true)) as n_failed from judged group by 1
) j on s.file_id = j.file_id
"""
)

P2_ROWS = (
    P2_BASE
    + """
select line_id, file_id, qname, cast(flag as int) as flag, rname, cast(pos as int) as pos, cast(mapq as int) as mapq, cigar, rnext, cast(pnext as int) as pnext, cast(tlen as int) as tlen, seq, qual, tags
from judged where quoted_well and wide and good
"""
)

SQL = {
    "p1_found": P1,
    "p2_found": P2,
    "p2_rows": P2_ROWS,
    "p2_report": P2_REPORT,
    "p3_found": "select tags['CB'] as cb, count(*) as n_record from alignments where tags['CB'] <> '' group by 1",
    "p3_runs": """
with o as (select tags['CB'] as key, aln_id - lag(aln_id) over (partition by tags['CB'] order by aln_id) as d from alignments where tags['CB'] <> '')
select key, count(*) as n_record, count(*) filter (d > 1000) + 1 as n_run, max(d) as longest_step from o group by 1
""",
}
