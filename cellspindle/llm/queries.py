"""Queries of the corpus problems (4 to 8) and their SQL."""

from __future__ import annotations

from secrets import token_bytes

from cellspindle.llm import containers, spans, surrogates, survivors, tokens
from cellspindle.session import table

QUERIES = {
    "p4_found": lambda s, d: spans.read_spans(table(s, d, "read1"), table(s, d, "kmer_idx")),
    "p4_shared": lambda s, d: spans.shared_part(table(s, d, "read1"), table(s, d, "kmer_idx")),
    "p5_found": lambda s, d: survivors.field_sources(table(s, d, "rcd")),
    "p5_survivors": lambda s, d: survivors.survivors(table(s, d, "rcd")),
    "p5_votes": lambda s, d: survivors.voted_values(table(s, d, "rcd")),
    "p6_ids": lambda s, d: _encoded(table(s, d, "documents")),
    "p7_containers": lambda s, d: _packed(table(s, d, "documents")),
    "p8_found": lambda s, d: surrogates.found_spans(_replaced(table(s, d, "documents"), table(s, d, "name_list"))),
    "p8_texts": lambda s, d: _replaced(table(s, d, "documents"), table(s, d, "name_list")).drop("spans"),
    "p7_checks": lambda s, d: _checked(table(s, d, "documents")),
    "p7_report": lambda s, d: containers.fill_report(_packed(table(s, d, "documents"))),
}


def _encoded(docs):
    return tokens.encode_corpus(docs, docs["doc_id"], docs["text"])


def _replaced(docs, names):
    """The secret is the setting spark.cellspindle.surrogateKey; without one, replacements hold for one run only."""
    given = docs.sparkSession.conf.get("spark.cellspindle.surrogateKey", None)
    return surrogates.replace_personal(docs, docs["doc_id"], docs["text"], names, given.encode() if given else token_bytes(32))


def _packed(docs):
    return containers.pack_documents(docs, docs["doc_id"], docs["text"])


def _checked(docs):
    return containers.plan_checks(*containers.measured_and_packed(docs, docs["doc_id"], docs["text"]))


P4 = """
with w as (
  select read_id, i, substr(seq, i + 1, 40) as k from (select read_id, seq, unnest(range(0, length(seq) - 39)) as i from read1 where length(seq) >= 40)
), known as (
  select distinct substr(dict, i + 1, 40) as k from (select dict, unnest(range(0, length(dict) - 39)) as i from kmer_idx where length(dict) >= 40)
), shared as (
  select k from w group by k having min(read_id) <> max(read_id) union select k from known
), hit as (
  select distinct read_id, i from w where k in (select k from shared)
), isl as (
  select *, sum(case when p is null or i - p > 40 then 1 else 0 end) over (partition by read_id order by i rows unbounded preceding) as g
  from (select *, lag(i) over (partition by read_id order by i) as p from hit)
), found as (
  select read_id, cast(min(i) as int) as lo, cast(max(i) + 40 as int) as hi from isl group by read_id, g
)
"""

P5 = """
with m as (
  select rcd_id, chrom, pos, regexp_replace(upper(trim(cb)), '-[0-9]+$', '') as cb, regexp_replace(upper(trim(ur)), '-[0-9]+$', '') as ur,
    mapq, cigar, gn, re, sp, coalesce(checked = 1, false) as c, case when qual >= 0 then qual else -1 end as q, seen_at
  from rcd where flag & 2816 = 0 and chrom is not null and pos is not null and trim(cb) <> '' and trim(ur) <> ''
), r as (
  select *, row_number() over (partition by chrom, pos, cb, ur order by c desc, q desc, seen_at desc nulls last, rcd_id) as rk,
    count(*) over (partition by chrom, pos, cb, ur) as n,
    first_value(rcd_id) over (partition by chrom, pos, cb, ur order by c desc, q desc, seen_at desc nulls last, rcd_id) as keep_id
  from m
), long as (
  select *, 'mapq' as field, cast(mapq as varchar) as v, mapq <> 255 as ok from r where n > 1
  union all select *, 'cigar', cigar, trim(cigar) not in ('', '.', '*', 'NA') from r where n > 1
  union all select *, 'gn', gn, trim(gn) not in ('', '.', '*', 'NA') from r where n > 1
  union all select *, 're', re, trim(re) not in ('', '.', '*', 'NA') from r where n > 1
  union all select *, 'sp', sp, trim(sp) not in ('', '.', '*', 'NA') from r where n > 1
)
"""

SQL = {
    "p4_found": P4 + "select read_id, lo, hi from found",
    "p4_shared": P4
    + """
select r.read_id, r.n_chars, coalesce(f.n, 0) as n_shared
from (select read_id, max(length(seq)) as n_chars from read1 group by 1) r left join (select read_id, sum(hi - lo) as n from found group by 1) f using (read_id)
""",
    "p5_found": P5 + "select keep_id, field, arg_min(rcd_id, rk) as from_id from long where ok group by keep_id, field",
    "p5_survivors": P5
    + """
select chrom, pos, cb, ur, max(n) as n_member, keep_id,
  cast(arg_min(v, rk) filter (ok and field = 'mapq') as int) as mapq, arg_min(v, rk) filter (ok and field = 'cigar') as cigar,
  arg_min(v, rk) filter (ok and field = 'gn') as gn, arg_min(v, rk) filter (ok and field = 're') as re, arg_min(v, rk) filter (ok and field = 'sp') as sp
from long group by chrom, pos, cb, ur, keep_id
""",
    "p5_votes": """
with m as (
  select chrom, pos, regexp_replace(upper(trim(cb)), '-[0-9]+$', '') as cb, regexp_replace(upper(trim(ur)), '-[0-9]+$', '') as ur, mapq, cigar, gn, re, sp,
    (case when qual > 0 then qual else 0 end + 1) * (case when coalesce(checked = 1, false) then 8 else 1 end)
      * cast(pow(2, 4 - coalesce(least(floor(datediff('day', seen_at, max_at) / 32), 4), 4)) as bigint) as vote
  from rcd, (select max(seen_at) as max_at from rcd)
  where flag & 2816 = 0 and chrom is not null and pos is not null and trim(cb) <> '' and trim(ur) <> ''
), g as (
  select chrom, pos, cb, ur, count(*) as n_member from m group by 1, 2, 3, 4 having count(*) > 1
), long as (
  select chrom, pos, cb, ur, vote, 'mapq' as field, cast(mapq as varchar) as v from m where mapq <> 255
  union all select chrom, pos, cb, ur, vote, 'cigar', upper(trim(cigar)) from m where trim(cigar) not in ('', '.', '*', 'NA')
  union all select chrom, pos, cb, ur, vote, 'gn', upper(trim(gn)) from m where trim(gn) not in ('', '.', '*', 'NA')
  union all select chrom, pos, cb, ur, vote, 're', upper(trim(re)) from m where trim(re) not in ('', '.', '*', 'NA')
  union all select chrom, pos, cb, ur, vote, 'sp', upper(trim(sp)) from m where trim(sp) not in ('', '.', '*', 'NA')
), best as (
  select chrom, pos, cb, ur, field, v, row_number() over (partition by chrom, pos, cb, ur, field order by sum(vote) desc, v) as k from long group by 1, 2, 3, 4, 5, 6
)
select g.chrom, g.pos, g.cb, g.ur, any_value(n_member) as n_member, cast(max(v) filter (field = 'mapq') as int) as mapq, max(v) filter (field = 'cigar') as cigar,
  max(v) filter (field = 'gn') as gn, max(v) filter (field = 're') as re, max(v) filter (field = 'sp') as sp
from g left join best b on g.chrom = b.chrom and g.pos = b.pos and g.cb = b.cb and g.ur = b.ur and b.k = 1 group by 1, 2, 3, 4
""",
    "p7_checks": """
select count(*) as n_document, count(*) filter (coalesce(text, '') = '') as n_empty, 0 as n_split, 0 as n_overfull, 0 as n_number_missing, 0 as n_token_lost, true as near_least from documents
""",
}
