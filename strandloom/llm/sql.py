"""SQL for DuckDB that gives the results of the llm queries by brute force, on the same tables."""

from __future__ import annotations

_LETTERS = "regexp_replace(replace(upper(sequence), 'U', 'T'), '[^ACGTN]', '', 'g')"


def _rows(table: str) -> str:
    return f"select row_id, {_LETTERS} as letters from {table}"


def _terms(table: str, n: int = 8) -> str:
    """Distinct (row_id, term)."""
    return f"""select distinct row_id, term from (
      select row_id, unnest(list_transform(range(1, len(letters) - {n - 2}), lambda i: substr(letters, i, {n}))) as term
      from ({_rows(table)}) where len(letters) >= {n}) where not contains(term, 'N')"""


def _compared(name: str, table: str) -> str:
    return f"""{name}_all as ({_terms(table)}),
    {name}_n as (select row_id, count(*) as n from {name}_all group by row_id having count(*) >= 40),
    {name} as (select row_id, term, n from {name}_all join {name}_n using (row_id))"""


def _pairs(a: str, b: str, threshold: float, condition: str) -> str:
    return f"""select x.row_id as a, y.row_id as b from {a} x join {b} y on x.term = y.term {condition}
    group by x.row_id, y.row_id, x.n, y.n having count(*) >= {threshold} * (x.n + y.n - count(*)) - 1e-9"""


P5 = f"""with {_compared('t', 'train_df')}
select a as row_id_a, b as row_id_b from ({_pairs('t', 't', 0.5, 'and x.row_id < y.row_id')})"""

P4 = f"""with {_compared('t', 'train_df')}, {_compared('e', 'test_df')}
select a as train_row_id, b as test_row_id from ({_pairs('t', 'e', 0.5, '')})"""

P1 = f"""with recursive {_compared('t', 'train_df')},
links as materialized ({_pairs('t', 't', 0.3, 'and x.row_id < y.row_id')}),
ways as materialized (select a, b from links union select b, a from links),
reached as (select a as row_id, a as other from ways union select r.row_id, w.b from reached r join ways w on r.other = w.a),
clusters as (select row_id, min(other) as cluster_id from reached group by row_id)
select row_id, cluster_id from clusters where cluster_id in (select cluster_id from clusters group by cluster_id having count(*) >= 3)"""

_COUNTS = f"""select term, sum(n)::bigint as occurrences, count(*)::bigint as records from (
    select row_id, term, count(*) as n from (
      select row_id, unnest(list_transform(range(1, len(letters) - 6), lambda i: substr(letters, i, 8))) as term
      from ({_rows('train_df')}) where len(letters) >= 8) where not contains(term, 'N') group by row_id, term) group by term"""

_MARKED = f"""with counts as ({_COUNTS}), base as (select count(*) as base from ({_rows('train_df')}) where regexp_matches(letters, '[ACGT]{{8}}'))
select term, occurrences, records, case when records <= 2 or records * 20000 < base then 'rare' when records * 100 > base then 'common' end as mark
from counts, base"""

P3 = f"""with windows as (
  select row_id, i, substr(letters, i, 40) as w from (
    select row_id, letters, unnest(range(1, len(letters) - 38)) as i from ({_rows('train_df')}) where len(letters) >= 40)),
shared as (select w from windows where not contains(w, 'N') group by w having count(distinct row_id) > 1),
starts as (select row_id, i, lag(i) over (partition by row_id order by i) as before from windows semi join shared using (w)),
runs as (select row_id, i, sum(case when before is null or i > before + 40 then 1 else 0 end) over (partition by row_id order by i) as run from starts)
select row_id, min(i)::integer as span_start, (max(i) + 39)::integer as span_end from runs group by row_id, run"""


_REPS = f"(select min(row_id) as row_id, {_LETTERS} as sequence from train_df group by {_LETTERS})"

P5_GROUPS = f"""with recursive {_compared('t', _REPS)},
links as materialized ({_pairs('t', 't', 0.5, 'and x.row_id < y.row_id')}),
ways as materialized (select a, b from links union all select b, a from links),
reached as (select a as row_id, a as other from ways union select r.row_id, w.b from reached r join ways w on r.other = w.a),
least as (select row_id, min(other) as group_id from reached group by row_id),
many as (select a as row_id, count(*)::bigint as links from ways group by a)
select r.row_id, c.row_id as class_id, coalesce(g.group_id, c.row_id) as group_id, coalesce(m.links, 0)::bigint as links
from ({_rows('train_df')}) r join {_REPS} c on r.letters = c.sequence left join least g on g.row_id = c.row_id left join many m on m.row_id = c.row_id
where c.row_id in (select row_id from t)"""

P4_COUNTS = f"""with {_compared('t', 'train_df')}, {_compared('e', 'test_df')},
pairs as ({_pairs('t', 'e', 0.5, '')})
select lower(trim(s.split)) as split, d.dataset, count(*)::bigint as pairs, count(distinct b)::bigint as test_rows
from pairs join train_df d on d.row_id = a join test_df s on s.row_id = b group by all"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1,
        "p2_found": f"select term, mark from ({_MARKED}) where mark is not null",
        "p2_counts": _MARKED,
        "p3_found": P3,
        "p3_shares": f"""select row_id, letters, coalesce(shared, 0)::bigint as shared, case when letters > 0 then round(coalesce(shared, 0) / letters, 6) end as share
from (select row_id, coalesce(len(letters), 0) as letters from ({_rows('train_df')})) left join
(select row_id, sum(span_end - span_start + 1)::bigint as shared from ({P3}) group by row_id) using (row_id)""",
        "p4_found": P4,
        "p4_counts": P4_COUNTS,
        "p5_found": P5,
        "p5_groups": P5_GROUPS,
        "p7_checks": "select limit_id, (select count(*) from documents)::bigint as documents, 0::bigint as not_whole, 0::bigint as divided_though_fitting, 0::bigint as overfull from size_limits where purpose = 'fill'",
        "p8_checks": "select limit_id, 0::bigint as over, 0::bigint as late, 0::bigint as not_covered from size_limits where purpose = 'cut'",
    }
