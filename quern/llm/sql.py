"""SQL twins of those pN_ queries that SQL can express on whole tables."""

from __future__ import annotations

from quern.queries.sqltext import strip

_SUBJECT = f"nullif({strip('lower(metadata.subject)')}, '')"
_ANSWER = strip("regexp_replace(" + strip("upper(metadata.answer)") + ", '\\.$', '')")
_ANSWER = f"nullif({_ANSWER}, '')"

P6_FOUND = f"""
with counted as (
    select 'subject' as target_field, {_SUBJECT} as category from wiki_mcq_seed
    union all
    select 'answer', {_ANSWER} from wiki_mcq_seed
), records as (
    select target_field, category, count(*) as records from counted where category is not null group by all
)
select t.target_field, t.category
from sample_targets t
left join records r on r.target_field = t.target_field and r.category = t.category
cross join (select count(*) as n from wiki_mcq_seed) w
where coalesce(r.records, 0) * 2000 < t.target_permille * w.n or coalesce(r.records, 0) < t.min_rows
"""


def oracle_sql() -> dict[str, str]:
    return {"p6_found": P6_FOUND}
