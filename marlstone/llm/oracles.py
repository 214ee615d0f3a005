"""DuckDB SQL of the queries that SQL can express; fixed values come from the operators' own tables."""

from __future__ import annotations

from . import quality, urls, warc


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def op4() -> str:
    low = {k: v for k, v, _ in quality.THRESHOLDS}
    high = {k: v for k, _, v in quality.THRESHOLDS}
    names = ", ".join(map(text, quality.STOP_WORDS))
    space, word = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
    between = " and ".join([f"{k} >= {v}" for k, v in low.items() if v is not None] + [f"{k} <= {v}" for k, v in high.items() if v is not None])
    return f"""
with rows as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
split as (
  select r, doc_id, t, list_filter(regexp_split_to_array(t, '{space}'), lambda w: w <> '') as words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) as lines
  from rows
),
words as (select r, unnest(words) as w, generate_subscripts(words, 1) as i from split),
windows as (
  select r, i, w || chr(31) || lead(w) over p || chr(31) || lead(w, 2) over p || chr(31) || lead(w, 3) over p || chr(31) || lead(w, 4) over p as g
  from words window p as (partition by r order by i)
),
twice as (select r, i from windows where g is not null qualify count(*) over (partition by r, g) > 1),
covered as (select r, count(distinct i + k) as n_repeat_words from twice, range(5) as x(k) group by r),
counted as (
  select doc_id, t, len(words) as n_words, length(list_aggregate(words, 'string_agg', '')) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
    len(list_filter(words, lambda w: lower(w) in ({names}))) as n_stop, len(list_filter(words, lambda w: upper(w) = w and lower(w) <> w and length(w) > 1)) as n_upper, len(list_distinct(words)) as n_distinct,
    len(list_filter(lines, lambda x: regexp_matches(x, {text(quality.BULLET)}))) as n_bullet, len(list_filter(lines, lambda x: regexp_matches(x, {text(quality.ELLIPSIS)}))) as n_ellipsis,
    length(t) - length(regexp_replace(t, '{quality.SCRIPTS}', '', 'g')) as n_letters
  from split left join covered using (r)
),
counts as (select * replace (coalesce(word_chars, 0) as word_chars) from counted),
rated as (
  select *, word_chars / greatest(n_words, 1) as mean_word_chars, n_symbols / greatest(word_chars, 1) as symbol_ratio, n_dup_lines / greatest(n_lines, 1) as dup_line_ratio,
    n_bullet / greatest(n_lines, 1) as bullet_line_ratio, n_ellipsis / greatest(n_lines, 1) as ellipsis_line_ratio, n_repeat_words / greatest(n_words, 1) as repeat_word_ratio,
    case when n_stop < {quality.LEAST_STOP} * n_words and 2 * n_letters < word_chars then 1 else n_stop / greatest(n_words, 1) end as stop_ratio,
    n_upper / greatest(n_words, 1) as upper_ratio, case when n_words >= 100 then n_distinct / n_words else 1 end as distinct_word_ratio,
    n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed
  from counts
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {between} as kept from rated
"""


def op5() -> str:
    listed = ", ".join(f"({text(h)}, {text(p)}, {text(v)}, {n})" for n, part in ((1, urls.RULES), (0, urls.LISTED)) for h, p, v in part)
    return f"""
with listed(l_host, l_path, verdict, priority) as (values {listed}),
rests as (select row_number() over () as r, page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (
  select r, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rests
),
best as (
  select r, l_host || l_path as rule, verdict, priority from parts join listed on (host = l_host or ends_with(host, '.' || l_host)) and starts_with(path, l_path)
  qualify row_number() over (partition by r order by priority desc, length(l_host) + length(l_path) desc, length(l_host) desc) = 1
)
select page_id, host, path, case when priority = 1 then rule end as rule, coalesce(verdict, 'allow') as verdict from parts left join best using (r)
"""


def op10() -> str:
    return f"""
with rows as (select row_number() over () as r, page_id, coalesce(html, '') as body from pages),
digests as (select r, page_id, strlen(body) as payload_bytes, sha256(body) as payload_digest from rows),
firsts as (select *, first_value(r) over w as first_row, first_value(page_id) over w as first_page from digests window w as (partition by payload_digest order by page_id nulls last, r))
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= {warc.MIN_REVISIT} and first_page is not null and r <> first_row then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {warc.MIN_REVISIT} and first_page is not null and r <> first_row then first_page end as refers_to
from firsts
"""


def oracle_sql() -> dict[str, str]:
    """Models, schedules, samples, token ids and spans of the method's own aren't SQL: those queries are tested against brute force."""
    return {"op4_quality_rules": op4(), "op5_url_filter": op5(), "op10_warc": op10()}
