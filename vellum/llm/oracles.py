"""DuckDB equivalents of those queries that SQL can express."""

from __future__ import annotations

from . import quality
from .chat import BODY, CLOSE, OPEN

_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOKENS = "regexp_extract_all(" + _ASCII_LOWER + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP1 = f"""
with d as (select doc_id, {_TOKENS.format("coalesce(text, '')")} as w from documents),
b as (select coalesce(item_id::varchar, 'null') as item, {_TOKENS.format("coalesce(text, '')")} as w from benchmark),
windows as (
  select distinct item, w[i:i + least(10, len(w)) - 1] as g from
  (select item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct len(g) as n from windows),
grams as (
  select doc_id, i, n, w[i:i + n - 1] as g from
  (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hits as (select doc_id, i, n, item from grams join windows using (g)),
hit_words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit_words using (doc_id) left join items using (doc_id)
"""

OP6 = """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, ''))::bigint as n from pages),
r as (select *, case when n >= 1000 then max(page_id) over (partition by html) else page_id end as keeper from p)
select page_id, n as payload_bytes, sha1(html) as payload_digest,
  case when page_id = keeper then 'response' else 'revisit' end as record_type,
  case when page_id = keeper then null else keeper end as refers_to
from r
"""

_ESC = "regexp_replace({}, '([<\\[])(\\\\*)(/?(?:s>|INST\\]))', '\\1\\\\\\2\\3', 'g')"
_FIXED = len(OPEN) + len(BODY) + len(CLOSE)

OP7 = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s as (
  select *, row_number() over (partition by conv_id order by turn, role, text) as i, count(*) over (partition by conv_id) as n,
    {_FIXED} + length({_ESC.format("role")}) + length({_ESC.format("text")}) as chars from t),
c as (select *, sum(chars) over (partition by conv_id order by i) as upto from s)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by i), '')) as loss_sha256,
  sum(case when role = 'assistant' or i = n then upto else 0 end)::bigint as formatted_chars
from c group by conv_id
"""


def _op8() -> str:
    ladder, risk = quality.LADDER, quality.RISK
    tail = f"list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln({1 - risk}))))"
    some = lambda step: " or ".join(f"{r} > {cuts[step]}" for r, cuts in ladder.items())
    counted = " union all ".join(f"select stratum, {i} as step, count(*) as n, count(*) filter (where {some(i)}) as k from good group by stratum" for i in range(quality.STEPS))
    over = " or ".join(f"coalesce(v.{r} > {cuts}[c.steps], false)" for r, cuts in ladder.items())
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
with d as (select doc_id, coalesce(lang, chr(0)) as stratum, coalesce(text, '') as text from documents),
w as (select *, {_WORDS.format("text")} as words, list_filter(string_split(text, chr(10)), lambda l: length(trim(l, {space})) > 0) as lines from d),
x as (select row_number() over () as row, * from w),
grams as (select row, i, array_to_string(words[i:i + 4], ' ') as g from (select row, words, unnest(range(1, len(words) - 3)) as i from x where len(words) > 5)),
twice as (select row, i from (select *, count(*) over (partition by row, g) as c from grams) where c > 1),
cover as (select row, count(distinct p) as n from (select row, unnest(range(i, i + 5)) as p from twice) group by row),
s as (
  select x.row, doc_id, stratum, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(cover.n, 0)::bigint as n_repeat_words, len(lines) as n_lines
  from x left join cover on x.row = cover.row),
v as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    coalesce(n_symbols / nullif(n_words, 0), 0) as symbols_per_word, coalesce(n_dup_lines / nullif(n_lines, 0), 0) as dup_line_share,
    coalesce(n_repeat_words / nullif(n_words, 0), 0) as repeat_share, coalesce(word_chars / nullif(n_words, 0), 0) as mean_word_chars from s),
good as (select v.* from v join (select doc_id from labels group by doc_id having max(quality) = 1) l using (doc_id) where not base_failed),
counted as ({counted}),
made as (select count(distinct stratum) as m from counted),
unsafe as (select * from counted, made where k > {risk} * n or {tail} > {quality.ERROR} / m),
c as (select stratum, coalesce(min(unsafe.step), {quality.STEPS}) as steps from (select distinct stratum from counted) left join unsafe using (stratum) group by stratum)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({over}) as kept
from v left join c using (stratum)
"""


OP8 = _op8()

ORACLES = {"op1_decontamination": OP1, "op6_warc": OP6, "op7_chat_formatting": OP7, "op8_quality_rules": OP8}
