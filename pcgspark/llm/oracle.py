"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

OP5 = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words, regexp_extract_all(t, '[^\n]+') as lines from d),
l as (select doc_id, list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from w),
g as (select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as gram
      from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w where len(words) > 2)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as n from g) where n > 1),
c as (select doc_id, count(distinct p) as n_repeat from (select doc_id, unnest([i, i + 1, i + 2]) as p from r) group by doc_id),
m as (select w.doc_id, len(words) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(l.lines) as n_lines,
             len(l.lines) - len(list_distinct(l.lines)) as n_dup, coalesce(n_repeat, 0) as n_repeat,
             len(regexp_extract_all(t, '[A-Z]')) as n_upper, len(regexp_extract_all(t, '[a-z]')) as n_lower,
             len(regexp_extract_all(t, '!')) as n_exclaim
      from w join l using (doc_id) left join c using (doc_id)),
b as (select *, (case when n_words < 50 then 1 else 0 end)
               + (case when 100 * n_repeat > 50 * n_words then 2 else 0 end)
               + (case when 100 * n_symbols > 4 * word_chars then 4 else 0 end)
               + (case when 100 * n_dup > 40 * n_lines then 8 else 0 end)
               + (case when 100 * n_upper > 60 * (n_upper + n_lower) then 16 else 0 end)
               + (case when word_chars < 2 * n_words or word_chars > 15 * n_words then 32 else 0 end)
               + (case when n_exclaim > n_words then 64 else 0 end) as bits from m)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
       cast(n_symbols as bigint) as n_symbols, cast(n_dup as bigint) as n_dup_lines,
       cast(n_repeat as bigint) as n_repeat_words, bits % 4 <> 0 as base_failed, bits = 0 as kept,
       cast(bits as bigint) as fail_bits, cast(1 as integer) as policy_version
from b
"""

OP6 = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, g from (
  select doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)
  union all select doc_id, 'short ' || array_to_string(w, ' ') from d where len(w) between 1 and 2)),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as a, doc_id as b from d union select r.a, e.b from r join e on e.a = r.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(r.b) as component_id
from d left join n using (doc_id) join r on r.a = d.doc_id group by 1, 2
"""

OP12 = r"""
with d as (select row_number() over () as d, coalesce(lang, 'und') as lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as pieces from documents),
p as (select d, lang, unnest(pieces) as piece, unnest(range(len(pieces))) as p from d),
v as (select d, lang, p, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p),
w as (select d, lang, p, unnest(ws) as w1, unnest(range(len(ws))) as i from v),
g as (select lang, w1, lead(w1) over o as w2, lead(w1, 2) over o as w3 from w window o as (partition by d, p order by i)),
n as (select lang, count(*) as n from g group by 1),
f1 as (select lang, w1, count(*) as f from g group by 1, 2),
f2 as (select lang, w1, w2, count(*) as f from g where w2 is not null group by 1, 2, 3),
f3 as (select lang, w1, w2, w3, count(*) as f from g where w3 is not null group by 1, 2, 3, 4),
c3 as (select * from f3 where f >= 10),
i2 as (select lang, w1, w2, max(f) as most from (select lang, w1, w2, f from c3 union all select lang, w2, w3, f from c3) group by 1, 2, 3),
c as (select x.lang, x.w1 || ' ' || x.w2 as phrase, x.f as a, a1.f as l, b1.f as r, 1 as k
      from f2 x join f1 a1 on a1.lang = x.lang and a1.w1 = x.w1 join f1 b1 on b1.lang = x.lang and b1.w1 = x.w2
           left join i2 on i2.lang = x.lang and i2.w1 = x.w1 and i2.w2 = x.w2 where x.f >= 10 and (i2.most is null or 100 * i2.most < 50 * x.f)
      union all select x.lang, x.w1 || ' ' || x.w2 || ' ' || x.w3, x.f, a1.f, b2.f, 1
      from c3 x join f1 a1 on a1.lang = x.lang and a1.w1 = x.w1 join f2 b2 on b2.lang = x.lang and b2.w1 = x.w2 and b2.w2 = x.w3
      union all select x.lang, x.w1 || ' ' || x.w2 || ' ' || x.w3, x.f, a2.f, b1.f, 2
      from c3 x join f2 a2 on a2.lang = x.lang and a2.w1 = x.w1 and a2.w2 = x.w2 join f1 b1 on b1.lang = x.lang and b1.w1 = x.w3),
s as (select *, cast(cast(a as hugeint) * a * 1000000 // (cast(l as hugeint) * r) as bigint) as score from c),
m as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
t as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from m)
select t.lang, rank, phrase, a, l, r, n.n, score from t join n on n.lang = t.lang where rank <= 2000
"""

ORACLE = {"op5_quality_rules": OP5, "op6_jaccard_join": OP6, "op12_collocations": OP12}
