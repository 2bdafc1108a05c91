"""DuckDB statements for the corpus queries that SQL can express."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUP = rf"""
with recursive words as (
  select doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') as w from documents
), shingles as (
  select distinct doc_id, case when len(w) < 3 then array_to_string(w, ' ') else w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] end as s
  from words, unnest(generate_series(1, greatest(len(w) - 2, 1))) as g(i) where len(w) > 0
), sizes as (
  select d.doc_id, count(s) as n from documents d left join shingles using (doc_id) group by d.doc_id
), links as (
  select x.doc_id as a, y.doc_id as b
  from shingles x join shingles y on x.s = y.s and x.doc_id <> y.doc_id
  join sizes p on p.doc_id = x.doc_id join sizes q on q.doc_id = y.doc_id
  group by x.doc_id, y.doc_id having 100 * count(*) >= 85 * (min(p.n) + min(q.n) - count(*))
), reach(a, b) as (
  select doc_id, doc_id from documents union select reach.a, links.b from reach join links on reach.b = links.a
)
select doc_id, n as n_shingles, c as component_id, doc_id = c as kept
from sizes join (select a, min(b) as c from reach group by a) on a = doc_id
"""

LEAK_WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

LEAKS = f"""
with items as (
  select item_id, {LEAK_WORDS} as w from benchmark
), windows as (
  select distinct item_id, least(len(w), 10) as k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as g
  from items, unnest(generate_series(1, greatest(len(w) - 9, 1))) as t(i) where len(w) > 0
), docs as (
  select doc_id, {LEAK_WORDS} as w from documents
), grams as (
  select doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') as g
  from docs, (select distinct k from windows) as s, unnest(generate_series(1, len(w) - k + 1)) as t(i) where len(w) >= k
), found as (
  select doc_id, i, grams.k, item_id from grams join windows using (g)
), hit as (
  select doc_id, count(distinct i + j) as n from found, unnest(generate_series(0, k - 1)) as t(j) group by doc_id
), named as (
  select doc_id, count(*) as n, string_agg(item, ',' order by item) as s
  from (select distinct doc_id, cast(item_id as varchar) as item from found) x group by doc_id
)
select doc_id, len(w) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(named.n, 0) as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from docs left join hit using (doc_id) left join named using (doc_id)
"""

SAFE = r"regexp_replace({0}, '<(\\*)\|', '<\\\1|', 'g')"
SAFE_NAME = rf"regexp_replace({SAFE.format('role')}, '\|(\\*)>', '|\\\1>', 'g')"
CHAT = f"""
with turns as (
  select distinct conv_id, turn, coalesce(role, 'unknown') as role, {SAFE.format("coalesce(text, '')")} as said, cast(coalesce(floor(turn / 64), -1) as bigint) as part
  from conversations
), people as (
  select distinct conv_id, role as speaker from turns where role <> 'system'
), lines as (
  select conv_id, speaker, part, turn, role, said, role = speaker as own,
    case when role = 'system' then '<|system|>' when role = speaker then '<|assistant|>' else '<|user name=' || {SAFE_NAME} || '|>' end || chr(10) as head
  from turns join people using (conv_id)
), placed as (
  select *, head || said || '<|end|>' || chr(10) as body,
    sum(length(head) + length(said) + 8) over (partition by conv_id, speaker order by part, turn, role, said) as stop
  from lines
)
select conv_id, speaker, part, 0 as sub, cast(min(stop - length(body)) as bigint) as start, count(*) as n_turns, cast(max(stop) - min(stop - length(body)) as bigint) as n_chars,
  sha256(string_agg(body, '' order by turn, role, said)) as text_sha256,
  coalesce(string_agg(cast(stop - length(said) - 8 as varchar) || '-' || cast(stop as varchar), ',' order by turn, role, said) filter (own), '') as masks,
  cast(coalesce(sum(length(said) + 8) filter (own), 0) as bigint) as n_masked
from placed group by conv_id, speaker, part
"""

DIVERGENCE = rf"""
with docs as (
  select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source, {LOWER} as low from documents
), used as (
  select lang, source, d, unnest(regexp_extract_all(low, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs
), in_lang as (
  select lang, term, count(*) as n from used group by lang, term having count(distinct d) >= 30
), in_group as (
  select lang, source, term, count(*) as n from used semi join in_lang using (lang, term) group by lang, source, term
), sizes as (
  select lang, count(*) as v, sum(n) as total from in_lang group by lang
), groups as (
  select g.lang, g.source, v, total, coalesce((select sum(n) from in_group i where i.lang = g.lang and i.source = g.source), 0) as own
  from (select distinct lang, source from docs) g left join sizes using (lang)
), shares as (
  select g.lang, g.source, t.term, coalesce(i.n, 0) as n,
    cast(1 + 1000000000 * cast(coalesce(i.n, 0) + 5 as hugeint) // (own + 5 * v) as bigint) as p,
    cast(1 + 1000000000 * cast(t.n + 5 as hugeint) // (total + 5 * v) as bigint) as q
  from groups g join in_lang t on t.lang = g.lang left join in_group i on i.lang = g.lang and i.source = g.source and i.term = t.term
), pairs as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source
), found as (
  select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(value, 0) as bigint) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
  union all select lang, source, 'term', term, p - q from shares where n > 0 and p > q
)
select * from (
  select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from found
) x where part = 'pair' or rank <= 50
"""

CRC_STEP = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
SPELLING = rf"""
with recursive crc as (
  select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: {CRC_STEP}, b)) as t
), runs as (
  select doc_id, run, count(*) as n
  from (select doc_id, unnest(regexp_extract_all({LOWER}, '[a-zÀ-ÿ]+')) as run from documents) x group by doc_id, run
), hashed as (
  select run, n, length(run) as size, xor(list_reduce(
    flatten(list_transform(string_split(coalesce(cast(doc_id as varchar), '') || ':' || run, ''), lambda s: case when ord(s) < 128 then [cast(ord(s) as bigint)] else [195, ord(s) - 64] end)),
    lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8), 4294967295), 4294967295) as h
  from runs, crc
), made as (
  select case when h % 199 = 0 then substr(run, 1, cast(h % size as bigint)) || substr(run, cast(h % size as bigint) + 2) else run end as word, n from hashed
), words as (
  select word, cast(sum(n) as bigint) as n from made where length(word) >= 6 group by word having sum(n) >= 5
), cut as (
  select word, n, i, substr(word, 1, i - 1) as head, substr(word, i + 1) as tail from words, unnest(generate_series(1, length(word))) as g(i)
), near as (
  select distinct a.word, a.n, b.word as other, b.n as other_n from cut a join cut b on a.i = b.i and a.head = b.head and a.tail = b.tail and a.word <> b.word
  union select c.word, c.n, w.word, w.n from cut c join words w on w.word = c.head || c.tail
  union select w.word, w.n, c.word, c.n from cut c join words w on w.word = c.head || c.tail
), best as (
  select word, n, count(*) as n_near, max(other_n) as form_n, min_by(other, struct_pack(a := -other_n, b := other)) as form from near group by word, n
), forms as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when form_n >= 5 * w.n then form end as form, case when form_n >= 5 * w.n then form_n end as form_n
  from words w left join best using (word)
), way(word, root, steps) as (
  select word, word, 0 from forms union all select way.word, f.form, steps + 1 from way join forms f on f.word = way.root where f.form is not null
)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n from forms f join (select word, max_by(root, steps) as root from way group by word) r using (word)
"""
