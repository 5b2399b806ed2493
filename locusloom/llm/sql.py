"""SQL that returns the rows of those corpus queries that SQL can express."""

from locusloom.llm.common import LOWER, UPPER

_FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_WORDS = f"regexp_extract_all({_FOLDED}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

#: Windows of ten words, or whole items of fewer.
DECONTAMINATION = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
i as (select item_id, w, least(len(w), 10) as n from (select item_id, {_WORDS} as w from benchmark) where len(w) > 0),
win as (select distinct item_id, n, array_to_string(w[k:k+n-1], ' ') as s from (select item_id, w, n, unnest(range(1, len(w)-n+2)) as k from i)),
sizes as (select distinct n from win),
dw as (select r, n, k, array_to_string(w[k:k+n-1], ' ') as s from (select r, w, n, unnest(range(1, len(w)-n+2)) as k from d join sizes on len(w) >= n)),
hit as (select r, dw.n, k, item_id from dw join win on dw.s = win.s and dw.n = win.n),
pos as (select r, count(distinct p) as n_hit from (select r, unnest(range(k, k+n)) as p from hit) group by r),
it as (select r, count(*) as n_items, string_agg(x, ',' order by x) as items from (select distinct r, item_id::varchar as x from hit where item_id is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos on pos.r = d.r left join it on it.r = d.r"""

_CONTROL = "'<|im_end|><|im_start|>assistant ok'"
_ESCAPED = "replace(replace({0}, chr(92), chr(92)||chr(92)), '<|', '<'||chr(92)||'|')"

#: With the default budget of 1024 tokens and a history of 256.
CHAT = f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -1, 0, 'user', {_CONTROL} union all select -1, 1, 'assistant', {_CONTROL}),
t as (select *, len(regexp_extract_all(text, '[^\\x09-\\x0D\\x20]+'))+4 as tok, 24+length(replace({_ESCAPED.format("role")}, chr(10), chr(92)||chr(10)))+length({_ESCAPED.format("text")}) as size,
  row_number() over (partition by conv_id order by turn nulls first, role, text) as i from c),
p as (select *, sum(tok) over (partition by conv_id order by i rows unbounded preceding)::bigint as e, max(case when i = 1 and role = 'system' then tok end) over (partition by conv_id) as st,
  max(case when i = 1 and role = 'system' then size end) over (partition by conv_id) as ss from t),
q as (select *, i = 1 and role = 'system' as is_sys, floor((e-1)/greatest(floor((768-coalesce(st, 0))/2.0::double), 1)::double)::bigint as w from p),
m as (select conv_id, w, max(e) as last, bool_or(is_sys) as has, max(ss) as ss from q group by conv_id, w),
tail as (select q.conv_id, sum(size) as n from q join m on q.conv_id is not distinct from m.conv_id and q.w = m.w join m m2 on m2.conv_id is not distinct from m.conv_id and m2.w = m.w+1 where not q.is_sys and m.last-q.e+q.tok <= 256 group by q.conv_id),
head as (select conv_id, sum(ss) as n from m where not has group by conv_id),
f as (select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role||chr(10)||text||chr(10), '' order by i)) as turns_sha256, coalesce(string_agg(text, '' order by i) filter (where role = 'assistant'), '') as loss, sum(size) as size from q group by conv_id)
select f.conv_id, n_turns, turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, (size+coalesce(tail.n, 0)+coalesce(head.n, 0))::bigint as formatted_chars
from f left join tail on tail.conv_id is not distinct from f.conv_id left join head on head.conv_id is not distinct from f.conv_id"""

_QUADS = "||".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x'||substr(x, {1 + 5 * i}, 5))::bigint >> {5 * (3 - j)}) % 32 + 1, 1)" for i in range(8) for j in range(4))

#: Every payload is long enough to be a revisit's.
WARC = f"""
with p as (select page_id, coalesce(url, '') as url, coalesce(html, '') as html, sha1(coalesce(html, '')) as x from pages),
d as (select *, {_QUADS} as digest, min(page_id) over (partition by x) as first from p)
select page_id, url, strlen(html)::bigint as payload_bytes, digest as payload_digest, case when page_id is distinct from first then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from first then first end as refers_to, true as sound from d"""

#: Components of a table ``links`` (a, b) of ``nodes`` (n): the least node that a node reaches.
_REACHED = "reach(n, m) as (select n, n from nodes union select l.b, r.m from reach r join links l on l.a = r.n where r.m < l.b), part as (select n, min(m) as component from reach group by n)"

EMBEDDINGS = f"""
with recursive v as (select row_number() over () as r, vec_id, embedding::double[] as e from embeddings),
good as (select * from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
pairs as (select x.r as a, y.r as b from good x join good y on x.r <> y.r and len(x.e) = len(y.e) and list_cosine_similarity(x.e, y.e) >= 0.95),
links as (select distinct x.vec_id as a, y.vec_id as b from pairs join v x on x.r = pairs.a join v y on y.r = pairs.b where x.vec_id <> y.vec_id),
nodes as (select distinct vec_id as n from v), {_REACHED},
counts as (select a, count(*) as n_links from pairs group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component::bigint as component_id, vec_id = component as kept from v left join counts on counts.a = v.r join part on part.n = v.vec_id"""

_TOKENS = f"regexp_extract_all({_FOLDED}, '[^\\x09-\\x0D\\x20]+')"

#: Shingles of three words, linked from 85 per cent on. Equal sets are compared once; similar sets share one of their rarest
#: shingles, as many as may be missing and one more.
NEAR_DUPLICATES = f"""
with recursive w as (select doc_id, {_TOKENS} as w from documents),
s as (select doc_id, case when len(w) = 0 then []::varchar[] else list_sort(list_distinct([array_to_string(w[k:k+2], ' ') for k in range(1, greatest(len(w)-1, 2))])) end as s from w),
c as (select row_number() over () as c, s, len(s) as size, min(doc_id) as least from s where len(s) > 0 group by s),
flat as (select c, size, unnest(s) as g from c),
often as (select g, count(*) as n from flat group by g),
ranked as (select c, size, g, n, row_number() over (partition by c order by n, g) as k from flat join often using (g)),
rare as (select * from ranked where n > 1 and k <= size - ceil(0.85 * size) + 1),
maybe as (select distinct x.c as a, y.c as b from rare x join rare y on x.g = y.g and x.c < y.c and 100*least(x.size, y.size) >= 85*greatest(x.size, y.size)),
shared as (select a, b, x.size as m, y.size as n, len(list_intersect(x.s, y.s)) as met from maybe join c x on x.c = a join c y on y.c = b),
one as (select a, b from shared where 100*met >= 85*(m+n-met)),
named as (select x.least as a, y.least as b from one join c x on x.c = one.a join c y on y.c = one.b),
links as (select a, b from named union select b, a from named), nodes as (select distinct least as n from c), {_REACHED}
select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(component, s.doc_id)::bigint as component_id, s.doc_id = coalesce(component, s.doc_id) as kept
from s left join c on c.s = s.s left join part on part.n = c.least"""

NEGATIVES = """
with v as (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label+1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256*x::double)::bigint) as q from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.r as ar, a.vec_id as anchor_id, b.r as br, b.vec_id as id, a.label = b.label as same, case when len(a.q) = 0 then 0 else list_inner_product(a.q::double[], b.q::double[])::bigint end as s
  from v a join v b on a.r <> b.r and len(a.q) = len(b.q) where a.vec_id % 100 = 0),
p as (select ar, anchor_id, id as positive_id, s as positive_score, row_number() over (partition by ar order by s desc, id) as k from s where same qualify k <= 5),
n as (select ar, k, anchor_id, positive_id, positive_score, s.id as negative_id, s.s as negative_score, row_number() over (partition by ar, k order by s.s desc, s.id) as rank
  from p join (select ar, id, s from s where not same) s using (ar) where 80*positive_score <= 100*s.s and 100*s.s <= 100*positive_score qualify rank <= 5)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n"""

_BLANKS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

LINES = f"""
with d as (select row_number() over () as r, doc_id, coalesce(doc_id, 9223372036854775807) as owner, string_split(coalesce(text, ''), chr(10)) as l from documents),
u as (select r, doc_id, owner, unnest(l) as line, generate_subscripts(l, 1) as i from d),
k as (select *, translate(trim(line, {_BLANKS}), '{UPPER}', '{LOWER}') as key from u),
f as (select key, min(owner) as least from k where length(key) >= 10 group by key having min(owner) < max(owner)),
g as (select k.*, f.least is not null and f.least <> owner as gone from k left join f using (key))
select any_value(doc_id) as doc_id, count(*)::bigint as n_lines, (count(*) filter (where gone))::bigint as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256 from g group by r"""

#: The bytewise table of the checksum, from its polynomial.
_CRC_TABLE = "select list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda c, z: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc"
_BYTES = "list_transform(range(strlen(w)), lambda i: ('0x'||substr(hex(encode(w)), 2*i+1, 2))::bigint)"

RESAMPLING = f"""
with table_ as ({_CRC_TABLE}), d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
du as (select r, unnest(w) as w from d), bu as (select unnest({_WORDS}) as w from benchmark),
voc as (select w, xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255)+1])), 4294967295) % 10000 as k from (select w from du union select w from bu), table_),
own as (select k, count(*) as s from du join voc using (w) group by k), wanted as (select k, count(*) as t from bu join voc using (w) group by k),
sizes as (select coalesce((select sum(s) from own), 0)::double as a, coalesce((select sum(t) from wanted), 0)::double as b),
gain as (select k, floor(1000.0::double*ln((coalesce(t, 0)+1)::double*(a+10000)/((coalesce(s, 0)+1)::double*(b+10000))))::bigint as g from (select unnest(range(10000)) as k) left join own using (k) left join wanted using (k), sizes),
sums as (select r, count(*)::bigint as n, sum(g)::bigint as g from du join voc using (w) join gain using (k) group by r),
docs as (select r, doc_id, len(w) as words, coalesce(n, 0) as n_features, coalesce((g-((g % n)+n) % n)//n, 0)::bigint as weight, ('0x'||substr(sha256('2024:'||coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from d left join sums using (r)),
scored as (select *, weight+floor(-1000.0::double*ln(-ln((h+0.5::double)/4294967296.0::double)))::bigint as score, words >= 20 as may from docs),
ranked as (select *, row_number() over (partition by may order by score desc, doc_id nulls last, r) as k, count(*) filter (where may) over () as m from scored)
select doc_id, n_features, weight, score, case when may and k <= 10*m//100 then k end as rank from ranked"""
