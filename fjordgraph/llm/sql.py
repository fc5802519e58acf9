"""DuckDB SQL for the queries that SQL can express.

Without SQL: op1 and op4 (tokenizers), op8 (a greedy map of slots), op9 (keyed
permutations), op10 (a fitted model) and op12 (parsed keys); tests hold those against
the public libraries or brute force, and op12's base columns against ``SECRETS_BASE``.
"""

from __future__ import annotations

from . import merkle

# marks are put where a level ends, then split at: another way to the pieces of the tree
_SPLIT = r"string_split(regexp_replace({x}, '({end})', '\1' || chr(1), 'g'), chr(1))"
_LEAVES = "list_transform({sections}, lambda s: list_transform({paragraphs}, lambda p: list_transform({phrases}, lambda x: sha256(x))))"
_TREE = _LEAVES.replace("{sections}", _SPLIT.format(x="{t}", end=r"\n\n+")).replace("{paragraphs}", _SPLIT.format(x="s", end=r"\n")).replace("{phrases}", _SPLIT.format(x="p", end=r"[.!?,;:|ea] |[" + "".join(rf"\x{{{{{a:x}}}}}-\x{{{{{b:x}}}}}" for a, b in merkle.ENDS) + "]"))
_PARAGRAPHS = "list_transform({t}, lambda s: list_transform(s, lambda p: sha256(array_to_string(p, '/'))))"
_SECTIONS = "list_transform({t}, lambda s: sha256(array_to_string(s, '/')))"
_DIFF = "nullif(coalesce(list_position(list_transform(range(1, greatest(len({a}), len({b})) + 1), lambda i: {a}[i] is distinct from {b}[i]), true), 0), 0) - 1"
_NODES = "list_concat(list_concat(flatten(flatten(t{x})), list_transform(flatten(p{x}), lambda h: 'p' || h)), list_concat(list_transform(s{x}, lambda h: 's' || h), ['r' || sha256(array_to_string(s{x}, '/'))]))"


def _near(b: str) -> str:
    return f"select a.doc_id, sum(least(a.k, b.k)) c from m a join m b on a.doc_id = b.doc_id and a.node = b.node where a.x = 'a' and b.x = '{b}' group by 1"


MERKLE = f"""
with d as (select doc_id, coalesce(text, '') t from documents),
n as (select doc_id, t, coalesce(lead(t) over (order by doc_id desc), first_value(t) over (order by doc_id desc)) nt from d),
x as (select doc_id, t, nt, left(t, cast(length(t) - length(t) // 3 as bigint)) || left(nt, cast(length(t) // 3 as bigint)) et from n),
y as materialized (select *, {_TREE.format(t="t")} ta, {_TREE.format(t="et")} tb, {_TREE.format(t="nt")} tn from x),
q as materialized (select *, {_PARAGRAPHS.format(t="ta")} pa, {_PARAGRAPHS.format(t="tb")} pb, {_PARAGRAPHS.format(t="tn")} pn from y),
z as materialized (select *, {_SECTIONS.format(t="pa")} sa, {_SECTIONS.format(t="pb")} sb, {_SECTIONS.format(t="pn")} sn from q),
u as (select doc_id, 'a' x, unnest({_NODES.format(x="a")}) node from z union all select doc_id, 'b', unnest({_NODES.format(x="b")}) from z union all select doc_id, 'n', unnest({_NODES.format(x="n")}) from z),
m as materialized (select doc_id, x, node, count(*) k from u group by all),
l as (select doc_id, sum(k) filter (x = 'a') a, sum(k) filter (x = 'b') b, sum(k) filter (x = 'n') n from m group by 1),
cb as ({_near("b")}), cn as ({_near("n")}),
f as (select *, {_DIFF.format(a="sa", b="sb")} fs from z)
select f.doc_id, length(t) as n_chars, sha256(et) as edited_sha256, sha256(array_to_string(sa, '/')) as fingerprint, sha256(array_to_string(sb, '/')) as edited_fingerprint,
 (2 * coalesce(cb.c, 0))::double / (l.a + l.b)::double as near_edited, (2 * coalesce(cn.c, 0))::double / (l.a + l.n)::double as near_next, fs as first_section,
 case when fs is not null then {_DIFF.format(a="coalesce(pa[fs + 1], [])", b="coalesce(pb[fs + 1], [])")} end as first_paragraph
from f join l using (doc_id) left join cb using (doc_id) left join cn using (doc_id)
"""

EMBEDDINGS = """
with recursive v as (select vec_id, label, embedding::double[] e from embeddings where label is not null and embedding is not null
 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as materialized (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.98),
r(id, m) using key (id) as (select a, a from (select distinct a from p) union select p.b, min(r.m) from r join p on p.a = r.id join recurring.r x on x.id = p.b where r.m < x.m group by p.b),
c as (select a, count(*) n from p group by 1)
select vec_id, coalesce(n, 0) as n_links, coalesce(m, vec_id) as component_id, vec_id = coalesce(m, vec_id) as kept
from embeddings left join c on c.a = vec_id left join r on r.id = vec_id
"""

MINHASH = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\r\v\f]+'), lambda x: x <> '') w from documents),
s as (select doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) g from w where len(w) > 0),
c as (select doc_id, g, count(*) n from s group by 1, 2),
t as (select doc_id, sum(n) n from c group by 1),
o as (select a.doc_id a, b.doc_id b, sum(least(a.n, b.n)) o from c a join c b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
p as materialized (select a, b from o join t x on x.doc_id = a join t y on y.doc_id = b where o >= 0.8::double * (x.n + y.n - o)),
r(id, m) using key (id) as (select a, a from (select distinct a from p) union select p.b, min(r.m) from r join p on p.a = r.id join recurring.r x on x.id = p.b where r.m < x.m group by p.b),
k as (select d.doc_id, coalesce(m, d.doc_id) class_id from documents d left join r on r.id = d.doc_id)
select doc_id, class_id, count(*) over (partition by class_id) as class_size, doc_id = class_id as kept from k
"""

_FORM = r"""case when contains({u}, '://') then '//' || regexp_replace({h}, '^www\.', '') || regexp_replace(regexp_replace({p}, '\.html?$', ''), '/+$', '') ||
 coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract({u}, '(?s)^[^?#]*\?([^#]*)', 1), '&'), lambda q: q <> '' and not regexp_matches(q, '^(utm_\w*|ref|fbclid|gclid)='))), '&'), ''), '') end"""
_HOST = r"coalesce(translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = r"coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _address(u: str) -> str:
    return _FORM.format(u=u, h=_HOST.format(u=u), p=_PATH.format(u=u))


URLS = rf"""
with recursive rules(v, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
b as (select page_id, url, {_HOST.format(u="url")} host, {_PATH.format(u="url")} path, {_address("url")} address, coalesce(html, '') html from pages),
h as (select address src, unnest(list_concat(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'))) tag from b where contains(url, '://')),
l as (select src, replace(regexp_extract(tag, '(?is)\b(?:href|url)\s*=\s*["'']?([^"''\s>]+)', 1), '&amp;', '&') u from h),
e as (select src, {_address("u")} dst from l where contains(u, '://')),
g as (select src, dst from e where src <> dst union select dst, src from e where src <> dst),
r(id, m) using key (id) as (select src, src from (select distinct src from g) union select g.dst, min(r.m) from r join g on g.src = r.id join recurring.r x on x.id = g.dst where r.m < x.m group by g.dst),
j as (select b.page_id, b.host, b.path, b.address, x.rule, x.v from b left join lateral (select rules.h || rules.p as rule, v from rules where (b.host = rules.h or ends_with(b.host, '.' || rules.h)) and starts_with(b.path, rules.p) order by length(rules.h || rules.p) desc, v limit 1) x on true),
k as (select j.*, case when address is not null then coalesce(r.m, address) end component from j left join r on r.id = j.address),
f as (select component, bool_or(coalesce(v = 'allow', false)) a, bool_or(coalesce(v = 'block', false)) bl from k where component is not null group by 1)
select page_id, host, path, rule, coalesce(v, case when a then 'allow' when bl then 'block' end, 'allow') as verdict, k.component,
 case when v is not null then 'rule' when a or bl then 'alias' else 'default' end as decided_by
from k left join f on f.component = k.component
"""

_ESC = r"replace(replace({x}, '\', '\s'), '<|', '<\|')"

CHAT = rf"""
with c as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') t from conversations
 union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
o as (select *, row_number() over w k, 12 + length(replace({_ESC.format(x="role")}, chr(10), '\r')) + 1 + length({_ESC.format(x="t")}) + 11 part from c window w as (partition by conv_id order by turn, role, t)),
q as (select *, sum(part) over (partition by conv_id order by k) upto, count(*) over (partition by conv_id) n, max(case when role = 'assistant' then k else 0 end) over (partition by conv_id) lastreply from o)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' order by k)) as turns_sha256,
 cast(coalesce(sum(length(t)) filter (role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(t, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
 cast(sum(case when role = 'assistant' then upto else 0 end) + max(case when lastreply < n and k = n then upto else 0 end) as bigint) as formatted_chars
from q group by conv_id
"""

# the CRC of each distinct word, byte by byte over a table that SQL derives
_CRC_TABLE = "tab as materialized (select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) t from range(256) r(i))"

RESAMPLING = rf"""
with {_CRC_TABLE},
fold as (select 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' a, 'abcdefghijklmnopqrstuvwxyz' b),
d as (select doc_id, row_number() over () k, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents, fold),
f as materialized (select k, unnest(w) w from d),
g as materialized (select unnest(regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) w from benchmark, fold),
x as (select w, hex(encode(w)) h from (select w from f union select w from g)),
y as (select w, list_transform(range(0, length(h) // 2), lambda i: cast('0x' || h[2 * i + 1:2 * i + 2] as bigint)) bytes from x),
z as materialized (select w, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket from y, tab),
s as (select bucket, count(*) n from f join z using (w) group by 1), t as (select bucket, count(*) n from g join z using (w) group by 1),
totals as (select (select count(*) from f)::double s_all, (select count(*) from g)::double t_all),
gains as (select w, cast(floor(1000 * ln((coalesce(t.n, 0) + 1)::double * (s_all + 10000) / ((coalesce(s.n, 0) + 1)::double * (t_all + 10000)))) as bigint) gain from z left join s using (bucket) left join t using (bucket), totals),
weights as (select k, sum(gain) weight from f join gains using (w) group by 1),
h as (select k, doc_id, len(w) n_features, cast('0x' || left(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), 8) as bigint)::double h from d),
scored as (select k, doc_id, n_features, cast(coalesce(weight, 0) as bigint) weight, cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) as bigint) score from h left join weights using (k)),
ranked as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls first) place, count(*) filter (n_features >= 20) over () n from scored)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= 10 * n // 100 then place end as rank from ranked
"""

# orders one by one: who is still there, filter after filter
AUDIT = r"""
with w as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w, first_value(doc_id) over (partition by coalesce(text, '') order by doc_id nulls last) least from documents),
said as (select doc_id, bool_or(coalesce(quality = 1, false)) good, bool_or(coalesce(toxic = 1, false)) toxic from labels group by 1),
flags as (select part, len(w) < 200 a, 100 * len(list_distinct(w)) < 50 * len(w) b, 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) c, regexp_matches(t, '[#$%&*|]') d, coalesce(doc_id > least, false) e, coalesce(good, false) good, coalesce(toxic, false) toxic from w left join said using (doc_id)),
counts as materialized (select part, list_value(a, b, c, d, e) f, count(*) n, count(*) filter (good) g, count(*) filter (toxic) x from flags group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) l),
orders as (select a.l || b.l || c.l || d.l || e.l as filter_order from letters a, letters b, letters c, letters d, letters e where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
run as materialized (select part, n, g, x, filter_order, list_transform(range(1, 6), lambda i: f[strpos('ABCDE', filter_order[i])]) fails, list_position(list_transform(range(1, 6), lambda i: f[strpos('ABCDE', filter_order[i])]), true) gone, len(list_filter(f, lambda y: y)) many from counts, orders),
each as (select part, filter_order, step, filter_order[step] l, coalesce(sum(n) filter (gone is null or gone = 0 or gone > step), 0) kept, coalesce(sum(n) filter (gone = step), 0) removed, coalesce(sum(n) filter (fails[step] and gone < step), 0) redundant,
 coalesce(sum(n) filter (fails[step] and many = 1), 0) unique_fails, coalesce(sum(g) filter (gone = step), 0) good_lost, coalesce(sum(x) filter (gone = step), 0) toxic_lost from run, range(1, 6) s(step) group by all)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
 cast(sum(removed) over (partition by part, l) as bigint) as shapley from each
"""

# positions follow from the texts between the matches
_ASSIGN = """([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _matches(kind: str, pattern: str, value: str, least: int) -> str:
    return f"""select doc_id, '{kind}' kind, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0), 'n': length(m[i]), 'v': length({value})}}), lambda x: x.v >= {least})) x from
 (select doc_id, regexp_extract_all(t, '{pattern}') m, regexp_extract_all(t, '{pattern}', {2 if kind == "assign" else 0}) v, string_split_regex(t, '{pattern}') g from d)"""


SECRETS_BASE = f"""
with d as (select doc_id, coalesce(text, '') t from documents),
m as ({_matches("assign", _ASSIGN, "v[i]", 12)} union all {_matches("access", "AKIA[A-Z0-9]+", "m[i]", 18)} union all {_matches("hex", "[0-9a-f]+", "m[i]", 16)})
select d.doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
 sha256(coalesce(string_agg(kind || ':' || cast(x.s as bigint) || ':' || cast(x.s + x.n as bigint), ',' order by x.s, list_position(['assign', 'access', 'hex'], kind)) filter (kind is not null), '')) as base_sha256
from d left join m on m.doc_id = d.doc_id group by 1
"""

ORACLE_SQL = {
    "op2_merkle_fingerprint": MERKLE,
    "op3_embedding_neardup": EMBEDDINGS,
    "op5_bag_minhash": MINHASH,
    "op6_url_filter": URLS,
    "op7_chat_prefixes": CHAT,
    "op11_word_trie_resampling": RESAMPLING,
    "op13_filter_audit": AUDIT,
}
