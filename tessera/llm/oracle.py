"""SQL of the operators that SQL can express over whole tables."""

from __future__ import annotations

CLOSURE = """
reach as (select distinct id, m from (with recursive r(id, m) as (select u, u from link union select r.id, link.v from r join link on link.u = r.m) select id, m from r))"""

OP1 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
p as (select doc_id, h, len(h) // 2 n, unnest(range(len(h) // 2)) p from d),
w as (select doc_id, p, substr(h, 2 * p + 1, 200) s from p where p + 100 <= n),
f as (select s, min((doc_id, p)) f from w group by s having count(*) > 1),
r as (select w.doc_id, w.p from w join f on f.s = w.s where (w.doc_id, w.p) <> f.f),
q as (select doc_id, p, substr(h, 2 * p + 1, 2) c from p semi join (select distinct doc_id from r) t using (doc_id)),
b as (select q.doc_id, q.p, q.c, max(r.p) over (partition by q.doc_id order by q.p rows between 99 preceding and current row) is not null gone from q left join r on r.doc_id = q.doc_id and r.p = q.p),
e as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by p), false) head from b),
g as (select doc_id, count(*) filter (where gone) n_removed, count(*) filter (where head) n_spans, sha256(unhex(coalesce(string_agg(c, '' order by p) filter (where not gone), ''))) k from e group by doc_id)
select d.doc_id, (len(h) // 2)::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans, coalesce(k, sha256(unhex(h))) kept_sha256 from d left join g using (doc_id)"""

OP2 = f"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then ['short ' || array_to_string(w, ' ')] else [] end) s from w),
n as (select doc_id, count(*) n from s group by doc_id),
o as (select a.doc_id a, b.doc_id b, count(*) o from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
one as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 80 * (x.n + y.n - o)),
link as (select a u, b v from one union all select b, a from one),{CLOSURE},
c as (select id, min(m) m from reach group by id)
select w.doc_id, coalesce(n.n, 0)::bigint n_shingles, coalesce(c.m, w.doc_id) component_id from w left join n using (doc_id) left join c on c.id = w.doc_id"""

OP5 = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 34], ' ') s from (select doc_id, w, unnest(range(1, len(w) - 33)) i from w where len(w) >= 35)),
many as (select s from win group by s having count(*) > 1),
rep as (select doc_id, i from win join many using (s)),
one as (select doc_id, unnest(w) word, generate_subscripts(w, 1) p from w),
b as (select one.doc_id, word, p, max(rep.i) over (partition by one.doc_id order by p rows between 34 preceding and current row) is not null gone from one left join rep on rep.doc_id = one.doc_id and rep.i = p),
k as (select doc_id, count(*) filter (where gone) n_removed, string_agg(word, ' ' order by p) filter (where not gone) t from b group by doc_id)
select w.doc_id, len(w)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(coalesce(t, '')) kept_sha256 from w left join k using (doc_id)"""

OP8 = f"""
with e as (select vec_id, embedding::double[] v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
g as (select vec_id, v, sqrt(list_dot_product(v, v)) n from e),
one as (select a.vec_id u, b.vec_id v from g a join g b on a.vec_id < b.vec_id and len(a.v) = len(b.v) where list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.95::double),
link as (select u, v from one union all select v, u from one),{CLOSURE},
c as (select id, min(m) m from reach group by id), n as (select u, count(*) n from link group by u)
select x.vec_id, coalesce(n.n, 0)::bigint n_links, coalesce(c.m, x.vec_id) component_id, coalesce(c.m, x.vec_id) = x.vec_id kept from embeddings x left join n on n.u = x.vec_id left join c on c.id = x.vec_id"""

#: CRC-32 of the bytes that {h} holds as hex text.
CRC = "xor(list_reduce([4294967295::bigint] || list_transform(range(len({h}) // 2), lambda i: ('0x' || substr({h}, 2 * i + 1, 2))::bigint), lambda c, x: list_reduce([xor(c, x)] || range(8), lambda r, k: xor(r >> 1, (r & 1) * 3988292384))), 4294967295)"
_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _levels(base: str, name: str, count: int) -> str:
    """Runs of 8 of base (tree, i, h) by level: name0, name1, ... (tree, i, hs), each made of the hashes of the one before."""
    out, below = [], base
    for k in range(count):
        out.append(f"{name}{k} as (select tree, i // 8 i, list(h order by i) hs from {below} where tree in (select tree from {below} group by tree having count(*) > 1) group by tree, i // 8)")
        out.append(f"{name}n{k} as (select tree, i, sha256(array_to_string(hs, '')) h from {name}{k})")
        below = f"{name}n{k}"
    return ",\n".join(out)


def _folds(base: str, name: str, levels: str, count: int) -> str:
    """base with cur folded through the levels and the siblings' digests appended to proof: name0, name1, ..."""
    out, below = [], base
    for k in range(count):
        at = f"(b.i // {8**k} % 8 + 1)"
        left, right = f"array_to_string(g.hs[:{at} - 1], '')", f"array_to_string(g.hs[{at} + 1:], '')"
        out.append(f"{name}{k} as (select b.* exclude (cur, proof), case when g.hs is null then cur else sha256({left} || cur || {right}) end cur, proof || coalesce({left} || {right}, '') proof from {below} b left join {levels}{k} g on g.tree = b.tree and g.i = b.i // {8 ** (k + 1)})")
        below = f"{name}{k}"
    return ",\n".join(out)


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(({c})::varchar) || ':' || ({c})::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


OP12 = f"""
with d as (select doc_id, lang, {_leaf("text")} h, case when doc_id is not null and {CRC.format(h="hex(encode(doc_id::varchar))")} % 3 = 0 then {_leaf(_LOWER.format(t="text"))} end alt from documents),
langs as (select lang, row_number() over (order by lang nulls first) - 1 tree from (select distinct lang from documents)),
t0 as (select tree, row_number() over (partition by tree order by doc_id nulls first, h) - 1 i, doc_id, h, alt from d join langs on langs.lang is not distinct from d.lang),
{_levels("t0", "r", 8)},
tops as (select tree, max(h) top from (select tree, h, count(*) over (partition by tree) n from t0) where n = 1 group by tree {"".join(f" union all select tree, h from (select tree, h, count(*) over (partition by tree) n from rn{k}) where n = 1" for k in range(8))}),
u0 as (select 0 tree, tree i, top h from tops),
{_levels("u0", "q", 4)},
roots as (select h from (select h, count(*) over () n from u0) where n = 1 {"".join(f" union all select h from (select h, count(*) over () n from qn{k}) where n = 1" for k in range(4))}),
s0 as (select *, coalesce(alt, h) cur, '' proof from t0),
{_folds("s0", "s_", "r", 8)},
v0 as (select s_7.* exclude (i, tree), 0 tree, tree i, top from s_7 join tops using (tree)),
{_folds("v0", "v_", "q", 4)}
select doc_id, v_3.h leaf, top subroot, roots.h root, sha256(proof) proof_sha256, cur folded_root, cur = roots.h verified from v_3, roots"""


def _words(table: str, side: str, key: str) -> str:
    return f"select '{side}' side, {key} id, regexp_extract_all({_LOWER.format(t="coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from {table}"


OP13 = f"""
with w as ({_words("documents", "d", "doc_id")} union all {_words("benchmark", "b", "item_id")}),
f as (select side, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) f from w),
h as (select f, hex(encode(f)) h from (select distinct f from f)),
b as (select f, {CRC.format(h="h")} % 10000 b from h),
n as (select side, id, b, count(*) n from f join b using (f) group by 1, 2, 3),
tot as (select coalesce(sum(n) filter (where side = 'd'), 0)::double s, coalesce(sum(n) filter (where side = 'b'), 0)::double t from n),
one as (select b, coalesce(sum(n) filter (where side = 'd'), 0)::double s, coalesce(sum(n) filter (where side = 'b'), 0)::double t from n group by b),
g as (select b, floor(1000 * ln((one.t + 1) * (tot.s + 10000) / ((one.s + 1) * (tot.t + 10000))))::bigint g from one, tot),
d as (select id, sum(n)::bigint n, sum(n * g)::bigint total from n join g using (b) where side = 'd' group by id),
r as (select doc_id, coalesce(n, 0)::bigint n_features, coalesce(floor(total / n), 0)::bigint weight, ('0x' || substr(sha256('7:' || doc_id), 1, 8))::bigint h from documents left join d on d.id = doc_id),
s as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint score from r),
k as (select doc_id, row_number() over (order by score desc, doc_id) k, count(*) over () n from s where n_features >= 39)
select s.doc_id, n_features, weight, score, case when k <= 25 * n // 100 then k end as rank from s left join k using (doc_id)"""
