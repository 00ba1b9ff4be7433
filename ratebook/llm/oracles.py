"""SQL twins of the queries of this package, over the same tables."""

from __future__ import annotations

_VECTORS = """
vectors as (
  select vec_id, {label} as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
)"""

TOPK = f"""
with {_VECTORS.format(label="0").strip()},
scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from vectors q join vectors c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from scored qualify rank <= 5
"""

HARD_NEGATIVES = f"""
with {_VECTORS.format(label="case when vec_id % 7 = 0 then (label + 1) % 10 else label end").strip()},
scored as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_inner_product(a.v, c.v)::bigint as score
  from vectors a join vectors c on a.vec_id % 50 = 0 and c.vec_id <> a.vec_id
  where a.label is not null and c.label is not null
),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id,
  row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank,
  vec_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3
"""


def _value(column: str) -> str:
    return f"coalesce(strlen({column})::varchar || ':' || {column}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_value(c) for c in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)) + ")"


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an expression of ASCII characters, bit by bit."""
    one = "case when {0} % 2 = 1 then xor({0} >> 1, 3988292384) else {0} >> 1 end"
    step = "xor(c, b)"
    bits = f"list_reduce([{step}, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: {one.format('x')})"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: {bits}), 4294967295)"


#: Nodes of all levels of the trees in {leaves} (tree, pos, node).
_NODES = """
  select tree, 0 as level, pos, node from {leaves}
  union all
  select tree, level + 1, pos // 3, sha256(string_agg(node, '' order by pos))
  from (select *, count(*) over (partition by tree) as n from {name}) where n > 1 group by tree, level, pos // 3
"""
#: The siblings of each node that is not a root.
_SIDES = """
  select x.tree, x.level, x.pos,
    coalesce(string_agg(y.node, '' order by y.pos) filter (where y.pos < x.pos), '') as l,
    coalesce(string_agg(y.node, '' order by y.pos) filter (where y.pos > x.pos), '') as r
  from {name} x join {name} y on x.tree = y.tree and x.level = y.level and x.pos // 3 = y.pos // 3
  where exists (select 1 from {name} z where z.tree = x.tree and z.level = x.level + 1)
  group by x.tree, x.level, x.pos
"""

MERKLE = f"""
with recursive leaves as (
  select *, row_number() over (partition by tree order by doc_id nulls first, node) - 1 as pos
  from (
    select doc_id, case when source is null then '-' else 's' || source end as tree, {_leaf("text")} as node,
      case when {crc32("doc_id::varchar")} % 2 = 0 then {_leaf("replace(text, chr(10), '')")} end as tampered
    from documents
  )
),
nodes as ({_NODES.format(leaves="leaves", name="nodes")}),
roots as (select tree, arg_max(node, level) as subroot from nodes group by tree),
sources as (select 'all' as tree, row_number() over (order by tree) - 1 as pos, subroot as node, tree as name from roots),
upper_nodes as ({_NODES.format(leaves="sources", name="upper_nodes")}),
sides as ({_SIDES.format(name="nodes")}),
upper_sides as ({_SIDES.format(name="upper_nodes")}),
steps as (
  select d.tree, d.pos, s.level as step, s.l, s.r
  from leaves d join sides s on s.tree = d.tree and s.pos = d.pos // (3 ** s.level)::bigint
  union all
  select d.tree, d.pos, 1000 + s.level, s.l, s.r
  from leaves d join sources u on u.name = d.tree join upper_sides s on s.pos = u.pos // (3 ** s.level)::bigint
),
path as (select *, row_number() over (partition by tree, pos order by step) as k from steps),
folded as (
  select tree, pos, 0::bigint as k, coalesce(tampered, node) as node from leaves
  union all
  select p.tree, p.pos, p.k, sha256(p.l || f.node || p.r) from folded f join path p on p.tree = f.tree and p.pos = f.pos and p.k = f.k + 1
),
proofs as (select tree, pos, sha256(string_agg(l || r, '' order by k)) as proof_sha256 from path group by tree, pos),
ends as (select tree, pos, arg_max(node, k) as folded_root from folded group by tree, pos),
top as (select arg_max(node, level) as root from upper_nodes)
select doc_id, d.node as leaf, subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root, folded_root = root as verified
from leaves d join roots using (tree) join ends e on e.tree = d.tree and e.pos = d.pos
left join proofs p on p.tree = d.tree and p.pos = d.pos cross join top
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all(coalesce({}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _run(words: str, first: str, size: str) -> str:
    """``size`` words from the ``first`` one on, as a text; words have no spaces."""
    return f"array_to_string(list_slice({words}, {first}, {first} + {size} - 1), ' ')"


NEAR_DUPLICATES = f"""
with recursive texts as (select doc_id, {_SPACED.format(_LOWER.format("text"))} as w from documents),
sets as (
  select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: {_run("w", "i", "5")}))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s
  from texts
),
shingles as (select doc_id, len(s) as n, unnest(s) as shingle from sets),
links as (
  select a.doc_id as a, b.doc_id as b from shingles a join shingles b on a.shingle = b.shingle and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
),
reached as (
  select doc_id as id, doc_id as other from sets union select id, b from reached join links on a = other
)
select doc_id, len(s) as n_shingles, min(other) as component_id, doc_id = min(other) as kept
from sets join reached on id = doc_id group by doc_id, s
"""

SUBSTRINGS = f"""
with texts as (select doc_id, {_SPACED.format("text")} as w from documents),
windows as (
  select doc_id, i, row_number() over (partition by {_run("w", "i", "20")} order by doc_id, i) > 1 as repeated
  from texts, unnest(range(1, len(w) - 18)) t(i) where len(w) >= 20
),
hit as (select distinct doc_id, i + j as i from windows, range(20) r(j) where repeated),
words as (select doc_id, i, w[i] as word from texts, unnest(range(1, len(w) + 1)) t(i)),
cut as (
  select doc_id, count(h.i) as n_removed, string_agg(word, ' ' order by i) filter (where h.i is null) as kept
  from words left join hit h using (doc_id, i) group by doc_id
)
select doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from texts left join cut using (doc_id)
"""

CONTAMINATION = f"""
with texts as (select doc_id, {_ALNUM.format(_LOWER.format("text"))} as w from documents),
items as (select item_id, {_ALNUM.format(_LOWER.format("text"))} as w from benchmark),
wanted as (
  select distinct item_id, least(len(w), 10) as size, {_run("w", "i", "least(len(w), 10)")} as run
  from items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) where len(w) > 0
),
found as (
  select doc_id, i, size, item_id from (
    select doc_id, i, size, {_run("w", "i", "size")} as run
    from texts, (select distinct size from wanted) s, unnest(range(1, len(w) - size + 2)) t(i) where len(w) >= size)
  join wanted using (size, run)
),
hit as (select doc_id, count(distinct i + j) as n_hit from found, range(10) r(j) where j < size group by doc_id),
named as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items
  from (select distinct doc_id, item_id::varchar as item_id from found) group by doc_id
)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from texts left join hit using (doc_id) left join named using (doc_id)
"""

ORACLES: dict[str, str] = {
    "op3_near_duplicates": NEAR_DUPLICATES,
    "op4_substring_dedup": SUBSTRINGS,
    "op7_decontamination": CONTAMINATION,
    "op11_topk": TOPK,
    "op12_hard_negatives": HARD_NEGATIVES,
    "op13_merkle_manifest": MERKLE,
}
