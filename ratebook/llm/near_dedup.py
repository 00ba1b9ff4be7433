"""Near duplicates by a chosen-path similarity join.

Documents are sets of word shingles.  Each of ``trees`` independent trees puts a document below its minwise token of one
hash function; a node with many documents branches on further minwise tokens, chosen by the path, until nodes are small
enough to compare every two members.  Two sets of similarity s share a token of one hash function with probability s, so
a pair at the threshold of 0.75 meets in none of 10 trees once in a million.

What keeps hot groups from costing all their pairs: equal sets are one class; in every node each member is first compared
with one pivot only, and what these links join is one component.  A node whose members are all of one component is
finished, and in others only pairs of different components are compared.  Links are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .textops import LOWER, SPACE, Sequences, U, Words, blocks, bounded_batches, distinct, lists, longs, mix
from .work import fresh, by_batch, keep_ids, one_text_an_id, staged

SHINGLE, SIMILARITY = 5, (75, 100)
TOKENS, TREES, BRANCHES, MAX_DEPTH = 40, 10, 3, 4
#: Members of a node that one task compares by their sketches, of 80 bytes each.
NODE = 4096
#: Equal minwise tokens of 40 that two sets must have to be compared in full; at 0.75 they have 30 on average, and fewer
#: than 17 six times in a million.
SKETCH = 17
#: Members of a main component that one task compares with the members outside it.
BLOCK = 4096
#: Shingles of a group that one task compares in full.
SHINGLES = 2_000_000
_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, TOKENS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a block; fewer words than ``size`` are one shingle."""
    words = Words(LOWER[data], bounds, SPACE)
    runs = Sequences(words.hashes())
    every, first = runs.all(size), words.first
    sets = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            sets.append(distinct(every[a : b - size + 1]))
        else:
            sets.append(runs.of(np.array([a]), b - a) if b > a else every[:0])
    return sets


def _tokens(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Minwise tokens of non-empty sets, one row per set."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.empty((len(sets), TOKENS), U)
    for k, seed in enumerate(_SEEDS):
        x = (flat ^ seed) * U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
        out[:, k] = np.minimum.reduceat(x ^ (x >> U(29)), at)
    return out


def _sign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i, j, data, bounds in blocks(batch.column(1)):
        sets = shingle_sets(data, bounds)
        sizes = np.array([len(x) for x in sets])
        some = np.flatnonzero(sizes)
        low, high = np.zeros(len(sets), U), np.zeros(len(sets), U)
        tokens = np.empty((0, TOKENS), U)
        if len(some):
            kept = [sets[k] for k in some]
            tokens = _tokens(kept, sizes[some])
            low[some] = [mix(x).sum(dtype=U) for x in kept]
            high[some] = [mix(x ^ U(0xA0761D6478BD642F)).sum(dtype=U) for x in kept]
        offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, TOKENS, 0))])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0)[i:j], longs(sizes), longs(low), longs(high), lists(tokens.ravel(), offsets)],
            names=["id", "n", "low", "high", "tokens"],
        )


def _sketches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The lower 16 bits of the tokens, which tell different ones apart well enough to choose what is compared."""
    tokens = np.asarray(batch.column(1).flatten()).astype(np.uint16).tobytes()
    width = 2 * TOKENS
    parts = [tokens[k : k + width] for k in range(0, len(tokens), width)]
    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.binary())], names=["id", "tokens", "n", "sketch"])


def _matrix(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in sketches), np.uint16).reshape(-1, TOKENS)


def _similar(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(id, pivot, same) from pairs with the sketches of both, for those with enough tokens in common."""
    same = (_matrix(batch.column(2)) == _matrix(batch.column(3))).sum(1)
    near = pa.array(same >= SKETCH)
    yield pa.RecordBatch.from_arrays(
        [batch.column(0).filter(near), batch.column(1).filter(near), longs(same[same >= SKETCH])], names=["id", "pivot", "same"]
    )


def _sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i, j, data, bounds in blocks(batch.column(1)):
        sets = [x.tobytes() for x in shingle_sets(data, bounds)]
        yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(sets, pa.binary())], names=["id", "shingles"])


def _confirm(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    part, whole = SIMILARITY
    linked = []
    for x, y in zip(batch.column(2), batch.column(3), strict=True):
        x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
        shared = 0
        if whole * min(len(x), len(y)) >= part * max(len(x), len(y)):
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
        linked.append(whole * shared >= part * (len(x) + len(y) - shared) and shared > 0)
    keep = pa.array(linked, pa.bool_())
    yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def shingles_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the documents in ``ids``; ``docs`` is (id, text)."""
    ids = staged(ids.distinct(), "pair-ids")
    return staged(by_batch(keep_ids(docs, ids, "id"), _sets, "id long, shingles binary").dropDuplicates(["id"]), "sets")


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the written ``pairs`` (a, b) whose full sets are similar."""
    sets = shingles_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    one = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    two = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    whole = pairs.join(one.hint("merge"), "b").join(two.hint("merge"), "a").select("a", "b", "x", "y")
    return staged(by_batch(whole, _confirm, "a long, b long"), "links")


def _candidates(table: pa.Table) -> pa.Table:
    """Members of one group that their sketch calls similar to a member of another component, in clusters that are joined
    by such pairs.  A cluster's name follows from its ids, so it is the same in every tree that brings it together."""
    comps = table["comp"].to_numpy()
    sketches = _matrix(table["sketch"].combine_chunks())
    cluster, found = np.arange(len(comps)), np.zeros(len(comps), bool)
    values, counts = np.unique(comps, return_counts=True)
    main = comps == values[np.argmax(counts)]
    for k in np.flatnonzero(~main):  # members of the main component need not be compared with each other
        near = np.flatnonzero(((sketches == sketches[k]).sum(1) >= SKETCH) & (comps != comps[k]))
        if len(near):
            found[near] = found[k] = True
            joined = np.unique(np.append(cluster[near], cluster[k]))
            if len(joined) > 1:
                cluster[np.isin(cluster, joined)] = joined[0]
    some = np.flatnonzero(found)
    ids, cluster = table["id"].to_numpy()[some], cluster[some]
    names, where = np.unique(cluster, return_inverse=True)
    name = np.zeros(len(names), U)
    np.add.at(name, where, mix(ids.view(U) * U(0x9E3779B97F4A7C15) + U(0x632BE59BD9B4E019)))
    return pa.table([longs(mix(name)[where]), pa.array(ids), pa.array(comps[some])], names=["node", "id", "comp"])


def _compare(table: pa.Table) -> pa.Table:
    """Links between components of one group, confirmed on full sets; not more than connect what they connect."""
    part, whole = SIMILARITY
    ids, comps = table["id"].to_numpy(), table["comp"].to_numpy()
    sets = [np.frombuffer(x.as_buffer(), U) for x in table["shingles"].combine_chunks()]
    sizes = np.array([len(x) for x in sets])
    shingles, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(column, minlength=len(shingles)) > 1
    column_of = np.cumsum(often) - 1
    row, column = row[often[column]], column_of[column[often[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    values, counts = np.unique(comps, return_counts=True)
    other = np.flatnonzero(comps != values[np.argmax(counts)])
    shared = np.zeros((len(other), len(sets)), np.float32)
    width = max(1, (8 << 20) // len(sets))
    for low in range(0, int(often.sum()), width):  # a band of shingles at a time, so that memory is bounded
        a, b = np.searchsorted(column, [low, low + width])
        band = np.zeros((len(sets), width), np.float32)
        band[row[a:b], column[a:b] - low] = 1
        shared += band[other] @ band.T
    union = sizes[other][:, None] + sizes[None, :] - shared
    x, y = np.nonzero((whole * shared >= part * union) & (shared > 0) & (comps[other][:, None] != comps[None, :]))
    root = {c: c for c in values.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    links = []
    for k, j in zip(other[x].tolist(), y.tolist(), strict=True):
        a, b = find(int(comps[k])), find(int(comps[j]))
        if a != b:
            root[max(a, b)] = min(a, b)
            links.append((int(ids[k]), int(ids[j])))
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _with_sketches(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    x = reps.select("id", F.col("sketch").alias("x"))
    y = reps.select(F.col("id").alias("pivot"), F.col("sketch").alias("y"))
    return pairs.join(x, "id").join(y, "pivot").select("id", "pivot", "x", "y")


def _mixed(points: DataFrame) -> DataFrame:
    """Nodes that hold several components: size, largest component (main) and number of members outside it, a pivot."""
    parts = points.groupBy("node", "comp").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("node", "id"), "id")).alias("p"))
    return (
        parts.groupBy("node")
        .agg(
            F.sum("size").alias("size"),
            F.max(F.struct("size", "comp")).alias("main"),
            F.count("*").alias("parts"),
            F.min("p").alias("p"),
        )
        .filter("parts > 1")
        .select("node", "size", (F.col("size") - F.col("main.size")).alias("others"), F.col("main.comp").alias("main"), "p.id")
        .withColumnRenamed("id", "pivot")
    )


def _groups(points: DataFrame, blocks_of_all: bool) -> DataFrame:
    """(node, id) of bounded groups in which all pairs of different components of ``points`` (node, id, comp, size,
    others, main) meet.  Members of a large main component are dealt out over blocks, each of which gets all others;
    with ``blocks_of_all``, where the others are many too, blocks of all members meet in pairs."""
    if blocks_of_all:
        parts = F.ceil(F.col("size") / (NODE // 2)).cast("int")
        own = F.pmod(F.xxhash64("id"), parts).cast("int")
        dealt = points.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        node = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
        return dealt.select(node.alias("node"), "id")
    last = F.when(F.col("size") <= NODE, F.lit(0)).otherwise(F.floor((F.col("size") - F.col("others")) / BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("id"), last + 1).cast("int")
    within = F.when(F.col("comp") == F.col("main"), F.array(own)).otherwise(F.sequence(F.lit(0), last))
    return points.select("node", "id", F.explode(within).alias("block")).select(F.xxhash64("node", "block").alias("node"), "id")


def _bounded(close: DataFrame) -> DataFrame:
    """(node, id, comp) of ``close`` (node, id, comp, n), where a cluster of more than SHINGLES shingles is cut into parts
    that meet in pairs."""
    weight = close.groupBy("node").agg(F.sum("n").alias("weight"))
    parts = F.greatest(F.ceil(F.col("weight") * 2 / SHINGLES), F.lit(1)).cast("int")
    dealt = close.join(weight, "node").withColumn("parts", parts)
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.greatest(F.col("parts") - 1, F.lit(0))))
    dealt = dealt.withColumn("own", own).withColumn("other", other)
    node = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
    return dealt.select(node.alias("node"), "id", "comp")


def _relabel(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after further links between ids of known components."""
    if comp is None:
        return staged(components(links), "components")
    c1 = comp.select(F.col("id").alias("a"), F.col("comp").alias("ca"))
    c2 = comp.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
    between = links.join(c1, "a", "left").join(c2, "b", "left")
    merged = staged(components(between.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))), "merged")
    moved = merged.select(F.col("id").alias("comp"), F.col("comp").alias("root"))
    old = comp.join(moved, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"))
    new = merged.join(comp, "id", "left_anti").select("id", "comp")
    return staged(old.unionByName(new), "components")


def _labelled(points: DataFrame, comp: DataFrame) -> DataFrame:
    return points.select("node", "id").join(comp, "id", "left").select("node", "id", F.coalesce("comp", "id").alias("comp"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``docs``.

    Texts without words and null texts have n_shingles 0 and are linked with nothing; null ids have a null component and
    are not kept.  Rows that repeat an id and text share its component; different texts of an id are documents of their
    own.  Other columns are not looked at.
    """
    docs = docs.select(id_column, text_column)
    placed = one_text_an_id(docs, id_column, text_column)
    if placed is None:
        return _near_duplicates(docs, id_column, text_column)
    docs, place = placed
    names = docs.select(place, F.col(id_column).cast("long").alias("_of")).filter(F.col(place).isNotNull()).distinct()
    names = staged(names, "place-names")
    found = _near_duplicates(docs.drop(id_column), place, text_column)
    own = found.join(names.withColumnRenamed("_of", id_column), place, "left")
    roots = names.select(F.col(place).alias("component_id"), F.col("_of").alias("_root"))
    return own.join(roots, "component_id", "left").select(id_column, "n_shingles", F.col("_root").alias("component_id"), "kept")


def _near_duplicates(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, n_shingles, component_id, kept) of documents whose ids have one text each."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    signed = staged(by_batch(docs, _sign, "id long, n long, low long, high long, tokens array<long>"), "signed")
    classes = signed.filter("n > 0").groupBy("low", "high", "n").agg(F.min("id").alias("rep"))
    reps = signed.join(classes.select(F.col("rep").alias("id")).distinct(), "id").select("id", "tokens", "n")
    reps = by_batch(reps.dropDuplicates(["id"]), _sketches, "id long, tokens array<long>, n long, sketch binary")
    reps = staged(reps, "classes")

    roots = reps.select("id", F.posexplode(F.slice("tokens", 1, TREES)).alias("tree", "token"))
    points = roots.select(F.xxhash64("tree", "token").alias("node"), "id", F.col("id").alias("comp"))
    comp, leaves, depth = None, [], 0
    while True:
        nodes = staged(_mixed(points), "nodes")
        if nodes.isEmpty():
            break
        points = staged(points.join(nodes, "node"), "points")
        pairs = points.filter("id <> pivot").select("id", "pivot")  # few repeat: pivots differ from tree to tree
        near = by_batch(_with_sketches(pairs, reps), _similar, "id long, pivot long, same long")
        best = near.groupBy("id").agg(F.max(F.struct("same", "pivot")).alias("best"))  # each member's most similar pivot
        pairs = staged(best.select(F.col("id").alias("a"), F.col("best.pivot").alias("b")), "pairs")
        comp = _relabel(comp, confirmed(pairs, docs))
        points = staged(_labelled(points, comp), "points")
        nodes = staged(_mixed(points), "nodes")
        points = points.join(nodes.drop("pivot"), "node")
        few = (F.col("size") <= NODE) | (F.col("others") <= NODE)
        leaves.append(staged(_groups(points.filter(few), False), "leaves"))
        if nodes.filter(~few).isEmpty():
            break
        wide = points.filter(~few)
        if depth == MAX_DEPTH:
            leaves.append(staged(_groups(wide, True), "leaves"))
            break
        depth += 1
        later = TOKENS - TREES
        chosen = [F.pmod(F.xxhash64("node", F.lit(depth * BRANCHES + c)), F.lit(later)).cast("int") + TREES for c in range(BRANCHES)]
        below = wide.join(reps, "id").select("node", "id", "comp", "tokens", F.explode(F.array(*chosen)).alias("k"))
        points = below.select(F.xxhash64("node", "k", F.col("tokens")[F.col("k")]).alias("node"), "id", "comp").distinct()
        points = staged(points, "points")

    if leaves:
        points = leaves[0]
        for more in leaves[1:]:
            points = points.unionByName(more)
        points = _labelled(points.distinct(), comp)
        mixed = points.join(_mixed(points).select("node"), "node").join(reps, "id").select("node", "id", "comp", "sketch")
        close = mixed.groupBy("node").applyInArrow(_candidates, "node long, id long, comp long")
        close = staged(close.distinct().join(reps.select("id", "n"), "id"), "close")
        if not close.isEmpty():
            sets = shingles_of(docs, close.select("id"))
            groups = _bounded(close).join(sets, "id").select("node", "id", "comp", "shingles")
            comp = _relabel(comp, staged(groups.groupBy("node").applyInArrow(_compare, "a long, b long"), "links"))
    known = classes.withColumnRenamed("rep", "id")
    if comp is not None:
        known = known.join(comp, "id", "left")
    else:
        known = known.withColumn("comp", F.lit(None).cast("long"))
    known = staged(known.select("low", "high", "n", F.coalesce("comp", "id").alias("component")), "classes")
    joined = signed.select("id", "n", "low", "high").join(known, ["low", "high", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return joined.select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each component, all columns as they are; rows that repeat an id and text become one row (the one
    of the smallest hash of all columns), different texts of an id are documents of their own, and rows without an id,
    which nothing can refer to, stay as they are."""
    whole, key = one_text_an_id(docs, id_column, text_column) or (docs, id_column)
    own, first = fresh(whole, "_kept"), fresh(whole, "_first")
    found = _near_duplicates(whole.select(key, text_column), key, text_column).filter("kept").select(F.col(key).alias(own)).distinct()
    kept = whole.filter(F.col(key).isNotNull()).join(found, F.col(key) == F.col(own), "left_semi")
    order = F.xxhash64(*[F.col(c) for c in docs.columns])
    one = kept.withColumn(first, F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col(first) == 1)
    return one.select(*docs.columns).unionByName(docs.filter(F.col(id_column).isNull()))
