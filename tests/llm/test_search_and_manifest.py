"""Top-k search, hard negatives and the Merkle manifest against brute force."""

import hashlib
import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from ratebook.llm import queries
from ratebook.llm.hard_negatives import hard_negatives, strassen
from ratebook.llm.merkle import Tree, digest, merkle_manifest, numbered, proof, witnesses
from ratebook.llm.oracles import ORACLES
from ratebook.llm.topk import top_k

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, label int, id long, v string, tile int, at int, score string"


def vectors(n=90, width=6, seed=3):
    """Rows with ties, copies, repeated ids and the awkward cases."""
    r = random.Random(seed)
    rows = [(k, [r.choice([-0.5, -0.1, 0.0, 0.2, 0.9]) for _ in range(width)], r.randrange(3)) for k in range(n)]
    rows += [(r.randrange(1000, 2000) * 5, [0.5] * width, 1) for _ in range(40)]  # one vector many times
    rows += [(10, [0.25] * width, 2), (10, [0.25] * width, 2), (11, [0.3, None, 0.1], 0), (12, None, 0), (None, [0.5] * width, 1)]
    rows += [(13, [math.nan] * width, 0), (14, [math.inf] * width, 0), (15, [], 0), (20, [0.9, 0.9], 1), (25, [1e30] * width, 1)]
    rows += [(-5, [0.4] * width, None), (30, [-0.9] * width, -1)]
    r.shuffle(rows)
    return [(*x, 1, "x", 2, 3, None) for x in rows]


def usable(rows):
    out = []
    for i, v, label, *_ in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [math.floor(256 * float(np.float32(x))) for x in v]
        if sum(x * x for x in ints) < 2**55:
            out.append((i, ints, label))
    return out


def product(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def expected_top(rows, every, k):
    good, out = usable(rows), []
    for i, v, _ in good:
        if i % every == 0:
            best = sorted((-product(v, w), j) for j, w, _ in good if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("k, bits, rows", [(5, 3, (16, 4)), (5, 10, None), (300, 4, (32, 8))])
def test_top_k(spark, rows, k, bits):
    data = vectors()
    df = spark.createDataFrame(data, VECTORS)
    got = top_k(df, F.col("vec_id") % 5 == 0, k, bits=bits, rows=rows)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == expected_top(data, 5, k)


def test_top_k_of_large_components(spark):
    data = [(k, [float(2**19 + k), -3.0 * k], 0, 1, "x", 2, 3, None) for k in range(30)]
    got = top_k(spark.createDataFrame(data, VECTORS.replace("float", "double")), F.col("vec_id") % 5 == 0, 3, rows=(8, 4))
    good = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in data]
    assert max(product(v, v) for _, v in good) > 2**53  # beyond what doubles add exactly
    want = []
    for i, v in good[::5]:
        best = sorted((-product(v, w), j) for j, w in good if j != i)[:3]
        want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert sorted(map(tuple, got.collect())) == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert top_k(empty, F.col("vec_id") % 5 == 0).collect() == []
    assert hard_negatives(empty, F.col("vec_id") % 5 == 0).collect() == []
    one = spark.createDataFrame([(0, [0.5], 1, 1, "x", 2, 3, None)], VECTORS)
    assert top_k(one, F.col("vec_id") % 5 == 0).collect() == []
    assert hard_negatives(one, F.col("vec_id") % 5 == 0).collect() == []


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 3, 7), (33, 17, 40), (64, 64, 64), (20, 0, 3), (0, 4, 4)])
def test_strassen(shape):
    m, k, n = shape
    r = np.random.default_rng(1)
    a, b = r.integers(-(2**27), 2**27, (m, k)), r.integers(-(2**27), 2**27, (k, n))
    assert (strassen(a, b, leaf=2) == a @ b).all()
    assert (strassen(a << 30, b, leaf=2) == (a << 30) @ b).all()  # modulo 2**64 where sums overflow


def expected_negatives(rows, every, p, n, window):
    good = [x for x in usable(rows) if x[2] is not None]
    out = []
    for i, v, label in good:
        if i % every:
            continue
        for s, j in sorted((-product(v, w), j) for j, w, other in good if j != i and other == label)[:p]:
            low, high = window[0] * -s, window[1] * -s
            hard = sorted((-product(v, w), x) for x, w, other in good if other != label and low <= 100 * product(v, w) <= high)[:n]
            out += [(i, j, r, x, -s, -t) for r, (t, x) in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize("rows, p, n", [((16, 4), 5, 3), (None, 5, 3), ((8, 8), 2, 30)])
def test_hard_negatives(spark, rows, p, n):
    data = vectors(seed=8)
    df = spark.createDataFrame(data, VECTORS)
    got = hard_negatives(df, F.col("vec_id") % 5 == 0, positives_wanted=p, negatives_wanted=n, rows=rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == expected_negatives(data, 5, p, n, (50, 95))


def test_hard_negatives_of_large_and_negative_scores(spark):
    r = random.Random(4)
    data = [(k, [r.uniform(-3e4, 3e4) for _ in range(40)], k % 2, 1, "x", 2, 3, None) for k in range(60)]
    got = hard_negatives(spark.createDataFrame(data, VECTORS), F.col("vec_id") % 5 == 0, rows=(16, 8), positives_wanted=29)
    assert sorted(map(tuple, got.collect())) == expected_negatives(data, 5, 29, 3, (50, 95))


# ------------------------------------------------------------------------------------------------------------- manifest


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(leaves, arity=3):
    out = [list(leaves)]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([h("".join(last[k : k + arity])) for k in range(0, len(last), arity)])
    return out


def path(tree, at, arity=3):
    """(left siblings, right siblings) of a leaf, level by level."""
    out = []
    for nodes in tree[:-1]:
        first = at // arity * arity
        run = nodes[first : first + arity]
        out.append((run[: at - first], run[at - first + 1 :]))
        at //= arity
    return out


def folded(leaf, steps):
    for left, right in steps:
        leaf = h("".join(left) + leaf + "".join(right))
    return leaf


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 82])
def test_tree(n):
    leaves = [h(str(k)) for k in range(n)]
    tree = Tree()
    for k, leaf in enumerate(leaves):
        tree.append(leaf)
        assert len(tree.witness) == k + 1
    want = levels(leaves)
    assert tree.close() == want[-1][0]
    assert tree.witness == [[("".join(a), "".join(b)) for a, b in path(want, k)] for k in range(n)]


def test_partial_witnesses_grow_with_later_siblings():
    tree = Tree()
    tree.append("a")
    assert tree.witness == [[]] and tree.runs[0][0].right == ""
    tree.append("b")
    assert tree.witness == [[], []] and tree.runs[0][0].right == "b" and tree.runs[0][1].left == "a"
    tree.append("c")
    assert tree.witness == [[("", "bc")], [("a", "c")], [("ab", "")]] and tree.runs[1][0].root == digest("abc")


@pytest.mark.parametrize("sizes", [(1, 2, 3), (9, 10, 81), (82, 8, 250)])
def test_witnesses_over_blocks(spark, sizes):
    rows = [(f"t{t}", k, n, h(f"{t}-{k}")) for t, n in enumerate(sizes) for k in range(n)]
    got = witnesses(spark.createDataFrame(random.sample(rows, len(rows)), "tree string, at long, size long, leaf string"), height=2).collect()
    assert len(got) == len(rows)
    trees = {f"t{t}": levels([h(f"{t}-{k}") for k in range(n)]) for t, n in enumerate(sizes)}
    for row in got:
        tree = trees[row.tree]
        assert row.leaf == tree[0][row["at"]] and row.root == tree[-1][0]
        assert [(x.left, x.right) for x in row.witness] == [("".join(a), "".join(b)) for a, b in path(tree, row["at"])]


def test_numbered_in_several_partitions(spark):
    rows = [("hot" if k % 3 else f"t{k % 7}", r) for k, r in enumerate(random.Random(2).choices([None, *range(40)], k=500))]
    df = spark.createDataFrame(rows, "tree string, x long").repartition(7)
    got = numbered(df, "tree", ["x"], "test").collect()
    for tree in {t for t, _ in rows}:
        mine = sorted((r["at"], r.x) for r in got if r.tree == tree)
        assert {r["size"] for r in got if r.tree == tree} == {len(mine)}
        want = sorted((x for t, x in rows if t == tree), key=lambda x: (x is not None, x or 0))
        assert mine == list(enumerate(want))


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


DOCS = "doc_id long, text string, lang string, source string, n_chars int, leaf string, tree int, root string, id string"


def documents(n=120):
    r = random.Random(5)
    rows = [(i, f"té\n{i}\n", "en", r.choice(["b", "a", "é", "", None, "z", "z", "z"]), i) for i in r.sample(range(1000), n)]
    rows += [(2000, None, None, None, None), (None, "x", "en", "a", 1), (None, "y", "en", "a", 1), (2001, "", "en", "lone", 0)]
    rows += [(2002, "same\n", "en", "z", 5)] * 4 + [(2002, "other\n", "en", "z", 6), (2003, "long word\n" * 30_000, "en", "b", 9)]
    return rows


def expected_manifest(rows, tampered):
    groups = {}
    for row in rows:
        i, text, lang, source, n = row
        leaf = h("".join(map(value, (i, source, lang, n, text))))
        other = tampered(row)
        groups.setdefault(source, []).append((i is not None, i or 0, leaf, row, other))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, (_, _, leaf, row, other) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            steps = path(trees[s], at) + path(top, k)
            i, _, lang, source, n = row
            start = leaf if other is None else h("".join(map(value, (i, source, lang, n, other))))
            end = folded(start, steps)
            shown = h("".join("".join(a) + "".join(b) for a, b in steps))
            out.append((i, leaf, trees[s][-1][0], top[-1][0], shown, end, end == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("height", [1, 2, 7])
def test_manifest(spark, height):
    data = documents()
    df = spark.createDataFrame([(*x, "x", 1, "y", "z") for x in data], DOCS)
    got = merkle_manifest(df, F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))), height=height)
    got = got.select("doc_id", "leaf", "subroot", "root", proof(F.col("witness")), "folded_root", "verified")

    def tampered(row):
        return row[1].replace("\n", "") if row[0] is not None and row[0] % 2 == 0 and row[1] is not None else None

    want = expected_manifest(data, tampered)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {x[-1] for x in want} == {True, False}
    plain = merkle_manifest(df, height=height)
    assert plain.filter("verified").count() == len(data)


def test_manifest_of_an_empty_table(spark):
    assert merkle_manifest(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables not present")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(result.fetchall(), key=repr)
