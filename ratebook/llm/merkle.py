"""Merkle manifest of a dataset, with an incremental witness for each row.

Rows are leaves of a tree per source, the roots of the sources are leaves of one more tree.  Leaves are appended in order;
the subtrees that are still open carry a partial witness for the leaves below them, which grows by each sibling that is
completed later.  A block of SPAN consecutive leaves is aligned with the tree, so blocks are appended by different tasks,
and their roots are the leaves of further appends.  A leaf's witness is that of its block below and, from there on, that of
the block's root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import bounded_batches
from .work import numbered, staged

ARITY = 3
#: Height of a block, and its leaves.
HEIGHT = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WITNESS = "array<struct<left: string, right: string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class _Open:
    """A completed subtree in a run that is still open: its leaves, and the siblings that have come so far."""

    __slots__ = ("first", "last", "left", "right", "root")

    def __init__(self, root: str, first: int, last: int, left: str):
        self.root, self.first, self.last, self.left, self.right = root, first, last, left, ""


class Tree:
    """Append-only tree that keeps a witness for each leaf: (siblings to the left, siblings to the right) a level."""

    def __init__(self, arity: int = ARITY):
        self.arity = arity
        self.runs: list[list[_Open]] = []
        self.witness: list[list[tuple[str, str]]] = []

    def append(self, leaf: str) -> None:
        at = len(self.witness)
        self.witness.append([])
        self._add(0, leaf, at, at + 1)

    def _add(self, level: int, root: str, first: int, last: int) -> None:
        if level == len(self.runs):
            self.runs.append([])
        run = self.runs[level]
        for sibling in run:
            sibling.right += root
        run.append(_Open(root, first, last, "".join(x.root for x in run)))
        if len(run) == self.arity:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        for x in run:
            step = x.left, x.right
            for leaf in range(x.first, x.last):
                self.witness[leaf].append(step)
        self._add(level + 1, digest("".join(x.root for x in run)), run[0].first, run[-1].last)

    def close(self, height: int | None = None) -> str:
        """The root; open runs are completed as they are, up to ``height`` or until one node remains."""
        level = 0
        while True:
            run = self.runs[level]
            if height is None:
                if len(run) == 1 and not any(self.runs[level + 1 :]):
                    return run[0].root
            elif level == height:
                return run[0].root
            if run:
                self._complete(level)
            level += 1


def fold(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and the siblings of its witness give."""
    return F.aggregate(witness, leaf, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))


def proof(witness: Column) -> Column:
    """Digest of a witness: of its siblings level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(witness, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def leaf_of(columns: Sequence[Column]) -> Column:
    """Digest of values, each as its byte count, a colon and its text; null is a dash."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def witnesses(leaves: DataFrame, name: str = "tree", height: int = HEIGHT, arity: int = ARITY) -> DataFrame:
    """(tree, at, leaf, witness, root) of (tree, at, size, leaf), where ``at`` counts the ``size`` leaves of a tree from 0.
    Leaves are dealt out by tree and block, so a large tree is as many tasks as it has blocks."""
    span = arity**height
    whole = leaves.withColumn("block", F.expr(f"at div {span}"))

    def append(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        tree = Tree(arity)
        for leaf in table["leaf"].to_pylist():
            tree.append(leaf)
        root = tree.close(None if table["size"][0].as_py() <= span else height)
        rows = [[{"left": a, "right": b} for a, b in steps] for steps in tree.witness]
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        kept = table.select(["tree", "at", "leaf", "size", "block"])
        return kept.append_column("below", pa.array(rows, kind)).append_column("top", pa.array([root] * len(rows), pa.string()))

    schema = f"tree string, at long, leaf string, size long, block long, below {WITNESS}, top string"
    dealt = whole.select("tree", "at", "leaf", "size", "block").repartition("tree", "block")
    done = dealt.groupBy("tree", "block").applyInArrow(append, schema)
    done = staged(done, f"{name}-blocks")
    if done.filter(F.col("size") > span).isEmpty():
        return done.select("tree", "at", "leaf", F.col("below").alias("witness"), F.col("top").alias("root"))
    tops = done.filter((F.col("at") % span == 0) & (F.col("size") > span))
    fewer = F.expr(f"(size + {span - 1}) div {span}").alias("size")
    above = witnesses(tops.select("tree", F.col("block").alias("at"), fewer, F.col("top").alias("leaf")), name, height, arity)
    above = above.select("tree", F.col("at").alias("block"), F.col("witness").alias("above"), "root")
    rest = F.coalesce("above", F.array().cast(WITNESS))
    return done.join(above, ["tree", "block"], "left").select(
        "tree", "at", "leaf", F.concat("below", rest).alias("witness"), F.coalesce("root", "top").alias("root")
    )


def merkle_manifest(
    df: DataFrame,
    tampered: Column | None = None,
    *,
    fields: Sequence[str] = FIELDS,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
    height: int = HEIGHT,
) -> DataFrame:
    """(id, leaf, subroot, root, witness, folded_root, verified) for each row.

    A row's leaf is the digest of its ``fields``.  Leaves of a source are in the order of their ids (null first, equal
    ones by digest); sources are in the order of their bytes (null first, a tree of its own).  ``witness`` leads from the
    leaf to the root of all.  ``folded_root`` is the root that follows from it and the leaf with ``tampered`` in place of
    the text (null where the text is as it was); ``verified`` says that it is the root.

    Null values have a leaf of their own, other than empty ones.  Repeated rows are as many leaves.  An empty table has no
    rows.  Columns that are not named don't matter.
    """
    bounded_batches(df.sparkSession)
    changed = F.lit(None).cast("string") if tampered is None else tampered
    other = leaf_of([changed if c == text_column else F.col(c) for c in fields])
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_column).cast("string")), F.lit("-"))
    leaves = df.select(
        F.col(id_column).cast("long").alias("id"), source.alias("tree"), leaf_of([F.col(c) for c in fields]).alias("leaf"),
        F.when(changed.isNotNull(), other).alias("other"),
    )
    placed = staged(numbered(staged(leaves, "leaves"), "tree", ["id", "leaf"], "leaves"), "leaves-numbered")
    own = witnesses(placed.select("tree", "at", "size", "leaf"), "leaves", height)

    subroots = own.filter("at = 0").select(F.col("tree").alias("name"), F.col("root").alias("leaf"), F.lit("all").alias("tree"))
    sources = staged(numbered(subroots, "tree", ["name"], "sources"), "sources-numbered")
    upper = witnesses(sources.select("tree", "at", "size", "leaf"), "sources", height)
    above = sources.select("at", F.col("name").alias("tree")).join(
        upper.select("at", F.col("leaf").alias("subroot"), F.col("witness").alias("above"), F.col("root").alias("all_root")), "at"
    )
    whole = own.drop("leaf", "root").join(placed, ["tree", "at"]).join(above.drop("at"), "tree")
    whole = whole.withColumn("witness", F.concat("witness", "above"))
    whole = whole.withColumn("folded_root", fold(F.coalesce("other", "leaf"), F.col("witness")))
    return whole.select(
        F.col("id").alias(id_column), "leaf", "subroot", F.col("all_root").alias("root"), "witness", "folded_root",
        (F.col("folded_root") == F.col("all_root")).alias("verified"),
    )
