"""Substring deduplication with suffix automata of reference shards.

A window is ``WINDOW`` consecutive words of one document.  A word goes if a window over it has the same words as a window
that starts earlier (in a document of smaller id, or further up in the same document).

1. Every window is assigned an anchor, the smallest hash of the ``GRAM``-word runs inside it.  Equal windows have equal
   anchors at equal places, so only passages around an anchor that occurs twice can hold repeated windows.  Windows next
   to each other mostly share their anchor; such a run of windows is a passage.
2. Equal passages are one: all but the first occurrence are covered by the first.
3. The different passages of an anchor are the reference texts of a shard (shards hold many anchors, by hash).  Each
   shard builds the suffix automaton of its passages and streams them through it: matching statistics of at least
   ``WINDOW`` words give the windows that occur elsewhere in the shard, and the state says where first.
4. An anchor with more than ``SHARED`` different passages (a phrase in very many contexts) would make a shard grow
   without bound.  Its windows are grouped by their hash instead, and the first of each group stays: as exact, and
   pre-aggregated before the shuffle.

What comes out for a document are the windows that may be repeated and those of them that are the first of their kind;
the rest of the former are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import SPACE, Sequences, U, Words, blocks, bounded_batches, lists, longs
from .work import fresh, by_batch, keep_ids, one_text_an_id, staged

WINDOW, GRAM, SHARED, SHARDS = 20, 10, 256, 64
_PLACE = U((1 << 28) - 1)


def _passages(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Sequences]:
    """(first window, number of windows, anchor hash) of each passage of a block, and the block's word sequences."""
    runs = Sequences(words.hashes())
    grams = runs.all(gram)
    n, width = len(words) - window + 1, window - gram + 1
    if n <= 0:
        return np.empty(0, int), np.empty(0, int), np.empty(0, U), runs
    # the leftmost smallest gram of each window: the place is the lower part of what is compared
    low = (grams & ~_PLACE) | np.arange(len(grams), dtype=U)
    reach = 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    inside = np.flatnonzero(np.arange(n) + window <= words.stop[:n])
    if not len(inside):
        return np.empty(0, int), np.empty(0, int), np.empty(0, U), runs
    anchor = (low[inside] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return inside[new], np.diff(np.append(new, len(inside))), grams[anchor[new]], runs


def _anchors(batch: pa.RecordBatch, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for _, _, data, bounds in blocks(batch.column(0)):
        yield pa.RecordBatch.from_arrays([longs(_passages(Words(data, bounds, SPACE), window, gram)[2])], names=["anchor"])


def _occurrences(batch: pa.RecordBatch, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for i, j, data, bounds in blocks(batch.column(1)):
        words = Words(data, bounds, SPACE)
        start, count, anchor, runs = _passages(words, window, gram)
        doc = np.searchsorted(words.first, start, "right") - 1
        passage = runs.of(start, count + window - 1) if len(start) else anchor
        yield pa.RecordBatch.from_arrays(
            [
                longs(anchor),
                longs(passage),
                batch.column(0)[i:j].take(pa.array(doc)),
                pa.array((start - words.first[doc]).astype(np.int32)),
                pa.array(count.astype(np.int32)),
            ],
            names=["anchor", "passage", "id", "start", "windows"],
        )


def _wanted_texts(batch: pa.RecordBatch, window: int) -> Iterator[pa.RecordBatch]:
    """Hashes of the words of the wanted passages: (anchor, id, start, words)."""
    for i, j, data, bounds in blocks(batch.column(1)):
        words = Words(data, bounds, SPACE)
        hashes = words.hashes()
        wanted = batch.column(2)[i:j]
        per = np.diff(np.asarray(wanted.offsets))
        flat = wanted.flatten()
        start = flat.field("start").to_numpy()
        doc = np.repeat(np.arange(j - i), per)
        size = flat.field("windows").to_numpy().astype(np.int64) + window - 1
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(words.first[doc] + start - (ends - size), size)
        yield pa.RecordBatch.from_arrays(
            [
                flat.field("anchor"),
                batch.column(0)[i:j].take(pa.array(doc)),
                pa.array(start),
                lists(hashes[at], np.concatenate([[0], ends])),
            ],
            names=["anchor", "id", "start", "words"],
        )


class Automaton:
    """Suffix automaton of several word sequences; each state knows the end of its first occurrence.

    Sequences must be added in the order of their places, so that the first occurrence is also the earliest.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [(0, 0)]

    def add(self, words: list[int], id_: int, start: int) -> None:
        last = 0
        for place, word in enumerate(words, start):
            last = self._extend(last, word, (id_, place))

    def _extend(self, last: int, word: int, place: tuple[int, int]) -> int:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        known = nxt[last].get(word)
        if known is not None:
            if length[known] == length[last] + 1:
                return known
            return self._split(last, known, word)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        first.append(place)
        link.append(0)
        p = last
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p != -1:
            q = nxt[p][word]
            link[new] = q if length[p] + 1 == length[q] else self._split(p, q, word)
        return new

    def _split(self, p: int, q: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.first.append(self.first[q])
        link[q] = copy
        while p != -1 and nxt[p].get(word) == q:
            nxt[p][word] = copy
            p = link[p]
        return copy

    def matches(self, words: list[int], longest: int) -> Iterator[tuple[int, int]]:
        """Matching statistics, cut off at ``longest``: (length, state) of the longest run of words that ends at each
        word and occurs in the automaton."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        for word in words:
            while state and word not in nxt[state]:
                state = link[state]
                size = length[state]
            if word in nxt[state]:
                state = nxt[state][word]
                size += 1
            while size >= longest and length[link[state]] >= longest:
                state = link[state]
            size = min(size, longest)
            yield size, state


def first_windows(rows: list[tuple[int, int, list[int]]], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """Runs (id, first window, number) of the windows of the passages ``rows`` (id, start, words) that occur in no
    earlier place of any of the passages."""
    automaton = Automaton()
    rows = sorted(rows, key=lambda r: r[:2])
    for id_, start, words in rows:
        automaton.add(words, id_, start)
    kept: list[tuple[int, int, int]] = []
    for id_, start, words in rows:
        for place, (size, state) in enumerate(automaton.matches(words, window), start):
            if size < window or automaton.first[state] < (id_, place):
                continue
            begin = place - window + 1
            if kept and kept[-1][0] == id_ and kept[-1][1] + kept[-1][2] == begin and begin > start:
                kept[-1] = (id_, kept[-1][1], kept[-1][2] + 1)
            else:
                kept.append((id_, begin, 1))
    return kept


def _shard(table: pa.Table, window: int) -> pa.Table:
    kept = first_windows(list(zip(*(table[k].to_pylist() for k in ("id", "start", "words")), strict=True)), window)
    columns = list(zip(*kept, strict=True)) or [(), (), ()]
    kinds = (pa.int64(), pa.int32(), pa.int32())
    return pa.table([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["id", "start", "windows"])


def _single_windows(batch: pa.RecordBatch, window: int) -> Iterator[pa.RecordBatch]:
    """Each window of a passage as a row, with two hashes of its words."""
    words = batch.column(2)
    size = np.diff(np.asarray(words.offsets))
    flat = np.asarray(words.flatten()).view(U)
    n = size - window + 1
    ends = np.cumsum(n)
    offset = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
    at = np.repeat(np.cumsum(size) - size, n) + offset
    row = np.repeat(np.arange(len(size)), n)
    low, high = (Sequences(flat, salt).of(at, window) for salt in (0, 0x5851F42D4C957F2D))
    place = batch.column(1).to_numpy()[row] + offset
    yield pa.RecordBatch.from_arrays(
        [longs(low), longs(high), batch.column(0).take(pa.array(row)), pa.array(place.astype(np.int32))],
        names=["low", "high", "id", "start"],
    )


def _cover(n: int, runs: list[tuple[int, int]], width: int) -> np.ndarray:
    """Marks of n places under runs of (first, count), each widened by width - 1 at its end."""
    delta = np.zeros(n + 1, np.int32)
    if len(runs):
        begin, count = np.array(runs).T
        np.add.at(delta, begin, 1)
        np.add.at(delta, np.minimum(begin + count + width - 1, n), -1)
    return np.cumsum(delta[:-1]) > 0


def _cut(batch: pa.RecordBatch, window: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    """Kept text (or its digest) of each row from its text, its doubtful windows and those of them that stay."""
    doubtful, stays = batch.column(2), batch.column(3)
    found = np.asarray(doubtful.is_valid())
    texts = batch.column(1).cast(pa.binary())
    total, gone, out = [], [], []
    for k, text in enumerate(texts):
        words = (text.as_py() or b"").split()
        total.append(len(words))
        removed = 0
        if found[k]:
            pairs = [[(r["start"], r["windows"]) for r in x[k].as_py() or ()] for x in (doubtful, stays)]
            n = max(0, len(words) - window + 1)
            windows = np.flatnonzero(_cover(n, pairs[0], 1) & ~_cover(n, pairs[1], 1))
            removed_words = _cover(len(words), [(w, 1) for w in windows], window)
            removed = int(removed_words.sum())
            words = [w for w, x in zip(words, removed_words.tolist(), strict=True) if not x]
        gone.append(removed)
        if not with_text:
            out.append(hashlib.sha256(b" ".join(words)).hexdigest())
        elif removed:
            out.append(b" ".join(words).decode())
        else:
            out.append(None)
    yield pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())],
        names=["id", "n_words", "n_removed", "kept"],
    )


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, doubtful, stays): runs of windows of a document that may be repeated, and those that are first of their kind.
    Documents without the former have no row.  ``docs`` is (id, text)."""
    anchors = by_batch(docs.select("text"), lambda b: _anchors(b, window, gram), "anchor long")
    # written, so that the join below has a plain exchange on both sides and hot anchors are split
    repeated = staged(anchors.groupBy("anchor").count().filter("count > 1").select("anchor"), "anchors")
    schema = "anchor long, passage long, id long, start int, windows int"
    found = by_batch(docs, lambda b: _occurrences(b, window, gram), schema)
    found = staged(found.join(repeated.hint("merge"), "anchor"), "passages")

    first = F.min(F.struct("id", "start", "windows")).alias("at")
    distinct = staged(found.groupBy("anchor", "passage").agg(first), "distinct-passages")
    counts = staged(distinct.groupBy("anchor").agg(F.count("*").alias("different")), "counts")
    distinct = staged(distinct.select("anchor", "at.*").join(counts.hint("merge"), "anchor"), "references")
    runs = ["id", "start", "windows"]
    alone = distinct.filter("different = 1").select(*runs)

    wanted = distinct.filter("different > 1").groupBy("id").agg(F.collect_list(F.struct("anchor", "start", "windows")).alias("w"))
    wanted = staged(wanted, "wanted")
    holders = keep_ids(docs, wanted, "id", "inner").select("id", "text", "w")
    texts = by_batch(holders, lambda b: _wanted_texts(b, window), "anchor long, id long, start int, words array<long>")
    texts = texts.dropDuplicates(["anchor", "id", "start"])
    texts = staged(texts.join(counts.hint("merge"), "anchor"), "reference-texts")
    few = texts.filter(F.col("different") <= SHARED)
    size = few.agg(F.sum(F.size("words"))).first()[0] or 0
    shards = max(SHARDS, size // 200_000)
    few = few.select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "id", "start", "words")
    few = few.groupBy("shard").applyInArrow(lambda t: _shard(t.drop_columns("shard"), window), "id long, start int, windows int")
    many = texts.filter(F.col("different") > SHARED).select("id", "start", "words")
    many = by_batch(many, lambda b: _single_windows(b, window), "low long, high long, id long, start int")
    many = many.groupBy("low", "high").agg(F.min(F.struct("id", "start")).alias("at")).select("at.*", F.lit(1).alias("windows"))

    stays = alone.unionByName(few).unionByName(many)
    every = found.select(*runs, F.lit(True).alias("doubt")).unionByName(stays.select(*runs, F.lit(False).alias("doubt")))
    run = F.struct("start", "windows")
    return staged(
        every.groupBy("id").agg(
            F.collect_list(F.when(F.col("doubt"), run)).alias("doubtful"), F.collect_list(F.when(~F.col("doubt"), run)).alias("stays")
        ),
        "windows",
    )


def _joined(docs: DataFrame, id_column: str, text_column: str, with_text: bool, window: int) -> DataFrame:
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    runs = repeated_windows(docs.filter("id is not null"), window)
    whole = keep_ids(docs, runs, "id", "inner" if with_text else "left").select("id", "text", "doubtful", "stays")
    schema = "id long, n_words long, n_removed long, kept string"
    return by_batch(whole, lambda b: _cut(b, window, with_text), schema)


def substring_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) for each row of ``docs``.

    Null texts have no words; texts shorter than a window lose nothing.  Rows without an id are not compared and keep
    all words.  Rows that repeat an id and text are one place, not copies of each other; different texts of an id are
    documents of their own, in the order of their digests.
    """
    docs = docs.select(id_column, text_column)
    placed = one_text_an_id(docs, id_column, text_column)
    if placed is None:
        found = _joined(docs, id_column, text_column, False, window)
    else:
        docs, place = placed
        names = docs.select(F.col(place).alias("id"), F.col(id_column).cast("long").alias("_of")).filter("id is not null").distinct()
        found = _joined(docs, place, text_column, False, window).join(names, "id", "left").drop("id").withColumnRenamed("_of", "id")
    return found.select(F.col("id").alias(id_column), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def remove_substrings(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages cut out of the text (its other words joined by one space); texts that lose nothing
    stay as they are, texts that lose all words are dropped.  All columns of ``docs`` are returned."""
    columns, placed = docs.columns, one_text_an_id(docs, id_column, text_column)
    if placed is not None:
        docs, id_column = placed
    own, kept = fresh(docs, "_id"), fresh(docs, "_kept")
    cut = _joined(docs, id_column, text_column, True, window).filter("n_removed > 0")
    cut = staged(cut.select(F.col("id").alias(own), F.col("kept").alias(kept)).dropDuplicates([own]), "cut")
    out = docs.join(cut, F.col(id_column) == F.col(own), "left").filter(F.col(kept).isNull() | (F.col(kept) != ""))
    text = F.coalesce(F.col(kept), F.col(text_column))
    return out.select(*[text.alias(c) if c == text_column else F.col(c) for c in columns])
