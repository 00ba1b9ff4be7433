"""Benchmark decontamination as a prefix-filtered set join.

A window is ``WINDOW`` consecutive words of a benchmark item (a shorter item is one window).  Its shingles are its runs
of ``SHINGLE`` words.  A document that contains a window contains all its shingles, so the necessary prefix is one
shingle: the rarest of the window, by counts over all documents.  Documents are joined with windows on these prefix
shingles only; the place of the shingle in the window bounds where the window can start and end in the document
(positional and length bounds), and the words there are compared with those of the window.

The index of prefix shingles is broadcast in shards of bounded size: a benchmark of up to ``SHARD_BYTES`` of text is one
shard, a larger one is several, each of which is streamed past the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import LOWER, NOT_ALNUM, Sequences, U, Words, blocks, bounded_batches, longs
from .work import by_batch, keep_ids, one_text_an_id, staged

WINDOW, SHINGLE, SHARD_BYTES = 10, 3, 8 << 20


class Windows:
    """Distinct windows of a shard of items."""

    def __init__(self, items: list[str], texts: list[str | None], window: int):
        array = pa.array([t or "" for t in texts], pa.string())
        place: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.items: list[set[str]] = []
        for i, _, data, bounds in blocks(array):
            data = LOWER[data]
            words = Words(data, bounds, NOT_ALNUM)
            text = data.tobytes()
            for d, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
                for k in range(a, max(b - window, a) + 1 if b > a else a):
                    run = b" ".join(text[words.start[j] : words.end[j]] for j in range(k, min(k + window, b)))
                    at = place.setdefault(run, len(self.words))
                    if at == len(self.words):
                        self.words.append(run)
                        self.items.append(set())
                    self.items[at].add(items[i + d])
        joined = pa.array([b" ".join(self.words)], pa.binary())
        hashes = np.empty(0, U)
        if self.words:
            ((_, _, data, bounds),) = blocks(joined, 1 << 62)
            hashes = Words(data, bounds, NOT_ALNUM).hashes()
        runs = Sequences(hashes)
        self.length = np.array([w.count(b" ") + 1 for w in self.words], np.int64)
        first = np.cumsum(self.length) - self.length
        self.hash = runs.of(first, self.length) if len(first) else np.empty(0, U)
        size = np.minimum(self.length, SHINGLE)
        per = self.length - size + 1
        self.window = np.repeat(np.arange(len(per)), per)
        self.offset = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        self.size = size[self.window]
        self.shingle = runs.of(first[self.window] + self.offset, self.size) if len(first) else np.empty(0, U)

    def prefixes(self, counts: dict[int, int]) -> dict[str, np.ndarray]:
        """One shingle of each window, the rarest (then the first), sorted by hash for the join."""
        seen = np.array([counts.get(int(s), 0) for s in self.shingle.view(np.int64)], np.int64)
        order = np.lexsort((self.offset, seen, self.window))
        rarest = order[np.searchsorted(self.window[order], np.arange(len(self.length)))]
        rarest = rarest[seen[rarest] > 0]  # a window with a shingle that no document has occurs nowhere
        rarest = rarest[np.argsort(self.shingle[rarest], kind="stable")]
        at = self.window[rarest]
        return {
            "shingle": self.shingle[rarest],
            "size": self.size[rarest],
            "offset": self.offset[rarest],
            "window": at,
            "length": self.length[at],
            "hash": self.hash[at],
        }


def _grams(words: Words, runs: Sequences, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the runs of ``size`` words inside documents."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, U)
    start = np.flatnonzero(np.arange(n) + size <= words.stop[:n])
    return start, runs.all(size)[start]


def _members(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into values, first place in the sorted ``wanted``) of values that are wanted."""
    # most values are told apart by a small table of bits before the search
    bits = np.zeros(1 << 20, bool)
    bits[(wanted >> U(44)).astype(np.int64)] = True
    maybe = np.flatnonzero(bits[(values >> U(44)).astype(np.int64)])
    at = np.searchsorted(wanted, values[maybe])
    at[at == len(wanted)] = 0
    hit = wanted[at] == values[maybe]
    return maybe[hit], at[hit]


def _count(batch: pa.RecordBatch, wanted: np.ndarray, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """How often the wanted shingles occur in a batch."""
    total = np.zeros(len(wanted), np.int64)
    for _, _, data, bounds in blocks(batch.column(0)):
        words = Words(LOWER[data], bounds, NOT_ALNUM)
        runs = Sequences(words.hashes())
        for size in sizes:
            _, at = _members(_grams(words, runs, size)[1], wanted)
            total += np.bincount(at, minlength=len(wanted))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([longs(wanted[some]), longs(total[some])], names=["shingle", "n"])


def _hits(batch: pa.RecordBatch, index: dict[str, np.ndarray], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """(id, start, words, window) of each occurrence of a window, per document."""
    sizes = sorted(set(index["size"].tolist()))
    for i, j, data, bounds in blocks(batch.column(1)):
        data = LOWER[data]
        words = Words(data, bounds, NOT_ALNUM)
        runs = Sequences(words.hashes())
        stop = words.stop
        begin = words.first[np.searchsorted(words.first, np.arange(len(words)), "right") - 1] if len(words) else stop
        rows: list[tuple[int, int, int, int]] = []
        for size in sizes:
            start, grams = _grams(words, runs, size)
            which, at = _members(grams, index["shingle"])
            while len(which):  # windows that share a prefix shingle follow each other in the index
                first = start[which] - index["offset"][at]
                length = index["length"][at]
                fits = (index["size"][at] == size) & (first >= begin[start[which]]) & (first + length <= stop[start[which]])
                same = np.flatnonzero(fits)
                same = same[runs.of(first[same], length[same]) == index["hash"][at[same]]]
                for k in same:
                    a, n, w = int(first[k]), int(length[k]), int(index["window"][at[k]])
                    found = b" ".join(data[words.start[x] : words.end[x]].tobytes() for x in range(a, a + n))
                    if found == texts[w]:
                        rows.append((int(np.searchsorted(words.first, a, "right")) - 1, a, n, w))
                more = at + 1 < len(index["shingle"])
                which, at = which[more], at[more] + 1
                more = index["shingle"][at] == grams[which]
                which, at = which[more], at[more]
        if rows:
            doc, a, n, w = (np.array(x) for x in zip(*sorted(set(rows)), strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j].take(pa.array(doc)), longs(a - words.first[doc]), longs(n), longs(w)],
                names=["id", "start", "length", "window"],
            )


def _digest(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Word counts, hit words and items of each document from its text and what was found in it."""
    totals, hit, items, digests = [], [], [], []
    for i, j, data, bounds in blocks(batch.column(1)):
        totals.extend(Words(data, bounds, NOT_ALNUM).counts.tolist())
        for k in range(i, j):
            delta = np.zeros(totals[k] + 1, np.int64)
            for run in batch.column(2)[k].as_py() or ():
                delta[run["start"]] += 1
                delta[run["start"] + run["length"]] -= 1
            hit.append(int((np.cumsum(delta)[:-1] > 0).sum()))
            found = sorted(set(batch.column(3)[k].as_py() or ()))
            items.append(len(found))
            digests.append(hashlib.sha256(",".join(found).encode()).hexdigest())
    yield pa.RecordBatch.from_arrays(
        [batch.column(0), *(pa.array(x, pa.int64()) for x in (totals, hit, items)), pa.array(digests, pa.string())],
        names=["id", "n_words", "n_hit", "n_items", "items_sha256"],
    )


def _shards(benchmark: DataFrame) -> Iterator[tuple[list[str], list[str | None]]]:
    """Items in parts of about SHARD_BYTES; each is collected on its own."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // SHARD_BYTES) or 1
    for part in range(parts):
        rows = benchmark.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).collect()
        yield [r["item"] for r in rows], [r["text"] for r in rows]


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, start, length, item) for each window of an item in a document; ``docs`` is (id, text), ``benchmark`` is
    (item, text).  Written as it is found, one part per shard of the benchmark."""
    context = docs.sparkSession.sparkContext
    found = None
    for items, texts in _shards(benchmark):
        windows = Windows(items, texts, window)
        if not windows.words:
            continue
        wanted = np.unique(windows.shingle)
        sizes = sorted(set(windows.size.tolist()))
        sent = context.broadcast(wanted)
        counted = by_batch(docs.select("text"), lambda b, s=sent, z=sizes: _count(b, s.value, z), "shingle long, n long")
        counts = {r["shingle"]: r["n"] for r in counted.groupBy("shingle").agg(F.sum("n").alias("n")).collect()}
        index = context.broadcast((windows.prefixes(counts), windows.words))
        hits = by_batch(docs, lambda b, s=index: _hits(b, *s.value), "id long, start long, length long, window long")
        names = [(w, i) for w, members in enumerate(windows.items) for i in sorted(members)]
        schema = "window long, item string"
        names = docs.sparkSession.createDataFrame(names, schema)
        part = staged(hits, "hits").join(F.broadcast(names), "window").select("id", "start", "length", "item")
        found = part if found is None else found.unionByName(part)
        sent.destroy()  # the hits are written
        index.destroy()
    return docs.sparkSession.createDataFrame([], "id long, start long, length long, item string") if found is None else found


def _plain(docs: DataFrame, benchmark: DataFrame, id_column: str, text_column: str, item_column: str, item_text: str):
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    items = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(item_text).alias("text"))
    return docs, items.filter("item is not null")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs``.

    Null texts have no words, items without words have no windows, items without an id are left out.  Rows without an id
    are not compared; different texts of an id are documents of their own.
    """
    docs = docs.select(id_column, text_column)
    placed = one_text_an_id(docs, id_column, text_column)
    if placed is not None:
        docs, place = placed
        names = docs.select(place, F.col(id_column).cast("long").alias("_of")).filter(F.col(place).isNotNull()).distinct()
        made = contamination(docs.drop(id_column), benchmark, place, text_column, item_column, item_text, window)
        made = made.join(names, place, "left")
        return made.select(F.col("_of").alias(id_column), *[c for c in made.columns if c not in (place, "_of")])
    docs, items = _plain(docs, benchmark, id_column, text_column, item_column, item_text)
    found = occurrences(docs.filter("id is not null"), items, window)
    per = found.groupBy("id").agg(F.collect_set(F.struct("start", "length")).alias("runs"), F.collect_set("item").alias("items"))
    whole = keep_ids(docs, staged(per, "hits-by-document"), "id", "left").select("id", "text", "runs", "items")
    out = by_batch(whole, _digest, "id long, n_words long, n_hit long, n_items long, items_sha256 string")
    return out.withColumn("contaminated", F.col("n_hit") > 0).withColumnRenamed("id", id_column)


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """``docs`` without documents that hold a window of an item; all columns as they are.  Rows without an id are kept;
    different texts of an id are documents of their own."""
    placed = one_text_an_id(docs, id_column, text_column)
    if placed is not None:
        kept = drop_contaminated(placed[0], benchmark, placed[1], text_column, item_column, item_text, window)
        return kept.select(*docs.columns)
    plain, items = _plain(docs, benchmark, id_column, text_column, item_column, item_text)
    found = occurrences(plain.filter("id is not null"), items, window)
    ids = staged(found.select(F.col("id").alias(id_column)).distinct(), "contaminated")
    return keep_ids(docs, ids, id_column, "left_anti")
