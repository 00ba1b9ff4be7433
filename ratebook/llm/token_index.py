"""Token ids of documents in binary shards with a minimal perfect hash index.

A shard is a pair of files in a shared folder:

* ``shard-<n>.ids``: the ids of its documents, one after the other in ascending order of document id, as little-endian
  unsigned integers of ``width`` bytes (2 where the vocabulary and the end id fit, else 4);
* ``shard-<n>.mph``: the index.  Keys are split over levels of bit arrays: a key whose hash of a level meets no other
  key's there owns a bit, others go on to the next level.  The number of set bits before its own is a key's slot, a
  number below the number of keys without gaps (a minimal perfect hash).  Slots hold a fingerprint of the key, which
  tells keys that were never stored, and the place of the document: first id in the shard and number of ids.

A lookup hashes the key on one level after another, about 1.6 on average, and reads the ids at the place that it finds.
"""

from __future__ import annotations

import io
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import U, blocks, bounded_batches, mix, same_bytes, span_hashes
from .work import work_dir

GAMMA, LEVELS = 2.0, 64
#: Documents of a shard: its index is built in memory and loaded as a whole.
SHARD_DOCS = 20_000
#: Parts of texts that a worker remembers, about 50 bytes each.
CACHED_WORDS = 2_000_000
#: Bytes of text whose distinct parts are found together.
ENCODED = 2 << 20


# --- minimal perfect hash


def _slot_hash(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys.view(U) ^ mix(np.array([level + 1], U))[0])


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(U) ^ U(0x94D049BB133111EB)) >> U(32)).astype(np.uint32)


class PerfectHash:
    """Distinct 64-bit keys to 0 .. len(keys) - 1."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts, left = [], [], keys
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(8, int(GAMMA * len(left)))
            at = (_slot_hash(left, level) % U(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(alone)
            left = left[~alone[at]]
        if len(left):
            raise ValueError("keys of a perfect hash must be distinct")
        return cls(sizes, np.concatenate(parts) if parts else np.empty(0, bool))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; a key that was not stored gets any slot, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = (_slot_hash(keys[left], level) % U(size)).astype(np.int64) + self.base[level]
            own = self.bits[at]
            out[left[own]] = self.rank[at[own]]
            left = left[~own]
            if not len(left):
                break
        return out


# --- ids of whole texts


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The encoder of a Python worker: what it remembers serves all tasks that run there."""
    return Encoder(path)


class Encoder:
    """Ids of texts by the tokenizers library.

    The library's byte-level tokenizers never join what stands before a space with what follows it, where the space comes
    after a visible character.  Texts are cut there, each distinct part of a block is encoded by the library once, and
    the ids of parts are kept for later blocks; when there are too many, those that no later block had are forgotten.
    Parts are found by their hashes and compared byte by byte; a block in which two parts share a hash is encoded part
    by part.
    """

    def __init__(self, path: str):
        self.library = _tokenizer(path)
        self._forget()

    def _cuts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where parts begin: at documents, and at spaces after an ASCII character or a two-byte letter."""
        space = np.flatnonzero(data == 32)
        space = space[space >= 2]
        before, earlier = data[space - 1], data[space - 2]
        plain = (before > 32) & (before < 127)
        letter = (before >= 0x80) & (earlier >= 0xC3) & (earlier <= 0xDF)
        cut = np.zeros(len(data), bool)
        cut[space[plain | letter]] = True
        cut[bounds[:-1][np.diff(bounds) > 0]] = True
        return np.flatnonzero(cut)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of the block, first id of each)."""
        start = self._cuts(data, bounds)
        end = np.append(start[1:], len(data))
        if not len(start):
            return np.empty(0, np.uint32), np.zeros(len(bounds), np.int64)
        part, sample, where = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        place = self._known(part)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            raw = data.tobytes()
            texts = [raw[start[k] : end[k]] for k in sample[missing].tolist()]
            place[missing] = len(self.first) - 1 + np.arange(len(missing))
            self._learn(part[missing], texts, self._library(texts))
        place = place[where]
        text_size = (self.text_first[1:] - self.text_first[:-1])[place]
        if same_bytes(data, start, end, self.text, self.text_first[place], text_size):
            ids, size = _runs(self.ids, self.first, place)
        else:
            ids, size = self._by_part(data, start, end)
        ends = np.cumsum(size)
        first = np.concatenate([[0], ends])[np.searchsorted(start, bounds)]
        if len(self.first) > CACHED_WORDS:
            self._trim()
        return ids, first

    def _library(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)]

    def _by_part(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, numbers of them) of parts that are told apart by their bytes."""
        raw, known = data.tobytes(), {}
        where = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        found = self._library(list(known))
        first = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        return _runs(np.fromiter(chain.from_iterable(found), np.uint32, int(first[-1])), first, where)

    def _forget(self) -> None:
        self.hash, self.at = np.empty(0, U), np.empty(0, np.int64)
        self.first, self.ids = np.zeros(1, np.int64), np.empty(0, np.uint32)
        self.text_first, self.text = np.zeros(1, np.int64), np.empty(0, np.uint8)
        self.again = np.empty(0, bool)

    def _trim(self) -> None:
        """Keep what was met again since the last time, if that leaves room for others."""
        keep = self.again[self.at]
        if 2 * int(keep.sum()) > CACHED_WORDS:
            self._forget()
            return
        self.hash, old = self.hash[keep], self.at[keep]
        self.ids, size = _runs(self.ids, self.first, old)
        self.text, text_size = _runs(self.text, self.text_first, old)
        self.first, self.text_first = (np.concatenate([[0], np.cumsum(x)]) for x in (size, text_size))
        self.at, self.again = np.arange(len(old)), np.zeros(len(old), bool)

    def _known(self, part: np.ndarray) -> np.ndarray:
        place = np.full(len(part), -1, np.int64)
        if len(self.hash):
            at = np.searchsorted(self.hash, part)
            at[at == len(self.hash)] = 0
            hit = self.hash[at] == part
            place[hit] = self.at[at[hit]]
            self.again[place[hit]] = True
        return place

    def _learn(self, part: np.ndarray, texts: list[bytes], found: list[list[int]]) -> None:
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
        at = np.arange(len(found)) + len(self.first) - 1
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(size)])
        self.ids = np.concatenate([self.ids, flat])
        text_size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_first = np.concatenate([self.text_first, self.text_first[-1] + np.cumsum(text_size)])
        self.text = np.concatenate([self.text, np.frombuffer(b"".join(texts), np.uint8)])
        self.again = np.concatenate([self.again, np.zeros(len(found), bool)])
        place = np.searchsorted(self.hash, part)  # both are in order
        self.hash, self.at = np.insert(self.hash, place, part), np.insert(self.at, place, at)


def _runs(values: np.ndarray, first: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of the runs at these places, their sizes); run i is values[first[i]:first[i + 1]]."""
    size = (first[1:] - first[:-1])[place]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(first[place] - (ends - size), size)], size


# --- shards


def _files(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def _index_bytes(keys: np.ndarray, first: np.ndarray, size: np.ndarray) -> bytes:
    table = PerfectHash.build(keys)
    slot = table.slots(keys)
    mark, place, length = np.empty(len(keys), np.uint32), np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    mark[slot], place[slot], length[slot] = fingerprints(keys), first, size
    head = json.dumps({"keys": len(keys), "levels": table.sizes}).encode()
    out = io.BytesIO()
    out.write(len(head).to_bytes(4, "little") + head + np.packbits(table.bits).tobytes())
    for x in (mark.astype("<u4"), place.astype("<i8"), length.astype("<i8")):
        out.write(x.tobytes())
    return out.getvalue()


class ShardIndex:
    def __init__(self, data: bytes):
        n = int.from_bytes(data[:4], "little")
        head, at = json.loads(data[4 : 4 + n]), 4 + n
        bits, keys = sum(head["levels"]), head["keys"]
        size = -(-bits // 8)
        self.table = PerfectHash(head["levels"], np.unpackbits(np.frombuffer(data, np.uint8, size, at))[:bits].astype(bool))
        at += size
        self.mark = np.frombuffer(data, "<u4", keys, at)
        self.first = np.frombuffer(data, "<i8", keys, at + 4 * keys)
        self.size = np.frombuffer(data, "<i8", keys, at + 12 * keys)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(is stored, first id in the shard, number of ids) of each key."""
        slot = self.table.slots(keys)
        some = np.maximum(slot, 0)
        if not len(self.mark):
            return np.zeros(len(keys), bool), some, some
        return (slot >= 0) & (self.mark[some] == fingerprints(keys)), self.first[some], self.size[some]


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    """One partition, in order of ids, to shards; yields a row of the manifest for each."""
    files, root = _files(folder)
    encode = encoder(path).encode
    kind = np.dtype(f"<u{width}")
    keys: list[int] = []
    sizes: list[int] = []
    out = name = None

    def close() -> pa.RecordBatch:
        nonlocal out
        out.close()
        size = np.array(sizes, np.int64)
        with files.open_output_stream(posixpath.join(root, f"{name}.mph")) as index:
            index.write(_index_bytes(np.array(keys, np.int64), np.cumsum(size) - size, size))
        row = [[name], [keys[0]], [keys[-1]], [len(keys)], [int(size.sum())]]
        out = None
        kinds = [pa.string(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=MANIFEST)

    for batch in batches:
        ids = batch.column(0).to_numpy()
        for i, j, data, bounds in blocks(batch.column(1), ENCODED):
            tokens, first = encode(data, bounds)
            for k in range(i, j):
                if keys and ids[k] == keys[-1]:  # a repeated row of an id
                    continue
                if out is not None and len(keys) >= SHARD_DOCS:
                    yield close()
                if out is None:
                    # a name of its own for each attempt: a lost task's files are in no manifest
                    name, keys, sizes = f"shard-{uuid.uuid4().hex}", [], []
                    out = files.open_output_stream(posixpath.join(root, f"{name}.ids"))
                own = tokens[first[k - i] : first[k - i + 1]]
                out.write(own.astype(kind).tobytes() + int(end_id).to_bytes(width, "little"))
                keys.append(int(ids[k]))
                sizes.append(len(own) + 1)
    if out is not None:
        yield close()


MANIFEST = ["name", "low", "high", "docs", "ids"]
MANIFEST_SCHEMA = "name string, low long, high long, docs long, ids long"


def write_ids(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int | None = None,
) -> DataFrame:
    """Encode ``docs`` into shards below ``folder``; returns the manifest (name, low, high, docs, ids, start), ordered.

    Null texts are empty and have the end id alone.  Rows without an id are left out; of the texts of an id the one with
    the smallest hash (of equal hashes the smallest text) is stored.  ``folder`` is shared by all executors and has a scheme that Arrow's file systems know.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    if width is None:
        width = 2 if max(_tokenizer(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    files, root = _files(folder)
    files.create_dir(root, recursive=True)
    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).filter("id is not null")
    placed = plain.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"), "text")
    rows = placed.mapInArrow(lambda b: _write(b, folder, tokenizer, end_id, width), MANIFEST_SCHEMA).collect()  # a row per shard
    start, table = 0, []
    for r in sorted(rows, key=lambda r: r["low"]):
        table.append((*r, start))
        start += r["ids"]
    # the manifest and the width are what a reader needs
    with files.open_output_stream(posixpath.join(root, "manifest.json")) as out:
        out.write(json.dumps({"width": width, "shards": [dict(zip([*MANIFEST, "start"], r, strict=True)) for r in table]}).encode())
    return spark.createDataFrame(table, f"{MANIFEST_SCHEMA}, start long")


def _manifest(folder: str) -> tuple[int, list[dict]]:
    files, root = _files(folder)
    with files.open_input_stream(posixpath.join(root, "manifest.json")) as f:
        found = json.loads(f.read())
    return found["width"], found["shards"]


def _read(batches: Iterator[pa.RecordBatch], folder: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    width, shards = _manifest(folder)
    if not shards:
        return
    files, root = _files(folder)
    low, high = (np.array([s[k] for s in shards], np.int64) for k in ("low", "high"))

    @lru_cache(4)
    def index(name: str) -> ShardIndex:
        with files.open_input_stream(posixpath.join(root, f"{name}.mph")) as f:
            return ShardIndex(f.read())

    for batch in batches:
        keys = batch.column(0).to_numpy()
        shard = np.searchsorted(low, keys, "right") - 1
        shard[(shard >= 0) & (keys > high[np.maximum(shard, 0)])] = -1
        order = np.argsort(shard, kind="stable")
        columns: list[list] = [[], [], [], [], []]
        for s in np.unique(shard[shard >= 0]):
            own = order[shard[order] == s]
            stored, first, size = index(shards[s]["name"]).find(keys[own])
            with files.open_input_file(posixpath.join(root, f"{shards[s]['name']}.ids")) as f:
                for k in np.flatnonzero(stored):
                    raw = f.read_at(int(size[k]) * width, int(first[k]) * width)
                    ids = np.frombuffer(raw, f"<u{width}")
                    for column, x in zip(
                        columns,
                        (int(keys[own[k]]), shards[s]["start"] + int(first[k]), len(ids), zlib.crc32(ids.astype("<u4").tobytes())),
                        strict=False,
                    ):
                        column.append(x)
                    if with_ids:
                        columns[4].append(ids.astype(np.int32))
        arrays = [pa.array(x, pa.int64()) for x in columns[:4]]
        names = ["id", "start", "n_tokens", "ids_crc32"]
        if with_ids:
            arrays, names = [*arrays, pa.array(columns[4], pa.list_(pa.int32()))], [*names, "ids"]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def read_ids(keys: DataFrame, folder: str, id_column: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of each of ``keys`` that is stored, by the index; other keys have no row.

    Keys are sorted first, so that a task opens few shards."""
    bounded_batches(keys.sparkSession)
    plain = keys.select(F.col(id_column).cast("long").alias("id")).filter("id is not null")
    schema = "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    placed = plain.repartitionByRange("id").sortWithinPartitions("id")
    return placed.mapInArrow(lambda b: _read(b, folder, with_ids), schema).withColumnRenamed("id", id_column)


def ids_folder(spark: SparkSession) -> str:
    return work_dir(spark, "token-ids")
