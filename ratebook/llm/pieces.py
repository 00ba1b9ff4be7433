"""N-best segmentation of whole texts into the pieces of a sentencepiece vocabulary, and decoding.

The lattice of a text has an edge for each piece at each place; a segmentation scores the sum of its pieces.  A character
without a piece of its own is an edge of byte pieces, below all others.  Forward Viterbi scores give the best
segmentation; they are also the exact rest costs of a backward A* search, which yields further segmentations in order.

No piece has a space after a visible character, so every segmentation passes through the places where a word begins.
Texts are cut there.  Forward scores of all distinct words of a block are found together, with the best and the second
score of each; the best ``N`` segmentations of a text differ from the best one in the ``N - 1`` words with the smallest
distance between the two at most, and A* runs on these alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import U, blocks, bounded_batches, span_hashes
from .work import by_batch

N, LONGEST = 4, 16
SPACE_MARK, LITERAL_MARK = 0x2581, 0x110000
CACHED_WORDS = 300_000
#: Characters of a word whose segmentations are remembered; longer ones are found anew.
CACHED_LENGTH = 1000
CODE_BITS = 21
SCHEMA = (
    "id long, ids array<int>, n_pieces long, score double, round_trip boolean, "
    "others array<struct<score: double, edits: array<struct<at: int, n: int, ids: array<int>>>>>"
)


class Vocabulary:
    """Pieces with scores, as a trie of their code points: its edges are sorted numbers of (node, code point)."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes = np.full(256, -1, np.int32)
        raw: list[bytes] = []
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            raw.append(b"")
            if model.is_byte(k):
                self.bytes[int(piece[3:5], 16)] = k
                raw[k] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                if "▁" in piece.lstrip("▁"):
                    raise ValueError(f"piece {piece!r} goes over the beginning of a word")
                if len(piece) <= LONGEST:
                    self.pieces[piece] = k, model.get_score(k)
                raw[k] = piece.replace("▁", " ").encode()
        if (self.bytes < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        self.unknown = min(s for _, s in self.pieces.values() if s > -1e8) - 10
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, tuple[int, float]] = {}
        for name, found in self.pieces.items():
            node = 0
            for c in name:
                node = nodes.setdefault((node, ord(c)), len(nodes) + 1)
            ends[node] = found
        steps = sorted((node << CODE_BITS | c, to) for (node, c), to in nodes.items())
        self.step, self.to = (np.array(x, np.int64) for x in zip(*steps, strict=True))
        self.id, self.score = np.full(len(nodes) + 1, -1, np.int32), np.full(len(nodes) + 1, -np.inf)
        for node, (k, score) in ends.items():
            self.id[node], self.score[node] = k, score
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(x) for x in raw])
        self.raw_first = np.cumsum(self.raw_size) - self.raw_size
        self.text = raw

    def edges(self, code: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the piece of each length 1 .. LONGEST at each place; ``last`` is the end of the place's
        word.  Id -1 stands for bytes; a score of -inf for no edge."""
        n = len(code)
        ids, scores = np.full((LONGEST, n), -1, np.int32), np.full((LONGEST, n), -np.inf)
        # the first step by distinct characters, the others for the places that are still in the trie
        distinct, where = np.unique(code, return_inverse=True)
        at = np.arange(n)
        node = self._next(np.zeros(len(distinct), np.int64), distinct)[where]
        for length in range(1, min(LONGEST, n) + 1):
            if length > 1:
                inside = at + length <= last[at]
                at, node = at[inside], node[inside]
                node = self._next(node, code[at + length - 1])
            alive = node > 0
            at, node = at[alive], node[alive]
            if not len(at):
                break
            ids[length - 1, at], scores[length - 1, at] = self.id[node], self.score[node]
        scores[0, ids[0] < 0] = self.unknown
        return ids, scores

    def _next(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The node behind each, 0 where there is none."""
        key = node << CODE_BITS | code
        place = np.searchsorted(self.step, key)
        place[place == len(self.step)] = 0
        return np.where(self.step[place] == key, self.to[place], 0)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, bounds) of the texts whose ids are ids[first[i]:first[i + 1]], with the space before the first word."""
        size = self.raw_size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = np.arange(ends[-1]) + np.repeat(self.raw_first[ids] - ends[:-1], size)
        return self.raw[flat], ends[first]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _code(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    code[code == SPACE_MARK] = LITERAL_MARK  # what stands for a space is never a character of the text
    code[code == 32] = SPACE_MARK
    return code


def best(words: list[str], pieces: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all words, their numbers, score, score of the second-best segmentation or -inf) of each word; of equal
    scores the longer last piece."""
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (word, id, character), the last piece of a word first
    score, second = np.zeros(len(words)), np.full(len(words), -np.inf)
    sizes = np.array([len(w) for w in words])
    order = np.argsort(sizes, kind="stable")
    low = 0
    while low < len(order):
        # words of similar length at a time: a rectangle of at most a million places
        longest = max(int(sizes[order[low]] * 1.5), 8)
        high = min(int(np.searchsorted(sizes[order], longest, "right")), low + max(1, (1 << 20) // longest // LONGEST))
        own = order[low:high]
        low = high
        size = sizes[own]
        ends = np.cumsum(size)
        first = ends - size
        code = _code("".join(words[k] for k in own))
        ids, scores = pieces.edges(code, np.repeat(ends, size))
        width = int(size.max())
        longest_piece = 1 + int(np.flatnonzero((scores > -np.inf).any(1)).max(initial=0))
        one, two = np.full((width + 1, len(own)), -np.inf), np.full((width + 1, len(own)), -np.inf)
        chosen = np.zeros((width + 1, len(own)), np.int8)
        one[0] = 0
        for j in range(1, width + 1):
            live = np.flatnonzero(size >= j)
            a, b, c = np.full(len(live), -np.inf), np.full(len(live), -np.inf), np.zeros(len(live), np.int8)
            for length in range(min(longest_piece, j), 0, -1):
                step = scores[length - 1, first[live] + j - length]
                x = one[j - length, live] + step
                b = np.maximum(np.maximum(b, np.minimum(a, x)), two[j - length, live] + step)
                better = x > a
                a[better], c[better] = x[better], length
            one[j, live], two[j, live], chosen[j, live] = a, b, c
        line = np.arange(len(own))
        score[own], second[own] = one[size, line], two[size, line]
        at = size.copy()
        while (left := np.flatnonzero(at > 0)).size:
            length = chosen[at[left], left].astype(int)
            at[left] -= length
            place = first[left] + at[left]
            steps.append((own[left], ids[length - 1, place], code[place]))
    if not steps:
        return np.empty(0, np.int32), np.zeros(len(words), np.int64), score, second
    word, ids, code = (np.concatenate(x)[::-1] for x in zip(*steps, strict=True))
    order = np.argsort(word, kind="stable")
    word, ids, code = word[order], ids[order], code[order]
    # a character without a piece is as many byte pieces as it has bytes
    many = np.ones(len(ids), np.int64)
    raw = np.flatnonzero(ids < 0)
    spelt = [pieces.bytes[list(_char(c).encode("utf-8", "surrogatepass"))] for c in code[raw].tolist()]
    many[raw] = [len(x) for x in spelt]
    flat = np.repeat(ids, many)
    if spelt:
        flat[flat < 0] = np.concatenate(spelt)
    return flat, np.bincount(word, many, len(words)).astype(np.int64), score, second


def _char(code: int) -> str:
    return chr(SPACE_MARK) if code == LITERAL_MARK else " " if code == SPACE_MARK else chr(code)


def n_best(word: str, n: int, pieces: Vocabulary) -> list[tuple[float, list[int]]]:
    """The ``n`` best segmentations of a word, best first: backward A* whose rest costs are the forward scores.  Of equal
    scores the one whose last pieces are longer comes first.

    An entry stands for the segmentations that share its last pieces, and costs what the best of them is short of the best
    of all.  No two entries share a segmentation, so only as many as are still wanted are kept.  They are listed with the
    longer last pieces first; an entry's place in the list is taken by those that follow from it, which keeps that order.
    Each knows the one before it, and its pieces are put together when it arrives at the start.
    """
    size = len(word)
    code = _code(word)
    ids, scores = pieces.edges(code, np.full(size, size))
    # the edges by the place where they end, of each place the longer first
    row, begin = np.nonzero(scores > -np.inf)
    order = np.lexsort((-row, begin + row))
    row, begin = row[order], begin[order]
    step, piece, start = scores[row, begin].tolist(), ids[row, begin].tolist(), begin.tolist()
    first = np.searchsorted(begin + row + 1, np.arange(size + 2)).tolist()
    forward = [0.0]
    for j in range(1, size + 1):
        forward.append(max([forward[start[e]] + step[e] for e in range(first[j], first[j + 1])]))
    found: list[tuple[float, list[int]]] = []
    # (cost, place, score of the tail, (edge, the same of the entry before))
    entries: list[tuple] = [(0.0, size, 0.0, None)]
    while entries and len(found) < n:
        costs = [x[0] for x in entries]
        k = costs.index(min(costs))  # of equal costs the first
        cost, at, tail, path = entries[k]
        if not at:
            del entries[k]
            done: list[int] = []
            while path:
                edge, path = path
                if piece[edge] >= 0:
                    done.append(piece[edge])
                else:
                    done.extend(pieces.bytes[list(word[start[edge]].encode("utf-8", "surrogatepass"))].tolist())
            found.append((tail, done))
            continue
        here = forward[at]
        entries[k : k + 1] = [
            (cost + (here - (forward[start[e]] + step[e])), start[e], step[e] + tail, (e, path)) for e in range(first[at], first[at + 1])
        ]
        wanted = n - len(found)
        if len(entries) > wanted:
            costs = [x[0] for x in entries]
            entries = [entries[x] for x in sorted(sorted(range(len(costs)), key=costs.__getitem__)[:wanted])]
    return found


class Segmenter:
    """Best segmentations of blocks of texts; frequent words are remembered."""

    def __init__(self, path: str, n: int):
        self.pieces, self.n = vocabulary(path), n
        self._forget()
        self.again = lru_cache(50_000)(lambda word: n_best(word, self.n, self.pieces))

    def _forget(self) -> None:
        self.hash, self.at = np.empty(0, U), np.empty(0, np.int64)
        self.first, self.ids = np.zeros(1, np.int64), np.empty(0, np.int32)
        self.score, self.second = np.empty(0), np.empty(0)
        self.met = np.empty(0, bool)

    def _trim(self) -> None:
        """Keep the words that were met again since the last time, if that leaves room for others."""
        keep = self.met[self.at]
        if 2 * int(keep.sum()) > CACHED_WORDS:
            self._forget()
            return
        self.hash, old = self.hash[keep], self.at[keep]
        self.ids, size = self._ids(old)
        self.first, self.at = np.concatenate([[0], np.cumsum(size)]), np.arange(len(old))
        self.score, self.second, self.met = self.score[old], self.second[old], np.zeros(len(old), bool)

    def _ids(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, numbers of them) of the words at these places."""
        size = (self.first[1:] - self.first[:-1])[place]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(self.first[place] - (ends - size), size)], size

    def _learn(self, part: np.ndarray, words: list[str]) -> None:
        ids, size, score, second = best(words, self.pieces)
        at = np.arange(len(size)) + len(self.first) - 1
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(size)])
        self.ids = np.concatenate([self.ids, ids])
        self.score, self.second = np.concatenate([self.score, score]), np.concatenate([self.second, second])
        self.met = np.concatenate([self.met, np.zeros(len(size), bool)])
        place = np.searchsorted(self.hash, part)  # both are in order
        self.hash, self.at = np.insert(self.hash, place, part), np.insert(self.at, place, at)

    def _known(self, part: np.ndarray) -> np.ndarray:
        """The place of each word, -1 for one that is not remembered."""
        place = np.full(len(part), -1, np.int64)
        if len(self.hash):
            at = np.searchsorted(self.hash, part)
            at[at == len(self.hash)] = 0
            hit = self.hash[at] == part
            place[hit] = self.at[at[hit]]
            self.met[place[hit]] = True
        return place

    def block(self, data: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        """Columns of SCHEMA but the id.  Words are told apart by their hashes; where the ids do not give a text back, two
        of them had the same one, and the block is done again by the words themselves."""
        made = self._block(data, bounds, False)
        return made if pc.all(made.column(3)).as_py() is not False else self._block(data, bounds, True)

    def _block(self, data: np.ndarray, bounds: np.ndarray, exact: bool) -> pa.RecordBatch:
        full = np.flatnonzero(np.diff(bounds) > 0)
        spaced = np.insert(data, bounds[full], 32)  # each text gets the space that its first word begins with
        limits = bounds + np.searchsorted(full, np.arange(len(bounds)))
        cut = spaced == 32
        cut[1:] &= spaced[:-1] != 32
        cut[limits[full]] = True
        start = np.flatnonzero(cut)
        first = np.searchsorted(start, limits)
        if not len(start):
            return self._columns(np.empty(0, np.int32), np.zeros(len(bounds), int), np.zeros(len(full)), data, bounds, [], full)
        end = np.append(start[1:], len(spaced))
        raw = spaced.tobytes()
        if exact:
            known: dict[bytes, int] = {}
            where = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(start.tolist(), end.tolist(), strict=True)])
            self._forget()
            self._learn(np.arange(len(known), dtype=U), [x.decode("utf-8", "surrogatepass") for x in known])
            place = where
        else:
            part, sample, where = np.unique(span_hashes(spaced, start, end), return_index=True, return_inverse=True)
            if len(self.hash) > CACHED_WORDS:
                self._trim()
            place = self._known(part)
            missing = np.flatnonzero(place < 0)
            if len(missing):
                place[missing] = len(self.first) - 1 + np.arange(len(missing))
                self._learn(part[missing], [raw[start[k] : end[k]].decode("utf-8", "surrogatepass") for k in sample[missing].tolist()])
            place = place[where]
        ids, size = self._ids(place)
        ends = np.cumsum(size)
        score, gap = self.score[place], (self.score - self.second)[place]
        if exact:
            self._forget()  # what was learnt here stands for no hash
        begin = np.concatenate([[0], ends])
        others = []
        for d in full.tolist():
            a, b = int(first[d]), int(first[d + 1])
            close = np.argsort(gap[a:b], kind="stable")[: self.n - 1] + a if b - a < 64 else _smallest(gap[a:b], self.n - 1) + a
            others.append(self._others(score[a:b].sum(), np.sort(close), raw, start, end, begin, a))
        total = np.add.reduceat(score, first[full]) if len(full) else np.empty(0)
        return self._columns(ids, begin[first], total, data, bounds, others, full)

    def _others(self, total: float, close: np.ndarray, raw: bytes, start, end, begin, first: int) -> list[dict]:
        """The second to n-th best segmentation of a text, as changes to the best one."""
        combined: list[tuple[float, list[tuple[int, int]]]] = [(0.0, [])]
        choices = {}
        for k in close.tolist():
            word = raw[start[k] : end[k]].decode("utf-8", "surrogatepass")
            choices[k] = found = self.again(word) if len(word) <= CACHED_LENGTH else n_best(word, self.n, self.pieces)
            more = [(c + x[0] - found[0][0], [*e, (k, r)] if r else e) for c, e in combined for r, x in enumerate(found)]
            combined = sorted(more, key=lambda x: (-x[0], x[1]))[: self.n]
        return [
            {
                "score": total + c,
                "edits": [
                    {"at": int(begin[k] - begin[first]), "n": int(begin[k + 1] - begin[k]), "ids": choices[k][r][1]} for k, r in e
                ],
            }
            for c, e in combined[1:]
        ]

    def _columns(self, ids, begin, total, data, bounds, others, full) -> pa.RecordBatch:
        rows = len(bounds) - 1
        score, rest = np.zeros(rows), [[] for _ in range(rows)]
        score[full] = total
        for d, x in zip(full.tolist(), others, strict=False):
            rest[d] = x
        text, ends = self.pieces.decode(ids, begin)
        # the decoded texts begin with a space; without it they are the texts again
        same = np.diff(ends) == np.diff(bounds) + (np.diff(bounds) > 0)
        if same.all():
            wrong = np.flatnonzero(np.delete(text, ends[full]) != data)
            same[np.searchsorted(bounds, wrong, "right") - 1] = False
        else:
            for d in np.flatnonzero(same):
                same[d] = bool((text[ends[d] + 1 : ends[d + 1]] == data[bounds[d] : bounds[d + 1]]).all())
        edit = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])
        kind = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(edit))]))
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32())),
                pa.array(np.diff(begin).astype(np.int64)),
                pa.array(score),
                pa.array(same),
                pa.array(rest, kind),
            ],
            names=["ids", "n_pieces", "score", "round_trip", "others"],
        )


def _smallest(values: np.ndarray, n: int) -> np.ndarray:
    """Places of the n smallest values, of equal ones the first."""
    limit = np.partition(values, n - 1)[n - 1]
    place = np.flatnonzero(values <= limit)
    return place[np.argsort(values[place], kind="stable")[:n]]


def segment(docs: DataFrame, path: str, n: int = N, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids, n_pieces, score, round_trip, others) for each row of ``docs``.

    ``others`` are the second to n-th best segmentations, each as its score and the changes that turn ``ids`` into it
    (from piece ``at``, ``n`` pieces become ``ids``); a text with fewer segmentations has fewer.  ``round_trip`` says
    that decoding gives the text back, byte by byte.  Null and empty texts have no pieces, score 0 and no others; null
    and repeated ids make no difference.
    """
    bounded_batches(docs.sparkSession)
    segmenters: dict[str, Segmenter] = {}

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if path not in segmenters:
            segmenters[path] = Segmenter(path, n)
        for i, j, data, bounds in blocks(batch.column(1)):
            made = segmenters[path].block(data, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *made.columns], names=["id", *made.schema.names])

    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return by_batch(plain, run, SCHEMA).withColumnRenamed("id", id_column)


def decode(ids: list[int], path: str) -> str:
    """The text of a list of ids."""
    pieces = vocabulary(path)
    return b"".join(pieces.text[k] for k in ids).decode("utf-8", "replace")[1:]


def decoded(encoded: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """(id, text) of a table with ids."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [decode(x.as_py() or [], path) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    bounded_batches(encoded.sparkSession)
    return by_batch(encoded.select(F.col(id_column).cast("long").alias("id"), "ids"), run, "id long, text string").withColumnRenamed("id", id_column)
