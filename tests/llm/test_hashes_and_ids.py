"""Texts that share weak hashes, and ids with several texts."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from ratebook.llm import pieces, queries, token_index
from ratebook.llm.decontaminate import contamination, drop_contaminated
from ratebook.llm.near_dedup import drop_near_duplicates, near_duplicates
from ratebook.llm.quality_rules import quality_rules
from ratebook.llm.substring_dedup import remove_substrings, substring_duplicates
from ratebook.llm.textops import PRIME, Sequences, Words, SPACE, span_hashes, times
from ratebook.llm.token_rollup import token_counts

SCHEMA = "doc_id long, text string, lang string, source string, id long, _place string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 7, "x") for i, t in texts], SCHEMA)


def opposite(n):
    """A word of ``n`` letters and its complement whose polynomials are equal modulo 2**64 for every base."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_products_modulo_the_prime():
    r = np.random.default_rng(3)
    a, b = (np.append(r.integers(0, PRIME, 500, dtype=np.uint64), [0, 1, PRIME - 1]).astype(np.uint64) for _ in range(2))
    assert [int(x) for x in times(a, b)] == [int(x) * int(y) % PRIME for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_opposite_words_have_different_hashes(n):
    a, b = opposite(n)
    data = np.frombuffer(f"{a} {b} {a}".encode(), np.uint8)
    words = Words(data, np.array([0, len(data)]), SPACE)
    h = span_hashes(data, words.start, words.end)
    assert h[0] == h[2] != h[1]
    x, y = (np.array([7 if c == "a" else 9 for c in w], np.uint64) for w in (a, b))  # sequences of two words
    runs = Sequences(np.concatenate([x, y, x]))
    one, two, three = runs.of(np.array([0, n, 2 * n]), n)
    assert one == three != two


@pytest.mark.parametrize("n", [1024, 4096])
def test_operators_part_opposite_words(spark, tmp_path, n):
    a, b = opposite(n)
    filler = " ".join(f"w{k}" for k in range(19))
    texts = [(1, a), (2, b), (3, f"{filler} {a}"), (4, f"{filler} {b}"), (5, f"{a}\n{b}\n{a}")]
    docs = table(spark, texts)
    near = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert near[1] == 1 and near[2] == 2
    gone = {r.doc_id: r.n_removed for r in substring_duplicates(docs).collect()}
    assert gone == dict.fromkeys(range(1, 6), 0)
    lines = {r.doc_id: r.n_dup_lines for r in quality_rules(docs).collect()}
    assert lines == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}
    library = token_index._tokenizer(queries.BYTE_BPE)
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts}
    folder = str(tmp_path / "ids")
    token_index.write_ids(docs, folder, queries.BYTE_BPE, 2)
    assert {r.doc_id: r.ids for r in token_index.read_ids(docs, folder).collect()} == {i: [*x, 2] for i, x in want.items()}
    counts = token_counts(docs, queries.BYTE_BPE, "v").select(F.sum("tokens")).first()[0]
    assert counts == sum(map(len, want.values()))
    assert all(r.round_trip for r in pieces.segment(docs, queries.PIECES).collect())


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    """With a hash that knows lengths only, results are those of the library all the same."""
    def weak(data, start, end):
        return (end - start).astype(np.uint64)

    text = "the cat sat on the mat, the dog ran far\nand the end came too\tsoon (so it was) ÄÖ ab ba"
    data = np.frombuffer(text.encode(), np.uint8)
    bounds = np.array([0, 20, len(data)])
    encoder = token_index.Encoder(queries.BYTE_BPE)
    want, first = encoder.encode(data, bounds)
    segmenter = pieces.Segmenter(queries.PIECES, 3)
    made = segmenter.block(data, bounds).to_pylist()
    monkeypatch.setattr(token_index, "span_hashes", weak)
    monkeypatch.setattr(pieces, "span_hashes", weak)
    for _ in range(2):  # the second time the words are remembered
        got, at = encoder.encode(data, bounds)
        assert got.tolist() == want.tolist() and at.tolist() == first.tolist()
    other = pieces.Segmenter(queries.PIECES, 3)
    for _ in range(2):
        assert other.block(data, bounds).to_pylist() == made
    assert all(x["round_trip"] for x in made)


WORDS = " ".join(f"v{k}" for k in range(60))


def clashing():
    """Two texts of id 2, one of them twice; rows without an id."""
    return [(1, WORDS), (2, WORDS + " tail"), (2, "other words here"), (2, "other words here"), (None, WORDS), (None, "y"), (3, None), (4, "short")]


def test_ids_with_several_texts(spark):
    docs = table(spark, clashing())
    near = sorted(map(tuple, near_duplicates(docs).collect()), key=repr)
    assert [x for x in near if x[0] == 2] == sorted([(2, 57, 1, False), (2, 1, 2, True), (2, 1, 2, True)], key=repr)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.filter("doc_id is not null").collect() if r.text is not None) == [
        (1, WORDS), (2, "other words here"), (4, "short"),
    ]
    assert sorted(r.text for r in kept.filter("doc_id is null").collect()) == [WORDS, "y"]
    cut = sorted(map(tuple, substring_duplicates(docs).collect()), key=repr)
    assert len(cut) == 8 and [x[:3] for x in cut if x[0] == 2] == sorted([(2, 61, 60), (2, 3, 0), (2, 3, 0)], key=repr)
    left = remove_substrings(docs)
    assert left.columns == docs.columns
    assert sorted(r.text for r in left.filter("doc_id = 2").collect()) == ["other words here", "other words here", "tail"]


def test_ids_with_several_texts_and_a_benchmark(spark):
    docs = table(spark, clashing())
    items = spark.createDataFrame([("b", " ".join(f"v{k}" for k in range(20, 35)))], "item_id string, text string")
    found = sorted(map(tuple, contamination(docs, items).collect()), key=repr)
    assert [x[:4] for x in found if x[0] == 2] == sorted([(2, 61, 15, 1), (2, 3, 0, 0), (2, 3, 0, 0)], key=repr)
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text) == sorted(
        [("2", "other words here"), ("2", "other words here"), ("None", WORDS), ("None", "y"), ("4", "short")]
    )


def test_the_stored_text_of_an_id_does_not_depend_on_the_order(spark, tmp_path):
    library = token_index._tokenizer(queries.BYTE_BPE)
    seen = set()
    for k, rows in enumerate([clashing(), clashing()[::-1]]):
        docs, folder = table(spark, rows).repartition(3), str(tmp_path / str(k))
        token_index.write_ids(docs, folder, queries.BYTE_BPE, 2)
        got = token_index.read_ids(docs, folder).filter("doc_id = 2").collect()
        assert len(got) == 3
        seen |= {tuple(r.ids) for r in got}
    assert len(seen) == 1
    assert seen <= {(*library.encode(t, add_special_tokens=False).ids, 2) for i, t in clashing() if i == 2}


def test_digest_of_kept_words(spark):
    r = substring_duplicates(table(spark, [(2, WORDS), (9, WORDS), (9, "x")])).filter("n_removed > 0").first()
    assert (r.doc_id, r.kept_sha256) == (9, hashlib.sha256(b"").hexdigest())
