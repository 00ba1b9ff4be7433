"""Language, quality, token files, archives, rollups, pieces and the pipeline."""

import base64
import collections
import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from ratebook.llm import pieces, queries, token_index
from ratebook.llm.language_id import language_id, softmax, temperature
from ratebook.llm.quality_model import FEATURES, SELECT, _sigmoid, fit, keep_quality, predict, quality, score_tests, train
from ratebook.llm.textops import blocks
from ratebook.llm.token_rollup import Rollup, deltas
from ratebook.llm.warc import page_chunks, pages_from, read_archives, write_archives

SMALL = "/root/testdata/sf0.001"
AWKWARD = [
    "  lead  two\n\nx  y  z 　 q",
    "a  b",
    "",
    "it's we'll <|endoftext|> x",
    " é Â  x  y",
    "tab\t x  \n y ",
    "日本 語 x",
    "é x \U0001f600 y",
    "a\x85 b c",
    "▁ mark ▁x",
    "long" * 3000,
]


def test_language_is_told_from_text(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "123 !?", "de"), (None, "x y", None)], "doc_id long, text string, lang string")
    every = docs.select("doc_id", "text", "lang").unionByName(odd)
    found = {r.doc_id: r for r in language_id(every).collect()}
    assert found[10**6].lang_pred == found[10**6 + 1].lang_pred == "und" and found[10**6].score == 0
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for i, r in found.items() if r.held_out and i in truth]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in found.items() if i is not None)
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_language_without_learning_rows(spark):
    rows = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_id(rows).collect()] == ["und"]
    assert language_id(rows.limit(0)).collect() == []


def test_temperature_recovers_a_scale():
    random_ = np.random.default_rng(0)
    scores = random_.normal(size=(4000, 3)) * 2
    targets = np.array([random_.choice(3, p=p) for p in softmax(scores)])
    assert temperature(scores * 5, targets) == pytest.approx(5, rel=0.1)


def test_ordinal_fit_orders_grades():
    random_ = np.random.default_rng(1)
    grades = random_.integers(0, 3, 900)
    found = [np.unique(np.concatenate([[int(g)], random_.integers(100, 2000, 20)])) for g in grades]
    model = fit(found, np.zeros((900, 8)), grades)
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails(found, np.zeros((900, 8)))
    assert (tails[:, 0] >= tails[:, 1]).all()
    expected = [tails[grades == g].sum(1).mean() for g in range(3)]
    assert expected[0] + 0.5 < expected[1] < expected[2] - 0.5


def _likelihood(score, thresholds, grades):
    tails = np.concatenate([np.ones((len(score), 1)), _sigmoid(score[:, None] - thresholds[None, :]), np.zeros((len(score), 1))], 1)
    line = np.arange(len(score))
    return np.log(tails[line, grades] - tails[line, grades + 1]).sum()


def test_score_tests_are_slopes_of_the_likelihood():
    random_ = np.random.default_rng(3)
    grades = random_.choice(3, 400, p=[0.2, 0.3, 0.5])
    found = [np.unique(np.concatenate([[int(g == 0)], random_.integers(2, 30, 5)])) for g in grades]
    tests, limit = score_tests(found, grades)
    share = np.array([(grades > k).mean() for k in range(2)])
    thresholds = np.log((1 - share) / share)
    for feature in (0, 1, 7, 20):
        has = np.array([feature in f for f in found], float)
        slope = (_likelihood(1e-4 * has, thresholds, grades) - _likelihood(-1e-4 * has, thresholds, grades)) / 2e-4
        each = np.array([(_likelihood(np.array([1e-4]), thresholds, grades[i : i + 1]) - _likelihood(np.array([-1e-4]), thresholds, grades[i : i + 1])) / 2e-4 for i in range(400)])
        assert tests[feature] == pytest.approx(abs(slope) / np.sqrt(has.sum() * (1 - has.mean()) * each.var()), rel=1e-4)
    assert limit == pytest.approx(np.sqrt(2 * np.log(30))) and tests[1] > limit and tests[FEATURES - 1] == 0


def test_wrong_ratings_are_not_learnt_by_heart():
    """One rating in ten is wrong, texts have many words: documents that were not learnt from are told all the same."""
    random_ = np.random.default_rng(4)
    truth = random_.choice([0, 2], 1200, p=[0.15, 0.85])
    rated = np.where(random_.random(1200) < 0.1, 0, truth)
    found = [np.unique(np.concatenate([random_.integers(5 * (g == 2), 5 * (g == 2) + 5, 2), random_.integers(100, 9000, 150)])) for g in truth]
    shares = np.zeros((1200, 8))
    model = fit(found[:900], shares[:900], rated[:900])
    keep = model.tails(found[900:], shares[900:])[:, -1] >= SELECT
    assert keep[truth[900:] == 2].mean() >= 0.98 and keep[truth[900:] == 0].mean() <= 0.05


def test_quality_of_documents_that_were_not_learnt_from(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = train(docs, labels.filter(~out))
    judged = predict(docs.join(labels.filter(out), "doc_id"), model).join(labels, "doc_id")
    kept = {(r.quality, r.toxic): r.kept for r in judged.groupBy("quality", "toxic").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()}
    assert kept[1, 0] >= 0.97 and kept[1, 1] <= 0.1 and kept[0, 0] <= 0.15 and kept[0, 1] <= 0.1


def test_quality_of_odd_tables(spark):
    rows = [(k, "good words here" if k % 2 else "bad words here", k % 2) for k in range(80)]
    rows += [(80, None, 1), (81, "", 0), (None, "good words here", 1), (82, "good " * 100000, 1), (1, "good words here", 1)]
    docs = spark.createDataFrame([(k, text, 7.0, "x") for k, text, _ in rows], "doc_id long, text string, grade double, p_top string")
    labels = spark.createDataFrame([(k, q, 0, "y") for k, _, q in rows], "doc_id long, quality int, toxic int, text string")
    left = keep_quality(docs, labels)
    assert left.columns == docs.columns
    kept = collections.Counter(r.doc_id for r in left.collect())
    assert kept[1] == 2 and kept[None] == 1 and kept[82] == 1 and all(kept[k] == k % 2 for k in range(2, 80))
    assert quality(docs, labels).count() == len(rows)
    same = quality(docs, labels.withColumn("quality", F.lit(1))).collect()
    assert len(same) == len(rows) and all(r.keep for r in same)
    assert not any(r.keep for r in quality(docs, labels.withColumn("toxic", F.lit(1))).collect())
    nothing = quality(docs, labels.withColumn("quality", F.lit(None).cast("int")).withColumn("toxic", F.lit(None).cast("int"))).collect()
    assert all(r.keep and r.p_top is None for r in nothing)


def test_quality_keeps_good_and_drops_rejected(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rated = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    found = {r.doc_id: r for r in quality(docs, labels).collect()}
    good = [found[i].keep for i, x in rated.items() if x == (1, 0)]
    bad = [found[i].keep for i, x in rated.items() if x != (1, 0)]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)
    left = keep_quality(docs, labels)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.select("doc_id").collect()) == sorted(i for i, r in found.items() if r.keep)
    assert keep_quality(docs.limit(3), labels.limit(0)).count() == 3
    assert quality(docs.limit(0), labels).collect() == []


@pytest.mark.parametrize("remembered", [token_index.CACHED_WORDS, 8])
def test_encoder_equals_the_library_on_whole_texts(monkeypatch, remembered):
    monkeypatch.setattr(token_index, "CACHED_WORDS", remembered)
    encoder, library = token_index.Encoder(queries.BYTE_BPE), token_index._tokenizer(queries.BYTE_BPE)
    for _ in range(2):  # the second time from memory
        for i, j, data, bounds in blocks(pa.array(AWKWARD)):
            ids, first = encoder.encode(data, bounds)
            for k in range(i, j):
                expected = library.encode(AWKWARD[k], add_special_tokens=False).ids
                assert ids[first[k - i] : first[k - i + 1]].tolist() == expected


def test_perfect_hash_is_minimal_and_knows_its_keys():
    for n in (0, 1, 2, 5000):
        keys = np.unique(np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n))
        assert sorted(token_index.PerfectHash.build(keys).slots(keys)) == list(range(len(keys)))
    with pytest.raises(ValueError):
        token_index.PerfectHash.build(np.array([3, 3]))


def test_token_files(spark, tmp_path):
    rows = [(40 - 3 * k, t) for k, t in enumerate([*AWKWARD, None])] + [(40, AWKWARD[0]), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    token_index.write_ids(docs, str(tmp_path / "ids"), queries.BYTE_BPE, 2)
    keys = spark.createDataFrame([(i,) for i, _ in rows[:-2]] + [(999,), (-7,), (8,)], "doc_id long")
    found = {r.doc_id: r for r in token_index.read_ids(keys, str(tmp_path / "ids")).collect()}
    library, start = token_index._tokenizer(queries.BYTE_BPE), 0
    assert set(found) == {i for i, _ in rows[:-1]}
    for i, text in sorted(rows[:-2], key=lambda r: r[0]):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        r = found[i]
        assert (r.ids, r.start, r.n_tokens) == (ids, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    empty = docs.limit(0)
    token_index.write_ids(empty, str(tmp_path / "none"), queries.BYTE_BPE, 2)
    assert token_index.read_ids(keys, str(tmp_path / "none")).collect() == []


def test_archives(spark, tmp_path):
    big = "".join(random.Random(1).choices("abcé \r\n", k=900_000))
    rows = [(1, "http://a/%0A?x=1\n2", "<p>é</p>"), (2, None, None), (3, "u", "<p>é</p>"), (9, "u", ""), (5, "v", big * 2), (7, "w", big * 2)]
    pages = spark.createDataFrame([(*r, "x") for r in rows] + [(None, "u", "y", "x")], "page_id long, url string, html string, data string")
    folder = str(tmp_path / "warc")
    archives = write_archives(pages, folder)
    stored = read_archives(archives, folder)
    largest = {}
    for i, _, html in rows:
        largest[html or ""] = max(i, largest.get(html or "", 0))
    expected = {}
    for i, _, html in rows:
        raw, target = (html or "").encode(), largest[html or ""]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        expected[i] = (len(raw), digest, "response", None) if target == i else (len(raw), digest, "revisit", target)
    found = pages_from(stored).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found} == expected
    parts = collections.defaultdict(list)
    for r in stored.collect():
        parts[r.page_id].append((r.chunk, bytes(r.data), r.url))
    assert len(parts[7]) > 1
    texts = {i: html or "" for i, _, html in rows}
    for i, url, _ in rows:
        whole = b"".join(p[1] for p in sorted(parts[i]))
        assert whole.decode() == (texts[i] if expected[i][2] == "response" else "")
        assert parts[i][0][2] == url
    direct = page_chunks(pages, size=1000).filter("last").collect()
    assert {r.page_id: (r.size, r.digest) for r in direct} == {i: x[:2] for i, x in expected.items()}
    none = write_archives(pages.limit(0), str(tmp_path / "none"))
    assert read_archives(none, str(tmp_path / "none")).collect() == []


def test_rollup_is_additive_and_commits_once(spark, tmp_path):
    schema = "source string, lang string, tokenizer string, tokens long"
    a = spark.createDataFrame([("s", "en", "v1", 5), ("s", "en", "v1", 7), (None, None, "v1", None)], schema)
    b = spark.createDataFrame([("s", "en", "v2", 6)], schema)
    rollup = Rollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().collect() == [] and rollup.committed() == set()
    assert rollup.commit("insert", deltas(None, a))
    assert not rollup.commit("insert", deltas(None, a))
    assert rollup.commit("revise", deltas(a.filter("tokens = 5"), b))

    def totals():
        return sorted((r.source or "", r.lang, r.tokenizer, r.docs, r.tokens) for r in rollup.totals().collect())

    expected = [("", None, "v1", 1, 0), ("s", "en", "v1", 1, 7), ("s", "en", "v2", 1, 6)]
    assert totals() == expected
    rollup.compact()
    assert totals() == expected and rollup.committed() == {"insert", "revise"}
    assert not rollup.commit("revise", deltas(None, a))
    assert rollup.commit("delete", deltas(a.filter("tokens is null"), None))
    assert totals() == expected[1:]
    rollup.compact()
    assert totals() == expected[1:]
    assert rollup.commit("nothing", deltas(a, a)) and totals() == expected[1:]


def test_token_totals_cover_all_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("text", "source", "lang").collect()
    library, expected = token_index._tokenizer(queries.BYTE_BPE), collections.Counter()
    for r in docs:
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        for version, tokens in (("byte_bpe_50k", n), ("byte_bpe_50k+end", n + 1)):
            expected[r.source, r.lang, version, "docs"] += 1
            expected[r.source, r.lang, version, "tokens"] += tokens
    found = queries.op5_token_counts(spark, SMALL).collect()
    assert {(r.source, r.lang, r.tokenizer, k): r[k] for r in found for k in ("docs", "tokens")} == dict(expected)
    assert len({r.text for r in docs}) < len(docs)  # copies count too


def brute(word, model):
    """All segmentations of a word, best first."""
    key = "".join("▁" if c == " " else "￿" if c == "▁" else c for c in word)
    out = []

    def go(at, ids, score):
        if at == len(word):
            out.append((score, ids))
            return
        for n in range(1, min(pieces.LONGEST, len(word) - at) + 1):
            if (piece := model.pieces.get(key[at : at + n])) is not None:
                go(at + n, [*ids, piece[0]], score + piece[1])
            elif n == 1:
                go(at + 1, ids + [int(model.bytes[b]) for b in word[at].encode()], score + model.unknown)

    go(0, [], 0.0)
    return sorted(out, key=lambda x: -x[0])


def listed(words, model):
    """``pieces.best`` with a list of ids for each word."""
    ids, size, score, second = pieces.best(words, model)
    return [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])], score, second


def test_segmentations_equal_brute_force():
    model = pieces.vocabulary(queries.PIECES)
    words = [" the", " thing", "  a", " ñé", " a\nb", " 漢字ab", " ▁x", " 123", " thhent", " ", " q\U0001f600"]
    for word, ids, score, second in zip(words, *listed(words, model), strict=True):
        every, found = brute(word, model), pieces.n_best(word, 6, model)
        assert score == every[0][0] and second == (every[1][0] if len(every) > 1 else -np.inf)
        assert [s for s, _ in found] == [s for s, _ in every[:6]]
        assert found[0][1] == ids and all((s, i) in every for s, i in found)


def test_long_runs_take_memory_in_proportion():
    model, random_ = pieces.vocabulary(queries.PIECES), random.Random(5)
    base64_like = "".join(random_.choices("ABCDEFGHabcdefghijklmnop0123456789+/", k=200_000))
    for short in (base64_like[:2000], "long" * 500):
        (ids,), score, second = listed([f" {short}"], model)
        found = pieces.n_best(f" {short}", 4, model)
        assert found[0] == (pytest.approx(score[0]), ids) and found[1][0] == pytest.approx(second[0])
    for run in (base64_like, "long" * 50_000):
        tracemalloc.start()
        found = pieces.n_best(f" {run}", 4, model)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 500e6
        assert len({tuple(ids) for _, ids in found}) == 4 and sorted(found, key=lambda x: -x[0]) == found
        assert all(pieces.decode(ids, queries.PIECES) == run for _, ids in found)


def test_segmented_texts_decode_and_have_the_best_alternatives(spark):
    model, short = pieces.vocabulary(queries.PIECES), ["is at", "a of b", " x yz", "to a\n"]
    rows = [(k, t) for k, t in enumerate([*short, *AWKWARD, None])] + [(None, "x"), (0, short[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    encoded = pieces.segment(docs, queries.PIECES)
    found = {r.doc_id: r for r in encoded.collect()}
    assert all(r.round_trip for r in found.values())
    for k, text in enumerate(short):
        every, r = brute(f" {text}", model), found[k]
        assert [r.score, *(o.score for o in r.others)] == [s for s, _ in every[: pieces.N]]
        for other in r.others:
            ids = list(r.ids)
            for edit in reversed(other.edits):
                ids[edit.at : edit.at + edit.n] = edit.ids
            assert (other.score, ids) in every
    back = {r.doc_id: r.text for r in pieces.decoded(encoded, queries.PIECES).collect()}
    assert {k: t or "" for k, t in rows} == back
    assert pieces.segment(docs.limit(0), queries.PIECES).collect() == []


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, folder), name)
        assert docs.columns == columns
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= ids and len(left) > 0.5 * len(ids)
        ids = left
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in encoded} == ids and all(r.round_trip for r in encoded)
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, folder).collect() == []
