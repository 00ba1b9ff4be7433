"""Near duplicates, substring removal, decontamination and quality rules against brute force."""

import collections
import hashlib
import random
import re

import pytest
from ratebook.llm import near_dedup, substring_dedup
from ratebook.llm.components import components
from ratebook.llm.decontaminate import contamination, drop_contaminated
from ratebook.llm.quality_rules import MEASURES, RULES, quality_rules, thresholds
from ratebook.llm.substring_dedup import Automaton, first_windows

SCHEMA = "doc_id long, text string, lang string, source string, extra string"
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts):
    """Documents with a column more than the library knows."""
    rows = [(i, t, "en", "s", "x") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed=4):
    """Texts with copies, near copies, shared passages and the awkward cases; ids are not in order."""
    random.seed(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = " ".join(random.choices(vocabulary, k=60))
    texts = [None, "", "  \n\t ", "one", "One ", "a b c d", "A b  c d", "same " * 80, "same " * 81]
    for k in range(30):
        words = random.choices(vocabulary, k=random.randint(30, 160))
        texts.append(" ".join(words))
        if k % 3 == 0:
            near = list(words)
            for _ in range(random.randint(0, 4)):
                near[random.randrange(len(near))] = "changed"
            texts += [" ".join(near), " ".join(words).upper(), " ".join(near)]
        if k % 4 == 0:
            texts.append(" ".join(words[:20]) + " " + passage + "\n" + " ".join(words[20:50]))
    texts.append(" ".join(random.choices(vocabulary, k=3000)))  # a long one
    ids = random.sample(range(1000), len(texts))
    return list(zip(ids, texts, strict=True))


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def expected_groups(texts):
    sets = {i: shingles(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    texts = corpus()
    found = near_dedup.near_duplicates(table(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == expected_groups(texts)


def test_near_duplicates_of_large_nodes(spark, monkeypatch):
    """Small limits, so that nodes branch, are compared in blocks, and end in blocks of all members."""
    monkeypatch.setattr(near_dedup, "NODE", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "MAX_DEPTH", 1)
    monkeypatch.setattr(near_dedup, "SHINGLES", 300)
    random.seed(9)
    shared = [f"h{k}" for k in range(60)]
    texts = []
    for k in range(45):
        words = shared + [f"d{k}x{j}" for j in range(random.choice([3, 12, 60]))]
        words[random.randrange(20, 50)] = f"e{k}"
        texts.append((k, " ".join(words)))
    found = near_dedup.near_duplicates(table(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == expected_groups(texts)


def test_near_duplicates_of_nothing_and_of_rows_without_ids(spark):
    assert near_dedup.near_duplicates(table(spark, [])).collect() == []
    rows = near_dedup.near_duplicates(table(spark, [(None, "a b c"), (3, "a b c"), (3, "a b c"), (5, "a b c")])).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in rows if r.doc_id) == [(3, 3, True), (3, 3, True), (5, 3, False)]
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, False)]
    left = near_dedup.drop_near_duplicates(table(spark, [(3, "a b"), (3, "a b"), (5, "A b"), (7, None)]))
    assert sorted(r.doc_id for r in left.collect()) == [3, 7]
    assert "extra" in left.columns


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, few):
    """By rounds of joins, and by one task."""
    edges = [(5, 4), (4, 9), (9, 12), (20, 21), (7, 7), (5, 4)] + [(100 + k, 101 + k) for k in range(40)]
    found = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long"), few).collect()}
    assert {k: v for k, v in found.items() if k < 100} == {4: 4, 5: 4, 9: 4, 12: 4, 20: 20, 21: 20}
    assert {v for k, v in found.items() if k >= 100} == {100}


def expected_substrings(texts, window=20):
    seen, out = {}, {}
    for i, text in sorted(texts, key=lambda x: x[0]):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if seen.setdefault(tuple(words[k : k + window]), (i, k)) != (i, k):
                gone[k : k + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[i] = len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()
    return out


@pytest.mark.parametrize("shared", [256, 1])
def test_substrings_equal_brute_force(spark, monkeypatch, shared):
    """By automata, and (with a limit of one passage) by the windows of hot anchors."""
    monkeypatch.setattr(substring_dedup, "SHARED", shared)
    texts = corpus(8)
    found = substring_dedup.substring_duplicates(table(spark, texts)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == expected_substrings(texts)


def test_removed_substrings_leave_other_columns(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    texts = [(1, f"first  {passage}"), (2, f"{passage} tail"), (3, passage), (4, None), (5, "short")]
    found = {r.doc_id: r for r in substring_dedup.remove_substrings(table(spark, texts)).collect()}
    assert {k: r.text for k, r in found.items()} == {1: f"first  {passage}", 2: "tail", 4: None, 5: "short"}
    assert found[2].extra == "x"
    assert substring_dedup.remove_substrings(table(spark, [])).collect() == []


def test_automaton_finds_first_occurrences():
    random.seed(1)
    for _ in range(60):
        rows = [(random.randrange(4), 50 * k, random.choices(range(3), k=random.randint(1, 14))) for k in range(4)]
        window = random.randint(1, 5)
        kept = {(i, s + k) for i, s, n in first_windows(rows, window) for k in range(n)}
        every = sorted((i, s + k, tuple(w[k : k + window])) for i, s, w in rows for k in range(len(w) - window + 1))
        seen, wanted = set(), set()
        for i, place, run in every:
            if run not in seen:
                wanted.add((i, place))
            seen.add(run)
        assert kept == wanted
    empty = Automaton()
    assert [size for size, _ in empty.matches([1, 2], 3)] == [0, 0]


def test_contamination_equals_brute_force(spark):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "Short one"), (3, ""), (4, None)]
    items += [(15, "é-x 7 seven"), (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    texts = [
        (1, "x Alpha, beta; gamma delta epsilon zeta eta theta iota kappa y"),
        (2, "beta gamma delta epsilon zeta eta theta iota kappa lambda"),
        (3, "short, ONE short two"),
        (4, None),
        (5, "É-x 7 seven é x 7 seven"),
        (6, "..."),
        (7, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu alpha beta"),
    ]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for i, text in items:
        words = word.findall((text or "").translate(LOWER))
        for k in range(max(1, len(words) - 9) if words else 0):
            windows[tuple(words[k : k + 10])].add(str(i))
    expected = {}
    for i, text in texts:
        words = word.findall((text or "").translate(LOWER))
        hit, own = [False] * len(words), set()
        for run, names in windows.items():
            for k in range(len(words) - len(run) + 1):
                if tuple(words[k : k + len(run)]) == run:
                    own |= names
                    hit[k : k + len(run)] = [True] * len(run)
        digest = hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
        expected[i] = (len(words), sum(hit), len(own), digest, any(hit))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = contamination(table(spark, texts), benchmark).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found} == expected
    clean = sorted(i for i, x in expected.items() if not x[-1])
    assert sorted(r.doc_id for r in drop_contaminated(table(spark, texts), benchmark).collect()) == clean == [4, 6]
    assert contamination(table(spark, []), benchmark).count() == 0
    assert contamination(table(spark, texts), benchmark.limit(0)).filter("contaminated").count() == 0


def test_quality_measures_equal_brute_force(spark):
    texts = corpus(3) + [(2000, "a | b\n\na | b\n a | b\nx"), (2001, "#*$%&|<>\n" * 60), (2002, "é日本 ok\n\n\nok")]
    expected = {}
    for i, text in texts:
        text = text or ""
        words = WORD.findall(text)
        runs = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        covered = [False] * len(words)
        for k in range(len(words) - 2):
            if runs[tuple(words[k : k + 3])] > 1:
                covered[k : k + 3] = [True] * 3
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        repeat = sum(covered)
        failed = len(words) < 50 or 100 * repeat > 50 * len(words)
        expected[i] = (len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), dup, repeat, failed)
    found = quality_rules(table(spark, texts)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert {r.doc_id: tuple(r[n] for n in names) for r in found} == expected
    assert not any(r.kept for r in found if r.base_failed)
    assert quality_rules(table(spark, [])).collect() == []
    assert [r.kept for r in quality_rules(spark.createDataFrame([(None, "x", None, None, "y")], SCHEMA)).collect()] == [False]


def test_each_quality_threshold_follows_its_group(spark):
    names = ["lang", "source", *MEASURES]

    def rows(source, scale):
        spread = [k * scale // 10 for k in range(200)]  # 0 to 20 times the scale
        return [("en", source, *[(400 if m == "word_length" else 0) + v for m in MEASURES]) for v in spread]

    # three groups of other scales, one that is small, one without a spread, one near the maximum of the shares
    data = rows("low", 1) + rows("mid", 2) + rows("high", 10) + rows("few", 1)[:50]
    data += [("en", "same", *[500] * len(MEASURES))] * 150
    data += [("en", "full", *[600 + k if m == "word_length" else 1000 * (k % 2) for m in MEASURES]) for k in range(150)]
    found = {r.source: r for r in thresholds(spark.createDataFrame(data, ", ".join(f"{n} {'string' if k < 2 else 'long'}" for k, n in enumerate(names)))).collect()}
    for name in RULES:
        column = f"limit_{name}"
        assert len({found[s][column] for s in ("low", "mid", "high")}) == 3
        assert found["few"][column] == found["same"][column]  # both take those of the language
        if name not in ("word_length", "short_words"):
            assert found["low"][column] < found["mid"][column] < found["high"][column]
            assert found["full"][column] == 999  # a document of nothing else still fails
    assert found["low"].limit_symbol_share < 100 and found["high"].limit_symbol_share > 200


def test_quality_rules_pass_documents_that_are_all_alike(spark):
    text = " ".join(f"word{k}" for k in range(100, 160))
    assert all(r.kept for r in quality_rules(table(spark, [(k, text) for k in range(150)])).collect())
    odd = table(spark, [(k, text.replace("word", "w" * (4 + k % 3))) for k in range(150)] + [(999, text.replace("word", "w" * 40))])
    assert [r.doc_id for r in quality_rules(odd).collect() if not r.kept] == [999]
