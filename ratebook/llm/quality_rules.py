"""Quality rules with adaptive thresholds.

Each document gets a few measures.  Fixed cutoffs are replaced by quantiles of each measure per language and source,
read from mergeable sketches: counts of values in buckets whose width grows with the value (exact below ``EXACT``, then
within 1/64 of the value).  Adding counts merges sketches, so the sketches of any parts of the corpus give the same
thresholds as the whole, in any order and to the last digit.  No rule has a fixed limit: each lies beyond a quantile by a
multiple of the distance between two quantiles.  A group with fewer than ``MIN_GROUP`` documents, or without a distance
between the two, takes the sketch of its language, and where that has none either, of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import SPACE, Sequences, Words, blocks, bounded_batches, span_hashes
from .work import by_batch, staged

MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 50, 50, 3
EXACT, MIN_GROUP = 128, 100
#: Rule: (measure, end quantile and middle quantile in thousandths, factor in percent).  The limit lies beyond the end
#: quantile by the factor times its distance from the middle one; a document fails above it, or below it where the end is
#: the lower one.
RULES = {
    "word_length": ("word_length", 900, 500, 400),
    "short_words": ("word_length", 50, 500, 200),
    "symbol_share": ("symbol_share", 900, 500, 200),
    "dup_line_share": ("dup_line_share", 950, 500, 50),
    "repeat_share": ("repeat_share", 900, 500, 400),
}
MEASURES = sorted({rule[0] for rule in RULES.values()})
#: Largest value of the measures that have one.
MOST = {"symbol_share": 1000, "dup_line_share": 1000, "repeat_share": 1000}
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _repeated(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of values that occur twice or more in their group, and of those that are not the first."""
    order = np.lexsort((values, group))
    same = (values[order][1:] == values[order][:-1]) & (group[order][1:] == group[order][:-1])
    again, twice = np.zeros(len(values), bool), np.zeros(len(values), bool)
    again[order[1:]] = same  # lexsort is stable: the first of equal values comes first
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, again


def _measure(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i, j, data, bounds in blocks(batch.column(1)):
        n = j - i
        words = Words(data, bounds, SPACE)
        doc = np.repeat(np.arange(n), words.counts)
        begins = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=begins[1:])
        chars = np.bincount(doc, begins[words.end] - begins[words.start], n).astype(np.int64)
        symbols = np.diff(np.concatenate([[0], np.cumsum(_SYMBOLS[data])])[bounds])

        # lines end at \n and at the ends of documents
        ends = np.union1d(np.flatnonzero(data == 10), bounds[1:])
        starts = np.concatenate([[0], ends[:-1] + (data[np.minimum(ends[:-1], len(data) - 1)] == 10)]) if len(data) else ends
        starts = np.maximum(starts, bounds[np.searchsorted(bounds, ends, "left") - 1]) if len(data) else starts
        starts = np.minimum(starts, ends)
        at = np.searchsorted(words.start, starts)
        full = at < np.searchsorted(words.start, ends)
        starts, ends = starts[full], ends[full]
        line_doc = np.searchsorted(bounds, starts, "right") - 1
        again = _repeated(span_hashes(data, starts, ends), line_doc)[1]
        dup_lines = np.bincount(line_doc[again], minlength=n)
        lines = np.bincount(line_doc, minlength=n)

        runs = Sequences(words.hashes()).all(REPEAT_WINDOW)
        inside = np.flatnonzero(np.arange(len(runs)) + REPEAT_WINDOW <= words.stop[: len(runs)])
        twice = inside[_repeated(runs[inside], doc[inside])[0]]
        covered = np.zeros(len(words) + REPEAT_WINDOW, bool)
        for k in range(REPEAT_WINDOW):
            covered[twice + k] = True
        repeat = np.bincount(doc[covered[: len(words)]], minlength=n)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0)[i:j], batch.column(2)[i:j], batch.column(3)[i:j]]
            + [pa.array(x.astype(np.int64)) for x in (words.counts, chars, symbols, dup_lines, repeat, lines)],
            names=["id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"],
        )


def measures() -> dict[str, Column]:
    """Whole numbers that the rules look at; shares are in thousandths, word length in hundredths of a character."""
    words = F.greatest("n_words", F.lit(1))
    return {
        "word_length": F.expr("word_chars * 100 div greatest(n_words, 1)"),
        "symbol_share": F.expr("n_symbols * 1000 div greatest(word_chars, 1)"),
        "dup_line_share": F.expr("n_dup_lines * 1000 div greatest(n_lines, 1)"),
        "repeat_share": (F.col("n_repeat_words") * 1000 / words).cast("long"),
    }


def bucket(value: Column) -> Column:
    """Lower end of the sketch bucket of a whole number from 0: the value itself below EXACT, then its leading bits."""
    bits = F.length(F.bin(value))
    shift = F.greatest(bits - len(bin(EXACT - 1)) + 2, F.lit(0))
    return F.expr("1L") * F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketch(measured: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, measure, bucket, n) over the measures in ``names``."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in names])
    cells = measured.select(*keys, F.explode(pairs).alias("cell")).select(*keys, "cell.*")
    return cells.groupBy(*keys, "measure", "bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser ``keys``, or of several parts, by adding counts."""
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], thousandths: list[int]) -> DataFrame:
    """(keys, measure, total, values): for each share, by its number, the smallest bucket up to which at least that share
    of values lie.

    A sketch has a few thousand buckets at most, so they are put in order as one list per group.
    """
    cells = F.sort_array(F.collect_list(F.struct("bucket", "n")))
    lists = sketches.groupBy(*keys, "measure").agg(cells.alias("cells"), F.sum("n").alias("total"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("at"))

    def value(share: int) -> Column:
        need = F.greatest(F.lit(1), F.ceil(F.col("total") * share / 1000)).cast("long")

        def step(acc: Column, cell: Column) -> Column:
            total = acc["sum"] + cell["n"]
            at = F.when(acc["at"].isNull() & (total >= need), cell["bucket"]).otherwise(acc["at"])
            return F.struct(total.alias("sum"), at.alias("at"))

        return F.aggregate("cells", start, step)["at"].alias(f"q{share}")

    return lists.select(*keys, "measure", "total", F.struct(*[value(x) for x in thousandths]).alias("values"))


def _limit(end: Column, middle: Column, upper: bool, factor: int, most: int | None) -> Column:
    """The limit beyond ``end``; at most half the way to the end of the measure's range, and below its maximum."""
    beyond = F.floor(F.abs(end - middle) * factor / 100).cast("long")
    if not upper:
        return end - F.least(beyond, F.floor(end / 2).cast("long"))
    if most is None:
        return end + beyond
    return F.least(end + F.least(beyond, F.floor((most - end) / 2).cast("long")), F.lit(most - 1).cast("long"))


def thresholds(measured: DataFrame) -> DataFrame:
    """(lang, source, one limit per rule) for each group of ``measured``; null is a group like any other.

    A group that is small, or in which the two quantiles of a rule are the same, has no scale of its own for the rule and
    takes the quantiles of its language, and where that has none, of the corpus.
    """
    keys = ["lang", "source"]
    shares = sorted({x for rule in RULES.values() for x in rule[1:3]})
    fine = staged(sketch(measured, keys, MEASURES), "sketches")
    by_lang = merge(fine, ["lang"])
    own = quantiles(fine, keys, shares)
    lang = quantiles(by_lang, ["lang"], shares).select(F.col("lang").alias("l"), "measure", F.col("total").alias("lt"), F.col("values").alias("lv"))
    whole = quantiles(merge(by_lang, []), [], shares).select("measure", F.col("values").alias("wv"))
    chosen = own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (own["measure"] == lang["measure"])).drop(lang["measure"], "l")
    chosen = chosen.join(whole, "measure")

    def limit(measure: str, end: int, middle: int, factor: int) -> Column:
        def scaled(values: str, total: str) -> Column:
            return (F.col(total) >= MIN_GROUP) & (F.col(values)[f"q{end}"] != F.col(values)[f"q{middle}"])

        used = F.when(scaled("values", "total"), F.col("values")).when(scaled("lv", "lt"), F.col("lv")).otherwise(F.col("wv"))
        return _limit(used[f"q{end}"], used[f"q{middle}"], end > middle, factor, MOST.get(measure))

    return chosen.groupBy(*keys).agg(
        *[F.max(F.when(F.col("measure") == rule[0], limit(*rule))).alias(f"limit_{name}") for name, rule in RULES.items()]
    )


def _fails(name: str) -> Column:
    """Whether a measure is beyond the limit of a rule, told in buckets, as the limit is."""
    measure, end, middle, _ = RULES[name]
    value, limit = bucket(F.col(measure)), F.col(f"limit_{name}")
    return value > limit if end > middle else (value < limit) & (F.col("n_words") > 0)


def quality_rules(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """(id, counts, base_failed, kept, the rules that failed) for each row of ``docs``.

    Null texts have no words and fail the base rules; null languages and sources form groups of their own; null ids and
    repeated rows are rows like others.
    """
    bounded_batches(docs.sparkSession)
    plain = docs.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column), F.col(lang).alias("lang"), F.col(source).alias("source")
    )
    schema = "id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
    measured = staged(by_batch(plain, _measure, schema), "measures").withColumns(measures())
    limits = thresholds(measured).withColumnsRenamed({"lang": "l", "source": "s"})
    limits = staged(limits, "thresholds")
    # one row per language and source, broadcast if the planner finds it small, else joined with split hot groups
    both = measured.join(limits, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    failed = F.filter(F.array(*[F.when(_fails(name), F.lit(name)) for name in RULES]), lambda x: x.isNotNull())
    return both.withColumns({"base_failed": base, "failed_rules": failed}).select(
        F.col("id").alias(id_column),
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"],
        (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"),
        "failed_rules",
    )
