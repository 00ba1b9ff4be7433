"""Nested JSON price files and the JSON files of public registries.

A price file is one JSON object whose ``standard_charge_information`` array holds everything of size.  Parsed
as a document it would have to fit into one row of one task, so it is read in pieces that end at ``}``; the pieces of a
block are put together to chunks of some MB, in the order of the scan and so without a shuffle.  String state and nesting
depth at each chunk follow from running sums over the chunks of a file (one small row per chunk).  With these, a chunk is
cut into array elements by itself; only the elements at its two ends meet others in a shuffle.  The elements come out as
rows that ``from_json`` parses one by one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import clean_string
from ..operators.joins import few_or_merged
from ..schema import NESTED_PRICE_FILE, NESTED_SERVICE
from .sinks import staged

SECTION = "standard_charge_information"
_PIECE_END = "}"
#: Bytes of text in a chunk; a piece is never cut.
CHUNK = 2**20
#: While chunks are read: few of them come to Python at once, and the reader decodes row by row, not thousands of rows.
_FEW_AT_ONCE = {"spark.sql.execution.arrow.maxRecordsPerBatch": "16", "spark.sql.parquet.enableVectorizedReader": "false"}
_AT = ["source_file", "block", "chunk"]
_BLANKS = b" \t\n\r\x0b\f"
_DEPTH = np.zeros(256, np.int64)
_DEPTH[[ord("{"), ord("[")]] = 1
_DEPTH[[ord("}"), ord("]")]] = -1


class _Brackets(NamedTuple):
    """Places of all brackets of a text, their change of depth, how many quotes stand ahead of each, and all quotes."""

    at: np.ndarray
    change: np.ndarray
    quotes_ahead: np.ndarray
    quotes: int


def _brackets(text: bytes) -> _Brackets:
    cells = np.frombuffer(text, np.uint8)
    quotes, escapes = np.flatnonzero(cells == ord('"')), np.flatnonzero(cells == ord("\\"))
    if len(escapes) and len(quotes):
        # a quote behind an odd number of backslashes is text
        begins = np.ones(len(escapes), bool)
        begins[1:] = np.diff(escapes) != 1
        first = np.maximum.accumulate(np.where(begins, escapes, 0))
        place = np.minimum(np.searchsorted(escapes, quotes - 1), len(escapes) - 1)
        quotes = quotes[(escapes[place] != quotes - 1) | ((quotes - first[place]) % 2 == 0)]
    change = _DEPTH[cells]
    at = np.flatnonzero(change)
    return _Brackets(at, change[at], np.searchsorted(quotes, at), len(quotes))


def _depths(text: bytes, in_string: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the brackets outside of strings, and the depth behind each."""
    found = _brackets(text)
    outside = (found.quotes_ahead + in_string) % 2 == 0
    return found.at[outside], depth + np.cumsum(found.change[outside])


def _chunks(size_of_chunk: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (``source_file, block, text``, the blocks of files one after another) put together."""
    schema = pa.schema([
        ("source_file", pa.string()), ("block", pa.int64()), ("chunk", pa.int64()), ("text", pa.string()),
        ("flips", pa.int64()), ("total0", pa.int64()), ("total1", pa.int64()),
    ])
    at, number, parts, size = None, 0, [], 0

    def chunk() -> pa.RecordBatch:
        text = b"}".join([*parts, b""])
        found = _brackets(text)
        inside = found.quotes_ahead % 2
        totals = [int(found.change[inside == s].sum()) for s in (0, 1)]
        values = pa.array([text], pa.binary()).view(pa.string())
        columns = [[at[0]], [at[1]], [number], values, [found.quotes % 2], [totals[0]], [totals[1]]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks, texts = batch.columns
        new = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(blocks[1:], blocks[:-1])).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for first, last in zip(starts[:-1], starts[1:], strict=True):
            here = (files[first].as_py(), blocks[first].as_py())
            if here != at:
                if parts:
                    yield chunk()
                at, number, parts, size = here, 0, [], 0
            for piece in texts[first:last].to_pylist():
                parts.append(piece)
                size += len(piece) + 1
                if size >= size_of_chunk:
                    yield chunk()
                    number, parts, size = number + 1, [], 0
    if parts:
        yield chunk()


def located_pieces(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Chunks of pieces, each piece with its ``}``: ``source_file, block, chunk, text``, and at their start ``in_string``
    and ``depth``.  A file that ends with other text than ``}`` has one too many behind it.

    The text is written once; placing the chunks is then a join with one row per chunk.
    """
    pieces = spark.read.option("lineSep", _PIECE_END).text(paths).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("text"),
    )
    schema = "source_file string, block long, chunk long, text string, flips long, total0 long, total1 long"
    chunks = staged(pieces.mapInArrow(partial(_chunks, CHUNK), schema), "json-chunks")
    in_file = W.partitionBy("source_file").orderBy("block", "chunk")
    states = chunks.select(*_AT, "flips", "total0", "total1").withColumn(
        "in_string", (F.sum("flips").over(in_file) - F.col("flips")) % 2
    )
    total = F.when(F.col("in_string") == 1, F.col("total1")).otherwise(F.col("total0"))
    states = staged(states.select(*_AT, "in_string", (F.sum(total).over(in_file) - total).alias("depth")), "json-states")
    return chunks.select(*_AT, "text").join(few_or_merged(states), _AT)


def _each(chunks: DataFrame, fn: Callable[[dict], list[dict]], schema: str, name: str) -> DataFrame:
    """Rows that ``fn`` gives (as dicts) for each chunk (a dict), written at once, as chunks must come to Python a few at a
    time."""
    spark, columns = chunks.sparkSession, to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.set_column(batch.schema.get_field_index("text"), "text", batch["text"].view(pa.binary()))
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist(fn(batch.slice(i, 1).to_pylist()[0]), schema=columns)

    before = {k: spark.conf.get(k) for k in _FEW_AT_ONCE}
    try:
        for k, v in _FEW_AT_ONCE.items():
            spark.conf.set(k, v)
        return staged(chunks.mapInArrow(run, schema), name)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _ends(text: bytes, at: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Places behind the ``}`` that leave depth 2: ends of the elements of top-level arrays."""
    cells = np.frombuffer(text, np.uint8)
    return at[(behind == 2) & (cells[at] == ord("}"))] + 1


def _events(section: str, chunk: dict) -> list[dict]:
    """A row per chunk: how many elements end in it, and where the section starts or an array of elements closes."""
    text = chunk["text"]
    at, behind = _depths(text, chunk["in_string"], chunk["depth"])
    ends = _ends(text, at, behind)
    marker = rb'"' + re.escape(section).encode() + rb'"\s*:\s*\[(?!\s*\])'
    found = [(m.end(), True) for m in re.finditer(marker, text)]
    for close in at[(behind == 1) & (np.frombuffer(text, np.uint8)[at] == ord("]"))].tolist():
        last = close - 1
        while last >= 0 and text[last] in _BLANKS:
            last -= 1
        if last < 0 or text[last] == ord("}"):  # an element, or the end of the chunk before, stands ahead
            found.append((close, False))
    events = [{"offset": o, "is_start": s, "ended": int(np.searchsorted(ends, o, "right"))} for o, s in sorted(found)]
    return [{**{k: chunk[k] for k in _AT}, "n": len(ends), "events": events}]


def located_sections(pieces: DataFrame, section: str = SECTION) -> DataFrame:
    """One row per chunk: ``n`` elements of top-level arrays end in it, of which ``ended`` ahead of each of its ``events``."""
    schema = "source_file string, block long, chunk long, n long, events array<struct<offset: long, is_start: boolean, ended: long>>"
    return _each(pieces, partial(_events, section), schema, "json-sections")


def section_bounds(pieces: DataFrame, section: str = SECTION, sections: DataFrame | None = None) -> DataFrame:
    """Per file the places where the section starts and ends (a file without elements in it has no row)."""
    sections = located_sections(pieces, section) if sections is None else sections
    events = sections.select("source_file", "block", "chunk", F.explode("events").alias("e")).select(
        "source_file", F.struct("block", "chunk", "e.offset", "e.ended").alias("at"), "e.is_start"
    )
    seen = F.count_if("is_start").over(
        W.partitionBy("source_file").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        events.withColumn("seen", seen)
        .groupBy("source_file")
        .agg(
            F.min(F.when(F.col("is_start"), F.col("at"))).alias("first_at"),
            F.min(F.when(~F.col("is_start") & (F.col("seen") > 0), F.col("at"))).alias("last_at"),
        )
        .filter(F.col("first_at").isNotNull())
    )


def _section_of(chunk: dict) -> tuple[int, int]:
    """The part of a chunk that is inside the section."""
    here = (chunk["block"], chunk["chunk"])

    def edge(at: dict | None, other: int) -> int:
        return at["offset"] if at is not None and (at["block"], at["chunk"]) == here else other

    return edge(chunk["first_at"], 0), edge(chunk["last_at"], len(chunk["text"]))


def _elements(chunk: dict) -> list[dict]:
    """Elements that stand in the chunk as a ``whole``, and the parts of those that go beyond it."""
    text = chunk["text"]
    low, high = _section_of(chunk)
    ends = _ends(text, *_depths(text, chunk["in_string"], chunk["depth"]))
    ends = ends[(ends > low) & (ends <= high)].tolist()
    starts = (chunk["first_at"]["block"], chunk["first_at"]["chunk"]) == (chunk["block"], chunk["chunk"])
    where, out = {k: chunk[k] for k in _AT}, []
    for i, (a, b) in enumerate(zip([low, *ends], [*ends, high], strict=True)):
        closes = i < len(ends)
        whole = closes and (i > 0 or starts)
        if b > a:
            part = text[a:b].lstrip(_BLANKS + b",") if whole else text[a:b]
            out.append({**where, "ordinal": i, "closes": closes, "whole": whole, "text": part})
    return out


def scan_array_elements(
    spark: SparkSession, paths: str | Sequence[str], section: str = SECTION, pieces: DataFrame | None = None,
    sections: DataFrame | None = None,
) -> DataFrame:
    """Elements (objects) of a top-level array: ``source_file, service_number`` (from 1), ``element`` text."""
    pieces = located_pieces(spark, paths) if pieces is None else pieces
    sections = located_sections(pieces, section) if sections is None else sections
    bounds = staged(section_bounds(pieces, section, sections), "json-bounds")
    here = F.struct("block", "chunk")

    def of(at: str) -> Column:
        return F.struct(F.col(f"{at}.block"), F.col(f"{at}.chunk"))

    # elements of the section that end ahead of each of its chunks
    first, last = here == of("first_at"), F.col("last_at").isNotNull() & (here == of("last_at"))
    inside = (here >= of("first_at")) & (F.col("last_at").isNull() | (here <= of("last_at")))
    counts = sections.drop("events").join(few_or_merged(bounds), "source_file").filter(inside).withColumn(
        "n", F.when(last, F.col("last_at.ended")).otherwise(F.col("n")) - F.when(first, F.col("first_at.ended")).otherwise(0)
    )
    in_file = W.partitionBy("source_file").orderBy("block", "chunk")
    counts = staged(counts.select(*_AT, (F.sum("n").over(in_file) - F.col("n")).alias("before"), "first_at", "last_at"), "json-counts")
    chunks = pieces.join(few_or_merged(counts.drop("before")), _AT)
    schema = "source_file string, block long, chunk long, ordinal long, closes boolean, whole boolean, text binary"
    parts = _each(chunks, _elements, schema, "json-elements").join(few_or_merged(counts.select(*_AT, "before")), _AT).select(
        "source_file", (F.col("before") + F.col("ordinal") + 1).alias("service_number"), "block", "chunk", "closes", "whole",
        F.col("text").cast("string").alias("text"),
    )
    several = (
        parts.filter("not whole")
        .groupBy("source_file", "service_number")
        .agg(
            F.array_sort(F.collect_list(F.struct("block", "chunk", "text"))).alias("parts"),
            F.max("closes").alias("complete"),
        )
        .filter("complete")
        .select(
            "source_file", "service_number",
            F.regexp_replace(F.array_join(F.col("parts.text"), ""), r"^[\s,]+", "").alias("element"),
        )
    )
    return parts.filter("whole").select("source_file", "service_number", F.col("text").alias("element")).unionByName(several)


def explode_services(
    spark: SparkSession, paths: str | Sequence[str], schema=NESTED_SERVICE, pieces: DataFrame | None = None,
    sections: DataFrame | None = None,
) -> DataFrame:
    """One row per service of nested price files: ``source_file, service_number, service``."""
    return scan_array_elements(spark, paths, pieces=pieces, sections=sections).select(
        "source_file", "service_number", F.from_json("element", schema).alias("service")
    )


def scan_nested_json(spark: SparkSession, paths: str | Sequence[str], schema=NESTED_PRICE_FILE) -> DataFrame:
    """Whole documents, one row per file - for small nested files; large ones go through
    :func:`explode_services`."""
    return spark.read.schema(schema).option("multiLine", True).json(paths).withColumn(
        "source_file", F.col("_metadata.file_path")
    )


_FILE_LEVEL = T.StructType([f for f in NESTED_PRICE_FILE.fields if f.name != SECTION])


def _outside(chunk: dict) -> list[dict]:
    """The text of a chunk that is not in the section, up to a ``}`` too many."""
    text = chunk["text"]
    at, behind = _depths(text, chunk["in_string"], chunk["depth"])
    below = at[behind < 0]
    end = int(below[0]) if len(below) else len(text)
    if chunk["depth"] < 0:
        end = 0
    if chunk["first_at"] is None:
        kept = text[:end]
    else:
        here = (chunk["block"], chunk["chunk"])
        first, last = ((x["block"], x["chunk"]) if x else None for x in (chunk["first_at"], chunk["last_at"]))
        ahead = text[: min(end, chunk["first_at"]["offset"] if here == first else len(text))] if here <= first else b""
        behind_it = text[chunk["last_at"]["offset"] if here == last else 0 : end] if last and here >= last else b""
        kept = ahead + behind_it
    return [{"source_file": chunk["source_file"], "block": chunk["block"], "chunk": chunk["chunk"], "text": kept}]


def nested_file_metadata(
    spark: SparkSession, paths: str | Sequence[str], pieces: DataFrame | None = None, sections: DataFrame | None = None
) -> DataFrame:
    """One provenance row per nested price file; list-valued fields give their first element."""
    pieces = located_pieces(spark, paths) if pieces is None else pieces
    bounds = staged(section_bounds(pieces, SECTION, sections), "json-bounds")
    here = F.struct("block", "chunk")
    first, last = (F.struct(F.col(f"{c}.block"), F.col(f"{c}.chunk")) for c in ("first_at", "last_at"))
    ends = pieces.join(few_or_merged(bounds), "source_file", "left").filter(
        F.col("first_at").isNull() | (here <= first) | (F.col("last_at").isNotNull() & (here >= last))
    )
    schema = "source_file string, block long, chunk long, text binary"
    outside = _each(ends, _outside, schema, "json-outside").withColumn("text", F.col("text").cast("string"))
    document = F.array_join(F.col("parts.text"), "")
    parsed = (
        outside.groupBy("source_file")
        .agg(F.array_sort(F.collect_list(F.struct("block", "chunk", "text"))).alias("parts"))
        .select("source_file", F.from_json(document, _FILE_LEVEL).alias("d"))
    )
    first = {"location_name": "mrf_location_name", "hospital_address": "mrf_address", "type_2_npi": "mrf_type_2_npi"}
    scalar = {"hospital_name": "mrf_hospital_name", "last_updated_on": "mrf_last_updated_on",
              "as_of_date": "mrf_as_of_date", "version": "mrf_version"}
    return parsed.select(
        "source_file",
        *[clean_string(F.get(F.col(f"d.{k}"), F.lit(0))).alias(v) for k, v in first.items()],
        *[clean_string(f"d.{k}").alias(v) for k, v in scalar.items()],
        clean_string("d.license_information.license_number").alias("mrf_license_number"),
    )


def scan_json_records(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """JSON array of flat records, nothing inferred."""
    return spark.read.schema(schema).option("multiLine", True).json(paths)


def header_array_rows(df: DataFrame, text: str, rename: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows of a JSON array of arrays whose first row holds the names; ``rename`` maps source name to output.

    ``keep`` columns of ``df`` identify the document.  A missing name gives NULL.
    """
    table = F.from_json(F.col(text), "array<array<string>>")
    rows = df.select(*keep, table.alias("_table")).select(
        *keep, F.get("_table", F.lit(0)).alias("_names"), F.posexplode("_table").alias("_row_number", "_row")
    )

    def cell(name: str) -> Column:
        place = F.array_position("_names", F.lit(name))
        return F.when(place > 0, F.get("_row", (place - 1).cast("int")))

    return rows.filter(F.col("_row_number") > 0).select(
        *keep, *[cell(source).alias(target) for source, target in rename.items()]
    )


def scan_header_array_json(spark: SparkSession, paths: str | Sequence[str], rename: Mapping[str, str]) -> DataFrame:
    return header_array_rows(spark.read.text(paths, wholetext=True), "value", rename)
