"""Token counts by source, language and tokenizer version, maintained by signed deltas.

The totals are sums, so a change is the rows it takes away (sign -1) and those it brings (sign +1): an insert has only
the latter, a delete only the former, a revised count both.  Each batch of changes is reduced to one signed row per group
and committed under its name.  A batch that is committed again, by a retry or twice by mistake, changes nothing:

* a batch is a folder ``batch=<name>``; it counts once Spark has written its ``_SUCCESS`` file;
* a commit of a name that counts already returns without reading its changes; one that broke off is written anew.

Compaction folds batches into one, named after their set, and remembers the names, so that they stay committed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import blocks, bounded_batches
from .token_index import ENCODED, encoder
from .work import by_batch

KEYS = ["source", "lang", "tokenizer"]
TOTALS = ["docs", "tokens"]
_SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


def token_counts(docs: DataFrame, path: str, version: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, source, lang, tokenizer, tokens) of each row of ``docs``; a null text has no tokens."""
    bounded_batches(docs.sparkSession)

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, data, bounds in blocks(batch.column(1), ENCODED):
            first = encoder(path).encode(data, bounds)[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], batch.column(2)[i:j], batch.column(3)[i:j], pa.array(np.diff(first).astype(np.int64))],
                names=["id", "source", "lang", "tokens"],
            )

    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), "source", "lang")
    counted = by_batch(plain, count, "id long, source string, lang string, tokens long")
    return counted.withColumn("tokenizer", F.lit(version))


def deltas(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """Signed rows (KEYS, docs, tokens) of a change from the rows ``before`` to the rows ``after``; groups whose changes
    cancel out have no row.  Null keys are groups like others."""
    parts = []
    for rows, sign in ((before, -1), (after, 1)):
        if rows is not None:
            one = F.lit(sign).cast("long")
            parts.append(rows.select(*KEYS, one.alias("docs"), (F.coalesce("tokens", F.lit(0)) * sign).alias("tokens")))
    if not parts:
        raise ValueError("a change needs rows before or after it")
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return every.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in TOTALS]).filter("docs <> 0 or tokens <> 0")


class Rollup:
    """The totals below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _names(self) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(at):
            return []
        found = [s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()]
        return sorted(n for n in found if self._exists(f"{self.folder}/{n}/_SUCCESS"))

    def _folded(self) -> tuple[str | None, set[str]]:
        """The compacted folder that counts, and the batches in it."""
        bases = []
        for name in self._names():
            if name.startswith("base="):
                batches = {r[0] for r in self.spark.read.text(f"{self.folder}/names-{name[5:]}").collect()}
                bases.append((len(batches), name, batches))
        return max(bases)[1:] if bases else (None, set())

    def committed(self) -> set[str]:
        """Names of the batches that count."""
        return {n[6:] for n in self._names() if n.startswith("batch=")} | self._folded()[1]

    def commit(self, name: str, changes: DataFrame) -> bool:
        """Add a batch of signed rows; False if it counts already."""
        if not name or "/" in name or "\n" in name:
            raise ValueError(f"a batch is not named {name!r}")
        if name in self.committed():
            return False
        changes.select(*KEYS, *TOTALS).write.mode("overwrite").parquet(f"{self.folder}/batch={name}")
        return True

    def totals(self) -> DataFrame:
        """(KEYS, docs, tokens) over all batches; groups that have come to nothing are left out."""
        base, folded = self._folded()
        names = [n for n in self._names() if n.startswith("batch=") and n[6:] not in folded] + ([base] if base else [])
        if not names:
            return self.spark.createDataFrame([], _SCHEMA)
        every = self.spark.read.schema(_SCHEMA).parquet(*[f"{self.folder}/{n}" for n in names])
        return every.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in TOTALS]).filter("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Fold all batches into one folder.  The names are written first: without the folder they mean nothing."""
        names = sorted(self.committed())
        mark = hashlib.sha256("\n".join(names).encode()).hexdigest()[:32]
        if not names or self._exists(f"{self.folder}/base={mark}/_SUCCESS"):
            return
        self.spark.createDataFrame([(n,) for n in names], "name string").write.mode("overwrite").text(f"{self.folder}/names-{mark}")
        self.totals().write.mode("overwrite").parquet(f"{self.folder}/base={mark}")
