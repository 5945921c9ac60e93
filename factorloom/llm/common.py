"""Shared helpers: Arrow text buffers, byte-bounded slices, seeded sampling of labels."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions.session import materialize

# White space of the contracts: space and code points 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

# Python passes hold at most about this many bytes of text at a time (one text at least).
SLICE_BYTES = 1 << 20

SHINGLE_SEED = 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


# Rows of an Arrow batch; texts of the usual length then make batches of a few MB. The driver keeps the
# text of every plan it has run, with all constants spelt out: a bound keeps that small.
RUNTIME = {
    "spark.sql.maxPlanStringLength": "8192",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def let_go(spark: SparkSession) -> None:
    """Free what finished plans hold.

    Spark drops the shuffles and broadcasts of a plan once the driver has collected its handles,
    which it would do every half an hour; rounds of small jobs leave many before that.
    """
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()


def stored(frame: DataFrame, label: str) -> DataFrame:
    """``materialize`` and free what the finished plan holds: its exchanges leave the disk at once."""
    kept = materialize(frame, label)
    let_go(frame.sparkSession)
    return kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the n + 1 offsets; a null is an empty text."""
    filled = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset :][: len(filled) + 1]
    data = filled.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(lengths: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes; a longer row is alone."""
    start, total = 0, 0
    for row, length in enumerate(lengths):
        if row > start and total + length > limit:
            yield start, row
            start, total = row, 0
        total += length
    if start < len(lengths):
        yield start, len(lengths)


def text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut batches with a ``text`` column to slices of bounded bytes."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
        for start, stop in slices(sizes):
            yield batch.slice(start, stop - start)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every shingle of the text, repeats included."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SHINGLE_SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - width]]
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a : b - 1], SHINGLE_SEED) for a, b in zip(starts, ends[width - 1 :])),
        np.uint64,
        len(starts),
    )


def bucket(column: Column, seed: str, buckets: int) -> Column:
    """Seeded bucket of a value; the same on every layout."""
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(buckets))


def labelled_sample(
    labels: DataFrame, label: str, *, train: Column, seed: str, max_rows: int
) -> DataFrame:
    """(doc_id, label) of at most about ``max_rows`` training documents, by a seeded hash.

    Null ids, labels other than 0 and 1 and documents with both labels are left out; repeated
    rows count once. The bound makes the result fit for a broadcast.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .filter(train)
        .groupBy("doc_id")
        .agg(F.min(label).alias("_low"), F.max(label).alias("_high"))
        .filter("_low = _high")
        .select("doc_id", F.col("_low").cast("int").alias("label"))
    )
    total = known.count()
    if total <= max_rows:
        return known
    share = int(max_rows / total * (1 << 20))
    return known.filter(bucket(F.col("doc_id"), seed, 1 << 20) < share)


class Shield:
    """Keeps all columns of a table through an operator, whatever their names.

    Columns that the operator reads keep their names (the first of each name); all others get
    names of their own until ``restore`` puts names and order back.
    """

    def __init__(self, docs: DataFrame, *read: str):
        self.names, taken, self.inside = docs.columns, set(), []
        for place, name in enumerate(self.names):
            own = name in read and name not in taken
            taken.add(name)
            self.inside.append(name if own else f"_kept_{place}")
        self.docs = docs.toDF(*self.inside)

    def restore(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(a).alias(b) for a, b in zip(self.inside, self.names)])


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds, F.lit(0))
