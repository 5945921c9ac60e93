"""Near-duplicates by the exact Jaccard similarity of word shingles: fingerprints and MinHash find, sets confirm.

Two texts are linked if their sets of ``WIDTH``-word shingles have a Jaccard similarity of at
least ``SIMILAR``. Texts of one set are one class. A class has ``BANDS`` x ``ROWS`` MinHash bytes;
classes that agree in a band share a bucket. At similarity 0.8 a pair shares no bucket with
probability 2e-8, and less above. Classes whose fingerprints are linked (``simhash``) share one
more bucket, numbered after the bands. What is found is confirmed on the whole sets.

A bucket's classes are first confirmed along a chain in hashed order, so a large group of copies
costs one pair a class, not all pairs. Buckets that then still hold several components are
compared in full, in cells of two blocks of at most about ``CELL`` classes and ``CELL_BYTES`` of
their sets. Pairs of one component are settled, pairs that differ too much in size cannot be
similar, and of the rest those that agree in fewer than ``AGREE`` bytes are left out (at similarity
0.8 with probability 8e-9). What is left is confirmed inside the cell, best agreement first, and
a pair that is confirmed settles all others between its two components: a cell gives at most one
link for each component it holds, however many pairs it has to look at.

Shingles and sets are compared by 64-bit hashes. Null, empty and blank texts have the empty set
and are one class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import shingle_hashes, stored, text_buffers, text_slices, tune
from factorloom.llm.components import connected_components

WIDTH = 5
SIMILAR = (4, 5)  # as a fraction, for whole-number comparisons
BANDS, ROWS = 45, 5
AGREE = 144
CELL = 1024
CELL_BYTES = 1 << 24
SEED = 42
PAIRS_AT_ONCE = 1 << 16

_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(text, WIDTH))


def signature(hashes: np.ndarray) -> np.ndarray:
    """One byte of the least product of the hashes with each factor."""
    least = np.full(len(_FACTORS), (1 << 64) - 1, np.uint64)
    for start in range(0, len(hashes), 256):
        products = np.multiply.outer(_FACTORS, hashes[start : start + 256])
        np.minimum(least, products.min(axis=1), out=least)
    return (least >> np.uint64(24)).astype(np.uint8)


def _class_of(hashes: np.ndarray) -> int:
    """Hash of the set, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def _class_batches(fingerprint: Callable[[bytes], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            raw, offsets = text_buffers(batch.column("text"))
            ids, sizes, marks, prints = [], [], [], []
            for a, b in zip(offsets[:-1], offsets[1:]):
                text = raw[a:b].tobytes()
                hashes = shingle_set(text)
                ids.append(_class_of(hashes))
                sizes.append(len(hashes))
                marks.append(signature(hashes).tobytes() if len(hashes) else b"")
                prints.append(fingerprint(text))
            names = [n for n in batch.schema.names if n != "text"]
            own = {
                "_class": pa.array(ids, pa.int64()),
                "_size": pa.array(sizes, pa.int64()),
                "_marks": pa.array(marks, pa.binary()),
                "_fingerprint": pa.array(np.array(prints, np.uint64).view(np.int64)),
            }
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), *own.values()], [*names, *own])

    return run


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        raw, offsets = text_buffers(batch.column("text"))
        sets = [shingle_set(raw[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_pydict(
            {
                "id": pa.array(map(_class_of, sets), pa.int64()),
                "hashes": pa.array([s.tobytes() for s in sets], pa.binary()),
            }
        )


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets (sorted, distinct) reach the similarity; exact."""
    part, whole = SIMILAR
    if whole * min(len(x), len(y)) < part * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return whole * both >= part * (len(x) + len(y) - both)


def _confirm_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = [[np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(n)] for n in ("left", "right")]
        yield batch.select(["a", "b"]).filter(pa.array([similar(x, y) for x, y in zip(*sides)], pa.bool_()))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("right"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return stored(both.mapInArrow(_confirm_batches, "a long, b long"), "similar-pairs")


# --- buckets that hold several components --------------------------------------------------


def cell_links(
    marks: np.ndarray,
    sets: list[np.ndarray],
    roots: np.ndarray,
    second: np.ndarray,
    band: int,
    across: bool,
) -> tuple[list[int], list[int]]:
    """Rows (i, j) of a cell that are similar, one pair for each two components they join.

    Pairs that share an earlier band belong to that bucket; pairs that share none belong to that
    of their fingerprints (``BANDS``). ``second`` marks the rows of the cell's second block; a cell ``across`` two blocks only compares rows of the first with rows
    of the second.
    """
    part, whole = SIMILAR
    sizes = np.array([len(x) for x in sets], np.int64)
    _, group = np.unique(roots, return_inverse=True)
    step = max(1, PAIRS_AT_ONCE // max(len(sizes), 1))
    places = np.arange(len(sizes))
    left, right = [], []
    for start in range(0, len(sizes), step):
        rows = places[start : start + step, None]
        open_ = (~second[rows] & second) if across else rows < places
        open_ = open_ & (group[rows] != group)
        open_ &= whole * np.minimum(sizes[rows], sizes) >= part * np.maximum(sizes[rows], sizes)
        i, j = np.nonzero(open_)
        i += start
        agree = marks[i] == marks[j]
        total = agree.sum(axis=1)
        near = total >= AGREE
        shared = agree.reshape(-1, BANDS, ROWS).all(axis=2)
        near &= np.where(shared.any(axis=1), shared.argmax(axis=1), BANDS) == band
        best = np.flatnonzero(near)[np.argsort(-total[near], kind="stable")]
        for x, y in zip(i[best].tolist(), j[best].tolist()):
            if group[x] != group[y] and similar(sets[x], sets[y]):
                group[group == group[y]] = group[x]
                left.append(x)
                right.append(y)
    return left, right


def _cell_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found(cell: pa.Table) -> pa.RecordBatch:
        ids, roots, block = (cell[n].to_numpy() for n in ("id", "root", "block"))
        marks = np.frombuffer(b"".join(cell["_marks"].to_pylist()), np.uint8).reshape(len(ids), -1)
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in cell["hashes"]]
        low, high, band = (cell[n][0].as_py() for n in ("low", "high", "band"))
        i, j = cell_links(marks, sets, roots, block == high, band, low != high)
        return pa.RecordBatch.from_pydict(
            {"a": np.minimum(ids[i], ids[j]).astype(np.int64), "b": np.maximum(ids[i], ids[j]).astype(np.int64)}
        )

    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        keys = [held[n].to_numpy() for n in ("bucket", "low", "high")]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        start = 0
        for cut in cuts.tolist():
            yield found(held.slice(start, cut - start))
            start = cut
        held = held.slice(start)
    if held is not None and held.num_rows:
        yield found(held)


def _links_of_open_buckets(
    crowded: DataFrame, stars: DataFrame, classes: DataFrame, sets: DataFrame
) -> DataFrame | None:
    """Links between different components in the buckets that the chains have not settled."""
    named = crowded.join(stars.withColumnRenamed("node", "id"), "id", "left").select(
        "bucket", "band", "id", "_size", F.coalesce("root", "id").alias("root")
    )
    named = stored(named, "bucket-roots")
    # A bucket of two is one pair, and the chain had it.
    open_ = (
        named.groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("_size").alias("shingles"),
            F.min("root").alias("least"),
            F.max("root").alias("most"),
        )
        .filter("n > 2 and least != most")
        .select(
            "bucket",
            F.greatest(F.ceil(F.col("n") / CELL), F.ceil(F.col("shingles") * 8 / CELL_BYTES)).alias("blocks"),
        )
    )
    open_ = stored(open_, "open-buckets")
    if open_.isEmpty():
        return None
    rows = named.join(open_, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "bucket", "band", "id", "root", "block",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
    )
    full = cells.join(classes.select(F.col("_class").alias("id"), "_marks"), "id").join(sets, "id")
    found = (
        full.repartition("bucket", "low", "high")
        .sortWithinPartitions("bucket", "low", "high")
        .mapInArrow(_cell_batches, "a long, b long")
    )
    return stored(found, "cell-links")


# --- documents -----------------------------------------------------------------------------


def similar_classes(texts: DataFrame, classes: DataFrame, linked: DataFrame) -> DataFrame:
    """(node, root) of the components of similar classes.

    ``texts`` are (_row_key, text); ``classes`` have a _row_key that holds their set; ``linked``
    are (_class, group), where classes of a group have linked fingerprints.
    """
    keys = [
        F.xxhash64(F.lit(band), F.substring("_marks", band * ROWS + 1, ROWS)) for band in range(BANDS)
    ]
    dealt = classes.filter("_size > 0").select(
        F.col("_class").alias("id"), "_size", F.posexplode(F.array(*keys)).alias("band", "bucket")
    )
    alike = linked.join(classes.filter("_size > 0"), "_class").select(
        F.col("_class").alias("id"),
        "_size",
        F.lit(BANDS).alias("band"),
        F.xxhash64(F.lit(BANDS), "group").alias("bucket"),
    )
    dealt = dealt.unionByName(alike)
    chain = Window.partitionBy("bucket").orderBy(F.xxhash64("bucket", "id"), "id")
    crowded = stored(
        dealt.withColumn("before", F.lag("id").over(chain))
        .withColumn("after", F.lead("id").over(chain))
        .filter("before is not null or after is not null")
        .select("bucket", "band", "id", "_size", "before"),
        "crowded-buckets",
    )
    chosen = classes.join(crowded.select(F.col("id").alias("_class")).distinct(), "_class", "left_semi")
    # Repeated rows share a key; their sets are equal.
    sets = stored(
        texts.join(chosen.select("_row_key"), "_row_key", "left_semi")
        .select("text")
        .mapInArrow(_set_batches, "id long, hashes binary")
        .dropDuplicates(["id"]),
        "shingle-sets",
    )
    pairs = (
        crowded.filter("before is not null")
        .select(F.least("id", "before").alias("a"), F.greatest("id", "before").alias("b"))
        .distinct()
    )
    stars = connected_components(_confirmed(pairs, sets))
    rest = _links_of_open_buckets(crowded, stars, classes, sets)
    if rest is None:
        return stars
    # The components found so far stand for the links that made them.
    found = stars.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return connected_components(found.unionAll(rest))


def similar_documents(
    docs: DataFrame,
    fingerprint: Callable[[bytes], int],
    linked: Callable[[DataFrame], DataFrame],
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """``keep`` columns, ``_group`` and ``component_id`` of every document.

    ``linked`` gives the group of each of the distinct fingerprints: (fp) to (fp, group).
    A component's id is its least doc_id; null ids are ignored, and a component of null ids has
    a null id. ``_group`` is never null.
    """
    tune(docs.sparkSession)
    text = F.col("text").cast("string").alias("text")
    texts = docs.select(*keep, F.xxhash64("doc_id", text).alias("_row_key"), text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")
    marked = stored(
        texts.mapInArrow(
            _class_batches(fingerprint), f"{schema}, _class long, _size long, _marks binary, _fingerprint long"
        ),
        "shingle-marks",
    )
    classes = stored(
        marked.groupBy("_class").agg(
            F.min("doc_id").alias("first_id"),
            F.min("_row_key").alias("_row_key"),
            F.first("_size").alias("_size"),
            F.first("_marks").alias("_marks"),
        ),
        "shingle-classes",
    )
    # Texts of one set may have several fingerprints; empty sets have their class already.
    prints = stored(
        marked.filter("_size > 0").select("_class", F.col("_fingerprint").alias("fp")).distinct(), "class-fingerprints"
    )
    groups = linked(stored(prints.select("fp").distinct(), "fingerprint-values"))
    alike = stored(prints.join(groups, "fp").select("_class", "group").distinct(), "fingerprint-groups")
    stars = similar_classes(texts.select("_row_key", "text"), classes, alike)
    rooted = classes.join(stars.withColumnRenamed("node", "_class"), "_class", "left").select(
        "_class", "first_id", F.coalesce("root", "_class").alias("_group")
    )
    ids = rooted.groupBy("_group").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(ids, "_group").select("_class", "_group", "component_id")
    return marked.join(named, "_class").select(*keep, "_group", "component_id")
