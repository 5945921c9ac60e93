"""Near-duplicates by SimHash: fingerprints linked at a few differing bits, by binary tries.

A fingerprint takes the majority of each bit over the hashes of all word shingles of the whole
text. Equal fingerprints are one class. Two fingerprints that differ in at most ``DISTANCE`` of
64 bits agree in at least two of ``DISTANCE + 2`` bit blocks, so every choice of two blocks
gives a forest of binary tries, one for each value of the chosen bits. Each trie is joined with
itself: node pairs go down together, count the bits in which they differ and are cut off beyond
the budget; node pairs that cannot exceed it any more are linked whole.

A trie of more than ``TRIE_ROWS`` fingerprints is split again by two of the blocks of its free
bits. Every split fixes bits, so after ``SPLITS`` splits a trie holds at most 2^13 fingerprints
whatever the data: no group is unbounded, and none is cut.

Null, empty and blank texts have fingerprint zero and are linked like any other. Repeated rows
have equal results. A component's id is its least doc_id; null ids are ignored, and a component
of null ids has a null id.

The pipeline's stage takes the same fingerprints and links, but drops no document for them alone:
linked texts are held against each other by their exact similarity (``jaccard``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.session import materialize
from factorloom.llm.common import Shield, shingle_hashes, table, text_buffers, text_slices, tune
from factorloom.llm.components import connected_components
from factorloom.llm.jaccard import similar_documents

SHINGLE = 4
DISTANCE = 4
BITS = 64
TRIE_ROWS = 4096
SPLITS = 4
LEAF = 8
PAIRS_AT_ONCE = 1 << 19


# --- fingerprints --------------------------------------------------------------------------


def majority(hashes: np.ndarray) -> int:
    """Bit b is 1 if more than half of the hashes have it set."""
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 4096):
        part = hashes[start : start + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * counts > len(hashes)).tolist())


def fingerprint(text: bytes) -> int:
    """The fingerprint of one whole text."""
    return majority(shingle_hashes(text, SHINGLE))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        raw, offsets = text_buffers(batch.column("text"))
        values = [fingerprint(raw[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
        names = [n for n in batch.schema.names if n != "text"]
        signed = pa.array(np.array(values, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([*map(batch.column, names), signed], [*names, "_fingerprint"])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``_fingerprint`` (64 bits as a long) of each whole text."""
    wanted = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema if f.name != "text")
    return wanted.mapInArrow(_fingerprint_batches, f"{schema}, _fingerprint long")


# --- tries ---------------------------------------------------------------------------------


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def block_masks(free: int, distance: int = DISTANCE) -> list[int]:
    """Masks of every choice of two of ``distance + 2`` near-equal blocks of the free bits."""
    bits = [b for b in range(BITS) if free >> b & 1]
    parts = np.array_split(np.array(bits, dtype=object), distance + 2)
    blocks = [sum(1 << b for b in part) for part in parts]
    return [a | b for a, b in combinations(blocks, 2)]


def _with_trie(rows: DataFrame, masks: list[int]) -> DataFrame:
    """One row for each mask: the trie is the fixed bits and their value."""
    tries = [
        F.struct(F.lit(_signed(m)).alias("fixed"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value"))
        for m in masks
    ]
    return rows.select("fp", F.inline(F.array(*tries)))


def _split_tries(rows: DataFrame, distance: int) -> DataFrame:
    """Split each trie by two blocks of its free bits.

    The choices of bits are at most 15 to the power of the splits so far (at distance 4) and
    do not grow with the rows, so their masks are broadcast.
    """
    every = (1 << BITS) - 1
    masks = [
        (kind["fixed"], _signed((kind["fixed"] & every) | mask))
        for kind in rows.select("fixed").distinct().collect()
        for mask in block_masks(every & ~kind["fixed"], distance)
    ]
    choices = rows.sparkSession.createDataFrame(masks, "fixed long, mask long")
    return rows.join(F.broadcast(choices), "fixed").select(
        "fp", F.col("mask").alias("fixed"), F.col("fp").bitwiseAND(F.col("mask")).alias("value")
    )


def _bit_count(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values).astype(np.int64)


def _forest(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """Least node of each node's component, for the edges (a, b)."""
    root = np.arange(nodes)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            hop = root[root]
            if (hop == root).all():
                break
            root = hop
        if (root == before).all():
            return root


def _reduced(a: list[np.ndarray], b: list[np.ndarray], nodes: int) -> tuple[list, list]:
    root = _forest(np.concatenate(a), np.concatenate(b), nodes)
    moved = np.flatnonzero(root != np.arange(nodes))
    return [moved], [root[moved]]


def join_tries(values: np.ndarray, starts: np.ndarray, free: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, row) that connect all rows of a trie within the distance.

    ``values`` are fingerprints, sorted by trie and value; ``starts`` are the first rows of the
    tries, ``free`` the mask of the bits in which a trie's rows can differ. A node is a range of
    rows that agree above some bit. Enough links are given to connect what is linked, not all
    pairs.
    """
    ends = np.append(starts[1:], len(values))
    work = [(starts, ends, starts, ends, np.full(len(starts), BITS - 1), free, np.zeros(len(starts), np.int64))]
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    held = 0
    while work:
        a0, a1, b0, b1, bit, open_bits, spent = work.pop()
        if len(a0) > PAIRS_AT_ONCE:
            half = len(a0) // 2
            for part in (slice(None, half), slice(half, None)):
                work.append(tuple(x[part] for x in (a0, a1, b0, b1, bit, open_bits, spent)))
            continue
        same = a0 == b0
        useful = (spent <= distance) & ~(same & (a1 - a0 < 2))
        a0, a1, b0, b1, bit, open_bits, spent, same = (
            x[useful] for x in (a0, a1, b0, b1, bit, open_bits, spent, same)
        )
        if not len(a0):
            continue
        # All of both nodes are within the budget: hang every row on the first.
        below = np.where(bit >= 63, open_bits, open_bits & ((np.uint64(1) << np.minimum(bit + 1, 63).astype(np.uint64)) - np.uint64(1)))
        whole = spent + _bit_count(below) <= distance
        leaf = ~whole & (a1 - a0 <= LEAF) & (b1 - b0 <= LEAF)
        for first, last, base in ((a0, a1, a0), (b0, b1, a0)):
            size = (last - first)[whole]
            rows = np.repeat(first[whole], size) + _steps(size)
            left.append(rows)
            right.append(np.repeat(base[whole], size))
            held += len(rows)
        if leaf.any():
            wide, deep = (a1 - a0)[leaf], (b1 - b0)[leaf]
            place = _steps(wide * deep)
            across = np.repeat(deep, wide * deep)
            x = np.repeat(a0[leaf], wide * deep) + place // across
            y = np.repeat(b0[leaf], wide * deep) + place % across
            near = (_bit_count(values[x] ^ values[y]) <= distance) & (x != y)
            left.append(x[near])
            right.append(y[near])
            held += int(near.sum())
        if held > PAIRS_AT_ONCE:
            left, right = _reduced(left, right, len(values))
            held = len(left[0])
        deeper = ~whole & ~leaf
        if not deeper.any():
            continue
        a0, a1, b0, b1, bit, open_bits, spent, same = (
            x[deeper] for x in (a0, a1, b0, b1, bit, open_bits, spent, same)
        )
        # The children of a node: rows with the bit clear, then rows with it set.
        am, bm = _first_set(values, a0, a1, bit), _first_set(values, b0, b1, bit)
        children = [
            (a0, am, b0, bm, spent, True),
            (am, a1, bm, b1, spent, True),
            (a0, am, bm, b1, spent + 1, True),
            (am, a1, b0, bm, spent + 1, ~same),
        ]
        below_them = []
        for x0, x1, y0, y1, cost, only in children:
            there = (x1 > x0) & (y1 > y0) & (cost <= distance) & only
            below_them.append([v[there] for v in (x0, x1, y0, y1, bit - 1, open_bits, cost)])
        work.append(tuple(map(np.concatenate, zip(*below_them))))
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = _reduced(left, right, len(values))
    return a[0], b[0]


def _steps(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, in a row."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _first_set(values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """First row of each sorted range with the bit set, by halving; rows agree above the bit."""
    low, high = low.copy(), high.copy()
    shift = bit.astype(np.uint64)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        is_set = (values[np.minimum(middle, len(values) - 1)] >> shift) & np.uint64(1) == 1
        high = np.where(open_ & is_set, middle, high)
        low = np.where(open_ & ~is_set, middle + 1, low)
    return low


def _link_batches(distance: int):
    def joined(rows: list[np.ndarray]) -> pa.RecordBatch:
        fixed, value, fp = rows
        starts = np.flatnonzero(
            np.concatenate([[True], (fixed[1:] != fixed[:-1]) | (value[1:] != value[:-1])])
        )
        own = fp.view(np.uint64)
        free = ~fixed.view(np.uint64)[starts]
        order = np.lexsort((own, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(fp))))))
        a, b = join_tries(own[order], starts, free, distance)
        return pa.RecordBatch.from_pydict({"a": fp[order][a], "b": fp[order][b]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("fixed", "value", "fp")]
            held = new if held is None else [np.concatenate(pair) for pair in zip(held, new)]
            if len(held[0]) < 1 << 16:
                continue
            # All but the last trie are complete.
            change = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
            if len(change):
                cut = int(change[-1]) + 1
                yield joined([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield joined(held)

    return run


def _join(tries: DataFrame, distance: int) -> DataFrame:
    return (
        tries.repartition("fixed", "value")
        .sortWithinPartitions("fixed", "value")
        .select("fixed", "value", "fp")
        .mapInArrow(_link_batches(distance), "a long, b long")
    )


def link_fingerprints(
    values: DataFrame, distance: int = DISTANCE, trie_rows: int = TRIE_ROWS
) -> DataFrame:
    """Links (a, b) that connect all fingerprints ``fp`` (distinct longs) within the distance."""
    tries = _with_trie(values.select("fp"), block_masks((1 << BITS) - 1, distance))
    links = None
    for split in range(SPLITS + 1):
        large = tries.groupBy("fixed", "value").count().filter(F.col("count") > trie_rows)
        large = materialize(large.select("fixed", "value"), "large-tries")
        crowded = split < SPLITS and not large.isEmpty()
        small = tries.join(large, ["fixed", "value"], "left_anti") if crowded else tries
        found = _join(small, distance)
        links = found if links is None else links.unionAll(found)
        if not crowded:
            break
        rows = materialize(tries.join(large, ["fixed", "value"], "left_semi"), "crowded-tries")
        tries = _split_tries(rows, distance)
    return links


def linked_fingerprints(values: DataFrame) -> DataFrame:
    """(fp, group) of all fingerprints ``fp`` (distinct longs) that have a link; linked ones share a group.

    A trie hangs what it links on one fingerprint, the group; a fingerprint may be in several.
    """
    links = link_fingerprints(values).filter("a != b")
    ends = F.array(F.struct(F.col("a").alias("fp"), F.col("b").alias("group")), F.struct(F.col("b").alias("fp"), F.col("b").alias("group")))
    return links.select(F.inline(ends)).distinct()


def near_fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The contract of ``op10``: ``keep`` columns, ``_fingerprint`` and ``component_id`` of every document."""
    tune(docs.sparkSession)
    prints = materialize(fingerprints(docs, keep), "fingerprints")
    classes = materialize(
        prints.groupBy(F.col("_fingerprint").alias("fp")).agg(F.min("doc_id").alias("first_id")),
        "fingerprint-classes",
    )
    stars = connected_components(link_fingerprints(classes))
    rooted = classes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(named, prints["_fingerprint"] == named["fp"]).drop("fp")


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The groups of the pipeline's stage: texts of a five-word Jaccard similarity of 0.8 or more.

    Linked fingerprints propose pairs, MinHash those beyond the distance; exact sets confirm both.
    """
    return similar_documents(docs, fingerprint, linked_fingerprints, keep)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component stays, with all its columns: the one with the least id.

    Null ids come last; among rows that share an id, the least text hash decides, and repeated
    rows leave one.
    """
    tune(docs.sparkSession)
    shield = Shield(docs, "doc_id", "text")
    keyed = shield.docs.withColumn("_text_key", F.xxhash64("text"))
    found = near_duplicates(keyed, keep=("doc_id", "_text_key"))
    whole = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_text_key"))
    stays = found.groupBy("_group").agg(F.min(whole).alias("_first")).select(
        F.col("_first.doc_id").alias("_id"), F.col("_first._text_key").alias("_key")
    )
    kept = keyed.join(
        stays,
        keyed["doc_id"].eqNullSafe(stays["_id"]) & (keyed["_text_key"] == stays["_key"]),
        "left_semi",
    )
    rest = [c for c in shield.inside if c != "doc_id"]
    once = kept.groupBy("doc_id", "_text_key").agg(F.min(F.struct(*rest)).alias("_row"))
    return shield.restore(once.select("doc_id", "_row.*"))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    return near_fingerprints(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.lpad(F.lower(F.hex("_fingerprint")), 16, "0").alias("fingerprint"),
        "component_id",
    )
