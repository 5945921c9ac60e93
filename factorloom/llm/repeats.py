"""Repeated passages: every byte under a string of ``LENGTH`` bytes that starts twice or more.

Prefix-free parsing, dealt out. A rolling hash over the bytes triggers at its least value in
every run of ``REACH`` positions, so what triggers depends on the text around it only, and every
string of LENGTH bytes holds a trigger at the same place wherever it occurs. The phrase of a
trigger is the text of all strings that trigger there, from up to REACH bytes before it. Equal
phrases are one entry of the dictionary with a count; the parse is the list of triggers.

The order of suffixes matters only as far as their first LENGTH bytes are equal, so suffixes are
classed by two 64-bit fingerprints of those bytes instead of being sorted by letters:

1. A phrase that occurs twice repeats as a whole. A phrase whose core (the bytes that all its
   strings share) is unique repeats nowhere. Only the dictionary entries between, at the edges
   of repeated text, go on.
2. Their suffixes are classed in blocks of ``BLOCK`` starts in the same two ways.
3. The starts of blocks still open are classed one by one.

Counts of an entry stand for all its occurrences, so text that repeats very often costs as much
as one copy. Results return to the parse by the entry, and to the documents by 128 bits of hash
of the text, as equal texts have equal results.

Null and short texts (under LENGTH bytes) have nothing removed. Repeated rows are occurrences of
each other. Very long texts are parsed in pieces of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.session import materialize
from factorloom.llm.common import slices, table, text_buffers, text_slices, tune

LENGTH = 400
REACH = 192
BLOCK = 32
GRAM = 16
PIECE = 1 << 20

BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_U = np.uint64


def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)


class Fingerprints:
    """64-bit fingerprints of any substrings of a byte array, for one of the bases."""

    def __init__(self, which: int):
        self.base = BASES[which]
        self.inverse = pow(self.base, -1, 1 << 64)
        self.values = _byte_values(which)
        self.powers = self.inverses = np.ones(1, _U)
        self.sums = np.zeros(1, _U)

    def read(self, data: np.ndarray) -> None:
        if len(self.powers) <= len(data):
            n = len(data) + 1
            step = np.full(n, self.base, _U)
            back = np.full(n, self.inverse, _U)
            step[0] = back[0] = 1
            self.powers, self.inverses = np.cumprod(step), np.cumprod(back)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        mixed = (self.sums[ends] - self.sums[starts]) * self.inverses[starts]
        mixed ^= mixed >> _U(32)
        return mixed * _U(0xD6E8FEB86659FD93)


def _rolling(data: np.ndarray) -> np.ndarray:
    """32-bit hash of the GRAM bytes from each position (the last ones read zeros)."""
    wide = np.concatenate([data, np.zeros(GRAM, np.uint8)]).astype(_U)
    for width in (1, 2, 4):
        wide = wide[:-width] | (wide[width:] << _U(8 * width))
    first, second = wide[: len(data)], wide[8 : 8 + len(data)]
    mixed = (first * _U(BASES[0])) ^ ((second + _U(0x632BE59BD9B4E019)) * _U(BASES[1]))
    mixed ^= mixed >> _U(29)
    return (mixed * _U(0xBF58476D1CE4E5B9)) >> _U(32)


def _least_places(hashes: np.ndarray, reach: int) -> np.ndarray:
    """Place of the least hash among the ``reach`` positions from each start, leftmost first."""
    least = (hashes << _U(32)) | np.arange(len(hashes), dtype=_U)
    width = 1
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:]) if width < len(least) else least[:0]
        width *= 2
    if reach > width and len(least) > reach - width:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    return (least & _U(0xFFFFFFFF)).astype(np.int64)


def triggers(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, reach: int) -> tuple[np.ndarray, ...]:
    """(place, least offset, greatest offset) of the strings that trigger at each place.

    The strings start at ``starts[k]`` and the next ``counts[k] - 1`` positions; an offset is
    the place less a string's start.
    """
    places = _least_places(_rolling(data), reach)
    rows = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
    own = places[rows]
    edge = np.ones(len(rows), bool)
    edge[1:] = (own[1:] != own[:-1]) | (rows[1:] != rows[:-1] + 1)
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(rows)) - 1
    at = own[first]
    return at, at - rows[last], at - rows[first]


def _pieces(sizes: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (row, first start, number of starts) of about PIECE starts in all."""
    held, total = [], 0
    for row, size in enumerate(sizes):
        for first in range(0, max(0, size - length + 1), PIECE):
            count = int(min(PIECE, size - length + 1 - first))
            if held and total + count > PIECE:
                yield held
                held, total = [], 0
            held.append((row, first, count))
            total += count
    if held:
        yield held


def _parse_batches(length: int, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, whole = Fingerprints(0), Fingerprints(1)
        for batch in text_slices(batches):
            raw, offsets = text_buffers(batch.column("text"))
            for pieces in _pieces(np.diff(offsets), length):
                rows, firsts, counts = (np.array(x, np.int64) for x in zip(*pieces))
                begins = offsets[rows] + firsts
                sizes = counts + length - 1
                data = np.concatenate([raw[b : b + n] for b, n in zip(begins, sizes)])
                starts = np.cumsum(sizes) - sizes
                at, low, high = triggers(data, starts, counts, reach)
                core.read(data)
                whole.read(data)
                piece = np.searchsorted(starts, at, side="right") - 1
                inner = core.of(at, at + length - reach + 1)
                outer = whole.of(at - high, at - low + length)
                outer += (low * (reach + 1) + high).astype(_U) * _U(BASES[0])
                place = at - starts[piece] + firsts[piece]
                owner = pa.array(rows[piece])
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": batch.column("key").take(owner),
                        "more_key": batch.column("more_key").take(owner),
                        "core": inner.view(np.int64),
                        "phrase": outer.view(np.int64),
                        "place": place,
                        "low": low.astype(np.int16),
                        "high": high.astype(np.int16),
                    }
                )

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, as they only travel to meet their triggers or spans."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in text_slices(batches):
        names = [n for n in batch.schema.names if n != "text"]
        raw, offsets = text_buffers(batch.column("text"))
        packed = [squeeze.compress(raw[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [*map(batch.column, names), pa.array(packed, pa.binary())], [*names, "packed"]
        )


def _unpacked(batch: pa.RecordBatch) -> Iterator[bytes]:
    expand = zstandard.ZstdDecompressor()
    for packed in batch.column("packed"):
        yield expand.decompress(packed.as_py())


def _context_batches(length: int):
    """Cut the phrases asked for out of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(_unpacked(batch)):
                asked = batch.column("asked")[row].as_py()
                names = ("core", "phrase", "n", "low", "high")
                out = {name: [a[name] for a in asked] for name in names}
                out["context"] = [
                    text[a["place"] - a["high"] : a["place"] - a["low"] + length] for a in asked
                ]
                kinds = [pa.int64()] * 3 + [pa.int16()] * 2 + [pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out)
                )

    return run


def _contexts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with their contexts in a row and the place of each trigger."""
    sizes = np.array([len(c.as_py()) for c in batch.column("context")], np.int64)
    for a, b in slices(sizes):
        part = batch.slice(a, b - a)
        data = np.frombuffer(b"".join(part.column("context").to_pylist()), np.uint8)
        begins = np.cumsum(sizes[a:b]) - sizes[a:b]
        yield part, data, begins + part.column("high").to_numpy(zero_copy_only=False).astype(np.int64)


def _take(part: pa.RecordBatch, rows: np.ndarray, more: dict) -> pa.RecordBatch:
    keys = {name: part.column(name).take(pa.array(rows)) for name in ("core", "phrase", "n")}
    return pa.RecordBatch.from_pydict({**keys, **more})


def _block_batches(length: int, reach: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints(0), Fingerprints(1)
        for batch in batches:
            for part, data, at in _contexts(batch):
                for p in prints:
                    p.read(data)
                low, high = (
                    part.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("low", "high")
                )
                for number in range(-(-reach // block)):
                    least, most = number * block, number * block + block - 1
                    rows = np.flatnonzero((low <= most) & (high >= least))
                    inner = prints[0].of(at[rows] - least, at[rows] - most + length)
                    all_there = (low[rows] <= least) & (high[rows] >= most)
                    full = rows[all_there]
                    outer = np.zeros(len(rows), _U)
                    outer[all_there] = prints[1].of(at[full] - most, at[full] - least + length)
                    yield _take(
                        part,
                        rows,
                        {
                            "block": np.full(len(rows), number, np.int16),
                            "inner": (inner + _U(number)).view(np.int64),
                            "outer": pa.array(outer.view(np.int64), mask=~all_there),
                        },
                    )

    return run


def _start_batches(length: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints(0), Fingerprints(1)
        for batch in batches:
            for part, data, at in _contexts(batch):
                for p in prints:
                    p.read(data)
                low, high, number = (
                    part.column(n).to_numpy(zero_copy_only=False).astype(np.int64)
                    for n in ("low", "high", "block")
                )
                for step in range(block):
                    offset = number * block + step
                    rows = np.flatnonzero((low <= offset) & (high >= offset))
                    start = at[rows] - offset[rows]
                    first, second = (p.of(start, start + length) for p in prints)
                    yield _take(
                        part,
                        rows,
                        {
                            "offset": offset[rows].astype(np.int16),
                            "first": first.view(np.int64),
                            "second": second.view(np.int64),
                        },
                    )

    return run


KEYS = ["key", "more_key"]


def _keyed(docs: DataFrame, *keep: str) -> DataFrame:
    text = F.col("text").cast("string")
    more = F.xxhash64(F.lit("more"), text)
    return docs.select(*keep, F.xxhash64(text).alias("key"), more.alias("more_key"), text.alias("text"))


def _packed(docs: DataFrame, *keep: str) -> DataFrame:
    keyed = _keyed(docs, *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema if f.name != "text")
    return keyed.mapInArrow(_pack, f"{schema}, packed binary")


def repeated_offsets(
    docs: DataFrame, parse: DataFrame, length: int = LENGTH, reach: int = REACH, block: int = BLOCK
) -> DataFrame:
    """(core, phrase, low, high): which offsets of a dictionary entry start repeated strings."""
    entry = ["core", "phrase"]
    entries = materialize(
        parse.groupBy(*entry).agg(
            F.count(F.lit(1)).alias("n"),
            # All of one row, as an entry's rows are told apart by nothing else that matters.
            *[F.first(c).alias(c) for c in (*KEYS, "place", "low", "high")],
        ),
        "repeat-entries",
    )
    whole = entries.filter("n > 1").select(*entry, "low", "high")
    mixed = entries.groupBy("core").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("kinds"))
    open_ = entries.join(mixed.filter("least = 1 AND kinds > 1").select("core"), "core", "left_semi")
    asked = open_.groupBy(*KEYS).agg(
        F.collect_list(F.struct("core", "phrase", "n", "place", "low", "high")).alias("asked")
    )
    met = _packed(docs).dropDuplicates(KEYS).join(asked, KEYS).select("asked", "packed")
    contexts = materialize(
        met.mapInArrow(
            _context_batches(length), "core long, phrase long, n long, low short, high short, context binary"
        ),
        "repeat-contexts",
    )
    blocks = materialize(
        contexts.mapInArrow(
            _block_batches(length, reach, block),
            "core long, phrase long, n long, block short, inner long, outer long",
        ),
        "repeat-blocks",
    )
    classes = materialize(
        blocks.groupBy("inner", "outer").agg(F.sum("n").alias("total")), "repeat-classes"
    )
    repeated = classes.filter("outer IS NOT NULL AND total > 1").select("inner", "outer")
    by_block = blocks.join(repeated, ["inner", "outer"], "left_semi").select(
        *entry,
        (F.col("block") * block).cast("short").alias("low"),
        (F.col("block") * block + block - 1).cast("short").alias("high"),
    )
    undecided = (
        classes.groupBy("inner")
        .agg(F.sum("total").alias("total"), F.max(F.col("outer").isNull() | (F.col("total") == 1)).alias("open"))
        .filter("total > 1 AND open")
        .select("inner")
    )
    last = blocks.join(undecided, "inner", "left_semi").select(*entry, "block")
    starts = materialize(
        contexts.join(last, entry).mapInArrow(
            _start_batches(length, block), "core long, phrase long, n long, offset short, first long, second long"
        ),
        "repeat-starts",
    )
    twice = starts.groupBy("first", "second").agg(F.sum("n").alias("total")).filter("total > 1")
    one_by_one = starts.join(twice.select("first", "second"), ["first", "second"], "left_semi").select(
        *entry, F.col("offset").alias("low"), F.col("offset").alias("high")
    )
    return whole.unionAll(by_block).unionAll(one_by_one)


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, reach: int = REACH, block: int = BLOCK
) -> DataFrame:
    """(key, more_key, spans) of the texts with repeated strings.

    A span is start * 2^32 + end in bytes; spans of a text may overlap.
    """
    parse = materialize(
        _keyed(docs).mapInArrow(
            _parse_batches(length, reach),
            "key long, more_key long, core long, phrase long, place long, low short, high short",
        ),
        "repeat-parse",
    )
    cores = materialize(
        parse.groupBy("core").count().filter(F.col("count") > 1).select("core"), "repeat-cores"
    )
    shared = materialize(parse.join(cores, "core", "left_semi"), "repeat-shared")
    offsets = repeated_offsets(docs, shared, length, reach, block)
    found = shared.select(*KEYS, "core", "phrase", "place").join(offsets, ["core", "phrase"])
    start, end = F.col("place") - F.col("high"), F.col("place") - F.col("low") + length
    return found.groupBy(*KEYS).agg(
        F.collect_set(F.shiftleft(start, 32).bitwiseOR(end)).alias("spans")
    )


def merged(spans: list[int] | None) -> list[tuple[int, int]]:
    """Maximal removed runs; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for span in sorted(spans or []):
        start, end = span >> 32, span & 0xFFFFFFFF
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _removal_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, all_runs, all_kept = [], [], []
        for row, text in enumerate(_unpacked(batch)):
            runs = merged(batch.column("spans")[row].as_py())
            kept, done = [], 0
            for start, end in runs:
                kept.append(text[done:start])
                done = end
            kept.append(text[done:])
            sizes.append(len(text))
            all_runs.append([{"start": s, "end": e} for s, e in runs])
            all_kept.append(b"".join(kept))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.array(all_runs, _RUNS),
                pa.array(all_kept, pa.binary()),
            ],
            names=["doc_id", "n_bytes", "runs", "kept"],
        )


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, reach: int = REACH, block: int = BLOCK
) -> DataFrame:
    """(doc_id, n_bytes, runs, kept): removed runs and remaining bytes of every document."""
    tune(docs.sparkSession)
    spans = materialize(repeated_spans(docs, length, reach, block), "repeat-spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    met = _packed(docs, "doc_id").join(spans, KEYS, "left").select("doc_id", "packed", "spans")
    return met.mapInArrow(
        _removal_batches,
        f"doc_id {kind}, n_bytes long, runs array<struct<start:long,end:long>>, kept binary",
    )


def op7_repeats(spark, sf_dir: str) -> DataFrame:
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("runs").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
