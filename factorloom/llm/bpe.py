"""Byte-level BPE: higher-order functions fold ranked merges over the bytes of distinct words.

A text is split by the vocabulary's pattern into pieces ("words"), each encoded on its own. One
Spark expression encodes a word: its state is an array of the parts' starts with the ranks of
neighbours, the ranks are a literal map, and a fold merges, step by step, the leftmost neighbours
whose joined bytes have the least rank. The map is dealt into literal buckets by hash, since a lookup
in a Spark map is a scan.

The most frequent distinct words of a seeded sample of documents are folded once and sent to all
tasks, at most ``CACHED`` of them. That bound affects speed only: what is not among them is folded
by the task that meets it, once for all its documents up to ``held`` such words. Words of more than ``LONG_WORD`` bytes,
where the fold's cost grows with the square, are merged by a heap instead; the result is the same.
Decoding concatenates the binary pieces of the ids.

Null and empty texts have no tokens. Repeated rows have equal results.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions.session import materialize
from factorloom.llm.common import bucket, table, text_slices, tune

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
RANK_BUCKETS = 1 << 16
SAMPLE_ROWS = 32_768
CACHED = 1 << 19
HELD = 1 << 18
LONG_WORD = 128
START_BITS = 8  # of a start in a word of at most LONG_WORD bytes
NO_RANK = (1 << (31 - START_BITS)) - 1


# --- vocabulary ----------------------------------------------------------------------------


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


# --- one word as an expression ---------------------------------------------------------------


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it in a body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bucket_of(token: str) -> int:
    """Spark's pmod(xxhash64(token), RANK_BUCKETS)."""
    mixed = xxhash.xxh64_intdigest(token.encode(), 42)
    return (mixed - (1 << 64) if mixed >> 63 else mixed) % RANK_BUCKETS


def rank_table(ranks: dict[bytes, int]) -> Column:
    """The ranks as buckets of maps; a token is a string with one code point for each byte."""
    if max(ranks.values(), default=0) >= NO_RANK:
        raise ValueError(f"ranks must be less than {NO_RANK}")
    dealt: list[dict[str, int]] = [{} for _ in range(RANK_BUCKETS)]
    for token, rank in ranks.items():
        name = token.decode("latin-1")
        dealt[_bucket_of(name)][name] = rank
    # A constant, so the optimizer reads it once and leaves a literal.
    return F.from_json(F.lit(json.dumps(dealt)), "array<map<string,int>>")


def fold_words(words: Column, ranks: dict[bytes, int]) -> Column:
    """Token ids of each word of an array; an empty word has none. The table is there once."""
    return _let(rank_table(ranks), lambda ranked: F.transform(words, lambda w: _fold(w, ranked)))


def _fold(word: Column, table: Column) -> Column:
    """Token ids of one word, as an array of ints.

    The state is one array of ints, an entry for each part's start and one for the word's end: the
    rank of the part joined with the one before it, and in the last bits the start. So the least
    entry is the leftmost merge of least rank, and a part is a slice of the word. A merge drops an
    entry and renews the ranks beside it.
    """

    def rank(token: Column) -> Column:
        own = F.get(table, F.pmod(F.xxhash64(token), F.lit(RANK_BUCKETS)).cast("int"))
        return F.coalesce(F.element_at(own, token), F.lit(NO_RANK))

    def entry(rank: Column, start: Column) -> Column:
        return F.shiftleft(rank, START_BITS).bitwiseOR(start)

    def start(own: Column) -> Column:
        return own.bitwiseAND((1 << START_BITS) - 1)

    def token(latin: Column, first: Column, end: Column) -> Column:
        return F.substring(latin, start(first) + 1, start(end) - start(first))

    def merge(latin: Column, state: Column, at: Column) -> Column:
        def near(steps: int) -> Column:
            return F.get(state, at + steps)

        # Beyond either end of the word an entry is null, and so is the token: it has no rank.
        left = entry(rank(token(latin, near(-2), near(1))), start(near(-1)))
        right = entry(rank(token(latin, near(-1), near(2))), start(near(1)))
        return F.concat(
            F.slice(state, 1, at - 1), F.array(left, right), F.slice(state, at + 3, F.lit(LONG_WORD + 1))
        )

    def fold(latin: Column, size: Column) -> Column:
        def step(state: Column, _: Column) -> Column:
            return _let(
                F.array_min(state),
                lambda low: F.when(low >= NO_RANK << START_BITS, state).otherwise(
                    _let((F.array_position(state, low) - 1).cast("int"), lambda at: merge(latin, state, at))
                ),
            )

        inner, none = F.sequence(F.lit(1), size - 1), F.lit(NO_RANK)
        pairs = F.transform(inner, lambda i: entry(rank(F.substring(latin, i, F.lit(2))), i))
        return F.aggregate(
            inner,
            F.concat(F.array(entry(none, F.lit(0))), pairs, F.array(entry(none, size))),
            step,
            lambda state: F.zip_with(
                F.slice(state, 1, F.size(state) - 1),
                F.slice(state, 2, F.size(state)),
                lambda first, end: rank(token(latin, first, end)),
            ),
        )

    def whole(latin: Column) -> Column:
        return _let(
            rank(latin),
            lambda own: F.when((own != NO_RANK) | (F.length(latin) == 1), F.array(own)).otherwise(
                fold(latin, F.length(latin))
            ),
        )

    none = F.array().cast("array<int>")
    return F.when(word == "", none).otherwise(
        _let(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), whole)
    )


# --- splitting -------------------------------------------------------------------------------

# Texts below this code point are split by the standard library, with classes spelt out.
_NEAR = 0x250


def _ranges(kind: str) -> str:
    return "".join(
        f"\\u{c:04x}" for c in range(_NEAR) if unicodedata.category(chr(c)).startswith(kind)
    )


def near_pattern(pattern: str) -> str:
    """The pattern with its Unicode classes spelt out for code points below _NEAR."""
    letters, numbers, space = _ranges("L"), _ranges("N"), r"\t-\r \u0085 "
    negated = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]")
    classed = negated.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    return classed.replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")


class Splitter:
    """Pieces of a text, as the pattern gives them."""

    def __init__(self, pattern: str):
        self.near = re.compile(near_pattern(pattern))
        self.far = regex.compile(pattern)
        self.beyond = re.compile(f"[^\\u0000-\\u{_NEAR - 1:04x}]")

    def __call__(self, text: str) -> list[str]:
        return (self.far if self.beyond.search(text) else self.near).findall(text)


# --- long words ------------------------------------------------------------------------------


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by a heap of neighbours: the least rank, leftmost first."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(start: int) -> None:
        middle = ends[start]
        if middle < n:
            rank = ranks.get(word[start : ends[middle]])
            if rank is not None:
                heapq.heappush(heap, (rank, start, ends[middle]))

    for start in range(n):
        offer(start)
    while heap:
        _, start, end = heapq.heappop(heap)
        if not alive[start] or ends[start] >= n or ends[ends[start]] != end:
            continue
        alive[ends[start]] = False
        ends[start] = end
        if end < n:
            before[end] = start
        offer(start)
        if before[start] >= 0:
            offer(before[start])
    return [ranks[word[s : ends[s]]] for s in range(n) if alive[s]]


# --- documents -------------------------------------------------------------------------------


def _count_batches(splitter_of: Callable[[], Splitter]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter_of()
        for batch in text_slices(batches):
            counts: Counter[str] = Counter()
            for text in batch.column("text").to_pylist():
                counts.update(split(text or ""))
            words = [w for w in counts if len(w.encode()) <= LONG_WORD]
            yield pa.RecordBatch.from_pydict(
                {"word": pa.array(words, pa.string()), "n": pa.array([counts[w] for w in words], pa.int64())}
            )

    return run


class Cache:
    """Ids of frequent words, in one array: word k has ids[starts[k] : starts[k + 1]]."""

    def __init__(self, words: pa.ChunkedArray, ids: pa.ChunkedArray):
        self.words = words.to_pylist()
        self.ids = ids.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        sizes = pc.list_value_length(ids).to_numpy().astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


class _Places(dict):
    """Places of known words; a new word gets the next place, until ``forget``."""

    def __init__(self, words: list[str]):
        super().__init__((w, i) for i, w in enumerate(words))
        self.known = len(words)
        self.new: list[str] = []
        self.told = 0

    def __missing__(self, word: str) -> int:
        place = self[word] = self.known + len(self.new)
        self.new.append(word)
        return place

    def untold(self) -> list[str]:
        """The words met since this was last asked."""
        words, self.told = self.new[self.told :], len(self.new)
        return words

    def forget(self) -> None:
        for word in self.new:
            del self[word]
        self.new, self.told = [], 0


def _split_batches(splitter_of: Callable[[], Splitter], words: list[str], held: int):
    """Replace texts by the places of their pieces and the words that are new to the task.

    Places go on through the rows of a task, in their order; ``_round`` counts how often the
    task has forgotten its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, places, rounds = splitter_of(), _Places(words), 0
        for batch in text_slices(batches):
            names = [n for n in batch.schema.names if n != "text"]
            codes, fresh, long_words, own_rounds = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = np.fromiter(map(places.__getitem__, split(text or "")), np.int32)
                new = places.untold()
                codes.append(found.tobytes())
                own_rounds.append(rounds)
                if len(places.new) > held:
                    places.forget()
                    rounds += 1
                # A long word is an empty word to the fold; its text goes beside.
                is_long = [len(w) * 4 > LONG_WORD and len(w.encode()) > LONG_WORD for w in new]
                fresh.append(["" if far else w for w, far in zip(new, is_long)])
                long_words.append([w for w, far in zip(new, is_long) if far])
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    *map(batch.column, names),
                    pa.array(codes, pa.binary()),
                    pa.array(fresh, strings),
                    pa.array(long_words, strings),
                    pa.array(own_rounds, pa.int32()),
                ],
                names=[*names, "_codes", "_words", "_long", "_round"],
            )

    return run


def _with_long_words(batch: pa.RecordBatch, ranks: dict[bytes, int]) -> pa.Array:
    """The folded ids, with those of long words (empty to the fold) put in."""
    folded, far = batch.column("_ids"), batch.column("_long")
    if not pc.sum(pc.list_value_length(far)).as_py():
        return folded
    filled = []
    for own, words in zip(folded.to_pylist(), map(iter, far.to_pylist())):
        filled.append([ids or heap_merge(next(words).encode(), ranks) for ids in own])
    return pa.array(filled, pa.list_(pa.list_(pa.int32())))


def _token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def _joined(ids: pa.Array, tokens: list[bytes]) -> pa.Array:
    """The binary pieces of each array of ids, concatenated."""
    texts = (
        b"".join(map(tokens.__getitem__, np.frombuffer(own, "<u4").tolist())) for own in ids.to_pylist()
    )
    return pa.array(texts, pa.binary())


def _assemble_batches(
    cache_ids: np.ndarray, cache_starts: np.ndarray, ranks: dict[bytes, int], decode: bool
):
    """Replace places by ids: of cached words, or of words that the task has met so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _token_bytes(ranks) if decode else []
        known, cache_sizes = len(cache_starts) - 1, np.append(np.diff(cache_starts), 0)
        held_ids, held_sizes, held_round = np.zeros(0, np.int32), np.zeros(0, np.int64), 0
        for batch in _by_round(batches):
            if held_round != (held_round := batch.column("_round")[0].as_py()):
                held_ids, held_sizes = held_ids[:0], held_sizes[:0]
            names = [n for n in batch.schema.names if not n.startswith("_")]
            sizes = pc.binary_length(batch.column("_codes")).to_numpy() // 4
            places = np.frombuffer(b"".join(batch.column("_codes").to_pylist()), np.int32)
            inner = _with_long_words(batch, ranks).flatten()
            held_ids = np.concatenate([held_ids, inner.flatten().to_numpy(zero_copy_only=False).astype(np.int32)])
            own_sizes = pc.list_value_length(inner).to_numpy(zero_copy_only=False).astype(np.int64)
            held_sizes = np.concatenate([held_sizes, own_sizes])
            new_sizes = np.append(held_sizes, 0)
            new_starts = np.cumsum(new_sizes) - new_sizes + len(cache_ids)
            cached = places < known
            own = np.where(cached, places, 0)
            new = np.where(cached, len(held_sizes), places - known)
            length = np.where(cached, cache_sizes[own], new_sizes[new])
            start = np.where(cached, cache_starts[own], new_starts[new])
            ends = np.cumsum(length)
            at = np.repeat(start - ends + length, length) + np.arange(int(length.sum()))
            ids = np.concatenate([cache_ids, held_ids])[at].astype("<u4")
            cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])] * 4
            buffers = [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(ids.tobytes())]
            packed = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, buffers).cast(pa.binary())
            more = {"ids": packed, **({"decoded": _joined(packed, tokens)} if decode else {})}
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, names), *more.values()], names=[*names, *more]
            )

    return run


def _by_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut where ``_round`` changes."""
    for batch in batches:
        rounds = batch.column("_round").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(rounds)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            if stop > start:
                yield batch.slice(start, stop - start)


def frequent_words(
    docs: DataFrame, splitter_of: Callable[[], Splitter], ranks: dict[bytes, int], cached: int = CACHED
) -> Cache:
    """The most frequent distinct words of a sample of documents and their folded ids."""
    # By rows, not by texts: copies of one text must not come in together.
    sample = docs.select("text").filter(F.rand(17) < SAMPLE_ROWS / max(docs.count(), 1))
    counts = materialize(
        sample.mapInArrow(_count_batches(splitter_of), "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n")),
        "word-counts",
    )
    # All words from a least count on, from a table of word counts; of the words one below, the
    # share that still fits, by hash.
    step = F.least(F.col("n"), F.lit(1000))
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()
    least, held, share = 1001, 0, 0.0
    for count, words in sorted(((r["step"], r["words"]) for r in sizes), reverse=True):
        if held + words > cached:
            share = (cached - held) / words
            break
        least, held = count, held + words
    fits = bucket(F.col("word"), "cached", 1 << 20) < int(share * (1 << 20))
    below = (F.col("n") < least) & (F.col("n") >= least - 1) & fits
    kept = counts.filter((F.col("n") >= least) | below).select(
        "word", F.get(fold_words(F.array("word"), ranks), F.lit(0)).alias("ids")
    )
    found = kept.toArrow()
    return Cache(found["word"], found["ids"])


def encode_texts(
    docs: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    path: str | None = None,
    pattern: str | None = None,
    decode: bool = False,
    held: int = HELD,
    cached: int = CACHED,
) -> DataFrame:
    """``keep`` columns and ``ids``: token ids of each whole text, little-endian 32-bit.

    With ``decode`` also ``decoded``, the bytes of the ids: the same as ``decode_ids`` gives,
    without further Python workers beside those that put the ids in place. ``held`` bounds the
    words that a task remembers, ``cached`` those that it gets ready, at some 200 bytes each; they
    change no result.
    """
    tune(docs.sparkSession)
    path, pattern = path or vocabulary_path(), pattern or split_pattern()
    ranks = read_ranks(path)

    def splitter_of() -> Splitter:
        return Splitter(pattern)

    wanted = docs.select(*keep, F.col("text").cast("string").alias("text"))
    cache = frequent_words(wanted, splitter_of, ranks, cached)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema if f.name != "text")
    split = wanted.mapInArrow(
        _split_batches(splitter_of, cache.words, held),
        f"{schema}, _codes binary, _words array<string>, _long array<string>, _round int",
    )
    folded = fold_words(F.col("_words"), ranks)
    return split.select(*keep, "_codes", "_long", "_round", folded.alias("_ids")).mapInArrow(
        _assemble_batches(cache.ids, cache.starts, ranks, decode),
        f"{schema}, ids binary" + ", decoded binary" * decode,
    )


def _decode_batches(tokens: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n != "ids"]
            ids = batch.column("ids")
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, names), ids, _joined(ids, tokens)], names=[*names, "ids", "decoded"]
            )

    return run


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Add ``decoded``: the bytes of the ids, piece by piece."""
    tokens = _token_bytes(read_ranks(path or vocabulary_path()))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "ids")
    return encoded.select(*[c for c in encoded.columns if c != "ids"], "ids").mapInArrow(
        _decode_batches(tokens), f"{schema}, ids binary, decoded binary"
    )


def token_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    coded = encode_texts(docs, decode=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))
