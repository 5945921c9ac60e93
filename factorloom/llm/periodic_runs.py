"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of at least ``max(6, 4 * q)`` consecutive words whose smallest period is q and
that no neighbouring word extends. For each power of two L every factor of L words gets a name:
equal factors of a document have equal names, and the factors of 2L words are named by the pairs
of names L words apart. Factors that occur once stay out of the sort of the next length, since no
longer factor around them can repeat.

In a run of period q, with L the least power of two from q on, every factor of L words that starts
in the first 4q - L - 1 words has its next occurrence just q words on (the run's root is
primitive), and three such occurrences fit. So successors at equal distances q of at most 2L form
arithmetic progressions, and each stretch of them proposes one period. The names extend a proposal
to both sides by binary steps; equal (start, period) are one run.

All documents of a text slice (about 1 MB, a longer text alone) are named together, a word of one
document never equalling a word of another. A document of n words takes n log n time and memory,
less where little repeats. Documents are independent: there is no shuffle, and copies, hot sources
or lost executors need nothing special.

Defined results: a null or empty text has no words, no runs and an empty collapsed text; words are
compared byte by byte; repeated rows are treated row by row; empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import Shield, table, text_slices, tune

SHORTEST = 6  # words of a run at least
POWERS = 4  # periods of a run at least

RUN_TYPE = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _named(keys: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of all positions (negative: the only one) and distances to the next occurrence.

    ``places`` ascend and have ``keys``; all other positions have names of their own.
    """
    names = -np.arange(1, size + 1, dtype=np.int64)
    distance = np.zeros(size, np.int64)
    order = np.argsort(keys, kind="stable")
    ordered, at = keys[order], places[order]
    same = ordered[1:] == ordered[:-1]
    distance[at[:-1][same]] = (at[1:] - at[:-1])[same]
    group = np.concatenate([[0], np.cumsum(~same)])
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    names[at[shared]] = group[shared]
    return names, distance


def find_runs(words: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start, then period.

    ``words`` are non-negative ids; each document must end with an id that occurs nowhere else.
    """
    size = len(words)
    dictionary, proposed = [], []
    keys, places, length = document * (int(words.max(initial=0)) + 1) + words, np.arange(size), 1
    while len(places):
        names, distance = _named(keys, places, size)
        dictionary.append(names)
        proposed.append(_proposals(distance, length))
        shared = names >= 0
        places = np.flatnonzero(shared[:-length] & shared[length:]) if length < size else places[:0]
        keys = names[places] * (size + 1) + names[places + length]
        length *= 2
    start = np.concatenate([p[0] for p in proposed] or [np.zeros(0, np.int64)])
    period = np.concatenate([p[1] for p in proposed] or [np.zeros(0, np.int64)])
    begin, end = _extended(dictionary, start, period)
    found = np.unique(np.stack([begin, period, end - begin], axis=1), axis=0)
    found = found[found[:, 2] >= np.maximum(SHORTEST, POWERS * found[:, 1])]
    return found[:, 0], found[:, 2], found[:, 1]


def _proposals(distance: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a stretch of progressions of three occurrences begins, and their distance."""
    at = np.flatnonzero((distance > 0) & (distance <= 2 * length) & (2 * distance > length))
    step = distance[at]
    third = distance[at + step] == step
    at, step = at[third], step[third]
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1] + 1) | (step[1:] != step[:-1])
    return at[first], step[first]


def _extended(dictionary: list[np.ndarray], start: np.ndarray, period: np.ndarray):
    """The ends of the widest stretches around ``start`` that keep ``period``."""
    right, left = start.copy(), start.copy()
    for level in range(len(dictionary) - 1, -1, -1):
        names, width = dictionary[level], 1 << level
        moving = np.arange(len(start))
        while len(moving):
            a = right[moving]
            moving = moving[names[a] == names[a + period[moving]]]
            right[moving] += width
        moving = np.arange(len(start))
        while len(moving):
            a = left[moving] - width
            a = np.where(a >= 0, a, -1)
            equal = (a >= 0) & (names[a] == names[a + period[moving]])
            moving = moving[equal]
            left[moving] -= width
    return left, right + period


def _covered(size: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Words that some run contains after its first period."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) > 0


def _numbered(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the words of all documents, each document closed by an id of its own."""
    ids: dict[bytes, int] = {}
    number = ids.setdefault
    sizes = np.array([len(words) + 1 for words in lists], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    words = np.empty(bounds[-1], np.int64)
    inner = np.ones(bounds[-1], bool)
    inner[bounds[1:] - 1] = False
    words[inner] = np.fromiter((number(w, len(ids)) for w in chain.from_iterable(lists)), np.int64)
    words[~inner] = len(ids)  # the only such word of its document
    return words, np.repeat(np.arange(len(lists)), sizes), bounds


def _run_batches(prepare: Callable[[object, list[bytes]], list[bytes]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            lists = [t.as_buffer().to_pybytes().split() if t.is_valid else [] for t in batch.column("text")]
            if prepare:
                lists = [prepare(i.as_py(), w) for i, w in zip(batch.column(0), lists)]
            words, document, bounds = _numbered(lists)
            start, length, period = find_runs(words, document)
            dropped = _covered(len(words), start, length, period)
            cuts = np.searchsorted(start, bounds)
            runs, clean = [], []
            for row, own in enumerate(lists):
                low, high = cuts[row], cuts[row + 1]
                runs.append(
                    [
                        {"start": s, "length": n, "period": q}
                        for s, n, q in zip(
                            (start[low:high] - bounds[row]).tolist(), length[low:high].tolist(), period[low:high].tolist()
                        )
                    ]
                )
                if low < high:
                    gone = dropped[bounds[row] : bounds[row + 1] - 1]
                    own = [own[k] for k in np.flatnonzero(~gone)]
                clean.append(b" ".join(own))
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in names),
                    pa.array([len(w) for w in lists], pa.int64()),
                    pa.array(runs, _RUN),
                    pa.array(clean, pa.binary()).cast(pa.string()),
                ],
                names=[*names, "n_words", "runs", "collapsed"],
            )

    return run


def periodic_runs(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    prepare: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """``keep`` columns, n_words, runs and the collapsed text of each row; one pass, no shuffle.

    The collapsed text drops each word that a run contains after its first period. ``prepare``
    may change the words, given the first kept column. ``keep`` must not name columns added.
    """
    tune(docs.sparkSession)
    wanted = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema if f.name != "text")
    return wanted.mapInArrow(_run_batches(prepare), f"{schema}, n_words long, runs {RUN_TYPE}, collapsed string")


def collapse_runs(docs: DataFrame) -> DataFrame:
    """The documents with collapsed texts (null stays null) and their ``n_chars``."""
    shield = Shield(docs, "text", "n_chars")
    marked = shield.docs.withColumn("_null", F.col("text").isNull())
    found = periodic_runs(marked, [c for c in marked.columns if c != "text"])
    clean = found.withColumn("text", F.when(~F.col("_null"), F.col("collapsed")))
    if "n_chars" in shield.inside:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.select("n_chars").schema[0].dataType))
    return shield.restore(clean)


def planted_loop(doc_id, words: list[bytes]) -> list[bytes]:
    """The contract's change: every tenth document by crc32 of its id ends in a loop; a null id none."""
    if doc_id is None or not words:
        return words
    seed = zlib.crc32(str(doc_id).encode())
    if seed % 10:
        return words
    seed //= 10
    size = len(words)
    head = seed % size
    period = 1 + (size - head) // (3 + seed % 8)
    return words[:head] + (words[head : head + period] * (-(-(size - head) // period)))[: size - head]


def _line(run: Column) -> Column:
    return F.concat_ws(",", run["start"], run["length"], run["period"])


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), prepare=planted_loop)
    best = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), -r["start"], -r["period"], r.alias("run")))
    )["run"]
    lines = F.array_join(F.transform("runs", lambda r: F.concat(_line(r), F.lit("\n"))), "")
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.floor(F.expr("1000 * _best.length div _best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


OP12_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
        xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
            lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS h
    FROM documents
), seeds AS (
    SELECT row, doc_id, words, len(words)::BIGINT AS n, h, h // 10 AS g FROM docs
), loops AS (
    SELECT row, doc_id, words, n, doc_id IS NOT NULL AND h % 10 = 0 AND n > 0 AS looped,
        CASE WHEN n > 0 THEN g % n ELSE 0 END AS a,
        CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p
    FROM seeds
), changed AS (
    SELECT row, doc_id, n, CASE WHEN looped
        THEN list_transform(range(n), lambda i: words[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1])
        ELSE words END AS words
    FROM loops
), places AS (
    SELECT row, n, unnest(range(n)) AS i, unnest(words) AS word FROM changed
), pairs AS (
    SELECT x.row, x.i, y.i - x.i AS q FROM places x JOIN places y
    ON x.row = y.row AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4
), stretches AS (
    SELECT row, q, min(i) AS s, count(*) + q AS length
    FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS stretch FROM pairs)
    GROUP BY row, q, stretch HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
    SELECT * FROM stretches l WHERE NOT EXISTS (SELECT 1 FROM stretches o WHERE o.row = l.row AND o.q < l.q
        AND o.s <= l.s AND o.s + o.length >= l.s + l.length)
), summed AS (
    SELECT row, count(*)::BIGINT AS n_runs,
        min({'length': -length, 'start': s, 'period': q}) AS best,
        string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS lines
    FROM runs GROUP BY row
), dropped AS (
    SELECT DISTINCT row, unnest(range(s + q, s + length)) AS i FROM runs
), collapsed AS (
    SELECT row, string_agg(word, ' ' ORDER BY i) AS text FROM places ANTI JOIN dropped USING (row, i) GROUP BY row
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, (-best.length)::BIGINT AS length,
    best.period::BIGINT AS period, (1000 * -best.length // best.period)::BIGINT AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM changed LEFT JOIN summed USING (row) LEFT JOIN collapsed USING (row)
"""
