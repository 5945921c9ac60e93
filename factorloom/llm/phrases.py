"""Phrase collocations by Toivonen's sampling, all counts exact.

A phrase is a run of one to three words inside a piece of text. A phrase cannot be more frequent
than its parts, so a bounded sample proposes frequent words and pairs, and one full pass counts

* every word,
* every pair of two proposed words, and
* every triple of two proposed pairs,

that is the proposals and their negative border. A word or pair that turns out frequent without
having been proposed is a failure of the border: it joins the proposals, and a further pass
counts the pairs and triples that have such a part. Passes go on until none fails; a failure
is longer than what caused it, so there are at most three. The sample only decides how much is
counted early: the result does not depend on it.

Proposals go to the tasks as two bit maps of ``BITS`` bits (two bits a phrase), so what is
broadcast is bounded whatever the corpus. A wrong hit makes a pass count a phrase for nothing; its
count is exact all the same, and a phrase counted twice has the same count twice. Tasks sum their
counts by word numbers and give them out when they reach ``HELD`` distinct phrases, so a frequent
word or a large language is one row of each task before the shuffle.

Words are bytes between spaces and tabs, A-Z lower-cased; pieces end at ``.,;:!?`` and code points
10 to 13. Defined results: a null or empty text has no words; a null language is ``und``; equal
documents all count; ties of score and count go by the bytes of the phrase; empty tables give
empty results; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.ranking import with_position
from factorloom.functions.session import materialize
from factorloom.llm.common import table, text_slices, tune

LEAST = 10  # occurrences of a candidate
SHARE = 50  # per cent of a phrase's occurrences inside a longer one that drop it
TOP = 2000  # phrases of a language in the report
SCALE = 1_000_000

SAMPLE_BYTES = 16 << 20  # text of the sample, about
SAMPLE_LONGEST = 1 << 20  # bytes of a document in the sample at most
BITS = 1 << 26  # of each bit map; 8 MB
HELD = 1 << 19  # distinct phrases a task holds
VOCABULARY = 1 << 21  # distinct words a task holds: three word numbers fit in 63 bits
CHUNK = 1 << 18  # words counted at a time

_BUCKET = 1 << 15  # bits of one value of bitmap_construct_agg
_BREAK = b"\xff"  # a byte that UTF-8 text does not have
_LOWER = bytes(
    0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b
    for b in range(256)
)


class Numbers(dict):
    """Numbers of the words of one language, given out on first sight."""

    def __init__(self, prefix: bytes, words: list[bytes], hashes: list[int]):
        super().__init__({_BREAK: -1})
        self.prefix, self.words, self.hashes = prefix, words, hashes

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(self.prefix + word, 42))
        return number


class Proposals:
    """Bit maps of the words and pairs that were proposed before (old) and since (new)."""

    def __init__(self, bits: int):
        self.bits = bits
        self.old = {1: None, 2: None}
        self.new = {1: None, 2: None}

    def add(self, fresh: dict[int, np.ndarray | None]) -> Proposals:
        grown = Proposals(self.bits)
        for size in (1, 2):
            maps = [m for m in (self.old[size], self.new[size]) if m is not None]
            grown.old[size] = None if not maps else maps[0] if len(maps) == 1 else maps[0] | maps[1]
            grown.new[size] = fresh.get(size)
        return grown

    def _hit(self, marks: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
        if marks is None:
            return np.zeros(len(hashes), bool)
        found = np.ones(len(hashes), bool)
        for place in (hashes & np.uint64(self.bits - 1), hashes >> np.uint64(32) & np.uint64(self.bits - 1)):
            found &= (marks[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found

    def known_and_new(self, size: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = self._hit(self.new[size], hashes)
        return new | self._hit(self.old[size], hashes), new


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a ^ (b << np.uint64(1) | b >> np.uint64(63))


class Held:
    """Counts of one task, by word numbers: 21 bits a word, so that keys sort as integers."""

    def __init__(self):
        self.words: list[bytes] = []
        self.hashes: list[int] = []
        self.langs: list[str] = []
        self.numbers: dict[str, Numbers] = {}
        self.totals: dict[str, int] = {}
        self.singles = np.zeros(0, np.int64)
        self.sums = {2: [], 3: []}
        self.marks = np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool)

    def of(self, lang: str) -> Numbers:
        if lang not in self.numbers:
            self.numbers[lang] = Numbers(lang.encode() + b"\t", self.words, self.hashes)
        return self.numbers[lang]

    def add(self, size: int, keys: np.ndarray) -> None:
        if len(keys):
            self.sums[size].append(np.unique(keys, return_counts=True))

    def marked(self, proposals: Proposals) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each word, and whether it is proposed at all or newly so."""
        unseen = np.array(self.hashes[len(self.marks[0]) :], np.uint64)
        if len(unseen):
            more = unseen, *proposals.known_and_new(1, unseen)
            self.marks = tuple(np.concatenate(pair) for pair in zip(self.marks, more))
        return self.marks

    def squeeze(self) -> int:
        """Join the sums once they hold more than ``HELD`` rows; how many distinct remain."""
        left = 0
        for size, parts in self.sums.items():
            rows = sum(len(k) for k, _ in parts)
            if rows > HELD and len(parts) > 1:
                keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, place, np.concatenate([c for _, c in parts]))
                self.sums[size] = [(keys, sums)]
                rows = len(keys)
            left = max(left, rows)
        return left

    def rows(self, singles: bool) -> Iterator[pa.RecordBatch]:
        """(lang, size, phrase, n); size 0 is the number of words of a language."""
        words = pa.array(self.words, pa.binary()).cast(pa.string())
        langs = pa.array(self.langs, pa.string())
        if singles:
            total = list(self.totals.items())
            yield _rows([t[0] for t in total], 0, [""] * len(total), [t[1] for t in total])
            at = np.flatnonzero(self.singles)
            for some in np.array_split(at, max(1, len(at) >> 15)):
                place = pa.array(some)
                yield _rows(langs.take(place), 1, words.take(place), self.singles[some])
        for size, parts in self.sums.items():
            for keys, sums in parts:
                for start in range(0, len(keys), 1 << 15):
                    some = keys[start : start + (1 << 15)]
                    numbers = [some >> np.int64(21 * k) & np.int64(VOCABULARY - 1) for k in range(size - 1, -1, -1)]
                    phrase = pc.binary_join_element_wise(*(words.take(pa.array(n)) for n in numbers), " ")
                    yield _rows(langs.take(pa.array(numbers[0])), size, phrase, sums[start : start + (1 << 15)])


def _rows(langs, size: int, phrases, counts) -> pa.RecordBatch:
    columns = [pa.array(langs, pa.string()), pa.array(np.full(len(phrases), size, np.int32)),
               pa.array(phrases, pa.string()), pa.array(counts, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "size", "phrase", "n"])


def _tokens(texts: list[bytes]) -> list[bytes]:
    """The words of all texts, with a break between pieces and between texts."""
    return _BREAK.join(texts).translate(_LOWER).replace(_BREAK, b" " + _BREAK + b" ").split()


def _count_chunk(held: Held, ids: np.ndarray, starts: int, proposals: Proposals | None, singles: bool) -> None:
    """Count the phrases that start in the first ``starts`` places of ``ids`` (-1: a break)."""
    word = ids >= 0
    if singles:
        grown = np.bincount(ids[:starts][word[:starts]], minlength=len(held.words))
        grown[: len(held.singles)] += held.singles
        held.singles = grown
    pair = word[:-1] & word[1:]
    at = np.flatnonzero(pair)
    keys = ids[at] << 21 | ids[at + 1]
    if proposals is None:
        held.add(2, keys[at < starts])
        return
    hashes, known, new = held.marked(proposals)
    both = known[ids[at]] & known[ids[at + 1]]
    at, keys = at[both], keys[both]
    fresh = new[ids[at]] | new[ids[at + 1]]
    held.add(2, keys[fresh & (at < starts)])
    pairs, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    seen = pair_hash(hashes[ids[at[first]]], hashes[ids[at[first] + 1]])
    pair_known, pair_new = (f[inverse] for f in proposals.known_and_new(2, seen))
    state = np.zeros(len(ids), np.int8)
    state[at] = pair_known.astype(np.int8) + (pair_known & pair_new)
    triple = np.flatnonzero((state[:-1] > 0) & (state[1:] > 0) & ((state[:-1] > 1) | (state[1:] > 1)))
    triple = triple[triple < starts]
    held.add(3, ids[triple] << 42 | ids[triple + 1] << 21 | ids[triple + 2])


def _counts(proposals, singles: bool):
    """Tasks of one pass; ``proposals`` is a broadcast, None counts all words and pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, marks = Held(), proposals.value if proposals is not None else None
        for batch in text_slices(batches):
            groups: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                if text.is_valid:
                    groups.setdefault(lang, []).append(text.as_buffer().to_pybytes())
            for lang, texts in groups.items():
                tokens = _tokens(texts)
                for start in range(0, len(tokens), CHUNK):
                    chunk = tokens[start : start + CHUNK + 2]
                    if len(held.words) + len(chunk) > VOCABULARY or held.squeeze() > HELD:
                        yield from held.rows(singles)
                        held = Held()
                    ids = np.fromiter(map(held.of(lang).__getitem__, chunk), np.int64, len(chunk))
                    held.langs += [lang] * (len(held.words) - len(held.langs))
                    starts = min(CHUNK, len(chunk))
                    if singles:
                        held.totals[lang] = held.totals.get(lang, 0) + int((ids[:starts] >= 0).sum())
                    _count_chunk(held, ids, starts, marks, singles)
        yield from held.rows(singles)

    return run


def _pass(docs: DataFrame, proposals, singles: bool, least: int) -> DataFrame:
    """(lang, size, phrase, n) of one pass over all texts, frequent ones and totals only."""
    rows = docs.mapInArrow(_counts(proposals, singles), "lang string, size int, phrase string, n long")
    summed = rows.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return summed.filter((F.col("n") >= least) | (F.col("size") == 0))


def _word_hash(word: Column) -> Column:
    return F.xxhash64(F.concat(F.col("lang"), F.lit("\t"), word))


def _marks(phrases: DataFrame, size: int, bits: int) -> np.ndarray | None:
    """The bit map of all phrases of a size; at most ``bits`` / 8 bytes reach the driver."""
    words = F.split("phrase", " ")
    value = _word_hash(words[0])
    if size == 2:
        other = _word_hash(words[1])
        value = value.bitwiseXOR(F.shiftleft(other, 1).bitwiseOR(F.shiftrightunsigned(other, 63)))
    mask = F.lit(bits - 1)
    places = phrases.filter(F.col("size") == size).select(
        F.explode(F.array(value.bitwiseAND(mask), F.shiftrightunsigned(value, 32).bitwiseAND(mask))).alias("place")
    )
    parts = (
        places.groupBy(F.shiftright("place", 15).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(_BUCKET - 1))).alias("marks"))
        .collect()
    )
    if not parts:
        return None
    marks = np.zeros(bits // 8, np.uint8)
    for bucket, some in parts:
        start = bucket * (_BUCKET // 8)
        marks[start : start + _BUCKET // 8] = np.frombuffer(some, np.uint8)[: len(marks) - start]
    return marks


def _sample(docs: DataFrame, least: int, sample_bytes: int) -> DataFrame:
    """Words and pairs that a bounded sample of the documents proposes."""
    size = F.octet_length("text")
    total = docs.agg(F.sum(size)).first()[0] or 0
    share = min(1.0, sample_bytes / max(total, 1))
    # The threshold is lowered below the expected count, so that few frequent phrases are missed.
    lowered = least if share == 1 else max(2, int(least * share / 2))
    some = docs if share == 1 else docs.filter(size <= SAMPLE_LONGEST).sample(share, seed=7)
    return _pass(some, None, True, lowered).filter("size > 0")


def phrase_counts(
    docs: DataFrame, least: int = LEAST, sample_bytes: int = SAMPLE_BYTES, bits: int = BITS
) -> DataFrame:
    """(lang, size, phrase, n) of all phrases of 1 to 3 words with n >= ``least`` in a language.

    Rows of size 0 hold the number of all words of a language. Stored tables only; each pass
    reads ``docs`` (lang, text) once.
    """
    spark = tune(docs.sparkSession)
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")
    )
    fresh = proposed = materialize(_sample(texts, least, sample_bytes), "phrase-sample")
    proposals, found = Proposals(bits), None
    while True:
        marks = {n: _marks(fresh, n, bits) for n in (1, 2)}
        if found is not None and not any(m is not None for m in marks.values()):
            break
        proposals = proposals.add(marks)
        sent = spark.sparkContext.broadcast(proposals)
        counted = materialize(_pass(texts, sent, found is None, least), "phrase-pass")
        sent.unpersist()
        # Failures of the border: frequent words and pairs that nothing had proposed.
        failed = counted.filter("size IN (1, 2)").join(proposed, ["lang", "size", "phrase"], "left_anti")
        fresh = materialize(failed.select(*proposed.columns), "phrase-fresh")
        proposed = proposed.unionByName(fresh)
        found = counted if found is None else found.unionByName(counted)
    return found.groupBy("lang", "size", "phrase").agg(F.max("n").alias("n"))


def _joined(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(
    docs: DataFrame,
    *,
    least: int = LEAST,
    share: int = SHARE,
    top: int = TOP,
    sample_bytes: int = SAMPLE_BYTES,
    bits: int = BITS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two and three words.

    A cut of a phrase of a occurrences into parts of l and r scores floor(10^6 a a / (l r)), in
    decimals of 38 digits; its lowest cut counts, the first at a tie. Phrases inside a longer one
    that has at least ``share`` per cent of their occurrences are left out.
    """
    counts = materialize(phrase_counts(docs, least, sample_bytes, bits), "phrase-counts")
    words = F.split("phrase", " ")
    candidates = counts.filter("size >= 2").withColumnRenamed("n", "a")
    cuts = candidates.withColumn("k", F.explode(F.expr("sequence(1, size - 1)"))).select(
        "*",
        _joined(words, F.lit(1), F.col("k")).alias("left"),
        _joined(words, F.col("k") + 1, F.col("size") - F.col("k")).alias("right"),
    )
    parts = counts.filter("size > 0")
    wide = "decimal(38,0)"
    scored = (
        cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
        .join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
        .withColumn(
            "score",
            F.expr(f"CAST({SCALE} * CAST(a AS {wide}) * a AS {wide}) div CAST(CAST(l AS {wide}) * r AS {wide})"),
        )
        .groupBy("lang", "size", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    longer = (
        candidates.filter("size > 2")
        .withColumn("start", F.explode(F.array(F.lit(1), F.lit(2))))
        .groupBy("lang", _joined(words, F.col("start"), F.lit(2)).alias("phrase"))
        .agg(F.max("a").alias("longer"))
    )
    kept = (
        scored.join(longer, ["lang", "phrase"], "left")
        .filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    # Sorted over range partitions: a language may hold any share of the phrases.
    best = [F.desc("score"), F.desc("a"), "phrase"]
    totals = counts.filter("size = 0").select("lang", "n")
    return (
        with_position(kept, "rank", best, ["lang"])
        .filter(F.col("rank") <= top)
        .join(F.broadcast(totals), "lang")
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), worded AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), places AS (
    SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM worded
), grams AS (
    SELECT lang, size, array_to_string(words[i : i + size - 1], ' ') AS phrase, size AS length
    FROM places, (VALUES (1), (2), (3)) AS sizes(size) WHERE i + size - 1 <= len(words)
), totals AS (
    SELECT lang, sum(len(words))::BIGINT AS n FROM worded GROUP BY lang
), counts AS (
    SELECT lang, size, phrase, count(*)::BIGINT AS f FROM grams GROUP BY lang, size, phrase HAVING count(*) >= 10
), cuts AS (
    SELECT lang, size, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS head,
        array_to_string(string_split(phrase, ' ')[k + 1 : size], ' ') AS tail
    FROM counts, (VALUES (1), (2)) AS places(k) WHERE k < size
), scored AS (
    SELECT c.lang, c.size, c.phrase, c.a, p.f AS l, q.f AS r,
        (1000000::HUGEINT * c.a * c.a // (p.f::HUGEINT * q.f))::BIGINT AS score,
        row_number() OVER (PARTITION BY c.lang, c.phrase
            ORDER BY 1000000::HUGEINT * c.a * c.a // (p.f::HUGEINT * q.f), k) AS place
    FROM cuts c JOIN counts p ON c.lang = p.lang AND c.head = p.phrase
    JOIN counts q ON c.lang = q.lang AND c.tail = q.phrase
), longer AS (
    SELECT lang, array_to_string(string_split(phrase, ' ')[s : s + 1], ' ') AS phrase, max(f) AS f
    FROM counts, (VALUES (1), (2)) AS starts(s) WHERE size = 3 GROUP BY ALL
), ranked AS (
    SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
    FROM scored s LEFT JOIN longer o ON s.lang = o.lang AND s.phrase = o.phrase
    WHERE place = 1 AND (o.f IS NULL OR 100 * o.f < 50 * a)
)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
