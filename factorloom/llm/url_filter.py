"""URL filters by a bit-parallel wildcard automaton.

Globs over canonical URLs (host with A-Z lower-cased, then path, as UTF-8) are packed into one
row of 64-bit words: a bit per state, where state j of a glob says that its first j characters
have been read. One byte of a URL moves every state of every glob at once,

    states = (states << 1) & step[byte] | states & stay[byte],

the shift carrying from word to word. ``stay`` holds states in front of a wildcard. The URLs of
a batch advance together, longest first, so that finished ones fall off the end.

In a glob ``*`` is any run of bytes without ``/``, ``**`` any run, ``?`` one byte except ``/``;
a backslash takes the next character as it is. A rule is a host and the start of a path, such as
``example.org/es/``: it fits its host and all subdomains. The longest fitting rule decides, at
equal length a blocking one before an allowing one, then the smaller text. Where no rule fits,
the first fitting glob decides, else the URL is allowed.

Defined results: a null URL and one without ``://`` have an empty host and path (so no rule that
has a host or path fits them); a path is empty where the URL has none; repeated rows are judged
row by row; empty tables give empty results; a URL of any length is read whole, at a cost in
proportion to its length. The rules and globs go to every task: 512 bytes for a character of a
rule, so a list of ten thousand rules takes some hundreds of MB and should be split by host.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import Shield, slices, table, text_buffers, tune

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the contract.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

# The method's own verdicts, first fit wins: advertising hosts, pages of an action.
GLOBS = (
    ("block", "*ads-track.*"),
    ("block", "*ads-track.*/**"),
    ("block", "*/**/login*"),
    ("block", "*/login*"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    place = F.instr(url, "://")
    return F.when(place > 0, F.substring(url, place + F.lit(3), F.length(url))).otherwise("")


def literal(text: str) -> str:
    """The glob that fits just this text."""
    return "".join("\\" + c if c in "*?\\" else c for c in text)


def rule_globs(rule: str) -> tuple[str, str]:
    """A rule's host and its subdomains, with any path that starts as the rule's."""
    return literal(rule) + "**", "*." + literal(rule) + "**"


class Automaton:
    """All globs in one row of words."""

    def __init__(self, globs: Sequence[str]):
        steps, stays, starts, ends, place = [], [], [], [], 0
        for glob in globs:
            starts.append(place)
            for kind, byte in _tokens(glob):
                if kind == "byte":
                    place += 1
                    steps.append((place, byte))
                else:
                    stays.append((place, kind == "any"))
            ends.append(place)
            place += 1
        self.words = max(1, -(-place // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        within = np.arange(256) != ord("/")
        for bit, byte in steps:
            word, mask = bit >> 6, np.uint64(1 << (bit & 63))
            self.step[within if byte is None else byte, word] |= mask
        for bit, every in stays:
            self.stay[slice(None) if every else within, bit >> 6] |= np.uint64(1 << (bit & 63))
        for bit in starts:
            self.start[bit >> 6] |= np.uint64(1 << (bit & 63))
        self.end_word = np.array([bit >> 6 for bit in ends], np.int64)
        self.end_bit = np.array([bit & 63 for bit in ends], np.uint64)

    def fits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text (row) whether each glob (column) fits it whole."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        starts, falling = offsets[:-1][order], lengths[order]
        states = np.repeat(self.start[None, :], len(order), axis=0)
        longest = int(falling[0]) if len(order) else 0
        alive = np.searchsorted(-falling, -np.arange(longest), side="left")
        for at, left in enumerate(alive):
            byte = raw[starts[:left] + at]
            now = states[:left]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            states[:left] = moved & self.step[byte] | now & self.stay[byte]
        found = np.empty((len(order), len(self.end_word)), bool)
        found[order] = states[:, self.end_word] >> self.end_bit & np.uint64(1)
        return found


def _tokens(glob: str) -> Iterator[tuple[str, int | None]]:
    place = 0
    while place < len(glob):
        char = glob[place]
        if glob.startswith("**", place):
            place += 1
            yield "any", None
        elif char == "*":
            yield "part", None
        elif char == "?":
            yield "byte", None
        else:
            if char == "\\" and place + 1 < len(glob):
                place += 1
                char = glob[place]
            for byte in char.encode():
                yield "byte", byte
        place += 1


def _first(found: np.ndarray) -> np.ndarray:
    """The first fitting column of each row, the column count where none fits."""
    none = np.ones((len(found), 1), bool)
    return np.argmax(np.concatenate([found, none], axis=1), axis=1)


def judge_urls(
    pages: DataFrame,
    keep: Sequence[str] = ("page_id",),
    rules: Sequence[tuple[str, str]] = RULES,
    globs: Sequence[tuple[str, str]] = GLOBS,
) -> DataFrame:
    """``keep`` columns, host, path, rule (null: none fits) and verdict of each row's ``url``.

    One pass, no shuffle; ``keep`` must not name the columns added.
    """
    tune(pages.sparkSession)
    ranked = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))
    automaton = Automaton([g for _, rule in ranked for g in rule_globs(rule)] + [g for _, g in globs])
    names = pa.array([rule for _, rule in ranked] + [None], pa.string())
    by_rule = np.array([verdict for verdict, _ in ranked] + [""], object)
    by_glob = np.array([verdict for verdict, _ in globs] + ["allow"], object)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column("_canonical")).to_numpy(zero_copy_only=False)
            for start, stop in slices(sizes):
                part = batch.slice(start, stop - start)
                found = automaton.fits(*text_buffers(part.column("_canonical")))
                fit = found[:, : 2 * len(ranked)].reshape(len(found), len(ranked), 2).any(axis=2)
                rule, glob = _first(fit), _first(found[:, 2 * len(ranked) :])
                verdict = np.where(rule < len(ranked), by_rule[rule], by_glob[glob])
                kept = [i for i, n in enumerate(part.schema.names) if n != "_canonical"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in kept), names.take(pa.array(rule)), pa.array(verdict, pa.string())],
                    names=[*(part.schema.names[i] for i in kept), "rule", "verdict"],
                )

    url = F.col("url").cast("string")
    wanted = pages.select(*keep, host_of(url).alias("host"), path_of(url).alias("path"))
    wanted = wanted.select(
        *[F.coalesce(c, F.lit("")).alias(c) if c in ("host", "path") else F.col(c) for c in wanted.columns],
        F.concat(F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))).alias("_canonical"),
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema if f.name != "_canonical")
    return wanted.mapInArrow(judge, f"{schema}, rule string, verdict string")


def drop_blocked(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    globs: Sequence[tuple[str, str]] = GLOBS,
) -> DataFrame:
    """The rows of ``pages`` whose URL is allowed, all columns as they are."""
    shield = Shield(pages, "url")
    judged = judge_urls(shield.docs, shield.inside, rules, globs)
    return shield.restore(judged.filter("verdict = 'allow'"))


def op11_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


OP11_SQL = r"""
WITH rests AS (
    SELECT row_number() OVER () AS row, page_id,
        CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), cut AS (
    SELECT row, page_id,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rests
), rules(verdict, rule, rule_host, rule_path) AS (
    VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
        ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'),
        ('block', 'com/de/', 'com', '/de/')
), fits AS (
    SELECT row, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
    FROM cut JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY row
)
SELECT page_id, host, path, rule,
    coalesce(verdict, CASE WHEN regexp_matches(host || path, '^[^/]*ads-track\.[^/]*(/(?s:.*))?$')
        OR regexp_matches(host || path, '^[^/]*/((?s:.*)/)?login[^/]*$') THEN 'block' ELSE 'allow' END) AS verdict
FROM cut LEFT JOIN fits USING (row)
"""
