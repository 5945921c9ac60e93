"""URL rules, periodic runs and collocations against brute force and SQL."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_data import DOCUMENTS, letters, messy_documents
from pyspark.sql import functions as F

from factorloom.llm import periodic_runs, phrases, url_filter
from factorloom.llm.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")


def by_value(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def sql_rows(name, folder):
    connection = duckdb.connect()
    for table in os.listdir(folder):
        table = table.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    result = connection.execute(ORACLES[name])
    return [c[0] for c in result.description], result.fetchall()


# --- URL filters -----------------------------------------------------------------------------


def plain_glob(glob):
    parts = re.findall(r"\\.|\*\*|\*|\?|[^\\]|\\", glob, re.S)
    known = {"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}
    return "".join(known.get(p) or re.escape(p[1] if len(p) == 2 and p[0] == "\\" else p) for p in parts)


def test_automaton_against_regular_expressions():
    draw = np.random.default_rng(3)
    globs = ["".join(draw.choice(list("ab/*?.\\"), draw.integers(0, 14))) for _ in range(150)]
    texts = ["".join(draw.choice(list("ab/."), draw.integers(0, 12))) for _ in range(400)] + ["", "*", "?", "\\a"]
    raw = [t.encode() for t in texts]
    automaton = url_filter.Automaton(globs)
    assert automaton.words > 8
    found = automaton.fits(
        np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    )
    for column, glob in enumerate(globs):
        pattern = re.compile(plain_glob(glob))
        assert found[:, column].tolist() == [bool(pattern.fullmatch(t)) for t in texts], glob


URLS = [
    "http://a.example.org/es/1", "http://example.org/es/", "HTTP://EXAMPLE.org/en/12?x=/es/", "https://example.org/en/2",
    "https://myexample.org/es/", "ftp://x.com/fr/page#frag", "http://com/de/", "http://a.com/de", "http://a.com/DE/",
    "http://org", "http://org/", "http://org?/", "://org/a", "no scheme org/", "", None, "http://", "http:///es/",
    "http://evil.net/x.org/", "http://user@b.org:80/x", "http://Übung.ORG/ä", "http://a.net/b/login.html", "http://a.net/login",
    "http://a.net/login/x", "http://www.ads-track.example.net", "http://ads-track.net/de/", "http://a\nb.org/c\nd?e",
    "http://a.net/" + "ab/" * 20000 + "login", "http://x.org/a://b.com/de/", "http://İ.org/",
]


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in url_filter.RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            if best is None or len(rule) > len(best[0]):
                best = rule, verdict
    if best is None:
        found = [v for v, g in url_filter.GLOBS if re.fullmatch(plain_glob(g), host + path)]
        best = None, (found or ["allow"])[0]
    return host, path, *best


def test_op11(spark, write, no_documents):
    rows = [(i, u, "html") for i, u in enumerate(URLS)] + [(None, URLS[0], None), (0, URLS[0], None)]
    folder = write(pages=(rows, "page_id long, url string, html string"))
    found = QUERIES["op11_url_filter"](spark, folder)
    expected = [(i, *plain_verdict(u)) for i, u, _ in rows]
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert by_value(found.collect()) == by_value(expected)
    columns, sql = sql_rows("op11_url_filter", folder)
    assert columns == found.columns and by_value(sql) == by_value(expected)
    assert QUERIES["op11_url_filter"](spark, no_documents).count() == 0


def test_rule_ties_and_escapes(spark):
    rules = [("allow", "b.c/de"), ("block", "a.b.c/d"), ("allow", "x.c/*"), ("block", "x.c/?"), ("block", "x.c/")]
    urls = ["s://a.b.c/def", "s://x.c/*y", "s://x.c/?", "s://x.c/y", "s://b.c/de", "s://y.c/"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    found = {r["url"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, ["url"], rules, []).collect()}
    assert [found[u] for u in urls] == [
        ("a.b.c/d", "block"), ("x.c/*", "allow"), ("x.c/", "block"), ("x.c/", "block"), ("b.c/de", "allow"), (None, "allow")
    ]
    tied = url_filter.judge_urls(pages, ["url"], [("allow", "b.c/d"), ("block", "b.c/de"), ("block", "c/def")], [])
    assert {r["rule"] for r in tied.filter("url = 's://a.b.c/def'").collect()} == {"b.c/de"}


def test_blocked_rows_go_and_columns_stay(spark):
    rows = [(1, "http://a.org/es/", "h", "v", "p"), (2, "http://example.org/es/", None, "v", "p"), (3, None, "h", "v", "p")]
    pages = spark.createDataFrame(rows, ["page_id", "url", "host", "verdict", "path"])
    kept = url_filter.drop_blocked(pages)
    assert kept.columns == pages.columns and by_value(kept.collect()) == by_value([rows[0], rows[2]])


# --- periodic runs ---------------------------------------------------------------------------


def plain_runs(words):
    """All runs by trying every period at every start."""
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                start, length = i, j + q - i
                part = words[start : start + length]
                smaller = any(
                    all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q)
                )
                if length >= max(6, 4 * q) and not smaller:
                    found.append((start, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    exponent = 1000 * best[1] // best[2] if runs else None
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
    return (doc_id, len(runs), *best, exponent, *digest)


@pytest.mark.parametrize("letters_used, size", [(1, 40), (2, 60), (2, 200), (3, 120), (6, 300)])
def test_runs_against_every_period(letters_used, size):
    draw = np.random.default_rng(size)
    texts = []
    for _ in range(40):
        words = draw.integers(0, letters_used, draw.integers(0, size)).tolist()
        for _ in range(draw.integers(0, 4)):
            at, period = draw.integers(0, len(words) + 1), draw.integers(1, 9)
            words[at:at] = (draw.integers(0, letters_used, period).tolist() * 9)[: draw.integers(3, 9 * period + 1)]
        texts.append([b"w%d" % w for w in words])
    words, document, bounds = periodic_runs._numbered(texts)
    start, length, period = periodic_runs.find_runs(words, document)
    row = np.searchsorted(bounds, start, side="right") - 1
    found = defaultdict(list)
    for r, s, n, q in zip(row, start, length, period):
        found[r].append((s - bounds[r], n, q))
    total = 0
    for r, own in enumerate(texts):
        expected = plain_runs(own)
        total += len(expected)
        assert found[r] == expected
    assert total > 20


def loops():
    """Documents of which many end in the contract's loop, and some with runs of their own."""
    own = [" ".join(["a b c"] * 5 + ["a b"] + ["x"] * 9), "x " * 6, "x " * 5, "a b " * 4 + "a", "a b a c " * 4 + "a b a c a c a c a c"]
    rows = [(i, t, "en", "s", None, *["x"] * 9) for i, t in enumerate(own)]
    looped = [i for i in range(50, 700) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows += [(i, letters(i, 20 + i % 90), "en", "s", None, *["x"] * 9) for i in looped[:25]]
    rows += [(looped[30], None, "en", "s", None, *["x"] * 9), (looped[31], " \n", "en", "s", None, *["x"] * 9)]
    rows += [(looped[32], letters(5, 3000), "en", "s", None, *["x"] * 9)] * 2
    return rows


def test_op12(spark, write, messy, no_documents):
    rows = loops() + [r for r in messy_documents() if not r[1] or len(r[1]) < 20000]
    folder = write(documents=(rows, DOCUMENTS))
    found = QUERIES["op12_periodic_runs"](spark, folder)
    expected = [plain_row(r[0], r[1]) for r in rows]
    assert by_value(found.collect()) == by_value(expected)
    assert sum(e[1] > 0 for e in expected) > 20
    for place in (folder, messy):
        columns, sql = sql_rows("op12_periodic_runs", place)
        assert columns == found.columns
        assert by_value(sql) == by_value(QUERIES["op12_periodic_runs"](spark, place).collect())
    assert QUERIES["op12_periodic_runs"](spark, no_documents).count() == 0


def test_collapsed_documents_keep_their_columns(spark):
    rows = [(1, "a b " * 6 + "c", "r", 25, "x"), (2, None, "r", None, "x"), (3, "no run here", None, 11, "x"), (None, "", "", 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_chars int, collapsed string")
    kept = periodic_runs.collapse_runs(docs)
    assert kept.columns == docs.columns
    assert by_value(kept.collect()) == by_value([(1, "a b c", "r", 5, "x"), *rows[1:]])


def test_one_document_of_one_word_repeated(spark):
    docs = spark.createDataFrame([(1, "x " * 300_000)], "doc_id long, text string")
    row = periodic_runs.periodic_runs(docs).first()
    assert row["runs"] == [(0, 300_000, 1)] and row["collapsed"] == "x" and row["n_words"] == 300_000


# --- collocations ----------------------------------------------------------------------------


def plain_collocations(rows, least, share, top):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            if any(
                len(o) > len(p) and 100 * b >= share * a and any(o[i : i + len(p)] == p for i in range(len(o)))
                for o, b in candidates.items()
                if set(p) <= set(o)
            ):
                continue
            score, _, left, right = min(
                (10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                for k in range(1, len(p))
            )
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def chatter(seed, count):
    draw = np.random.default_rng(seed)
    vocabulary = np.array(["the", "The", "of", "tea", "über", "мир", "x\x1cy", "a\x00b", "cat", "dog", "run", "zz", "q"])
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    rows = []
    for _ in range(count):
        words = draw.choice(vocabulary, draw.integers(0, 40), p=weights / weights.sum())
        marks = draw.choice([" ", "  ", "\t", ", ", ".", "\n", "\x0b", "! "], len(words), p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.04, 0.03, 0.03])
        rows.append((str(draw.choice(["en", "de", "fr"], p=[0.6, 0.3, 0.1])), "".join(w + m for w, m in zip(words, marks))))
    return rows + [(None, "tea cup. " * 12), ("und", "tea cup tea cup; " * 3), ("en", None), ("en", ""), (None, None)]


@pytest.mark.parametrize("sample_bytes, bits", [(1 << 30, 1 << 20), (400, 1 << 20), (2000, 1 << 15), (0, 1 << 16)])
def test_collocations_whatever_the_sample(spark, monkeypatch, sample_bytes, bits):
    monkeypatch.setattr(phrases, "HELD", 50)
    rows = chatter(1, 150)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    found = phrases.collocations(docs, least=5, top=60, sample_bytes=sample_bytes, bits=bits)
    expected = plain_collocations(rows, 5, 50, 60)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert by_value(found.collect()) == by_value(expected) and len(expected) > 100


def test_failures_of_the_border_take_further_passes(spark, monkeypatch):
    """Without a sample words fail first, then their pairs, then triples close the search."""
    passes, real = [], phrases._pass

    def watched(docs, proposals, singles, least):
        passes.append(proposals is not None)
        return real(docs, proposals, singles, least)

    monkeypatch.setattr(phrases, "_pass", watched)
    docs = spark.createDataFrame(chatter(2, 60), "lang string, text string")
    phrases.phrase_counts(docs, 5, sample_bytes=0).count()
    assert passes == [False, True, True, True]
    passes.clear()
    phrases.phrase_counts(docs, 5).count()
    assert passes == [False, True]


def test_phrases_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 7)
    monkeypatch.setattr(phrases, "VOCABULARY", 16)
    rows = chatter(4, 40)
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    found = phrases.collocations(docs, least=4, top=50)
    assert by_value(found.collect()) == by_value(plain_collocations(rows, 4, 50, 50))


def test_op13(spark, write, messy, no_documents):
    rows = [(i, t, la, "s", None, *["x"] * 9) for i, (la, t) in enumerate(chatter(3, 200))]
    folder = write(documents=(rows, DOCUMENTS))
    for place, own in ((folder, rows), (messy, messy_documents())):
        found = by_value(QUERIES["op13_collocations"](spark, place).collect())
        assert found == by_value(plain_collocations([(r[2], r[1]) for r in own], 10, 50, 2000))
        assert found == by_value(sql_rows("op13_collocations", place)[1])
    assert QUERIES["op13_collocations"](spark, no_documents).count() == 0


def test_scores_past_64_bits(spark):
    big = 3_000_000_019
    counts = [("en", 0, "", 10**12), ("en", 1, "a", big), ("en", 1, "b", big + 2), ("en", 2, "a b", big - 5)]
    frame = spark.createDataFrame(counts, "lang string, size int, phrase string, n long")
    docs = spark.createDataFrame([("en", "a b")], "lang string, text string")
    real = phrases.phrase_counts
    try:
        phrases.phrase_counts = lambda *a: frame
        row = phrases.collocations(docs).first()
    finally:
        phrases.phrase_counts = real
    assert row["score"] == 10**6 * (big - 5) ** 2 // (big * (big + 2))


def test_word_hashes_agree_with_spark(spark):
    import xxhash

    words = ["tea", "über", "x" * 100, "a\x00b"]
    frame = spark.createDataFrame([("en", w) for w in words], "lang string, w string")
    got = [r[0] % (1 << 64) for r in frame.select(phrases._word_hash(F.col("w"))).collect()]
    assert got == [xxhash.xxh64_intdigest(b"en\t" + w.encode(), 42) for w in words]
