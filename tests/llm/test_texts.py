"""Operators on single texts: media, tokens, personal data, pages."""

import base64
import hashlib
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from llm_data import messy_documents

from factorloom.llm import bpe, flac, html_text, pii
from factorloom.llm.queries import QUERIES

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")


SMALL = "/root/testdata/sf0.01"


def by_id(rows):
    return sorted(rows, key=repr)


# --- FLAC ------------------------------------------------------------------------------------


def random_payloads():
    draw = np.random.default_rng(5)
    return [
        b"a" * 192,
        bytes(draw.integers(0, 256, 1920, dtype=np.uint8)),
        bytes([0, 255]) * 960,
        bytes((128 + 100 * np.sin(np.arange(3840) / 20)).astype(np.uint8)),
        b"",
    ]


def test_flac_round_trip_in_both_ways():
    payloads = random_payloads()
    for payload, stream, (samples, offsets) in zip(
        payloads, flac.encode(payloads), flac.decode(flac.encode(payloads))
    ):
        assert (samples.astype(np.int8).view(np.uint8) ^ 0x80).tobytes() == payload
        slow, places = flac._decode_slowly(stream, flac.Stream(stream))
        assert (slow == samples).all() and places == offsets.tolist()


def test_flac_batch_does_not_change_streams():
    payloads = random_payloads()
    assert flac.encode(payloads) == [flac.encode([p])[0] for p in payloads]


@pytest.mark.parametrize("place", [4, 30, 45, 50, 60, 100, -1])
def test_flac_damage_is_found(place):
    stream = bytearray(flac.encode(random_payloads()[3:4])[0])
    stream[place] ^= 0x10
    with pytest.raises((ValueError, IndexError, KeyError)):
        flac.decode([bytes(stream)])


def test_flac_general_frames():
    """A stereo mid/side stream of 16 bits with verbatim, constant and escaped parts."""
    bits = []

    def put(value, width):
        bits.extend((value >> (width - 1 - i)) & 1 for i in range(width))

    left, right = [5, 7, -3, 100], [5, 9, -4, -100]
    mid = [(a + b) >> 1 for a, b in zip(left, right)]
    side = [a - b for a, b in zip(left, right)]
    for value, width in ((0x7FFC, 15), (0, 1), (6, 4), (0, 4), (10, 4), (4, 3), (0, 1), (0, 8), (3, 8)):
        put(value, width)
    head = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))
    put(flac._crc_of(head, flac.CRC8, 8), 8)
    put(1 << 1, 8)
    for value in mid:
        put(value & 0xFFFF, 16)
    put(8 << 1, 8)  # fixed order 0, one escaped partition of 9 raw bits
    put(0, 6)
    put(15, 4)
    put(9, 5)
    for value in side:
        put(value & 0x1FF, 9)
    bits += [0] * (-len(bits) % 8)
    frame = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))
    frame += flac._crc_of(frame, flac.CRC16, 16).to_bytes(2, "big")
    packed = (8000 << 44) | (1 << 41) | (15 << 36) | 4
    info = b"fLaC\x80\x00\x00\x22" + b"\x00\x10" * 2 + bytes(6) + packed.to_bytes(8, "big") + bytes(16)
    samples, offsets = flac.decode([info + frame])[0]
    assert samples.reshape(-1, 2).tolist() == [list(x) for x in zip(left, right)]
    assert offsets.tolist() == [42]


def test_op2(spark, messy, no_documents):
    expected = []
    for doc_id, text, *_ in messy_documents():
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        expected.append(
            (doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        )
    found = QUERIES["op2_flac_media"](spark, messy).collect()
    assert by_id(tuple(r)[:5] for r in found) == by_id(expected)
    features = {}
    for doc_id, text, *_ in messy_documents():
        raw = (text or "").encode()
        samples = [b - 128 for b in raw + b" " * (-len(raw) % 192 if raw else 192)]
        turns = sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:]))
        features[hashlib.sha256(bytes(v + 128 for v in samples)).hexdigest()] = (
            f"frames={len(samples) // 192};min={min(samples)};max={max(samples)};sum={sum(samples)};"
            f"energy={sum(v * v for v in samples)};turns={turns}",
            len(samples) // 192,
        )
    assert all((r["feature"], r["n_blocks"]) == features[r["payload_sha256"]] for r in found)
    assert len({r["media_sha256"] for r in found}) == len({r["payload_sha256"] for r in found})
    assert QUERIES["op2_flac_media"](spark, no_documents).count() == 0


def test_flac_blocks_can_be_sought(spark, messy):
    media = flac.encode_text_media(spark.read.parquet(f"{messy}/documents.parquet"))
    blocks = flac.pcm_blocks(media.filter("doc_id = 6")).orderBy("block").collect()
    pcm = b"".join(b["pcm"] for b in blocks)
    text = (np.frombuffer(pcm, "<i2") + 128).astype(np.uint8).tobytes()
    whole = next(t for i, t, *_ in messy_documents() if i == 6).encode()
    assert text[: len(whole)] == whole and text[len(whole) :].strip() == b""
    assert [b["first_sample"] for b in blocks] == [192 * k for k in range(len(blocks))]
    stream = bytes(media.filter("doc_id = 6").first()["media"])
    assert all(stream[b["byte_offset"] : b["byte_offset"] + 2] == b"\xff\xf8" for b in blocks)
    digest = flac.media_digests(spark.read.parquet(f"{messy}/documents.parquet").filter("doc_id = 6")).first()
    seeks = "".join(f"{b['first_sample']}:{b['byte_offset']}\n" for b in blocks)
    assert digest["seek_sha256"] == hashlib.sha256(seeks.encode()).hexdigest()


def test_media_of_any_id(spark):
    docs = spark.createDataFrame([("a", "x"), (None, None), ("a", "x")], "name string, text string")
    rows = flac.media_digests(docs, "name").collect()
    assert sorted(str(r["name"]) for r in rows) == ["None", "a", "a"]
    assert {r["payload_bytes"] for r in rows} == {192} and len({r["media_sha256"] for r in rows}) == 2


# --- tokens ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    ranks = {
        base64.b64decode(a): int(b)
        for a, b in map(bytes.split, open(public_tokenizers.path(bpe.VOCABULARY), "rb"))
    }
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op4(spark, messy, no_documents, library):
    expected = []
    for doc_id, text, *_ in messy_documents():
        ids = library.encode_ordinary(text or "")
        coded = np.array(ids, "<u4").tobytes()
        expected.append(
            (doc_id, len(ids), hashlib.sha256(coded).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        )
    assert by_id(map(tuple, QUERIES["op4_bpe"](spark, messy).collect())) == by_id(expected)
    assert QUERIES["op4_bpe"](spark, no_documents).count() == 0


def test_bpe_without_cached_words(spark, messy, library, monkeypatch):
    empty = pa.chunked_array([], pa.string()), pa.chunked_array([], pa.list_(pa.int32()))
    monkeypatch.setattr(bpe, "frequent_words", lambda *_: bpe.Cache(*empty))
    docs = spark.read.parquet(f"{messy}/documents.parquet")
    coded = bpe.encode_texts(docs)
    found = [(r["doc_id"], r["ids"]) for r in coded.collect()]
    texts = [(r["doc_id"], bytes(r["decoded"])) for r in bpe.decode_ids(coded).collect()]
    assert by_id(texts) == by_id((i, (t or "").encode()) for i, t, *_ in messy_documents())
    expected = [
        (i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes()) for i, t, *_ in messy_documents()
    ]
    assert by_id((i, bytes(ids)) for i, ids in found) == by_id(expected)


@pytest.mark.parametrize("held", [0, 5, 1 << 18])
def test_words_are_folded_once_by_a_task(spark, library, monkeypatch, held):
    """Later rows use the ids of words that earlier rows of the task brought, until it forgets them."""
    empty = pa.chunked_array([], pa.string()), pa.chunked_array([], pa.list_(pa.int32()))
    monkeypatch.setattr(bpe, "frequent_words", lambda *_: bpe.Cache(*empty))
    draw = random.Random(4)
    words = ["the", " the", "über", "abcdefghij", "x" * 200, "中文字", "q1w2", "tion", "supercalifragilistic", ""]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 9))) for _ in range(700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: (bytes(r["ids"]), bytes(r["decoded"])) for r in bpe.encode_texts(docs, decode=True, held=held).collect()}
    for i, text in enumerate(texts):
        assert found[i] == (np.array(library.encode_ordinary(text), "<u4").tobytes(), text.encode())


def test_fold_keeps_one_entry_a_part(spark, library):
    """Words of every length the fold takes; a rank that does not fit an entry is refused."""
    ranks = bpe.read_ranks(bpe.vocabulary_path())
    draw = random.Random(6)
    words = ["", "a", "é", "中"]
    words += ["".join(draw.choice("abetions é中\0") for _ in range(draw.randint(2, 40))) for _ in range(200)]
    words += [c * n for c in "az0" for n in (2, 3, 127, 128)]
    docs = spark.createDataFrame([(words,)], "words array<string>")
    found = docs.select(bpe.fold_words(docs["words"], ranks).alias("ids")).first()["ids"]
    assert found == [library._encode_single_piece(w) if w else [] for w in words]
    with pytest.raises(ValueError, match="ranks must be less"):
        bpe.rank_table({b"a": bpe.NO_RANK})


def test_long_words_by_heap(library):
    ranks = bpe.read_ranks(bpe.vocabulary_path())
    draw = random.Random(2)
    for _ in range(60):
        word = "".join(draw.choice("abcdeé中") for _ in range(draw.randint(1, 400)))
        assert bpe.heap_merge(word.encode(), ranks) == library._encode_single_piece(word)


def test_both_patterns_split_alike():
    split = bpe.Splitter(public_tokenizers.PATTERN)
    draw = random.Random(9)
    for _ in range(500):
        text = "".join(chr(draw.randrange(0x250)) for _ in range(40)) + draw.choice(["", " 's", "\n\n x", "  "])
        assert split.near.findall(text) == split.far.findall(text)


# --- personal data ---------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match.group())
            if (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in match.group().split(".")))
                or (kind == "card" and 14 <= len(digits) <= 19 and pii.luhn(digits))
                or (kind == "phone" and 10 <= len(digits) <= 15)
            ):
                found.append((kind, *match.span()))
    return sorted(found, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def test_pii_against_plain_patterns():
    draw = random.Random(4)
    cards = ["4923437827071911", "4923-4378 2707 1911", "4923437827071912", "00000000000000"]
    for _ in range(3000):
        text = "".join(
            draw.choice(["a", "é", ".", "@", "b.c", " ", "1", "25", "255", "256", "+", "(", ")", "-", "%", "\n", *cards])
            for _ in range(draw.randint(0, 25))
        )
        base = [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE]
        assert base == plain_spans(text), text


def test_op9(spark, messy, no_documents):
    expected = []
    for doc_id, text, *_ in messy_documents():
        spans = plain_spans(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        counts = [sum(s[0] == k for s in spans) for k in PATTERNS]
        expected.append((doc_id, *counts, hashlib.sha256(joined.encode()).hexdigest()))
    found = QUERIES["op9_pii_spans"](spark, messy).collect()
    assert by_id(tuple(r)[:6] for r in found) == by_id(expected)
    assert QUERIES["op9_pii_spans"](spark, no_documents).count() == 0


def test_pii_checksums_and_context():
    kinds = lambda text: [s[0] for s in pii.find_spans(text)]
    assert kinds("account DE89 3704 0044 0532 0130 00") == ["iban"]
    assert kinds("account DE89 3704 0044 0532 0130 01") == []
    assert kinds("ssn 078-05-1120") == ["ssn"] and kinds("part 078-05-1120") == []
    assert kinds('token = "24be64439e3e49cf46b2d7c9"') == ["secret"]
    assert kinds("call 606-555-7814") == ["local_phone"] and kinds("item 606-555-7814") == []


def test_redaction(spark, messy):
    docs = spark.read.parquet(f"{messy}/documents.parquet")
    clean = pii.redact_documents(docs)
    assert clean.columns == docs.columns
    text = clean.filter("doc_id = 10").first()
    assert "[EMAIL]" in text["text"] and "[PHONE]" in text["text"] and "a.b@" not in text["text"]
    assert text["n_chars"] == len(text["text"])
    assert pii.redact("ab", [("x", 0, 2, 1.0), ("y", 1, 2, 1.0)]) == "[X]"


def test_long_digit_runs_are_linear():
    assert pii.find_spans("1" * 300_000) == [] and pii.find_spans("a" * 300_000 + "@") == []


# --- pages -----------------------------------------------------------------------------------

STORY = "The river was high and the people of the town went to the hills for the night. "
PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class='has-sidebar'>"
    "<header><a href=/>Home</a></header><nav><ul><li><a href=/a>First</a></ul></nav>"
    "<div class='cookie-notice'>We use cookies and you are with us for the best of it.</div>"
    "<article><h1>High &amp; dry</h1><p>{story}<p>Short<br>one.</p><script>var a='</p>';</script>"
    "<div class=ad>Buy the best of the best now and for ever.</div><p><b>{story}<!-- no <p> --></article>"
    "<aside>Other things that are not of the story but are long enough to be one of the blocks.</aside>"
    "<section id=comments><p>{story}</p></section><form><input value=x>Send</form>"
    "<footer>&copy; someone</footer></body></html>"
)


def test_page_with_article():
    story = STORY.strip()
    page = PAGE.replace("{story}", STORY)
    assert html_text.main_text(page) == f"High & dry {story} Short one. {story}"


def test_page_without_article():
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Part {i}</a></li>" for i in range(5)) + "</ul>"
    body = f"<div>{menu}</div><div><p>{STORY * 4}</p><p>Yes.</p><p>{STORY * 4}</p></div><p>\N{COPYRIGHT SIGN} us</p>"
    story = (STORY * 4).strip()
    assert html_text.main_text(f"<body>{body}</body>") == f"{story} Yes. {story}"


def test_page_shapes():
    story = STORY.strip()
    around = f"<div class='page-header'><p>{STORY}</p></div>%s<div id=sidebar><p>{STORY}</p></div>"
    inner = f"<h1>Flood</h1><p>{STORY}</p>"
    for body in (
        f"<main><div class='entry-header'>{inner}</div><section class='comment-list'><p>{STORY}</p></section></main>",
        f"<div role=main>{inner}<div class=toc><a href=#a>A</a></div></div>",
        f"<main><p>{STORY}</p><article class='post tags-news'>{inner}<article class=comment><p>{STORY}</p></article></article></main>",
        f"<article><header>{inner}</header><div class='notice'>{STORY}</div><nav><a href=/>Up</a></nav></article>",
    ):
        assert html_text.main_text(around % body) == f"Flood {story}", body


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<article>", ""),
        ("<article>a<b>b</b>c &#228;&nbsp;&lt; d</article>", "abc ä < d"),
        ("<article><p>one<p>two<li>three<a href='x", "one two three"),
        ("<article>1 < 2 <!-- open", "1 < 2"),
        ("<article><p>kept</p><script>lost", "kept"),
        ("<p" * 5000, ""),
    ],
)
def test_broken_pages(page, text):
    assert html_text.main_text(page) == text


def test_op1(spark, write, no_documents):
    rows = [(1, "u", PAGE.replace("{story}", STORY)), (1, "u", PAGE.replace("{story}", STORY)), (2, None, None), (None, "v", "")]
    folder = write(pages=([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, n_chars string"))
    found = QUERIES["op1_main_text"](spark, folder)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    expected = [(i, u, html_text.main_text(h), len(html_text.main_text(h))) for i, u, h in rows]
    assert by_id(map(tuple, found.collect())) == by_id(expected)
    assert QUERIES["op1_main_text"](spark, no_documents).count() == 0


class Article(HTMLParser):
    """The text of a page's article by the standard library: words only, blocks part them."""

    def __init__(self):
        super().__init__()
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag not in ("b", "i", "a", "em", "span"):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag not in ("b", "i", "a", "em", "span"):
            self.parts.append(" ")

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def test_op1_against_another_extractor(spark):
    """All pages of the small tables hold one article: its words, and nothing else, come out."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    found = {r["page_id"]: r["text"] for r in QUERIES["op1_main_text"](spark, SMALL).collect()}
    assert len(found) == len(pages) > 200
    for page in pages:
        assert page["html"].count("<article") == 1
        reader = Article()
        reader.feed(page["html"])
        assert found[page["page_id"]] == " ".join("".join(reader.parts).split())
