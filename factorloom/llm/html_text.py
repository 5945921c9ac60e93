"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one decides blocks by their place (menus,
headers, footers, sidebars, forms, notices, adverts, comments, and all outside the article of a
page that has one), link density, length and stop-word density. Pass two lets ambiguous blocks
inherit the label of their nearest decided neighbours.

Inside an article a block is only dropped for its place or its links; few stop words make it
ambiguous there, as tables and headlines have few.

Null or empty html gives an empty text. Unclosed tags, comments and scripts run to their
parent's or the page's end. Repeated pages give repeated, equal rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import table, text_slices

GOOD, BAD, SHORT, NEAR = "good", "bad", "short", "near"

SHORT_LENGTH = 70
LONG_LENGTH = 200
STOP_LOW = 0.15
STOP_HIGH = 0.30
LINKS_OUTSIDE = 0.33
LINKS_INSIDE = 0.8

STOP_WORDS = {
    "en": "a all an and are as at be been but by for from had has have he her his if in into is it its "
    "more no not of on one or our she so some than that the their them then there these they this to "
    "up was we were what when which who will with would you your",
    "de": "aber als am an auch auf aus bei bis da das dass dem den der des die durch ein eine einem einen "
    "einer er es für hat ich ihr im in ist man mit nach nicht noch nur oder sich sie sind so um und uns "
    "vom von vor war was wie wird wir zu zum zur über",
    "fr": "à au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui "
    "mais me ne nous on ont ou où par pas pour plus qu que qui sa se ses si son sont sur te tu un une "
    "vous y été",
    "es": "a al como con de del desde donde el ella en entre era es esta este ha hay la las le lo los más "
    "me mi muy no nos o para pero por que se ser si sin sobre son su sus también te tiene un una uno y "
    "ya",
}
_STOP = {language: frozenset(words.split()) for language, words in STOP_WORDS.items()}

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol option optgroup p pre search section select summary table tbody td "
    "template tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW_TAGS = frozenset("script style title textarea noscript iframe noframes noembed xmp svg math object".split())
SPACE_TAGS = frozenset("br wbr img input".split())
# Elements whose own kind makes their text boilerplate.
DROP_TAGS = frozenset("nav footer aside form header menu dialog select button template head".split())
ROOT_TAGS = frozenset(("article", "main"))
# Elements whose start ends an open element of the same kind, unless one of these lies between.
SIBLINGS = frozenset("li dt dd tr td th option".split())
LIST_TAGS = frozenset("ul ol dl table div section article main nav aside select".split())

# Parts of class and id names, and roles, that mark boilerplate.
DROP_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner toc "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "signup login sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead topbar toolbar comment comments reply replies disqus respond discussion related "
    "recommended share sharing social pagination pager tags hidden".split()
)
DROP_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split()
)
# On an article itself only these count: classes of articles also list topics and layouts.
ARTICLE_DROP_NAMES = frozenset(
    "ad ads advert sponsored promo comment comments reply replies related recommended hidden".split()
)
# Marks outside an article; inside one they belong to it.
OUTSIDE_DROP_NAMES = frozenset("header copyright disclaimer legal".split())
_NEGATIONS = frozenset(("has", "with", "no", "without", "is"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*>"
    r"|[^<]+|<",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([A-Za-z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_MAIN = re.compile(r"role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?articleBody\b", re.IGNORECASE)
_MARKS = re.compile(r"class|id|role|hidden|style", re.IGNORECASE)
_PARTS = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")
_WORDS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    dropped: bool  # by its place
    root: int  # number of the article or main part it stands in, 0 for none
    article: bool  # in an article element
    label: str = field(default="")


def _marked(attributes: str, names: frozenset[str] = DROP_NAMES) -> bool:
    """Whether class, id, role or style name the element as boilerplate or hide it."""
    if not _MARKS.search(attributes):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value.lower() in DROP_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return True
        if name in ("class", "id"):
            for word in value.split():
                parts = [p.lower() for p in _PARTS.split(word) if p]
                if parts and parts[0] not in _NEGATIONS and not names.isdisjoint(parts):
                    return True
    return False


def blocks(page: str) -> list[Block]:
    """Blocks with text, in page order."""
    found: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # element, starts a dropped part, starts an article
    opened: dict[str, int] = {}
    dropped = roots = links = in_article = articles = 0
    parts: list[str] = []
    linked: list[str] = []

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                link = " ".join(html.unescape("".join(linked)).split())
                found.append(Block(text, len(link), dropped > 0, articles if roots else 0, in_article > 0))
            parts.clear()
            linked.clear()

    def pop():
        nonlocal dropped, roots, in_article
        name, drops, root = stack.pop()
        opened[name] -= 1
        dropped -= drops
        roots -= root
        in_article -= name == "article"

    def close(name: str):
        while stack[-1][0] != name:
            pop()
        pop()

    at, end = 0, len(page)
    while at < end:
        token = _TOKEN.match(page, at)
        at = token.end()
        name = token.group(2)
        if name is None:
            piece = token.group()
            if piece == "<" and (page[at : at + 1].isalpha() or page[at : at + 1] == "/"):
                # A tag that never ends is no text.
                at = page.find("<", at) if page.find("<", at) >= 0 else end
                continue
            if piece[0] != "<" or piece == "<":
                parts.append(piece)
                if links:
                    linked.append(piece)
            continue
        name = name.lower()
        if token.group(1):
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCK_TAGS:
                flush()
            if opened.get(name):
                flush()
                close(name)
            continue
        attributes = token.group(3)
        if name in RAW_TAGS:
            if not attributes.endswith("/"):
                tail = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(page, at)
                at = tail.end() if tail else end
            parts.append(" ")
            continue
        if name in SPACE_TAGS:
            parts.append(" ")
        if name == "a":
            links = 1  # links do not nest
            linked.append(" ")
        block = name in BLOCK_TAGS
        if block:
            flush()
            if name != "p" and name in SIBLINGS:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == name:
                        close(name)
                        break
                    if stack[depth][0] in LIST_TAGS:
                        break
            if stack and stack[-1][0] == "p":
                pop()
            links = 0 if name not in ("p", "div") else links
        if name in VOID_TAGS or attributes.endswith("/"):
            continue
        if name in ("html", "body", "main"):
            drops = False
        elif name == "article":
            drops = _marked(attributes, ARTICLE_DROP_NAMES)
        else:
            inside = name == "header" and roots
            names = DROP_NAMES if roots else DROP_NAMES | OUTSIDE_DROP_NAMES
            drops = (name in DROP_TAGS and not inside) or _marked(attributes, names)
        if not (block or drops):
            continue
        if drops and not block:
            flush()
        root = not drops and (name in ROOT_TAGS or _MAIN.search(attributes) is not None)
        if root and not roots:
            articles += 1
        stack.append((name, drops, root))
        opened[name] = opened.get(name, 0) + 1
        dropped += drops
        roots += root
        in_article += name == "article"
    flush()
    return found


def stop_density(text: str) -> float:
    """Largest share of stop words over the languages known."""
    words = _WORDS.findall(text.lower())
    if not words:
        return 0.0
    return max(sum(w in stop for w in words) for stop in _STOP.values()) / len(words)


def _first_pass(block: Block, has_root: bool) -> str:
    length = len(block.text)
    density = block.links / length
    if block.dropped or (has_root and not block.root):
        return BAD
    if density > (LINKS_INSIDE if block.root else LINKS_OUTSIDE):
        return BAD
    if block.root:
        if length < SHORT_LENGTH:
            return SHORT
        return GOOD if stop_density(block.text) >= STOP_LOW else NEAR
    if "\N{COPYRIGHT SIGN}" in block.text:
        return BAD
    if length < SHORT_LENGTH:
        return BAD if density > 0 else SHORT
    stops = stop_density(block.text)
    if stops >= STOP_HIGH:
        return GOOD if length > LONG_LENGTH else NEAR
    return NEAR if stops >= STOP_LOW else BAD


def classify(found: list[Block]) -> list[Block]:
    """Label every block good or bad.

    An ambiguous block takes the label its nearest decided neighbours share. Where they differ,
    the nearer one counts, and at equal distance a near-good block, or any block of an article,
    is good. With no decided neighbour the same holds. Blocks of an article look only at blocks
    of that article that their place has not dropped.
    """
    if any(b.article and not b.dropped for b in found):
        for b in found:
            b.root *= b.article
    has_root = any(b.root and not b.dropped for b in found)
    first = [_first_pass(b, has_root) for b in found]
    groups: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        if not (b.root and b.dropped):
            groups.setdefault(b.root, []).append(i)
    labels = list(first)
    for root, rows in groups.items():
        decided: list[int | None] = []
        last = None
        for place, i in enumerate(rows):
            decided.append(last)
            last = place if first[i] in (GOOD, BAD) else last
        following = None
        for place in range(len(rows) - 1, -1, -1):
            i = rows[place]
            if first[i] in (GOOD, BAD):
                following = place
                continue
            before = decided[place]
            near = [p for p in (before, following) if p is not None]
            near.sort(key=lambda p: abs(p - place))
            kinds = {first[rows[p]] for p in near}
            kind = GOOD if root or first[i] == NEAR else BAD
            if len(kinds) == 1:
                kind = kinds.pop()
            elif kinds and abs(near[0] - place) != abs(near[1] - place):
                kind = first[rows[near[0]]]
            labels[i] = kind
    for b, label in zip(found, labels):
        b.label = label
    return found


def main_text(page: str | None) -> str:
    return " ".join(b.text for b in classify(blocks(page or "")) if b.label == GOOD)


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        texts = [main_text(page) for page in batch.column("text").to_pylist()]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in names], pa.array(texts, pa.string())],
            names=[*names, "main_text"],
        )


def extract_main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns and the main text of each page; one pass over whole pages, no shuffle."""
    wanted = pages.select(*keep, F.col("html").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema if f.name != "text")
    return wanted.mapInArrow(_text_batches, f"{schema}, main_text string").withColumnRenamed(
        "main_text", "text"
    )


def op1_main_text(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
