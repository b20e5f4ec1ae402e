"""Main text of HTML pages by two passes of block rules.

The page is cut into blocks at block-level tags; character references are decoded
and white space inside a block becomes one space. Containers that never hold the
article (menus, headers, footers, sidebars, forms, adverts, notices, comments) are
known by tag, or by the words of class, id and role of a container or a paragraph.
Every word of a value is evidence: one that names what isn't the article speaks against
it, one that names the article for it, and the values are added up. That evidence is
overruled by density and neighbours: if nothing else would be left of a page, it isn't
believed.

First pass: a block is judged by its length, its density of stop words and its density
of links, and may stay undecided. Where the page marks its article, what stands
outside is out, and the bars are lower inside. Stop words tell only on pages that
have known ones; elsewhere length and links do. Characters of scripts that don't
part words count half a word. Second pass: undecided short blocks take the label of
the nearest decided neighbour in the same region (the closer one, measured in
characters between them; on a tie the one before; a heading belongs to what follows).

Each page is handled alone; memory is bounded by an Arrow batch and the longest
page. Defined cases: null or empty html, or a page with no article: empty text;
unclosed tags, quotes and comments end at the next container or at the end of the
page; repeated rows get equal texts; a very long page is held whole; an empty table
gives an empty frame; the result's column takes a name that the table doesn't have.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlake.llm.common import fresh_name, table

# Element names of HTML by what they mean here.
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea title select button canvas audio video noembed noframes xmp".split())
OUT = frozenset("aside dialog footer form head menu nav search".split())
#: Only these are kept on the stack of open containers.
CONTAINER = frozenset("article aside blockquote body dialog details div dl fieldset figure footer form head header html li main menu nav ol search section table td th tr ul".split())
ARTICLE = frozenset(["article", "main"])
#: Words of class, id and role values that name what isn't the article.
HINTS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay"
    " sidebar side rail widget menu nav navbar navigation breadcrumb breadcrumbs toc pagination pager header masthead topbar footer copyright"
    " comment comments commentlist disqus reply replies respond discussion share sharing social related recommended newsletter subscribe signup login search skip".split()
)
STOP_WORDS = frozenset(
    "the of and to in is that it for was on are as with his they at be this from have or by not but what all were we when your can said there use an each which she do how their if"
    " der die das und ist nicht ein eine den von zu mit sich des auf für im dem als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über"
    " le la les de et un une des que est pas pour dans ce il sur qui au par plus avec se son sont ne elle aux du en"
    " el los las que y en un una por con no se su para es al lo como más o pero sus le ya este sí porque".split()
)
#: Words that name the article, words that don't speak against it beside one of these, and those that deny what follows.
GOOD = frozenset("article entry post story main content".split())
WEAK = frozenset("header masthead banner".split())
DENIALS = frozenset("has with no without is".split())
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_CJK = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    link_chars: int
    out: bool
    inside: bool
    hinted: bool = False  # out only by the words of a class, id or role
    label: int = 0  # 1 in, -1 out, 0 undecided
    heading: bool = False
    links: int = 0


def _tag_end(page: str, at: int) -> int:
    """Index of the > that ends the tag at ``at``; quoted values may hold one."""
    rest = _REST.match(page, at)
    return rest.end() - 1 if rest else len(page)


def _evidence(token: str) -> int:
    """-1 if a word of one value of class, id or role names what isn't the article, 1 if one names the article, else 0."""
    parts = [p.lower() for p in _PART.findall(token)]
    good = not GOOD.isdisjoint(parts)
    for i, p in enumerate(parts):
        if p in HINTS and DENIALS.isdisjoint(parts[:i]) and not (good and p in WEAK):
            return -1
    return int(good and HINTS.isdisjoint(parts))


def _hinted(attributes: str) -> bool:
    """Whether class, id and role together speak against an element."""
    found = _ATTRIBUTE.findall(attributes) if "=" in attributes else ()
    return sum(_evidence(token) for _, value in found for token in value.strip("\"'").split()) < 0


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, with what is known of where they stand."""
    found: list[Block] = []
    text: list[str] = []
    # (name, out, inside an article, out by a hint) of each open container
    stack: list[tuple[str, bool, bool, bool]] = []
    linked, link_chars, links, heading, against = False, 0, 0, False, False

    def flush() -> None:
        nonlocal link_chars, links
        joined = " ".join("".join(text).split())
        if joined:
            _, out, inside, hinted = stack[-1] if stack else ("", False, False, False)
            found.append(Block(joined, link_chars, out, inside, hinted or against, heading=heading, links=links))
        text.clear()
        link_chars, links = 0, int(linked)

    def add(raw: str) -> None:
        nonlocal link_chars
        if raw:
            raw = entities.unescape(raw) if "&" in raw else raw
            text.append(raw)
            if linked:
                link_chars += len(raw.strip())

    at, n = 0, len(page)
    while at < n:
        tag = page.find("<", at)
        if tag < 0:
            add(page[at:])
            break
        following = page[tag + 1 : tag + 2]
        if following == "!" or following == "?":
            add(page[at:tag])
            if page.startswith("<!--", tag):
                end = page.find("-->", tag + 4)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", tag)
                at = n if end < 0 else end + 1
            continue
        name = _NAME.match(page, tag + 1)
        if not name:  # a bare < is text
            add(page[at : tag + 1])
            at = tag + 1
            continue
        add(page[at:tag])
        element, closing = name[1].lower(), following == "/"
        end = _tag_end(page, name.end())
        attributes = page[name.end() : end]
        at = end + 1
        if element in RAW:
            if element in BLOCK:
                flush()
            if not closing and not attributes.endswith("/"):
                stop = re.compile(rf"</{re.escape(element)}\b", re.I).search(page, at)
                at = n if stop is None else _tag_end(page, stop.end()) + 1
            continue
        if element == "a":
            linked = not closing
            links += linked
            continue
        if element not in BLOCK:
            continue
        flush()
        if element in VOID:
            continue
        heading = not closing and len(element) == 2 and element[0] == "h" and element[1].isdigit()
        # a paragraph's own class holds until the next block
        against = not closing and element not in CONTAINER and _hinted(attributes)
        if element not in CONTAINER:
            continue
        linked = False
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == element:
                    del stack[i:]
                    break
        elif not attributes.endswith("/"):
            _, out, inside, hinted = stack[-1] if stack else ("", False, False, False)
            own = element in OUT or (element == "header" and not inside)
            named = element not in ("html", "body") and element not in ARTICLE and _hinted(attributes)
            stack.append((element, out or own, inside or element in ARTICLE, hinted or named))
    flush()
    return found


def _judge(b: Block, known: bool) -> int:
    """First pass: 1 in, -1 out, 0 undecided; ``known``: the page has stop words that are known."""
    words = _WORD.findall(b.text.lower())
    length = len(words) + len(_CJK.findall(b.text)) / 2
    density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    links = b.link_chars / len(b.text)
    # bars inside a marked article, and where nothing is marked
    most_links, enough, dense, long = (0.7, 6, 0.08, 20) if b.inside else (0.4, 12, 0.15, 40)
    if links > most_links:
        # a paragraph that is one link reads like prose, a list of links doesn't
        prose = b.links == 1 and length >= max(enough, 12) and (density >= dense if known else length >= 1.5 * enough)
        return 0 if prose else -1
    if length >= enough and links <= most_links / 2 and (density >= dense if known else length >= 1.5 * enough):
        return 1
    if length >= long and links <= most_links / 4:
        return 1
    if known and not b.inside and length >= 12 and density < 0.05:
        return -1
    return 0


def _passes(found: list[Block], out: list[bool]) -> None:
    """Labels all blocks 1 or -1 by both passes."""
    words = [w for b in found for w in _WORD.findall(b.text.lower())]
    known = sum(w in STOP_WORDS for w in words) >= 0.03 * len(words)
    marked = any(b.inside and not o for b, o in zip(found, out, strict=True))
    region = []
    for b, o in zip(found, out, strict=True):
        if o or (marked and not b.inside):
            b.label = -1
            if not marked:  # inside a marked article an advert says nothing of what stands beside it
                region.append(b)
        else:
            b.label = _judge(b, known)
            region.append(b)
    labels = [b.label for b in region]
    if not any(labels) or (marked and 1 not in labels):  # nothing to go by: a marked article's short blocks are in, others out
        for b in region:
            b.label = b.label or (1 if marked else -1)
        return
    ends = [0]
    for b in region:
        ends.append(ends[-1] + len(b.text))
    after, last = [-1] * len(region), -1
    for i in range(len(region) - 1, -1, -1):
        after[i] = last
        last = i if labels[i] else last
    before = -1
    for i, b in enumerate(region):
        if labels[i]:
            before = i
            continue
        q = after[i]
        # a heading belongs to what follows it
        if b.heading and q >= 0 and labels[q] == 1:
            b.label = 1
        elif before < 0 or (q >= 0 and ends[q] - ends[i + 1] < ends[i] - ends[before + 1]):
            b.label = labels[q]
        else:
            b.label = labels[before]


def classify(found: list[Block]) -> list[Block]:
    """Both passes; returns the same blocks, all labelled 1 or -1."""
    _passes(found, [b.out or b.hinted for b in found])
    if any(b.hinted for b in found) and not any(b.label == 1 for b in found):
        _passes(found, [b.out for b in found])
    return found


def main_text(page: str | None) -> str:
    return " ".join(b.text for b in classify(blocks(page or "")) if b.label == 1)


def extract(pages: DataFrame, html_col: str = "html") -> tuple[DataFrame, str]:
    """``pages`` with the main text as one more column, whose name is returned too."""
    name = fresh_name(pages, "main_text")
    at = pages.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            texts = pa.array([main_text(column[i].as_py()) for i in range(batch.num_rows)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, name])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(name, T.StringType())])), name


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found, c = extract(pages)
    return found.select("page_id", "url", F.col(c).alias("text"), F.char_length(c).cast("long").alias("n_chars"))
