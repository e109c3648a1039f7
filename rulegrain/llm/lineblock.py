"""Main text of web pages by line-block distribution.

The markup is stripped into lines: the text of each block element. Lines in
menus, headers, footers, sidebars, notices, adverts, forms and comment sections
(by element, role, class, id or a first heading that says so; a block that
holds the page's main article or most of its unlinked text is none) and lines
that are mostly links weigh nothing. The main article is the one with most
unlinked text that isn't named a comment. Inside articles, names of paragraphs,
headings, captions and the like decide only where they say comment, advert or menu.
Text lengths are summed over sliding windows of lines; the page's text surges
where a window rises over the threshold and dives where it falls to nothing.
Between a surge and its dive all lines that weigh something are kept, short
ones at either end included, up to the next line that weighs nothing. A kept
line carries the other lines of its container (the innermost article or main,
else the innermost div, section or cell, else the page) that aren't furniture,
however short; lines that are mostly links too, but for those of the page itself.
Containers side by side in one block, with the same tag and class as two that
were kept, or on the page between two kept ones, keep their short lines too.
An article of links alone is kept where nothing else weighs.

Defined results: null or empty html has an empty text; repeated rows are
extracted each; an empty table gives no rows; other columns pass through, and
those named text or n_chars are replaced. Truncated and unclosed markup is read
as far as it goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 3
#: Attributes up to the tag's end: a quote opens a value only after `=`, so one in a bare value or name is a character.
ATTRS = r"(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?:svg|math)\b{ATTRS}(?<=/)>"
    rf"|<(?P<raw>title|script|style|noscript|template|svg|math|iframe|object|select|textarea|button|canvas|audio|video)\b{ATTRS}(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{ATTRS})(?:>|\Z)",
    re.S | re.I,
)
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("div section td th".split())
OUTSIDE = frozenset("nav footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words in class or id names of page furniture.
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed)?|promos?|promotion|banner|side-?bar|nav|navbar|navigation|menu|breadcrumbs?|footer|foot|masthead|topbar|site-?header|page-?header"
    r"|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|share|sharing|social|related|recommend(?:ed|ations)?|more-?from|widget|toolbar|pager|pagination|disclaimer|copyright|legal"
    r"|comments?|comment-?(?:list|section|form)|disqus|replies|respond|discussion|tags?|tag-?cloud)(?=$|[\s_-])",
    re.I,
)
#: Class names that say what a block has beside it, and marks that hold also where the block is most of the page.
BESIDE = re.compile(r"(?:^|(?<=\s))(?:has|with|without|no|is|show|hide)-\S+", re.I)
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|replies|respond|ads?|adverts?|advertisement)(?=$|[\s_-])", re.I)
#: Inside articles, names that hold for elements of running text as well; what else such an element is called decides nothing.
INNER = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|comments?|comment-?(?:list|section|form)|disqus|replies|respond|menu|nav|navbar|navigation)(?=$|[\s_-])", re.I)
RUNNING = frozenset("p h2 h3 h4 h5 h6 figcaption figure blockquote pre li dt dd td th hgroup address".split())
#: An article that is one reader's comment; an aside that is a quotation from the text.
ONE_COMMENT = re.compile(r"(?:^|\s)(?:comment|reply)(?:[_-]\S*)?(?=$|\s)", re.I)
QUOTE = re.compile(r"(?:^|[\s_-])(?:pull-?quotes?|quotes?|quotation|callout|epigraph)(?=$|[\s_-])", re.I)
#: First headings of comment sections, in the languages of the tables.
COMMENT_HEAD = re.compile(
    r"(?:\d+\s+)?(?:(?:reader |user )?comments?|responses|replies|kommentare?|leserkommentare|commentaires?|comentarios?|commenti)(?:\s*[(\[]?\d+[)\]]?)?\s*:?"
    r"|(?:leave|post|add|write) (?:a|your) (?:comment|reply)",
    re.I,
)
#: Every attribute in turn, so that words inside a value are never taken for names.
ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")


def _is_furniture(tag: str, attrs: str, inside_article: bool) -> int:
    """1 for furniture unless the block holds the main article or most of the text, 2 unless it holds the main article, 3 at any rate."""
    if tag == "form":
        return 1
    if tag in OUTSIDE and not (tag == "aside" and inside_article and _quotes(attrs)) or tag == "header" and not inside_article:
        return 2
    if not attrs or tag in ("html", "body"):
        return 0
    mark = 0
    named = INNER if inside_article and tag in RUNNING else FURNITURE
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if tag in ("article", "main"):
            if name == "class" and ONE_COMMENT.search(value) or name == "itemprop" and value.lower() == "comment":
                return 1
            continue
        if name in ("class", "id") and tag != "h1" and named.search(BESIDE.sub(" ", value)):
            mark = max(mark, 2 if COMMENTS.search(value) else 1)
        if name == "role" and value.lower() in ROLES:
            mark = max(mark, 2)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return 3
    return mark


def _class(attrs: str) -> str:
    return next((v.strip("\"'") for n, v in ATTR.findall(attrs) if n.lower() == "class"), "")


def _quotes(attrs: str) -> bool:
    return bool(QUOTE.search(_class(attrs)))


@dataclass
class Block:
    """An open or closed block: the block around it, whether it looks like furniture, unlinked text, and where its lines begin."""

    around: int
    tag: str
    kind: int
    first: int
    quotable: bool = False
    unlinked: int = 0


def _holders(blocks: list[Block]) -> set[int]:
    """The blocks that hold the page's main article, which is the article with most text where it has half of main's, else main."""
    best: dict[str, int] = {}
    for k, b in enumerate(blocks):
        if b.tag in ("article", "main") and not b.kind and (b.tag not in best or b.unlinked > blocks[best[b.tag]].unlinked):
            best[b.tag] = k
    if len(best) == 2 and 2 * blocks[best["article"]].unlinked < blocks[best["main"]].unlinked:
        del best["article"]
    held = set()
    for k in best.values():
        while k and k not in held:
            held.add(k)
            k = blocks[k].around
    return held


def lines_of(html: str) -> tuple[list[tuple[str, int, bool, int]], list[tuple[int, str, str]]]:
    """The page's lines: text, characters of it in links, whether it is page furniture, and its
    container (0 for the page); and the containers: the one around, tag and class."""
    out: list[tuple[str, int, int, int]] = []  # with the innermost block in place of furniture
    stack: list[tuple[str, int, int]] = []  # open block elements; the innermost block; the container
    blocks = [Block(0, "", 0, 0)]
    containers = [(0, "", "")]
    whole = 0
    text: list[str] = []
    links = articles = place = 0
    linked: list[str] = []

    def end_line() -> None:
        if text:
            line = " ".join(unescape("".join(text)).split())
            if line:
                nonlocal whole
                link, block = len(" ".join(unescape("".join(linked)).split())), stack[-1][1] if stack else 0
                if stack and stack[-1][0] in ("h2", "h3", "h4", "h5", "h6") and len(line) < 60 and blocks[block].first == len(out) and blocks[block].tag in ("div", "section") and COMMENT_HEAD.fullmatch(line):
                    blocks[block].kind = max(2, blocks[block].kind)
                out.append((line, link, block, stack[-1][2] if stack else 0))
                whole += len(line) - link
                blocks[block].unlinked += len(line) - link
            text.clear()
            linked.clear()

    def add(piece: str) -> None:
        if piece:
            text.append(piece)
            if links:
                linked.append(piece)

    for m in TOKEN.finditer(html):
        add(html[place : m.start()])
        place = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            add(" ")
        elif tag == "a":
            links = 0 if m["close"] else 1
        elif tag in BLOCKS:
            end_line()
            if m["close"]:
                links = 0
                if any(t == tag for t, _, _ in stack):
                    while True:
                        t = stack.pop()[0]
                        articles -= t in ("article", "main")
                        if t == tag:
                            break
            elif tag not in VOID and not m["attrs"].endswith("/"):
                if tag in ("p", "li") and stack and stack[-1][0] == tag:
                    stack.pop()
                kind = _is_furniture(tag, m["attrs"], articles > 0)
                block, within = stack[-1][1:] if stack else (0, 0)
                if tag == "blockquote" and blocks[block].quotable:
                    blocks[block].kind = 0
                if kind or tag in ("article", "main") or tag in CONTAINERS:
                    blocks.append(Block(block, tag, kind, len(out), tag == "aside" and kind == 2 and articles > 0 and not FURNITURE.search(_class(m["attrs"]))))
                    block = len(blocks) - 1
                if tag in ("article", "main") or tag in CONTAINERS and not articles:
                    containers.append((within, tag, _class(m["attrs"])))
                    within = len(containers) - 1
                stack.append((tag, block, within))
                articles += tag in ("article", "main")
    add(html[place:])
    end_line()
    for b in blocks[:0:-1]:  # inner ones come after outer ones
        blocks[b.around].unlinked += b.unlinked
    held = _holders(blocks)
    bad = [False]
    for k, b in enumerate(blocks[1:], 1):
        bad.append(bad[b.around] or b.kind == 3 or b.kind > 0 and k not in held and (b.kind == 2 or 2 * b.unlinked <= whole))
    return [(line, link, bad[block], c) for line, link, block, c in out], containers


def _beside(lines: list, weight: list[int], keep: list[bool], containers: list[tuple[int, str, str]]) -> set[int]:
    """Containers of short lines among kept ones like them, as where each paragraph has a block of its own."""
    held = {c for (*_, c), k in zip(lines, keep, strict=True) if k and c}
    alike: dict[tuple[int, str, str], int] = {}
    ends: dict[int, tuple[int, int]] = {}
    for c in sorted(held):
        around, tag, _ = containers[c]
        if tag in CONTAINERS:
            alike[containers[c]] = alike.get(containers[c], 0) + 1
            ends[around] = (ends.get(around, (c, c))[0], c)
    found = set()
    for c in {c for (*_, c), w in zip(lines, weight, strict=True) if w and c} - held:
        around, tag, _ = containers[c]
        first, last = ends.get(around, (c, c))
        if tag in CONTAINERS and (first < c < last or around and alike.get(containers[c], 0) > 1):
            found.add(c)
    return found


def main_text(html: str) -> str:
    lines, containers = lines_of(html)
    weight = [0 if bad or 2 * link > len(t) else len(t) for t, link, bad, _ in lines]
    if not any(weight):
        weight = [0 if bad or containers[c][1] not in ("article", "main") else len(t) for t, _, bad, c in lines]
    if not any(weight):
        return ""
    n = len(weight)
    block = [sum(weight[i : i + WINDOW]) for i in range(n)]
    threshold = max(1, min(80, max(block) // 2))
    keep = [False] * n
    i = 0
    while i < n:
        if block[i] < threshold or not weight[i]:
            i += 1
            continue
        # surge at i: back to the last line that weighs nothing, on to the dive
        first = i
        while first and weight[first - 1] and not keep[first - 1]:
            first -= 1
        dive = i
        while dive < n and weight[dive]:
            dive += 1
        keep[first:dive] = [True] * (dive - first)
        i = dive
    held = {c for (*_, c), k in zip(lines, keep, strict=True) if k}
    held |= _beside(lines, weight, keep, containers)
    return "\n\n".join(t for (t, _, bad, c), w, k in zip(lines, weight, keep, strict=True) if k or not bad and c in held and (w or c))


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with `text` (main text) and `n_chars` (its code points)."""
    rest = pages.drop("text", "n_chars")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(h or "") for h in batch.column(html).to_pylist()]
            kept = [c for c in batch.schema.names if c != html]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*kept, "text", "n_chars"])

    schema = T.StructType([*rest.drop(html).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rest.mapInArrow(run, schema)
