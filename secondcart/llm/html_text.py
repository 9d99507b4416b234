"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html as html_entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondcart.llm.common import exact_columns, text_slices

# Elements whose content is never text of the page, up to their end tag.
RAW = frozenset(
    "script style noscript template title textarea iframe object svg math canvas select"
    " option datalist audio video xmp noembed noframes".split()
)
# Elements that hold something other than the article.
ASIDE = frozenset("nav footer aside form menu dialog button fieldset".split())
MAIN = frozenset("article main".split())
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr frame".split()
)
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl"
    " dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr"
    " html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead"
    " title tr ul".split()
)
# Words in a class, an id or a role that mark such elements; compared with whole words only.
# Inside an article a longer name also counts if all its other words are in NAME_WORDS, so that
# `share-buttons` does and `related-work` does not.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment"
    " comments consent contentinfo cookie cookies copyright disqus footer form gdpr header login"
    " masthead menu modal nav navbar navigation newsletter notice notices notification paywall"
    " popup promo promoted promotion related respond search share sharing sidebar signup social"
    " sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
NAME_WORDS = frozenset(
    "area article articles bar block box button buttons container content email form google icon"
    " icons inline inner item items link links list main media module news page post posts section"
    " site slot thread top bottom left right unit wrap wrapper".split()
)
# Words that say what an element is next to or has, not what it is.
NOT_NAMES = frozenset("and has no of or the to with without".split())
# Elements that an article is made of. Their ids and labels are mostly made from their titles.
PARTS = frozenset(
    "h1 h2 h3 h4 h5 h6 hgroup p blockquote pre figure figcaption table section li dt dd".split()
)
TITLES = frozenset("h1 h2 h3 h4 h5 h6 hgroup p blockquote pre figure figcaption".split())
# Ids of sections that hold comments all the same.
COMMENT_IDS = frozenset(
    ["comments", "comment section", "comments section", "comment list", "respond", "disqus thread"]
)
IMPLIED_END = {"p": frozenset(["p"]), "li": frozenset(["li"]), "tr": frozenset(["tr", "td", "th"])}
NAME = re.compile(r"[A-Za-z][^\s/>]*")
REST = re.compile(r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""")
MARKS = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"""\shidden(?=[\s=>])|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"([a-z])([A-Z])")

WINDOW = 3
# Without an article element: characters in a window that count as a surge.
SURGE = 80
LINK_SHARE = 0.5


@dataclass
class Line:
    """One block of the page. ``aside``: in a menu, form, advert and so on."""

    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    aside: bool = False
    main: bool = False

    def text(self) -> str:
        return " ".join(html_entities.unescape("".join(self.pieces)).split())


def _marks_aside(kind: str, value: str, name: str, part: bool, in_main: bool) -> bool:
    """Whether a class, id, role or label says that an element is not text of the page."""
    # camelCase and underscores count as word borders, as hyphens do
    value = value if kind == "class" else CAMEL.sub(r"\1 \2", value)
    if part and kind == "aria-label":
        return False
    if part and kind == "id":
        return name not in TITLES and " ".join(WORD.findall(value.lower())) in COMMENT_IDS
    for token in value.split() if kind == "class" else [value]:
        found = WORD.findall(CAMEL.sub(r"\1 \2", token).lower())
        telling = ASIDE_WORDS.intersection(found)
        if in_main:
            # as with the element itself, a header there belongs to the article
            telling -= {"header"}
        if not telling or not NOT_NAMES.isdisjoint(found):
            continue
        if not (part or in_main) or all(w in telling or w in NAME_WORDS for w in found):
            return True
    return False


def _is_aside(name: str, attributes: str, in_article: bool, in_main: bool) -> bool:
    if name in ASIDE or (name == "header" and not in_article):
        return True
    if "=" in attributes or "hidden" in attributes:
        if name not in ("html", "body", "article", "main"):
            marks = MARKS.findall(attributes)
            # docutils writes sections as div
            part = name in PARTS or any(
                k.lower() == "class" and "section" in v.strip("\"'").split() for k, v in marks
            )
            for kind, value in marks:
                if _marks_aside(kind.lower(), value.strip("\"'"), name, part, in_main):
                    return True
            return bool(HIDDEN.search(f" {attributes}"))
    return False


def lines_of(page: str) -> list[Line]:
    """Strip markup: the blocks of a page, in page order."""
    lines: list[Line] = []
    line = Line()
    # name, then of the element or one above it: aside, main, article
    stack: list[tuple[str, bool, bool, bool]] = []
    opened: Counter[str] = Counter()
    aside = main = False
    links = 0
    at, end = 0, len(page)
    lower = page.lower()
    if len(lower) != end:  # a few capital letters grow when lower-cased
        lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in page)

    def cut() -> Line:
        if line.pieces:
            lines.append(line)
        return Line(aside=aside, main=main)

    while at < end:
        tag = page.find("<", at)
        if tag < 0:
            tag = end
        if tag > at:
            piece = page[at:tag]
            line.pieces.append(piece)
            if links:
                line.linked += len(piece.strip())
        if tag == end:
            break
        follows = page[tag + 1 : tag + 2]
        if page.startswith("<!--", tag):
            stop = page.find("-->", tag + 2)
            at = end if stop < 0 else stop + 3
            continue
        if follows in ("!", "?"):
            stop = page.find(">", tag)
            at = end if stop < 0 else stop + 1
            continue
        closing = follows == "/"
        named = NAME.match(page, tag + 1 + closing)
        if not named:
            line.pieces.append("<")  # not markup
            at = tag + 1
            continue
        name = lower[named.start() : named.end()]
        rest = REST.match(page, named.end())
        if rest:
            at = rest.end()
        else:
            stop = page.find(">", named.end())
            at = end if stop < 0 else stop + 1
        attributes = page[named.end() : at - 1]
        if name == "a":
            links = 0 if closing else 1
        if not closing and name in RAW and not attributes.endswith("/"):
            stop = lower.find(f"</{name}", at)
            if name in BLOCK:
                line = cut()
            at = end if stop < 0 else stop
            continue
        if name in RAW:
            continue
        if closing:
            # An end tag closes the nearest element of its name; one without it closes nothing.
            while opened[name]:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == name:
                    break
        elif name not in VOID and not attributes.endswith("/"):
            if name in IMPLIED_END and stack and stack[-1][0] in IMPLIED_END[name]:
                opened[stack.pop()[0]] -= 1
            above = stack[-1] if stack else ("", False, False, False)
            opened[name] += 1
            stack.append(
                (
                    name,
                    above[1] or _is_aside(name, attributes, above[3], above[2]),
                    above[2] or name in MAIN or 'role="main"' in attributes,
                    above[3] or name == "article",
                )
            )
        now = stack[-1][1:3] if stack else (False, False)
        changed = now != (aside, main)
        aside, main = now
        if name in BLOCK or changed:
            line = cut()
    cut()
    return lines


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """Text between the surge and the dive of the page's line lengths.

    Lines that lie in menus, adverts, forms and so on are taken out, as are lines outside the
    article where the page marks one, and link lists elsewhere. What is left of a marked article
    is text. Elsewhere sums over ``window`` of the lines left rise to the threshold where the text
    begins and fall below it for good where it ends; all lines between the two stay.
    """
    if not page:
        return ""
    lines = lines_of(page)
    texts = [x.text() for x in lines]
    marked = any(x.main and not x.aside and t for x, t in zip(lines, texts, strict=True))

    def length(line: Line, text: str) -> int:
        if line.aside or (marked and not line.main):
            return 0
        if not marked and line.linked > LINK_SHARE * len(text):
            return 0
        return len(text)

    kept = [(t, n) for x, t in zip(lines, texts, strict=True) if (n := length(x, t))]
    if marked or not kept:
        return " ".join(t for t, _ in kept)
    sizes = [n for _, n in kept]
    threshold = min(surge, sum(sizes))
    padded = [0] * (window - 1) + sizes + [0] * (window - 1)
    # the window at i holds the lines from i - window + 1 to i
    total = sum(padded[: window - 1])
    surges = []
    for i in range(len(padded) - window + 1):
        total += padded[i + window - 1]
        if total >= threshold:
            surges.append(i)
        total -= padded[i]
    first, last = max(0, surges[0] - window + 1), surges[-1]
    return " ".join(t for t, _ in kept[first : last + 1])


def _extract(batches) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "html"):
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_pydict(
            {
                "page_id": batch.column("page_id"),
                "url": batch.column("url"),
                "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            }
        )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    Works row by row without a shuffle. A NULL or empty html has the empty text, a very long page
    is parsed whole; ids and urls are passed on as they are, NULL and repeated ones too, and equal
    pages have equal texts. Of windows with equal sums the first rise and the last fall count. An
    empty table gives an empty result; other columns are ignored, whatever their names.
    """
    rows = exact_columns(pages, "page_id", "url", "html").withColumn(
        "page_id", F.col("page_id").cast("long")
    )
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
