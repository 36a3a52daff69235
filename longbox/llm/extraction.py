"""Main text of catalogue and article pages.

A page is a sequence of words and tags. A word scores one; a tag costs the more,
the less its kind occurs inside the content of labelled pages, those that mark
their content themselves; on a page without such a mark a tag costs a few words
at most, since there the same tags make up the content too. One scan over the scores finds the contiguous region
of largest sum, which is the content. Menus, adverts, forms and the like inside
it are left out by their element or their class, and so are scripts and styles.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labelled pages to learn from, at most: those of least hash.
SAMPLE = 2_000
# Kinds of tags known: those on so many pages of the sample.
SEEN = 2
# Words that a tag which content never has costs; and the weight of the prior.
COST = 50.0
PRIOR = 2.0
# Inside an article or main element a tag costs this share.
INSIDE = 0.01
# On a page without them it costs so many words at most.
UNMARKED = 3.25

# Elements by their role in HTML.
CONTENT = "article main".split()
RAW = "script style noscript template iframe svg textarea title xmp".split()
LEFT_OUT = "head nav footer aside form button select dialog object menu".split()
WITHIN_TEXT = (
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr"
).split()
PARAGRAPHS = "p h1 h2 h3 h4 h5 h6 br blockquote pre".split()
# Elements that may stay open without saying where they end.
VOID = "br wbr hr img input meta link col area base embed source track param".split()
LOOSE = frozenset([*WITHIN_TEXT, *PARAGRAPHS, *VOID, *"li dt dd tr td th option".split()])
MARKED = re.compile(
    r"(?i)(?<!\S)(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|respond|disqus\w*|sidebar|menu|nav|navbar|navigation|footer|header|masthead|"
    r"notice|notices|cookies?|consent|banner|share|sharing|social|related|newsletter|subscribe|breadcrumbs?|popup|modal|search)(?!\S)"
)
# Names of what readers add, where an article is a comment.
ADDED = re.compile(r"(?i)(?<!\S)(?:comments?|respond|disqus\w*)(?!\S)")

# Compound names that hide: such a last part, or such a first part before a word for a container; no part denies it.
LAST = re.compile(r"(?i)ads?|advert\w*|adsense|sponsor\w*|promo|comments?|disqus|cookies?|consent|banner|newsletter|popup|notice")
FIRST = re.compile(r"(?i)ads?|advert\w*|adsense|sponsor\w*|promo|comments?|disqus|cookies?|consent|banner|newsletter|popup")
HOLDER = re.compile(
    r"(?i)slot|unit|box|block|banner|bar|list|section|area|wrap|wrapper|container|form|thread|feed|panel|overlay|notice|inner|"
    r"content|body|item|top|bottom|left|right|\d+"
)
DENIED = re.compile(r"(?i)no|not|non|has|have|with|without|hide|hidden|free|less")
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")

_OPENS = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_REST = re.compile(r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_NAMED = re.compile(r"(?i)(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): ("text", "", text), ("open", tag, attributes), ("close", tag, "").

    Comments and the content of raw elements are no tokens. A tag ends at the
    first ``>`` outside quotes. If quotes let a tag run to the end of the page,
    they count for nothing from there on; a tag without any ``>`` is text.
    """
    at, last, quoted = 0, page.rfind(">"), True
    start = 0
    while found := _OPENS.search(page, at):
        name = (found[4] or "").lower()
        if found[1] or found[2]:
            end = page.find("-->" if found[1] else ">", found.end())
            end, rest = (len(page) if end < 0 else end + (3 if found[1] else 1)), ""
        else:
            closed = _REST.match(page, found.end()) if quoted and found.end() <= last else None
            if closed is None and found.end() > last:
                break
            quoted = closed is not None
            end = closed.end() if closed else page.find(">", found.end()) + 1
            rest = page[found.end() : end - 1]
        if found.start() > start:
            yield "text", "", page[start : found.start()]
        at = start = end
        if not name:
            continue
        if found[3]:
            yield "close", name, ""
            continue
        yield "open", name, rest
        if name in RAW:
            close = _raw_end(name).search(page, at)
            at = start = close.start() if close else len(page)
    if start < len(page):
        yield "text", "", page[start:]


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I)


def _names(name: str, attributes: str) -> str:
    """Whole words of class and role, and of the id of what holds other elements (elsewhere it is an anchor)."""
    return " ".join(" ".join(value) for kind, *value in _NAMED.findall(attributes) if kind.lower() != "id" or name not in LOOSE)


@lru_cache(maxsize=10_000)
def _hides(names: str) -> bool:
    """Whether a name, whole or by its parts, is one of what is no content."""
    if MARKED.search(names):
        return True
    for name in names.split():
        parts = _PARTS.split(name)
        if len(parts) < 2 or any(DENIED.fullmatch(x) for x in parts):
            continue
        if LAST.fullmatch(parts[-1]) or FIRST.fullmatch(parts[0]) and HOLDER.fullmatch(parts[1]):
            return True
    return False


def _left_out(name: str, attributes: str, inside: bool, holds: set[str]) -> bool:
    """Whether an element is no content; ``inside``: an article or main is open.

    ``holds``: which of article and main are in it. A form may be around a whole
    page; what is in an aside or menu goes with it, but for a main.
    """
    if name in RAW:
        return True
    names = _names(name, attributes)
    around = "main" in holds or "article" in holds and not ADDED.search(names)
    if name in LEFT_OUT or name == "header" and not inside:
        return not ("main" in holds or around and name == "form")
    if name in CONTENT or name in ("body", "html"):
        return False
    return not around and _hides(names)


def _holding(items: list[tuple[str, str, str]]) -> dict[int, set[str]]:
    """By the place of an opening tag, which of article and main lie in its element.

    An article within an article is a comment or the like and counts for neither
    the outer one nor what is between.
    """
    holds: dict[int, set[str]] = {}
    open_: list[tuple[str, int]] = []
    count: Counter[str] = Counter()
    for at, (kind, name, rest) in enumerate(items):
        if kind == "open":
            if name == "main" or name == "article" and not count["article"]:
                for _, place in reversed(open_):
                    if name in holds.get(place, ()):
                        break
                    holds.setdefault(place, set()).add(name)
            if name not in VOID and not rest.endswith("/") and (name not in LOOSE or _hides(_names(name, rest))):
                open_.append((name, at))
                count[name] += 1
        elif kind == "close" and count[name]:
            last = None
            while last != name:
                last, _ = open_.pop()
                count[last] -= 1
    return holds


def scored(page: str, cost: dict[str, float]) -> Iterator[tuple[float, str]]:
    """(score, text) of each token; a tag that ends a line of text gives a space."""
    open_, hidden = [], 0
    count: Counter[str] = Counter()
    items = list(tokens(page))
    holds = _holding(items)
    most = COST if any(kind == "open" and name in CONTENT for kind, name, _ in items) else UNMARKED
    for at, (kind, name, rest) in enumerate(items):
        if kind == "text":
            if not hidden:
                text = html_lib.unescape(rest)
                yield float(len(text.split())), text
            continue
        shown = not hidden
        inside = any(count[n] for n in CONTENT)
        price = min(most, cost.get(name, _cost(name, 0, 0))) * (INSIDE if inside and name not in CONTENT else 1)
        if kind == "open":
            out = _left_out(name, rest, inside, holds.get(at, set()))
            if out and inside:
                price = 0.0  # left out as a whole, so it says nothing of what follows
            if (name not in LOOSE or out) and name not in VOID and not rest.endswith("/"):
                open_.append((name, out))
                count[name] += 1
                hidden += out
        elif count[name]:
            last = None
            while last != name:
                last, out = open_.pop()
                count[last] -= 1
                hidden -= out
            shown &= not hidden
        if shown:
            yield -price, "" if name in WITHIN_TEXT else " "


def main_text(page: str, cost: dict[str, float]) -> str:
    """Text of the contiguous region of largest score, white space as single spaces."""
    items = list(scored(page, cost))
    best = total = 0.0
    region = (0, 0)
    start = 0
    for i, (score, _) in enumerate(items):
        total += score
        if total <= 0.0:
            total, start = 0.0, i + 1
        elif total > best:
            best, region = total, (start, i + 1)
    return " ".join("".join(text for _, text in items[region[0] : region[1]]).split())


def _cost(name: str, inside: int, n: int) -> float:
    usual = 1.0 if name in WITHIN_TEXT or name in PARAGRAPHS else 0.0
    return COST * (1 - (inside + PRIOR * usual) / (n + PRIOR))


TALLY = "inside n pages".split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tag, inside, n, pages) per batch of labelled pages."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for page in batch.column("html").to_pylist():
            depth, met = 0, set()
            for kind, name, _ in tokens(page):
                if kind == "text":
                    continue
                edge = name in CONTENT
                depth = max(0, depth + (1 if kind == "open" else -1)) if edge else depth
                tally = counts.setdefault(name, [0, 0, 0])
                tally[0] += depth > 0 and not edge
                tally[1] += 1
                tally[2] += name not in met
                met.add(name)
        values = list(counts.values())
        yield pa.RecordBatch.from_pydict({"tag": list(counts)} | {name: pa.array([v[i] for v in values], pa.int64()) for i, name in enumerate(TALLY)})


def learn(pages: DataFrame) -> dict[str, float]:
    """Cost of each kind of tag, from those of ``pages`` with an article or main element.

    ``pages``: page_id, url, html. ``SAMPLE`` of them are read (rows of equal id
    and url together) and the kinds kept that ``SEEN`` of them have; any other kind
    has the cost of the prior: none for what text is made of, full for others.
    """
    labelled = pages.select(F.xxhash64("page_id", "url").alias("_order"), "html").filter(F.rlike("html", F.lit(r"(?i)<(article|main)[\s>]")))
    # Only hashes are put in order; the pages below the last one stay where they are.
    last = labelled.select("_order").orderBy("_order").limit(SAMPLE).agg(F.max("_order")).first()[0]
    labelled = labelled.filter(F.col("_order") <= F.lit(last)).select("html")
    counts = labelled.mapInArrow(_count, "tag STRING, inside BIGINT, n BIGINT, pages BIGINT")
    rows = counts.groupBy("tag").agg(*[F.sum(name).alias(name) for name in TALLY]).filter(F.col("pages") >= SEEN).collect()
    return {r["tag"]: _cost(r["tag"], r["inside"], r["n"]) for r in rows}


def extract(pages: DataFrame, cost: dict[str, float]) -> DataFrame:
    """(page_id, url, text) of each row of ``pages``: page_id, url, html.

    Character references are decoded, white space is one space, blocks are
    joined by one. Pages null, empty or without words have an empty text. One
    row per row, repeated ones too; an empty table gives no rows. Pages are
    taken whole, however long; other columns are ignored.
    """

    @F.arrow_udf("string")
    def text(htmls: pa.Array) -> pa.Array:
        return pa.array([main_text(page.as_py() or "", cost) for page in htmls], pa.string())

    return pages.select("page_id", "url", text(F.col("html")).alias("text"))
