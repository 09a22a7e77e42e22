"""Main text of web pages, by differencing pages whose addresses are nearest.

A page becomes lines, one for each block. Within a host the pages are put in the order of their URL paths, in which a page's
neighbours are those that share the longest beginnings with it; the lines outside the articles are
aligned with each neighbour's by a longest common subsequence, and what is shared is furniture and goes. What differencing
can't prove goes by its markup: lines within navigation, headers, footers, asides, forms, and elements that are
named as adverts, notices or comments. Lines that the page itself marks as its article are never compared, so that
a passage which articles share stays in each of them.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

#: Neighbours on either side with which a page is compared.
NEAREST = 2
#: A page without a marked article that shares this much of its text with a neighbour is a copy of it, not of its template.
COPY = 0.8
#: Pages of a stretch of the order that one task compares, and pages of a range.
STRETCH, RANGE = 500, 20_000

#: Elements by what they are for.
UNSEEN = frozenset("head script style noscript template svg math iframe object canvas audio video select datalist textarea button".split())
IN_HEAD = frozenset("head title meta link base script style noscript template".split())
FURNITURE = frozenset("nav aside footer form menu dialog".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs pagination pager comment comments disqus respond reply replies share sharing social related recommended recommendations toolbar footer masthead topbar login".split()
)
REMARKS = frozenset("comment comments reply replies respond disqus".split())

_raw = "|".join(("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg"))
#: Comments, declarations, elements whose content is no markup, and tags; an unclosed comment or element takes the rest.
_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(?P<raw>" + _raw + r")(?=[\s/>]).*?(?:</(?P=raw)(?=[\s/>])[^>]*>?|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/><]*)(?P<more>(?:[^<>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=|[\"'])*+)>",
    re.DOTALL | re.IGNORECASE,
)
_attribute = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_hump = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_not_a_name = re.compile(r"(?:no|has|with|without|is)[-_]")
OPEN, ARTICLE, ASIDE = range(3)

Line = tuple[str, int]


def _words(names: str) -> set[str]:
    """The words that class names and ids are made of."""
    kept = (n for n in names.split() if not _not_a_name.match(n.lower()))
    return {w for n in kept for w in re.split(r"[^a-z0-9]+", _hump.sub("-", n).lower())}


def _kind(tag: str, more: str, within: bool) -> int:
    """Whether an element is the article, furniture, or neither; ``within`` an article a header is part of it."""
    kind = ARTICLE if tag in ("article", "main") else ASIDE if tag in FURNITURE or (tag == "header" and not within) else OPEN
    if more and "=" in more:
        found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _attribute.findall(more)}
        role, words = found.get("role", "").lower(), _words(found.get("class", "") + " " + found.get("id", ""))
        if role in ROLES:
            return ASIDE
        if kind == ARTICLE or tag in ("body", "html"):
            return ASIDE if words & REMARKS and tag == "article" else kind
        if words & NAMES or ("header" in words and not within and tag != "h1"):
            return ASIDE
        if role == "main" or found.get("itemprop", "").lower() == "articlebody":
            return ARTICLE
    return kind


def lines(page: str | None) -> list[Line]:
    """(text, kind) of each block of a page in order; white space is one space, empty blocks are left out."""
    page = page or ""
    out: list[Line] = []
    buffer: list[tuple[str, bool]] = []
    stack: list[tuple[str, int]] = []
    on_stack: Counter[str] = Counter()
    depth = [0, 0, 0]  # open elements of each kind
    unseen = at = 0

    def push(tag: str, kind: int) -> None:
        nonlocal unseen
        stack.append((tag, kind))
        on_stack[tag] += 1
        depth[kind] += 1
        unseen += tag in UNSEEN

    def pop() -> str:
        nonlocal unseen
        tag, kind = stack.pop()
        on_stack[tag] -= 1
        depth[kind] -= 1
        unseen -= tag in UNSEEN
        return tag

    def flush() -> None:
        for aside in (False, True):
            text = " ".join("".join([t for t, a in buffer if a == aside]).split())
            if text:
                out.append((text, ASIDE if aside else ARTICLE if depth[ARTICLE] else OPEN))
        buffer.clear()

    def close_open(tags: tuple[str, ...], stop: tuple[str, ...]) -> None:
        """End the innermost of ``tags`` if none of ``stop`` stands between."""
        if any(on_stack[t] for t in tags):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in tags:
                    while len(stack) > i:
                        pop()
                    return
                if stack[i][0] in stop:
                    return

    def say(text: str) -> None:
        if text and not unseen:
            buffer.append((html.unescape(text) if "&" in text else text, depth[ASIDE] > 0))

    for m in _token.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in BLOCKS
        if block:
            flush()
        elif tag == "br" and not unseen:
            buffer.append((" ", depth[ASIDE] > 0))
        if m["end"]:
            if on_stack[tag]:
                while pop() != tag:
                    pass
            continue
        if on_stack["head"] and tag not in IN_HEAD:  # a head that was left open
            close_open(("head",), ())
        if block:
            close_open(("p",), ("div", "li", "td", "th", "article", "section", "aside", "main", "nav", "header", "footer", "form", "blockquote"))
            if tag == "li":
                close_open(("li",), ("ul", "ol", "menu"))
            elif tag in ("td", "th", "tr"):
                close_open(("td", "th") if tag != "tr" else ("tr",), ("table",))
            elif tag in ("dt", "dd"):
                close_open(("dt", "dd"), ("dl",))
        if tag in VOID or m["more"].endswith("/") and tag not in BLOCKS:
            continue
        kind = _kind(tag, m["more"], depth[ARTICLE] > 0)
        if block or kind != OPEN or depth[ASIDE] or tag in UNSEEN:
            push(tag, kind)
    say(page[at:])
    flush()
    return out


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` with every beginning of ``b``, bits of one number for its places."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    every = (1 << len(b)) - 1
    row = every
    for x in a:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & every
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def shared_places(a: list[int], b: list[int]) -> list[int]:
    """The places in ``a`` of a longest common subsequence with ``b``, in memory in proportion to their lengths."""
    both = set(a) & set(b)
    places, a, b = [i for i, x in enumerate(a) if x in both], [x for x in a if x in both], [x for x in b if x in both]
    if not a:
        return []
    if len(a) == 1:
        return places
    half = len(a) // 2
    ahead, behind = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])[::-1]
    cut = int((ahead + behind).argmax())
    left, right = shared_places(a[:half], b[:cut]), shared_places(a[half:], b[cut:])
    return [places[i] for i in left] + [places[half + i] for i in right]


def host(url: Column) -> Column:
    """A URL's host in lower case, without user and port; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)", 1), F.lit(""))


OUTLINE = "host string, path string, key string, marked boolean, hashes array<long>, sizes array<int>"


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each page that are compared: a hash, and the characters of those that no markup tells apart."""
    for batch in batches:
        marked, hashes, sizes = [], [], []
        for page in batch.column("html").to_pylist():
            found = lines(page)
            compared = [(t, k) for t, k in found if k != ARTICLE]
            marked.append(len(compared) < len(found))
            hashes.append([xxhash.xxh3_64_intdigest(t) - 2**63 for t, _ in compared])
            sizes.append([len(t) if k == OPEN else 0 for t, k in compared])
        columns = [*(batch.column(c) for c in ("host", "path", "key")), pa.array(marked), pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in OUTLINE.split(", ")])


def _compare(stretch: pd.DataFrame, size: int) -> pd.DataFrame:
    """key, shared of the pages of a stretch of ``size`` (not of those it overlaps with): the places of lines that a near page of the host has too."""
    rows, out = list(stretch.sort_values("pos").itertuples()), []
    for i, row in enumerate(rows):
        if row.pos // size != row.stretch:
            continue
        shared: set[int] = set()
        mine = list(row.hashes)
        for j in range(max(0, i - NEAREST), min(len(rows), i + NEAREST + 1)):
            if j == i or rows[j].host != row.host:
                continue
            found = shared_places(mine, list(rows[j].hashes))
            if row.marked or sum(row.sizes[p] for p in found) < COPY * sum(row.sizes):
                shared.update(found)
        out.append((row.key, sorted(shared)))
    return pd.DataFrame(out, columns=["key", "shared"])


def shared_lines(pages: DataFrame) -> DataFrame:
    """key, shared: for each different page of a host the places, among the lines outside its article, of those that near pages share.

    ``pages``: host, path, key, html. Copies within a host (one key) are one page, at the least of their paths. The order of all
    pages is cut into ranges and those into stretches, which overlap by the pages that are compared, so a host may have any number of pages.
    """
    outlines = pages.where("host <> ''").mapInArrow(_outlines, OUTLINE).groupBy("host", "key").agg(F.min("path").alias("path"), F.any_value("marked").alias("marked"), F.any_value("hashes").alias("hashes"), F.any_value("sizes").alias("sizes"))
    different = staged(outlines, "page-outlines")
    ranges = max(1, math.ceil(different.count() / RANGE))
    ordered = different.repartitionByRange(ranges, "host", "path", "key").sortWithinPartitions("host", "path", "key").withColumn("id", F.monotonically_increasing_id())
    placed = staged(ordered.withColumns({"range": F.shiftright("id", 33), "at": F.col("id").bitwiseAND(F.lit(2**33 - 1))}), "page-order")
    counts = placed.groupBy("range").agg(F.count(F.lit(1)).alias("pages"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = counts.select("range", F.coalesce(F.sum("pages").over(before), F.lit(0)).alias("offset"))
    numbered = placed.join(offsets, "range").withColumn("pos", F.col("offset") + F.col("at"))
    size = STRETCH
    stretch = lambda by: F.floor((F.col("pos") + by) / size)
    dealt = numbered.select("host", "key", "marked", "hashes", "sizes", "pos", F.explode(F.sequence(stretch(-NEAREST), stretch(NEAREST))).alias("stretch"))
    return dealt.groupBy("stretch").applyInPandas(lambda pages: _compare(pages, size), "key string, shared array<int>")


def main_text(page: str | None, shared: set[int]) -> str:
    """The article's lines, or if none is marked those that are neither shared nor furniture by markup."""
    found = lines(page)
    if any(k == ARTICLE for _, k in found):
        return "\n".join([t for t, k in found if k == ARTICLE])
    return "\n".join([t for i, (t, k) in enumerate(found) if k == OPEN and i not in shared])


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns and text, n_shared (lines that differencing takes out) of every page.

    ``pages``: url, html. Blocks are joined by one line end; a text has none within a block. Null html is empty and has an empty
    text; pages without a host in their url, null ones included, are compared with none and lose only what markup
    tells; repeated rows and null ids stay, each with its text; a very long page is one row like any other; an empty
    table gives no rows; other columns do not matter.
    """
    row, site = F.struct(*keep).alias("row"), host(F.col("url"))
    keyed = pages.select(row, site.alias("host"), path(F.col("url")).alias("path"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = keyed.withColumn("key", F.md5(F.concat("host", F.lit("\n"), "html").cast("binary")))
    shared = shared_lines(keyed.select("host", "path", "key", "html")).withColumnRenamed("key", "_key")
    joined = keyed.select("row", "key", "html").join(shared, F.col("key") == F.col("_key"), "left").select("row", "html", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = [set(s or ()) for s in batch.column("shared").to_pylist()]
            texts = [main_text(page, s) for page, s in zip(batch.column("html").to_pylist(), shared)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array([len(s) for s in shared], pa.int32())], ["row", "text", "n_shared"])

    made = joined.mapInArrow(run, f"row {joined.schema['row'].dataType.simpleString()}, text string, n_shared int")
    return made.select(*[F.col("row")[c].alias(c) for c in keep], "text", "n_shared")


def op12_webtext(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")
