"""HTML extraction: the main text of pages by differencing each with its nearest pages by URL, and by their elements.

1. Every page is cut into text lines (blocks), each with what its elements say: inside an article or main element, inside a
   menu, footer, sidebar, notice, advert, form, comment section or other furniture, or neither.
2. Pages of one host with the same main lines are copies and count as one. The different ones are ordered by URL path
   within their host (a distributed sort of narrow keys; rows at the ends of its partitions are matched up afterwards), so
   each has a nearest page before and after it, neither of which is a copy.
3. Every page's lines are aligned with those of both by longest common subsequence, and shared lines go: the site's template.

Elements decide where differencing can't: lines in furniture go though no other page has them. Lines inside an article go
only if both neighbours share them, since one shared line can be a quotation, and never for a neighbour that shares half of
the article, which is a near copy. A page outside any article keeps its lines if differencing would leave none of them.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import common

#: Elements that are never main text; elements whose content isn't markup.
FURNITURE = frozenset("nav footer aside form script style noscript template head iframe object svg button select menu dialog fieldset canvas audio video map".split())
RAW = "script|style|textarea|title|noscript|template|iframe|svg"
#: Words of class, id and role that name furniture.
NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription sidebar menu menus navbar nav navigation breadcrumb breadcrumbs footer masthead comment comments disqus respond share sharing social related recommended recommendations widget toolbar login signup search contentinfo complementary dialog".split())
#: Words that add nothing at the end of a compound name (ad-slot, related-posts), so the word before them tells.
PLAIN = frozenset("area bar block body box btn button buttons card container content count frame group heading holder icon icons inner item items label layer link links list message module outer panel placeholder post posts region section slot text thread title unit wrap wrapper zone".split())
#: Words by which a compound says what else is there, not what it is (has-comments, content-with-sidebar).
ABOUT = frozenset("has have no not with without".split())
BY_NAME, BY_ELEMENT = 1, 2
#: Elements that begin and end a block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element that a new one of the group ends, up to the nearest element of the second group.
CLOSED_BY = {"p": (BLOCKS - {"body", "html"}, frozenset("article aside blockquote body dd details div dl fieldset figure footer form header html li main nav ol section table td th ul".split())), "li": (frozenset(["li"]), frozenset("ol ul menu dir".split())), "dt": (frozenset("dt dd".split()), frozenset(["dl"])), "dd": (frozenset("dt dd".split()), frozenset(["dl"])), "td": (frozenset("td th tr tbody".split()), frozenset(["table"])), "th": (frozenset("td th tr tbody".split()), frozenset(["table"])), "tr": (frozenset("tr tbody".split()), frozenset(["table"])), "option": (frozenset("option optgroup".split()), frozenset(["select"]))}
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^<>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>|<[!?][^>]*>", re.I | re.S)
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _named(value: str, in_article: bool) -> bool:
    """Whether a token of a class, id or role names furniture: its last word that isn't PLAIN does. Words are parts in
    letters, camel case is cut; tokens with a word of ABOUT name none."""
    names = NAMES if in_article else NAMES | {"header"}
    for token in value.split():
        words = [w.lower() for w in _WORD.findall(token)]
        if ABOUT.isdisjoint(words):
            while words and words[-1] in PLAIN:
                words.pop()
            if words and words[-1] in names:
                return True
    return False


def _furniture(tag: str, attributes: str, in_article: bool, exempt: bool) -> int:
    """0 for none, BY_NAME for furniture by class, id or role (not looked at where exempt), BY_ELEMENT for other furniture."""
    if tag in FURNITURE or (tag == "header" and not in_article):
        return BY_ELEMENT
    if not attributes:
        return 0
    found = 0
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            if not exempt and (_named(value, in_article) or (name == "role" and value.lower() == "banner")):
                found = found or BY_NAME
            continue
        value = value.lower()
        if (name == "hidden" and value in ("", "hidden")) or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return BY_ELEMENT
    return found


def lines(page: str) -> list[tuple[str, bool, bool]]:
    """(text, in an article, in furniture) of each block with text, in page order; white space in a block is one space.

    Names of class, id and role don't count on html, body, main and an outermost article, nor around a main; where all
    articles are furniture by them, they don't count on or around any outermost article."""
    found = _lines(page, False)
    if any(a for _, a, _ in found) and all(f for _, a, f in found if a):
        found = _lines(page, True)
    return found


def _lines(page: str, any_article: bool) -> list[tuple[str, bool, bool]]:
    """The lines of a page; names around an outermost article count if not any_article."""
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, int]] = [("", False, 0)]  # tag, in an article, in furniture
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, stack[-1][1], stack[-1][2] > 0))
            parts.clear()

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"] and m["raw"].lower() == "title":
                flush()
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            flush()
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if any(x[2] != stack[-1][2] or x[1] != stack[-1][1] for x in stack[k - 1 :]):
                        flush()
                    del stack[k:]
                    break
            continue
        if tag == "br":
            parts.append(" ")
        if tag in VOID:
            continue
        for k in range(len(stack) - 1, 0, -1):
            ended = CLOSED_BY.get(stack[k][0])
            if ended and tag in ended[0]:
                del stack[k:]
                break
            if any(stack[k][0] in scope for _, scope in CLOSED_BY.values()):
                break
        _, article, furniture = stack[-1]
        outermost = tag in ("article", "main") and not article
        article = article or outermost
        if furniture == BY_NAME and outermost and (tag == "main" or any_article):
            furniture = 0
        if not furniture:
            furniture = _furniture(tag, m["attributes"], article, outermost or tag in ("html", "body", "main"))
            if furniture:
                flush()
        if not m["attributes"].endswith("/"):
            stack.append((tag, article, furniture))
    parts.append(page[at:])
    flush()
    return out


#: Parts in which a host's pages meet the lines that most of them have.
SALTS = 256
#: Bits of the table of one alignment that is held whole; larger ones are halved first.
CELLS = 1 << 23


def _last_row(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequence of a with b[:j], for j from 0 to len(b), by one bit-parallel row."""
    where: dict[int, int] = {}
    for k, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << k
    full = row = (1 << len(b)) - 1
    for x in a:
        if x in where:
            u = row & where[x]
            row = ((row + u) | (row - u)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _table(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence with b, from the rows of the whole table."""
    where: dict[int, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    b = [y for y in b if y in where]
    full = (1 << len(a)) - 1
    rows = [full]
    for y in b:
        u = rows[-1] & where[y]
        rows.append(((rows[-1] + u) | (rows[-1] - u)) & full)
    length = lambda i, j: i - (rows[j] & ((1 << i) - 1)).bit_count()
    found, i, j = [], len(a), len(b)
    while i and j:
        here = length(i, j)
        if here == length(i - 1, j):
            i -= 1
        elif here == length(i, j - 1):
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append(i)
    return found


def shared(a: list[int], b: list[int], cells: int = CELLS) -> set[int]:
    """Places in a of a longest common subsequence with b.

    Where the table would have more than cells bits, a is halved and b cut where the halves' lengths add up to most, so
    memory grows with the lines, not with their product."""
    found: set[int] = set()
    open_ = [(0, a, b)]
    while open_:
        at, a, b = open_.pop()
        low = 0
        while low < min(len(a), len(b)) and a[low] == b[low]:
            low += 1
        high = 0
        while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
            high += 1
        found.update(range(at, at + low), range(at + len(a) - high, at + len(a)))
        there = set(b)
        places = [k for k in range(low, len(a) - high) if a[k] in there]
        mine = [a[k] for k in places]
        there = set(mine)
        other = [y for y in b[low : len(b) - high] if y in there]
        if not mine or not other:
            continue
        if len(mine) * len(other) <= cells or len(mine) == 1:
            found.update(at + places[k] for k in _table(mine, other))
            continue
        half = len(mine) // 2
        cut = int(np.argmax(_last_row(mine[:half], other) + _last_row(mine[half:][::-1], other[::-1])[::-1]))
        turn = places[half]
        open_ += [(at + low, a[low:turn], other[:cut]), (at + turn, a[turn : len(a) - high], other[cut:])]
    return found


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


INSIDE, FURNISHED = 1, 2
_PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("same", pa.binary()), ("lines", pa.binary()), ("marks", pa.list_(pa.int8())), ("numbers", pa.list_(pa.int64()))])
_PARSED_DDL = "page_id long, url string, host string, path string, same binary, lines binary, marks array<byte>, numbers array<long>"


def _main(marks: list[int]) -> list[int]:
    """Places of the main lines by the elements: those of the article, or all outside furniture where there is none."""
    inside = [k for k, m in enumerate(marks) if m == INSIDE]
    return inside or [k for k, m in enumerate(marks) if not m & FURNISHED]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page its main lines, packed (they hold no line ends), marks and hashes of all lines, and a hash of the main ones."""
    packed = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in _PARSED}
        size = 0
        for page_id, url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            cut = lines(page or "")
            try:
                at = urlsplit(url or "")
                host, path = at.netloc.lower(), at.path
            except ValueError:
                host, path = "", url
            marks = [INSIDE * inside + FURNISHED * furniture for _, inside, furniture in cut]
            numbers = [_number(t) for t, _, _ in cut]
            main = _main(marks)
            same = hashlib.blake2b(repr([numbers[k] for k in main]).encode(), digest_size=16).digest()
            for c, v in zip(out.values(), (page_id, url, host, path, same, packed("\n".join([cut[k][0] for k in main]).encode()), marks, numbers), strict=True):
                c.append(v)
            size += len(page or "")
            if size > 4 << 20:
                yield pa.RecordBatch.from_pydict(out, schema=_PARSED)
                out, size = {f.name: [] for f in _PARSED}, 0
        yield pa.RecordBatch.from_pydict(out, schema=_PARSED)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (host, path, row): each with the rows before and after; the first and last of a partition are
    marked, for their other neighbour lies elsewhere."""
    schema = pa.schema([("row", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("before", pa.int64()), ("after", pa.int64()), ("edge", pa.bool_())])
    held: list[list] = []
    first = True
    for batch in batches:
        for row, host, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            new = [row, host, path, None, None, first]
            if held and held[-1][1] == host:
                new[3], held[-1][4] = held[-1][0], row
            held.append(new)
            first = False
        if len(held) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held[:-1], strict=True), schema, strict=True)], schema=schema)
            held = held[-1:]
    if held:
        held[-1][5] = True
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def nearest(pages: DataFrame) -> DataFrame:
    """(row, before, after): the rows next to each row of pages (row, host, path) by path within its host, null at the ends."""
    keys = pages.select("row", "host", "path").repartitionByRange("host", "path", "row").sortWithinPartitions("host", "path", "row")
    near = common.keep(keys.mapInArrow(_neighbours, "row long, host string, path string, before long, after long, edge boolean"), "neighbours")
    edges = near.where("edge")  # two rows of each partition of the sort
    along = Window.orderBy("host", "path", "row")
    same = lambda shift: F.when(shift("host", 1).over(along) == F.col("host"), shift("row", 1).over(along))
    edges = edges.withColumn("before", F.coalesce("before", same(F.lag))).withColumn("after", F.coalesce("after", same(F.lead)))
    return near.where("not edge").unionByName(edges).select("row", "before", "after")


def usual(unlike: DataFrame) -> DataFrame:
    """(row, usual): the lines that over half of all pages of the host of a row of unlike (row, host, marks, numbers) have
    inside an article.

    A host has at most twice as many such lines as a page has on average. They meet its pages by host and one of SALTS
    parts of them, so a host with very many pages isn't in one task."""
    inside = F.array_distinct(F.filter("numbers", lambda _, k: F.get("marks", k) == INSIDE))
    pages = unlike.groupBy("host").agg(F.count("*").alias("pages")).where("pages > 2")  # fewer pages have no two neighbours
    counts = unlike.select("host", F.explode(inside).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where("n > 1")
    lines_of = counts.join(pages, "host").where("2 * n > pages").groupBy("host").agg(F.collect_list("line").alias("usual"))
    parts = unlike.select("row", "host", F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("part"))
    return parts.join(parts.select("host", "part").distinct().join(lines_of, "host"), ["host", "part"]).select("row", "usual")


def kept(marks: list[int], numbers: list[int], others: list[list[int]], usual: list[int] | None = None) -> list[int]:
    """Places of the lines that stay, given the lines of the nearest pages before and after (those that exist) and those
    that most pages of the host have inside their articles."""
    main = _main(marks)
    found = [shared(numbers, other) for other in others]
    if main and marks[main[0]] == INSIDE:
        templates = [f for f in found if 2 * len(f.intersection(main)) < len(main)]
        both = templates[0] & templates[1] if len(templates) == 2 else set()
        most = set(usual or ())
        return [k for k in main if k not in both or numbers[k] not in most]
    either = set().union(*found)
    return [k for k in main if k not in either] or main


def _differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpacked = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        page_id, url, packed, marks, mine, most, before, after = (c.to_pylist() for c in batch.columns)
        text = []
        for p, m, x, u, *others in zip(packed, marks, mine, most, before, after, strict=True):
            line = dict(zip(_main(m), unpacked(p).decode().split("\n"), strict=False))
            text.append("\n\n".join([line[k] for k in kept(m, x, [y for y in others if y is not None], u)]))
        yield pa.RecordBatch.from_arrays([pa.array(page_id, pa.int64()), pa.array(url, pa.string()), pa.array(text, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html): the main text, blocks joined by a blank line.

    Null and empty html give an empty text; null urls are one host; a page whose host has no other text loses only what its
    elements name; repeated rows stay, each with the same text; among equal paths the order is that of the line hashes; other columns aren't read; an empty table gives an empty table."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = rows.mapInArrow(_parse, _PARSED_DDL)
    # copies within a host are one; texts stay out of this table
    unlike = parsed.select("host", "same", F.struct("path", "numbers", "marks").alias("first")).groupBy("host", "same").agg(F.min("first").alias("first"))
    unlike = common.keep(unlike.select("host", "same", "first.*").withColumn("row", F.monotonically_increasing_id()), "unlike")
    lines_of = lambda name: unlike.select(F.col("row").alias(name), F.col("numbers").alias(f"{name}_lines"))
    near = nearest(unlike).join(lines_of("before"), "before", "left").join(lines_of("after"), "after", "left")
    near = near.join(usual(unlike), "row", "left").join(unlike.select("row", "host", "same"), "row").select("host", "same", "usual", "before_lines", "after_lines")
    pairs = parsed.join(near, ["host", "same"], "left").select("page_id", "url", "lines", "marks", "numbers", "usual", "before_lines", "after_lines")
    done = pairs.mapInArrow(_differenced, "page_id long, url string, text string")
    return done.withColumn("n_chars", F.char_length("text").cast("long"))
