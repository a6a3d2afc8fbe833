"""Main text of web pages by differencing with the nearest page of the same host.

A page is read into its text lines (one per block, in page order) with their places:
inside an element that is never main text by its tag, role, class or hidden state
(``MARKED``; by class only as a whole token, and not where it holds most of the paragraph
text), inside the article or not, paragraph-like or not.  Pages of a host are
ordered by url path; a page's partner is that of its two neighbours whose path agrees
longer (the earlier one at a tie), unless it is a copy or near copy, which shares over half
of the page's paragraph text and so tells nothing of the frame: then the other one, or none
if that is a copy too.  The lines of both are aligned by a longest common
subsequence, and shared lines are taken for the site's frame and deleted.

The plain method also deletes what two articles of a host quote alike, and copies of a
page delete each other.  So, as the exact check that follows: marked lines are deleted in
any case, lines outside an article (or, without one, ``main``) element too where the page
has one; paragraphs, headings, quotes, lists and tables inside it are kept even when
shared; and a partner that shares every line in question is a copy and tells nothing.
Buttons, labels and hidden or advertising elements inside a block go without ending it.

Rows are dealt to ranges of (host, path) so that a hot host is split; every page is
shuffled once and a task holds the lines of one Arrow batch at a time.

Defined results: a null or empty html, or one without main text, gives an empty text; a
null url counts as a host of its own; repeated rows get equal results; an empty table
gives an empty table; input columns that clash with output names are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shockspark.llm.common import at, fresh, ship, text_or_empty, without
from shockspark.llm.ranges import deal
from shockspark.llm.urlfilter import host_and_path

#: Names of elements, roles and class words.
RAW = "script style noscript template textarea svg math iframe object canvas title select".split()
SKIPPED = set("nav aside footer form menu dialog button label fieldset head".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
MARKED = set("ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup "
             "modal newsletter subscribe signup sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer comment comments "
             "reply replies respond disqus share sharing social related recommended widget login toolbar pagination pager skip".split())
#: Words that only say where or how something stands.
LAYOUT = set("main site page global primary secondary left right top bottom upper lower inner outer box bar container wrapper wrap area block section list "
             "item items slot unit links link buttons header".split())
#: Words that mark together with words of parts, whoever wrote or sold what they name.
STRONG = set("ad ads adsense advert adverts advertisement advertising sponsored comment comments disqus".split())
PARTS = set("post user users reader readers visitor visitors customer google facebook fb body content text entry article c o b m slot zone space "
            "native inline mid thread author form meta count title label".split())
#: Raw elements whose text ends at their end tag or with the page, whatever their tag looks like.
TEXT_ONLY = set("script style textarea title iframe".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
             "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())
HOLDERS = {"li", "td", "th", "dd", "blockquote"}
KEPT_OPEN = BLOCKS - {"hr", "option"}
NOTHING = ("", False, False, False, "", 0)
#: What stands in a tag after its name: a quoted value is read whole, whatever is in it.
INSIDE = r"""(?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+"""
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(" + "|".join(RAW) + rf")(?![\w:-]){INSIDE}>|<(/?)([a-zA-Z][\w:-]*)({INSIDE})>|<[!?][^<>]*>",
                   re.S | re.I)
END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"""([^\s"'/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"']++)))?+""")
#: Elements inside a block that may be marked: by what they are, and by their class.
CONTROLS = {"button", "label"}
INLINE = set("span a b i em strong small font ins mark".split())
INLINE_BY_CLASS = {"span", "a", "small", "ins"}
#: Places of a line.
DROPPED, BARE, OPEN, KEPT = range(4)


def _class_marked(value: str, inline: bool = False) -> bool:
    """Whether a class or id has a token that is a marked word, or marked words together
    with words of layout (not one of several other words, as in "has-sidebar"), adverts and
    comments with words of parts too ("user-comments", "ad-slot-1"); inside a block these only."""
    for token in value.split():
        words = {word for word in re.split(r"[^a-z0-9]+", token) if word and not word.isdigit()}
        if not inline and words & MARKED and words <= MARKED | LAYOUT or words & STRONG and words <= MARKED | STRONG | LAYOUT | PARTS:
            return True
    return False


def _marked(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, bool]:
    """Whether an element is no main text for sure, whether by its class, and whether it is
    the main part."""
    marked, by_class, main = tag in SKIPPED or tag == "header" and not in_article, False, tag == "main"
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if tag in INLINE and name in ("class", "id"):
            by_class |= name == "class" and tag in INLINE_BY_CLASS and _class_marked(value, inline=True)
        elif name in ("class", "id"):
            by_class |= _class_marked(value) or "header" in re.split(r"[^a-z0-9]+", value) and not in_article
        elif name == "role":
            marked |= value in ROLES
            main |= value == "main"
        elif name == "itemprop":
            main |= value == "articlebody"
        elif name == "style":
            marked |= "display:none" in "".join(value.split())
        else:
            marked |= name == "hidden" or name == "aria-hidden" and value == "true" and tag not in INLINE
    free = tag in ("body", "html")
    return marked and not free, by_class and not (free or main or tag == "article"), main


def _tokens(page: str) -> Iterator[tuple[re.Match, int]]:
    """The tags, comments and raw elements of a page, with the place where each ends.  A raw
    element that is closed in its tag, or never, ends at once unless it is text only."""
    position, missing = 0, set()
    while token := TOKEN.search(page, position):
        position, raw = token.end(), (token[1] or "").lower()
        if raw and (raw in TEXT_ONLY or not token[0].endswith("/>")):
            end = None if raw in missing else END[raw].search(page, position)
            if end:
                position = end.end()
            else:
                missing.add(raw)
                position = len(page) if raw in TEXT_ONLY else position
        yield token, position


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, place, whether paragraph-like) of every line of a page."""
    lines: list[list] = []
    stack: list[tuple[str, bool, bool, bool, str, int]] = []  # tag, marked, in article, in main, kind of block, element marked by class
    parent: list[int] = [0]  # of each element marked by class, the one around it
    opened: Counter[str] = Counter()
    parts: list[str] = []
    block = ""
    muted: tuple[str, int] | None = None  # a marked element inside a block: its name, the height of the stack
    within = 0  # elements of that name open in it

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            _, marked, article, main, _, element = stack[-1] if stack else NOTHING
            lines.append([text, marked, article, main, block in PARAGRAPHS, element])

    position = 0
    for token, end in _tokens(page):
        if token.start() > position and not muted:
            parts.append(page[position:token.start()])
        position = end
        tag = (token[3] or "").lower()
        if not tag:
            if token[1] and token[1].lower() == "title":
                flush()
            continue
        if tag == "br":
            parts.append(" ")
        if tag not in BLOCKS:
            if muted and tag == muted[0]:
                within += -1 if token[2] else 1
                muted = muted if within else None
            elif not muted and not token[2] and (tag in CONTROLS or tag in INLINE and token[4].strip()) and not token[4].endswith("/"):
                _, _, article, main, _, _ = stack[-1] if stack else NOTHING
                own, by_class, _ = _marked(tag, token[4], article or main)
                if own or by_class:
                    muted, within = (tag, len(stack)), 1
            continue
        flush()
        if token[2]:
            if opened[tag]:
                while True:
                    ended = stack.pop()[0]
                    opened[ended] -= 1
                    if ended == tag:
                        break
            block = stack[-1][4] if stack else ""
            if muted and len(stack) < muted[1]:
                muted = None  # never closed: it ends with the block around it
        elif tag in KEPT_OPEN:
            if tag == "p" and stack and stack[-1][0] == "p" or tag in ("li", "td", "th", "tr", "dd", "dt") and stack and stack[-1][0] == tag:
                opened[stack.pop()[0]] -= 1  # these end where the next one begins
                if muted and len(stack) < muted[1]:
                    muted = None
            _, marked, article, main, outer, element = stack[-1] if stack else NOTHING
            own, by_class, is_main = _marked(tag, token[4], article or main) if token[4].strip() or tag in SKIPPED or tag in ("header", "main") else (False, False, False)
            if by_class:
                parent.append(element)
                element = len(parent) - 1
            block = tag if tag in PARAGRAPHS else outer if outer in HOLDERS else ""
            stack.append((tag, marked or own, article or tag == "article", main or is_main, block, element))
            opened[tag] += 1
    if not muted:
        parts.append(page[position:])
    flush()
    # an element marked by its class that holds most of the paragraph text is not marked
    held = [0] * len(parent)
    for x in lines:
        if x[4] and not x[1]:
            held[x[5]] += len(x[0])
    total = sum(held)
    for i in range(len(parent) - 1, 0, -1):
        if parent[i]:
            held[parent[i]] += held[i]
    shut = [False] * len(parent)
    for i in range(1, len(parent)):
        shut[i] = shut[parent[i]] or 2 * held[i] <= total
    for x in lines:
        x[1] = x[1] or shut[x[5]]
    inside = 2 if any(x[2] and not x[1] for x in lines) else 3 if any(x[3] and not x[1] for x in lines) else None
    out = []
    for x in lines:
        if x[1] or inside and not x[inside]:
            place = DROPPED
        else:
            place = BARE if not inside else KEPT if x[4] else OPEN
        out.append((x[0], place, x[4]))
    return out


def shared_lines(own: list[str], other: list[str]) -> set[int]:
    """Indexes of the lines of ``own`` in a longest common subsequence with ``other``.

    Equal heads and tails are shared at once.  Between them rows of bits are kept, in which
    a 0 bit marks a column where the common length grows: one row of every block of rows,
    as many rows as blocks, so that memory grows with the lines times the root of the lines;
    the trace back computes the rows of a block anew."""
    head = 0
    while head < min(len(own), len(other)) and own[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(len(own), len(other)) - head and own[-1 - tail] == other[-1 - tail]:
        tail += 1
    found = {*range(head), *range(len(own) - tail, len(own))}
    both = set(own[head:len(own) - tail]) & set(other[head:len(other) - tail])
    rows = [i for i in range(head, len(own) - tail) if own[i] in both]
    columns = [line for line in other[head:len(other) - tail] if line in both]
    where: dict[str, int] = {}
    for line, places in _places(columns).items():
        bits = bytearray(len(columns) // 8 + 1)
        for j in places:
            bits[j >> 3] |= 1 << (j & 7)
        where[line] = int.from_bytes(bits, "little")
    full = (1 << len(columns)) - 1

    def following(v: int, i: int) -> int:
        u = v & where[own[i]]
        return ((v + u) | (v - u)) & full

    size = isqrt(len(rows)) + 1
    starts, v = [], full  # the row before each block
    for n, i in enumerate(rows):
        if n % size == 0:
            starts.append(v)
        v = following(v, i)
    j = len(columns) - 1
    for b in range(len(starts) - 1, -1, -1):
        history = [starts[b]]
        for i in rows[b * size:(b + 1) * size]:
            history.append(following(history[-1], i))
        r = len(history) - 1
        while r and j >= 0:
            if history[r] >> j & 1:
                j -= 1
            elif not history[r - 1] >> j & 1:
                r -= 1
            else:
                found.add(rows[b * size + r - 1])
                r, j = r - 1, j - 1
    return found


def _places(lines: list[str]) -> dict[str, list[int]]:
    places: dict[str, list[int]] = {}
    for j, line in enumerate(lines):
        places.setdefault(line, []).append(j)
    return places


def _agreement(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _copied(lines: list[tuple], shared: set[int]) -> bool:
    """Whether over half of the paragraph text that may be main text is shared."""
    sizes = [len(x[0]) if x[2] and x[1] != DROPPED else 0 for x in lines]
    return 2 * sum(sizes[i] for i in shared) > sum(sizes)


def differenced(page: tuple, before: tuple | None, after: tuple | None) -> tuple[str, int]:
    """The main text of (host, path, lines) given its neighbours in path order, and the
    number of lines that the differencing deleted."""
    host, path, lines = page
    near = [p for p in (before, after) if p and p[0] == host]
    asked = {i for i, x in enumerate(lines) if x[1] in (BARE, OPEN)}
    gone: set[int] = set()
    for partner in sorted(near, key=lambda p: -_agreement(path, p[1])):
        shared = shared_lines([x[0] for x in lines], [x[0] for x in partner[2]])
        if not (asked and _copied(lines, shared)):
            gone = shared
            break
    # the check: article paragraphs come back, all of a copy does, marked lines go
    gone = {i for i in gone if lines[i][1] != KEPT}
    if asked <= gone and not any(x[1] == KEPT for x in lines):
        gone -= asked
    return "\n\n".join(t for i, (t, place, _) in enumerate(lines) if place != DROPPED and i not in gone), len(gone)


def main_text(page: tuple, before: tuple | None, after: tuple | None) -> str:
    return differenced(page, before, after)[0]


def extract_text(df: DataFrame, url: str = "url", html: str = "html", key: str = "page_id", out: str = "text",
                 counted: str | None = None) -> DataFrame:
    """The columns of ``df`` but the html, with the main text of each page as ``out``;
    ``counted`` names an added column with the number of lines that differencing deleted."""
    ship(df.sparkSession)
    order, where = fresh(df, "url_order"), fresh(df, "url_parts")
    host, path = host_and_path(at(url))
    parts = df.withColumn(where, F.struct(host.alias("host"), path.alias("path")))
    blank = "\x01"
    sortable = F.concat_ws(blank, at(where)["host"], at(where)["path"], F.coalesce(at(url), F.lit("")), F.lpad(F.coalesce(at(key).cast("string"), F.lit("")), 20, "0"),
                           F.hex(F.xxhash64(text_or_empty(html))))
    keyed = parts.withColumn(order, sortable).drop(where)
    dealt, part, side = deal(keyed, order, html)
    dealt = dealt.sortWithinPartitions(part, side, order)
    keep = [c for c in without(df, out, *[counted] * bool(counted)).columns if c != html]
    schema = T.StructType([T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(keep)] + [T.StructField("text", T.StringType()), T.StructField("deleted", T.LongType())])
    dealt = dealt.select(*[at(c).alias(f"c{i}") for i, c in enumerate(keep)], at(part).alias("part"), at(side).alias("side"), at(order).alias("order"),
                         at(html).alias("html"))  # plain names for the Arrow batches

    def rows(batch: pa.RecordBatch) -> list[tuple]:
        found = []
        for p, s, k, page in zip(*(batch.column(c).to_pylist() for c in ("part", "side", "order")), batch.column("html")):
            host, path = k.split(blank)[:2]
            found.append((p, s, k, (host, path, lines_of(page.as_py() or ""))))
        return found

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        waiting: tuple | None = None

        def finish(found, batch, following):
            """Texts of a batch's own rows; ``following``: the row after the batch."""
            nonlocal held
            texts, deleted, take = [], [], []
            for i, (p, s, _, page) in enumerate(found):
                if s == 0:
                    before = held[1] if held and held[0] == p else None
                    nxt = found[i + 1] if i + 1 < len(found) else following
                    after = nxt[3] if nxt and nxt[0] == p and nxt[1] >= 0 else None
                    text, n = differenced(page, before, after)
                    texts.append(text)
                    deleted.append(n)
                    take.append(i)
                if s <= 0:
                    held = (p, page)
            own = batch.take(pa.array(take, pa.int64()))
            return pa.RecordBatch.from_arrays([*own.columns[:len(keep)], pa.array(texts, pa.string()), pa.array(deleted, pa.int64())], names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            found = rows(batch)
            if waiting:
                yield finish(*waiting, found[0])
            waiting = (found, batch)
        if waiting:
            yield finish(*waiting, None)

    found = dealt.mapInArrow(extracted, schema)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("text").alias(out), *[F.col("deleted").alias(counted) for _ in range(bool(counted))])
