"""Main text of web pages by deduced templates.

The markup tokens of a page (tags with their class and id, digits masked) and its text runs
outside the article get an occurrence count per page. Tokens of a host with the same vector of
counts over its pages of one layout form an equivalence class; pages without tokens do not count.
Vectors are never gathered: a class is known by
sums of hashes that each page adds to. A class with enough tokens and pages is valid if on most of
them its tokens stand in the same order, round after round, and each round lies in the same slot
of the class around it (a slot is what lies between two tokens of a class). The valid classes are the
template. Data inside a slot can neither close a template element nor leave one open, and text
that belongs to a class is template. Which slots are main text is told by tags and class names:
the articles, or where they hold no text the body, without menus, forms, adverts and the like.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.session import cut_lineage

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\s*=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Fixed values of HTML: elements without content, of raw text, of running text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title template iframe svg select canvas".split())
INLINE = frozenset("a abbr annotation b bdi bdo big cite code data del dfn em font i ins kbd label maction math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle "
                   "msub msubsup msup mtable mtd mtext mtr munder munderover mark noscript object q s samp semantics small span strike strong sub sup time tt u var wbr".split())
SECTIONING = frozenset("article main".split())
CLOSED_BY_BLOCK = frozenset(["p"])

#: Elements and words that mark what is not main text. A class, id or role marks an element if the
#: whole name consists of such words, at most with words of PLAIN_WORDS beside them.
OUTSIDE = frozenset("nav footer aside form button dialog menu head".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer masthead comment comments reply "
    "replies respond disqus discussion share sharing social related recommended newsletter subscribe subscription signup login search "
    "pagination pager toolbar contentinfo complementary".split())
PAGE_HEADER = frozenset(["header"])
PLAIN_WORDS = frozenset(
    "area articles bar block bottom box button buttons container content form global group icons inner item items left link links list main "
    "media outer page pages panel post posts primary right secondary section site slot stories top unit wrap wrapper".split())
#: Elements that no name marks: those that hold the main text, headings and paragraphs.
UNMARKED = frozenset("html body main article h1 h2 h3 h4 h5 h6 p".split())

#: Pages are dealt to so many kinds by hash; text counts as template if pages of this many kinds repeat it.
PAGE_KINDS = 63
LEAST_PAGES = 8
#: Tokens of a class from which on it can be a template.
LEAST_TOKENS = 3
#: Share of a layout's pages that a class needs to be a template, and share of a class's pages that
#: its order and slot must exceed.
LEAST_SHARE = 0.5
#: Bits of each of the two hashes that a page adds to a vector. A task's sums fit 64 bits, those of all pages
#: are decimals.
VECTOR_BITS = 38
#: Tokens that a task holds before it sends what it has summed.
HELD_TOKENS = 100_000


def _key(label: str) -> int:
    return xxhash.xxh64_intdigest(label) >> 1


def _text_key(text: str) -> int:
    return _key(f"#{' '.join(text.split())}")


def _named(value: str, marking: frozenset) -> bool:
    for name in value.split():
        words = {w.lower() for w in NAME_WORD.findall(name)}
        if words & marking and words <= marking | PLAIN_WORDS:
            return True
    return False


class Tag:
    __slots__ = ("name", "close", "label", "key", "end", "outside", "named", "anchor", "header")

    def __init__(self, name: str, close: bool, attributes: str):
        self.name, self.close = name, close
        self.label, self.header = f"</{name}>" if close else f"<{name}>", False
        self.outside = self.named = self.anchor = False  # by element, by class or role, by id
        if not close:
            self._read(name, attributes)
        self.key, self.end = _key(self.label), _key(f"</{name}>")

    def _read(self, name: str, attributes: str) -> None:
        self.outside = name in OUTSIDE
        self.header = name in PAGE_HEADER
        if attributes and attributes != "/":
            marks = []
            for key, *values in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), "".join(values)
                if key in ("class", "id", "role"):
                    if name not in UNMARKED:
                        if _named(value, OUTSIDE_WORDS):
                            self.anchor |= key == "id"
                            self.named |= key != "id"
                        self.header |= _named(value, PAGE_HEADER)
                    marks.append(f"{key}={re.sub(r'[0-9]+', '0', value)}")
                elif name not in ("html", "body") and (key == "hidden" or (key == "aria-hidden" and value == "true") or (
                        key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))):
                    self.outside = True
            if marks:
                self.label = f"<{name} {' '.join(marks)}>"


_tags: dict[tuple, Tag] = {}
NO_TEMPLATE: dict[int, int] = {}


def _tag(name: str, close: str, attributes: str) -> Tag:
    key = (name, close, attributes if len(attributes) < 80 else None)
    if key[2] is None:
        return Tag(name, bool(close), attributes)
    found = _tags.get(key)
    if found is None:
        if len(_tags) > 20_000:
            _tags.clear()
        found = _tags[key] = Tag(name, bool(close), attributes)
    return found


def tokens(html: str):
    """Tags and text runs (str) in page order; comments and raw text elements are left out."""
    at, end = 0, len(html)
    while at < end:
        found = TOKEN.search(html, at)
        if found is None:
            yield html[at:]
            return
        if found.start() > at:
            yield html[at:found.start()]
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if not found[0].endswith(">"):
            return  # the page ends inside a tag
        if name in RAW:
            if not found[1] and not found[3].endswith("/"):
                close = re.compile(rf"</{re.escape(name)}(?![a-z0-9])[^>]*>?", re.IGNORECASE).search(html, at)
                at = close.end() if close else end
            continue
        yield _tag(name, found[1], found[3])


def runs(html: str, template: dict[int, int] = NO_TEMPLATE):
    """(tag, text, outside, in article) in page order: one of tag and text is given. Outside is 2
    in an element that is no main text, 1 in one that only a name marks, else 0. A name marks
    nothing around <main>, and inside articles, where ids are anchors, an id only does in the template.

    `template` holds the class of each template token; an element whose both tags are tokens of one
    class is closed by nothing else.
    """
    stack: list[tuple[str, int, bool, bool]] = []  # name, outside, article, fixed
    outside, article = [0, 0, 0], 0

    def level() -> int:
        return 2 if outside[2] else 1 if outside[1] else 0

    def closed(to: int) -> None:
        nonlocal article
        while len(stack) > to:
            _, out, art, _ = stack.pop()
            outside[out] -= 1
            article -= art

    for token in tokens(html):
        if isinstance(token, str):
            yield None, token, level(), article > 0
            continue
        name = token.name
        fixed = token.key in template and template[token.key] == template.get(token.end)
        if token.close:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name and (fixed or not stack[i][3]):
                    closed(i)
                    break
                if stack[i][3] and not fixed:
                    break
        else:
            if name not in INLINE and name != "br":
                for i in range(len(stack) - 1, -1, -1):  # an open paragraph ends where a block begins
                    if stack[i][0] in CLOSED_BY_BLOCK:
                        closed(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
            if name not in VOID and (name not in INLINE or token.outside or token.named or token.anchor):
                if name == "main" and outside[1]:
                    stack[:] = [(n, 0 if out == 1 else out, art, fix) for n, out, art, fix in stack]
                    outside[1] = 0
                if token.outside or (token.header and not article and name in PAGE_HEADER):
                    out = 2
                else:
                    out = int(token.named or (token.header and not article) or (token.anchor and (not article or token.key in template)))
                art = name in SECTIONING
                stack.append((name, out, art, fixed))
                outside[out] += 1
                article += art
        yield token, None, level(), article > 0


def main_text(html: str, template: dict[int, int] = NO_TEMPLATE) -> str:
    """Blocks of the articles, joined by line ends; of the body, where the articles outside menus,
    comments and the like hold no text; of articles inside what only a name marks, where all else is empty."""
    kinds = ("article", "body", "named")
    chosen = {kind: [] for kind in kinds}
    current = {kind: [] for kind in kinds}

    def close() -> None:
        for kind in kinds:
            if current[kind]:
                block = " ".join(unescape("".join(current[kind])).split())
                if block:
                    chosen[kind].append(block)
                current[kind] = []

    for tag, text, outside, article in runs(html, template):
        if tag is not None:
            if tag.name not in INLINE:
                close()
        elif outside:
            if article and outside == 1:
                current["named"].append(text)
        else:
            if article:
                current["article"].append(text)
            elif not (template and text.strip() and _text_key(text) in template):
                current["body"].append(text)
    close()
    return "\n".join(next(filter(None, chosen.values()), ()))


def page_tokens(html: str):
    """(key, is markup) of a page's tokens in page order."""
    for tag, text, outside, article in runs(html):
        if tag is not None:
            if tag.name not in INLINE:
                yield tag.key, True
        elif not outside and not article and not text.isspace():
            yield _text_key(text), False


def read_classes(keys: list[int], classes: dict[int, int], rank: dict[int, int]) -> dict[int, tuple | None]:
    """class -> (its tokens in order, token before the slot it lies in, -1 outside all) of one page.

    None marks a class whose rounds differ in order or in their slot, or one that crosses a class
    of lower rank.
    """
    held: dict[int, list] = {}
    at = [(key, classes[key]) for key in keys if key in classes]
    for key, cls in at:
        held.setdefault(cls, []).append(key)
    found: dict[int, tuple | None] = {}
    place: dict[int, int] = {}
    size: dict[int, int] = {}
    for cls, seen in held.items():
        n = size[cls] = len(set(seen))
        if len(seen) % n or seen != seen[:n] * (len(seen) // n):
            found[cls] = None
        else:
            found[cls] = (tuple(seen[:n]), None)
            place.update((key, i) for i, key in enumerate(seen[:n]))
    stack: list[list] = []  # class, its last token
    for key, cls in at:
        if found[cls] is None:
            continue
        if place[key] == 0:
            slot = stack[-1][1] if stack else -1
            tokens, known = found[cls]
            if known is not None and known != slot:
                found[cls] = None
                continue
            found[cls] = (tokens, slot)
            stack.append([cls, key])
        else:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == cls), None)
            if i is None:
                continue
            if any(rank[other] < rank[cls] for other, _ in stack[i + 1:]):
                found[cls] = None
                del stack[i]
                continue
            for other, _ in stack[i + 1:]:
                found[other] = None
            del stack[i + 1:]
            stack[i][1] = key
        if place[key] == size[cls] - 1:
            stack.pop()
    return found


def host_of(url):
    """Column expression: lower-case host of an address, empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _rows(rows: list, schema: pa.Schema):
    for low in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows[low:low + 10_000]), schema)], schema=schema)


def layout_of(html):
    """Column expression: the body tag with digits masked and the names of the sectioning elements.
    It only parts a host's pages into groups, so a tag inside a comment does no harm."""
    body = F.regexp_replace(F.regexp_extract(html, r"(?i)<body\b[^>]*", 0), r"[0-9]+", "0")
    parts = F.array_sort(F.array_distinct(F.transform(
        F.regexp_extract_all(html, F.lit(r"(?i)<(article|main|header|nav|aside|footer)\b"), 1), F.lower)))
    return F.coalesce(F.xxhash64(body, F.array_join(parts, " ")), F.lit(0))


def token_classes(pages: DataFrame) -> DataFrame:
    """(host, layout, classes): the tokens of each class of equal vectors with enough tokens and
    pages, the most common class first.

    Tasks send one row per host, layout and token (again for each HELD_TOKENS of them), not one per page, and
    all of it adds up: counts, sums, the bits of the kinds of pages, the smallest and largest page hash. Only
    tokens that a large share of a layout's pages hold are gathered, so the classes are bounded by the
    tokens of its pages. Copies of a page weigh as much as they occur, but are one kind of page for text.
    """
    schema = pa.schema([("host", pa.string()), ("layout", pa.int64()), ("token", pa.int64()), ("markup", pa.bool_()), ("pages", pa.int64()), ("low", pa.int64()),
                        ("high", pa.int64()), ("kinds", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
    mask = (1 << VECTOR_BITS) - 1

    def run(batches):
        seen: dict[tuple, list] = {}
        for batch in batches:
            for host, layout, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                html = html.as_py() or ""
                counts = Counter(page_tokens(html))
                if not counts:
                    continue
                page = xxhash.xxh64_intdigest(html.encode("utf-8", "replace")) >> 1
                counts[-1, True] = 1  # the page itself
                marks = {n: xxhash.xxh3_128_intdigest(f"{page}:{n}") for n in set(counts.values())}
                for (key, markup), n in counts.items():
                    held = seen.setdefault((host, layout, key, markup), [0, 0, 0, 0, page, page])
                    held[0] += 1
                    held[1] += marks[n] & mask
                    held[2] += marks[n] >> VECTOR_BITS & mask
                    held[3] |= 1 << page % PAGE_KINDS
                    held[4], held[5] = min(held[4], page), max(held[5], page)
            if len(seen) > HELD_TOKENS:
                yield from _rows([(*unit, *held) for unit, held in seen.items()], schema)
                seen = {}
        yield from _rows([(*unit, *held) for unit, held in seen.items()], schema)

    found = pages.mapInArrow(run, "host string, layout bigint, token bigint, markup boolean, pages bigint, low bigint, high bigint, kinds bigint, first bigint, last bigint")
    found = cut_lineage(found.groupBy("host", "layout", "token").agg(
        F.max("markup").alias("markup"), F.sum("pages").alias("pages"), *(F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("low", "high")),
        F.when(F.min("first") == F.max("last"), 1).otherwise(F.greatest(F.lit(2), F.bit_count(F.bit_or("kinds")))).alias("different")))
    sizes = found.where("token = -1").select("host", "layout", F.col("pages").alias("all"))
    # text counts only where many pages repeat it
    common = found.where("token >= 0").join(sizes, ["host", "layout"]).where(
        (F.col("pages") >= LEAST_SHARE * F.col("all")) & (F.col("different") >= F.when(F.col("markup"), 2).otherwise(LEAST_PAGES)))
    classes = common.groupBy("host", "layout", "pages", "low", "high").agg(F.sort_array(F.collect_list("token")).alias("tokens")).where(
        F.size("tokens") >= LEAST_TOKENS)
    return classes.groupBy("host", "layout").agg(
        F.sort_array(F.collect_list(F.struct("pages", F.size("tokens").alias("n"), "tokens")), asc=False).alias("classes")).select(
        "host", "layout", F.col("classes.tokens").alias("classes"))


def deduce_templates(pages: DataFrame) -> DataFrame:
    """(host, layout, template): the valid classes of each layout with any, tokens in order.

    Tasks send one row per class and order, with the number of their pages.
    """
    classes = cut_lineage(token_classes(pages))
    schema = pa.schema([("host", pa.string()), ("layout", pa.int64()), ("cls", pa.int64()), ("tokens", pa.list_(pa.int64())), ("slot", pa.int64()), ("pages", pa.int64())])

    def run(batches):
        for batch in batches:
            held = _Held()
            seen: Counter = Counter()
            for host, layout, html, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                classes = held(tokens)
                rank = {cls: i for i, cls in enumerate(dict.fromkeys(classes.values()))}
                for cls, read in read_classes([key for key, _ in page_tokens(html.as_py() or "")], classes, rank).items():
                    seen[(host, layout, cls, *(read or ((), -1)))] += 1
            yield from _rows([(*order, n) for order, n in seen.items()], schema)

    read = pages.join(classes, ["host", "layout"]).select("host", "layout", "html", "classes").mapInArrow(
        run, "host string, layout bigint, cls bigint, tokens array<bigint>, slot bigint, pages bigint")
    orders = read.groupBy("host", "layout", "cls", "tokens", "slot").agg(F.sum("pages").alias("pages"))
    valid = orders.groupBy("host", "layout", "cls").agg(
        F.max_by("tokens", F.struct("pages", "tokens")).alias("tokens"), F.max("pages").alias("most"), F.sum("pages").alias("pages")).where(
        (F.size("tokens") > 0) & (F.col("most") > LEAST_SHARE * F.col("pages")))
    return valid.groupBy("host", "layout").agg(F.sort_array(F.collect_list("tokens")).alias("template"))


class _Held:
    """Lists of classes as token -> class; a class is named by its smallest token."""

    def __init__(self):
        self.known: dict[tuple, dict] = {}

    def __call__(self, classes) -> dict[int, int]:
        classes = tuple(map(tuple, classes.as_py() or ()))
        if classes not in self.known:
            if len(self.known) > 1000:
                self.known.clear()
            self.known[classes] = {key: min(cls) for cls in classes for key in cls}
        return self.known[classes]


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page. Null or empty html gives an empty text.

    The templates are written first, so that the planner knows their size: it broadcasts them if
    they are small, else joins by host, where it splits a hot host. Pages of a host with fewer tokens
    in common than a template needs are read without one.
    """
    html = F.col("html").cast("string")
    rows = pages.select(host_of(F.col("url")).alias("host"), layout_of(html).alias("layout"), html.alias("html"),
                        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    templates = cut_lineage(deduce_templates(rows.select("host", "layout", "html")))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        held = _Held()
        for batch in batches:
            texts = [main_text(html.as_py() or "", held(classes)) for html, classes in zip(batch.column(0), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=schema)

    return rows.join(templates, ["host", "layout"], "left").select("html", "page_id", "url", "template").mapInArrow(
        run, "page_id bigint, url string, text string, n_chars bigint")
