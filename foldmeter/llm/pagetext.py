"""Main text of HTML pages by equivalence classes of page tokens.

Tokens are the opening and closing tags of block elements and whole text nodes, told apart by their path of elements.
For each host, tokens with the same occurrence vector (the same number of times on the same pages) form a class; a vector
is compared by its page count, its total and two exclusive ors of hashes of (page, times), so it never has to be held.  A
class is large and frequent enough to be template if it has ``least_size`` tokens and stands on ``least_pages`` different
pages and on ``share`` of the host's.  It is valid if its tokens follow each other in one order on all pages and, as
brackets, nest with the other classes, always in the same slot of the same parent.  The valid classes, nested, are the
host's template; what stands between two neighbouring template tokens is a slot.

Of the slots the article is kept: those inside article elements, or, where a page has none, in elements labelled as its
content, or else slots that are not template text and not mostly links; never those below navigation, page headers, footers,
sidebars, forms, notices, adverts, comments, scripts and styles.  Text inside an article is data however often it recurs, so
copies of one article on a host stay whole.

Only hashes of tokens are written and shuffled, pre-aggregated per host and token; page sources are not.  A template has
fewer than (mean tokens of a page) / share tokens.  A page is parsed in one row, in linear time.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmeter.llm.urls import host_of
from foldmeter.session import broadcast_if_small, cut_lineage

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var".split()
)
CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("html body article main section div table ul ol dl form aside nav footer header blockquote td th".split())

#: Elements that are never article text, and labels (words of class, id or role) that say the same.
ASIDE_TAGS = frozenset("head script style title noscript template nav footer aside form iframe textarea select button svg math object canvas audio video dialog menu xmp noembed noframes".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices alert menu nav navbar navigation breadcrumb breadcrumbs sidebar aside comment comments disqus respond "
    "reply replies share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay "
    "footer contentinfo complementary toolbar pagination pager widget".split()
)
HEADER_WORDS = frozenset("header masthead topbar".split())
CONTENT_WORDS = frozenset("article content main post entry story".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|[^<]+|<",
    re.S,
)
LABEL = re.compile(r"""(?<![\w-])(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(1 << 16)
def _key(*parts) -> int:
    return int.from_bytes(blake2b(repr(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@lru_cache(1 << 14)
def _label_words(attributes: str) -> frozenset:
    return frozenset(w.lower() for m in LABEL.finditer(attributes) for w in WORD.findall(m.group(1)))


class Element:
    """An open element: its path, and whether it is beside the article, in an article, in labelled content, in a link."""

    __slots__ = ("tag", "path", "aside", "article", "content", "link")

    def __init__(self, tag: str, words: frozenset, parent: Element | None):
        inline = tag in INLINE
        above = parent.path if parent else 0
        self.tag = tag
        self.path = above if inline else _key(above, tag, tuple(sorted(words & (ASIDE_WORDS | HEADER_WORDS | CONTENT_WORDS))))
        self.link = tag == "a" or bool(parent and parent.link)
        labelled = bool(words & ASIDE_WORDS) and tag not in ("html", "body", "main")
        starts = tag in ("article", "main") and not labelled
        self.article = starts or bool(parent and parent.article)
        header = (tag == "header" or bool(words & HEADER_WORDS)) and tag not in ("html", "body") and not self.article
        own = labelled or tag in ASIDE_TAGS or header
        # an article does not lie inside a menu or an advert: one that was never closed ends here
        self.aside = own or (bool(parent and parent.aside) and not starts)
        self.content = bool(words & CONTENT_WORDS) and not inline or bool(parent and parent.content)


def parse(source: str):
    """The page's tokens and text nodes in page order.

    Yields ("tag", key, None, None) for block tags and breaks, and ("text", key, words, element) for text nodes with words.
    """
    stack: list[Element] = []
    names: Counter = Counter()

    def pop(n: int):
        for e in stack[n:]:
            names[e.tag] -= 1
            if e.tag not in INLINE:
                yield "tag", _key(e.path, "/"), None, None
        del stack[n:]

    def innermost(tags, scopes=frozenset()):
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in scopes:
                return None
        return None

    at, size = 0, len(source)
    while at < size:
        m = TOKEN.match(source, at)
        at = m.end()
        closing, tag, attributes = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
        if tag is None:
            piece = m.group()
            if not piece.startswith(("<!", "<?")):
                text = html.unescape(piece)
                if text and not text.isspace():
                    top = stack[-1] if stack else None
                    words = " ".join(text.split())
                    yield "text", _key(top.path if top else 0, "text", words), text, top
                elif text:
                    yield "text", None, " ", stack[-1] if stack else None
            continue
        tag = tag.lower()
        inline = tag in INLINE
        if closing:
            if names[tag]:
                i = innermost({tag}, SCOPES if inline or tag == "p" else frozenset())
                if i is not None:
                    yield from pop(i)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                yield "tag", None, None, None
            continue
        if not inline and names["p"] and tag not in RAW:
            i = innermost({"p"}, SCOPES)
            if i is not None:
                yield from pop(i)
        if tag in CLOSES_ITSELF and any(names[t] for t in CLOSES_ITSELF[tag]):
            i = innermost(CLOSES_ITSELF[tag], {"ul", "ol", "dl", "table", "select"})
            if i is not None:
                yield from pop(i)
        element = Element(tag, _label_words(attributes), stack[-1] if stack else None)
        if tag in RAW:
            end = re.compile(rf"</{tag}[^>]*>", re.I).search(source, at)
            at = end.end() if end else size
            continue
        if attributes.endswith("/") and tag not in INLINE and tag in ("svg", "math", "path"):
            continue
        stack.append(element)
        names[tag] += 1
        if not inline:
            yield "tag", _key(element.path, "<"), None, None
    yield from pop(0)


def page_tokens(source: str) -> list[int]:
    return [key for _, key, _, _ in parse(source) if key is not None]


def article_text(source: str, template: frozenset = frozenset()) -> str:
    """The article's text; ``template`` holds the keys of the host's template tokens."""
    pieces, slot, links = [], 0, Counter()
    articles = contents = False
    for kind, key, text, element in parse(source):
        known = key is not None and key in template
        if kind == "tag":
            pieces.append(None)
            slot += known
            continue
        if known:
            slot += 1
        aside = bool(element and element.aside)
        linked = bool(element and element.link)
        mark = (bool(element and element.article), bool(element and element.content))
        if not aside:
            if key is not None:
                articles |= mark[0]
                contents |= mark[1]
                links[slot, linked] += len(text)
            pieces.append((text, mark, slot, known))
        if known:
            slot += 1
    blocks, block = [], []
    for piece in [*pieces, None]:
        if piece is None:
            words = "".join(block).split()
            if words:
                blocks.append(" ".join(words))
            block = []
            continue
        text, (article, content), place, known = piece
        if articles:
            keep = article
        elif contents:
            keep = content
        else:
            keep = not known and links[place, True] <= links[place, False]
        if keep:
            block.append(text)
    return " ".join(blocks)


def class_orders(tokens: list[int], classes: dict[int, int]) -> dict[int, tuple[list[int], int, int]]:
    """Per class on one page: its tokens in order, the parent class (-1 for none) and the parent's slot; parent -2 if invalid."""
    seen: dict[int, list[int]] = {}
    for t in tokens:
        if t in classes:
            seen.setdefault(classes[t], []).append(t)
    found, bad = {}, set()
    for c, order in seen.items():
        k = len(set(order))
        if len(order) % k or order != order[:k] * (len(order) // k):
            bad.add(c)
        found[c] = order[:k]
    place = {t: i for c, order in found.items() for i, t in enumerate(order)}
    parents: dict[int, tuple[int, int]] = {}
    stack: list[list[int]] = []
    for t in tokens:
        c = classes.get(t)
        if c is None or c in bad:
            continue
        if place[t] == 0:
            parent = (stack[-1][0], stack[-1][1]) if stack else (-1, 0)
            if parents.setdefault(c, parent) != parent:
                parents[c] = (-2, 0)
            stack.append([c, 0])
        while stack and stack[-1][0] != c and any(s[0] == c for s in stack):
            bad.add(stack.pop()[0])  # opened inside c and still open where c goes on
        if stack and stack[-1][0] == c:
            stack[-1][1] = place[t]
            if place[t] == len(found[c]) - 1:
                stack.pop()
    return {c: (found[c], *((-2, 0) if c in bad else parents.get(c, (-2, 0)))) for c in found}


def _signed(x: bytes) -> int:
    return int.from_bytes(blake2b(x, digest_size=8).digest(), "little", signed=True)


def _tokens_of(batches):
    for batch in batches:
        sources = [s or "" for s in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([_signed(s.encode()) for s in sources], pa.int64()),
                pa.array([page_tokens(s) for s in sources], pa.list_(pa.int64())),
            ],
            names=["host", "page", "tokens"],
        )


def _times(batches):
    for batch in batches:
        host, page = batch.column(0), batch.column(1)
        for i, tokens in enumerate(batch.column(2)):
            keys, n = np.unique(np.asarray(tokens.values, np.int64), return_counts=True)
            rows = pa.array(np.full(len(keys), i))
            yield pa.RecordBatch.from_arrays([host.take(rows), page.take(rows), pa.array(keys), pa.array(n)], names=["host", "page", "token", "n"])


def _orders(batches):
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            classes = dict(zip(row["members"], row["classes"]))
            for c, (order, parent, slot) in class_orders(row["tokens"], classes).items():
                out.append({"host": row["host"], "class": c, "order": order, "parent": parent, "slot": slot})
        schema = pa.schema([("host", pa.string()), ("class", pa.int32()), ("order", pa.list_(pa.int64())), ("parent", pa.int32()), ("slot", pa.int32())])
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _extract(batches):
    for batch in batches:
        sources, members = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        texts = [article_text(s or "", frozenset(m or ())) for s, m in zip(sources, members)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])


def host_templates(pages: DataFrame, least_pages: int = 4, share: float = 0.8, least_size: int = 3) -> DataFrame:
    """``pages`` (host, html) to one row per host with a template: ``members`` (its tokens) and ``nesting`` (class, parent, slot).

    A page counts once however many copies of it a host has.
    """
    parsed = cut_lineage(pages.select("host", "html").mapInArrow(_tokens_of, "host string, page long, tokens array<long>").dropDuplicates(["host", "page"]))
    per_host = parsed.groupBy("host").agg(F.count("*").alias("host_pages"))
    seen = parsed.mapInArrow(_times, "host string, page long, token long, n long").groupBy("host", "token")
    stats = seen.agg(
        F.count("*").alias("pages"),
        F.sum("n").alias("total"),
        F.bit_xor(F.xxhash64("page", "n")).alias("one"),
        F.bit_xor(F.xxhash64("n", "page", F.lit(1))).alias("two"),
    )
    frequent = stats.filter(F.col("pages") >= least_pages).join(broadcast_if_small(cut_lineage(per_host)), "host")
    frequent = frequent.filter(F.col("pages") >= share * F.col("host_pages"))
    classes = frequent.groupBy("host", "pages", "total", "one", "two").agg(F.sort_array(F.collect_list("token")).alias("members"))
    classes = classes.filter(F.size("members") >= least_size)
    per_host = classes.groupBy("host").agg(F.sort_array(F.collect_list("members")).alias("all"))
    numbered = F.transform("all", lambda m, i: F.transform(m, lambda _: i.cast("int")))
    proposed = cut_lineage(per_host.select("host", F.flatten("all").alias("members"), F.flatten(numbered).alias("classes")))
    on_pages = parsed.join(broadcast_if_small(proposed), "host").mapInArrow(
        _orders, "host string, class int, order array<long>, parent int, slot int"
    )
    judged = on_pages.groupBy("host", "class").agg(
        F.min("order").alias("order"),
        F.max("order").alias("other"),
        *[f(c).alias(f"{f.__name__}_{c}") for c in ("parent", "slot") for f in (F.min, F.max)],
    )
    valid = judged.filter("order = other and min_parent = max_parent and min_slot = max_slot and min_parent > -2")
    # a class inside one that is not valid hangs on nothing, but its own order still holds: it stays, as a root
    rows = F.struct("class", "order", F.col("min_parent").alias("parent"), F.col("min_slot").alias("slot"))
    whole = valid.groupBy("host").agg(F.sort_array(F.collect_list(rows)).alias("tree"))
    nesting = F.transform("tree", lambda c: F.struct(c["class"].alias("class"), c.parent.alias("parent"), c.slot.alias("slot")))
    return whole.select("host", F.flatten("tree.order").alias("members"), nesting.alias("nesting"))


def main_text(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    least_pages: int = 4,
    share: float = 0.8,
    least_size: int = 3,
) -> DataFrame:
    """Per row of ``pages``: id, url and ``text``, the article's blocks in page order joined by one space; empty if none.

    A null or empty page has no text; a null url, or one without a host, shares the empty host.  Repeated rows are each
    returned.  Pages of hosts without a template (too few pages) are read by their own elements.  Other columns are ignored,
    whatever their names.  White space is what Unicode calls so; character references are decoded.
    """
    id_kind, url_kind = (docs_type.simpleString() for docs_type in (pages.schema[id_column].dataType, pages.schema[url_column].dataType))
    rows = pages.select(
        F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"), host_of(F.col(url_column)).alias("host")
    )
    templates = cut_lineage(host_templates(rows, least_pages, share, least_size).select("host", "members"))
    joined = rows.join(broadcast_if_small(templates), "host", "left").select("id", "url", "html", "members")
    found = joined.mapInArrow(_extract, f"id {id_kind}, url {url_kind}, text string")
    return found.select(F.col("id").alias(id_column), F.col("url").alias(url_column), "text")
