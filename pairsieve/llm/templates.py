"""Main text of web pages by template deduction from equivalence classes.

A page is a sequence of tokens: tags (with their class and id), and runs of text, each told apart
by its path of enclosing tags. Over the pages of a host a token has an occurrence vector, its
count on every page. Tokens with equal vectors form an equivalence class; tags seen on at
least two distinct pages and half of the host's are template, text needs ``LEAST_PAGES``. Pages of
a host with equal tokens are one page: copies add no support. A vector is carried as the
exclusive-or of hashes of (page, count), so classes come from aggregations that combine
map-side, and no task holds a host, however many pages it has.

On a page a class is valid if its tokens come in one order, repeated as often as they occur. The
tokens of valid classes are the template; what stands between them are slots. Text of the template
is left out, inside articles too: a block made of nothing else, and in other blocks the runs
whose class has ``LARGE`` tokens (a lone common word between tags is no template). A slot
holds main text if the tags around it are those of an article and not of a menu, header,
footer, advert, form or reader comments. On pages without an article element, slots made of
links are left out as well. A page's longest block never goes for its repetition alone.

Defined results: null html is empty and has no text; a null or odd URL has the host of its text
up to the first slash, or none. A host with fewer than ``LEAST_PAGES`` distinct pages has no
template text and its pages are judged by their tags alone. An unclosed tag, comment, script or attribute reaches to the end of the page, as in
browsers. Repeated rows give equal results. Other columns are not read. An empty table gives
an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_digest, xxh64_intdigest

from pairsieve.llm.common import table
from pairsieve.session import stored_table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</?[A-Za-z](?:[^>\"']+|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*(?:>|\Z)"
    r"|[^<]+|<",
    re.S,
)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ROLE = re.compile(r"\s(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
# Elements whose content is no markup.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg"}
_VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
    "track", "wbr",
}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn",
    "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
_MAIN = {"article", "main"}
_ASIDE_TAGS = {
    "nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "head",
}
_ASIDE_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored",
    "promo", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header",
    "masthead", "footer", "sidebar", "aside", "cookie", "cookies", "consent", "notice",
    "notices", "popup", "modal", "newsletter", "subscribe", "subscription", "social", "share",
    "sharing", "related", "recommended", "comment", "comments", "respond", "replies", "reply",
    "login", "signup", "form", "search", "widget", "pagination", "pager", "toolbar",
}
# Distinct pages on which text must stand, and tokens of a class, to be template.
LEAST_PAGES, LARGE = 6, 3


def _hash(key: str) -> int:
    value = xxh64_intdigest(key.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


class Token:
    """A tag or run of text of a page; ``key`` is the digest of its path and content."""

    __slots__ = ("kind", "name", "words", "text", "key")

    def __init__(self, kind, name="", words=(), text="", key=None):
        self.kind, self.name, self.words, self.text, self.key = kind, name, words, text, key


def tokenize(page: str) -> list[Token]:
    """Tags and text of a page, keyed by their path; comments and raw elements have no text.

    A closing tag closes the nearest open tag of its name; one without an open tag is dropped.
    A path is carried as a digest of its last name and the path above, so that the work is linear
    in the page, however deep its tags nest.
    """
    tokens, path, at = [], [], 0
    above, is_open, blocks = [0], Counter(), []  # digest per open tag; names; tags not inline

    def close(key=None):
        name = path.pop()
        above.pop()
        is_open[name] -= 1
        if name not in _INLINE:
            blocks.pop()
        tokens.append(Token("close", name, key=key))

    while at < len(page):
        found = _TOKEN.match(page, at)
        at = found.end()
        piece = found.group()
        if piece[0] != "<" or len(piece) == 1:
            text = html.unescape(piece)
            key = _hash(f"{above[-1]}#{' '.join(text.split())}")
            tokens.append(Token("text", text=text, key=key))
            continue
        name = _NAME.match(piece)
        if not name:
            continue
        name = name.group(1).lower()
        if piece[1] == "/":
            if is_open[name]:
                while path[-1] != name:  # left open: closed with it
                    close()
                close(_hash(f"{above[-1]}/"))
            elif name == "p":
                tokens.append(Token("break"))
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "p" and blocks and blocks[-1] == "p":
            while path[-1] != "p":
                close()
            close()
        values = ["".join(v) for v in _ROLE.findall(piece)]
        words = tuple(w for v in values for w in re.split(r"[\s_-]+", v.lower()) if w)
        key = _hash(f"{above[-1]}/{name}." + ".".join(words))
        if name in _VOID or piece.endswith("/>"):
            tokens.append(Token("break", name, key=key))
            continue
        tokens.append(Token("open", name, words, key=key))
        above.append(_hash(f"{above[-1]}/{name}"))
        path.append(name)
        is_open[name] += 1
        if name not in _INLINE:
            blocks.append(name)
    return tokens


def _occurrence_batches(batches):
    """A page's tokens (text, not tags, first ``n_texts``), their counts, and a digest of them."""
    for batch in batches:
        digests, keys, counts, n_texts = [], [], [], []
        for text in batch.column("html").to_pylist():
            tokens = [t for t in tokenize(text or "") if t.key is not None]
            texts = Counter(t.key for t in tokens if t.kind == "text" and t.text.strip())
            tags = Counter(t.key for t in tokens if t.kind != "text")
            order = np.array([t.key for t in tokens], "<i8").tobytes()
            digests.append(int.from_bytes(xxh64_digest(order), "little", signed=True))
            keys.append([*texts, *tags])
            counts.append([*texts.values(), *tags.values()])
            n_texts.append(len(texts))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("host"),
                pa.array(digests, pa.int64()),
                pa.array(keys, pa.list_(pa.int64())),
                pa.array(counts, pa.list_(pa.int32())),
                pa.array(n_texts, pa.int32()),
            ],
            names=["host", "page", "tokens", "counts", "n_texts"],
        )


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z]+://)?([^/?#]*)", 1))


def templates(pages: DataFrame, least_share: float = 0.5) -> DataFrame:
    """(host, tokens, classes): tokens of frequent equivalence classes, and their class.

    Tokens on half of a host's pages are at most twice as many as a page has on average.
    """
    narrow = pages.select(host_of(F.col("url")).alias("host"), "html")
    found = narrow.mapInArrow(
        _occurrence_batches,
        "host string, page long, tokens array<long>, counts array<int>, n_texts int",
    )
    # One row per distinct page: copies are dropped map-side first.
    packed = F.struct("tokens", "counts", "n_texts")
    distinct = found.groupBy("host", "page").agg(F.first(packed).alias("of"))
    each = distinct.select(
        "host",
        "page",
        F.col("of.n_texts").alias("n_texts"),
        F.posexplode(F.arrays_zip("of.tokens", "of.counts")).alias("at", "t"),
    ).select(
        "host",
        "page",
        F.col("t.tokens").alias("token"),
        F.col("t.counts").alias("n"),
        (F.col("at") < F.col("n_texts")).alias("is_text"),
    )
    vectors = each.groupBy("host", "token", "is_text").agg(
        F.count("*").alias("support"), F.bit_xor(F.xxhash64("page", "n")).alias("vector")
    )
    sizes = distinct.groupBy("host").agg(F.count("*").alias("pages"))
    least = F.when(F.col("is_text"), LEAST_PAGES).otherwise(2)
    frequent = vectors.filter(F.col("support") >= least).join(sizes, "host").filter(
        F.col("support") >= least_share * F.col("pages")
    )
    return frequent.groupBy("host").agg(
        F.collect_list("token").alias("tokens"),
        F.collect_list(F.xxhash64("support", "vector")).alias("classes"),
    )


def valid_classes(tokens: list[Token], class_of: dict[int, int]) -> set[int]:
    """Classes whose tokens come in the same order each time round on this page."""
    keys: dict[int, list[int]] = {}
    for token in tokens:
        own = class_of.get(token.key)
        if own is not None:
            keys.setdefault(own, []).append(token.key)
    valid = set()
    for own, found in keys.items():
        n = len(set(found))
        if found[n:] == found[:-n]:
            valid.add(own)
    return valid


def _aside(token: Token) -> bool:
    return token.name in _ASIDE_TAGS or not _ASIDE_WORDS.isdisjoint(token.words)


def parts(tokens: list[Token], class_of: dict[int, int]):
    """(runs, in article, aside, new block) per stretch of text under the same tags.

    A run is (text, is link, class if template or None); blocks are cut at every tag that is
    not inline.
    """
    valid = valid_classes(tokens, class_of)
    stack: list[tuple[bool, bool, bool]] = []  # main, aside, link per open tag
    mains = asides = links = 0
    runs, new = [], True
    for token in tokens:
        if token.kind == "text":
            own = class_of.get(token.key)
            fixed = own in valid and bool(token.text.strip())
            runs.append((token.text, links > 0, own if fixed else None))
            continue
        breaks = token.name not in _INLINE
        main = aside = False
        if token.kind == "open":
            main, aside, link = token.name in _MAIN, _aside(token), token.name == "a"
        elif token.kind == "close":
            main, aside, link = stack.pop()
        # The state of the stack belongs to the text before the tag.
        if breaks or main or aside:
            yield runs, mains > 0, asides > 0, new
            runs, new = [], breaks
        if token.kind == "open":
            stack.append((main, aside, link))
            mains, asides, links = mains + main, asides + aside, links + link
        elif token.kind == "close":
            mains, asides, links = mains - main, asides - aside, links - link
    yield runs, mains > 0, asides > 0, new


def main_text(page: str, class_of: dict[int, int]) -> str:
    """The article's blocks, one per line."""
    tokens = tokenize(page)
    has_article = any(t.kind == "open" and t.name in _MAIN for t in tokens)
    sizes = Counter(class_of.values())
    blocks: list[list] = [[]]
    for runs, main, aside, new in parts(tokens, class_of):
        wanted = not aside and (main or not has_article)
        linked = sum(len(t.strip()) for t, link, _ in runs if link)
        if not has_article and linked * 2 > sum(len(t.strip()) for t, _, _ in runs):
            runs = []
        if new or not wanted:
            blocks.append([])
        if wanted:
            blocks[-1] += runs
    whole = [" ".join("".join(t for t, _, _ in b).split()) for b in blocks]
    longest = max(range(len(blocks)), key=lambda i: len(whole[i]))
    lines = []
    for i, block in enumerate(blocks):
        text = whole[i]
        if i != longest and any(own is not None for _, _, own in block):
            mixed = any(own is None and t.strip() for t, _, own in block)
            kept = [t for t, _, own in block if own is None or mixed and sizes[own] < LARGE]
            text = " ".join("".join(kept).split())
        if text:
            lines.append(text)
    return "\n".join(lines)


def _text_batches(batches):
    for batch in batches:
        texts = []
        rows = zip(*(batch.column(c).to_pylist() for c in ("html", "tokens", "classes")))
        for page, tokens, classes in rows:
            texts.append(main_text(page or "", dict(zip(tokens or (), classes or ()))))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
            names=["page_id", "url", "text"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    hosted = narrow.withColumn("host", host_of(F.col("url")))
    # A merge join of two shuffled inputs: adaptive execution splits its partitions where a host
    # has very many pages. Stored, as it splits none whose stage also aggregates.
    found = stored_table(templates(narrow), "templates")
    joined = hosted.join(found.hint("merge"), "host", "left").drop("host")
    return joined.mapInArrow(_text_batches, "page_id long, url string, text string")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op8_html_text": op8_html_text}
ORACLES: dict[str, str] = {}
