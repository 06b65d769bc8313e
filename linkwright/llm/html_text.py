"""HTML extraction: boilerplate by repeats in a host's pages, the certain text by page structure.

``extract_text(pages)`` cuts a page into blocks. Scripts and styles go at once; menus, headers,
footers, sidebars, notices, adverts, forms and comments are told by their elements, roles, and the
words of their class and id. Where a page marks its article (``article``, else ``main`` or role
main), the blocks within are certainly its text: they are kept whole, since hosts publish copies of
and a copied article is still the article of its page. Of several articles, those with
less than a third of the longest one's characters are teasers and go.

Everything outside of goes to the host's suffix array: the token streams of all its pages
are concatenated, common prefixes of neighbouring suffixes show the substrings of ``REPEAT`` tokens
or more that stand on ``PAGES`` or more distinct pages, tokens covered by them are boilerplate, and
unique runs stay. This settles the text of pages that mark no article, with all of the host's pages
as evidence, and counts each page's boilerplate. A host of more than ``HOST_PAGES`` pages is dealt by
a hash of the page into parts: each part counts its distinct pages by ``REPEAT``-token window (64-bit
hashes), the counts are summed over the host, and the windows of ``PAGES`` pages or more go back to
the parts that hold them. What is removed is thus the same however a host is dealt.

Within a block, white space becomes one space; blocks are joined by one newline in page order.
Cases: NULL or empty html gives the empty text; broken markup is read as far as it goes, an unclosed
element lasts to the end; pages with a NULL url make up one host; equal pages of a host count as one
page in its repeats; input columns named as an output column are replaced.
"""

from __future__ import annotations

import hashlib
import html as references
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


from .arrays import U64, mix
from .frames import durable, prepared, release
from .suffix_dedup import common_prefixes, suffix_array

REPEAT, PAGES = 8, 3
HOST_PAGES = 2_000
#: The list of hosts with more pages is broadcast up to so many of them (under 10 MB), and joined by shuffling beyond; rows are the same.
BROADCAST_HOSTS = 100_000

#: Elements of HTML by what they are to a reader.
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template"))
HIDDEN = frozenset(("head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "dialog", "svg", "canvas", "object", "menu", "audio", "video", "datalist", "label", "fieldset"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
BLOCKS = frozenset(("address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"))
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter "
    "notice notices pager pagination paywall popup promo promoted recommended related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Words that go with a mark in one class or id without changing what it says.
BESIDE = frozenset("area articles bar block bottom box button buttons container dropdown form global group holder icons inner item items js left link links list main message outer page panel policy post posts primary right row secondary section site slot stories sub text thread top unit wrapper zone".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
ENDED_BY = {
    "p": BLOCKS - {"body", "html"},
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "tbody", "tfoot", "thead")),
    "td": frozenset(("td", "th", "tr")),
    "th": frozenset(("td", "th", "tr")),
    "option": frozenset(("option",)),
}

#: What end tags and omitted end tags go by.
_STRUCTURE = BLOCKS | HIDDEN

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_MAIN = re.compile(r"role\s*=\s*[\"']?main\b", re.I)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
_SPACE = re.compile(r"\s+")
_HOST = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def _marked(value: str) -> bool:
    """Whether a class or id is a mark: a word of MARKS, alone or among words of MARKS and BESIDE only."""
    for token in value.split():
        words = [w for w in re.split(r"[^a-z]+", token) if w]
        if words and not MARKS.isdisjoint(words) and all(w in MARKS or w in BESIDE for w in words):
            return True
    return False


def _unwanted(tag: str, attributes: str) -> int:
    """0 wanted, 1 unwanted by the words of its class or id, 2 by its element, role or being hidden."""
    if tag in HIDDEN:
        return 2
    if not attributes or tag in ("body", "html", "main"):
        return 0
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES):
            return 2
        if name in ("class", "id") and _marked(value):
            found = 1
    return found


class _Stack:
    """Open elements. What one tag ends is found without walking over elements that stay open."""

    def __init__(self):
        self.open: list[tuple[str, int, str | None]] = []  # element, how unwanted, article or main where it is the outermost one
        self.blocks: list[int] = []  # places of the block elements
        self.inline: list[dict[str, int]] = [{}]  # open inline elements since each block element
        self.named: dict[str, int] = {}  # open block elements by name

    def push(self, tag: str, bad: int, region: str | None) -> None:
        if tag in _STRUCTURE:
            self.blocks.append(len(self.open))
            self.inline.append({})
            self.named[tag] = self.named.get(tag, 0) + 1
        else:
            self.inline[-1][tag] = self.inline[-1].get(tag, 0) + 1
        self.open.append((tag, bad, region))

    def pop(self) -> tuple[str, int, str | None]:
        tag, bad, region = self.open.pop()
        if tag in _STRUCTURE:
            self.blocks.pop()
            self.inline.pop()
            self.named[tag] -= 1
        else:
            self.inline[-1][tag] -= 1
        return tag, bad, region

    def ended_by_end(self, tag: str) -> int:
        """How many elements an end tag closes: to the nearest of its name, an inline one only within its block."""
        if tag in _STRUCTURE:
            if not self.named.get(tag):
                return 0
            return len(self.open) - next(k for k in reversed(self.blocks) if self.open[k][0] == tag)
        if not self.inline[-1].get(tag):
            return 0
        return next(n for n, x in enumerate(reversed(self.open), 1) if x[0] == tag)

    def ended_by_start(self, tag: str) -> int:
        """How many elements whose end tag was omitted a start tag closes."""
        if self.blocks and tag in ENDED_BY.get(self.open[self.blocks[-1]][0], ()):
            return len(self.open) - self.blocks[-1]
        return 0


class _Page:
    """Reads a page into blocks: the numbers of the outermost open article and main, whether something hides the text within each of them and within the page, and the text."""

    def __init__(self):
        self.blocks: list[tuple[int | None, int | None, tuple[bool, bool, bool], str]] = []
        self.regions: list[bool] = []  # of each article or main: whether something around it is unwanted by its class
        self.stack = _Stack()
        self.parts: list[str] = []
        self.held: list[list[str]] = []  # what unwanted inline elements interrupt
        self.by_kind = self.by_class = 0  # open elements that are unwanted by kind, and by class
        self.at: dict[str, tuple[int, int]] = {}  # the outermost open article and main: number, by_class when it began

    def flush(self) -> None:
        if not self.parts:
            return
        text = _SPACE.sub(" ", references.unescape("".join(self.parts))).strip()
        self.parts.clear()
        if text:
            article, main = self.at.get("article"), self.at.get("main")
            hidden = tuple(self.by_kind > 0 or self.by_class > (region[1] if region else 0) for region in (article, main, None))
            self.blocks.append((article and article[0], main and main[0], hidden, text))

    def push(self, tag: str, attributes: str) -> None:
        bad, region = _unwanted(tag, attributes), None
        if bad and tag not in BLOCKS:
            self.held.append(self.parts)
            self.parts = []
        kind = "article" if tag == "article" else "main" if tag == "main" or _MAIN.search(attributes) else None
        if kind and not bad and not self.by_kind and kind not in self.at:
            region = kind
            self.at[kind] = (len(self.regions), self.by_class)
            self.regions.append(self.by_class > (self.at["main"][1] if "main" in self.at else 0))
        self.by_kind += bad == 2
        self.by_class += bad == 1
        self.stack.push(tag, bad, region)

    def pop(self, n: int) -> None:
        for _ in range(n):
            tag, bad, region = self.stack.pop()
            if bad or tag in BLOCKS:
                self.flush()
            if bad and tag not in BLOCKS:
                self.parts = self.held.pop()
            self.by_kind -= bad == 2
            self.by_class -= bad == 1
            if region:
                del self.at[region]


def _read(page: str) -> _Page:
    out, at = _Page(), 0
    while at < len(page):
        m = _TAG.search(page, at)
        out.parts.append(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        if m[2] is None:  # a comment or declaration
            continue
        tag, attributes = m[2].lower(), m[3] or ""
        if tag in BLOCKS:
            out.flush()
        if m[1]:
            out.pop(out.stack.ended_by_end(tag))
        elif tag == "br":
            out.parts.append(" ")
        elif tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and (tag in BLOCKS or not attributes.endswith("/")):
            out.pop(out.stack.ended_by_start(tag))
            out.push(tag, attributes)
    out.flush()
    while out.held:  # unwanted inline elements that never ended
        out.parts = out.held.pop()
        out.by_kind = out.by_class = 0
        out.flush()
    return out


def page_blocks(page: str) -> list[tuple[str, str]]:
    """(kind, text) of a page's blocks in order; kinds: a its article, l loose text, c menus, adverts and the like."""
    read = _read(page)
    size: dict[int, int] = {}
    for article, main, hidden, text in read.blocks:
        for region, out_of_sight in ((article, hidden[0]), (main, hidden[1])):
            if region is not None:
                size[region] = size.get(region, 0) + (0 if out_of_sight else len(text))
    articles = {b[0] for b in read.blocks if b[0] is not None and size[b[0]]}
    mains = {b[1] for b in read.blocks if b[1] is not None and size[b[1]]}
    chosen = {r for r in articles if not read.regions[r]} or mains or articles
    longest = max((size[r] for r in chosen), default=0)
    chosen = {r for r in chosen if 3 * size[r] >= longest}
    out = []
    for article, main, hidden, text in read.blocks:
        own = 0 if article in chosen else 1 if main in chosen else 2
        out.append(("c" if hidden[own] else "al"[own == 2], text))
    return out


def repeated(streams: list[np.ndarray], least: int = REPEAT, pages: int = PAGES) -> list[np.ndarray]:
    """Which tokens of each stream lie in a string of ``least`` tokens found in ``pages`` streams."""
    lengths = np.array([len(s) for s in streams])
    if not lengths.sum():
        return [np.zeros(0, bool) for _ in streams]
    tokens = np.concatenate([np.append(s, 0) for s in streams])  # 0 ends a page
    owner = np.repeat(np.arange(len(streams)), lengths + 1)
    ends = np.cumsum(lengths + 1)
    order, _ = suffix_array(tokens)
    group = np.cumsum(common_prefixes(tokens.astype(np.int64), order, max(1, len(tokens) // 4096), least) < least) - 1
    whole = order + least < ends[owner[order]]
    order, group = order[whole], group[whole]
    distinct = np.unique(group * len(streams) + owner[order])
    many = np.bincount(distinct // len(streams), minlength=int(group.max(initial=0)) + 1) >= pages
    change = np.zeros(len(tokens) + 1, np.int64)
    begin = order[many[group]]
    np.add.at(change, begin, 1)
    np.add.at(change, begin + least, -1)
    covered = np.cumsum(change[:-1]) > 0
    return [covered[e - n - 1 : e - 1] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]


def streams(pages: list[list[tuple[str, str]]], number: dict[str, int] | None = None) -> list[np.ndarray]:
    """The token stream of each page: numbered words of what stands outside of articles, 1 after each block."""
    number = {} if number is None else number
    out = []
    for blocks in pages:
        row = []
        for kind, text in blocks:
            if kind != "a":
                row += [number.setdefault(w, len(number) + 2) for w in text.split(" ")] + [1]
        out.append(np.array(row, np.int64))
    return out


def settled(blocks: list[tuple[str, str]], gone: np.ndarray) -> tuple[str, int]:
    """A page's text, and how many tokens of its stream are boilerplate; gone: which places of the stream are covered."""
    marked = any(kind == "a" for kind, _ in blocks)
    at = lost = 0
    kept = []
    for kind, text in blocks:
        if kind == "a":
            kept.append(text)
            continue
        tokens = text.split(" ")
        covered = gone[at : at + len(tokens)].tolist()
        at += len(tokens) + 1
        lost += sum(covered)
        if kind == "l" and not marked and (left := [w for w, g in zip(tokens, covered, strict=True) if not g]):
            kept.append(" ".join(left))
    return "\n".join(kept), lost


def settled_host(pages: list[list[tuple[str, str]]]) -> list[tuple[str, int]]:
    """What settled() gives for each page of a host by the suffix array of all of them; equal pages count as one."""
    seen: dict[tuple, int] = {}
    first = [seen.setdefault(tuple(p), k) for k, p in enumerate(pages)]
    only = sorted(set(first))
    marks = dict(zip(only, repeated(streams([pages[k] for k in only])), strict=True))
    return [settled(p, marks[k]) for p, k in zip(pages, first, strict=True)]


def window_hashes(pages: list[list[tuple[str, str]]], least: int = REPEAT) -> list[np.ndarray]:
    """The hash of every string of ``least`` tokens of each page's stream; equal in all parts of a host."""
    number: dict[str, int] = {}
    rows = streams(pages, number)
    code_of = np.array([0, 1, *(int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for w in number)], U64)
    out = []
    for row in rows:
        stream = code_of[row]
        code = np.zeros(max(0, len(stream) - least + 1), U64)
        for k in range(least):
            code = mix(code + stream[k : k + len(code)] + U64(1))
        out.append(code.view(np.int64))
    return out


def _packed(blocks: list[tuple[str, str]]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress("\n".join(kind + text for kind, text in blocks).encode("utf-8", "surrogatepass"))


def _unpacked(column) -> list[list[tuple[str, str]]]:
    read = zstandard.ZstdDecompressor().decompress
    pages = (read(page).decode("utf-8", "surrogatepass") for page in column.to_pylist())
    return [[(x[0], x[1:]) for x in page.split("\n")] if page else [] for page in pages]


def _windows(table: pa.Table) -> pa.Table:
    """A part's windows, each with its number of distinct pages."""
    pages = _unpacked(pa.chunked_array([pc.unique(table["_blocks"])]))
    found = [np.unique(w) for w in window_hashes(pages)]
    code, n = np.unique(np.concatenate(found), return_counts=True)
    host, part = (pa.array([table[c][0].as_py()] * len(code), t) for c, t in (("_host", pa.string()), ("_part", pa.int64())))
    return pa.table({"_host": host, "_part": part, "window": code, "pages": n.astype(np.int64)})


def _settle_part(table: pa.Table, common: pa.Table) -> pa.Table:
    """A part's pages without the windows that are common in the host."""
    known, pages = np.sort(common["window"].to_numpy()), _unpacked(table["_blocks"])
    out = []
    for blocks, code in zip(pages, window_hashes(pages), strict=True):
        change = np.zeros(len(code) + REPEAT + 1, np.int64)
        begin = np.flatnonzero(np.isin(code, known))
        np.add.at(change, begin, 1)
        np.add.at(change, begin + REPEAT, -1)
        out.append(settled(blocks, np.cumsum(change) > 0))
    return _with_texts(table, out)


def _settle(table: pa.Table) -> pa.Table:
    return _with_texts(table, settled_host(_unpacked(table["_blocks"])))


def _with_texts(table: pa.Table, found: list[tuple[str, int]]) -> pa.Table:
    texts = [t for t, _ in found]
    new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64()), "n_boilerplate": pa.array([n for _, n in found], pa.int64())}
    table = table.drop_columns(["_host", "_part", "_blocks"])
    for name, column in new.items():
        table = table.append_column(name, column)
    return table


def _parse(html_col: str, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            found = [_packed(page_blocks(page or "")) for page in batch.column(batch.schema.get_field_index(html_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()) if k == "_blocks" else batch.column(batch.schema.get_field_index(k)) for k in schema.names], schema=schema)

    return run


def host_of(url_col: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), _HOST, 1))


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", host_pages: int = HOST_PAGES) -> DataFrame:
    """pages with text, n_chars and n_boilerplate (tokens outside of articles that the host repeats) in place of html."""
    from pyspark.sql.pandas.types import to_arrow_schema

    prepared(pages.sparkSession)
    made = ("text", "n_chars", "n_boilerplate")
    pages = pages.select(*[c for c in pages.columns if c not in (*made, "_host", "_part", "_blocks") or c in (url_col, html_col)])
    pages = pages.withColumn("_host", host_of(url_col))
    sizes = pages.groupBy("_host").agg(F.ceil(F.count("*") / host_pages).alias("_parts")).where("_parts > 1")
    sizes = durable(sizes)  # as many rows as pages / host_pages at most: broadcast while that is few
    hosts = sizes.count()
    kept = [f for f in pages.schema.fields if f.name not in (html_col, "_host")]
    result = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_boilerplate", T.LongType())])
    schema = T.StructType([*kept, T.StructField("_host", T.StringType()), T.StructField("_blocks", T.BinaryType())])
    parsed = lambda f: f.mapInArrow(_parse(html_col, to_arrow_schema(schema)), schema)
    few = hosts <= BROADCAST_HOSTS
    spread = F.broadcast(sizes) if few else sizes
    small = pages.join(spread, "_host", "left_anti") if hosts else pages
    done = parsed(small).withColumn("_part", F.lit(0).cast("long")).groupBy("_host", "_part").applyInArrow(_settle, result)
    if not hosts:
        return done
    large = parsed(pages.join(spread, "_host", "left_semi")).join(spread, "_host")
    large = durable(large.withColumn("_part", F.pmod(F.xxhash64("_blocks"), "_parts")).drop("_parts"))
    windows = durable(large.select("_host", "_part", "_blocks").groupBy("_host", "_part").applyInArrow(_windows, "_host string, _part long, window long, pages long"))
    release(pages.sparkSession, 0.5)
    common = windows.groupBy("_host", "window").agg(F.sum("pages").alias("n")).where(F.col("n") >= PAGES)
    common = windows.join(common, ["_host", "window"], "left_semi").select("_host", "_part", "window")
    dealt = large.groupBy("_host", "_part").cogroup(common.groupBy("_host", "_part")).applyInArrow(_settle_part, result)
    return done.unionByName(dealt)


def query(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars", "n_boilerplate")
