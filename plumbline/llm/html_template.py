"""Main text of web pages by template deduction over equivalence classes.

Each page is read as tokens: the path of every element (names with class and id) and every text block at its path. Pages of a
host that hold the same blocks (those that names and roles leave) are copies and count as one page. Over the different pages of
a host, tokens that occur equally often in each page (the same occurrence vector) form an equivalence class. The vector is kept
as a sum over pages of a number drawn from page and count, so it is an aggregate that combines before it moves and no host's
pages meet anywhere. A class is valid if it stands in at least `SUPPORT` of the host's different pages and these are `PAGES` or
more. Valid classes nest by their element paths: the template of a host is its valid element paths, each under the nearest
valid path above it, and its valid text blocks, which are constant text.

Menus are told apart by list, not by path: the blocks of one path in one parent element are a list, and a list that holds
mostly link text is linked. A path at which `SUPPORT` of the host's pages have a linked list has a menu; its linked lists go,
other lists at the same path stay.

A page's main text is what is left once constant blocks, menu lists and blocks inside elements that by name, class, id
or role are navigation, headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments are gone. If the page
has an article or main element, blocks outside of it are left too. A host of few pages has no valid class; names and roles
decide alone there.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import batches as B
from plumbline.llm.store import land
from plumbline.llm.url_filters import host_of

SUPPORT, PAGES, LINKED = 0.6, 5, 0.5

# Element names of HTML by what they do to text.
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
CLOSED_BY_BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
LEFT_OUT = RAW | set("head nav footer aside form button select svg template object canvas audio video math dialog menu header".split())
# Words of classes, ids and roles that mark what is not the article.
MARKED = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar aside complementary menu nav navbar navigation "
    "breadcrumb breadcrumbs pagination footer contentinfo header masthead cookie cookies consent notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login search share sharing social related recommended comment comments reply replies respond disqus hidden".split()
)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=\s|/|$)", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
NOT_WORD = re.compile(r"[^a-z]+")
PLACED = "struct<path:string,text:string,linked:bigint,main:boolean,out:boolean>"


class Page:
    """One pass over a page: element paths in order, and text blocks (path, text, in a linked list, in an article, left out by name)."""

    def __init__(self, source: str):
        self.paths: list[str] = []
        self.blocks: list[tuple[str, str, bool, bool, bool]] = []
        self.open: list[tuple[str, str, bool, bool, int]] = [("", "", False, False, 0)]  # name, path, in an article, left out, number
        self.lists: dict[tuple[int, str], list[int]] = {}  # characters, and those inside links, of the blocks of one path in one parent
        self.within: list[tuple[int, str]] = []
        self.opened = 0
        self.parts: list[str] = []
        self.links = self.in_links = 0
        at, n = 0, len(source)
        while at < n:
            m = TOKEN.search(source, at)
            self.text(source[at : m.start() if m else n])
            if not m:
                break
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                self.end(name)
                continue
            self.start(name, m[3])
            if name in RAW and not m[3].endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                at = close.end() if close else n
                self.end(name)
        self.flush()
        linked = {key: inside >= LINKED * chars for key, (chars, inside) in self.lists.items()}
        self.blocks = [(path, text, linked[key], main, out) for (path, text, _, main, out), key in zip(self.blocks, self.within, strict=True)]

    def kept(self) -> list[tuple[str, str, bool]]:
        """Blocks that names and roles leave, the article's alone if there is one: path, text, in a linked list."""
        within = any(b[3] for b in self.blocks)
        return [(path, text, linked) for path, text, linked, main, out in self.blocks if not out and (main or not within)]

    def text(self, raw: str) -> None:
        if raw and not self.open[-1][3]:
            self.parts.append(raw)
            if self.links:
                self.in_links += len(raw.strip())

    def flush(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            _, path, main, out, _ = self.open[-1]
            self.blocks.append((path, text, False, main, out))
            self.within.append((self.open[-2][4] if len(self.open) > 1 else -1, path))
            sums = self.lists.setdefault(self.within[-1], [0, 0])
            sums[0] += len(text)
            sums[1] += self.in_links
        self.parts, self.in_links = [], 0

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self.flush()
            while self.open[-1][0] in CLOSED_BY_BLOCK or (name == "li" and self.open[-1][0] == "li"):
                self.open.pop()
        elif name == "br":
            self.parts.append(" ")
        if name in VOID:
            return
        above = self.open[-1]
        words, given = set(), []
        for key, *values in ATTRIBUTE.findall(attributes) if attributes else ():
            value = next(filter(None, values), "")
            key = key.lower()
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                words.add("hidden")
            elif key != "aria-hidden":
                given.append(value)
                words.update(NOT_WORD.split(CAMEL.sub(" ", value).lower()))
        inside = above[2] or name in ("article", "main")
        out = above[3] or (name in LEFT_OUT and not (name == "header" and above[2])) or (bool(words & MARKED) and name not in ("html", "body", "article", "main"))
        if name in BLOCKS:
            path = f"{above[1]}/{name}" + "".join(f".{v}" for v in given)
            self.paths.append(path)
        elif name == "a":
            self.links += 1
            path = above[1]
        else:
            path = above[1]
            if not out:
                return  # inline elements do not matter for blocks
        if name != "a" or out != above[3]:
            if out and not above[3]:
                self.flush()
            self.opened += 1
            self.open.append((name, path, inside, out, self.opened))

    def end(self, name: str) -> None:
        if name == "a":
            self.links = max(0, self.links - 1)
        if name in BLOCKS:
            self.flush()
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == name:
                self.flush()
                del self.open[i:]
                break
            if self.open[i][0] in ("article", "main", "body") and name not in BLOCKS:
                break


def _number(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass"))


def contents(pages: DataFrame) -> DataFrame:
    """(host, page, tokens): one row per host and different content; tokens is a list of (kind, path, text, times) as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, "html", 4_000_000):
            pages, packed = [], []
            for source in batch.column(1).to_pylist():
                page, seen = Page(source or ""), {("page", "", 0): 1}
                for path in page.paths:
                    seen["element", path, 0] = seen.get(("element", path, 0), 0) + 1
                for path, text, linked, _, out in page.blocks:
                    if not out:
                        key = "text", path, _number(text)
                        seen[key] = seen.get(key, 0) + 1
                        if linked:
                            seen["slot", path, 0] = seen.get(("slot", path, 0), 0) + 1
                pages.append(_number(*(x for path, text, _ in page.kept() for x in (path, text))))
                packed.append(json.dumps([[*key, times] for key, times in seen.items()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(pages, np.uint64).view(np.int64)), pa.array(packed, pa.string())], ["host", "page", "tokens"])

    return pages.select("host", "html").mapInArrow(run, "host string, page bigint, tokens string").groupBy("host", "page").agg(F.min("tokens").alias("tokens"))


def tokens(pages: DataFrame) -> DataFrame:
    """(host, kind, token, path, pages, vector): what the different pages of each host have, summed per batch.

    kind: element, text, slot (a linked list) or page (one per page).
    """
    schema = "host string, kind string, token bigint, path string, pages bigint, vector bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, "tokens", 4_000_000):
            total: dict[tuple, list[int]] = {}
            for host, page, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for kind, path, text, times in json.loads(packed):
                    got = total.setdefault((host, kind, path, text), [0, 0])
                    got[0] += 1
                    got[1] = (got[1] + _number(str(page), str(times))) & 0xFFFFFFFFFFFFFFFF
            names, sums = list(total), list(total.values())
            numbers = [_number(kind, path, str(text)) for _, kind, path, text in names]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([n[0] for n in names], pa.string()), pa.array([n[1] for n in names], pa.string()), pa.array(np.array(numbers, np.uint64).view(np.int64)),
                    pa.array([n[2] for n in names], pa.string()), pa.array([s[0] for s in sums], pa.int64()), pa.array(np.array([s[1] for s in sums], np.uint64).view(np.int64)),
                ],
                ["host", "kind", "token", "path", "pages", "vector"],
            )

    wrapped = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    return contents(pages).mapInArrow(run, schema).groupBy("host", "kind", "token").agg(
        F.first("path").alias("path"), F.sum("pages").alias("pages"), F.xxhash64(wrapped("vector")).alias("vector"),
    )


def templates(pages: DataFrame) -> DataFrame:
    """Per host: classes (list of tokens' paths with the path of the class above), constant (hashes of constant text blocks), menus (paths that have a menu)."""
    found = land(tokens(pages), "tokens")
    sizes = found.where("kind = 'page'").select("host", F.col("pages").alias("of"))
    valid = found.where("kind <> 'page'").join(sizes, "host").where((F.col("of") >= PAGES) & (F.col("pages") >= SUPPORT * F.col("of")))
    classes = valid.where("kind <> 'slot'").groupBy("host", "vector").agg(
        F.array_sort(F.collect_set("path")).alias("paths"), F.collect_set(F.when(F.col("kind") == "text", F.col("token"))).alias("constant"),
    )
    nested = classes.groupBy("host").agg(F.collect_list(F.struct("paths", "constant")).alias("classes")).withColumn(
        "classes", F.transform("classes", lambda c: F.struct(c["paths"].alias("paths"), c["constant"].alias("constant"), F.array_max(F.filter(
            F.flatten(F.transform("classes", lambda o: o["paths"])), lambda p: F.startswith(c["paths"][0], F.concat(p, F.lit("/"))),
        )).alias("under"))),
    )
    menus = valid.where("kind = 'slot'").groupBy("host").agg(F.collect_set("path").alias("menus"))
    return nested.join(menus, "host", "full").select("host", "classes", F.coalesce(F.flatten(F.transform("classes", lambda c: c["constant"])), F.array().cast("array<bigint>")).alias("constant"), "menus")


def main_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per row of `pages`: id, url, text (blocks joined by an empty line; empty if there are none), n_chars.

    Null pages have no text. Pages without a host (null or odd urls) count as pages of one host. Repeated rows are kept;
    copies count as one page of the host. Other columns are left out.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.col(source).alias("html"))
    template = land(templates(rows).select("host", "constant", "menus"), "templates")
    joined = rows.join(template, "host", "left").select("id", "url", "html", "constant", "menus")
    schema = T.StructType([*joined.select("id", "url").schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (None, None, set(), set())
        for batch in B.slices(batches, "html", 4_000_000):
            out = []
            for body, constant, menus in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                if known[0] != constant or known[1] != menus:
                    known = (constant, menus, set(constant.as_py() or ()), set(menus.as_py() or ()))
                page = Page(body or "")
                kept = [
                    text for path, text, linked in page.kept()
                    if not (linked and path in known[3])
                    and (not known[2] or np.uint64(_number("text", path, str(_number(text)))).astype(np.int64).item() not in known[2])
                ]
                out.append("\n\n".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, schema).select(F.col("id").alias(id_col), F.col("url").alias(url), "text", "n_chars")
