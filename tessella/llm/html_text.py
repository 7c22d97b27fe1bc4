"""Main text of web pages by equivalence classes of template tokens.

A page is a sequence of tokens: the start and end tags of its containers and its runs of
text, each told apart by the containers around it. Over the distinct pages of one host a
token has an occurrence vector, its count on every page. The vector's fingerprint is a
mergeable sum over pages, so tokens fall into equivalence classes by an aggregation, without
ever bringing a host's pages together. Classes whose tokens are on more than half of the
host's pages are candidates for its template. On a page a class is valid if its tokens come
in the class's order, round after round, and if it nests: its span lies in one gap of any
larger class that it meets. Valid classes are the template, and the gaps between their
tokens are the slots.

A page's text is what its slots hold: text that belongs to the template is the host's, and
slots of links are its menus. Where the page itself marks its article, that is the slot,
and all of it is kept, fixed text too. What lies in a menu, header, footer, sidebar,
notice, advert, form, comment thread or raw-text element, by tag, role, class or id, is
outside any slot. A template that would leave nothing of a page isn't that page's.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import map_batches, read, small, staged

#: A template token is on this share of a host's distinct pages and one more page; it takes so many pages to tell.
SHARE, PAGES = 0.5, 3
#: Templates, and tokens in them, that a join may broadcast.
HOSTS, TOKENS = 5_000, 500_000

# Fixed values of the HTML standard: elements that begin and end a block, void elements,
# and elements whose content is raw text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|noembed|noframes|iframe|xmp|svg|math|template|object|canvas|video|audio"
#: Containers that never hold the article's text; those of them, and others, that lie inside a block.
OUTSIDE = frozenset("nav header footer aside form head title menu button select textarea dialog option optgroup search".split())
INLINE = frozenset("span ins button select textarea label".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle banner banners sponsor sponsored promo promotion promoted nav navbar navigation menu "
    "menus breadcrumb breadcrumbs header masthead footer sidebar sidebars aside rail widget widgets cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay subscribe subscription newsletter signup login comment comments commentlist disqus replies reply respond discussion share sharing social "
    "related recommended recommendations pagination pager toolbar skip hidden".split()
)
#: The same for an element that is itself marked as an article; and names that mark one.
ARTICLE_NAMES = frozenset("comment comments reply replies related recommended ad advert sponsored promo".split())
MARKED = frozenset("article post entry story content main".split())
WORDS = re.compile(r"[A-Za-z]+")
TOKEN = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{RAW})(?=[\s/>])(?P<rawattr>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>(?:\s*=\s*\"[^\"]*\"|\s*=\s*'[^']*'|[^>])*)>|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"([^\s\"'>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s\"'>/=]+)")

def traits(tag: str, attr: str) -> tuple[bool, bool, str]:
    """Whether a container's attributes put it outside the article, whether they mark one, and its class and role words."""
    names, roles, outside = [], [], False
    for name, a, b, c, bare in ATTR.findall(attr):
        name, value = (name or bare).lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            outside = True
        elif name == "role":
            roles.append(value)
        elif name in ("class", "id"):
            names += [w for part in value.split() if not re.match(r"(has|with|no|without)[-_]", part) for w in WORDS.findall(part)]
    known = ARTICLE_NAMES if tag in ("article", "main") else () if tag in ("html", "body") else NAMES
    outside = outside or any(w in known for w in names) or any(r in ROLES for r in roles)
    return outside, "main" in roles or "article" in roles or tag in ("div", "section") and any(w in MARKED for w in names), " ".join(sorted({*names, *roles}))


#: Elements that an opening tag closes when it comes straight inside them.
CLOSES = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "option": ("option",), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("td", "th", "tr", "p")}


def tokens(page: str) -> Iterator[tuple[int, str | None, bool, int]]:
    """The page's tokens in order: (hash, None, False, 0) for a container's tag, (hash, text, in the marked article, characters in links) for a block that isn't outside."""
    # Each open element: tag, hash of its place, inside the article, outside it (1 by name, 2 by tag).
    stack: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]
    block: list[str] = []
    at = linked = 0
    link = False

    def flush() -> Iterator[tuple[int, str | None, bool, int]]:
        nonlocal linked
        text = " ".join("".join(block).split())
        block.clear()
        if text:
            _, place, inside, _ = stack[-1]
            yield signed(xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), place)), text, inside, linked
        linked = 0

    for m in TOKEN.finditer(page):
        if m.start() > at and not stack[-1][3]:
            block.append(html.unescape(page[at : m.start()]))
            linked += link * len(block[-1])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        inline = tag in INLINE
        if tag not in BLOCK and tag not in OUTSIDE and not inline:
            if tag == "br":
                block.append(" ")
            elif tag == "a":
                link = not m["end"]
            continue
        if not inline:
            yield from flush()
        if m["end"]:
            if any(x[0] == tag for x in stack):
                while stack[-1][0] != tag:
                    stack.pop()
                place = stack.pop()[1]
                if not inline:
                    yield signed(place ^ 1), None, False, 0
            continue
        if tag in VOID:
            continue
        if not inline:
            closes = CLOSES.get(tag, ("p",))
            while stack[-1][0] in closes:
                stack.pop()
        _, place, inside, outside = stack[-1]
        named, marks, words = traits(tag, m["attr"]) if m["attr"] else (False, False, "")
        article = tag in ("article", "main")
        if article and outside < 2 and not inside:
            outside = 0
        if tag in OUTSIDE and not (tag == "header" and inside):
            outside = 2
        elif named and not outside:
            outside = 1
        place = xxhash.xxh64_intdigest(f"{tag} {words}", place)
        stack.append((tag, place, inside or article or marks, outside))
        if not inline:
            yield signed(place), None, False, 0
    if at < len(page) and not stack[-1][3]:
        block.append(html.unescape(page[at:]))
    yield from flush()


def signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, token, n, first, page) for each page's distinct tokens: how often, and first at which place."""
    for whole in batches:
        for at in range(0, whole.num_rows, 128):
            batch = whole.slice(at, 128)
            out: list[list] = [[], [], [], [], []]
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = page.as_py() or ""
                seen: dict[int, list[int]] = {}
                for k, (h, *_) in enumerate(tokens(page)):
                    seen.setdefault(h, [0, k])[0] += 1
                uid = signed(xxhash.xxh64_intdigest(page.encode("utf-8", "replace")))
                for column, values in zip(out, ([name] * len(seen), seen, [n for n, _ in seen.values()], [k for _, k in seen.values()], [uid] * len(seen))):
                    column.extend(values)
            types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["host", "token", "n", "first", "page"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, template) from (host, html): each host's equivalence classes, a class its tokens in order."""
    # Copies count once. Only pages that have copies are shuffled.
    keyed = pages.select("host", "html", F.xxhash64("html").alias("a"), F.xxhash64(F.lit(1), "html").alias("b"))
    copied = staged(keyed.groupBy("host", "a", "b").count().where("count > 1").select("host", "a", "b"), "copied")
    single = keyed.join(small(copied), ["host", "a", "b"], "left_anti").select("host", "html")
    copies = keyed.join(small(copied), ["host", "a", "b"], "left_semi").dropDuplicates(["host", "a", "b"]).select("host", "html")
    seen = map_batches(single.unionByName(copies), occurrences, "host string, token long, n int, first int, page long")
    # An occurrence vector's fingerprint: sums of hashes of (page, count), in halves that can't overflow.
    mark = F.xxhash64("page", "n")
    low, high = F.sum(mark.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftright(mark, 32))
    found = seen.groupBy("host", "token").agg(F.count("*").alias("support"), low.alias("low"), high.alias("high"), F.min(F.struct("page", "first"))["first"].alias("first"))
    found = staged(found.where(F.col("support") >= PAGES), "tokens")
    pages_of = found.groupBy("host").agg(F.max("support").alias("pages"))
    frequent = found.join(pages_of, "host").where(F.col("support") >= SHARE * F.col("pages") + 1)
    classes = frequent.groupBy("host", "support", "low", "high").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "token"))), lambda x: x["token"]).alias("class"))
    return classes.groupBy("host").agg(F.collect_list("class").alias("template"))


def valid_tokens(page: list[int], template: list[list[int]]) -> set[int]:
    """The places of a page's tokens that belong to valid classes."""
    of = {t: (c, k) for c, tokens in enumerate(template) for k, t in enumerate(tokens)}
    places: dict[int, list[tuple[int, int]]] = {}
    for at, t in enumerate(page):
        if t in of:
            places.setdefault(of[t][0], []).append((at, of[t][1]))
    ordered = []
    for c, found in places.items():
        n = len(template[c])
        if len(found) % n == 0 and all(k == i % n for i, (_, k) in enumerate(found)):
            ordered.append([at for at, _ in found])
    # Larger classes first; a class must lie in one gap of each that it meets.
    kept: list[list[int]] = []
    for own in sorted(ordered, key=lambda x: (-len(x), x)):
        if all(bisect(big, own[0]) == bisect(big, own[-1]) or bisect(own, big[0]) == bisect(own, big[-1]) for big in kept):
            kept.append(own)
    return {at for own in kept for at in own}


def main_text(page: str | None, template: list[list[int]] | None) -> str:
    """The article's blocks, joined by line breaks."""
    found = list(tokens(page or ""))
    if any(inside for _, text, inside, _ in found if text is not None):
        return "\n".join(text for _, text, inside, _ in found if text is not None and inside)
    fixed = valid_tokens([h for h, *_ in found], template) if template else set()
    slots: list[list[int]] = [[]]
    for at, (_, text, *_) in enumerate(found):
        if at in fixed:
            slots.append([])
        elif text is not None:
            slots[-1].append(at)
    if fixed:
        slots = [s for s in slots if 2 * sum(found[at][3] for at in s) <= sum(len(found[at][1]) for at in s)]
    kept = [found[at][1] for slot in slots for at in slot]
    return "\n".join(kept or [text for _, text, *_ in found if text is not None])


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row: id_col, url_col, text, n_chars.

    Null and empty pages have an empty text. Pages with a null or odd url share the empty
    host. Equal pages of a host count once in its template; rows with null or repeated
    ids keep their own rows; other columns are ignored.
    """
    name = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), name.alias("host"))
    known = staged(templates(own.select("host", "html")), "templates")
    held = known.agg(F.coalesce(F.sum(F.size(F.flatten("template"))), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                texts = [main_text(page.as_py(), template.as_py()) for page, template in zip(batch.column(2), batch.column(3))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["id", "url", "text", "n_chars"])

    joined = own.join(small(known, HOSTS) if held <= TOKENS else known.hint("merge"), "host", "left").select("id", "url", "html", "template")
    kind = own.schema["id"].dataType.simpleString()
    out = map_batches(joined, run, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extracted(read(spark, sf_dir, "pages"))
