"""Main text of pages by a site style tree.

The pages of a host are merged by the style paths of their elements (tag and class from the root down). Of each path the
tree knows how its presentation (the sequence of child elements) and its content (the text below) are spread over the
host's pages; the importance of a node is the entropy of both, so what all pages share has none. Copies of a page are one
page: they say nothing about what different pages share. Elements whose kind alone
says that they aren't content (menus, adverts, forms …) have an importance of zero, the article's own flow has full
importance. Branches of low importance are taken off each page and the blocks that are left are its text.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogwatch.llm.store import settle

# Importance below which a branch goes, the share of content in it, and the pages a host needs for a judgement.
LEAST_IMPORTANCE = 0.2
CONTENT_SHARE = 0.8
LEAST_PAGES = 5
ROWS = 128

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style title textarea noscript iframe template svg math canvas object head select button dialog".split())
RAW = frozenset("script style title textarea noscript iframe template".split())
NOISE_TAGS = frozenset("nav aside footer form menu fieldset".split())
PAGE_HEADER = frozenset(["header"])
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
FLOW = frozenset("article main p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption body html".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup "
    "modal overlay newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments "
    "disqus respond replies related recommended share sharing social widget pagination pager masthead toolbar search login".split()
)
# An open element that a start tag of the key ends, and the elements that keep it from being looked for further up.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
}
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "option", "legend"}
P_SCOPE = frozenset("table td th caption button object".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>""")
_ANY_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_WORD = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "path", "parent", "noise", "children", "article", "main")

    def __init__(self, tag: str, path: str, parent: int, noise: bool, article: bool, main: bool):
        self.tag, self.path, self.parent, self.noise, self.article, self.main = tag, path, parent, noise, article, main
        self.children: list[str] = []


def _is_noise(tag: str, attrs: dict[str, str], article: bool) -> bool:
    if tag in UNSEEN or tag in NOISE_TAGS or (tag in PAGE_HEADER and not article):
        return True
    if tag in ("article", "main", "body", "html"):
        return tag == "article" and not NOISE_WORDS.isdisjoint(_WORD.findall(attrs.get("class", "").lower()))
    if "hidden" in attrs or attrs.get("role", "").lower() in NOISE_ROLES or _HIDDEN.search(attrs.get("style", "")):
        return True
    return not NOISE_WORDS.isdisjoint(_WORD.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()))


def parse(html: str) -> tuple[list[Node], list[tuple[int, str | None]]]:
    """Elements in page order, and the page's flow: (element, text), or (element, None) where a block begins or ends."""
    nodes = [Node("", "", -1, False, False, False)]
    flow: list[tuple[int, str | None]] = []
    stack = [0]
    at, n = 0, len(html)

    def pop_to(k: int) -> None:
        for i in reversed(stack[k:]):
            if nodes[i].tag in BLOCKS:
                flow.append((i, None))
        del stack[k:]

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            flow.append((stack[-1], html[at:]))
            break
        if lt > at:
            flow.append((stack[-1], html[at:lt]))
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if html[lt + 1 : lt + 2] in ("!", "?"):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(html, lt) or _ANY_TAG.match(html, lt)
        if not m:
            if re.match(r"</?[a-zA-Z]", html[lt : lt + 3]):  # a tag that never ends
                break
            flow.append((stack[-1], "<"))
            at = lt + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    pop_to(k)
                    break
            continue
        closes, scope = ({"p"}, P_SCOPE) if tag in ENDS_P else (set(), set())
        for closes, scope in ((closes, scope), CLOSES.get(tag, (set(), set()))):
            for k in range(len(stack) - 1, 0, -1) if closes else ():
                open_tag = nodes[stack[k]].tag
                if open_tag in closes:
                    pop_to(k)
                    if tag != "tr":
                        break
                elif open_tag in scope:
                    break
        attrs = {a.lower(): x or y or z for a, x, y, z in reversed(_ATTR.findall(m[3]))} if m[3].strip(" /") else {}
        parent = nodes[stack[-1]]
        noise = _is_noise(tag, attrs, parent.article)
        label = f"{tag}.{'.'.join(sorted(attrs['class'].split()))}" if attrs.get("class") else tag
        node = Node(
            tag, f"{parent.path}/{label}", stack[-1], noise, (parent.article or tag == "article") and not noise, parent.main or tag == "main"
        )
        parent.children.append(label)
        nodes.append(node)
        here = len(nodes) - 1
        if tag in BLOCKS:
            flow.append((here, None))
        elif tag == "br":
            flow.append((stack[-1], " "))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            close = html.find(">", end.end()) if end else -1
            at = n if close < 0 else close + 1
        elif tag not in VOID:
            stack.append(here)
    return nodes, flow


def _line(pieces: list[str]) -> str:
    return " ".join(entities.unescape("".join(pieces)).split())


def _own(nodes: list[Node], flow: list[tuple[int, str | None]], low: frozenset[str]) -> set[str]:
    """Those of the ``low`` paths that hold most of the page's own article; all of them if the rest would still take most of it.

    Boxes around an article are only looked at where the article is most of what the page says.
    """
    noise = [False] * len(nodes)
    for i, x in enumerate(nodes[1:], 1):
        noise[i] = noise[x.parent] or x.noise
    page = 0
    pieces: list[tuple[int, set[str], set[str]]] = []  # size, low paths within the article, and around it
    for i, text in flow:
        if not text or noise[i] or not (size := sum(map(len, text.split()))):
            continue
        page += size
        if nodes[i].article:
            within, around = set(), set()
            while i > 0:
                x = nodes[i]
                if x.path in low and x.tag not in FLOW:
                    (within if x.article else around).add(x.path)
                i = x.parent
            pieces.append((size, within, around))
    total = sum(size for size, _, _ in pieces)
    taken = [(size, within | around if 2 * total > page else within) for size, within, around in pieces]
    held: dict[str, int] = {}
    for size, paths in taken:
        for path in paths:
            held[path] = held.get(path, 0) + size
    own = {path for path, size in held.items() if 2 * size > total}
    return set(held) if 2 * sum(size for size, paths in taken if paths - own) > total else own


def main_text(html: str | None, low: frozenset[str] = frozenset()) -> str:
    """Blocks of the article (else of the main element, else of the body) without noise and branches of ``low`` paths."""
    if not html:
        return ""
    nodes, flow = parse(html)
    if low:
        low = low - _own(nodes, flow, low)
    gone = [False] * len(nodes)
    for i, x in enumerate(nodes[1:], 1):
        gone[i] = gone[x.parent] or x.noise or (x.path in low and x.tag not in FLOW)
    inside = "article" if any(x.article and not g for x, g in zip(nodes, gone)) else "main" if any(x.main and not g for x, g in zip(nodes, gone)) else ""
    lines, pieces = [], []
    for i, text in [*flow, (0, None)]:
        if text is None:
            if pieces and (line := _line(pieces)):
                lines.append(line)
            pieces = []
        elif not gone[i] and (not inside or getattr(nodes[i], inside)):
            pieces.append(text)
    return "\n".join(lines)


def style_features(html: str | None) -> list[tuple[str, int, int]]:
    """For each style path of a page that isn't judged by its kind: the path, and hashes of presentation and content."""
    if not html:
        return []
    nodes, flow = parse(html)
    texts: dict[int, list[str]] = {}
    for i, text in flow:
        while text and i > 0:
            texts.setdefault(i, []).append(text)
            i = nodes[i].parent
    out: dict[str, tuple[int, int]] = {}
    for i, x in enumerate(nodes):
        if i and x.tag in BLOCKS and x.tag not in FLOW and not x.noise:
            shape = zlib.crc32(" ".join(x.children).encode("utf-8", "replace"))
            words = zlib.crc32(_line(texts.get(i, [])).encode("utf-8", "replace"))
            a, b = out.get(x.path, (0, 0))
            out[x.path] = (zlib.crc32(b"%d %d" % (a, shape)), zlib.crc32(b"%d %d" % (b, words)))  # equal paths of a page, in order
    return [(path, a, b) for path, (a, b) in out.items()]


def _host(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def style_tree(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, path, pages, importance`` of every style path that isn't judged by its kind.

    Equal pages of a host count once. Features are counted by (host, path, feature) first, so a host with most of all pages
    is spread over its features and only counts meet under the host.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(h, m, *x) for h, m, page in zip(hosts, marks, batch.column(2)) for x in style_features(page.as_py())]
            columns = list(zip(*rows)) or [(), (), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                names=["host", "page", "path", "shape", "content"],
            )

    rows = pages.select(_host(url).alias("host"), F.xxhash64(html).alias("page"), F.col(html).alias("html"))
    found = rows.mapInArrow(run, "host string, page long, path string, shape long, content long").distinct()
    features = found.select("host", "path", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("shape").alias("feature")), F.struct(F.lit(1).alias("kind"), F.col("content").alias("feature")))).alias("x"))
    counts = features.groupBy("host", "path", "x.kind", "x.feature").agg(F.count(F.lit(1)).alias("c"))
    spread = counts.groupBy("host", "path", "kind").agg(F.sum("c").alias("pages"), F.sum(F.col("c") * F.log("c")).alias("s"))
    entropy = F.when(F.col("pages") > 1, (F.log("pages") - F.col("s") / F.col("pages")) / F.log("pages")).otherwise(1.0)
    weight = F.when(F.col("kind") == 1, CONTENT_SHARE).otherwise(1 - CONTENT_SHARE)
    return spread.groupBy("host", "path").agg(F.max("pages").alias("pages"), F.sum(entropy * weight).alias("importance"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text``: one row per input row, other columns ignored.

    A null or empty page, and one that is all noise, has the empty text; repeated rows are kept (and count as one page
    of their host); a null url is a host of its own; a null page_id is kept. An empty table gives an empty table.
    """
    tree = style_tree(pages, url, html)
    low = tree.where((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LEAST_IMPORTANCE))
    # One row for each host: its template's paths. Written first, so that its true size decides how it is joined.
    low = settle(low.groupBy("host").agg(F.collect_set("path").alias("low")), "style-tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [main_text(x.as_py(), frozenset(y.as_py() or ())) for x, y in zip(part.column(2), part.column(3))]
                texts = [x.encode("utf-8", "replace").decode() for x in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), _host(url).alias("host"))
    return rows.join(low, "host", "left").select("page_id", "url", "html", "low").mapInArrow(run, "page_id long, url string, text string")
