"""Main text of web pages by wrappers inferred per host.

Pages of a host are read as token streams of block elements and texts. Equal
neighbours fold into repeated groups; streams are aligned pairwise, level by
level, and what one side lacks becomes an optional group, texts that differ
become slots. Folding the pages of a host one after another gives a union-free
regular expression of its pages, the wrapper. Tasks fold their own pages
first; one small wrapper per task and host then meets the others of the host,
so a hot host moves no pages. The wrapper's main group, chosen on the text
that all pages of the host put into it, is what is extracted from every page;
a page without that group is its own wrapper.

What is not text by its element is left out. A group that is so by its names
alone is left out where the pages of the host put at most half of their text
into it; a body, main part or article is never left out.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .common import slices, small

DEPTH = 150  # deeper elements count as part of the one at this depth; their texts stay

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp".split())
# elements that end an open paragraph, and those that end an open element of their own kind
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
HOLDS = frozenset("ul ol dl table tbody thead tfoot tr select".split())  # an implied end does not reach beyond these

# parts of a page that are not its text: by element, and by a word of class, id or role
NOT_TEXT = frozenset("head nav header footer aside form script style noscript template select button textarea title iframe svg canvas audio video object menu dialog".split())
NOT_TEXT_WORDS = frozenset("ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion menu nav navbar navigation navigationbar breadcrumb breadcrumbs sidebar aside header masthead footer footnav cookie cookies consent notice notices notification alert popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments commentlist reply replies respond disqus search searchform widget toolbar pagination pager skip complementary contentinfo".split())
NEVER_BY_NAME = frozenset("html body main article".split())
ELEMENT, NAMED = 2, 1  # why a node is not text
MAIN_WORDS = frozenset("article content main post entry story body text".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "sig", "items", "drop", "inline")

    def __init__(self, tag: str, sig: str, drop: int, inline: bool):
        self.tag, self.sig, self.items, self.drop, self.inline = tag, sig, [], drop, inline


def _words(names: str) -> set[str]:
    return {w for w in _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", names).lower()) if w}


def _not_text(tag: str, names: str, words: set[str]) -> int:
    """ELEMENT, NAMED or 0. In a sentence a whole name tells (promo, not search-term)."""
    if tag in NOT_TEXT:
        return ELEMENT
    if tag in NEVER_BY_NAME:
        return 0
    told = words & NOT_TEXT_WORDS
    if told and tag in INLINE:
        told = any(own and own <= NOT_TEXT_WORDS for own in map(_words, names.split()))
    return NAMED if told else 0


def parse(page: str) -> Node:
    """Tree of block elements; items are nodes, texts, and None for a line break. Any input parses."""
    root = Node("#root", "#root", 0, False)
    # every open element, with the node that takes its content: its own, or beyond DEPTH that of an outer one
    stack, tags, inlines, at, end = [root], ["#root"], [False], 0, len(page)
    opened: Counter[str] = Counter()

    def close(i: int) -> None:
        opened.subtract(tags[i:])
        del stack[i:], tags[i:], inlines[i:]

    while at < end:
        token = _TOKEN.match(page, at)
        if token is None:  # an unfinished tag: the rest of it is markup up to the next one
            nxt = page.find("<", at + 1)
            at = end if nxt < 0 else nxt
            continue
        at = token.end()
        text, name = token.group(4), token.group(2)
        if text is not None:
            stack[-1].items.append(text)
            continue
        if name is None:
            continue
        tag = name.lower()
        if token.group(1):
            if opened[tag] > 0:
                close(next(i for i in range(len(tags) - 1, 0, -1) if tags[i] == tag))
            continue
        if tag == "br":
            stack[-1].items.append(None)
            continue
        if tag in RAW:
            over = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = over.end() if over else end
            continue
        names = " ".join(v for m in _NAMED.finditer(token.group(3)) for v in m.groups()[1:] if v) if token.group(3) else ""
        words = _words(names) if names else ()
        drop = _not_text(tag, names, set(words))
        inline = tag in INLINE
        if inline and not drop or tag in VOID and tag != "hr":
            continue
        for i in range(len(stack) - 1, 0, -1):  # implied ends
            open_ = tags[i]
            if open_ == "p" and tag in ENDS_P or open_ in ENDS_OWN.get(tag, ()):
                close(i)
                break
            if open_ in HOLDS or not inlines[i] and open_ not in ("p", "li", "dt", "dd", "td", "th", "tr", "option"):
                break
        if len(stack) > DEPTH and drop != ELEMENT:
            node = stack[-1]
            node.items.append(None)
        else:
            node = Node(tag, tag + "".join(f".{w}" for w in sorted(words)), drop, inline)
            stack[-1].items.append(node)
        if tag not in VOID and not token.group(3).endswith("/"):
            stack.append(node)
            tags.append(tag)
            inlines.append(inline)
            opened[tag] += 1
        elif tag == "hr":
            stack[-1].items.append(None)
    return root


# ---- wrappers: [signature, flags, characters, items]; an item is a wrapper or [None, flags, characters, text hash or None]

OPTIONAL, REPEATED, UNSURE = 1, 2, 4  # unsure: no text by its names


def _fold(items: list) -> list:
    """Neighbours of one signature become one repeated group."""
    out: list = []
    for item in items:
        if out and out[-1][0] == item[0]:
            out[-1] = align(out[-1], item)
            out[-1][1] |= REPEATED
        else:
            out.append(item)
    return out


def stream(node: Node) -> list:
    """A page's own wrapper. Elements that are not text are left out of it."""
    items = []
    for item in node.items:
        if isinstance(item, Node):
            if item.drop != ELEMENT:
                items.append(stream(item))
                items[-1][1] |= UNSURE * (item.drop == NAMED)
        elif item is not None and not item.isspace():
            plain = item.strip()
            items.append([None, 0, len(plain), hash_text(plain)])
    return [node.sig, 0, sum(i[2] for i in items), _fold(items)]


def hash_text(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def align(a: list, b: list) -> list:
    """The wrapper of both: equal signatures merge in order, the rest become optional, texts that differ slots."""
    flags, size = a[1] | b[1], a[2] + b[2]
    if a[0] is None:
        return [None, flags, size, a[3] if a[3] == b[3] else None]
    x, y = a[3], b[3]
    if [i[0] for i in x] == [i[0] for i in y]:
        return [a[0], flags, size, [align(i, j) for i, j in zip(x, y)]]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i][0] == y[j][0] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    merged = []
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i][0] == y[j][0]:
            merged.append(align(x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
            merged.append([x[i][0], x[i][1] | OPTIONAL, *x[i][2:]])
            i += 1
        else:
            merged.append([y[j][0], y[j][1] | OPTIONAL, *y[j][2:]])
            j += 1
    return [a[0], flags, size, _fold(merged)]


def settle(wrapper: list) -> tuple[list, list[list[str]]]:
    """The wrapper without the unsure groups that hold at most half of the text, and the paths of those that stay."""
    kept = []

    def walk(node: list, path: list[str]) -> list:
        items = []
        for item in node[3]:
            if item[0] is not None:
                below = [*path, item[0]]
                if item[1] & UNSURE:
                    if item[2] * 2 <= wrapper[2]:
                        continue
                    kept.append(below)
                item = walk(item, below)
            items.append(item)
        return [node[0], node[1] & ~UNSURE, sum(i[2] for i in items), items]

    return walk(wrapper, []), kept


def _is_main(sig: str) -> int:
    tag, *words = sig.split(".")
    return 3 if tag == "article" else 2 if tag == "main" or "main" in words else 1 if any(w in MAIN_WORDS for w in words) and tag != "body" else 0


def main_path(wrapper: list) -> list[str]:
    """Signatures from below the root to the main group.

    The named groups (an article, a main part, a group called content and the
    like) with the best rank and, among these, the most text; without any, the
    deepest group that holds nine tenths of the text.
    """
    found: list[tuple[int, int, list[str]]] = []
    todo = [(wrapper, [])]
    while todo:
        node, path = todo.pop()
        for item in node[3]:
            if item[0] is None:
                continue
            below = [*path, item[0]]
            rank = _is_main(item[0])
            if rank and item[2]:
                found.append((rank, item[2], below))
            if rank < 3:
                todo.append((item, below))
    if found:
        return max(found, key=lambda f: (f[0], f[1], f[2]))[2]
    node, path = wrapper, []
    while True:
        inner = [i for i in node[3] if i[0] is not None and i[2] * 10 >= wrapper[2] * 9 and not i[1] & REPEATED and i[0].split(".")[0] not in ("p", "pre", "li", "td")]
        if not inner or not wrapper[2]:
            return path
        node, path = inner[0], [*path, inner[0][0]]


def regular_expression(wrapper: list) -> str:
    """The wrapper as a union-free regular expression over tags and #text slots."""
    sign = {0: "", OPTIONAL: "?", REPEATED: "+", OPTIONAL | REPEATED: "*"}[wrapper[1] & ~UNSURE]
    if wrapper[0] is None:
        body = "#text" if wrapper[3] is None else f"'{wrapper[3]:08x}'"
        return f"({body}){sign}" if sign else body
    body = f"<{wrapper[0]}>" + "".join(map(regular_expression, wrapper[3])) + f"</{wrapper[0].split('.')[0]}>"
    return f"({body}){sign}" if sign else body


def _at(root: Node, path: list[str]) -> list[Node]:
    nodes = [root]
    for sig in path:
        nodes = [i for n in nodes for i in n.items if isinstance(i, Node) and i.drop != ELEMENT and i.sig == sig]
    return nodes


def text_of(nodes: list[Node]) -> str:
    """Blocks of the nodes in page order, one per line."""
    blocks, line = [], []

    def flush() -> None:
        if line:
            block = " ".join(entities.unescape("".join(line)).split())
            if block:
                blocks.append(block)
            line.clear()

    todo: list = list(reversed(nodes))
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            line.append(item)
        elif not item.drop:
            if item.inline:
                todo.extend(reversed(item.items))
            else:
                flush()
                todo.append(None)
                todo.extend(reversed(item.items))
    flush()
    return "\n".join(blocks)


def main_text(page: str, path: list[str] | None, kept: list[list[str]] | tuple = ()) -> str:
    root = parse(page)

    def keep(paths) -> None:
        for group in paths:
            for node in _at(root, group):
                node.drop = 0

    keep(kept)
    nodes = _at(root, path) if path is not None else []
    if not nodes or not path:
        own, more = settle(stream(root))
        keep(more)
        nodes = _at(root, main_path(own))
    return text_of(nodes)


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON) and path (JSON: that of the main group, those of the groups kept in spite of their names) of every host, over all its pages."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded: dict[str, list] = {}
        for batch in slices(batches, "html"):
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                one = stream(parse(page or ""))
                folded[name] = align(folded[name], one) if name in folded else one
        if folded:
            yield pa.RecordBatch.from_arrays([pa.array(list(folded)), pa.array([json.dumps(w) for w in folded.values()])], ["host", "wrapper"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        # one row per task that met the host
        whole = None
        for text in group["wrapper"]:
            one = json.loads(text)
            whole = one if whole is None else align(whole, one)
        whole, kept = settle(whole)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(whole)], "path": [json.dumps([main_path(whole), kept])]})

    parts = pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(own, "host string, wrapper string")
    return parts.groupBy("host").applyInPandas(join, "host string, wrapper string, path string")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, host, text and n_chars of every row of (page_id, url, html).

    A null or empty page, and one without text in its main group, has an empty
    text. Pages without a host share the empty one. Repeated rows are returned
    as often as they come; an empty table gives no rows. Wrappers join the
    pages by broadcast while they are few, else by host.
    """
    found = stage(wrappers(pages), "wrappers")
    source = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host(F.col("url")))
    joined = source.join(small(found.select("host", "path")), "host", "left").select("page_id", "url", "host", "path", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, list] = {}
        for batch in slices(batches, "html"):
            texts = []
            for path, page in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if path not in known:
                    known[path] = json.loads(path) if path else [None, []]
                texts.append(main_text(page or "", *known[path]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "host", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id bigint, url string, host string, text string, n_chars bigint")
