"""Operator 6: main text of web pages by wrappers inferred from pages of the same host.

A wrapper is a union-free regular expression over a page's tokens, kept as a
tree: elements in order, each once, optional (?) or repeated (+), and texts
that are constant or slots (#PCDATA). Pages of a host are merged into it one
after another: children are aligned on their longest common subsequence,
elements that only one side has become optional, runs of equal siblings and
tandem groups of siblings fold into repeated ones, and texts that differ
become slots. Every page counts: a task merges all its pages into a partial
wrapper of each host, and partial wrappers are merged in the same way.

The wrapper decides where a host keeps its article: the smallest container
that holds most of the text that differs between pages and stands in no link;
from there up to the article or main element around it, or to the container
that also has its heading. It also says what is the template's there: texts,
and elements with their texts, that are equal in all pages, where at least
TEMPLATE_PAGES pages differ in the rest of the article and have more of it
than of the template (copies of one article have no template).

A wrapper keeps every element that any page has, however many there are;
nesting below DEEP levels is learned as siblings. A task sends its wrappers
when they have TASK_NODES nodes together, and the task that merges those of a
host holds the host's wrapper and one batch of parts. No html is shuffled;
decisions of up to HELD_BYTES are broadcast, more of them meet the pages in a
join on the host, whose hot hosts adaptive execution splits.

Text in menus, headers, footers, sidebars, forms, scripts and styles is left
out wherever it stands, by element and role; adverts, notices and comments
that no template gives away are told by words of class and id, as the last
resort. Defined results: a null or empty html gives an empty text; a null url
is a host of its own; equal pages give equal results; markup that is cut off
or not closed is closed at the end; pages of any length, and elements nested
to any depth, are extracted whole; other columns pass through, and one called
text is replaced.
"""

from __future__ import annotations

import hashlib
import html as entities
import pickle
import re
import sys
import zlib
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import arrow_map, partitions, saved, table, unused, with_columns

TEMPLATE_PAGES, DEEP, HELD_BYTES = 4, 2000, 1 << 25
#: Nodes of a task's wrappers and of the pages since they were counted last, beyond which it sends wrappers of half as many and begins anew.
TASK_NODES = 200_000
#: Part of the differing text that the article's container has at least.
MOST = 0.6

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CLOSES_P = BLOCKS - frozenset("body caption head html legend tbody td tfoot th thead title tr".split())
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr",), "tbody": ("tr", "thead", "tbody"), "tfoot": ("tr", "tbody")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "p": ("article", "div", "section", "td", "th", "li", "body", "main", "blockquote", "aside", "nav", "footer", "header", "figure", "form")}
LEFT_OUT = frozenset("aside audio button canvas dialog embed footer form head iframe input map menu nav noscript object script select style svg template textarea title video".split())
CONTAINERS = frozenset("article body center div html main section table tbody td tr".split())
HEADINGS = frozenset("h1 h2 header hgroup".split())
# Words of classes and ids of what is no article: anywhere in a name; as a whole name or its end; or before a word for a part of a page.
BOILERPLATE = frozenset("ad ads adbox adsbygoogle adslot adunit advert adverts advertisement advertisements banner breadcrumb breadcrumbs commentlist consent cookie cookies disqus dropdown footer gdpr login masthead menu modal nav navbar navigation newsletter pager pagination popup sidebar signup sponsor sponsored subscribe toolbar".split())
AT_END = frozenset("comment comments discussion notice notices promo promoted related replies reply respond response responses search share sharing skip social widget".split())
PARTS = frozenset("area bar block box button buttons container content count form header icons items link links list panel post posts section stories thread title tools wrapper".split())
#: The same for article elements, which may be comments or teasers of others.
OTHER_ARTICLE = frozenset("ad ads advert adverts comment comments promo related replies reply response responses sponsored teaser".split())
HEADERS = frozenset("global-header header main-header page-header site-header top-header".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|$)|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


def host_of(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def events(page: str):
    """("open", tag, signature, left out) | ("close", tag) | ("text", text), balanced, from tolerant parsing."""
    stack: list[str] = []
    within: Counter[str] = Counter()
    at, n = 0, len(page)

    def close(to: int):
        while len(stack) > to:
            within[stack[-1]] -= 1
            yield ("close", stack.pop())

    while at < n:
        m = TOKEN.match(page, at)
        if m is None:  # cannot be: any character matches; for safety's sake
            at += 1
            continue
        at = m.end()
        cdata, slash, tag, attributes, text = m.groups()
        if text is not None:
            yield ("text", entities.unescape(text))
        elif cdata is not None:
            yield ("text", cdata)
        elif tag is None:
            continue
        elif slash:
            tag = tag.lower()
            if within[tag]:
                yield from close(len(stack) - 1 - stack[::-1].index(tag))
            elif tag in ("p", "br"):
                yield ("open", tag, tag, False)
                yield ("close", tag)
        else:
            tag = tag.lower()
            if tag in CLOSES_P and within["p"]:
                yield from _close_implied(stack, ("p",), SCOPES["p"], close)
            if tag in ENDED_BY and any(within[x] for x in ENDED_BY[tag]):
                yield from _close_implied(stack, ENDED_BY[tag], SCOPES.get(tag, ("table",)), close)
            signature, out = _signature(tag, attributes) if attributes else (tag, tag in LEFT_OUT)
            yield ("open", tag, signature, out)
            if tag in VOID or (attributes.endswith("/") and tag in ("svg", "path")):
                yield ("close", tag)
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>|$", re.I).search(page, at) if at < n else None
                if end:
                    if at < end.start():
                        yield ("text", page[at : end.start()])
                    at = max(end.end(), at)
                yield ("close", tag)
            else:
                stack.append(tag)
                within[tag] += 1
    yield from close(0)


def _close_implied(stack, ended, scopes, close):
    for k in range(len(stack) - 1, -1, -1):
        if stack[k] in ended:
            yield from close(k)
            return
        if stack[k] in scopes:
            return


def _boilerplate(name: str) -> bool:
    """Whether a name of a class or id is one of what is no article."""
    parts = [x for x in re.split(r"[-_\d]+", name) if x]
    if not BOILERPLATE.isdisjoint(parts):
        return True
    return bool(parts) and (parts[-1] in AT_END or (parts[-1] in PARTS and not AT_END.isdisjoint(parts)))


def _signature(tag: str, attributes: str) -> tuple[str, bool]:
    found = {}
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), a or b or c)
    said = " ".join(found.get(k, "") for k in ("class", "id")).lower().split()
    style = found.get("style", "").replace(" ", "").lower()
    out = tag in LEFT_OUT or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
    if said and not out and tag not in ("html", "body", "main"):
        if tag == "article":
            out = any(not OTHER_ARTICLE.isdisjoint(re.split(r"[-_]+", x)) for x in said)
        else:
            out = any(map(_boilerplate, said)) or not HEADERS.isdisjoint(said)
    name = re.sub(r"\d+", "#", found.get("class") or found.get("id") or "").lower()
    role = "main" if found.get("role", "").lower() == "main" else ""
    return ".".join(x for x in (tag, role, *name.split()) if x), out


@dataclass(slots=True)
class Node:
    sig: str
    children: list
    optional: bool = False
    repeated: bool = False
    text: str | None = None  # of "#text": the constant, None for a slot
    chars: int = 0  # of "#text": of all pages
    seen: int = 1  # pages
    out: bool = False
    codes: frozenset = frozenset()  # of elements: hashes of all text in them, the smallest TEMPLATE_PAGES

    @property
    def tag(self) -> str:
        return self.sig.split(".", 1)[0]

    @property
    def main(self) -> bool:
        return self.sig.split(".")[1:2] == ["main"] or self.tag == "main"


def text_code(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little")


def joined_code(codes: list[int]) -> int:
    h = 0
    for c in codes:
        h = (h * 0x9E3779B97F4A7C15 + c + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def tree_of(page: str) -> Node:
    """The page as a wrapper of itself alone."""
    root = Node("#page", [])
    # (node, codes of the blocks of text in it, whether it is left out); below DEEP levels, children go to the last node above.
    stack: list[tuple[Node, list[int], bool]] = [(root, [], False)]
    for e in events(page):
        above, codes, out = stack[-1]
        if e[0] == "open":
            node = Node(e[2], [], out=e[3])
            (above if len(stack) < DEEP else stack[DEEP - 1][0]).children.append(node)
            stack.append((node, [], out or e[3]))
        elif e[0] == "close":
            stack.pop()
            above.codes = frozenset((joined_code(codes),))
            above.children = fold(above.children)
            if codes and not out:
                stack[-1][1].append(joined_code(codes))
        elif text := " ".join(e[1].split()):
            (above if len(stack) <= DEEP else stack[DEEP - 1][0]).children.append(Node("#text", [], text=text, chars=len(text)))
            codes.append(text_code(text))
    root.children = fold(root.children)
    root.codes = frozenset((joined_code(stack[0][1]),))
    return root


def fold(children: list[Node]) -> list[Node]:
    """Runs of equal siblings as one repeated element, then tandem groups of two or three."""
    out: list[Node] = []
    for c in children:
        if out and out[-1].sig == c.sig:
            seen = max(out[-1].seen, c.seen)
            optional = out[-1].optional and c.optional
            out[-1] = merge(out[-1], c, False)
            out[-1].repeated, out[-1].seen, out[-1].optional = c.sig != "#text", seen, optional
        else:
            out.append(c)
    for width in (2, 3):
        i = 0
        while i + 2 * width <= len(out):
            group = [c.sig for c in out[i : i + width]]
            if "#text" not in group and group == [c.sig for c in out[i + width : i + 2 * width]]:
                times = 2
                while group == [c.sig for c in out[i + times * width : i + (times + 1) * width]]:
                    times += 1
                folded = Node("#group", out[i : i + width], repeated=True, seen=out[i].seen)
                for t in range(1, times):
                    folded = merge(folded, Node("#group", out[i + t * width : i + (t + 1) * width], repeated=True), False)
                out[i : i + times * width] = [folded]
            i += 1
    return out


def aligned(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, as pairs of positions: a bit vector for each element of y."""
    if x == y:
        return [(i, i) for i in range(len(x))]
    where: dict[str, int] = {}
    for i, s in enumerate(x):
        where[s] = where.get(s, 0) | 1 << i
    every = (1 << len(x)) - 1
    rows = [every]  # zero bits: where the common subsequence with a prefix of y grows
    for s in y:
        v = rows[-1]
        u = v & where.get(s, 0)
        rows.append((v + u | v - u) & every)
    out, i, j = [], len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif ((rows[j] ^ rows[j - 1]) & ((1 << i) - 1)).bit_count() == 0 or (rows[j] & ((1 << i) - 1)).bit_count() == (rows[j - 1] & ((1 << i) - 1)).bit_count():
            j -= 1
        else:
            i -= 1
    return out[::-1]


def merge(a: Node, b: Node, pages: bool = True) -> Node:
    """The least general wrapper of both. `pages`: b is of other pages, so that elements of one side only are optional."""
    node = Node(a.sig, [], optional=a.optional or b.optional, repeated=a.repeated or b.repeated, chars=a.chars + b.chars, seen=a.seen + b.seen if pages else max(a.seen, b.seen), out=a.out or b.out)
    if a.sig == "#text":
        node.text = a.text if a.text == b.text else None
        return node
    node.codes = frozenset(sorted(a.codes | b.codes)[:TEMPLATE_PAGES])
    x, y = a.children, b.children
    out: list[Node] = []
    i = j = 0
    for p, q in [*aligned([c.sig for c in x], [c.sig for c in y]), (len(x), len(y))]:
        for c in (*x[i:p], *y[j:q]):
            c.optional = True
            out.append(c)
        if p < len(x):
            out.append(merge(x[p], y[q], pages))
        i, j = p + 1, q + 1
    node.children = fold(out)
    return node


def infer(pages: list[str]) -> Node | None:
    wrapper = None
    for page in pages:
        wrapper = tree_of(page) if wrapper is None else merge(wrapper, tree_of(page))
    return wrapper


def walk(wrapper: Node):
    """(node, its ancestors' number) of all nodes, parents first, in order."""
    stack = [(wrapper, 0)]
    while stack:
        node, depth = stack.pop()
        yield node, depth
        stack += [(c, depth + 1) for c in reversed(node.children)]


def dumped(wrapper: Node) -> bytes:
    return pickle.dumps([(d, n.sig, n.optional, n.repeated, n.text, n.chars, n.seen, n.out, n.codes) for n, d in walk(wrapper)])


def loaded(data: bytes) -> Node:
    path: list[Node] = []
    for depth, sig, *rest in pickle.loads(data):
        del path[depth:]
        path.append(Node(sig, [], *rest))
        if depth:
            path[depth - 1].children.append(path[depth])
    return path[0]


def expression(wrapper: Node) -> str:
    """The wrapper as a union-free regular expression."""
    said: list[str] = []
    open_nodes: list[Node] = []

    def close(to: int):
        while len(open_nodes) > to:
            node = open_nodes.pop()
            if not node.sig.startswith("#") and node.children:
                said.append(f"</{node.tag}>")
            mark = ("*" if node.optional else "+") if node.repeated else "?" if node.optional else ""
            if mark:
                said[-1] += f"){mark}"

    for node, depth in walk(wrapper):
        close(depth)
        open_nodes.append(node)
        first = len(said)
        if node.sig == "#text":
            said.append("#PCDATA" if node.text is None else node.text)
        elif not node.sig.startswith("#") or not node.children:
            said.append(f"<{node.sig}>" if not node.sig.startswith("#") else "")
        if node.optional or node.repeated:
            if first < len(said):
                said[first] = f"({said[first]}"
            else:
                said.append("(")
    close(0)
    return re.sub(r"\( ", "(", " ".join(x for x in said if x))


def path_code(above: int, sig: str) -> int:
    return zlib.crc32(sig.encode("utf-8", "replace"), above)


def decide(wrapper: Node) -> tuple[tuple[str, ...] | None, frozenset]:
    """(path of the element that holds the article, its template); no path: none found. The template has (code of path, text) of texts
    and (code of path, code of all text) of elements."""
    nodes = list(walk(wrapper))
    paths: list[tuple[int, bool, bool, bool]] = []  # (code, left out, in a link, in an element of equal text) of each node
    above: list[int] = []
    parent = [0] * len(nodes)
    for k, (node, depth) in enumerate(nodes):
        del above[depth:]
        code, out, link, same = paths[above[-1]] if above else (0, False, False, False)
        parent[k] = above[-1] if above else -1
        plain = not node.sig.startswith("#")
        equal = plain and wrapper.seen > 1 and node.seen == wrapper.seen and not node.repeated and not node.optional and len(node.codes) == 1
        paths.append((path_code(code, node.sig) if plain else code, out or node.out, link or node.tag == "a", same or equal))
        above.append(k)

    def weigh(differing: bool) -> list[int]:
        total = [0] * len(nodes)
        for k, (node, _) in enumerate(nodes):
            _, out, link, same = paths[k]
            ours = node.sig == "#text" and not out and not link and (not differing or wrapper.seen == 1 or (node.text is None and not same))
            total[k] = node.chars if ours else 0
        for k in range(len(nodes) - 1, 0, -1):
            total[parent[k]] += total[k]
        return total

    def ancestors(k: int) -> list[int]:
        out = []
        while parent[k] >= 0:
            k = parent[k]
            out.append(k)
        return out

    every = weigh(False)
    total = weigh(True)
    if not total[0]:
        total = every
    if not total[0]:
        return None, frozenset()
    children: list[list[int]] = [[] for _ in nodes]
    for k in range(1, len(nodes)):
        children[parent[k]].append(k)
    at, way = 0, [0]
    while big := [c for c in children[at] if total[c] >= MOST * total[0] and (nodes[c][0].sig.startswith("#g") or nodes[c][0].tag in CONTAINERS) and not nodes[c][0].repeated]:
        at = big[0]
        way.append(at)
    named = [i for i, k in enumerate(way) if nodes[k][0].tag == "article"] or [i for i, k in enumerate(way) if nodes[k][0].main]
    # An article that is the same in all pages, beside something that differs.
    beside = [k for k in range(way[-1] + 1, len(nodes)) if nodes[k][0].tag == "article" and not paths[k][1] and 2 * every[k] >= every[way[-1]] and way[-1] in ancestors(k)] if not named else []
    if named:
        way = way[: named[-1] + 1]
    elif beside:
        way = [*ancestors(beside[0])[::-1], beside[0]]
    else:
        while len(way) > 2 and nodes[way[-2]][0].tag not in ("body", "html", "#page") and any(nodes[c][0].tag in HEADINGS and not nodes[c][0].out for c in children[way[-2]] if c != way[-1]):
            way.pop()
    root = tuple(nodes[k][0].sig for k in way if not nodes[k][0].sig.startswith("#"))
    if not root:
        return None, frozenset()
    top = nodes[way[-1]][0]
    template, constant = set(), 0
    if len(top.codes) >= TEMPLATE_PAGES:
        depth, whole = nodes[way[-1]][1], 0
        given = [False] * len(nodes)  # in an element of the template
        for k in range(way[-1] + 1, len(nodes)):
            node, d = nodes[k]
            if d <= depth:
                break
            code, out, _, same = paths[k]
            given[k] = given[parent[k]]
            if out:
                continue
            whole += node.chars
            if node.sig == "#text":
                fixed = node.text is not None and node.seen == wrapper.seen and not node.optional
                constant += node.chars if fixed or given[k] else 0
                if fixed and not given[k]:
                    template.add((code, node.text))
            elif same and not given[k] and node.tag in BLOCKS and len(node.codes) == 1 and node.codes != {0}:
                template.add((code, next(iter(node.codes))))
                given[k] = True
        if 2 * constant >= whole:
            template = set()
    return root, frozenset(template)


def extract(page: str, root: tuple[str, ...] | None, template: frozenset) -> str:
    """Main text of a page: inside every element on the wrapper's path; without one, in article or main elements, else all of it."""
    texts = texts_of(page, root, template)
    return "\n\n".join(texts["path"] or texts["named"] or texts["all"])


def texts_of(page: str, root: tuple[str, ...] | None, template: frozenset) -> dict[str, list[str]]:
    """Blocks of a page inside elements on the path, inside article or main elements, and all."""
    texts: dict[str, list[str]] = {"path": [], "named": [], "all": []}
    parts: dict[str, list[str]] = {k: [] for k in texts}
    # (tag, signature, left out, on the path, article or main, code of the path, blocks before, codes of texts within)
    stack: list[tuple] = []
    out = path_in = named_in = 0

    def flush():
        for k, part in parts.items():
            if part:
                if block := " ".join("".join(part).split()):
                    texts[k].append(block)
                part.clear()

    for e in events(page):
        if e[0] == "open":
            _, tag, signature, leaves = e
            if tag in BLOCKS:
                flush()
            elif tag == "br":
                for part in parts.values():
                    part.append(" ")
            leaves = leaves or (tag == "header" and not named_in and not path_in)
            here = bool(root) and signature == root[-1] and len(stack) >= len(root) - 1 and tuple(x[1] for x in stack[len(stack) - len(root) + 1 :]) == root[:-1]
            named = tag in ("article", "main") or signature.split(".")[1:2] == ["main"]
            stack.append((tag, signature, int(leaves), int(here), int(named), path_code(stack[-1][5] if stack else 0, signature), len(texts["path"]), []))
            out, path_in, named_in = out + stack[-1][2], path_in + stack[-1][3], named_in + stack[-1][4]
        elif e[0] == "close":
            if stack[-1][0] in BLOCKS:
                flush()
            tag, _, a, b, c, code, before, codes = stack.pop()
            if template and codes:
                whole = joined_code(codes)
                if not out and stack:
                    stack[-1][7].append(whole)
                if path_in > b and (code, whole) in template:
                    del texts["path"][before:]
            out, path_in, named_in = out - a, path_in - b, named_in - c
        elif not out:
            text = e[1]
            if template and stack and (plain := " ".join(text.split())):
                stack[-1][7].append(text_code(plain))
                if path_in and (stack[-1][5], plain) in template:
                    continue
            parts["all"].append(text)
            if path_in:
                parts["path"].append(text)
            if named_in:
                parts["named"].append(text)
    flush()
    return texts


def size_of(wrapper: Node) -> int:
    return sum(1 for _ in walk(wrapper))


def fit(pages: DataFrame) -> DataFrame:
    """Rows (host, expression, decision) of every host, from all its pages (url, html)."""
    rows = pages.select(host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html")).where("html IS NOT NULL")

    def learn(batches):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEEP))
        held: dict[str, Node] = {}
        size = 0

        def flush():
            for host, wrapper in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([dumped(wrapper)], pa.binary())], ["host", "part"])

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tree = tree_of(page.as_py())
                size += size_of(tree)
                held[host] = merge(held[host], tree) if host in held else tree
                if size > TASK_NODES:
                    # Most of a page is in its wrapper already.
                    size = sum(map(size_of, held.values()))
                    if 2 * size > TASK_NODES:
                        yield from flush()
                        held, size = {}, 0
        yield from flush()

    def wrap(batches):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEEP))
        host, wrapper = None, None

        def told():
            return pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([expression(wrapper)], pa.string()), pa.array([pickle.dumps(decide(wrapper))], pa.binary())], ["host", "expression", "decision"])

        for batch in batches:
            for of, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if wrapper is not None and of == host:
                    wrapper = merge(wrapper, loaded(part.as_py()))
                    continue
                if wrapper is not None:
                    yield told()
                host, wrapper = of, loaded(part.as_py())
        if wrapper is not None:
            yield told()

    parts = rows.transform(arrow_map, learn, "host string, part binary")
    parts = parts.repartition(partitions(pages.sparkSession), "host").sortWithinPartitions("host", "part")
    return saved(parts.transform(arrow_map, wrap, "host string, expression string, decision binary"))


#: Decisions of a Python worker's last hosts.
_decisions: dict[bytes, tuple] = {}


def _decision(data: bytes | None):
    if data is None:
        return None, frozenset()
    if data not in _decisions:
        if len(_decisions) > 1000:
            _decisions.clear()
        _decisions[data] = pickle.loads(data)
    return _decisions[data]


def main_text(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The rows of pages (url, html) with text."""
    spark = pages.sparkSession
    wrappers = fit(pages)
    wanted = list(pages.columns if keep is None else keep)
    mark = unused(pages, "__wrapper")
    host, page = host_of(F.col("url").cast("string")), F.col("html").cast("string")

    def texts(htmls, decisions):
        return [pa.array([extract(x, *_decision(d)) if x else "" for x, d in zip(htmls, decisions, strict=True)], pa.string())]

    if (wrappers.agg(F.sum(F.length("decision") + F.length("host"))).first()[0] or 0) <= HELD_BYTES:
        held = spark.sparkContext.broadcast({r["host"]: bytes(r["decision"]) for r in wrappers.select("host", "decision").collect()})
        out = with_columns(pages, [page, host], [(mark, "string")], lambda x, h: texts(x.to_pylist(), map(held.value.get, h.to_pylist())), wanted)
    else:
        met = pages.join(wrappers.select(F.col("host").alias(f"{mark}h"), F.col("decision").alias(f"{mark}d")), host == F.col(f"{mark}h"), "left")
        out = with_columns(met, [page, F.col(f"{mark}d")], [(mark, "string")], lambda x, d: texts(x.to_pylist(), d.to_pylist()), wanted)
    return out.select(*[F.col(f"`{c}`") for c in wanted if c != "text"], F.col(mark).alias("text"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
