"""HTML extraction by wrapper induction.

The pages of a host share a template. For every host some reference pages (at most
``REFERENCES``, picked by hashes of their content, so that copies are one) are parsed and
aligned by simple tree matching over element names. The page that agrees best with the
others, cut down to the elements that most of them have, is the template of the host.
Then every page is aligned with its template, and what stands at each element is summed
up over all pages of the host, in aggregations that no hot host makes one task's lot:

- the smallest element that holds most of the text that varies is the content (the
  article or main element around it, if there is one), and what lies elsewhere, such as
  menus, adverts and footers whose words change from page to page, is template;
- a text that stays the same below one element in most pages is constant. At the content's
  edges, before the first and after the last text that varies, it is template, but for a heading
  that varying text follows; between them it is the article's (the headings of a recipe),
  unless the same text stands outside too;
- so are slots that are nothing but links in most pages, where no article or main frames the content;
  in one they are the article's own.

Pages are aligned a second time to take their content out. Names break the ties that no
alignment can: comments, forms, adverts and notices inside an article go by element names
and by class, id and role words of blocks (``MARKS``; of words in a sentence only by ``UNSEEN``), and a page without a
wrapper, for its host has too few pages or it has another layout, is judged by these and by where its text lies.

Simple tree matching is exact at every size: it runs without recursion, subtrees of one
shape are matched once, equal ones at the ends of a list of children pair off (which no
better mapping can beat), and the rest is a dynamic programme in rows, divided where its
table would be large. Where two lists have many different shapes, all pairs are scored at once, level by
level: 1,500 against 1,500 items of different shapes take a second or two, and 4 bytes a pair.

Character references are decoded, white space inside a block becomes one space, blocks
are trimmed and joined by line feeds in page order. Text is never cut.

Defined results: null or empty html gives an empty text; a null or odd url has no
host, and its page is judged alone; pages with the same two longest blocks count once
when constancy is judged, so that copies do not make an article a template; repeated
rows are extracted each; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import html as _html
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import in_arrow, materialize, release, small_batches, small_side

#: Reference pages of a host; the template comes from them, what is constant from all pages.
REFERENCES = 6
#: Share of pages that makes a text or a slot template, and pages of different content that it takes.
SUPPORT, LEAST = 0.6, 3
#: Share of the varying text that the content holds.
MOST_TEXT = 0.7
#: Cells of a matching table that are kept whole; larger ones are divided.
CELLS = 1 << 20
#: Pairs of children's shapes beyond which all are scored at once.
MANY = 1 << 10

# Element names of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
HIDDEN = frozenset("head script style template noscript iframe object svg canvas audio video map math select datalist textarea title".split())
AROUND = frozenset("nav footer aside form button menu dialog".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("table ul ol dl article body section main".split())
#: Words of class, id and role that name what surrounds an article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs toolbar sidebar aside "
    "footer header masthead cookie cookies consent gdpr notice notices alert warning popup modal overlay newsletter subscribe subscription signup login comment comments commentlist "
    "reply replies respond disqus share sharing social related recommended pagination pager search widget copyright legal skip hidden complementary contentinfo".split()
)
#: Those that never frame an article; the others don't count where an element holds a heading h1, a main or an article.
NEVER = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo comment comments commentlist reply replies respond disqus cookie cookies consent gdpr hidden".split())
#: Those that also take a word out of a sentence; any other name of an inline element tells nothing about what it holds.
UNSEEN = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored hidden".split())
#: Layout words that may stand beside a mark in one name; with any other word the name is the article's own.
BESIDE = frozenset(
    "area article bar bars block body bottom box btn button buttons col column container content entry fixed form global group head icon icons inline inner item items label left link links "
    "list main module outer page panel post posts primary right row section secondary site slot sticky tag tags text title top unit user view wrap wrapper zone".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NAMED = re.compile(r"class|id|role|hidden|style", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


class Node:
    """An element: its name, children and blocks, and the shape of all below it."""

    __slots__ = ("tag", "kids", "parent", "never", "around", "holds", "main", "blocks", "chars", "shape", "size", "at", "near")

    def __init__(self, tag: str, parent: Node | None, never: bool = False, around: bool = False):
        self.tag, self.parent, self.kids = tag, parent, []
        self.never = never or bool(parent and parent.never)
        self.around, self.holds = around, False
        self.main = bool(parent and parent.main)
        self.blocks: list[Block] = []
        self.chars, self.shape, self.size, self.at, self.near = 0, 0, 1, -1, -1


class Block:
    """A run of text that no block element interrupts; ``skip``: names say that it stands in something around the article."""

    __slots__ = ("node", "raw", "linked", "text", "skip")

    def __init__(self, node: Node):
        self.node, self.raw, self.linked, self.text, self.skip = node, [], 0, "", False


def _marks(name: str) -> set[str]:
    """The words of one class, id or role that name something around an article."""
    words = {w.lower() for w in _WORD.findall(name)}
    found = words & MARKS
    return found if found and words <= found | BESIDE else set()


def _attributes(raw: str) -> tuple[set[str], bool]:
    """(the marks in an element's attributes, whether it is the main one by its role)."""
    out: set[str] = set()
    main = False
    if not raw or not _NAMED.search(raw):
        return out, main
    for k, v in _ATTRIBUTE.findall(raw):
        k = k.lower()
        if v[:1] in ("'", '"'):
            v = v.strip(v[0])
        if k in ("class", "id", "role"):
            for name in v.split():
                out |= _marks(name)
            main = main or k == "role" and v == "main"
        elif k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and _HIDES.search(v):
            out.add("hidden")
    return out, main


def parse(page: str) -> tuple[Node, list[Block], list[Node]]:
    """The tree of a page, its blocks and its elements in page order. Never fails, whatever the markup."""
    root = Node("#", None)
    now, blocks, nodes = root, [], [root]
    block: Block | None = None
    depth_skip: list[str] = []  # open inline elements that hide their text: by style, or as adverts
    links = 0
    at, end = 0, len(page)
    open_tags: Counter[str] = Counter()

    def put(text: str) -> None:
        nonlocal block
        if not text:
            return
        if block is None:
            if not text.strip():
                return
            block = Block(now)
            now.blocks.append(block)
            blocks.append(block)
        if depth_skip:
            text = " "
        block.raw.append(text)
        if links:
            block.linked += len(text.strip())

    def close(node: Node) -> None:
        """Closes all open elements up to this one."""
        nonlocal now
        while now is not node.parent:
            open_tags[now.tag] -= 1
            now = now.parent

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if m[1]:
                links -= tag == "a" and links > 0
                if depth_skip and depth_skip[-1] == tag:
                    depth_skip.pop()
            else:
                links += tag == "a"
                if depth_skip:
                    if depth_skip[-1] == tag:
                        depth_skip.append(tag)
                elif m[3] and _attributes(m[3])[0] & UNSEEN:
                    depth_skip.append(tag)
            continue
        if tag in ("br", "wbr", "img", "input"):
            put(" " if tag == "br" and block is not None else "")
            continue
        block, links, depth_skip = None, 0, []
        if m[1]:  # an end tag closes what is open inside, if it is open at all
            if open_tags[tag]:
                node = now
                while node.tag != tag:
                    node = node.parent
                close(node)
            continue
        if tag in VOID:
            continue
        if now.tag == "p":
            close(now)
        if tag in CLOSED_BY and any(open_tags[t] for t in CLOSED_BY[tag]):
            node = now
            while node is not root and node.tag not in SCOPE:
                if node.tag in CLOSED_BY[tag]:
                    close(node)
                    break
                node = node.parent
        words, main = _attributes(m[3])
        if now.main:
            words.discard("header")  # of the article itself
        frame = tag in ("html", "body", "article", "main")
        never = tag in HIDDEN or tag in AROUND or bool(words & NEVER) and (not frame or tag == "article") or tag == "header" and not now.main
        node = Node(tag, now, never, bool(words) and not frame)
        node.main = node.main or tag in ("article", "main") or main
        if tag in ("h1", "article", "main") and not node.never:
            up = now
            while up is not None and not up.holds:
                up.holds = True
                up = up.parent
        now.kids.append(node)
        nodes.append(node)
        now = node
        open_tags[tag] += 1
        if tag in RAW:
            closing = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = closing.end() if closing else end
            close(node)
    outer: dict[int, bool] = {id(None): False}
    for node in nodes:  # parents first: what surrounds a node is known by then
        outer[id(node)] = outer[id(node.parent)] or node.around and not node.holds
    for b in blocks:
        b.text = " ".join(_html.unescape("".join(b.raw)).split())
        b.skip = b.node.never or outer[id(b.node)]
    return root, [b for b in blocks if b.text], shaped(nodes)


def shaped(nodes: list[Node]) -> list[Node]:
    """Gives the elements of a tree, parents first, the shape and the size of what they hold."""
    for node in reversed(nodes):
        node.shape = hash((node.tag, *[k.shape for k in node.kids]))
        node.size = 1 + sum(k.size for k in node.kids)
    return nodes


def _ends(a: list[Node], b: list[Node]) -> tuple[int, int]:
    """How many children of one shape two lists share at the start, and after that at the end."""
    most = min(len(a), len(b))
    lo = 0
    while lo < most and a[lo].shape == b[lo].shape:
        lo += 1
    hi = 0
    while hi < most - lo and a[-1 - hi].shape == b[-1 - hi].shape:
        hi += 1
    return lo, hi


def scores(left: list[Node], right: list[Node]) -> np.ndarray:
    """The matching scores of all pairs of two lists of subtrees of different shapes.

    Level by level from the deepest: at each the different shapes of all children on either side. One subtree
    goes against all of the other side that have its name at once, a step of the dynamic programme for
    each of its children."""
    levels = [(left, right)]
    while all(levels[-1]):
        levels.append(tuple(list({k.shape: k for n in side for k in n.kids}.values()) for side in levels[-1]))
    lower = np.zeros((len(levels[-1][0]), len(levels[-1][1]) + 1), np.int32)
    for k in range(len(levels) - 2, -1, -1):
        row_of, column_of = ({n.shape: i for i, n in enumerate(side)} for side in levels[k + 1])
        out = np.zeros((len(levels[k][0]), len(levels[k][1]) + 1), np.int32)  # the last column: no child
        groups: dict[tuple[str, int], list[int]] = {}
        for j, n in enumerate(levels[k][1]):
            groups.setdefault((n.tag, len(n.kids).bit_length()), []).append(j)
        for (tag, bits), columns in groups.items():
            width = (1 << bits) - 1
            kids = np.full((len(columns), width), lower.shape[1] - 1)
            for at, j in enumerate(columns):
                own = [column_of[c.shape] for c in levels[k][1][j].kids]
                kids[at, : len(own)] = own
            gathered: dict[int, np.ndarray] = {}
            for i, n in enumerate(levels[k][0]):
                if n.tag != tag:
                    continue
                best = np.zeros((width + 1, len(columns)), np.int32)
                for kid in n.kids if width else ():
                    r = row_of[kid.shape]
                    if r not in gathered:
                        if len(gathered) * kids.size > CELLS * 16:
                            gathered.clear()
                        gathered[r] = np.ascontiguousarray(lower[r][kids].T)
                    step = best[:-1] + gathered[r]
                    np.maximum(step, best[1:], out=step)
                    np.maximum.accumulate(step, axis=0, out=best[1:])
                out[i, columns] = 1 + best[-1]
        lower = out
    return lower[:, :-1]


class Matching:
    """Simple tree matching: the largest top-down mapping of two trees that keeps names and order."""

    def __init__(self):
        self.known: dict[tuple[int, int], int] = {}
        self.tables: dict[tuple, np.ndarray] = {}

    def score(self, a: Node, b: Node) -> int:
        """The size of the largest mapping; without recursion, each pair of shapes once."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if self._easy(x, y) is not None:
                todo.pop()
                continue
            lo, hi = _ends(x.kids, y.kids)
            xs, ys = x.kids[lo : len(x.kids) - hi], y.kids[lo : len(y.kids) - hi]
            left, right = ({k.shape: k for k in side if k.kids}.values() for side in (xs, ys))
            many = len(left) * len(right) > MANY  # these are scored all at once
            need = [] if many else [(p, q) for p in left for q in right if self._easy(p, q) is None]
            if need:
                todo += need
                continue
            ends = sum(k.size for k in x.kids[:lo]) + sum(k.size for k in x.kids[len(x.kids) - hi :])
            self.known[x.shape, y.shape] = 1 + ends + (int(self._last(self._weights(xs, ys))[-1]) if xs and ys else 0)
            todo.pop()
        return self._easy(a, b)

    def _easy(self, a: Node, b: Node) -> int | None:
        if a.tag != b.tag:
            return 0
        if a.shape == b.shape:
            return a.size
        return 1 if not a.kids or not b.kids else self.known.get((a.shape, b.shape))

    def _weights(self, xs: list[Node], ys: list[Node]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(table of scores by kind, kinds of xs, kinds of ys): children of one shape are of one kind."""
        sides = []
        for side in (xs, ys):
            first: dict[int, int] = {}
            kinds = np.array([first.setdefault(k.shape, len(first)) for k in side], np.intp)
            sides.append((kinds, list({k.shape: k for k in side}.values())))
        left, right = sides[0][1], sides[1][1]
        if sum(bool(k.kids) for k in left) * sum(bool(k.kids) for k in right) > MANY:
            key = (tuple(k.shape for k in left), tuple(k.shape for k in right))
            if key not in self.tables:
                self.tables[key] = scores(left, right)
            return self.tables[key], sides[0][0], sides[1][0]
        table = np.array([[self._easy(p, q) for q in right] for p in left], np.int64)
        return table, sides[0][0], sides[1][0]

    @staticmethod
    def _last(weights: tuple) -> np.ndarray:
        """The last row of the dynamic programme."""
        table, a, b = weights
        row = np.zeros(len(b) + 1, np.int64)
        for k in a:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + table[k][b]))
        return row

    def _chosen(self, weights: tuple, i0: int = 0, j0: int = 0) -> list[tuple[int, int]]:
        """The pairs of a best mapping of two lists; a large table is divided at its middle row."""
        out, todo = [], [(weights, i0, j0)]
        while todo:
            (table, a, b), i0, j0 = todo.pop()
            m, n = len(a), len(b)
            if not m or not n:
                continue
            if m > 1 and (m + 1) * (n + 1) > CELLS:
                half = m // 2
                above, below = self._last((table, a[:half], b)), self._last((table, a[half:][::-1], b[::-1]))[::-1]
                cut = int(np.argmax(above + below))
                todo += [((table, a[:half], b[:cut]), i0, j0), ((table, a[half:], b[cut:]), i0 + half, j0 + cut)]
                continue
            w = np.zeros((m + 1, n + 1), np.int64)
            for i, k in enumerate(a):
                w[i + 1, 1:] = np.maximum.accumulate(np.maximum(w[i, 1:], w[i, :-1] + table[k][b]))
            i, j = m, n
            while i and j:
                if w[i, j] == w[i - 1, j]:
                    i -= 1
                elif w[i, j] == w[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((i0 + i, j0 + j))
        return out

    def pairs(self, a: Node, b: Node) -> Iterator[tuple[Node, Node]]:
        """The pairs of a largest mapping, parents first."""
        todo = [(a, b)] if a.tag == b.tag else []
        while todo:
            x, y = todo.pop()
            yield x, y
            self.score(x, y)  # what was scored with many others is known by its own children only now
            if x.shape == y.shape:
                todo += zip(x.kids, y.kids, strict=True)
                continue
            lo, hi = _ends(x.kids, y.kids)
            m, n = len(x.kids) - hi, len(y.kids) - hi
            todo += zip(x.kids[:lo], y.kids[:lo], strict=True)
            todo += zip(x.kids[m:], y.kids[n:], strict=True)
            xs, ys = x.kids[lo:m], y.kids[lo:n]
            if xs and ys:
                todo += [(xs[i], ys[j]) for i, j in self._chosen(self._weights(xs, ys))]


def induce(pages: list[str]) -> str:
    """The template of some pages of a host: the elements that most of them have, aligned with
    the page that agrees best with the others. As text: depth and name of each, parents first."""
    trees = [t for t in map(parse, dict.fromkeys(pages)) if t[1]]
    if not trees:
        return ""
    matching = Matching()
    alike = [sum(2 * matching.score(t[0], o[0]) / (t[0].size + o[0].size) for o in trees) for t in trees]
    root, _, nodes = trees[int(np.argmax(alike))]
    held: Counter[int] = Counter()
    for other in trees:
        held.update(id(x) for x, _ in matching.pairs(root, other[0]))
    out, depth = [], {id(root): 0}
    for node in nodes:
        if node.parent is not None:
            depth[id(node)] = depth[id(node.parent)] + 1
        if 2 * held[id(node)] > len(trees):
            out.append(f"{depth[id(node)]} {node.tag}")
    return "\n".join(out)


def template(text: str) -> list[Node]:
    """The elements of a template, numbered; a parent comes before its children."""
    nodes: list[Node] = []
    path: list[Node] = []
    for line in text.split("\n"):
        depth, tag = line.split(" ", 1)
        del path[int(depth) :]
        node = Node(tag, path[-1] if path else None)
        if path:
            path[-1].kids.append(node)
        node.main = node.main or tag in ("article", "main")
        node.at = len(nodes)
        nodes.append(node)
        path.append(node)
    return shaped(nodes)


def _text_hash(b: Block) -> int:
    return xxhash.xxh64_intdigest(f"{b.node.tag} {b.text}".encode()) - (1 << 63)


def placed(known: list[Node], tree: tuple[Node, list[Block], list[Node]]) -> list[tuple[Block, int, int]] | None:
    """Each block of a page with the numbers of the template's elements that hold it: the
    nearest of all, and the nearest above its own element. None if the page has another
    layout: less than half of the template."""
    n = 0
    for x, y in Matching().pairs(known[0], tree[0]):
        y.at = x.at
        n += 1
    if 2 * n < len(known):
        return None
    for node in tree[2]:  # parents first
        node.near = node.at if node.at >= 0 else node.parent.near
    return [(b, b.node.near, (b.node.parent or b.node).near) for b in tree[1]]


class Wrapper:
    """What is known of a host: its template, where its content lies, and what is constant."""

    def __init__(self, text: str):
        told = json.loads(text)
        self.known = template(told["template"])
        self.links, self.constant = set(told["links"]), {(p, h) for p, h in told["constant"]}
        self.framed = self.known[told["content"]].tag in ("article", "main")
        inside = {told["content"]}
        for node in self.known:
            if node.parent is not None and node.parent.at in inside:
                inside.add(node.at)
        self.inside = inside

    def content(self, tree: tuple) -> list[Block] | None:
        """The blocks of the content; None if the page is not of this template."""
        found = placed(self.known, tree)
        if found is None:
            return None
        inner = [(b, (above, _text_hash(b)) in self.constant, at in self.links) for b, at, above in found if at in self.inside]
        beyond = {b.text for b, at, _ in found if at not in self.inside}
        varies = [k for k, (_, constant, links) in enumerate(inner) if not constant and (self.framed or not links)]
        if not varies:
            return []
        first, last = varies[0], varies[-1]
        while first and inner[first - 1][0].node.tag in HEADINGS and not inner[first - 1][2]:
            first -= 1  # a heading that varying text follows
        return [b for b, constant, _ in inner[first : last + 1] if not (constant and b.text in beyond)]


def learn(known: str, pages: int, mass: dict[int, int], linked: list[int], constant: list[tuple[int, int]]) -> str:
    """A wrapper from what was summed up over all pages of a host: ``mass`` is the varying
    text at each element of the template, ``linked`` the slots of links alone."""
    nodes = template(known)
    for node in nodes:
        node.chars = mass.get(node.at, 0)
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.chars += node.chars
    if not nodes[0].chars or pages < LEAST:
        return ""
    top = nodes[0]
    while kid := next((k for k in top.kids if k.chars >= MOST_TEXT * nodes[0].chars and k.kids), None):
        top = kid
    if kid := next((k for k in top.kids if k.chars >= MOST_TEXT * nodes[0].chars and k.main), None):
        top = kid
    around = top
    while around is not None:
        top = around if around.tag in ("article", "main") else top
        around = around.parent
    return json.dumps({"template": known, "content": top.at, "links": linked, "constant": constant})


def _alone(tree: tuple[Node, list[Block], list[Node]], marks: bool) -> list[Block]:
    """The content of a page of which no wrapper is known."""
    root, blocks, nodes = tree
    left = [b for b in blocks if not (marks and b.skip)]
    inside = [b for b in left if b.node.main]
    if inside:
        return inside
    for b in left:
        b.node.chars += len(b.text) if b.linked < 0.9 * len(b.text) else 0
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.chars += node.chars
    top = root
    while kid := next((k for k in top.kids if k.chars >= MOST_TEXT * root.chars and k.kids and any(x.chars for x in k.kids)), None):
        top = kid
    held = {id(top)}
    for node in nodes:
        if id(node.parent) in held:
            held.add(id(node))
    kept = [b for b in left if id(b.node) in held]
    if top.tag in ("#", "html", "body"):  # nothing frames the article: lists of links before and after it are menus
        plain = [k for k, b in enumerate(kept) if b.linked < 0.9 * len(b.text)]
        kept = kept[plain[0] : plain[-1] + 1] if plain else kept
    return kept


def extract(page: str | None, wrapper: Wrapper | None = None, marks: bool = True) -> str:
    """The article of a page, given the wrapper of its host; without ``marks`` by structure alone."""
    if not page:
        return ""
    tree = parse(page)
    found = wrapper.content(tree) if wrapper else None
    if found is None:
        found = _alone(tree, marks)
    return "\n".join(b.text for b in found if not (marks and b.skip))


def templates(pages: DataFrame, references: int = REFERENCES) -> DataFrame:
    """(host, template): from at most ``references`` pages of a host, those with the least
    of as many hashes of their content. Input columns: host, html."""
    hashes = [F.xxhash64(F.lit(k), "html") for k in range(references)]
    picked = pages.groupBy("host").agg(*[F.min(h).alias(f"h{k}") for k, h in enumerate(hashes)])
    asked = small_side(materialize(picked, "html-picked"), 100_000)
    either = F.lit(False)
    for k, h in enumerate(hashes):
        either = either | (h == F.col(f"h{k}"))
    chosen = pages.join(asked, "host").filter(either).groupBy("host", F.xxhash64("html")).agg(F.first("html").alias("html")).select("host", "html")

    def align(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": rows["host"].iloc[:1], "template": [induce(sorted(rows["html"]))]})

    return chosen.groupBy("host").applyInPandas(align, "host string, template string").filter("template <> ''")


def _slots(pages: DataFrame) -> DataFrame:
    """(host, page, at, above, h, chars, linked) of every block of the pages that follow their
    template; text that names set apart, such as comments longer than the article, weighs nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[Node]] = {}
        for batch in batches:
            rows: list[tuple] = []
            for host, page, text in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "template")), strict=True):
                if host not in cache:
                    if len(cache) > 1000:
                        cache.clear()
                    cache[host] = template(text)
                found = placed(cache[host], tree := parse(page))
                if not found:
                    continue
                long = sorted(((len(b.text), b.text) for b in tree[1]), reverse=True)[:2]
                own = xxhash.xxh64_intdigest("\n".join(t for _, t in long).encode()) - (1 << 63)
                rows += [(host, own, at, above, _text_hash(b), 0 if b.skip else len(b.text), b.linked >= 0.9 * len(b.text)) for b, at, above in found]
            names = ["host", "page", "at", "above", "h", "chars", "linked"]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return pages.select("host", "html", "template").transform(in_arrow, run, "host string, page long, at int, above int, h long, chars long, linked boolean")


def wrappers(pages: DataFrame, references: int = REFERENCES) -> DataFrame:
    """(host, wrapper) of every host with enough pages. Input columns: host, html."""
    known = materialize(templates(pages, references), "html-templates")
    slots = materialize(_slots(pages.join(small_side(known, 50_000), "host")), "html-slots")
    many = slots.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    many = materialize(many, "html-pages")
    enough = F.col("n") >= F.greatest(F.lit(LEAST), F.ceil(SUPPORT * F.col("pages")))
    texts = slots.select("host", "above", "h", "page").distinct().groupBy("host", "above", "h").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST)
    constant = materialize(texts.join(small_side(many), "host").filter(enough).select("host", "above", "h"), "html-constant")
    varying = slots.join(small_side(constant), ["host", "above", "h"], "left_anti")
    mass = varying.groupBy("host", "at").agg(F.sum(F.when(F.col("linked"), 0).otherwise(F.col("chars"))).alias("chars"), F.every("linked").alias("linked"))
    spread = slots.select("host", "at", "page").distinct().groupBy("host", "at").agg(F.count("*").alias("n"))
    facts = mass.join(spread, ["host", "at"]).join(small_side(many), "host")
    facts = facts.groupBy("host").agg(F.first("pages").alias("pages"), F.collect_list(F.struct("at", "chars", (F.col("linked") & enough).alias("linked"))).alias("slots"))
    fixed = constant.groupBy("host").agg(F.collect_list(F.struct("above", "h")).alias("constant"))
    rows = known.join(facts, "host").join(fixed, "host", "left").withColumn("constant", F.coalesce("constant", F.expr("cast(array() AS array<struct<above:int,h:long>>)")))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                constant = sorted([c["above"], c["h"]] for c in r["constant"])
                out.append(learn(r["template"], r["pages"], {s["at"]: s["chars"] for s in r["slots"]}, sorted(s["at"] for s in r["slots"] if s["linked"]), constant))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.string())], ["host", "wrapper"])

    found = materialize(rows.transform(in_arrow, tell, "host string, wrapper string").filter("wrapper <> ''"), "wrappers")
    release(known, slots, many, constant)
    return found


def extract_pages(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", references: int = REFERENCES, marks: bool = True) -> DataFrame:
    """(id, url, text) of every page."""
    small_batches(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url), _HOST, 1), F.lit("")))
    source = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))
    known = small_side(wrappers(source.filter("host <> '' AND html <> ''").select("host", "html"), references), 50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, Wrapper] = {}
        for batch in batches:
            out = []
            for page, host, wrapper in zip(*(batch.column(c).to_pylist() for c in ("html", "host", "wrapper")), strict=True):
                if wrapper and host not in cache:
                    if len(cache) > 1000:
                        cache.clear()
                    cache[host] = Wrapper(wrapper)
                out.append(extract(page, cache[host] if wrapper else None, marks))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(out, pa.string())], ["id", "url", "text"])

    kind = pages.schema[id].dataType.simpleString()
    joined = source.join(known, "host", "left").select("id", "url", "html", "host", "wrapper")
    found = joined.transform(in_arrow, run, f"id {kind}, url string, text string")
    return found.select(F.col("id").alias(id), F.col("url").alias(url), "text")
