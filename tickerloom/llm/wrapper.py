"""Main text of web pages by wrapper induction: same-host pages are aligned by simple tree matching.

Pages of a host are taken in groups of `GROUP` (fewer where they are very long), the last ones of equal size.  Every page's DOM tree is matched, top down, with the tree of one page of
its group (the one of median size): two nodes with equal labels match, and their children match so that most nodes do, in order.  A node is known by
the node it matches; one without a partner by its parent's and its label.  What the pages of a group show in a node, taken together, tells template from slots:

constant    a text that most pages of the group show under the same parent is template;
rotating    a part outside the main one, whose texts come back on pages that differ in their main part, is template: a notice dealt from a stock;
frame       a container beside the main part, at the same place and of the same shape on nearly every page, is template: a notice of each page's own;
menu        a list whose text is nearly all links is a menu;
marked      a part that its class, id or role names as none of the article (`MARKS`) is set aside where it stands on `CONSTANT_PAGES` pages of the group,
            and so are the elements that HTML has for menus, footers and sidebars.

The main part is the node with most of the slots' text, widened to the nearest node around it that has a heading of its own on most pages; it is never
template as a whole.  A page's main text is what fills its slots, wherever they are.  Scripts, styles, forms and the page's head are no text at all.

Large hosts are split over salted groups, so no task has to hold a host; each page is parsed once.  Edge cases: null, empty and text-free html give
an empty text; on a host of fewer than `CONSTANT_PAGES` pages (or with null url) nothing can be told by alignment, and marks and menus alone are set
aside; a page whose text would all be template keeps all of its text outside the parts set aside; pages of any depth and length are read whole; repeated rows
stay rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.common import read, staged

#: Pages aligned together, and pages a salted part of a large host holds.
GROUP, PART = 128, 256
#: Letters of html that a group holds about; one page may have more.
GROUP_LETTERS = 1 << 24
#: Letters of the names of large hosts up to which their table is sent to every executor.
SENT = 1 << 23
#: Pages a task gets about.
TASK = 1000
#: A text is template from this share of the group's matching pages, and this many pages, on; a part stands on nearly every page from FRAME on.
CONSTANT, CONSTANT_PAGES, FRAME = 0.6, 5, 0.9
#: A part rotates where this share of its pages, and CONSTANT_PAGES of them, show a text that another page shows, too.
ROTATING = 0.2
#: A list with this share of its text in links is a menu.
LINKED = 0.9

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that hold other blocks: only these can be a main part or a frame.
CONTAINER = frozenset("article aside body center div dl footer header html main menu nav ol section table tbody td tr ul #root".split())
BOUND = frozenset("html body main article section div center table tbody tr td".split())
CLOSES_P = BLOCK - {"body", "html", "dd", "dt", "legend", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: What an opening tag ends: tags, up to the nearest of the bounds.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Elements without text of the page.
NO_TEXT = frozenset("head form script style textarea title noscript iframe template xmp button select dialog svg object canvas audio video".split())
#: Tags, roles and words that mark parts of no article.  A word marks by class (whole or between hyphens) or as the whole id, never a heading.
MARKED_TAGS = frozenset("nav footer aside menu".split())
MARKED_ROLES = frozenset("navigation banner contentinfo complementary search alert menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads advert advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead toolbar pagination "
    "cookie cookies consent notice comment comments disqus replies share sharing related newsletter subscribe widget".split()
)

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    """An element: children are nodes and strings of text, in page order."""

    __slots__ = ("aside", "children", "key", "label", "marked", "nodes", "parent", "shape", "tag")

    def __init__(self, tag: str, label: str, parent: Node | None, aside: bool, marked: bool):
        self.tag, self.label, self.parent, self.aside, self.marked = tag, label, parent, aside, marked
        self.children: list = []
        self.nodes: list[Node] = []
        self.shape = self.key = -1


def _attributes(tag: str, raw: str) -> tuple[str, bool, bool]:
    """(label, whether the element has no text, whether it is marked) from a tag and its attributes."""
    label, aside, marked = tag, tag in NO_TEXT, tag in MARKED_TAGS
    if not raw or raw.isspace():
        return label, aside, marked
    for m in _ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden":
            aside = True
        elif name == "role":
            marked = marked or value.lower() in MARKED_ROLES
        elif name == "class":
            # Numbers in a class are those of one page.
            label = f"{tag}.{re.sub('[0-9]+', '0', value)}"
            # The page's own body and html may carry any word.
            if tag not in HEADINGS and tag not in ("html", "body"):
                marked = marked or not MARKS.isdisjoint(re.split(r"[\s_-]+", _CAMEL.sub(" ", value).lower()))
        elif name == "id" and tag not in HEADINGS:
            marked = marked or value.lower() in MARKS
    return label, aside, marked


def parse(source: str) -> Node:
    """The tree of a page; unclosed and stray tags are dealt with as browsers mostly do."""
    root = Node("#root", "#root", None, False, False)
    at, here = 0, root
    seen: dict[tuple[str, str], tuple[str, bool, bool]] = {}
    #: How many elements of a tag are open, so that a search upwards never runs in vain.
    opened: Counter = Counter()
    size = len(source)

    def leave(node: Node) -> Node:
        """The parent of node, which is closed with all that is open in it."""
        nonlocal here
        while True:
            opened[here.tag] -= 1
            if here is node:
                return here.parent
            here = here.parent

    while at < size:
        m = _TOKEN.search(source, at)
        end = m.start() if m else size
        if end > at:
            here.children.append(entities.unescape(source[at:end]))
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if opened[tag]:
                up = here
                while up.tag != tag:
                    up = up.parent
                here = leave(up)
            continue
        if tag in CLOSES_P and opened["p"]:
            up = here
            while up.parent is not None and up.tag != "p" and up.tag not in BOUND:
                up = up.parent
            if up.tag == "p":
                here = leave(up)
        if tag in ENDS and any(opened[t] for t in ENDS[tag][0]):
            ends, bounds = ENDS[tag]
            up, last = here, None
            while up.parent is not None and up.tag not in bounds:
                if up.tag in ends:
                    last = up
                up = up.parent
            if last is not None:
                here = leave(last)
        key = tag, m[3]
        found = seen.get(key)
        if found is None:
            found = seen[key] = _attributes(tag, m[3])
        label, aside, marked = found
        if tag == "header":
            marked = marked or not (opened["article"] or opened["main"])
        node = Node(tag, label, here, aside, marked)
        here.children.append(node)
        here.nodes.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(source, at)
            at = close.end() if close else size
        elif tag not in VOID and not m[3].endswith("/"):
            here = node
            opened[tag] += 1
    return root


def in_order(root: Node) -> list[Node]:
    """root and all nodes below it, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.nodes))
    return out


class Shapes:
    """Trees by shape: equal trees of labels have equal numbers, and a pair of shapes is matched once."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.label: list[str] = []
        self.below: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.pairs: dict[tuple[int, int], int] = {}

    def name(self, nodes: list[Node]) -> None:
        """Give every node of a tree (parents first) the number of its shape."""
        for node in reversed(nodes):
            shape = node.label, tuple(n.shape for n in node.nodes)
            found = self.known.get(shape)
            if found is None:
                found = self.known[shape] = len(self.label)
                self.label.append(shape[0])
                self.below.append(shape[1])
                self.size.append(1 + sum(self.size[k] for k in shape[1]))
            node.shape = found

    def match(self, a: int, b: int) -> int:
        """Simple tree matching: the most nodes that can match in order, a with b."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if (x, y) in self.pairs or self._plain(x, y) is not None:
                todo.pop()
                continue
            ahead, behind, xs, ys = self._trimmed(x, y)
            deeper = [(p, q) for p in dict.fromkeys(xs) for q in dict.fromkeys(ys) if (p, q) not in self.pairs and self._plain(p, q) is None]
            if deeper:
                todo.extend(deeper)
                continue
            todo.pop()
            same = sum(self.size[k] for k in self.below[x][:ahead]) + sum(self.size[k] for k in self.below[x][len(self.below[x]) - behind :])
            self.pairs[x, y] = 1 + same + (int(self._last_row(xs, ys)[-1]) if xs and ys else 0)
        return self.weight(a, b)

    def _plain(self, a: int, b: int) -> int | None:
        """The match of a pair that needs no look at its children's children."""
        if self.label[a] != self.label[b]:
            return 0
        if a == b:
            return self.size[a]
        return 1 if not self.below[a] or not self.below[b] else None

    def weight(self, a: int, b: int) -> int:
        found = self._plain(a, b)
        return self.pairs[a, b] if found is None else found

    def _trimmed(self, a: int, b: int) -> tuple[int, int, tuple[int, ...], tuple[int, ...]]:
        """Children of equal shape at both ends, which match one another in a best match, and what is between."""
        xs, ys = self.below[a], self.below[b]
        ahead = behind = 0
        most = min(len(xs), len(ys))
        while ahead < most and xs[ahead] == ys[ahead]:
            ahead += 1
        while behind < most - ahead and xs[-1 - behind] == ys[-1 - behind]:
            behind += 1
        return ahead, behind, xs[ahead : len(xs) - behind], ys[ahead : len(ys) - behind]

    def _weights(self, x: int, ys: tuple[int, ...]) -> np.ndarray:
        kinds = {y: self.weight(x, y) for y in dict.fromkeys(ys)}
        return np.array([kinds[y] for y in ys])

    def _last_row(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> np.ndarray:
        """Best weights of xs with each beginning of ys."""
        best = np.zeros(len(ys) + 1, np.int64)
        rows: dict[int, np.ndarray] = {}
        for x in xs:
            if x not in rows:
                rows[x] = self._weights(x, ys)
            taken = best[:-1] + rows[x]
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], taken))
        return best

    def partners(self, a: int, b: int) -> list[tuple[int, int]]:
        """Places of children of a and of b that match in a best match, in order."""
        self.match(a, b)
        n = len(self.below[a]), len(self.below[b])
        if not all(n):
            return []
        ahead, behind, xs, ys = self._trimmed(a, b) if a != b else (n[0], 0, (), ())
        out = [(k, k) for k in range(ahead)]
        for x in dict.fromkeys(xs):
            for y in dict.fromkeys(ys):
                self.match(x, y)
        # Halves of xs, one after the other, so that memory stays linear in the children.
        todo = [(0, len(xs), 0, len(ys))]
        while todo:
            i, j, k, m = todo.pop()
            if i == j or k == m:
                continue
            if j - i == 1:
                w = self._weights(xs[i], ys[k:m])
                if w.max() > 0:
                    out.append((ahead + i, ahead + k + int(w.argmax())))
                continue
            half = (i + j) // 2
            left, right = self._last_row(xs[i:half], ys[k:m]), self._last_row(xs[half:j][::-1], ys[k:m][::-1])[::-1]
            cut = k + int((left + right).argmax())
            todo += [(half, j, cut, m), (i, half, k, cut)]
        return out + [(n[0] - k, n[1] - k) for k in range(behind, 0, -1)]


def align(reference: Node, page: Node, shapes: Shapes) -> dict[int, Node]:
    """id of a node of page: the node of reference it matches."""
    out, todo = {}, [(reference, page)]
    while todo:
        a, b = todo.pop()
        out[id(b)] = a
        for i, j in shapes.partners(a.shape, b.shape):
            if a.nodes[i].label == b.nodes[j].label:
                todo.append((a.nodes[i], b.nodes[j]))
    return out


class Page:
    """A parsed page: its nodes, parents first, their keys, texts and lengths."""

    def __init__(self, source: str):
        self.root = parse(source)
        self.nodes = in_order(self.root)
        self.place = {id(n): k for k, n in enumerate(self.nodes)}

    def measure(self, out: set[int]) -> dict[int, int]:
        """id of a node: letters of the text in and below it, what is set aside in `out` left out."""
        size = {}
        for node in reversed(self.nodes):
            size[id(node)] = 0 if id(node) in out else sum(len(c.strip()) if type(c) is str else size[id(c)] for c in node.children)
        return size

    def texts(self) -> dict[int, int]:
        """id of a node: a hash of all text in and below it."""
        found = {}
        for node in reversed(self.nodes):
            parts = [c.strip() if type(c) is str else found[id(c)] for c in node.children if type(c) is not str or not c.isspace()]
            found[id(node)] = hash(tuple(parts)) if any(parts) else 0
        return found

    def menus(self) -> set[int]:
        """Lists of two items and more whose text is nearly all links."""
        out, whole, links = set(), {}, {}
        inside = set()
        for node in self.nodes:
            if node.tag == "a" or node.parent is not None and id(node.parent) in inside:
                inside.add(id(node))
        for node in reversed(self.nodes):
            own = 0 if node.aside else sum(len(c.strip()) for c in node.children if type(c) is str)
            whole[id(node)] = 0 if node.aside else own + sum(whole[id(n)] for n in node.nodes)
            links[id(node)] = 0 if node.aside else (own if id(node) in inside else 0) + sum(links[id(n)] for n in node.nodes)
            if node.tag in ("ul", "ol", "dl", "menu") and len(node.nodes) > 1 and whole[id(node)] and links[id(node)] >= LINKED * whole[id(node)]:
                out.add(id(node))
        return out


def text_blocks(root: Node, out_of: set[int]) -> list[tuple[Node, str]]:
    """(innermost block element, text) of all text outside the nodes of `out_of`, in page order."""
    out: list[tuple[Node, str]] = []
    parts: list[str] = []
    holder = root

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append((holder, text))
        parts.clear()

    # (node, next child, holder to go back to)
    stack: list[list] = [[root, 0, root]]
    while stack:
        node, k, back = stack[-1]
        if k == len(node.children):
            stack.pop()
            if node.tag in BLOCK:
                flush()
                holder = back
            continue
        stack[-1][1] += 1
        child = node.children[k]
        if type(child) is str:
            parts.append(child)
        elif child.aside or id(child) in out_of:
            if child.tag in BLOCK:
                flush()
        elif child.tag in BLOCK:
            flush()
            stack.append([child, 0, holder])
            holder = child
        else:
            if child.tag == "br":
                parts.append(" ")
            stack.append([child, 0, holder])
    flush()
    return out


class Wrapper:
    """What the pages of one group show together: keys of nodes, the main part, and which parts are template."""

    def __init__(self, pages: list[Page]):
        self.pages = pages
        self.keys: dict[tuple[int, str], int] = {}
        self.parent: list[int] = []
        self.tag: list[str] = []
        shapes = Shapes()
        for page in pages:
            shapes.name(page.nodes)
        reference = sorted(pages, key=lambda p: len(p.nodes))[len(pages) // 2]
        for node in reference.nodes:
            node.key = self._new(node)
        for page in pages:
            matched = align(reference.root, page.root, shapes) if page is not reference else {}
            for node in page.nodes:
                if page is not reference:
                    partner = matched.get(id(node))
                    node.key = partner.key if partner is not None else self._loose(node)
        self.reference = reference
        self.induce()

    def _new(self, node: Node) -> int:
        self.parent.append(-1 if node.parent is None else node.parent.key)
        self.tag.append(node.tag)
        return len(self.tag) - 1

    def _loose(self, node: Node) -> int:
        at = node.parent.key, node.label
        if at not in self.keys:
            self.keys[at] = self._new(node)
        return self.keys[at]

    def around(self, key: int) -> list[int]:
        """key and the keys around it, up to the root."""
        out = [key]
        while self.parent[out[-1]] >= 0:
            out.append(self.parent[out[-1]])
        return out

    def induce(self) -> None:
        n = len(self.pages)
        menus = [p.menus() for p in self.pages]
        out = [{*m, *(id(x) for x in p.nodes if x.aside)} for m, p in zip(menus, self.pages, strict=True)]
        texts = [p.texts() for p in self.pages]
        shown: dict[int, list[tuple[int, int]]] = defaultdict(list)  # key: pages that have it, and their texts
        shapes: dict[int, Counter] = defaultdict(Counter)
        marked: dict[int, int] = Counter()
        for k, page in enumerate(self.pages):
            for node in page.nodes:
                if texts[k][id(node)]:
                    shown[node.key].append((k, texts[k][id(node)]))
                    shapes[node.key][node.shape] += 1
                if node.marked:
                    marked[node.key] += 1
        # Constant texts, by the block that holds them: under the same parent, most pages show the same.
        blocks = [text_blocks(p.root, o) for p, o in zip(self.pages, out, strict=True)]
        per_text: dict[tuple, set[int]] = defaultdict(set)
        per_place: dict[tuple, set[int]] = defaultdict(set)
        for k, found in enumerate(blocks):
            for holder, text in found:
                place = self._place(holder)
                per_text[place, text].add(k)
                per_place[place].add(k)
        self.constant = {
            (place, text) for (place, text), seen in per_text.items() if len(seen) >= CONSTANT_PAGES and len(seen) >= CONSTANT * len(per_place[place])
        } if n >= CONSTANT_PAGES else set()
        # The main part.
        weight: dict[int, int] = Counter()
        headed: dict[int, set[int]] = defaultdict(set)
        for k, found in enumerate(blocks):
            for holder, text in found:
                if (self._place(holder), text) in self.constant:
                    continue
                for key in self.around(holder.key):
                    weight[key] += len(text)
                    if holder.tag in HEADINGS:
                        headed[key].add(k)
        children: dict[int, list[int]] = defaultdict(list)
        for key, up in enumerate(self.parent):
            if up >= 0 and weight[key]:
                children[up].append(key)
        main = 0
        while True:
            inner = [c for c in children[main] if self.tag[c] in CONTAINER and 2 * weight[c] > weight[main]]
            if not inner:
                break
            main = inner[0]
        for key in self.around(main):
            if len(headed[key]) >= CONSTANT * n:
                main = key
                break
        self.main = main
        path = set(self.around(main))
        inside = self._inside(main)
        # A part outside the main one, or in it, whose texts come back where the main parts differ.
        core = dict(shown[main])
        template: set[int] = set()
        if n >= CONSTANT_PAGES:
            for key in sorted(shown):
                if key in path or key in template or self.parent[key] in template:
                    if self.parent[key] in template:
                        template.add(key)
                    continue
                rows = shown[key]
                if not inside[key] and self._rotates(rows, core) or not inside[key] and self.tag[key] in CONTAINER and self._frames(key, rows, shapes, path):
                    template.add(key)
        least = CONSTANT_PAGES if n >= CONSTANT_PAGES else 1
        half = weight[0] / 2
        # A tag says what an element is; a class, an id or a role has to stand in the wrapper, and never holds most of the text.
        self.marked = {key for key, count in marked.items() if key not in path and (self.tag[key] in MARKED_TAGS or count >= least and weight[key] <= half)}
        self.template = template
        self.out = out

    def _place(self, holder: Node) -> tuple[int, str]:
        return self.parent[holder.key], holder.label

    def _inside(self, main: int) -> list[bool]:
        inside = [False] * len(self.parent)
        for key, up in enumerate(self.parent):
            inside[key] = key == main or up >= 0 and inside[up]
        return inside

    def _rotates(self, rows: list[tuple[int, int]], core: dict[int, int]) -> bool:
        mains: dict[int, set[int]] = defaultdict(set)
        for k, text in rows:
            mains[text].add(core.get(k, 0))
        again = sum(len(mains[text]) > 1 for _, text in rows)
        return again >= CONSTANT_PAGES and again >= ROTATING * len(rows)

    def _frames(self, key: int, rows: list[tuple[int, int]], shapes: dict[int, Counter], path: set[int]) -> bool:
        n, alike = len(self.pages), shapes[key].most_common(1)[0][1]
        return self.parent[key] in path and alike == len(rows) and alike >= max(CONSTANT_PAGES, FRAME * n)

    def text(self, k: int) -> str:
        """The main text of page k."""
        page = self.pages[k]
        out = {*self.out[k], *(id(x) for x in page.nodes if x.key in self.marked)}
        slots = []
        whole = text_blocks(page.root, out)
        gone = {*out, *(id(x) for x in page.nodes if x.key in self.template)}
        for holder, text in text_blocks(page.root, gone):
            if (self._place(holder), text) not in self.constant:
                slots.append(text)
        # A page of template only: all text that is not set aside.
        return "\n\n".join(slots or [text for _, text in whole])


def extract(sources: list[str | None]) -> list[str]:
    """The main text of each page of one group."""
    full = [k for k, s in enumerate(sources) if s]
    out = ["" for _ in sources]
    if full:
        wrapper = Wrapper([Page(sources[k]) for k in full])
        for at, k in enumerate(full):
            out[k] = wrapper.text(at)
    return out


def host(url: Column) -> Column:
    """The host of a URL, lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#]*)", 1), F.lit("")))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    keyed = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    counts = pages.select(host(F.col("url")).alias("_host")).groupBy("_host").agg(F.count("*").alias("n"))
    total = pages.count()
    # Every host above PART pages.
    large = staged(counts.filter(F.col("n") > PART).select("_host", F.ceil(F.col("n") / PART).alias("_parts")))
    letters = large.agg(F.sum(F.length("_host") + 16)).first()[0] or 0
    # Sent everywhere where its size allows that; else an ordinary join, which moves the pages once more.
    keyed = keyed.join(F.broadcast(large) if letters <= SENT else large, F.col("host") == F.col("_host"), "left")
    draw = F.xxhash64(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))
    keyed = keyed.withColumn("part", F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(draw, F.col("_parts"))))
    kind = pages.schema["page_id"].dataType.simpleString()

    def rows(batches):
        group: list[tuple] = []
        at = None

        def done():
            texts = extract([g[2] for g in group])
            types = [id_type, pa.string()]
            columns = [pa.array([g[c] for g in group], t) for c, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        def last():
            """What is left of a part: one group, or some of equal size where it is more than GROUP or GROUP_LETTERS."""
            nonlocal group
            left = group
            groups = min(len(left), max(-(-len(left) // GROUP), -(-sum(len(g[2] or "") for g in left) // GROUP_LETTERS)))
            for k in range(groups):
                group = left[k * len(left) // groups : (k + 1) * len(left) // groups]
                yield done()
            group = []

        held = 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            for step in range(0, batch.num_rows, 256):
                part = batch.slice(step, 256)
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if group and at != row[3:]:
                        yield from last()
                        held = 0
                    elif len(group) == 2 * GROUP or held >= 2 * GROUP_LETTERS and len(group) > 1:
                        half = len(group) // 2
                        rest, group = group[half:], group[:half]
                        yield done()
                        group, held = rest, sum(len(g[2] or "") for g in rest)
                    at = row[3:]
                    group.append(row[:3])
                    held += len(row[2] or "")
        yield from last()

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK)
    ordered = keyed.select("page_id", "url", "html", "host", "part").repartition(tasks, "host", "part").sortWithinPartitions("host", "part", "page_id", "url")
    return ordered.mapInArrow(rows, f"page_id {kind}, url string, text string, n_chars long")


def op5_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))
