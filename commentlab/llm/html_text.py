"""Main text of web pages by wrapper induction per host.

Every page becomes a tree of its block elements; runs of like siblings count as one node. The
commonest tree of a host is its wrapper. Simple tree matching aligns each page with its host's
wrapper, so that nodes of different pages that match share a slot. Over all pages of a host a
slot whose text hardly changes is template, and so is one made of links; slots that vary hold the
content. Elements that by convention hold menus, headers, footers, sidebars, adverts, forms,
scripts, styles or comments are never content, nor are those whose whole class or id is a
conventional name of such; html, body, main, articles, headings and what holds a page's only
articles are not judged by their names. Names that content may have too (search, related, share)
leave it to the slots. Where a page has an article or main element, content lies within it, and
links make template of its slots only under such a name. A slot's pages are the different pages of
the host: copies, pages whose text before this judgement is one, count once.

Counts are combined in tasks and added up by Spark; wrappers and slots are joined back to the
pages (broadcast only when counted to be few), so a host with a third of all pages is no group of
its own in any task.

Defined results: NULL or empty html gives an empty text; a NULL url is a host of its own; broken
markup is read as far as it can be: an end tag without start is dropped, an unfinished tag at the
end is markup; hosts with few different pages are judged by conventions alone. Every row has its text.
Columns other than id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentlab.llm import common
from commentlab.llm.urls import host
from commentlab.session import materialise

# A slot is template if at most this share of its pages have a text of their own,
CONSTANT = 0.2
# seen on at least so many pages, or if this share of its characters are in links.
LEAST_PAGES, LINKS = 5, 0.5
# Wrappers of so many hosts are broadcast.
HOSTS = 20_000

# fixed values: conventions of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes svg math".split())
NOISE_TAGS = frozenset(
    "head script style noscript template nav header footer aside form button select option textarea input iframe "
    "svg math canvas object menu dialog title xmp noembed noframes".split()
)
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising cookies gdpr nav navbar sidebar sidenav breadcrumb breadcrumbs "
    "footer masthead comment comments reply replies disqus sponsored pagination pager".split()
)
# Not of inline elements, where these name parts of code and of dictionaries.
BLOCKS_ONLY = frozenset("adv comment comments reply replies footer".split())
# Words that content may be named by as well: two of them in a name are noise, one is for the slots to decide.
DOUBTFUL_WORDS = frozenset(
    "banner promo promotion sponsor cookie consent notice notices alert popup modal overlay menu navigation "
    "respond share sharing social related recommended newsletter subscribe subscription widget toolbar login signup search".split()
)
# Words that may stand beside them in a name.
PLACES = frozenset(
    "area article articles bar block box button buttons container global header icon icons inner item items link links list mobile "
    "outer post posts primary section site slot top bottom unit user wrap wrapper".split()
)
# Elements that no class or id makes noise.
NEVER = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
CLOSED_BY = {
    "p": frozenset(
        "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu "
        "nav ol p pre section table ul".split()
    ),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"]),
}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTES = re.compile(r"(?<![^\s\"'/])([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+|[^\W\d_]+")
WORDS = re.compile(r"[a-z]+")
# The marks of a skeleton are no part of a label: unescaped code makes tags such as <b)>.
MARKS = str.maketrans("(),", "[];")


class Node:
    """A block element: its label, children in order, and its own text by pieces.

    ``parts`` holds child nodes and (text, in a link) pairs in page order. ``doubt``: 1 if its name
    may be one of noise and the slots decide, 2 if it would be noise but for an article below it.
    """

    __slots__ = ("label", "tag", "noise", "doubt", "parts", "slot")

    def __init__(self, tag: str, label: str, noise: bool):
        self.tag, self.label, self.noise, self.doubt, self.parts, self.slot = tag, label, noise, 0, [], None


def parse(page: str) -> Node:
    """The tree of block elements of a page."""
    root = Node("", "", False)
    stack: list[tuple[str, Node]] = [("", root)]  # open elements; inline ones carry their block's node
    links, at = 0, 0
    opened: dict[str, int] = {}  # open elements by tag
    blocks: list[int] = []  # places of open block elements
    condemned: list[Node] = []  # by class or id

    def close(i):
        nonlocal links
        for tag, _ in stack[i:]:
            opened[tag] -= 1
            links -= tag == "a"
        del stack[i:]
        while blocks and blocks[-1] >= i:
            blocks.pop()

    for found in TAG.finditer(page):
        if found.start() < at:
            continue
        if found.start() > at:
            stack[-1][1].parts.append((page[at : found.start()], links > 0))
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            if opened.get(tag):
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
            continue
        if tag in RAW and not found[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            stack[-1][1].parts.append(Node(tag, tag, True))
            continue
        while blocks and tag in CLOSED_BY.get(stack[blocks[-1]][0], ()):  # elements that this one ends
            close(blocks[-1])
        if tag in INLINE:
            named, by_class, by_id, _ = _names(tag, found[3])
            if named or by_class == 2 or by_id == 2:
                node = Node(tag, tag, True)
                stack[-1][1].parts.append(node)
                stack.append((tag, node))
            else:
                stack.append((tag, stack[-1][1]))
            opened[tag] = opened.get(tag, 0) + 1
            links += tag == "a"
        elif tag in VOID:
            stack[-1][1].parts.append((" ", False))
        else:
            named, by_class, by_id, label = _names(tag, found[3])
            node = Node(tag, label, named or tag in NOISE_TAGS)
            if by_class or by_id:
                # an id within an article, or of a section, may be made from a headline
                slug = tag == "section" or opened.get("article") or opened.get("main")
                node.doubt = 1
                if not node.noise and (by_class == 2 or (by_id == 2 and not slug)):
                    node.noise = True
                    condemned.append(node)
            stack[-1][1].parts.append(node)
            opened[tag] = opened.get(tag, 0) + 1
            blocks.append(len(stack))
            stack.append((tag, node))
    if at < len(page):
        stack[-1][1].parts.append((page[at:], links > 0))
    if condemned and not _has_article(root):
        _pardon(root, frozenset(condemned))
    return root


def _pardon(root: Node, condemned: frozenset[Node]) -> None:
    """Names are no proof where the only articles of a page are below them; its text is then not only in these."""
    holds: set[Node] = set()
    for node in reversed(walk(root)):
        if (not node.noise or node in condemned) and (node.tag in ("article", "main") or not holds.isdisjoint(node.parts)):
            holds.add(node)
    for node in condemned & holds:
        node.noise, node.doubt = False, 2


def _named(token: str, inline: bool) -> int:
    """What a whole class or id tells: 2 noise by convention, 1 doubtful, 0 nothing."""
    words = [w.lower() for w in PARTS.findall(token)]
    if inline and not BLOCKS_ONLY.isdisjoint(words):
        return 0
    joined = "".join(words)
    if joined in NOISE_WORDS:
        return 2
    if joined in DOUBTFUL_WORDS:
        return 1
    sure = sum(w in NOISE_WORDS for w in words)
    likely = sum(w in DOUBTFUL_WORDS for w in words)
    if not sure + likely or any(not (w.isdigit() or w in NOISE_WORDS or w in DOUBTFUL_WORDS or w in PLACES) for w in words):
        return 0
    return 2 if sure or likely > 1 else 1


def _names(tag: str, attributes: str) -> tuple[bool, int, int, str]:
    """Whether the role tells of noise, what class and id tell, and the element's label."""
    label = tag.translate(MARKS)
    if "=" not in attributes:
        return False, 0, 0, label
    noise, told, inline = False, {"class": 0, "id": 0}, tag in INLINE
    for name, *values in ATTRIBUTES.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "role":
            noise |= value.strip().lower() in NOISE_ROLES
        elif name in told:
            if tag not in NEVER:
                told[name] = max([told[name], *(_named(t, inline) for t in value.split())])
            label += "." + "-".join(WORDS.findall(value.lower()))
    return noise, told["class"], told["id"], label


def walk(root: Node) -> list[Node]:
    """The nodes of a tree, each before those below it, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(part for part in reversed(node.parts) if isinstance(part, Node))
    return out


def shapes_of(root: Node) -> dict[Node, tuple[int, list[Node]]]:
    """Per node a number that equal trees of labels share, and its children; runs of like siblings once."""
    numbers: dict[tuple, int] = {}
    out: dict[Node, tuple[int, list[Node]]] = {}
    for node in reversed(walk(root)):
        firsts, last = [], None
        for part in node.parts:
            if isinstance(part, Node):
                if out[part][0] != last:
                    firsts.append(part)
                last = out[part][0]
        key = node.label, *(out[child][0] for child in firsts)
        out[node] = numbers.setdefault(key, len(numbers)), firsts
    return out


def skeleton(node: Node, shapes: dict | None = None) -> str:
    """The tree of labels below a node; runs of like siblings once."""
    shapes = shapes or shapes_of(node)
    out, todo = [], [node]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            out.append(part)
            continue
        out.append(part.label)
        if firsts := shapes[part][1]:
            out.append("(")
            todo.append(")")
            for k, child in enumerate(reversed(firsts)):
                todo.extend([","] * (k > 0))
                todo.append(child)
    return "".join(out)


def unfold(text: str) -> tuple:
    """A skeleton as nested (label, children)."""
    stack, label = [[]], ""
    for token in re.split(r"([(),])", text):
        if token == "(":
            stack[-1].append((label, []))
            stack.append(stack[-1][-1][1])
            label = ""
        elif token in (",", ")"):
            if label:
                stack[-1].append((label, []))
            label = ""
            if token == ")":
                stack.pop()
        elif token:
            label = token
    if label:
        stack[-1].append((label, []))
    return ("", stack[0][0][1]) if text.startswith("(") and stack[0] else ("", stack[0])


def match(a: tuple, b: tuple) -> tuple[int, list]:
    """Simple tree matching: size of the largest match of two trees, and the matched children."""
    if a[0] != b[0]:
        return 0, []
    # pairs of trees under way: the trees, their results so far, the pairs still to match, where the result goes
    top: dict = {}
    todo = [(a, b, {}, _alike(a, b), top, 0)]
    while todo:
        a, b, inner, left, to, key = todo[-1]
        if left:
            i, j = left.pop()
            below = a[1][i], b[1][j]
            todo.append((*below, {}, _alike(*below), inner, (i, j)))
            continue
        todo.pop()
        to[key] = _best(len(a[1]), len(b[1]), inner)
    return top[0]


def _alike(a: tuple, b: tuple) -> list[tuple[int, int]]:
    """Children of two trees that have one label."""
    return [(i, j) for i, x in enumerate(a[1]) for j, y in enumerate(b[1]) if x[0] == y[0]]


def _best(n: int, m: int, inner: dict) -> tuple[int, list]:
    """Size and pairs of the best match of n and m children in order, from the matches of the pairs."""
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + inner.get((i, j), (0,))[0])
    pairs, i, j = [], n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j, inner[i, j][1]))
    return best[n][m] + 1, pairs[::-1]


def _number(*key) -> int:
    """Eight bytes of a key's digest as a signed number."""
    return int.from_bytes(hashlib.blake2b(repr(key).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _slots(own: tuple, wrapper: tuple, pairs: list) -> tuple:
    """Slot numbers for the tree ``own``: the wrapper's place if matched, else one by label."""
    top: tuple = (_number("", ""), [])
    todo = [(own, wrapper, pairs, top)]
    while todo:
        own, wrapper, pairs, (slot, out) = todo.pop()
        to = {i: (j, inner) for i, j, inner in pairs}
        for i, child in enumerate(own[1]):
            j, inner = to.get(i, ("+", []))
            out.append((_number(slot, child[0], j), []))
            todo.append((child, ("", []) if j == "+" else wrapper[1][j], inner, out[-1]))
    return top


class Aligner:
    """Gives the nodes of pages their slots; alignments of equal skeletons are kept."""

    def __init__(self):
        self.kept: dict[tuple[str, str], tuple] = {}

    def align(self, root: Node, wrapper: str) -> None:
        shapes = shapes_of(root)
        own = skeleton(root, shapes)
        if (own, wrapper) not in self.kept:
            if len(self.kept) > 5_000:
                self.kept.clear()
            a, b = unfold(own), unfold(wrapper)
            self.kept[own, wrapper] = _slots(a, b, match(a, b)[1])
        todo = [(root, self.kept[own, wrapper])]
        while todo:
            node, slots = todo.pop()
            node.slot, at, last = slots[0], -1, None
            for part in node.parts:
                if isinstance(part, Node):
                    at += shapes[part][0] != last
                    last = shapes[part][0]
                    todo.append((part, slots[1][at]))


def clean(pieces: list[str]) -> str:
    return " ".join(html.unescape("".join(pieces)).split())


def slots_of(root: Node) -> list[tuple[int, bool, list[tuple[str, bool]]]]:
    """(slot, in an article and not doubtful, own text pieces) of every node that is not noise."""
    out, todo = [], [(root, False, False)]
    while todo:
        node, inside, doubt = todo.pop()
        if node.noise:
            continue
        inside = inside or node.tag in ("article", "main")
        doubt = (doubt or node.doubt == 1) and node.tag not in ("article", "main")
        own = [part for part in node.parts if not isinstance(part, Node)]
        if own:
            out.append((node.slot, inside and not doubt, own))
        todo.extend((part, inside, doubt) for part in reversed(node.parts) if isinstance(part, Node))
    return out


def main_text(root: Node, template: frozenset[int]) -> str:
    """Text of the content blocks in page order, joined by one space."""
    blocks: list[str] = []
    article = _has_article(root)
    todo = [(root, False, 0)]  # nodes under way: in an article, parts done
    while todo:
        node, inside, at = todo.pop()
        if node.noise:
            continue
        inside = inside or node.tag in ("article", "main")
        speak = (inside or not article) and node.slot not in template
        held: list[str] = []
        for k in range(at, len(node.parts)):
            part = node.parts[k]
            if not isinstance(part, Node):
                if speak:
                    held.append(part[0])
            elif not (part.tag in INLINE and part.noise):
                todo += [(node, inside, k + 1), (part, inside, 0)]
                break
        if held:
            blocks.append(clean(held))
    return " ".join(b for b in blocks if b)


def page_number(root: Node) -> int:
    """What pages of one main text share, before any slot is called template."""
    return _number(main_text(root, frozenset()))


def _has_article(root: Node) -> bool:
    todo = [root]
    while todo:
        node = todo.pop()
        if not node.noise and node.doubt < 2:
            if node.tag in ("article", "main"):
                return True
            todo.extend(part for part in node.parts if isinstance(part, Node))
    return False


def _with(rows: DataFrame, per_host: DataFrame) -> DataFrame:
    """``rows`` with the columns of a table of hosts; hosts without one keep their rows."""
    if common.small_enough(per_host.select("host"), HOSTS):
        return rows.join(F.broadcast(per_host), "host", "left")
    return rows.join(per_host.hint("shuffle_merge"), "host", "left")


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), host(url).alias("host"), F.col(page).alias("html")
    )
    kind = dict(rows.dtypes)["page_id"]

    def shapes(batches):
        for batch in batches:
            seen = set()
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root = parse(text or "")
                seen.add((name, skeleton(root), page_number(root)))
            if seen:
                names, trees, numbers = zip(*seen, strict=True)
                yield pa.record_batch([pa.array(names), pa.array(trees), pa.array(numbers, pa.int64())], names=["host", "tree", "page"])

    wrappers = (
        rows.select("host", "html").mapInArrow(shapes, "host string, tree string, page long").distinct()
        .groupBy("host", "tree").agg(F.count("*").alias("n"))
        .groupBy("host").agg(F.max_by("tree", F.struct("n", "tree")).alias("wrapper"))
    )
    wrappers = materialise(wrappers, "wrappers")

    def told(batches):
        aligner = Aligner()
        for batch in batches:
            seen: dict[tuple[str, int, int], tuple] = {}
            for name, text, wrapper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                root = parse(text or "")
                page = page_number(root)
                aligner.align(root, wrapper)
                own: dict[int, list] = {}
                for slot, inside, parts in slots_of(root):
                    said = clean([t for t, _ in parts])
                    if said:
                        row = own.setdefault(slot, [[], 0, 0, False])
                        row[0].append(said)
                        row[1] += len(said)
                        row[2] += len(clean([t for t, link in parts if link]))
                        row[3] |= inside
                for slot, (texts, *others) in own.items():
                    seen[name, slot, page] = _number(texts), *others
            if seen:
                names, slots, numbers = zip(*seen, strict=True)
                digests, chars, linked, inside = zip(*seen.values(), strict=True)
                yield pa.record_batch(
                    [pa.array(names), pa.array(slots, pa.int64()), pa.array(numbers, pa.int64()), pa.array(digests, pa.int64()),
                     pa.array(chars, pa.int64()), pa.array(linked, pa.int64()), pa.array(inside)],
                    names=["host", "slot", "page", "digest", "chars", "linked", "inside"],
                )

    said = (
        _with(rows.select("host", "html"), wrappers).select("host", "html", "wrapper")
        .mapInArrow(told, "host string, slot long, page long, digest long, chars long, linked long, inside boolean")
        .groupBy("host", "slot", "page")  # copies of a page count once
        .agg(*(F.max(c).alias(c) for c in ("digest", "chars", "linked", "inside")))
        .groupBy("host", "slot", "digest")
        .agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("chars", "linked")), F.max("inside").alias("inside"))
        .groupBy("host", "slot")
        .agg(F.count("*").alias("texts"), *(F.sum(c).alias(c) for c in ("n", "chars", "linked")), F.max("inside").alias("inside"))
    )
    repeats = (F.col("n") >= LEAST_PAGES) & (F.col("texts") <= CONSTANT * F.col("n"))
    template = said.filter(repeats | ((F.col("linked") > LINKS * F.col("chars")) & ~F.col("inside")))
    template = template.groupBy("host").agg(F.array_sort(F.collect_set("slot")).alias("template"))
    known = materialise(wrappers.join(template, "host", "left"), "templates")

    def extract(batches):
        aligner = Aligner()
        for batch in batches:
            texts = []
            for text, wrapper, slots in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                root = parse(text or "")
                aligner.align(root, wrapper or "")
                texts.append(main_text(root, frozenset(slots or ())))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return (
        _with(rows, known).select("page_id", "url", "html", "wrapper", "template")
        .mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
    )
