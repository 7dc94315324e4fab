"""Main text of web pages by wrapper induction.

Pages are read into light trees of blocks.  A block's key is its path of elements
and names with its text.  For every host, the keys are counted over all its pages
of different content; a key that stands on LEAST of them and on more than half is
the host's template.  The pages on which the template's keys stand first, cut to
the template, are the host's patterns.  Each page's tree is aligned to them by
simple tree matching, also inside marked articles: the largest set of node pairs
that keeps ancestors and the order of siblings.  Aligned nodes with a template
key are left out, the rest is content.  Where a page marks its article (article,
main) only that is taken, and regions that are no article by their element, role
or name (menus, footers, sidebars, adverts, forms, comments) are left out
anywhere; names that parts of articles have too (notice, related, search and the
like) only outside marked articles.

Nothing here recurses along a page's nesting.  Lists of siblings are trimmed of
equal subtrees at both ends; the rest is matched by the weight of what is below,
whatever its size, by rows of bits where every pair counts one.  Time can grow with
the product of the sizes of a page and a pattern, memory does not.

Pages with the same article count once, so neither copies nor two pages make a
template; if nothing but template is left, the page keeps its text.

Defined results: null and empty pages have the empty text; pages without a host
are aligned with nothing; pages that repeat give a row each; pages of any length
are read whole; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import save, text_blocks

# Elements by role (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var".split()
)
LEFT_OUT = frozenset(
    "head title script style noscript template nav header footer aside form menu button select textarea input option "
    "iframe object embed svg canvas audio video dialog noembed noframes".split()
)
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form toolbar".split())
# Names (class, id) by role, as pages commonly give them (fixed values).
LEFT_OUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|ad(?:box|slot|unit|container|wrap|wrapper|banner|block)s?|advert\w*|adsense|sponsor\w*|cookies?|consent|gdpr|"
    r"sidebar|nav\w*|breadcrumbs?|masthead|footer|comments?|disqus|replies|respond|share|sharing|social|newsletter|subscribe|pagination|pager)(?:$|[\s_-])",
    re.I,
)
#: Names that leave a region out only outside marked articles, whose parts have such names too.
HINT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:alert|announcement|promo\w*|banner|notice|notification|side|menu|header|signup|login|related|recommended|popup|modal|widget|"
    r"toolbar|search)(?:$|[\s_-])",
    re.I,
)
#: What an opening tag closes when it is still open.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
#: Where the search for an element to close ends.
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


#: Distinct pages of a host that a template node stands on at least.
LEAST = 3
#: Products of lengths up to which a table of siblings is kept whole and without bits; the pairs are the same beyond.
SMALL = 400
#: Weights of pairs of subtrees that are kept at a time.
HELD = 1_000_000


@dataclass(slots=True, eq=False)
class Node:
    tag: str
    name: str = ""  # class and id
    out: bool = False  # no article by element, role or name
    hint: bool = False  # no article by a name that articles use too
    children: list = field(default_factory=list)  # nodes and strings, in page order
    slots: list | None = None  # children that alignment sees, once prepared
    size: int = 1  # of the tree of slots
    height: int = 1
    key: int = 0  # of path and text, once keyed() has run


def _node(tag: str, raw: str) -> Node:
    node = Node(tag, out=tag in LEFT_OUT)
    if raw and not raw.isspace():
        given = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}
        node.name = f"{given.get('class', '')} {given.get('id', '')}".strip()
        if given.get("role", "").lower() == "main" and tag != "main":
            node.tag = "main"
        named = tag not in ("html", "body")
        node.out = (
            node.out
            or given.get("role", "").lower() in LEFT_OUT_ROLES
            or "hidden" in given
            or given.get("aria-hidden") == "true"
            or bool(re.search(r"display\s*:\s*none", given.get("style", ""), re.I))
            or (named and bool(LEFT_OUT_NAMES.search(node.name)))
        )
        node.hint = named and bool(HINT_NAMES.search(node.name))
    return node


def parse(page: str) -> Node:
    """The page's tree; never fails, whatever the markup, in time linear in the page but for odd nesting."""
    root = Node("#root")
    stack, tags, open_tags = [root], ["#root"], Counter()
    last = page.rfind(">")  # a tag that the page does not close is text

    def pop_to(i: int) -> None:
        open_tags.subtract(tags[i:])
        del stack[i:], tags[i:]

    at = 0
    while True:
        m = _TOKEN.search(page, at) if at <= last or page.find("<!--", at) >= 0 else None
        text = page[at : m.start() if m else len(page)]
        if text:
            stack[-1].children.append(html.unescape(text))
        if not m:
            return root
        at = m.end()
        closing, tag = m[1], (m[2] or "").lower()
        if not tag:
            continue
        if closing:
            if open_tags[tag] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if tags[i] == tag:
                        pop_to(i)
                        break
                    if tag in INLINE and tags[i] not in INLINE:
                        break
            continue
        if tag not in INLINE:
            while len(stack) > 1 and (tags[-1] in INLINE or (tags[-1] == "p" and tag != "br")):
                if tag in VOID and tag != "hr":
                    break
                pop_to(len(stack) - 1)
            if tag in CLOSES and any(open_tags[t] > 0 for t in CLOSES[tag]):
                for i in range(len(stack) - 1, 0, -1):
                    if tags[i] in SCOPES.get(tag, {"table"}):
                        break
                    if tags[i] in CLOSES[tag]:
                        pop_to(i)
                        break
        if tag == "br":
            stack[-1].children.append(" ")
            continue
        node = _node(tag, m[3])
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(page, at)
            if tag in ("textarea", "title"):
                node.children.append(html.unescape(page[at : end.start() if end else len(page)]))
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
            tags.append(tag)
            open_tags[tag] += 1


def _is_article(node: Node) -> bool:
    return node.tag in ("article", "main")


def _own_header(node: Node) -> bool:
    """The heading of an article may stand in a header of its own."""
    return node.tag == "header" and not LEFT_OUT_NAMES.search(node.name)


def _visible(node: Node, inside: bool) -> bool:
    """Is a node read? Inside marked articles names that only hint leave nothing out."""
    if inside:
        return not node.out or _own_header(node)
    return not node.out and not node.hint


def _first(root: Node, wanted, enter) -> list[Node]:
    """Outermost nodes below root that are wanted, in page order; nodes that are not entered hide what they hold."""
    found, stack = [], list(reversed(root.children))
    while stack:
        c = stack.pop()
        if isinstance(c, Node) and enter(c):
            if wanted(c):
                found.append(c)
            else:
                stack.extend(reversed(c.children))
    return found


def blocks(node: Node, drop: frozenset | set = frozenset(), inside: bool = False) -> list[str]:
    """Texts of the blocks under a node, without what is left out or in drop (ids of nodes)."""
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append(text)

    stack = [(iter(node.children), inside, True)]
    while stack:
        rest, within, is_block = stack[-1]
        for c in rest:
            if isinstance(c, str):
                held.append(c)
                continue
            block = c.tag not in INLINE
            if block and (c.tag not in VOID or c.tag == "hr"):
                close()
            if _visible(c, within) and id(c) not in drop:
                stack.append((iter(c.children), within or block and _is_article(c), block))
                break
        else:
            stack.pop()
            if is_block:
                close()
    close()
    return out


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True) or 1


def prepared(root: Node) -> set[int]:
    """The keys of a tree's blocks with text; slots, sizes and keys are set on its nodes.

    A key is a hash of the path of elements and names and of all text below, taken
    from the leaves up, so that deep trees cost no more than flat ones.
    """
    order: list[tuple[Node, bytes, list]] = []
    stack = [(root, b"", False)]
    while stack:
        node, path, inside = stack.pop()
        inside = inside or _is_article(node)
        seen = [c for c in node.children if isinstance(c, str) or _visible(c, inside)]
        node.slots = [c for c in seen if isinstance(c, Node) and c.tag not in INLINE and c.tag not in VOID]
        order.append((node, path, seen))
        for c in seen:
            if isinstance(c, Node):
                below = path if c.tag in INLINE else hashlib.blake2b(path + f"/{c.tag} {c.name}".encode("utf-8", "surrogatepass"), digest_size=8).digest()
                stack.append((c, below, inside))
    digests: dict[int, bytes] = {}
    keys: set[int] = set()
    for node, path, seen in reversed(order):
        parts = [" ".join(c.split()).encode("utf-8", "surrogatepass") if isinstance(c, str) else digests.pop(id(c)) for c in seen]
        text = b"\0".join(p for p in parts if p)
        digests[id(node)] = hashlib.blake2b(text, digest_size=16).digest() if text else b""
        node.size += sum(c.size for c in node.slots)
        node.height += max((c.height for c in node.slots), default=0)
        if text and node is not root and node.tag not in INLINE and node.tag not in ("html", "body"):
            node.key = _hash(path + digests[id(node)])
            keys.add(node.key)
    return keys


def keyed(root: Node) -> set[int]:
    """The keys of a tree's blocks with text, which are set on them."""
    return prepared(root)


def _fits(a: Node, b: Node) -> bool:
    """Can two blocks be a pair? Where both are keyed, blocks without blocks of their own match by their text too."""
    return a.tag == b.tag and a.name == b.name and not (a.key and b.key and a.key != b.key and not (a.slots and b.slots))


def _trimmed(xs: list[Node], ys: list[Node]) -> tuple[int, int]:
    """How many pairs of equal subtrees stand at the beginning and at the end of two lists: some largest matching has them."""
    same = lambda a, b: a.key and a.key == b.key and _fits(a, b)
    m, n, lo, hi = len(xs), len(ys), 0, 0
    while lo < min(m, n) and same(xs[lo], ys[lo]):
        lo += 1
    while hi < min(m, n) - lo and same(xs[m - 1 - hi], ys[n - 1 - hi]):
        hi += 1
    return lo, hi


def _flat(xs: list[Node], ys: list[Node]) -> bool:
    """Does one of two lists hold no blocks of blocks? Then every pair counts 1."""
    return not any(x.slots for x in xs) or not any(y.slots for y in ys)


def _bit_rows(xs: list[Node], ys: list[Node]):
    """A function (row, from, to) that gives the rows of the most pairs of two flat lists, after the row of `from`: bits, zero where a pair is won over the column before."""
    every, bare, keyed_, inner = ({} for _ in range(4))
    for j, y in enumerate(ys):
        of, bit = (y.tag, y.name), 1 << j
        every[of] = every.get(of, 0) | bit
        if not y.key:
            bare[of] = bare.get(of, 0) | bit
        else:
            keyed_[of, y.key] = keyed_.get((of, y.key), 0) | bit
        if y.slots:
            inner[of] = inner.get(of, 0) | bit
    full = (1 << len(ys)) - 1

    def rows(row: int, begin: int, end: int) -> Iterator[int]:
        for x in xs[begin:end]:
            of = (x.tag, x.name)
            fits = (bare.get(of, 0) | keyed_.get((of, x.key), 0) | (inner.get(of, 0) if x.slots else 0)) if x.key else every.get(of, 0)
            u = row & fits
            row = (row + u | row - u) & full
            yield row

    return rows, full


def _weight_steps(a: Node, b: Node):
    """The size of the largest matching of two trees whose roots are a pair; asks for those of pairs below it."""
    lo, hi = _trimmed(a.slots, b.slots)
    ends = [*zip(a.slots[:lo], b.slots[:lo]), *zip(a.slots[len(a.slots) - hi :], b.slots[len(b.slots) - hi :])]
    total = 1 + sum(min(x.size, y.size) for x, y in ends)
    xs, ys = a.slots[lo : len(a.slots) - hi], b.slots[lo : len(b.slots) - hi]
    if not xs or not ys:
        return total
    if _flat(xs, ys):
        rows, row = _bit_rows(xs, ys)
        for row in rows(row, 0, len(xs)):  # noqa: B007
            pass
        return total + len(ys) - row.bit_count()
    above = [0] * (len(ys) + 1)
    for x in xs:
        row = [0]
        for j, y in enumerate(ys):
            best = max(row[j], above[j + 1])
            if _fits(x, y):
                w = _plain_weight(x, y)
                best = max(best, above[j] + (w or (yield x, y)))
            row.append(best)
        above = row
    return total + above[-1]


def _plain_weight(a: Node, b: Node) -> int:
    """The weight of a pair that needs no matching of what is below it, else 0."""
    if a.key and a.key == b.key:
        return min(a.size, b.size)
    return 0 if a.slots and b.slots else 1


def _weight(a: Node, b: Node, known: dict | None = None) -> int:
    """The size of the largest matching of two trees, of any size, whose roots are a pair.

    Nothing recurses; known keeps weights of pairs found before, and is emptied when it
    holds HELD of them, which costs time alone.
    """
    known = {} if known is None else known
    if w := _plain_weight(a, b) or known.get((id(a), id(b)), 0):
        return w
    stack, answer = [((id(a), id(b)), _weight_steps(a, b))], None
    while stack:
        key, steps = stack[-1]
        try:
            x, y = steps.send(answer)
        except StopIteration as e:
            stack.pop()
            if len(known) >= HELD:
                known.clear()
            answer = known[key] = e.value
            continue
        asked = id(x), id(y)
        answer = known.get(asked)
        if answer is None:
            stack.append((asked, _weight_steps(x, y)))
    return answer


def _by_recurrence(xs: list[Node], ys: list[Node], known: dict | None = None) -> list[tuple[Node, Node]]:
    """Pairs of two lists of siblings, in order, of the largest weight. Of the table only some rows are kept, the others are made again on the way back."""
    m, n = len(xs), len(ys)
    every = m if m * n <= SMALL else max(1, math.isqrt(m))

    def rows(above: list[int], begin: int, end: int) -> Iterator[list[int]]:
        for x in xs[begin:end]:
            row = [0]
            for j, y in enumerate(ys):
                best = max(row[j], above[j + 1])
                row.append(max(best, above[j] + _weight(x, y, known)) if _fits(x, y) else best)
            yield row
            above = row

    return _walked_back(xs, ys, rows, [0] * (n + 1), every, lambda row, j: row[j] == row[j - 1], lambda row, above, j: row[j] == above[j])


def _by_bits(xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node]]:
    """_by_recurrence() of lists that are flat, with the same pairs: rows of the common subsequence as bits."""
    rows, full = _bit_rows(xs, ys)
    return _walked_back(xs, ys, rows, full, max(1, math.isqrt(len(xs))), lambda row, j: row >> (j - 1) & 1, lambda row, above, j: not above >> (j - 1) & 1)


def _walked_back(xs: list[Node], ys: list[Node], rows, first, every: int, left, up) -> list[tuple[Node, Node]]:
    """The pairs that a table's rows tell from its end: left(row, j) and up(row, above, j) say whether a place is worth no more than its neighbours."""
    kept, row = [first], first
    for i in range(0, len(xs), every):
        for row in rows(row, i, min(i + every, len(xs))):  # noqa: B007
            pass
        kept.append(row)
    out, j = [], len(ys)
    for b in reversed(range(len(kept) - 1)):
        begin = b * every
        table = [kept[b], *rows(kept[b], begin, min(begin + every, len(xs)))] if j else []
        i = len(table) - 1
        while i > 0 and j:
            if left(table[i], j):
                j -= 1
            elif up(table[i], table[i - 1], j):
                i -= 1
            else:
                out.append((xs[begin + i - 1], ys[j - 1]))
                i, j = i - 1, j - 1
    return out


def _siblings(xs: list[Node], ys: list[Node], known: dict | None = None) -> list[tuple[Node, Node]]:
    """Pairs of two lists of siblings, in order, of the largest weight: equal ones at both ends first, then the rest."""
    m, n = len(xs), len(ys)
    lo, hi = _trimmed(xs, ys)
    ends = [*zip(xs[:lo], ys[:lo]), *zip(xs[m - hi :], ys[n - hi :])]
    xs, ys = xs[lo : m - hi], ys[lo : n - hi]
    if not xs or not ys:
        return ends
    if len(xs) == len(ys) == 1:
        return ends + ([(xs[0], ys[0])] if _fits(xs[0], ys[0]) else [])
    return ends + (_by_bits(xs, ys) if _flat(xs, ys) and len(xs) * len(ys) > SMALL else _by_recurrence(xs, ys, known))


def align(a: Node, b: Node, pairs: list) -> int:
    """Simple tree matching: the number of pairs of a largest matching of two trees with matching roots, of any size, which are added."""
    for tree in (a, b):
        if tree.slots is None:
            prepared(tree)
            for node in _tree(tree):
                node.key = 0
    known: dict = {}
    before, todo = len(pairs), [(a, b)] if (a.tag, a.name) == (b.tag, b.name) else []
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        todo += _siblings(x.slots, y.slots, known)
    return len(pairs) - before


def _tree(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        yield (node := stack.pop())
        stack += node.slots


def pruned(root: Node, template: set[int] | frozenset) -> Node | None:
    """A keyed tree cut to its template nodes and what stands above them; None if there are none."""
    cut: dict[int, Node] = {}
    for node in reversed(list(_tree(root))):
        kept = [cut.pop(id(c)) for c in node.slots if id(c) in cut]
        if kept or node.key in template:
            cut[id(node)] = Node(
                node.tag, node.name, slots=kept, size=1 + sum(c.size for c in kept), height=1 + max((c.height for c in kept), default=0), key=node.key
            )
    return cut.get(id(root))


def template_nodes(page: Node, patterns: list[Node], template: set[int] | frozenset) -> set[int]:
    """Nodes of the keyed page (their ids) that are aligned with an equal template node of a pattern."""
    out: set[int] = set()
    for pattern in patterns:
        pairs: list = []
        align(page, pattern, pairs)
        out.update(id(a) for a, b in pairs if a.key and a.key == b.key and a.key in template)
    return out


def articles(root: Node) -> list[Node]:
    """The outermost marked articles; without any, the body."""
    shown = lambda n: _visible(n, False)
    found = _first(root, lambda n: n.tag == "article", shown) or _first(root, lambda n: n.tag == "main", shown)
    return found or _first(root, lambda n: n.tag == "body", lambda n: True)[:1] or [root]


def content(root: Node, drop: frozenset | set = frozenset()) -> str:
    """Texts of the articles' blocks, one a line, without the nodes in drop if any text is left."""
    found = articles(root)
    inside = _is_article(found[0])
    kept = [b for n in found if id(n) not in drop for b in blocks(n, drop, inside)] or [b for n in found for b in blocks(n, inside=inside)]
    return "\n".join(kept)


def is_template(pages: int, of: int) -> bool:
    return pages >= LEAST and 2 * pages > of


def main_text(page: str | None, patterns: list[Node] = (), template: set[int] | frozenset | None = None) -> str:
    """The article of a page, one line per block.

    patterns: trees of its host, pruned to the template whose keys are given; or,
    without those, other pages of the host, counted as extract_text() counts them.
    """
    if not page:
        return ""
    root = parse(page)
    if not patterns:
        return content(root)
    own = keyed(root)
    if template is None:
        held = {content(p): {n.key for n in _tree(p) if n.key} if p.slots is not None else keyed(p) for p in patterns} | {content(root): own}
        counts = Counter(k for keys in held.values() for k in keys)
        template = {k for k, n in counts.items() if is_template(n, len(held))}
        patterns = [p for p in (pruned(p, template) for p in patterns) if p is not None]
    if not own & template:
        return content(root)
    return content(root, template_nodes(root, list(patterns), template))


SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def host_column(url: str = "url"):
    return F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def host_patterns(pages: DataFrame) -> DataFrame:
    """(host, keys, patterns): keys of each host's template, and the html of pages that hold them.

    Keys are counted over all pages: first those of each content, then the contents
    of each key, both with partial aggregation, so a large host is no task of its
    own.  More than half of a host's contents hold each of its template keys: their
    number is under twice that of the blocks of a page.
    """
    rows = pages.withColumn("page", F.xxhash64("html")).where((F.length("host") > 0) & (F.length("html") > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, texts in text_blocks(batches, 4_000_000, "html"):
            at, keys, contents = [], [], []
            for i, page in enumerate(texts):
                root = parse(page)
                own = [0, *keyed(root)]  # 0: the page itself
                at += [i] * len(own)
                keys += own
                contents += [_hash(content(root).encode("utf-8", "surrogatepass"))] * len(own)
            held = block.select(["host", "page"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array(keys, pa.int64()), pa.array(contents, pa.int64())], names=["host", "page", "key", "content"])

    nodes = rows.select("host", "page", "html").mapInArrow(run, "host string, page long, key long, content long")
    once = nodes.groupBy("host", "key", "content").agg(F.min("page").alias("page"))
    counted = save(once.groupBy("host", "key").agg(F.count("*").alias("n"), F.min("page").alias("page")).where(F.col("n") >= LEAST), "nodes")
    whole = counted.where("key = 0").select("host", F.col("n").alias("of"))
    template = save(counted.where("key <> 0").join(whole, "host").where(F.col("n") * 2 > F.col("of")).select("host", "key", "page"), "template")
    chosen = rows.select("host", "page", "html").join(template.select("host", "page").distinct(), ["host", "page"])
    patterns = chosen.groupBy("host", "page").agg(F.min("html").alias("html")).groupBy("host").agg(F.collect_list("html").alias("patterns"))
    return save(template.groupBy("host").agg(F.collect_list("key").alias("keys")).join(patterns, "host"), "patterns")


def extract_text(pages: DataFrame) -> DataFrame:
    """Main text of every page (page_id, url, html), with its length in code points."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("host", host_column())
    joined = rows.join(host_patterns(rows), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list[Node], frozenset]] = {}
        for block, texts in text_blocks(batches, 4_000_000, "html"):
            out = []
            hosts, keys, patterns = (block.column(c) for c in ("host", "keys", "patterns"))
            for i, (page, host) in enumerate(zip(texts, hosts.to_pylist(), strict=True)):
                if host is None or not keys[i].is_valid:
                    out.append(main_text(page))
                    continue
                if host not in held:
                    if len(held) > 64:
                        held.clear()
                    template = frozenset(keys[i].as_py())
                    trees = [parse(p) for p in patterns[i].as_py()]
                    for tree in trees:
                        keyed(tree)
                    held[host] = [p for p in (pruned(t, template) for t in trees) if p is not None], template
                out.append(main_text(page, *held[host]))
            yield pa.RecordBatch.from_arrays(
                [block.column("page_id"), block.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=SCHEMA.names
            )

    return joined.select("page_id", "url", "host", "html", "keys", "patterns").mapInArrow(run, SCHEMA)
