"""Main text of web pages by wrapper induction.

A host's pages are grouped by layout, a hash of the upper tree; layouts of fewer than three pages go together, or to the
host's most frequent layout if that has more pages. Of every group one page of usual length is the reference. Each other
page's tree is aligned with it by simple tree matching, and over all pages of the group every reference node counts how
often it was met and how often with the same text. Nodes that stay the same are the group's template; what varies is
content, but for slots whose marks say that they are menus, adverts, forms and the like, and that do not hold most of
what varies. References meet their pages by broadcast if they are measured to be small, else by a join on group and salt,
so a group with a third of all pages is dealt to many tasks.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .common import Workspace, table

#: Bytes of references up to which they are sent to every task, and parts that a group's pages are dealt to beyond.
BROADCAST_BYTES = 64_000_000
#: Rows of counts per group or host up to which they are sent to every task.
BROADCAST_ROWS = 1_000_000
SALTS = 64
#: A node is template if at least so many pages have it, and so many in a hundred of them with the same text.
LEAST_PAGES = 3
SAME_PERCENT = 80

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
DROPPED = frozenset(
    "head script style noscript template iframe object svg math canvas nav footer aside form button select option textarea input "
    "dialog menu audio video map title".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Tags that end an open element of the same group when they start.
CLOSES = {t: frozenset(["p"]) for t in BLOCKS - {"br", "body", "html", "head"}} | {
    "li": frozenset(["p", "li"]), "dt": frozenset(["p", "dt", "dd"]), "dd": frozenset(["p", "dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["p", "tr", "td", "th"]), "td": frozenset(["p", "td", "th"]), "th": frozenset(["p", "td", "th"]), "body": frozenset(["head"]),
}
#: An open element is not ended beyond these.
SCOPE = {"li": frozenset(["ul", "ol", "menu"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "tr": frozenset(["table"])}
#: Words in class, id or role that mark a slot as no content, if it does not hold most of the text (see `marked`).
MARKS = frozenset(
    "ad ads adsense advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion nav navbar navigation menu "
    "menubar breadcrumb breadcrumbs sidebar sidenav rail footer masthead cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay comment comments commentlist respond reply replies disqus share sharing social related recommended newsletter "
    "subscribe subscription signup login search searchbox pagination pager skip widget toolbar complementary contentinfo dialog form "
    "discussion discussions feedback reactions responses guestbook".split()
)
#: Words that may stand beside a mark in one name: where a slot is and what it is made of. Any other word means another
#: thing: `no-sidebar` and `notice-of-works` are no marks, `sidebar-left` and `post-comments` are.
AROUND = frozenset(
    "top bottom left right inner outer wrap wrapper container holder box block area section slot bar list item items unit group row "
    "col column primary secondary first last site page post entry article user reader head title body button link links icon icons "
    "panel pane module zone frame small large mini mobile desktop fixed sticky global main".split()
)
MAIN = frozenset(["article", "main"])
#: Elements that no mark removes.
UNMARKED = MAIN | {"#page", "html", "body"}
#: Elements that make the layout of a page, and those whose inside does not count for it.
FRAMES = frozenset("div section header footer nav aside article main form center table dl ul ol".split())
WHOLE = frozenset("article main header footer nav aside form table dl ul ol".split())
#: Levels below the body that count.
LAYOUT_LEVELS = 3

_tag = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?\]\]>|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*)>?)", re.S)
_mark = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_words = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_space = re.compile(r"\s+")


def _label(tag: str, marks: str) -> str:
    """What elements are compared by: no numbers, which often count pages, and no marks of elements that a page has once."""
    return tag if tag in UNMARKED else " ".join([tag, *(w for w in marks.split() if not w.isdigit())])


def _named(attributes: str) -> tuple[str, frozenset[str]]:
    """The words and numbers of class, id and role, and the words among them that mark a slot: those of names that say
    nothing else."""
    words, slots = set(), set()
    for value in _mark.findall(attributes):
        for name in "".join(value[1:]).split():
            own = {w.lower() for w in _words.findall(name)}
            words |= own
            found = own & MARKS
            if found and all(w in MARKS or w in AROUND or w.isdigit() for w in own):
                slots |= found
    return " ".join(sorted(words)), frozenset(slots)


class Node:
    """An element: its tag, its marks (words and numbers of class, id and role), those of them that mark a slot, its label, what is in
    it (texts and elements), its place in page order and, once asked for, its text."""

    __slots__ = ("tag", "marks", "slots", "label", "inside", "number", "size", "_shape", "_kids")

    def __init__(self, tag: str, marks: str, number: int, slots: frozenset[str] = frozenset()):
        self.tag, self.marks, self.slots, self.label, self.inside, self.number = tag, marks, slots, _label(tag, marks), [], number
        self.size, self._shape, self._kids = 0, None, None

    @property
    def kids(self) -> list[Node]:
        if self._kids is None:
            self._kids = [x for x in self.inside if not isinstance(x, str)]
        return self._kids

    @property
    def shape(self) -> bytes:
        """A digest of the labels of the tree below, equal for trees that match in full; sets size, its elements, too."""
        if self._shape is None:
            for x in reversed(preorder(self)):
                below = hashlib.blake2b(x.label.encode("utf-8", "surrogatepass") + b"\0", digest_size=16)
                for k in x.kids:
                    below.update(k._shape)
                x.size, x._shape = 1 + sum(k.size for k in x.kids), below.digest()
        return self._shape

    @property
    def dropped(self) -> bool:
        return self.tag in DROPPED

    @property
    def header(self) -> bool:
        return self.tag == "header" or self.tag not in UNMARKED and "header" in self.marks.split()


def preorder(top: Node) -> list[Node]:
    """The node and all below it, in page order."""
    out, todo = [], [top]
    while todo:
        x = todo.pop()
        out.append(x)
        todo.extend(reversed(x.kids))
    return out


def parse(page: str) -> Node:
    """The tree of a page. Bad markup never raises: stray end tags are skipped, open elements end where HTML says."""
    top = Node("#page", "", 0)
    stack, at, number = [top], 0, 1
    opened: Counter[str] = Counter()

    def end_from(i: int) -> None:
        opened.subtract([x.tag for x in stack[i:]])
        del stack[i:]

    for start, end, closing, name, attributes in _tags(page):
        if start > at:
            stack[-1].inside.append(page[at:start])
        at = end
        if not name:
            continue
        if closing:
            if opened[name]:
                end_from(max(i for i, x in enumerate(stack) if x.tag == name) if stack[-1].tag != name else len(stack) - 1)
            continue
        closes = CLOSES.get(name)
        if closes:
            stop = SCOPE.get(name, ())
            i = len(stack) - 1
            while i > 0 and stack[i].tag not in stop and any(opened[t] for t in closes):
                if stack[i].tag in closes:
                    end_from(i)
                elif stack[i].tag in BLOCKS and stack[i].tag not in ("p", "li", "td", "th", "tr", "dt", "dd"):
                    break
                i -= 1
        marks, slots = _named(attributes) if attributes else ("", frozenset())
        node = Node(name, marks, number, slots)
        number += 1
        stack[-1].inside.append(node)
        closed = name in VOID or attributes.rstrip().endswith("/") and name not in BLOCKS
        if not closed:
            stack.append(node)
            opened[name] += 1
    if at < len(page):
        stack[-1].inside.append(page[at:])
    return top


def layout(top: Node) -> int:
    """A hash of the upper tree: the frames directly in the body in their order, below them without repeats in a row."""
    body = top
    while body.tag in ("#page", "html"):
        inner = [k for k in body.kids if k.tag in ("html", "body")]
        if not inner:
            break
        body = inner[0]
    found = hashlib.blake2b(digest_size=8)
    todo: list[tuple[Node, int]] = [(body, 0)]
    while todo:
        x, level = todo.pop()
        found.update(f"{level} {x.label}\n".encode("utf-8", "surrogatepass"))
        if level == LAYOUT_LEVELS or x.tag in WHOLE:
            continue
        kids = [k for k in x.kids if k.tag in FRAMES]
        if level:
            kids = [k for i, k in enumerate(kids) if not i or k.label != kids[i - 1].label]
        todo.extend((k, level + 1) for k in reversed(kids))
    return int.from_bytes(found.digest(), "big", signed=True)


def _tags(page: str):
    """Start, end, whether closing, name and attributes of each tag; comments have no name. Raw elements hold one text."""
    at = 0
    while True:
        m = _tag.search(page, at)
        if not m:
            return
        name = (m[2] or "").lower()
        yield m.start(), m.end(), bool(m[1]), name, m[3] or ""
        at = m.end()
        if name in RAW and not m[1]:
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = close.start() if close else len(page)
            if not close:
                return


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """The pairs of a largest simple tree matching: equal labels, order kept, parents matched.

    Equal trees at both ends of two lists of children are matched first, which loses nothing; the rest is found by
    dynamic programming.
    """
    sizes: dict[tuple[bytes, bytes], int] = {}

    def known(x: Node, y: Node) -> int | None:
        if x.label != y.label:
            return 0
        if not x.kids or not y.kids:
            return 1
        return x.size if x.shape == y.shape else sizes.get((x.shape, y.shape))

    def ends(xs: list[Node], ys: list[Node]) -> tuple[int, int, int]:
        low, p, q = 0, len(xs), len(ys)
        while low < p and low < q and xs[low].shape == ys[low].shape:
            low += 1
        while p > low and q > low and xs[p - 1].shape == ys[q - 1].shape:
            p, q = p - 1, q - 1
        return low, p, q

    def size_all(xs: list[Node], ys: list[Node]) -> None:
        """Fill in the sizes that matching these lists asks for, those of the trees below first."""
        todo: list[tuple] = [(None, xs, ys)]
        while todo:
            key, us, vs = todo[-1]
            low, p, q = ends(us, vs)
            missing = {(x.shape, y.shape): (x.kids, y.kids) for x in us[low:p] for y in vs[low:q] if known(x, y) is None}
            if missing:
                todo.extend((k, *lists) for k, lists in missing.items())
                continue
            todo.pop()
            if key and key not in sizes:
                sizes[key] = 1 + sum(n for _, _, n in children(us, vs))

    def children(xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node, int]]:
        low, p, q = ends(xs, ys)
        pairs = [(x, y, x.size) for x, y in (*zip(xs[:low], ys[:low]), *zip(xs[p:], ys[q:]))]
        left, right = xs[low:p], ys[low:q]
        if left and right:
            best = [[0] * (len(right) + 1)]
            for x in left:
                above, row = best[-1], [0]
                for j, y in enumerate(right):
                    n = known(x, y)
                    row.append(max(above[j + 1], row[j], above[j] + n if n else 0))
                best.append(row)
            i, j = len(left), len(right)
            while i and j:
                if best[i][j] == best[i - 1][j]:
                    i -= 1
                elif best[i][j] == best[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((left[i], right[j], best[i + 1][j + 1] - best[i][j]))
        return pairs

    a.shape, b.shape  # sets the sizes of all nodes
    out, todo = [], [(a, b)] if a.label == b.label else []
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        if x.kids and y.kids:
            size_all(x.kids, y.kids)
            todo.extend((p, q) for p, q, _ in children(x.kids, y.kids))
    return out


def marked(top: Node, skip: frozenset[int] = frozenset(), *, headers: bool = True) -> frozenset[int]:
    """Numbers of the slots of a page that marks remove.

    Marks never remove html, body, article or main, nor what is around the page's articles (around the largest, where
    some article lies outside all marked slots: then the others are comments, teasers and the like). They remove no slot
    that holds more than half of the text of its article or main (of the page, outside those), and no mark counts whose
    slots hold as much together. Text in skip, and in headers unless they are wanted, is not counted.
    """
    nodes = preorder(top)
    words = {x.number: x.slots for x in nodes if x.slots and x.tag not in UNMARKED}
    slots = set(words)
    if not slots:
        return frozenset()
    weight = {}
    for x in reversed(nodes):
        hidden = x.dropped or x.number in skip or not headers and x.header
        weight[x.number] = 0 if hidden else sum(len(y.strip()) if isinstance(y, str) else weight[y.number] for y in x.inside)
    parent, base, inner, cores = {}, {top.number: top.number}, {top.number: False}, {"article": [], "main": []}
    within = {t: {top.number: False} for t in cores}
    for x in nodes:
        n = x.number
        for t, found in cores.items():
            if x.tag == t and not within[t][n] and weight[n]:
                found.append(n)
        if x.tag in MAIN and base[n] == top.number:
            base[n] = n
        for k in x.kids:
            parent[k.number], base[k.number], inner[k.number] = n, base[n], inner[n] or n in slots
            for t, flags in within.items():
                flags[k.number] = flags[n] or x.tag == t
    kept = cores["article"] or cores["main"]
    if any(not inner[n] for n in kept):
        kept = [max(kept, key=lambda n: weight[n])]
    for n in kept:
        while n in parent:
            n = parent[n]
            slots.discard(n)
    slots = {n for n in slots if 2 * weight[n] <= weight[base[n]]}
    together: dict[tuple[int, str], int] = {}
    below = set()
    for x in nodes:
        n = x.number
        if n in slots and n not in below:
            for w in words[n]:
                together[base[n], w] = together.get((base[n], w), 0) + weight[n]
        if n in slots or n in below:
            below.update(k.number for k in x.kids)
    return frozenset(n for n in slots if any(2 * together.get((base[n], w), 0) <= weight[base[n]] for w in words[n]))


def text_of(node: Node, skip: frozenset[int] = frozenset(), *, headers: bool = True) -> str:
    """The blocks of text below a node, one per line; elements that never are content and those in skip are left out,
    and headers too unless they are wanted."""
    blocks, run = [], []

    def flush() -> None:
        text = _space.sub(" ", html.unescape("".join(run))).strip()
        if text:
            blocks.append(text)
        run.clear()

    todo: list = [(node, False)]
    while todo:
        x, ends = todo.pop()
        if isinstance(x, str):
            run.append(x)
        elif ends:
            flush()
        elif x.number in skip or x is not node and (x.dropped or not headers and x.header):
            if x.tag in BLOCKS:
                flush()
        else:
            if x.tag in BLOCKS:
                flush()
                todo.append((x, True))
            todo.extend((y, False) for y in reversed(x.inside))
    flush()
    return "\n".join(blocks)


def mains(top: Node, skip: frozenset[int]) -> list[Node]:
    """The outermost article and main elements outside slots that are no content, which skip has."""
    found, todo = [], [top]
    while todo:
        x = todo.pop()
        if not x.dropped and x.number not in skip:
            if x.tag in MAIN:
                found.append(x)
            else:
                todo.extend(reversed(x.kids))
    return found


class Texts:
    """The text below each element, white space folded, as a range of the page's text."""

    def __init__(self, top: Node):
        pieces, at, self.ranges = [], 0, {}
        todo: list = [(top, None)]
        while todo:
            x, start = todo.pop()
            if isinstance(x, str):
                text = _space.sub(" ", x).strip()
                if text:
                    pieces.append(text)
                    at += len(text) + 1
            elif start is None:
                todo.append((x, at))
                todo.extend((y, None) for y in reversed(x.inside))
            else:
                self.ranges[x.number] = (start, max(start, at - 1))
        self.text = " ".join(pieces)

    def same(self, number: int, other: Texts, others: int) -> bool:
        """Whether two elements have the same text, and any."""
        (a, b), (c, d) = self.ranges[number], other.ranges[others]
        return a < b and b - a == d - c and self.text[a:b] == other.text[c:d]


def counts(reference: Node, texts: Texts, page: Node) -> tuple[list[int], list[int]]:
    """Numbers of the reference nodes that the page has, and of those with the same text."""
    own = Texts(page)
    pairs = align(reference, page)
    return [x.number for x, _ in pairs], [x.number for x, y in pairs if texts.same(x.number, own, y.number)]


def own_text(page: Node) -> str:
    """The text of the page's article and main elements without marked slots. It needs no wrapper: text inside them is
    never template, as a host may hold many copies of an article."""
    slots = marked(page)
    return "\n".join(t for t in (text_of(x, slots) for x in mains(page, slots)) if t)


def varying_text(page: Node, reference: Node | None, template: frozenset[int]) -> str:
    """The text of every slot that varies between the pages of a group, or, where nothing varies, of all slots."""
    pairs = align(reference, page) if reference and template else []
    same = frozenset(y.number for x, y in pairs if x.number in template)
    text = text_of(page, same | marked(page, same, headers=False), headers=False)
    # Else all of it is on most pages of the host: copies of one article.
    return text or text_of(page, marked(page, headers=False), headers=False)


def extract(page: Node, reference: Node | None, template: frozenset[int]) -> str:
    """The main text of a page by its group's wrapper."""
    return own_text(page) or varying_text(page, reference, template)


def _hosted(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.regexp_extract(F.col(url_col), r"(?s)\A.*?://([^/?#]*)", 1)
    return pages.select(
        F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"),
        F.lower(F.coalesce(host, F.lit(""))).alias("_host"),
    )


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, own = [], []
        for page in batch.column(2).to_pylist():
            top = parse(page)
            found.append(layout(top))
            own.append(own_text(top) or None)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(found, pa.int64()), pa.array(own, pa.string())], names=["_id", "_url", "_html", "_host", "_layout", "_own"],
        )


def _grouped(hosted: DataFrame, work: Workspace) -> DataFrame:
    """Adds _group, the code of a host's layout, or of what its layouts of few pages go to."""
    id_type = dict(hosted.dtypes)["_id"]
    laid = work.write(hosted.mapInArrow(_layouts, f"_id {id_type}, _url string, _html string, _host string, _layout long, _own string"), "pages")
    code = F.xxhash64("_host", "_layout")
    sizes = laid.groupBy("_host", "_layout").agg(F.count(F.lit(1)).alias("_n"))
    many = F.col("_n") >= LEAST_PAGES
    most = F.max(F.when(many, F.struct("_n", code.alias("_code"))))
    few = F.coalesce(F.sum(F.when(~many, F.col("_n"))), F.lit(0))
    others = sizes.groupBy("_host").agg(
        F.when(most["_n"] > few, most["_code"]).otherwise(F.xxhash64("_host")).alias("_other"),
    )
    kept = sizes.where(many).select(code.alias("_kept"))
    kept, others = (F.broadcast(t) if t.count() <= BROADCAST_ROWS else t for t in (kept, others))
    group = F.coalesce("_kept", "_other")
    joined = laid.join(kept, code == F.col("_kept"), "left").join(others, "_host")
    return joined.select("_id", "_url", "_html", "_own", group.alias("_group"))


def _with_references(grouped: DataFrame, references: DataFrame, broadcast: bool) -> DataFrame:
    if broadcast:
        return grouped.join(F.broadcast(references), "_group", "left")
    salted = references.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = grouped.withColumn("_salt", F.pmod(F.xxhash64("_id", "_html"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["_group", "_salt"], "left").drop("_salt")


class _Parsed:
    """Trees and node texts of the references that a task meets; the few last ones are kept."""

    def __init__(self):
        self.kept: dict[int, tuple[Node, Texts]] = {}

    def __call__(self, group: int, page: str) -> tuple[Node, Texts]:
        if group not in self.kept:
            if len(self.kept) >= 256:
                self.kept.clear()
            top = parse(page)
            self.kept[group] = (top, Texts(top))
        return self.kept[group]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parsed, found = _Parsed(), {}

    def out() -> pa.RecordBatch:
        keys = list(found)
        made = pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()),
            pa.array([found[k][0] for k in keys], pa.int64()), pa.array([found[k][1] for k in keys], pa.int64()),
        ], names=["_group", "node", "met", "same"])
        found.clear()
        return made

    for batch in batches:
        for group, page, reference in zip(*(batch.column(i).to_pylist() for i in range(3))):
            top, texts = parsed(group, reference)
            met, same = counts(top, texts, parse(page))
            for i, numbers in ((0, met), (1, same)):
                for n in numbers:
                    found.setdefault((group, n), [0, 0])[i] += 1
        if len(found) > 100_000:
            yield out()
    yield out()


def induce(grouped: DataFrame, work: Workspace) -> tuple[DataFrame, bool]:
    """Per group the reference page and the numbers of its template nodes, counted over all its pages."""
    usual = grouped.groupBy("_group").agg(F.avg(F.length("_html")).alias("_usual"))
    small = usual.count() <= BROADCAST_ROWS
    near = F.struct(F.abs(F.length("_html") - F.col("_usual")).alias("d"), F.xxhash64("_html").alias("h"))
    ranked = grouped.join(F.broadcast(usual) if small else usual, "_group")
    references = work.write(ranked.groupBy("_group").agg(F.min_by("_html", near).alias("_reference")), "references")
    size = references.agg(F.sum(F.octet_length("_reference"))).first()[0] or 0
    broadcast = size <= BROADCAST_BYTES
    joined = _with_references(grouped, references, broadcast).select("_group", "_html", "_reference")
    found = joined.mapInArrow(_count, "_group long, node int, met long, same long").groupBy("_group", "node").agg(
        F.sum("met").alias("met"), F.sum("same").alias("same"),
    ).where((F.col("met") >= LEAST_PAGES) & (100 * F.col("same") >= SAME_PERCENT * F.col("met")))
    nodes = found.groupBy("_group").agg(F.sort_array(F.collect_list("node")).alias("_template"))
    return work.write(references.join(nodes, "_group", "left"), "wrappers"), broadcast


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parsed = _Parsed()
    for batch in batches:
        texts = []
        for group, own, page, reference, template in zip(*(batch.column(i).to_pylist() for i in range(2, 7))):
            if own is None:
                own = varying_text(parse(page), parsed(group, reference)[0] if reference else None, frozenset(template or ()))
            texts.append(own)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["_id", "_url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: the id, url, text (empty if none) and n_chars.

    Pages with a NULL url, or none with `://`, share one wrapper of their own. NULL and empty html has an empty text.
    Repeated rows each get a row; other columns are not looked at; an empty table gives an empty result.
    """
    work = Workspace(pages.sparkSession, "html-extract")
    grouped = _grouped(_hosted(pages, id_col, url_col, html_col), work)
    wrappers, broadcast = induce(grouped, work)
    open_ = F.col("_own").isNull()
    joined = _with_references(grouped, wrappers, broadcast).select(
        "_id", "_url", "_group", "_own", *[F.when(open_, F.col(c)).alias(c) for c in ("_html", "_reference", "_template")],
    )
    id_type = dict(grouped.dtypes)["_id"]
    out = joined.mapInArrow(_extract, f"_id {id_type}, _url string, text string, n_chars long")
    return out.withColumnsRenamed({"_id": id_col, "_url": url_col})


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
