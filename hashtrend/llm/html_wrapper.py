"""Main text of web pages by wrapper induction over the pages of a host.

*Trees.*  A page becomes an element tree (unclosed tags end where HTML lets them end); runs of neighbouring children
with one label (tag and class) fold into one node, so a list or a run of paragraphs is one slot.

*Wrapper.*  Pages of a host are aligned in groups of about ``GROUP_PAGES`` (so a host with very many pages spreads over
tasks): every tree is matched with the wrapper by simple tree matching, the largest order-preserving mapping of equal
labels, and what found no partner is added to the wrapper at its place (partial tree alignment), so that later pages of
the same layout meet it.  A text that stands in one aligned node on at least ``CONSTANT`` of at least ``LEAST_PAGES`` different
pages is template; aligned nodes whose texts vary, and nodes without a partner, are content.

*Regions.*  Alignment decides first.  Of the text that varies, what a fixed list of HTML marks as no article text is
left out: menus, headers, footers, sidebars, forms, notices, adverts, reader comments, by element, role, or a word of
the class or id; but never a subtree that holds more than half of the page's varying text (of the elements that HTML
itself sets apart from the article, ``APART``, this holds where no article or main element has text outside them).
Where article or main elements hold more than half of the text that is left, only text inside them counts.  Text that
no reader sees (scripts, styles, the head) is no text from the start.

*Text.*  A block is what stands between two block-level tags; character references are decoded, white space becomes
one space, blocks are joined by line breaks in page order.  Nothing else is dropped.

Defined results: a null or empty html gives an empty text; a null or odd url puts the page among those without host;
repeated rows are extracted once each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashtrend.llm.groups import importable, shared_folder

GROUP_PAGES = 64
SALTS = 32
LEAST_PAGES = 5
CONSTANT = 0.8

# Fixed values of HTML: elements by kind.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title noscript iframe template xmp noembed".split())
BLOCK = set(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search"
    " section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - set("caption col colgroup td th tr tbody thead tfoot option optgroup legend body html head".split())
ENDS = {  # a start tag ends these open elements, up to the nearest of the containers
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
SCOPE = set("html body article aside div section main nav header footer form table td th ul ol dl blockquote figure".split())

# What no reader sees, and what is no article text.
UNSEEN = {"head", "datalist"} | RAW
NO_TEXT = set("nav footer aside form menu dialog button select svg canvas object audio video search label fieldset".split())
APART = NO_TEXT - {"form", "label", "fieldset"}
NO_ROLE = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NO_WORD = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation"
    " breadcrumb breadcrumbs comment comments reply replies disqus cookie cookies consent notice notices popup modal newsletter"
    " subscribe subscription share sharing social related recommended footer masthead login signup toolbar pagination pager"
    " copyright banner alert".split()
)
NO_WORD_OUTSIDE = {"header", "top", "search", "widget", "teaser"}  # unless inside the article

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(/?)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


class Node:
    """An element: label, children, whether it is text at all, and the listed element it lies in."""

    __slots__ = ("tag", "label", "parent", "children", "dropped", "inside", "listed", "wrapped")

    def __init__(self, tag: str, label: str, parent: Node | None, dropped: bool, inside: bool, listed: bool = False):
        self.tag, self.label, self.parent, self.dropped, self.inside = tag, label, parent, dropped, inside
        self.listed = self if listed else parent and parent.listed  # the nearest one on the lists, itself included
        self.children: list[Node] = []
        self.wrapped = None  # the aligned node of the wrapper


def _no_text(tag: str, attributes: dict[str, str], parent: Node) -> bool:
    """Whether the lists name an element."""
    if tag in NO_TEXT or (tag == "header" and not parent.inside):
        return True
    if attributes.get("role", "").strip().lower() in NO_ROLE or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    words = {w.lower() for k in ("class", "id") for w in _CAMEL.findall(attributes.get(k, ""))}
    return bool(words & NO_WORD) or (not parent.inside and bool(words & NO_WORD_OUTSIDE))


Block = tuple["Node", str, "Node | None"]


def parse(html: str) -> tuple[Node, list[Block]]:
    """The element tree and the blocks (element, text, listed element around the text) in page order."""
    root = Node("", "", None, False, False)
    now, run_of = root, root
    run: dict[Node | None, list[str]] = {}  # by listed element, so that an inline one can go without its block
    blocks: list[Block] = []
    at, end = 0, len(html)

    def flush():
        for listed, parts in run.items():
            text = " ".join("".join(parts).split())
            if text:
                blocks.append((run_of, text, listed))
        run.clear()

    def add(text: str):
        nonlocal run_of
        if not now.dropped:
            if not run:
                run_of = now
                while run_of.tag not in BLOCK and run_of.parent is not None:
                    run_of = run_of.parent
            run.setdefault(now.listed, []).append(unescape(text))

    while at < end:
        m = _TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:  # end tag
            if tag == "br":
                add(" ")
                continue
            node = now
            while node.parent is not None and node.tag != tag:
                if tag not in BLOCK and node.tag in SCOPE:
                    break  # an inline end tag does not close blocks around it
                node = node.parent
            if node.parent is not None and node.tag == tag:
                if tag in BLOCK:
                    flush()
                now = node.parent
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK:
            flush()
        if tag in CLOSES_P:
            node = now
            while node.parent is not None and node.tag not in SCOPE and node.tag != "p":
                node = node.parent
            if node.tag == "p":
                now = node.parent
        if tag in ENDS:
            closes, until = ENDS[tag]
            node, found = now, None
            while node.parent is not None and node.tag not in until:
                if node.tag in closes:
                    found = node
                node = node.parent
            if found is not None:
                now = found.parent
        if tag in ("body", "head", "html") and tag == "body":
            while now.parent is not None and now.tag != "html":  # an open head ends here
                now = now.parent
        attributes = {k.lower(): unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3] else {}
        dropped = now.dropped or tag in UNSEEN
        listed = not dropped and _no_text(tag, attributes, now)
        inside = now.inside or tag in ("article", "main") or attributes.get("role", "").lower() in ("main", "article")
        node = Node(tag, f"{tag}.{attributes.get('class', '')}", now, dropped, inside and not dropped, listed)
        now.children.append(node)
        if tag in RAW:
            stop = _RAW_END[tag].search(html, at)
            at = stop.start() if stop else end
            if stop:
                at = html.find(">", at) + 1 or end
        elif tag not in VOID and not m[4]:
            now = node
    flush()
    return root, blocks


def folded(node: Node) -> list[list[Node]]:
    """Children as runs of neighbours with one label; a run's members share their grandchildren's slots."""
    runs: list[list[Node]] = []
    for child in node.children:
        if runs and runs[-1][0].label == child.label:
            runs[-1].append(child)
        else:
            runs.append([child])
    return runs


class Slot:
    """A folded node: a label, its folded children, the elements it stands for."""

    __slots__ = ("label", "children", "members")

    def __init__(self, label: str, members: list[Node]):
        self.label, self.members = label, members
        self.children: list[Slot] = []


def folded_tree(root: Node) -> Slot:
    """The slots of a page under a common root; a stack in place of recursion, as pages may be nested to any depth."""
    tree = Slot("", [root])
    open_ = [tree]
    while open_:
        slot = open_.pop()
        together: list[list[Node]] = []
        known: dict[str, list[Node]] = {}  # the first run of a label
        for member in slot.members:
            for run in folded(member):
                label = run[0].label
                if together and together[-1][0].label == label:
                    together[-1].extend(run)
                elif len(slot.members) > 1 and label in known:
                    known[label].extend(run)
                else:
                    together.append(list(run))
                    known.setdefault(label, together[-1])
        slot.children = [Slot(run[0].label, run) for run in together]
        open_ += slot.children
    return tree


def _table(a: Slot, b: Slot, size: dict[tuple[int, int], int]) -> list[list[int]]:
    """Sizes of the largest order-preserving mappings of the first i children of a to the first j of b."""
    best = [[0] * (len(b.children) + 1)]
    for x in a.children:
        above, row, of = best[-1], [0], id(x)
        for j, y in enumerate(b.children):
            own = size.get((of, id(y)), 0)
            row.append(max(above[j + 1], row[j], above[j] + own))
        best.append(row)
    return best


def match(a: Slot, b: Slot, pairs: list | None = None) -> int:
    """Simple tree matching: size of the largest mapping of two trees that keeps order, parents and labels; with
    ``pairs``, the mapped slots are appended to it.  A stack in place of recursion, each pair of slots measured once."""
    if a.label != b.label:
        return 0
    size: dict[tuple[int, int], int] = {}
    open_ = [(a, b, False)]
    while open_:
        x, y, below_known = open_.pop()
        if below_known:
            size[id(x), id(y)] = _table(x, y, size)[-1][-1] + 1
            continue
        open_.append((x, y, True))
        of_label: dict[str, list[Slot]] = {}
        for d in y.children:
            of_label.setdefault(d.label, []).append(d)
        open_ += [(c, d, False) for c in x.children for d in of_label.get(c.label, ())]
    if pairs is not None:
        mapped = [(a, b)]
        while mapped:
            x, y = mapped.pop()
            pairs.append((x, y))
            best = _table(x, y, size)
            i, j = len(x.children), len(y.children)
            while i and j:
                if best[i][j] == best[i - 1][j]:
                    i -= 1
                elif best[i][j] == best[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    mapped.append((x.children[i], y.children[j]))
    return size[id(a), id(b)]


def extend(pairs: list[tuple[Slot, Slot]]) -> list[tuple[Slot, Slot]]:
    """Adds the second tree's slots without a partner to the first tree, behind what stands before them; returns them as
    pairs with themselves."""
    partner = {id(theirs): ours for ours, theirs in pairs}
    new: list[tuple[Slot, Slot]] = []
    for ours, theirs in pairs:
        at = 0
        for child in theirs.children:
            known = partner.get(id(child))
            if known is not None:
                at = next(i for i, c in enumerate(ours.children) if c is known) + 1
                continue
            ours.children.insert(at, child)
            at += 1
            below = [child]
            while below:
                slot = below.pop()
                new.append((slot, slot))
                below += slot.children
    return new


def article_text(blocks: list[Block], template: set[tuple[int, str]]) -> list[str]:
    """The texts that stay: not template, not in a listed element (unless that holds most), and, where article or main
    elements hold most of these, inside them."""
    varying = [(node, text, listed) for node, text, listed in blocks if (node.wrapped, text) not in template]
    total = sum(len(text) for _, text, _ in varying)
    held: dict[Node, int] = {}
    for _, text, listed in varying:
        while listed is not None:
            held[listed] = held.get(listed, 0) + len(text)
            listed = listed.parent.listed
    named = any(node.inside and (listed is None or listed.tag not in APART) for node, _, listed in varying)
    left = []
    for node, text, listed in varying:
        while listed is not None and 2 * held[listed] > total and not (named and listed.tag in APART):
            listed = listed.parent.listed
        if listed is None:
            left.append((node.inside, text))
    article = 2 * sum(len(text) for inside, text in left if inside) > sum(len(text) for _, text in left)
    return [text for inside, text in left if inside or not article]


def extract(pages: list[str], least: int = LEAST_PAGES, constant: float = CONSTANT) -> list[str]:
    """Main texts of pages of one host, aligned with each other."""
    parsed = [parse(p) for p in pages]
    wrapper = None
    seen: dict[tuple, int] = {}  # different pages
    holders: dict[int, set[int]] = {}  # wrapper slot -> pages with a partner of it
    said: dict[tuple[int, str], set[int]] = {}
    for k, (root, blocks) in enumerate(parsed):
        number = seen.setdefault(tuple(article_text(blocks, set())), k)
        tree = folded_tree(root)
        pairs: list[tuple[Slot, Slot]] = []
        if wrapper is None:
            wrapper = Slot("", [])
        match(wrapper, tree, pairs)
        pairs += extend(pairs)
        for ours, theirs in pairs:
            for node in theirs.members:
                node.wrapped = id(ours)
            holders.setdefault(id(ours), set()).add(number)
        for node, text, _ in blocks:
            if node.wrapped is not None:
                said.setdefault((node.wrapped, text), set()).add(number)
    template = {
        k for k, pages_ in said.items() if len(holders[k[0]]) >= least and len(pages_) >= least and len(pages_) >= constant * len(holders[k[0]])
    }
    return ["\n".join(article_text(blocks, template)) for _, blocks in parsed]


_OUT = "page_id long, url string, text string, n_chars long"


def main_texts(pages: DataFrame, group_pages: int = GROUP_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    importable(pages.sparkSession)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
        F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1), F.lit("")).alias("host"),
    )
    # The sizes of hosts beyond one group are a written table, so Spark knows its size: it broadcasts one below
    # spark.sql.autoBroadcastJoinThreshold and leaves the pages where they are.  A larger one meets the pages in a
    # shuffle under SALTS keys a host, so that a host with very many pages is no hot key.  Hosts go by their hash;
    # two that share one only get more parts.
    key = F.xxhash64("host").alias("host_key")
    sizes = rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > group_pages)
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    stored = f"{shared_folder(pages.sparkSession)}/host-sizes-{uuid.uuid4().hex}"
    sizes.write.parquet(stored)
    sizes = pages.sparkSession.read.schema(sizes.schema).parquet(stored)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("url", "page_id"), F.lit(SALTS)).cast("int")).withColumn("host_key", key)
    parts = F.ceil(F.coalesce("n", F.lit(1)) / group_pages)
    dealt = salted.join(sizes, ["host_key", "salt"], "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url"), parts))

    def work(table):
        table = table.sort_by([("page_id", "ascending"), ("url", "ascending"), ("html", "ascending")])
        texts = extract([h or "" for h in table["html"].to_pylist()])
        return pa.table(
            {"page_id": table["page_id"], "url": table["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
        )

    return dealt.select("page_id", "url", "html", "host", "part").groupBy("host", "part").applyInArrow(work, _OUT)


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
