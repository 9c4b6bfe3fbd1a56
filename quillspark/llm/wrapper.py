"""Main text of web pages by wrapper induction over pages of one host.

1. A page becomes a tree of its block-level nodes. Under one parent, like text elements (paragraphs, headings, items) fold into one node,
   and so do boxes in a row that are built alike.
2. Of each host, the page with the smallest id lends its folded tree as the exemplar. Every page is aligned to
   it by simple tree matching: the largest set of node pairs that keeps parents, order and labels.
3. Over all pages of a host, each exemplar node's texts are counted. A node that has one text on nearly all of three pages and
   more is template; varying nodes are slots.
4. The content is the node below which nearly all varying text lies, whatever its element is called.
   Pages give its blocks, without template and without what is marked as menu, advert, form, comment
   and the like. A page that doesn't align decides by itself.

Counts are combined in the tasks and by host, so a host with a third of all pages costs a row for
each of its different texts. Host models are broadcast when they are small, else joined.
"""

from __future__ import annotations

import html
import re
from collections import OrderedDict, defaultdict
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import saved, shared_dir, small_batches

# Fixed values of the HTML standard: elements without content, with raw text, within a line, and which start tags end a paragraph.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
#: Elements that hold no article text.
NOISE_TAGS = frozenset("head title nav footer aside form script style noscript template iframe svg button select textarea input option dialog menu object embed canvas audio video".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tr td th figcaption hr address".split())
#: Words in class, id or role that mark what isn't the article.
NOISE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|search"
    r"|side|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|toolbar|share|sharing|social|related|recommend\w*|comments?|commentlist|reply|replies|respond|disqus|reactions?|pagination|pager|widget"
    r"|complementary|contentinfo|skip)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Within an article or main element, only boxes count, and only words for what an article never has: words of a page's layout, and of what authors write, say nothing.
NOISE_IN_ARTICLE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscri\w*|signup|login|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead"
    r"|toolbar|comments?|commentlist|disqus|pagination|pager|complementary|contentinfo|skip)(?:$|[\s_-])",
    re.IGNORECASE,
)
MARK = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)|[!?][^>]*+(?:>|\Z))", re.DOTALL)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)


class Node:
    __slots__ = ("children", "label", "noise", "tag")

    def __init__(self, tag: str, marks: str = "", noise: bool = False) -> None:
        self.tag, self.noise = tag, noise
        self.label = f"{tag}.{re.sub(r'[0-9]+', '0', marks)}" if marks else tag
        self.children: list[Node] = []


def parse(source: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The root, and the blocks in page order: (the innermost open node, the text). Any depth takes time in proportion to the page."""
    root = Node("#root")
    stack, blocks, text, at = [root], [], [], 0
    opened: dict[str, int] = defaultdict(int)  # open elements by tag

    def flush() -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                blocks.append((stack[-1], joined))
            text.clear()

    def close(k: int) -> None:
        flush()
        for n in stack[k:]:
            opened[n.tag] -= 1
        del stack[k:]

    while at < len(source):
        m = MARK.search(source, at)
        if not m:
            text.append(source[at:])
            break
        text.append(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue  # a comment or declaration
        tag = m[2].lower()
        marks = " ".join(next(filter(None, a[1:]), "") for a in ATTRIBUTE.findall(m[3])) if "=" in m[3] else ""
        within = opened["article"] or opened["main"]
        inline = tag in INLINE and (within or not (marks and tag not in VOID and NOISE_WORDS.search(marks)))
        if m[1]:
            if opened[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            elif not inline:
                flush()
            continue
        if inline:
            if tag == "br":
                text.append(" ")
            continue
        flush()
        # start tags that end open elements
        ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ()) + (() if tag in INLINE else ("p",))
        walls = ("ul", "ol", "dl", "table", "select", "div", "article", "section", "main", "aside", "body")
        for k in range(len(stack) - 1, 0, -1) if any(opened[e] for e in ends) else ():
            if stack[k].tag in ends:
                close(k)
            elif stack[k].tag in walls:
                break
        header = tag == "header" and not within
        # layout classes of a page's frame ("has-sidebar") don't mark all that is in it; an article may be a comment
        named = bool(marks and not (within and tag in TEXT_TAGS) and (NOISE_IN_ARTICLE if within else NOISE_WORDS).search(marks)) and tag not in ("html", "body", "main") and (tag != "article" or "comment" in marks.lower())
        node = Node(tag, marks, tag in NOISE_TAGS or header or named)
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(source, at)
            at = end.end() if end else len(source)
            continue
        stack.append(node)
        opened[tag] += 1
    flush()
    return root, blocks


class Folded:
    """A node of the folded tree: like siblings in a row are one."""

    __slots__ = ("built", "children", "label", "noise", "number", "size", "tag")

    def __init__(self, label: str, tag: str, noise: bool) -> None:
        self.label, self.tag, self.noise, self.number = label, tag, noise, -1
        self.children: list[Folded] = []


def _built(root: Node) -> dict[int, int]:
    """How each node is built, by identity: its label and how its children are, like text elements once, like neighbours once."""
    order = [root]
    for n in order:
        order += n.children
    out: dict[int, int] = {}
    for n in reversed(order):
        inner, seen, last = [n.label], set(), 0
        for c in n.children:
            own = out[id(c)]
            if own != last and (c.tag not in TEXT_TAGS or c.label not in seen):
                inner.append(c.label if c.tag in TEXT_TAGS else str(own))
            seen.add(c.label)
            last = own
        out[id(n)] = xxhash.xxh3_64_intdigest("\n".join(inner))
    return out


def fold(root: Node) -> tuple[Folded, dict[int, Folded]]:
    """The folded tree, and the folded node of each node by identity."""
    of: dict[int, Folded] = {}
    built = _built(root)
    top = Folded(root.label, root.tag, root.noise)
    todo = [(top, [root])]
    while todo:
        out, group = todo.pop()
        for n in group:
            of[id(n)] = out
        texts: dict[str, list[Node]] = {}
        run: list[Node] = []
        for child in (c for n in group for c in n.children):
            if child.tag in TEXT_TAGS:
                into = texts.get(child.label)
                run = []
            else:
                into = run if run and run[0].label == child.label and built[id(run[0])] == built[id(child)] else None
            if into is None:
                into = [child]
                out.children.append(Folded(child.label, child.tag, child.noise))
                todo.append((out.children[-1], into))
                if child.tag in TEXT_TAGS:
                    texts[child.label] = into
                else:
                    run = into
            else:
                into.append(child)
    return top, of


def number(tree: Folded) -> list[Folded]:
    """Numbers the nodes in page order and returns them."""
    out: list[Folded] = []
    todo = [tree]
    while todo:
        n = todo.pop()
        n.number = len(out)
        out.append(n)
        todo += reversed(n.children)
    return out


def shape(tree: Folded) -> str:
    """The tree as text: depth, noise mark and label of each node, a line each."""
    out: list[str] = []
    todo = [(tree, 0)]
    while todo:
        n, depth = todo.pop()
        out.append(f"{depth} {int(n.noise)} {n.tag} {n.label}".replace("\n", " "))
        todo += [(c, depth + 1) for c in reversed(n.children)]
    return "\n".join(out)


class Recent:
    """Results by the texts they are of, as many as a bound of characters allows."""

    def __init__(self, make, chars: int = 4 << 20) -> None:
        self.make, self.chars, self.size = make, chars, 0
        self.known: OrderedDict[tuple, object] = OrderedDict()

    def __call__(self, *of):
        if of in self.known:
            self.known.move_to_end(of)
            return self.known[of]
        out = self.known[of] = self.make(*of)
        self.size += self._weight(of)
        while self.size > self.chars and len(self.known) > 1:
            self.size -= self._weight(self.known.popitem(last=False)[0])
        return out

    @staticmethod
    def _weight(of: tuple) -> int:
        return sum(len(x) * (1 if isinstance(x, str) else 32) for x in of)


def _tree_of(text: str) -> Folded:
    path: list[Folded] = []
    every: list[Folded] = []
    for line in text.split("\n"):
        depth, noise, tag, label = line.split(" ", 3)
        n = Folded(label, tag, noise == "1")
        every.append(n)
        del path[int(depth) :]
        if path:
            path[-1].children.append(n)
        path.append(n)
    number(path[0])
    for n in reversed(every):
        n.size = 1 + sum(c.size for c in n.children)
        n.built = xxhash.xxh3_64_intdigest("\n".join([n.label, *(str(c.built) for c in n.children)]))
    return path[0]


def _ends(a: list[Folded], b: list[Folded]) -> tuple[int, int]:
    """How many children at the beginning, and then at the end, of both lists are built alike."""
    n = min(len(a), len(b))
    low = next((k for k in range(n) if a[k].built != b[k].built), n)
    high = next((k for k in range(n - low) if a[-1 - k].built != b[-1 - k].built), n - low)
    return low, high


def _heaviest(weights: list[np.ndarray], left: list[int], right: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    """The greatest weight of pairs (i, k) that keep the order in both lists, and these pairs; i and k weigh weights[left[i]][right[k]].

    Of the table of best weights every so many rows are kept, and those between are made again on the way back: memory grows as n times the root of m.
    """
    m, n = len(left), len(right)

    def below(score: np.ndarray, i: int) -> np.ndarray:
        out = np.zeros(n + 1, np.int32)
        np.maximum.accumulate(np.maximum(score[1:], score[:-1] + weights[left[i]][right]), out=out[1:])
        return out

    step = isqrt(m) + 1
    score, kept = np.zeros(n + 1, np.int32), []
    for i in range(m):
        if i % step == 0:
            kept.append(score)
        score = below(score, i)
    pairs, k = [], n
    for first in range((m - 1) // step * step, -1, -step) if m else ():
        block = [kept[first // step]]
        for i in range(first, min(first + step, m)):
            block.append(below(block[-1], i))
        i = len(block) - 1
        while i and k:
            if block[i][k] == block[i - 1][k]:
                i -= 1
            elif block[i][k] == block[i][k - 1]:
                k -= 1
            else:
                pairs.append((first + i - 1, k - 1))
                i, k = i - 1, k - 1
    return int(score[n]), pairs


def _align(exemplar: str, page: str) -> dict[int, int]:
    """Simple tree matching of two folded trees: page node -> exemplar node, by number. Trees that are built alike match as they are.

    Lists of any length are matched by one rule, whose time grows with the product of the lengths. What two nodes have in
    common depends on how they are built alone, so like pairs are compared once.
    """
    a, b = tree_of(exemplar), tree_of(page)
    if a.label != b.label:
        return {}
    # pairs of like nodes below like parents; smaller ones are matched before those they are in
    pending, order, seen = [(a, b)], [], {(a.built, b.built)}
    while pending:
        x, y = pending.pop()
        if x.built == y.built:
            continue
        low, high = _ends(x.children, y.children)
        left, right = x.children[low : len(x.children) - high], y.children[low : len(y.children) - high]
        kinds = {c.built: c for c in left}
        like: dict[str, dict[int, Folded]] = defaultdict(dict)
        for d in right:
            like[d.label][d.built] = d
        order.append((x, y, low, high, left, right, kinds, like))
        for c in kinds.values():
            for d in like.get(c.label, {}).values():
                if (c.built, d.built) not in seen:
                    seen.add((c.built, d.built))
                    pending.append((c, d))
    best: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    for x, y, low, high, left, right, kinds, like in sorted(order, key=lambda pair: pair[0].size):
        number_of: dict[int, int] = {}
        own = np.array([number_of.setdefault(d.built, len(number_of)) for d in right], np.int64)
        weights, row_of = [], {}
        for c in kinds.values():
            row_of[c.built] = len(weights)
            weights.append(np.zeros(len(number_of), np.int32))
            for d in like.get(c.label, {}).values():
                weights[-1][number_of[d.built]] = c.size if c.built == d.built else best[c.built, d.built][0]
        most, pairs = _heaviest(weights, [row_of[c.built] for c in left], own)
        m, n = len(x.children), len(y.children)
        sure = [(k, k) for k in range(low)] + [(m - 1 - k, n - 1 - k) for k in range(high)]
        best[x.built, y.built] = (1 + sum(x.children[i].size for i, _ in sure) + most, sure + [(low + i, low + k) for i, k in pairs])
    out: dict[int, int] = {}
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        out[y.number] = x.number
        todo += zip(x.children, y.children, strict=True) if x.built == y.built else ((x.children[i], y.children[k]) for i, k in best[x.built, y.built][1])
    return out


tree_of, align = Recent(_tree_of), Recent(_align)


def read_page(source: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The page's folded tree as text, and its blocks: (folded node number, text)."""
    root, blocks = parse(source or "")
    tree, of = fold(root)
    number(tree)
    return shape(tree), [(of[id(n)].number, text) for n, text in blocks]


def _texts(blocks: list[tuple[int, str]], to: dict[int, int]) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for n, text in blocks:
        if n in to:
            out.setdefault(to[n], []).append(text)
    return out


#: A node is template if so large a share of at least so many pages have one text there.
SAME, PAGES = 0.95, 3


class Model:
    """What a host's pages say of its exemplar: the content node, and the template nodes below it."""

    def __init__(self, exemplar: str, stats: dict[int, tuple[int, int, int]]) -> None:
        """stats: node -> (pages with text there, pages with the commonest text, characters)."""
        root = tree_of(exemplar)
        mass: dict[int, int] = {}
        fixed = {k for k, (pages, top, _) in stats.items() if pages >= PAGES and top >= SAME * pages}

        every = [root]
        for n in every:  # parents first
            every += n.children
        for n in reversed(every):
            own = 0 if n.noise else sum(mass[c.number] for c in n.children)
            mass[n.number] = own + (0 if n.noise or n.number in fixed else stats.get(n.number, (0, 0, 0))[2])
        total = mass[root.number]
        self.content = root
        # the deepest container that holds nearly all varying text; an article or main element will do with most of it
        todo = [root]
        while todo:
            n = todo.pop()
            if n.noise or n.tag in TEXT_TAGS:
                continue
            if n.tag in ("article", "main") and 2 * mass[n.number] > total:
                self.content = n
                break
            if 5 * mass[n.number] >= 4 * total and total:
                self.content = n
            todo += n.children
        self.inside: set[int] = set()
        self.template: set[int] = set()
        todo = [self.content]
        while todo:
            n = todo.pop()
            if n.noise:
                continue
            self.inside.add(n.number)
            todo += n.children
        # what all pages of a host have is template, in an article too; but where one article makes up much of a host, its text would look constant
        varied = [stats[k] for k in self.inside if k in stats and k not in fixed]
        if any(2 * top < pages for pages, top, _ in varied):
            self.template = fixed & self.inside
            if self.content.tag in ("article", "main"):
                # paragraphs, headings and lists of an article may be alike by chance; a box of its own with nothing else isn't
                texts, slots = {n.number: 0 for n in every}, {n.number: 0 for n in every}
                for n in reversed(every):
                    texts[n.number] += n.number in stats
                    slots[n.number] += n.number in stats and n.number not in fixed
                    for c in n.children:
                        texts[n.number] += texts[c.number]
                        slots[n.number] += slots[c.number]
                self.template = {n.number for n in every if n.number in self.inside and n.tag not in TEXT_TAGS and texts[n.number] and not slots[n.number]}


_model = Recent(lambda exemplar, stats: Model(exemplar, {k: (a, b, c) for k, a, b, c in stats}))


def main_text(source: str | None, exemplar: str | None = None, stats: tuple = ()) -> str:
    page, blocks = read_page(source)
    if exemplar is not None:
        model, to = _model(exemplar, stats), align(exemplar, page)
        if model.content.number in to.values():
            # nodes that the exemplar lacks count as slots, below the content node and not marked as noise
            inside = set()
            todo = [(tree_of(page), False)]
            while todo:
                n, within = todo.pop()
                own = to.get(n.number)
                if n.noise or own in model.template:
                    continue
                within = within or own == model.content.number
                if within:
                    inside.add(n.number)
                todo += [(c, within) for c in n.children]
            return "\n".join(t for k, t in blocks if k in inside)
    own: dict[int, list[str]] = _texts(blocks, {n: n for n, _ in blocks})
    model = Model(page, {k: (1, 1, sum(map(len, v))) for k, v in own.items()})
    return "\n".join(t for k, t in blocks if k in model.inside)


def _host_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[tuple, list[int]] = {}

    def out() -> pd.DataFrame:
        return pd.DataFrame([(*k, *v) for k, v in held.items()], columns=["host", "node", "text", "pages", "chars"])

    for pdf in batches:
        for host, source, exemplar in zip(pdf["host"], pdf["html"], pdf["exemplar"], strict=True):
            page, blocks = read_page(source)
            for node, texts in _texts(blocks, align(exemplar, page)).items():
                joined = "\n".join(texts)
                own = held.setdefault((host, node, xxhash.xxh3_64_intdigest(joined) >> 1), [0, 0])
                own[0] += 1
                own[1] += len(joined)
        if len(held) > 100_000:
            yield out()
            held = {}
    if held:
        yield out()


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 4 << 20) -> DataFrame:
    """One row per input row: page_id, url, text (blocks joined by line breaks; empty if none).

    A null html counts as empty. Pages without a host in their URL, or without a URL, form one group. Repeated
    rows are each extracted; they count repeatedly in the host's statistics. Ties for a host's smallest
    id are broken by the tree's text. An empty table gives no rows. Other columns are ignored, whatever their names;
    pages may be of any length and depth.
    """
    spark = pages.sparkSession
    small_batches(spark)
    at = shared_dir(spark)
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    slim = slim.withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))))

    def small(df: DataFrame) -> DataFrame:
        size = df.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]
        return F.broadcast(df) if size <= broadcast_bytes else df

    first = saved(slim.groupBy(F.col("host").alias("of")).agg(F.min("page_id").alias("id")), f"{at}/first")

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"host": pdf["host"], "exemplar": [read_page(h)[0] for h in pdf["html"]]})

    lent = slim.join(small(first), F.col("page_id").eqNullSafe(F.col("id")) & (F.col("host") == F.col("of"))).select("host", "html")
    exemplars = lent.mapInPandas(shapes, "host string, exemplar string").groupBy("host").agg(F.min("exemplar").alias("exemplar"))
    exemplars = saved(exemplars, f"{at}/exemplars")

    counts = slim.join(small(exemplars), "host").select("host", "html", "exemplar").mapInPandas(_host_counts, "host string, node int, text long, pages long, chars long")
    counts = counts.groupBy("host", "node", "text").agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars"))
    nodes = counts.groupBy("host", "node").agg(F.sum("pages").alias("pages"), F.max("pages").alias("top"), F.sum("chars").alias("chars"))
    # as many entries as the exemplar has nodes
    stats = nodes.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("node", "pages", "top", "chars"))).alias("stats"))
    models = saved(exemplars.join(stats, "host", "left"), f"{at}/models")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple] = {}
        for pdf in batches:
            texts = []
            for host, source, exemplar, stats in zip(pdf["host"], pdf["html"], pdf["exemplar"], pdf["stats"], strict=True):
                if host not in known:
                    if len(known) > 256:
                        known.clear()
                    known[host] = tuple((s["node"], s["pages"], s["top"], s["chars"]) for s in stats) if stats is not None else ()
                texts.append(main_text(source, exemplar, known[host]))
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": texts})

    return slim.join(small(models), "host").select("page_id", "url", "host", "html", "exemplar", "stats").mapInPandas(run, "page_id long, url string, text string")
