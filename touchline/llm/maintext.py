"""Operator 7: the main text of web pages by a minimum cut.

A page becomes a list of text blocks. A classifier gives each block two costs: of calling it content and of calling it
boilerplate. Those costs are the capacities to the two terminals of a graph; blocks that follow one another, and blocks
under one parent, are tied by edges whose capacities fall with their distance in the tree. The maximum flow's cut is the
cheapest labelling.

The classifier is a logistic regression over hashed traits: the words of classes and ids around a block, its tag, length,
share of links and last mark. No table labels blocks, so it learns from pages that say themselves what is what: of a
bounded sample, blocks inside article or main elements are content, those outside, in navigation, asides, footers or
forms, or on several pages alike are not. It starts from a prior, a vocabulary of usual class names and plain weights, and
learns what to add to it without seeing the elements that its labels come from; these speak for themselves in the end. A
table without such pages is labelled by the prior.

Null or empty html gives an empty text. Repeated rows and extra columns pass through. A page without any block of text
gives an empty text. Nothing is cut short: pages are read to their last character, closed tags or not. An empty table
gives no rows.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import FTRL
from .shared import table

#: An attribute as browsers read it: a quote delimits only directly after the "=".
ATTRIBUTE = r"(?:=[^\s/>=]*|[^\s/>=]+)(?:\s*=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s\"'>][^\s>]*)?)?"
#: A comment, a declaration, or a tag with its attributes; a "<" that starts none of them is text.
MARK = re.compile(rf"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]+|{ATTRIBUTE})*+)(?:>|\Z)", re.S)
#: One attribute's name and value.
NAMED = re.compile(r"(=[^\s/>=]*|[^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>][^\s>]*))?)?")
WORD = re.compile(r"[A-Za-z]+")
BLANK = re.compile(r"\s+")
#: Their contents are not text of the page.
SILENT = frozenset("script style noscript template svg iframe object head title textarea select option button datalist canvas audio video".split())
#: Of those, the ones whose contents are not markup either.
RAW = frozenset("script style textarea title iframe noscript".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul legend caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the key ends an open element of the values.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset("ul ol dl table article section div body nav aside footer header main form".split())
#: What a container's tag says about its text: positive is content.
TAG_SAYS = {"article": 4.0, "main": 2.5, "nav": -7.0, "footer": -6.0, "header": -3.5, "aside": -6.0, "form": -6.0, "menu": -6.0, "dialog": -6.0, "fieldset": -4.0}
GOOD = frozenset("article content main post entry story body text prose".split())
BAD = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promoted promotion sponsor sponsored menu nav navbar navigation breadcrumb breadcrumbs"
    " footer header masthead sidebar side aside widget cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup login"
    " share sharing social related recommended recommendations comment comments reply replies respondents discussion disqus toolbar pager pagination search alert toast"
    " copyright legal tags taglist outbrain taboola".split()
)
HEADINGS = frozenset(("h1", "h2", "h3"))
SHARED_PARENT, NEXT_BLOCK = 1.2, 0.8
#: Elements that say what their text is, by their definition.
CONTENT, OTHER = frozenset(("article", "main")), frozenset(("nav", "footer", "aside", "form", "menu", "dialog"))
#: Pages learnt from at most, drawn by a hash; pages that a text is on to be boilerplate; hash buckets of traits.
LEARN_FROM, ALIKE, BUCKETS = 2_000, 3, 1 << 14
EPOCHS = 2


class Node:
    """An open element, with what its own and its ancestors' tags and names say."""

    __slots__ = ("tag", "parent", "depth", "says", "bad", "silent", "link", "total", "tags", "good", "inside", "marks")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.inside = 1 if tag in CONTENT else -1 if tag in OTHER else parent.inside if parent else 0
        self.marks: tuple[str, ...] = ()
        own = 0.0 if tag == "header" and parent and parent.inside > 0 else TAG_SAYS.get(tag, 0.0)
        self.says = own
        self.silent = tag in SILENT or bool(parent and parent.silent)
        self.link = tag == "a" or bool(parent and parent.link)
        if attributes:
            self.read(attributes)
        self.bad = bool(parent and parent.bad) or self.says <= -3.0
        self.good = bool(parent and parent.good) or self.says >= 1.5
        self.tags = (parent.tags if parent else 0.0) + own
        self.total = (parent.total if parent else 0.0) + self.says

    def chain(self) -> Iterator[Node]:
        x: Node | None = self
        while x:
            yield x
            x = x.parent

    def read(self, attributes: str) -> None:
        for m in NAMED.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                self.silent = True
            elif name in ("class", "id", "role", "aria-label") and self.tag not in ("html", "body"):
                found = set(WORD.findall(value))
                self.marks += tuple(sorted(found))
                if found & BAD:
                    self.says = min(self.says, 0.0) - 5.0
                elif found & GOOD:
                    self.says += 1.5


class Block:
    __slots__ = ("node", "text", "linked", "size")

    def __init__(self, node: Node, text: str, linked: int, size: int):
        self.node, self.text, self.linked, self.size = node, text, linked, size


def blocks(page: str) -> list[Block]:
    """The runs of text between the ends of block elements, in page order."""
    out: list[Block] = []
    root = at = Node("", None)
    owner = root
    parts: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = BLANK.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                out.append(Block(owner, text, linked, sum(map(len, parts))))
            parts.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal owner, linked
        if not text or at.silent:
            return
        if not parts:
            if text.isspace():
                return
            owner = at
            while owner.parent and owner.tag not in BLOCKS:
                owner = owner.parent
        parts.append(text)
        if at.link:
            linked += len(text)

    here, n = 0, len(page)
    while here < n:
        m = MARK.search(page, here)
        if not m:
            take(page[here:])
            break
        take(page[here : m.start()])
        here = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                take(" ")
                continue
            x: Node | None = at
            while x and x.tag != tag and not (tag not in BLOCKS and x.tag in BLOCKS):
                x = x.parent
            if tag in BLOCKS or x and x.tag == tag and tag in BLOCKS:
                close()
            if x and x.parent and x.tag == tag:
                at = x.parent
            continue
        if tag in BLOCKS:
            close()
            if at.tag == "p" or at.tag not in BLOCKS:
                x = at  # a block ends an open paragraph with all that is open inside it
                while x.parent and x.tag not in BLOCKS:
                    x = x.parent
                if x.tag == "p" and x.parent:
                    at = x.parent
            if ends := ENDS.get(tag):
                x = at
                while x and x.tag not in ends and x.tag not in SCOPES:
                    x = x.parent
                if x and x.tag in ends and x.parent:
                    at = x.parent
        if tag in VOID:
            if tag == "br":
                take(" ")
            continue
        if (m[3] or "").rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        at = Node(tag, at, m[3] or "")
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, here)
            here = end.end() if end else n
            at = at.parent or root
    close()
    return out


def prior(b: Block) -> float:
    """How much a block looks like content before anything is learnt, in nats."""
    score, good = b.node.total, b.node.good
    words = b.text.count(" ") + 1
    share = b.linked / max(1, b.size)
    score -= 4.0 * share if words < 60 else 2.0 * share
    score += 0.5 if b.node.tag in HEADINGS and good else 0.0
    if words >= 25:
        score += 1.5
    elif words >= 10:
        score += 0.7
    elif not good:
        score -= 0.4
    if b.text[-1] in ".!?…\"”'":
        score += 0.4
    if b.node.tag in ("p", "blockquote", "pre", "h1", "h2", "h3"):
        score += 0.6
    if b.text[0] == "©" or "all rights reserved" in b.text.lower():
        score -= 4.0
    return score


def traits(b: Block) -> np.ndarray:
    """Buckets of what is learnt from: nothing that says article, main, navigation or the like."""
    words = b.text.count(" ") + 1
    found = {f"words {words.bit_length()}", f"links {4 * b.linked // max(1, b.size)}", f"tag {b.node.tag if b.node.inside >= 0 or b.node.tag not in OTHER else ''}", f"ends {b.text[-1] if not b.text[-1].isalnum() else 'a'}"}
    for x in b.node.chain():
        found.update(f"name {m}" for m in x.marks)
    return np.unique(np.array([zlib.crc32(f.encode()) % BUCKETS for f in found], np.int32))


def own_label(b: Block, said: bool) -> int | None:
    """What a page's own elements say of a block, if they do."""
    if b.node.inside < 0:
        return 0
    return int(b.node.inside > 0) if said else None


def leaning(b: Block, weights: np.ndarray | None = None) -> float:
    """The classifier: how much a block looks like content, in nats."""
    learnt = 0.0 if weights is None else float(weights[traits(b)].sum() + weights[-1])
    return max(-8.0, min(8.0, prior(b) + learnt))


def ties(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between blocks next to one another and between successive blocks of one parent."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        parent = b.node.parent or b.node
        if i:
            a = found[i - 1]
            apart = a.node.bad != b.node.bad
            out.append((i - 1, i, NEXT_BLOCK / (1 + steps(a.node, b.node)) * (0.1 if apart else 1.0)))
        if (j := last.get(id(parent))) is not None:
            out.append((j, i, SHARED_PARENT if b.node.bad == found[j].node.bad else 0.1))
        last[id(parent)] = i
    return out


def steps(a: Node, b: Node, most: int = 12) -> int:
    """Steps in the tree from one element to another, `most` if there are more."""
    n = 0
    while a is not b and n < most:
        if a.depth >= b.depth and a.parent:
            a = a.parent
        else:
            b = b.parent or b
        n += 1
    return n


def minimum_cut(lean: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side. Node i holds lean[i] to the source if positive, to the sink if negative. Flow is pushed along shortest paths, all of one length at a time (Dinic, 1970)."""
    n = len(lean)
    left, free = [max(0.0, x) for x in lean], [max(0.0, -x) for x in lean]
    near: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[float] = []
    for a, b, c in edges:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += (b, a)
        room += (c, c)
    tiny = 1e-9
    while True:
        level = [0 if x > tiny else -1 for x in left]
        todo, end, k = [i for i in range(n) if level[i] == 0], n + 1, 0
        while k < len(todo):
            x = todo[k]
            k += 1
            if level[x] >= end:
                break
            if free[x] > tiny:
                end = level[x]
                continue
            for e in near[x]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    todo.append(to[e])
        if end > n:
            return [x >= 0 for x in level]
        turn = [0] * n
        for start in range(n):
            while level[start] == 0 and left[start] > tiny:
                path, x = [], start
                while free[x] <= tiny or level[x] != end:
                    edges_of = near[x]
                    while turn[x] < len(edges_of) and not (room[edges_of[turn[x]]] > tiny and level[to[edges_of[turn[x]]]] == level[x] + 1 <= end):
                        turn[x] += 1
                    if turn[x] < len(edges_of):
                        path.append(edges_of[turn[x]])
                        x = to[path[-1]]
                    elif path:
                        x = to[path.pop() ^ 1]
                        turn[x] += 1
                    else:
                        break
                if free[x] <= tiny or level[x] != end:
                    break
                flow = min([left[start], free[x], *(room[e] for e in path)])
                left[start] -= flow
                free[x] -= flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow


def main_text(page: str | None, weights: np.ndarray | None = None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    kept = minimum_cut([leaning(b, weights) for b in found], ties(found))
    return "\n".join(b.text for b, yes in zip(found, kept) if yes)


def fit(df: DataFrame, html: str = "html", learn_from: int = LEARN_FROM) -> np.ndarray | None:
    """Weights of the traits, learnt from at most about `learn_from` pages; None if none of these says what its blocks are."""
    share = learn_from / max(1, df.count())
    drawn = df.select(html) if share >= 1 else df.select(html).where(F.pmod(F.xxhash64(html), F.lit(1_000_000)) < int(share * 1_000_000))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for page in batch.column(0):
                found = blocks(page.as_py() or "")
                said = any(b.node.inside > 0 for b in found)
                for b in found:
                    out.append((zlib.crc32(b.text.encode()), traits(b).tobytes(), prior(b) - b.node.tags, own_label(b, said)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.float64(), pa.int32()))], names=["text", "at", "base", "label"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((at, base, text, label) for b in batches for text, at, base, label in zip(*(c.to_pylist() for c in b.columns)) if label is not None)
        times = Counter(text for _, _, text, _ in found)
        model = FTRL(BUCKETS, alpha=0.1, l1=0.5)
        dice = np.random.default_rng(7)
        for _ in range(EPOCHS):
            for i in dice.permutation(len(found)):
                at, base, text, label = found[i]
                at = np.append(np.frombuffer(at, np.int32), BUCKETS)
                model.learn(at, np.ones(len(at)), 0 if times[text] >= ALIKE else label, offset=base)
        if found:
            yield pa.RecordBatch.from_pydict({"weights": [model.weights().astype(np.float32).tobytes()]})

    got = drawn.mapInArrow(rows, "text long, at binary, base double, label int").repartition(1).mapInArrow(learn, "weights binary").collect()
    return np.frombuffer(got[0]["weights"], np.float32) if got else None


def extract(df: DataFrame, html: str = "html", text: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """Replace the html column by the main text; other columns stay, but for one that bears the text's name."""
    names = [c for c in df.columns if c not in (html, text)]
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(batch.schema.get_field_index(html))
            for i in range(0, len(batch), 256):
                made = pa.array([main_text(p.as_py(), weights) for p in pages.slice(i, 256)], pa.string())
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(n)) for n in names] + [made], names=[*names, text])

    return df.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, weights=fit(pages)).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
