"""Main-text extraction by a tree-structured graphical model.

A page becomes a tree: block elements are inner nodes, runs of inline content are leaves.  Each node is
content or not; its features (tag, name tokens, length, link share) give its own potential and each
parent-child edge couples the two.  One sum-product pass upward and one downward give exact marginals; the
leaves at half or more are the text.  Training ascends the likelihood with the same two passes.

Labelled pages: a seeded set of pages composed here from parts whose role is known, and at most TRAIN_PAGES
pages of the table, the first in an order hashed from the id, each page of an id once, that mark their article
themselves (article or main elements; navigation, asides, headers, footers and forms inside are not content).
The names of page parts in NOT_CONTENT serve the composer alone: what a name tells, the model has to learn.
Every page is then read whole.

Nulls: a null page is an empty one; its text is empty.  White space is what str.split() takes as such; br is
white space inside its block.  Repeated rows get equal texts.  An empty table gives an empty result.
"""

from __future__ import annotations

import html as html_
import random
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from terrane.llm.common import bounded_sample, random_key, table

TRAIN_PAGES, COMPOSED, EPOCHS, RATE, RIDGE, SEED = 150, 500, 44, 0.1, 1e-3, "extraction-1:"

# HTML's void, raw-text and inline elements, elements that end an open one of a kind, and names of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript title textarea select iframe svg canvas audio video object head".split())
UNPARSED = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in "script style title textarea iframe".split()}  # only the end tag counts inside
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output progress q ruby s samp small span strike strong sub sup time tt u var button".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol dl table body html div article section main".split())
ASIDE = frozenset("nav aside header footer form".split())
NOT_CONTENT = frozenset("nav aside footer header form menu sidebar widget navbar breadcrumb breadcrumbs ad ads advert advertisement banner promo sponsored sponsor cookie cookies consent notice alert newsletter subscribe popup modal comments comment respond reply replies discussion share sharing social related recommended tags pagination pager copyright legal masthead toolbar login search footnote disclaimer".split())
GOLD, DROSS = "zzgold", "zzdross"  # mark the parts of composed pages
CONTENT = "content post entry article story text body main".split()
NEUTRAL = "wrap wrapper container row col column page inner outer site block box section left center grid layout clearfix".split()

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+")


class Tree:
    """Nodes of a page in page order, a parent before its children; leaves carry text."""

    __slots__ = ("features", "leaf_of", "parent", "texts", "words")

    def __init__(self) -> None:
        self.parent: list[int] = [-1]
        self.features: list[list[str]] = [["tag=page"]]
        self.texts: list[str] = []
        self.leaf_of: list[int] = []
        self.words: list[int] = []


@cache
def _sized(n: int) -> str:
    return "words=%d" % next((k for k in (1, 2, 4, 8, 16, 32, 64) if n <= k), 99)


def _names(attributes: str) -> list[str]:
    return sorted({"name=" + t for m in NAMES.finditer(attributes) for t in PART.findall((m[1] or m[2] or m[3] or "").lower())})


def parse(html: str) -> Tree:
    tree = Tree()
    stack: list[tuple[str, int]] = [("page", 0)]  # open elements and their nodes; an inline element has the node of its block
    tags = {0: "page"}  # of the nodes of blocks
    is_open: Counter[str] = Counter()
    run: list[str] = []
    linked = 0
    raw, depth = "", 0  # the element that hides what is in it, and how many of its kind are open

    def flush() -> None:
        nonlocal linked, run
        text = " ".join("".join(run).split()) if run else ""
        run = []
        if text:
            node = stack[-1][1]
            n = text.count(" ") + 1
            share = min(1.0, linked / n)
            last = text[-1]
            tree.parent.append(node)
            tree.features.append(["leaf", "in=" + tags[node], _sized(n), "links=%d" % round(3 * share), "end=" + ("stop" if last in ".!?…:\"”" else "other"), "mark" if "©" in text else "plain"])
            tree.texts.append(text)
            tree.leaf_of.append(len(tree.parent) - 1)
            tree.words.append(n)
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html_.unescape(piece) if "&" in piece else piece
            run.append(piece)
            if is_open["a"]:
                linked += len(piece.split())

    def push(name: str, node: int) -> None:
        stack.append((name, node))
        is_open[name] += 1

    def pop(depth: int) -> None:
        is_open.subtract(t for t, _ in stack[depth:])
        del stack[depth:]

    at = 0
    while m := TOKEN.search(html, at):
        if not raw:
            add(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name, closing = name.lower(), m[1]
        if raw:
            if name == raw:
                depth += -1 if closing else not m[3].endswith("/")
                raw = raw if depth else ""
            continue
        if name in VOID:
            if name == "br":
                run.append(" ")
            elif name == "hr":
                flush()
            continue
        if closing:
            if is_open[name] and name not in RAW:
                k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name)
                if name not in INLINE:
                    flush()
                pop(k)
            continue
        if name in RAW:
            if name == "head" or m[3].endswith("/"):
                continue  # what a head may hold is void or hidden itself
            if name in UNPARSED:
                end = UNPARSED[name].search(html, at)
                at = end.end() if end else len(html)
            else:
                raw, depth = name, 1
            continue
        if name in INLINE:
            push(name, stack[-1][1])
            continue
        flush()
        enders = ENDS.get(name, ())
        if is_open["p"] or any(is_open[e] for e in enders):
            for k in range(len(stack) - 1, 0, -1):
                tag = stack[k][0]
                if tag == "p" or tag in enders:
                    pop(k)
                    break
                if tag in HOLDS and tag not in enders:
                    break
        while stack[-1][0] in INLINE:  # an inline element left open ends with its block
            pop(len(stack) - 1)
        tree.parent.append(stack[-1][1])
        tree.features.append(["tag=" + name, *(_names(m[3]) if m[3] else ())])
        push(name, len(tree.parent) - 1)
        tags[stack[-1][1]] = name
    if not raw:
        add(html[at:])
    flush()
    total = sum(tree.words)
    for node, n in zip(tree.leaf_of, tree.words, strict=True):
        tree.features[node].append("part=%d" % min(5, (total // n).bit_length()))  # its share of the page's words
    tree.features[0].append("article=yes" if {"article", "main"} & set(tags.values()) else "article=no")
    return tree


class Model:
    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.edge = np.zeros((2, 2, 2))  # leaf or not, parent, child


def _potentials(model: Model, tree: Tree) -> tuple[list[float], list[tuple[float, ...]]]:
    get = model.weights.get
    own = np.exp(np.clip([sum(get(f, 0.0) for f in fs) for fs in tree.features], -30, 30)).tolist()
    edges = [tuple(e.ravel().tolist()) for e in np.exp(model.edge)]
    return own, [edges[fs[0] == "leaf"] for fs in tree.features]


def marginals(model: Model, tree: Tree) -> list[float]:
    """P(content) of each node."""
    up, edge = _potentials(model, tree)
    parent, n = tree.parent, len(tree.parent)
    message = [1.0] * n
    for k in range(n - 1, 0, -1):
        e00, e01, e10, e11 = edge[k]
        a = up[k]
        message[k] = r = (e10 + e11 * a) / (e00 + e01 * a)
        up[parent[k]] = min(1e30, max(1e-30, up[parent[k]] * r))
    odds = up[:]
    for k in range(1, n):
        e00, e01, e10, e11 = edge[k]
        c = odds[parent[k]] / message[k]
        odds[k] = min(1e30, max(1e-30, up[k] * (e01 + e11 * c) / (e00 + e10 * c)))
    return [x / (1 + x) for x in odds]


def content(model: Model, html: str | None) -> str:
    """The main text of one page: its content leaves in page order, one to a line."""
    if not html:
        return ""
    tree = parse(html)
    if not tree.texts:
        return ""
    p = marginals(model, tree)
    return "\n".join(t for t, k in zip(tree.texts, tree.leaf_of, strict=True) if p[k] >= 0.5)


def _states(tree: Tree, starts, stops) -> list[int]:
    """1 for a node inside a part with a feature that starts content and in none with one that stops it."""
    state = [0] * len(tree.parent)
    for k in range(1, len(tree.parent)):
        state[k] = state[tree.parent[k]]
        if stops.intersection(tree.features[k]):
            state[k] = -1
        elif starts.intersection(tree.features[k]) and state[k] >= 0:
            state[k] = 1
    return [int(x > 0) for x in state]


def self_marked(tree: Tree) -> list[int] | None:
    """Labels of the nodes of a page that marks its article; None if it doesn't."""
    labels = _states(tree, {"tag=article", "tag=main"}, {"tag=" + t for t in ASIDE})
    return labels if any(labels) else None


def composed_trees(n: int, seed: int = 1) -> list[tuple[Tree, list[int]]]:
    """Trees of composed pages with the labels of their nodes; the marks that tell them are taken away."""
    out = []
    for page, _ in composed(n, seed):
        tree = parse(page)
        marks = {"name=" + GOLD}, {"name=" + DROSS}
        labels = _states(tree, *marks)
        labels[0] = labels[1]  # a page of which all is text, but for what is marked otherwise
        tree.features = [[f for f in fs if f not in marks[0] | marks[1]] for fs in tree.features]
        out.append((tree, labels))
    return out


def composed(n: int, seed: int = 1) -> list[tuple[str, list[bool]]]:
    """Labelled pages made of parts whose role is known, with the label of each leaf in page order."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("aeioubcdlmnrst", k=rng.randrange(1, 9)))
    line = lambda a, b: " ".join(word() for _ in range(rng.randrange(a, b)))
    sentence = lambda: (line(4, 25).capitalize() + rng.choice([".", ".", ".", "!", "?"]))
    text = lambda: " ".join(sentence() for _ in range(rng.randrange(1, 7)))
    name = lambda names: rng.choice(["class", "class", "id"]) + '="' + rng.choice(["", "", "site-", "page-", "main-"]) + rng.choice(names) + rng.choice(["", "", "-box", "-list", "-wrap"]) + '"'
    link = lambda: f'<a href="/{word()}">{line(1, 4)}</a>'
    plain = lambda: rng.choice(["", "", f' class="{rng.choice(NEUTRAL)}"', f' id="{rng.choice(NEUTRAL)}-{word()}"', f' class="{word()} {word()}"'])
    held = lambda inner: f"<{(tag := rng.choice(['div', 'div', 'section']))}{plain()}>{inner}</{tag}>" if rng.random() < 0.4 else inner
    spoiled = sorted(NOT_CONTENT - ASIDE)
    torn = lambda: f'class="{rng.choice(CONTENT)}-{rng.choice(spoiled)}"'  # a name that says both

    def boiler() -> tuple[str, int]:
        part, k = plain_boiler()
        return re.sub(r"^<(\w+)", rf"<\1 role={DROSS}", part), k

    def plain_boiler() -> tuple[str, int]:
        kind = rng.choice([*range(8), rng.randrange(9)])
        if kind == 8:
            k = rng.randrange(1, 6)
            return f"<div {torn()}>{''.join(f'<span>{link()}</span> ' for _ in range(k))}</div>", 1
        if kind == 0:
            k = rng.randrange(2, 9)
            tag = rng.choice(["nav", f"div {name(['menu', 'navbar', 'breadcrumb'])}"])
            return f"<{tag}><ul>{''.join(f'<li>{link()}</li>' for _ in range(k))}</ul></{tag.split()[0]}>", k
        if kind == 1:
            return f"<footer>&copy; {line(1, 5)} {rng.choice([sentence(), link()])}</footer>", 1
        if kind == 2:
            return f"<header><h1>{line(1, 5)}</h1><p>{line(2, 9)}</p></header>" if rng.random() < 0.5 else f'<header class="masthead"><div>{line(1, 5)}</div><p>{text()}</p></header>', 2
        if kind == 3:
            k = rng.randrange(1, 5)
            return f"<aside><h3>{line(1, 4)}</h3>{''.join(rng.choice([f'<p>{text()}</p>', f'<div>{link()}</div>']) for _ in range(k))}</aside>", k + 1
        if kind == 4:
            return f"<form {name(['search', 'login', 'newsletter', 'subscribe'])}><p>{rng.choice([line(2, 8), sentence()])}</p><label>{line(1, 3)}</label><button>{word()}</button></form>", 2
        if kind == 5:
            k = rng.randrange(1, 6)
            tag = rng.choice(["div", "section", "ol", "ul"])
            inner = "".join(f'<{"li" if tag in ("ol", "ul") else "div"} class="comment"><p>{text()}</p></{"li" if tag in ("ol", "ul") else "div"}>' for _ in range(k))
            return f"<{tag} {name(['comments', 'replies', 'discussion'])}>{inner}</{tag}>", k
        if kind == 6:
            k = rng.randrange(1, 4)
            return f"<div {name(spoiled)}>{''.join(f'<p>{rng.choice([text(), sentence(), line(2, 12)])}</p>' for _ in range(k))}</div>", k
        return f"<div {name(spoiled)}>{rng.choice([text(), sentence(), line(1, 12)])}</div>", 1

    def article(tag: str) -> tuple[str, list[bool]]:
        parts, labels = [f"<h1>{line(2, 10)}</h1>"] if rng.random() < 0.8 else [], []
        labels += [True] * len(parts)
        for _ in range(rng.randrange(1, 12)):
            x = rng.random()
            if x < 0.50:
                body = rng.choice([text(), text(), sentence(), line(1, 9), f"{text()} {link()} {text()}", link(), f"{text()} &copy; {line(1, 5)}"])
                parts.append(held(rng.choice([f"<p>{body}</p>", f"<p{plain()}>{body}</p>", f"<p><b>{body}<br>{line(1, 9)}", f"<div{plain()}>{body}</div>"])))
                labels.append(True)
            elif x < 0.58:
                parts.append(f"<h2>{line(1, 8)}</h2>")
                labels.append(True)
            elif x < 0.66:
                k = rng.randrange(1, 5)
                parts.append("<ul>" + "".join(f"<li>{rng.choice([line(1, 9), sentence()])}</li>" for _ in range(k)) + "</ul>")
                labels += [True] * k
            elif x < 0.71:
                parts.append(rng.choice([f"<blockquote>{text()}</blockquote>", f"<pre>{line(2, 20)}</pre>", f"<table><tr><td>{line(1, 5)}</td></tr></table>"]))
                labels.append(True)
            else:
                b, k = boiler()
                parts.append(b)
                labels += [False] * k
        return f"<{tag} role={GOLD}>{''.join(parts)}</{tag.split()[0]}>", labels

    def around(bare: bool) -> tuple[str, list[bool]]:
        found = [boiler() for _ in range(rng.randrange(4) if not bare or rng.random() < 0.5 else 0)]
        return "".join(part for part, _ in found), [False] * sum(k for _, k in found)

    marked = lambda: rng.choice(["article", "article", "main", f"div {name(CONTENT)}", f"section {name(CONTENT)}", f"div {torn()}", f"div {torn()}"])
    pages = []
    for _ in range(n):
        bare = rng.random() < 0.35  # nothing tells where the text starts: its parts lie among the others
        (before, y0), (after, y2) = around(bare), around(bare)
        inner, y1 = article(f"div{plain()}" if bare or rng.random() < 0.25 else marked())
        if bare:
            inner = re.sub(r"^<[^>]*>|</\w+>$", "", inner)
        body = held(held(before + inner + after))
        pages.append((f"<html{f' role={GOLD}' if bare else ''}><head><title>{line(1, 6)}</title></head><body>{body}</body></html>", y0 + y1 + y2))
    return pages


class Forest:
    """Labelled trees side by side, so that messages of one depth are passed at once."""

    def __init__(self, labelled: list[tuple[Tree, list[int]]], at: dict[str, int]):
        size = np.array([len(tree.parent) for tree, _ in labelled], dtype=np.int64)
        base = np.cumsum(size) - size
        self.label = np.array([y for _, labels in labelled for y in labels], dtype=float)
        self.parent = np.concatenate([np.where(np.array(tree.parent) < 0, -1, np.array(tree.parent) + b) for (tree, _), b in zip(labelled, base.tolist(), strict=True)])
        nodes = [fs for tree, _ in labelled for fs in tree.features]
        self.leaf = np.array([int(fs[0] == "leaf") for fs in nodes])
        pairs = [(at[f], k) for k, fs in enumerate(nodes) for f in fs if f in at]
        self.feature, self.of = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
        depth = np.zeros(len(nodes), dtype=np.int64)
        for k, q in enumerate(self.parent.tolist()):
            if q >= 0:
                depth[k] = depth[q] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max(initial=0)) + 1)]

    def marginals(self, weights: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and the expected number of (parent, child) states over the edges of either kind."""
        up = np.clip(np.bincount(self.of, weights[self.feature], len(self.leaf)), -30, 30)
        e = np.exp(edge)[self.leaf]
        message, without, parent = np.zeros(len(up)), np.zeros(len(up)), self.parent
        for level in reversed(self.levels):
            a, x = np.exp(up[level]), e[level]
            message[level] = np.log((x[:, 1, 0] + x[:, 1, 1] * a) / (x[:, 0, 0] + x[:, 0, 1] * a))
            up = np.clip(up + np.bincount(parent[level], message[level], len(up)), -69, 69)
        odds = up.copy()
        for level in self.levels:
            without[level] = odds[parent[level]] - message[level]
            c, x = np.exp(without[level]), e[level]
            odds[level] = np.clip(up[level] + np.log((x[:, 0, 1] + x[:, 1, 1] * c) / (x[:, 0, 0] + x[:, 1, 0] * c)), -69, 69)
        inner = parent >= 0
        a, c = np.exp(up[inner]), np.exp(without[inner])
        joint = e[inner] * np.stack((np.stack((np.ones(len(a)), a), axis=-1), np.stack((c, a * c), axis=-1)), axis=1)
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        return 1 / (1 + np.exp(-odds)), np.stack([joint[self.leaf[inner] == kind].sum(axis=0) for kind in (0, 1)])

    def seen(self) -> np.ndarray:
        """The number of (parent, child) states over the edges of either kind, as labelled."""
        out, inner = np.zeros((2, 2, 2)), self.parent >= 0
        np.add.at(out, (self.leaf[inner], self.label[self.parent[inner]].astype(int), self.label[inner].astype(int)), 1)
        return out


def train(labelled: list[tuple[Tree, list[int]]]) -> Model:
    """Likelihood ascent (Adam, one step an epoch and eighth of the pages) over labelled trees."""
    model = Model()
    known = Counter(f for tree, _ in labelled for f in {f for fs in tree.features for f in fs})
    names = sorted(f for f, n in known.items() if n > 1)
    at = {f: i for i, f in enumerate(names)}
    forests = [Forest(part, at) for k in range(8) if (part := labelled[k::8])]
    size = len(names) + 8
    w, m, v, step = np.zeros(size), np.zeros(size), np.zeros(size), 0
    w[len(names) :] = np.tile([1.0, -1.0, -1.0, 1.0], 2)
    for _ in range(EPOCHS):
        for forest in forests:
            p, moves = forest.marginals(w[: len(names)], w[len(names) :].reshape(2, 2, 2))
            rest = np.bincount(forest.feature, (forest.label - p)[forest.of], len(names))
            grad = np.concatenate((rest, (forest.seen() - moves).ravel())) / (1 + len(p)) - RIDGE * w / len(names)
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            w = w + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weights, model.edge = dict(zip(names, w.tolist(), strict=False)), w[len(names) :].reshape(2, 2, 2)
    return model


def fit(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> Model:
    """The model from composed pages and those of a bounded sample of the table that mark their article."""
    rows = pages.where("html IS NOT NULL").select(F.col("page_id").alias("_id"), "html")
    keyed = rows.select("_id", random_key(SEED, F.col("_id")).alias("_key")).orderBy("_key", "_id").limit(train_pages).distinct()
    sample = sorted(r.html for r in bounded_sample(rows.where("_id IS NOT NULL"), "html", keyed, train_pages).select("html").collect())
    trees = [(tree, y) for tree in map(parse, sample) if (y := self_marked(tree)) is not None]
    return train(trees + composed_trees(COMPOSED))


def extracted(pages: DataFrame, model: Model) -> DataFrame:
    """pages with text, the main text."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(StringType())
    def run(html: pa.Array) -> pa.Array:
        return pa.array([content(shared.value, x) for x in html.to_pylist()], pa.string())

    return pages.withColumn("text", run(F.col("html")))


def op5_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = extracted(pages, fit(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
