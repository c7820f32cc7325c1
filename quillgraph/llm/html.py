"""Main-text extraction with a tree-structured graphical model.

A page becomes a tree of block elements; runs of text belong to the block they stand in.  Every node
is content or not.  Its own features give a potential for either, and each parent-child pair has a
potential for their joint state.  Sum-product messages, upward and then downward, give exact
marginals, and the text of nodes that are more likely content is the result.  The weights maximise
the likelihood of labelled pages, with the same messages supplying the expectations.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import map_batches, text_bytes

#: Labelled pages that the weights are learned from, and rounds of gradient ascent.
PAGES, ROUNDS = 240, 60

# Element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "template", "iframe", "title", "textarea", "select")
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body caption html tbody td tfoot th thead tr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",)}
GOOD = "article blog body content entry hentry main page post prose story text".split()
BAD = "ad ads advert advertisement banner bottom breadcrumb comment comments consent cookie disqus footer form header hidden menu meta modal nav navbar newsletter notice pagination popup promo recommended related reply respond share sidebar signup social sponsor sponsored subscribe tags toolbar top widget".split()

_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
#: The rest of a tag: a quote means something after an equals sign only.  Nothing is tried twice.
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*'|(?!["'])))*+>""")
_RAW_END = {name: re.compile(rf"</{name}\s*+>", re.IGNORECASE) for name in RAW}
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")
_LABEL = re.compile(r"data-content=\"(\d)\"")
_RIGHTS = re.compile(r"©|\(c\) |copyright|all rights", re.IGNORECASE)
_END = re.compile(r"[.!?…:;](?:\s|$)")

NAMES = ["bias", *(f"tag:{t}" for t in "article main p h heading-first li list blockquote pre table div section nav header footer aside form body other".split()), *(f"good:{g}" for g in GOOD), *(f"bad:{b}" for b in BAD), "under-bad", "under-good", "under-article", "marked-elsewhere", "no-marks", "no-marks-prose", "no-marks-links", "no-marks-first", "no-marks-last", "no-marks-deep", "copyright", "long", "longer", "links", "all-links", "sentences", "none", "list-of-links", "short", "hidden"]
_AT = {n: i for i, n in enumerate(NAMES)}
_KIND = {"article": "article", "main": "main", "p": "p", "#text": "p", "li": "li", "dd": "li", "dt": "li", "ul": "list", "ol": "list", "dl": "list", "menu": "nav", "blockquote": "blockquote", "pre": "pre", "table": "table", "tbody": "table", "tr": "table", "td": "table", "th": "table", "div": "div", "section": "section", "nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "dialog": "aside", "body": "body", "html": "body"} | {f"h{k}": "h" for k in range(1, 7)}


@dataclass
class Node:
    tag: str
    parent: int
    marks: frozenset = frozenset()
    hidden: bool = False
    label: int = 0
    chars: int = 0  # of text in the subtree, and of text in links there
    linked: int = 0
    ends: int = 0
    children: int = 0
    rights: bool = False  # a notice of copyright stands in its own text


@dataclass
class Page:
    """Nodes in page order (a parent before its children) and runs of text with their nodes."""

    nodes: list[Node] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)


def markup(source: str):
    """(text before, tag name, is an end, attributes) in page order, in time proportional to the page.

    Comments and declarations are left out, CDATA is text.  A tag whose quotes don't close before the page
    ends has no quotes; from there on no tag has.
    """
    at, n, quotes, kept = 0, len(source), True, 0
    while True:
        at = source.find("<", at)
        if at < 0 or at + 1 >= n:
            yield source[kept:], None, False, ""
            return
        c = source[at + 1]
        if c in "!?":
            before = source[kept:at]
            if source.startswith("<!--", at):
                end, skip = source.find("-->", at + 4), 3
            elif source.startswith("<![CDATA[", at):
                end, skip = source.find("]]>", at + 9), 3
                before += source[at + 9 : n if end < 0 else end].replace("&", "&amp;")
            else:
                end, skip = source.find(">", at), 1
            at = kept = n if end < 0 else end + skip
            yield before, None, False, ""
            continue
        m = _NAME.match(source, at + 1)
        if m is None:
            at += 1
            continue
        rest = _REST.match(source, m.end()) if quotes else None
        if rest is None:
            quotes = False
            end = source.find(">", m.end())
            if end < 0:  # no tag ends any more
                yield source[kept:], None, False, ""
                return
            end += 1
        else:
            end = rest.end()
        name = m[0].lower()
        yield source[kept:at], name.lstrip("/"), name[0] == "/", source[m.end() : end - 1]
        at = kept = end
        if name in _RAW_END and source[end - 2] != "/":
            closing = _RAW_END[name].search(source, end)
            at = kept = closing.end() if closing else n


def parse(source: str) -> Page:
    """Blocks and text of a page; markup that is not closed, or closed twice, is borne with."""
    page = Page([Node("html", -1)])
    nodes, stack = page.nodes, [("html", 0)]  # open elements and the block that each belongs to
    blocks, is_open = [0], Counter()  # places of blocks in the stack; open elements by name
    text: list[str] = []
    held, links = 0, 0

    def flush(block: int) -> None:
        nonlocal held
        if text:
            run = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if run:
                if nodes[block].tag in ("html", "body"):  # text in no block is a block of its own
                    nodes[block].children += 1
                    nodes.append(Node("#text", block, label=nodes[block].label))
                    block = len(nodes) - 1
                page.runs.append((block, run))
                node = nodes[block]
                node.chars += len(run)
                node.linked += min(held, len(run))
                node.ends += len(_END.findall(run))
                node.rights = node.rights or _RIGHTS.search(run) is not None
        held = 0

    def add(s: str) -> None:
        nonlocal held
        text.append(s)
        if links:
            held += len(s)

    def close(k: int) -> None:
        """Close the open elements from place k on."""
        nonlocal links
        for t, _ in stack[k:]:
            is_open[t] -= 1
            links -= t == "a"
        del stack[k:]
        while blocks[-1] >= k:
            blocks.pop()

    for before, name, ends, attributes in markup(source):
        if before:
            add(before)
        if name is None or name in RAW:
            continue
        if ends:
            if is_open[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                if blocks[-1] >= k:
                    flush(stack[-1][1])
                close(k)
            elif name in BLOCK:  # as browsers do, an end without a start still ends the line
                flush(stack[-1][1])
            continue
        if name in VOID:
            if name == "hr":
                flush(stack[-1][1])
            else:
                add(" " if name in ("br", "wbr", "img", "input") else "")
            continue
        if name == "html" or name == "head" or (name == "body" and is_open["body"]):
            continue
        closed = CLOSES.get(name, ())
        if name in CLOSES_P:
            closed = (*closed, "p")
        place = len(blocks) - 1  # only blocks are ever closed by a start
        while place > 0 and any(is_open[t] for t in closed):
            t = stack[blocks[place]][0]
            if t in closed:
                flush(stack[-1][1])
                close(blocks[place])
            elif t in SCOPE.get(name, ()) or name not in SCOPE:
                break
            place -= 1
        block = stack[-1][1]
        if name in BLOCK:
            flush(block)
            own = attributes.lower()
            marks = frozenset(p for x in _MARK.findall(attributes) for p in _PART.findall("".join(x).lower())) if "=" in own else frozenset()
            label = _LABEL.search(attributes)
            nodes.append(Node(name, block, marks, "hidden" in own or "display:none" in own.replace(" ", ""), int(label[1]) if label else nodes[block].label))
            nodes[block].children += 1
            block = len(nodes) - 1
            blocks.append(len(stack))
        elif name == "a":
            links += 1
        stack.append((name, block))
        is_open[name] += 1
    flush(stack[-1][1])
    for k in range(len(nodes) - 1, 0, -1):  # children hand their sums to their parents
        node, up = nodes[k], nodes[nodes[k].parent]
        up.chars += node.chars
        up.linked += node.linked
        up.ends += node.ends
    return page


_GOOD, _BAD = frozenset(GOOD), frozenset(BAD)
_BOILER = frozenset(("nav", "header", "footer", "aside", "form"))


def features(page: Page) -> list[list[tuple[int, float]]]:
    """Sparse features of each node.

    A page that marks its content nowhere (no article or main element, no telling class or id) is told by
    the look of its blocks: prose or links, first or last, depth.
    """
    out, above, first, depth = [], [], True, []
    marked = any(k.tag in ("article", "main") or (k.marks & _GOOD and not k.marks & _BAD and k.tag not in _BOILER and k.tag != "body") for k in page.nodes)
    count = len(page.nodes)
    for at, node in enumerate(page.nodes):
        depth.append(depth[node.parent] + 1 if node.parent >= 0 else 0)
        under_bad, under_good, in_article = above[node.parent] if node.parent >= 0 else (0, 0, 0)
        kind = _KIND.get(node.tag, "other")
        own = [(0, 1.0), (_AT[f"tag:{kind}"], 1.0)]
        if kind == "h" and first:
            own.append((_AT["tag:heading-first"], 1.0))
            first = False
        good, bad = node.marks & _GOOD, node.marks & _BAD
        own += [(_AT[f"good:{g}"], 1.0) for g in good] + [(_AT[f"bad:{b}"], 1.0) for b in bad]
        if under_bad:
            own.append((_AT["under-bad"], 1.0))
        if under_good:
            own.append((_AT["under-good"], 1.0))
        if in_article:
            own.append((_AT["under-article"], 1.0))
        if node.hidden:
            own.append((_AT["hidden"], 1.0))
        if node.rights:
            own.append((_AT["copyright"], 1.0))
        if marked and not (under_good or in_article or good or kind in ("article", "main")):
            own.append((_AT["marked-elsewhere"], 1.0))
        n, density = node.chars, node.linked / node.chars if node.chars else 0.0
        if not n:
            own.append((_AT["none"], 1.0))
        else:
            own += [(_AT["long"], min(math.log2(1 + n), 10) / 10), (_AT["longer"], float(n > 200)), (_AT["links"], density), (_AT["sentences"], min(node.ends, 3) / 3)]
            if density > 0.8:
                own.append((_AT["all-links"], 1.0))
                if kind in ("list", "li"):
                    own.append((_AT["list-of-links"], 1.0))
            if n < 30:
                own.append((_AT["short"], 1.0))
            if not marked:
                own += [(_AT["no-marks"], 1.0), (_AT["no-marks-links"], density), (_AT["no-marks-deep"], min(depth[at], 8) / 8)]
                if node.ends and density < 0.3:
                    own.append((_AT["no-marks-prose"], min(math.log2(1 + n), 10) / 10))
                if at < 0.15 * count:
                    own.append((_AT["no-marks-first"], 1.0))
                if at > 0.9 * count:
                    own.append((_AT["no-marks-last"], 1.0))
        out.append(own)
        above.append((under_bad or bool(bad and not good) or kind in _BOILER or node.hidden, under_good or bool(good and not bad), in_article or kind in ("article", "main")))
    return out


def _log_add(a: float, b: float) -> float:
    """The logarithm of exp(a) + exp(b)."""
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


@dataclass
class Model:
    """Weights of the features for "content", and the log potential of (parent, child) states."""

    weights: np.ndarray
    pair: np.ndarray

    def unary(self, page: Page) -> list[float]:
        w = self.weights.tolist()
        return [sum(w[k] * x for k, x in own) for own in features(page)]

    def marginals(self, page: Page) -> tuple[list[float], list[list[float]]]:
        """P(content) of each node, and joint marginals [00, 01, 10, 11] with its parent (root: none)."""
        nodes = page.nodes
        belief, up = self.unary(page), [0.0] * len(nodes)
        l00, l01, l10, l11 = self.pair.ravel().tolist()
        for k in range(len(nodes) - 1, 0, -1):
            e = belief[k]
            up[k] = _log_add(l11 + e, l10) - _log_add(l01 + e, l00)
            belief[nodes[k].parent] += up[k]
        joint = [[]]
        for k in range(1, len(nodes)):
            rest, own = belief[nodes[k].parent] - up[k], belief[k]  # the parent without this child
            belief[k] += _log_add(l11 + rest, l01) - _log_add(l10 + rest, l00)
            j = [l00, l01 + own, l10 + rest, l11 + rest + own]
            top = max(j)
            j = [math.exp(x - top) for x in j]
            z = sum(j)
            joint.append([x / z for x in j])
        return [1 / (1 + math.exp(-b)) if b > -700 else 0.0 for b in belief], joint

    def text(self, source: str) -> str:
        page = parse(source)
        p, _ = self.marginals(page)
        return "\n".join(run for k, run in page.runs if p[k] > 0.5)


def labelled_pages(n: int = PAGES, seed: int = 11) -> list[str]:
    """Pages of many layouts; the attribute data-content says which blocks are content.

    A third of them mark their content with no element, class or id that the features know.
    """
    rng = random.Random(seed)
    words = ["".join(rng.choices(["ta", "re", "no", "mi", "lo", "se", "ka", "du"], k=rng.randint(1, 4))) for _ in range(400)]
    say = lambda a, b: " ".join(rng.choices(words, k=rng.randint(a, b))).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])
    para = lambda: " ".join(say(4, 18) for _ in range(rng.randint(1, 6)))
    links = lambda k: "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in rng.choices(words, k=k)) + "</ul>"
    maybe = lambda p, s: s() if rng.random() < p else ""

    plain_class = lambda: rng.choice(["", "", f' class="{rng.choice(["wrap", "box", "col-left", "inner", "x1 s12", "container", "row", "layout"])}"', f' id="{rng.choice(words)}"'])

    def unmarked() -> str:
        own = content()
        put = rng.choice(["div", "div", "deep", "cell", "none", "none"])
        if put == "none":  # straight in the body: each block says for itself what it is
            depth, out = 0, []
            for piece in re.split(r"(<[^>]*>)", own):
                if re.match(r"<(?!/|b>|br>|input|a )[a-z]", piece):
                    if not depth and "data-content" not in piece:
                        piece = piece[:-1] + ' data-content="1">'
                    depth += not re.match(r"<p[ >]", piece)
                elif re.match(r"</(?!b>|a>|p>)", piece):
                    depth -= 1
                out.append(piece)
            main = "".join(out)
        else:
            open_, close_ = {"div": (f"<div{plain_class()}>", "</div>"), "deep": (f"<div{plain_class()}><div{plain_class()}><div>", "</div></div></div>"), "cell": ("<table><tr><td>", "</td></tr></table>")}[put]
            at = open_.rindex(">")
            main = open_[:at] + ' data-content="1">' + own + close_
        around = [
            maybe(0.5, lambda: rng.choice([f"<div{plain_class()}>{links(rng.randint(3, 8))}</div>", links(rng.randint(2, 6)), "<p>" + " | ".join(f'<a href="/{w}">{w}</a>' for w in rng.choices(words, k=rng.randint(3, 6))) + "</p>"])),
            main,
            maybe(0.2, lambda: f"<div{plain_class()}>{links(rng.randint(3, 8))}</div>"),
            maybe(0.5, lambda: rng.choice([f"<p>&copy; {rng.randint(1995, 2030)} {say(1, 8)}</p>", f"<div{plain_class()}>Copyright {say(1, 6)}{links(2)}</div>", f"<div{plain_class()}><p>(c) {say(2, 10)} All rights reserved.</p></div>"])),
        ]
        return "".join(around)

    def content() -> str:
        out = [f"<h1>{say(2, 9)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.randint(1, 12)):
            out.append(
                rng.choices(
                    [
                        lambda: f"<p>{para()}</p>",
                        lambda: f"<p>{para()}",
                        lambda: f"<p><b>{say(2, 8)}<br></p>",
                        lambda: f"<h2>{say(1, 6)}</h2>",
                        lambda: "<ul>" + "".join(f"<li>{say(2, 12)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>",
                        lambda: f"<blockquote><p>{para()}</p></blockquote>",
                        lambda: f"<pre>{say(3, 9)}</pre>",
                        lambda: f'<p>{say(3, 9)} <a href="/x">{say(1, 3)}</a> {say(3, 9)}</p>',
                        lambda: f"<table><tr><td>{say(1, 3)}</td><td>{say(1, 3)}</td></tr></table>",
                        lambda: f"<div>{para()}</div>",
                        lambda: f"<p>{rng.choice(words)}</p>",
                        lambda: f"<section><h3>{say(1, 5)}</h3><p>{para()}</p></section>",
                        lambda: f'<div class="{rng.choice(["ad", "ads", "advert banner", "sponsored", "promo"])}" data-content="0">{say(2, 15)}</div>',
                        lambda: f'<div class="{rng.choice(["share", "social", "related", "newsletter signup", "tags"])}" data-content="0">{say(1, 4)}{links(3)}</div>',
                        lambda: f'<form data-content="0"><p>{say(2, 6)}</p><input></form>',
                    ],
                    weights=[14, 5, 1, 3, 3, 2, 1, 3, 1, 2, 2, 1, 1, 1, 0.6],
                )[0]()
            )
        return "".join(out)

    def comments() -> str:
        each = lambda: f"<{t}><p>{para()}</p></{t}>"
        t = rng.choice(["li", "div", "article"])
        return f'<{(s := rng.choice(["section", "div", "ol"]))} {rng.choice(["id", "class"])}="{rng.choice(["comments", "comment list", "respond", "disqus comments"])}" data-content="0"><h2>{say(1, 2)}</h2>' + "".join(each() for _ in range(rng.randint(1, 5))) + f"</{s}>"

    out = []
    for k in range(n):
        if k % 3 == 2:
            out.append(f'<html><head><title>{say(2, 5)}</title></head><body data-content="0">{unmarked()}</body></html>')
            continue
        head, tail = rng.choice([("<article>", "</article>")] * 4 + [("<main><article>", "</article></main>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="post" class="entry">', "</div>"), ('<div id="main"><div class="article body">', "</div></div>"), ('<section class="story">', "</section>")])
        head = re.sub(r">", ' data-content="1">', head)
        inner = content()
        if rng.random() < 0.2:
            inner += comments()
        page = [
            maybe(0.3, lambda: f'<div class="{rng.choice(["cookie notice", "consent banner", "notice"])}">{para()}</div>'),
            maybe(0.5, lambda: f"<header><p>{say(1, 6)}</p>{maybe(0.5, lambda: '<h1>' + say(1, 3) + '</h1>')}</header>"),
            maybe(0.8, lambda: rng.choice([f"<nav>{links(rng.randint(2, 8))}</nav>", f'<div class="{rng.choice(["menu", "nav", "navbar top"])}">{links(5)}</div>', links(6)])),
            maybe(0.4, lambda: f'<div class="{rng.choice(["ad", "ads", "advert", "banner"])}">{say(2, 20)}</div>'),
            maybe(0.3, lambda: f'<{(t := rng.choice(["aside", "div"]))} class="{rng.choice(["sidebar", "widget", "related"])}"><h3>{say(1, 3)}</h3><p>{para()}</p>{links(4)}</{t}>'),
            head + inner + tail,
            maybe(0.25, comments),
            maybe(0.3, lambda: f"<aside><p>{para()}</p>{links(3)}</aside>"),
            maybe(0.2, lambda: f"<form><p>{say(2, 8)}</p><input><button>{rng.choice(words)}</button></form>"),
            maybe(0.8, lambda: rng.choice([f"<footer>&copy; {say(2, 25)}</footer>", f'<div class="footer bottom">{say(2, 14)}{links(3)}</div>', f"<footer><p>{para()}</p></footer>"])),
        ]
        out.append(f'<!DOCTYPE html><html><head><title>{say(2, 5)}</title><style>p{{margin:0}}</style></head><body data-content="0">{"".join(page)}</body></html>')
    return out


def train(pages: list[str] | None = None) -> Model:
    """Maximum likelihood on labelled pages, with a Gaussian prior on the weights."""
    trees = [parse(p) for p in (labelled_pages() if pages is None else pages)]
    rows = [features(t) for t in trees]
    y = [np.array([k.label for k in t.nodes]) for t in trees]
    m = Model(np.zeros(len(NAMES)), np.zeros((2, 2)))
    seen_pair = np.zeros((2, 2))
    for t, lab in zip(trees, y, strict=True):
        for k in range(1, len(t.nodes)):
            seen_pair[lab[t.nodes[k].parent], lab[k]] += 1
    total = sum(len(t.nodes) for t in trees)
    node = np.array([i for t, r in enumerate(rows) for i, own in enumerate(r) for _ in own])
    base = np.cumsum([0, *(len(r) for r in rows)])
    node = node + np.repeat(base[:-1], [sum(len(own) for own in r) for r in rows])
    col = np.array([k for r in rows for own in r for k, _ in own])
    val = np.array([x for r in rows for own in r for _, x in own])
    gold = np.concatenate(y)
    moments = [np.zeros(len(NAMES)), np.zeros(len(NAMES)), np.zeros((2, 2)), np.zeros((2, 2))]
    for t in range(1, ROUNDS + 1):
        p, pair = [], np.zeros(4)
        for tree in trees:
            own, joint = m.marginals(tree)
            p += own
            pair += np.array(joint[1:]).sum(0) if len(joint) > 1 else 0
        g = [np.bincount(col, weights=val * (gold - np.array(p))[node], minlength=len(NAMES)) / total - 1e-4 * m.weights, (seen_pair - pair.reshape(2, 2)) / total - 1e-4 * m.pair]
        for i, (x, name) in enumerate(zip(g, ("weights", "pair"), strict=True)):
            moments[2 * i] = 0.9 * moments[2 * i] + 0.1 * x
            moments[2 * i + 1] = 0.99 * moments[2 * i + 1] + 0.01 * x * x
            setattr(m, name, getattr(m, name) + 0.25 * (moments[2 * i] / (1 - 0.9**t)) / (np.sqrt(moments[2 * i + 1] / (1 - 0.99**t)) + 1e-9))
    return m


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """Per row: page_id, url, text (empty if the page has none), n_chars in code points.

    A null html counts as empty.  Repeated rows stay; an empty table gives an empty result; other columns
    are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        text = [shared.value.text(raw.decode("utf-8", "replace")) for raw in text_bytes(b, "html")]
        return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return map_batches(rows, kernel, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars bigint", "html")


def op8(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), train())
