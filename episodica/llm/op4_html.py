"""Main text of HTML pages by a tree-structured graphical model.

A page becomes a tree of block elements whose leaves are runs of inline text. Every node has a hidden label, content or
not; its own features give a node potential and each parent-child edge a potential for equal labels. Sum-product messages,
once up and once down the tree, give exact marginals; the text runs that are more likely content make up the main text.
The potentials are learned from labelled pages, which ``labelled_pages`` writes from layout rules.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the model is trained on.
TRAINING_PAGES = 240
# Element names of HTML.
DROPPED = frozenset("script style noscript template textarea select svg annotation annotation-xml iframe object canvas audio video head title button".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BLOCKS = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 header footer nav aside form fieldset ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption details summary address dialog menu hr".split())
VOID = frozenset("br hr img input meta link area base col embed param source track wbr".split())
#: An opening element ends an open element of the second set, up to the third.
ENDS = {
    **{t: (frozenset(["p"]), frozenset(["td", "th", "button", "table"])) for t in BLOCKS - frozenset(["html", "body", "tr", "td", "th", "thead", "tbody", "tfoot", "caption"])},
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}
#: Elements of a head; any other ends it.
HEAD = frozenset("base link meta title style script noscript template basefont bgsound noframes head".split())
#: An end tag does not reach out of these; one of a part of a table only not out of the second.
SCOPE, TABLE_SCOPE = frozenset("applet caption table td th marquee object template select".split()), frozenset(["table", "template"])
TABLE_PARTS = frozenset("table tbody thead tfoot tr td th caption".split())
#: Elements that end an open drawing.
NOT_DRAWN = frozenset("blockquote body dd div dl dt h1 h2 h3 h4 h5 h6 head hr li menu ol p pre table ul".split())
# What class, id and role names say, by kind.
NAMES = {
    "content": "article content post entry story main body text prose copy richtext",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip tabs",
    "header": "header masthead topbar banner branding logo hero",
    "footer": "footer foot copyright legal colophon imprint bottom",
    "advert": "ad ads adv advert advertisement sponsor sponsored promo promotion dfp banner",
    "side": "sidebar side aside widget widgets rail related recommended recommendations more popular trending",
    "comment": "comment comments discussion respond reply replies disqus reader readers",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay warning message",
    "form": "form newsletter subscribe signup login search contact",
    "share": "share sharing social tags meta byline author date toolbar",
}
KINDS = list(NAMES)
_KIND_OF: dict[str, list[int]] = {}
for _k, _names in enumerate(NAMES.values()):
    for _n in _names.split():
        _KIND_OF.setdefault(_n, []).append(_k)
TAGS = ["article", "main", "section", "div", "p", "heading", "li", "list", "nav", "header", "footer", "aside", "form", "table", "quote", "figure", "root", "text"]
_TAG_OF = {
    **{t: t for t in ("article", "main", "section", "div", "p", "li", "nav", "header", "footer", "aside", "form")},
    **{f"h{i}": "heading" for i in range(1, 7)}, **{t: "list" for t in ("ul", "ol", "dl", "menu")}, "dt": "li", "dd": "li", "fieldset": "form",
    **{t: "table" for t in ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption")}, "blockquote": "quote", "pre": "quote",
    "figure": "figure", "figcaption": "figure", "html": "root", "body": "root", "dialog": "aside", "details": "div", "summary": "p", "address": "footer"}
_TAG_INDEX = {t: i for i, t in enumerate(TAGS)}
_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_LABELS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_MAY_HIDE = re.compile(r"hidden|display", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")
_MARK = re.compile(r"data-label\s*=\s*\"([01])\"")
#: Elements whose name is passed down to everything inside them.
_PASSED = {t: i for i, t in enumerate(("article", "main", "nav", "header", "footer", "aside", "form"))}
_OWN, _ABOVE, _ABOVE_TAG = len(TAGS), len(TAGS) + len(KINDS), len(TAGS) + 2 * len(KINDS)
_VALUES = _ABOVE_TAG + len(_PASSED)
N_FEATURES = _VALUES + 7


def hides(attributes: str) -> bool:
    """Whether an element is hidden by its attributes; values of other attributes say nothing."""
    if not _MAY_HIDE.search(attributes):
        return False
    for found in _ATTRIBUTE.finditer(attributes):
        name, value = found.group(1).lower(), html.unescape(found.group(2) or found.group(3) or found.group(4) or "")
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and _NO_DISPLAY.search(value)):
            return True
    return False


class Page:
    """The tree of one page: parallel lists over nodes in page order, so every parent comes before its children."""

    def __init__(self, source: str, marked: bool = False):
        self.parent, self.tag, self.kinds, self.text, self.linked, self.marks = [-1], ["root"], [()], [None], [0], [None]
        self.marked = marked
        self._read(source)

    def _node(self, parent: int, tag: str, kinds: tuple[int, ...] = (), text: str | None = None, linked: int = 0, mark: str | None = None) -> int:
        for column, value in ((self.parent, parent), (self.tag, tag), (self.kinds, kinds), (self.text, text), (self.linked, linked), (self.marks, mark)):
            column.append(value)
        return len(self.parent) - 1

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("root", 0)]
        run: list[str] = []
        linked = links = 0
        hidden: list[str] = []  # open elements inside a dropped one
        at, size, lower = 0, len(source), None

        def flush() -> None:
            nonlocal linked
            text = _SPACE.sub(" ", html.unescape("".join(run))).strip() if run else ""
            if text:
                self._node(stack[-1][1], "text", text=text, linked=min(linked, len(text)))
            run.clear()
            linked = 0

        def imply(name: str) -> None:
            """Open elements that an opening one ends."""
            ended, until = ENDS.get(name, ((), ()))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ended:
                    del stack[k:]
                    break
                if stack[k][0] in until:
                    break

        def reveal(name: str) -> None:
            """The same for elements inside a dropped one, which may end itself."""
            if "head" in hidden and (name in ("body", "html") or (hidden[-1] == "head" and name not in HEAD)):
                hidden.clear()
                return
            drawn = next((k for k in range(len(hidden) - 1, -1, -1) if hidden[k] in ("svg", "foreignobject")), None)
            if drawn is not None and hidden[drawn] == "svg" and name in NOT_DRAWN:
                del hidden[drawn:]
            ended, until = ENDS.get(name, ((), ()))
            for k in range(len(hidden) - 1, -1, -1):
                if hidden[k] in ended:
                    del hidden[k:]
                    return
                if hidden[k] in until or hidden[k] in (TABLE_SCOPE if name in TABLE_PARTS else SCOPE):
                    return
            for above, _ in reversed(stack):
                if above in ended:
                    hidden.clear()
                if above in ended or above in until:
                    return

        while at < size:
            found = _MARKUP.search(source, at)
            end = found.start() if found else size
            if hidden == ["head"] and source[at:end].strip():
                hidden.clear()
            if end > at and not hidden:
                run.append(source[at:end])
                linked += (end - at) * (links > 0)
            if not found:
                break
            at = found.end()
            name = found.group(2)
            if name is None:
                continue
            name = name.lower()
            if found.group(1):
                if name in hidden:
                    del hidden[len(hidden) - 1 - hidden[::-1].index(name):]
                    continue
                if hidden and name in BLOCKS and any(t == name for t, _ in stack) and not (TABLE_SCOPE if name in TABLE_PARTS else SCOPE).intersection(hidden):
                    hidden.clear()  # the end of a parent
                if hidden:
                    continue
                if name == "a":
                    links = max(0, links - 1)
                elif name in BLOCKS and any(t == name for t, _ in stack):
                    flush()
                    while stack.pop()[0] != name:
                        pass
                continue
            attributes = found.group(3)
            if name in VOID:
                if not hidden:
                    run.append(" ")
                    if name == "hr":
                        flush()
                continue
            if hidden:
                reveal(name)
            closed = attributes.endswith("/") and name not in BLOCKS
            if name in RAW and not closed:  # everything up to the end tag is no markup
                lower = source.lower() if lower is None else lower
                stop = lower.find("</" + name, at)
                at = size if stop < 0 else stop
                if not hidden:
                    hidden.append(name)
                continue
            if hidden:
                if name not in VOID and not closed:
                    hidden.append(name)
                continue
            if name in DROPPED or (attributes and hides(attributes)):
                flush()
                if name in BLOCKS:
                    imply(name)
                if not closed:
                    hidden.append(name)
                continue
            if name == "a":
                links += 1
            elif name in BLOCKS:
                flush()
                links = 0
                imply(name)
                kinds: tuple[int, ...] = ()
                if attributes:
                    words = " ".join("".join(m) for m in _LABELS.findall(attributes)).lower()
                    kinds = tuple({k for w in _PART.findall(words) for k in _KIND_OF.get(w, ())}) if words else ()
                mark = _MARK.search(attributes) if self.marked and attributes else None
                stack.append((name, self._node(stack[-1][1], _TAG_OF.get(name, "div"), kinds, mark=mark.group(1) if mark else None)))
        flush()

    def features(self) -> list[tuple[list[int], tuple[float, ...]]]:
        """Per node: the yes-or-no features it has, and the values of the others."""
        n = len(self.parent)
        length, linked = [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            if self.text[i] is not None:
                length[i], linked[i] = len(self.text[i]), self.linked[i]
            length[self.parent[i]] += length[i]
            linked[self.parent[i]] += linked[i]
        whole = math.log1p(length[0]) or 1.0
        above: list[frozenset[int]] = [frozenset()] * n
        out = []
        for i in range(n):
            tag, kinds, text = self.tag[i], self.kinds[i], self.text[i]
            has = above[self.parent[i]] if i else above[0]
            own = [_TAG_INDEX[tag], *[_OWN + k for k in kinds], *has]
            if kinds or tag in _PASSED:
                has = has.union([_ABOVE + k for k in kinds], [_ABOVE_TAG + _PASSED[tag]] if tag in _PASSED else [])
            above[i] = has
            size = length[i]
            stops, ended = (min(text.count(".") + text.count(","), 5) / 5, float(text[-1] in ".!?:;")) if text is not None else (0.0, 0.0)
            out.append((own, (min(math.log1p(size) / 7, 1.0), linked[i] / size if size else 0.0, float(size < 25), stops, ended, math.log1p(size) / whole, 1.0)))
        return out

    def edges(self) -> list[int]:
        """Kind of the edge to the parent: below the page itself, to a text run, or between blocks."""
        return [0 if self.tag[p] == "root" else 1 if self.text[i] is not None else 2 for i, p in enumerate(self.parent)]


def marginals(parent: list[int], node: list[float], edge: list[float]) -> list[float]:
    """Probability of label 1 at each node: sum-product up and down the tree in log-odds.

    ``node`` holds the log-odds of the node potentials, ``edge`` the log-potential of labels equal to the parent's.
    """
    def through(x: float, e: float) -> float:  # log-odds of a node, as seen across an edge
        x = math.exp(max(-200.0, min(200.0, x)))
        same, other = math.exp(e), math.exp(-e)
        return math.log((same * x + other) / (other * x + same))

    n = len(parent)
    full, sent = list(node), [0.0] * n
    for i in range(n - 1, 0, -1):
        sent[i] = through(full[i], edge[i])
        full[parent[i]] += sent[i]
    for i in range(1, n):
        full[i] += through(full[parent[i]] - sent[i], edge[i])
    return [1 / (1 + math.exp(-max(-200.0, min(200.0, x)))) for x in full]


def labels_of(page: Page) -> np.ndarray:
    """Labels of a training page: a text run takes the nearest mark above it, a block the label of most of its text."""
    n = len(page.parent)
    mark, weight = [0] * n, np.zeros((n, 2))
    for i in range(1, n):
        mark[i] = int(page.marks[i]) if page.marks[i] is not None else mark[page.parent[i]]
    for i in range(n - 1, 0, -1):
        if page.text[i] is not None:
            weight[i, mark[i]] += len(page.text[i])
        weight[page.parent[i]] += weight[i]
    return np.where(weight.sum(1) > 0, weight[:, 1] > weight[:, 0], np.array(mark) == 1).astype(int)


def _filler(rng: random.Random, words: int) -> str:
    out = ["".join(rng.choice(("ba", "re", "ti", "on", "al", "en", "st", "ou", "li", "ka", "mo", "ze")) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    for i in range(len(out)):
        if rng.random() < 0.1 or i == len(out) - 1:
            out[i] += rng.choice((".", ".", ",", "!"))
    return " ".join(out)


def labelled_pages(count: int = TRAINING_PAGES, seed: int = 5) -> Iterator[str]:
    """Pages of random layouts; ``data-label`` says whether an element's text is content."""
    rng = random.Random(seed)

    def links(n: int) -> str:
        return "".join(f'<li><a href="#">{_filler(rng, rng.randint(1, 3))}</a></li>' for _ in range(n))

    def some(low: int, high: int) -> str:
        return _filler(rng, rng.randint(low, high))

    def name(kind: str) -> str:
        return rng.choice(("class", "class", "id")) + '="' + rng.choice(NAMES[kind].split()) + rng.choice(("", "", "-box", "-wrap", " x1")) + '"'

    def clutter(kind: str) -> str:
        body = {
            "menu": lambda: f"<ul>{links(rng.randint(3, 8))}</ul>", "header": lambda: f"<a href='/'>{some(1, 3)}</a><p>{some(2, 8)}</p>",
            "footer": lambda: f"&copy; {some(2, 6)} &middot; {some(4, 30)}", "advert": lambda: rng.choice((some(5, 20), f"<p>{some(5, 25)}</p>")),
            "side": lambda: f"<h3>{some(1, 3)}</h3><ul>{links(rng.randint(2, 6))}</ul><p>{some(4, 25)}</p>",
            "comment": lambda: "".join(f"<div><b>{some(1, 2)}</b><p>{some(5, 60)}</p></div>" for _ in range(rng.randint(1, 5))),
            "notice": lambda: f"<p>{some(6, 30)}</p><a href='#'>{some(1, 2)}</a>",
            "form": lambda: f"<label>{some(1, 5)}</label><input type=text><p>{some(2, 12)}</p>", "share": lambda: f"<ul>{links(rng.randint(2, 5))}</ul>",
        }[kind]()
        tag = {"menu": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "footer", "div"), "advert": ("div", "aside"), "side": ("aside", "div"),
               "comment": ("section", "div", "ol"), "notice": ("div", "section"), "form": ("form", "form", "div"), "share": ("div",)}[kind]
        chosen = rng.choice(tag)
        bare = chosen in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.6
        return f'<{chosen} {"" if bare else name(kind)} data-label="0">{body}</{chosen}>'

    for _ in range(count):
        parts = []
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.72:
                parts.append(rng.choice(("<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<div>{}</div>")).format(some(3, 120)))
            elif kind < 0.84:
                parts.append(rng.choice(("<h2>{}</h2>", "<h3>{}</h3>")).format(some(1, 7)))
            elif kind < 0.9:
                parts.append("<ul>" + "".join(f"<li>{some(2, 20)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.95:
                parts.append(f"<blockquote>{some(8, 40)}</blockquote>")
            else:
                parts.append("<table>" + "".join(f"<tr><td>{some(1, 5)}</td><td>{some(1, 8)}</td></tr>" for _ in range(rng.randint(2, 4))) + "</table>")
        if rng.random() < 0.85:
            parts.insert(0, f"<h1>{some(3, 14)}</h1>")
        for kind in ("advert", "share", "side", "form", "notice"):
            if rng.random() < 0.15:
                parts.insert(rng.randint(0, len(parts)), clutter(kind))
        tag, attribute = rng.choice((("article", ""), ("article", ""), ("main", ""), ("div", name("content")), ("section", name("content")), ("div", "")))
        body = f'<{tag} {attribute} data-label="1">{"".join(parts)}</{tag}>'
        if rng.random() < 0.3:
            body = f"<div>{body}</div>"
        before = [clutter(k) for k in ("notice", "header", "menu", "advert", "form", "side") if rng.random() < 0.5]
        after = [clutter(k) for k in ("share", "comment", "side", "advert", "form", "footer", "notice") if rng.random() < 0.5]
        rng.shuffle(before)
        yield f'<html><head><title>{some(2, 8)}</title></head><body data-label="0">{"".join(before)}{body}{"".join(after)}</body></html>'


Weights = tuple[list[float], list[float]]


@cache
def train(count: int = TRAINING_PAGES) -> Weights:
    """Piecewise training: node potentials by logistic regression on all nodes, an edge potential of each kind from how
    often its two labels agree (halved, since neighbours share some of the same evidence)."""
    rows, answers = [], []
    agree, edges = np.ones(3), np.full(3, 2.0)
    for source in labelled_pages(count):
        page = Page(source, marked=True)
        y, kinds = labels_of(page), page.edges()
        x = np.zeros((len(y), N_FEATURES))
        for i, (own, values) in enumerate(page.features()):
            x[i, own] = 1.0
            x[i, _VALUES:] = values
            if i:
                edges[kinds[i]] += 1
                agree[kinds[i]] += y[i] == y[page.parent[i]]
        rows.append(x)
        answers.append(y)
    x, y = np.concatenate(rows), np.concatenate(answers)
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * 0.3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist(), (np.log(agree / (edges - agree)) / 4).tolist()


def content_odds(page: Page, weights: Weights) -> list[float]:
    """Marginal probability of content at each node."""
    w, edge = weights
    node = [sum([w[k] for k in own]) + sum([w[_VALUES + k] * v for k, v in enumerate(values)]) for own, values in page.features()]
    return marginals(page.parent, node, [edge[k] for k in page.edges()])


def main_text(source: str | None, weights: Weights) -> str:
    """Blocks that are more likely content than not, in page order, joined by a space."""
    page = Page(source or "")
    return " ".join(text for text, q in zip(page.text, content_odds(page, weights)) if text is not None and q > 0.5)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = train()
    for batch in batches:
        texts = [main_text(x, weights) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row: the main text of the whole page.

    Null or empty html, and pages without content, give an empty text. Broken markup is read as far as it goes. Repeated
    rows are treated alike; an empty table gives no rows; other columns are not read.
    """
    rows = pages.select("page_id", "url", "html")
    schema = rows.select("page_id", "url", F.lit("").alias("text")).schema
    return rows.mapInArrow(_extract, schema).withColumn("n_chars", F.length("text").cast("bigint"))
