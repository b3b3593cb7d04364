"""Main text of web pages: a linear-chain conditional random field over the DOM's leaf blocks.

A page becomes its sequence of text blocks, each with the tags, roles and class words of its ancestors and
the look of its text. A two-label chain (main text or not) scores blocks and their neighbours together and
is decoded by Viterbi.

The chain is trained on labelled pages: layouts whose parts are known by construction, filled with block
texts of a bounded sample of the pages at hand. Layouts vary in what holds the main text, so the model does
not lean on one tag, and put every kind of part that is not main text before, after and inside it.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.llm.toxicity import thinned

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"(?:^|[\s\"'])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"']|$)", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
# Elements of the HTML standard, by how they are read.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template textarea title".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output progress q rp rt ruby "
    "s samp small span strike strong sub sup time tt u var wbr object canvas audio video noscript "
    "math semantics annotation mrow mi mn mo ms mtext mfrac msqrt mroot msup msub msubsup mover munder munderover mstyle mtable mtr mtd".split())
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}
_CLOSED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody"},
              "th": {"td", "th", "tr", "tbody"}, "option": {"option", "optgroup"}}
# Words in class names, ids and roles, by the part of a page they speak of.
_KINDS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager skip tabs topbar",
    "head": "header masthead banner logo site brand tagline",
    "foot": "footer colophon copyright legal contentinfo bottom",
    "side": "sidebar side aside complementary widget related recommended recommendations trending popular more rail teaser",
    "ad": "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner dfp commercial",
    "note": "notice cookie cookies consent alert gdpr privacy popup modal overlay toast message warning paywall",
    "form": "form subscribe subscription newsletter signup login search register contact poll survey",
    "talk": "comment comments commentlist reply replies respond discussion disqus thread responses feedback review reviews",
    "share": "share sharing social follow buttons tools toolbar author byline meta tags tag",
    "main": "article content main post entry story body text prose page copy articlebody maincontent",
}
_KIND = {w: k for k, words in _KINDS.items() for w in words.split()}


class _Reader:
    """Pieces of markup, found forwards only: what one search has passed over is not searched again."""

    def __init__(self, page: str):
        self.page, self.quoted, self.missing = page, True, set()
        self.last = {mark: page.rfind(mark) for mark in (">", '"', "'")}

    def _find(self, mark: str, at: int) -> int:
        """The next place of the mark, or -1; a mark that is not there is looked for once."""
        if mark in self.missing:
            return -1
        found = self.page.find(mark, at)
        if found < 0:
            self.missing.add(mark)
        return found

    def _tag_end(self, at: int) -> int:
        """The > that ends a tag, outside quotes that are closed; where none does, quotes count no more."""
        place = at
        while self.quoted:
            m = _STOP.search(self.page, place)
            if m is None:
                self.quoted = False
            elif m.group() == ">":
                return m.start()
            else:
                place = m.end()
                if place <= self.last[m.group()]:
                    place = self.page.find(m.group(), place) + 1
        return self._find(">", at)

    def __iter__(self):
        """(kind, value, attributes): text, cdata, start and end; comments and declarations are passed over."""
        page, at = self.page, 0
        while at < len(page):
            if page[at] != "<":
                end = page.find("<", at)
                end = len(page) if end < 0 else end
                yield "text", page[at:end], ""
                at = end
                continue
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = len(page) if end < 0 else end + 3
                continue
            if page.startswith("<![CDATA[", at) and (end := self._find("]]>", at + 9)) >= 0:
                yield "cdata", page[at + 9 : end], ""
                at = end + 3
                continue
            if page[at + 1 : at + 2] in ("!", "?"):
                end = page.find(">", at)
                at = len(page) if end < 0 else end + 1
                continue
            m = _NAME.match(page, at) if at < self.last[">"] else None
            end = self._tag_end(m.end()) if m else -1
            if end < 0:
                yield "text", "<", ""
                at += 1
                continue
            tag, closing = m.group(1).lower(), page[at + 1] == "/"
            yield "end" if closing else "start", tag, page[m.end() : end]
            at = end + 1
            if tag in _RAW and not closing and tag not in self.missing:
                found = _RAW_END[tag].search(page, at)
                if found:
                    at = found.end()
                elif tag == "template":
                    self.missing.add(tag)
                else:
                    at = len(page)


class _Open:
    """Open elements, and how often each of their features is there."""

    def __init__(self, known):
        self.known, self.tags, self.own, self.solid = known, [], [], []
        self.places: dict[str, list[int]] = {}
        self.features: dict[str, int] = {}

    def push(self, tag: str, features: tuple[str, ...]) -> None:
        if self.known is not None:
            features = tuple(f for f in features if f in self.known)
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag not in _INLINE:
            self.solid.append(len(self.tags))
        self.tags.append(tag)
        self.own.append(features)
        for f in features:
            self.features[f] = self.features.get(f, 0) + 1

    def close(self, depth: int) -> None:
        while len(self.tags) > depth:
            tag = self.tags.pop()
            self.places[tag].pop()
            if self.solid and self.solid[-1] == len(self.tags):
                self.solid.pop()
            for f in self.own.pop():
                self.features[f] -= 1
                if not self.features[f]:
                    del self.features[f]


def blocks(page: str | None, known=None) -> list[tuple[str, list[str]]]:
    """(text, features) of every leaf block with text, in page order.

    Scripts, styles, templates, text areas and titles have no text. Character references are decoded; white
    space becomes one space. Text outside any element is a block too. `known`, if given, holds the features
    of ancestors that are wanted. Time grows with the page's length, however broken its markup.
    """
    out, text, linked = [], [], 0
    there = _Open(known)

    def flush():
        nonlocal text, linked
        joined = " ".join("".join(text).split())
        if joined:
            out.append((joined, list(there.features), linked, there.tags[-1] if there.tags else ""))
        text, linked = [], 0

    for kind, value, attributes in _Reader(page or ""):
        if kind in ("text", "cdata"):
            piece = html.unescape(value) if kind == "text" else value
            text.append(piece)
            if there.places.get("a"):
                linked += len(piece.strip())
        elif kind == "end":
            if value not in _INLINE:
                flush()
            if there.places.get(value):
                there.close(there.places[value][-1])
        elif value in ("br", "hr") or value in _RAW:
            text.append(" ")
        elif value not in _VOID:
            if value not in _INLINE:
                flush()
                nearest = there.solid[-1] if there.solid else None
                ends = _CLOSED_BY.get(there.tags[nearest], ()) if nearest is not None else ()
                if ends is None or value in ends:
                    there.close(nearest)
            there.push(value, _ancestor(value, attributes))
    flush()
    return [(t, _described(t, own, a, last, i, len(out))) for i, (t, own, a, last) in enumerate(out)]


def _ancestor(tag: str, attributes: str) -> tuple[str, ...]:
    own = [] if tag in _INLINE - {"a", "label"} else [f"tag={tag}"]
    if attributes:
        for name, a, b, c in _ATTR.findall(attributes):
            value, name = a or b or c, name.lower()
            if name in ("class", "id", "role"):
                words = {w.lower() for w in _PART.findall(value)} | {value.lower()}
                own += [f"is={_KIND[w]}" for w in words if w in _KIND] + [f"word={w}" for w in words if w.isalpha()]
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                own.append("hidden")
    return tuple(own)


def _described(text: str, ancestors: list[str], linked: int, tag: str, i: int, n: int) -> list[str]:
    words = text.count(" ") + 1
    size = len(text)
    out = list(dict.fromkeys(ancestors))
    out += [f"last={tag}", f"words={min(7, words.bit_length())}", f"links={min(3, 4 * linked // max(1, size))}", f"end={text[-1] if text[-1] in '.!?:,;' else 'a'}"]
    if "©" in text:
        out.append("copyright")
    if i == 0 or i == n - 1:
        out.append("first" if i == 0 else "final")
    return out


class Chain:
    """Two-label linear chain: weights of (feature, label 1 against 0), of label pairs, of the first label."""

    def __init__(self, weights: dict[str, float], bias: float, pair: np.ndarray, first: np.ndarray):
        self.weights, self.bias, self.pair, self.first = weights, bias, pair, first

    def viterbi(self, features: list[list[str]]) -> list[int]:
        """Best label sequence; ties go to label 1."""
        if not features:
            return []
        get, pair = self.weights.get, self.pair.tolist()
        a = b = 0.0
        back = []
        for i, own in enumerate(features):
            u = self.bias + sum(get(f, 0.0) for f in own)
            if i == 0:
                a, b = float(self.first[0]), float(self.first[1]) + u
            else:
                from_a, from_b = int(b + pair[1][0] >= a + pair[0][0]), int(b + pair[1][1] >= a + pair[0][1])
                back.append((from_a, from_b))
                a, b = max(a + pair[0][0], b + pair[1][0]), max(a + pair[0][1], b + pair[1][1]) + u
        out = [int(b >= a)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]

    def text(self, page: str | None) -> str:
        found = blocks(page, self.weights)
        return " ".join(t for (t, _), y in zip(found, self.viterbi([f for _, f in found]), strict=True) if y)


def fit(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 200, rate: float = 0.1, decay: float = 3e-4) -> Chain:
    """Conditional likelihood of the labels, by forward-backward over all pages at once and Adam."""
    names = sorted({f for page, _ in pages for own in page for f in own})
    number = {f: i for i, f in enumerate(names)}
    length = np.array([len(y) for _, y in pages])
    most = int(length.max())
    owner = np.concatenate([np.full(len(own), p * most + i) for p, (page, _) in enumerate(pages) for i, own in enumerate(page)])
    which = np.array([number[f] for page, _ in pages for own in page for f in own])
    label = np.zeros((len(pages), most), int)
    inside = np.arange(most) < length[:, None]
    for p, (_, y) in enumerate(pages):
        label[p, : len(y)] = y
    theta = np.zeros(len(names) + 7)  # features, bias, label pairs, first label
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    k = len(names)
    seen_pair = np.zeros((2, 2))
    for p, (_, y) in enumerate(pages):
        np.add.at(seen_pair, (y[:-1], y[1:]), 1)
    seen_first = np.bincount(label[:, 0], minlength=2)
    for step in range(1, epochs + 1):
        unary = np.bincount(owner, theta[which], len(pages) * most).reshape(len(pages), most) + theta[k]
        u = np.stack([np.zeros_like(unary), unary], -1)
        pair, first = theta[k + 1 : k + 5].reshape(2, 2), theta[k + 5 : k + 7]
        ahead, back = np.zeros_like(u), np.zeros_like(u)
        ahead[:, 0] = u[:, 0] + first
        for i in range(1, most):
            new = np.logaddexp.reduce(ahead[:, i - 1, :, None] + pair, axis=1) + u[:, i]
            ahead[:, i] = np.where(inside[:, i, None], new, ahead[:, i - 1])
        for i in range(most - 2, -1, -1):
            new = np.logaddexp.reduce(pair + (u[:, i + 1] + back[:, i + 1])[:, None, :], axis=2)
            back[:, i] = np.where(inside[:, i + 1, None], new, 0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        p = np.exp(ahead + back - total[:, None, None]) * inside[..., None]
        edge = np.exp(ahead[:, :-1, :, None] + pair + (u[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]) * inside[:, 1:, None, None]
        miss = (p[..., 1] - label * inside).ravel()
        grad = np.concatenate([np.bincount(which, miss[owner], k), [miss.sum()], (edge.sum((0, 1)) - seen_pair).ravel(), p[:, 0].sum(0) - seen_first])
        grad = grad / len(pages) + decay * theta
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Chain(dict(zip(names, theta[:k].tolist(), strict=True)), float(theta[k]), theta[k + 1 : k + 5].reshape(2, 2), theta[k + 5 :])


_SYLLABLES = "ba ce di fo gu la me ni ro su ta ve xo za".split()
_YES, _NO = "\x01", "\x02"  # marks of labelled block texts, taken off after parsing


def labelled_pages(samples: list[str], count: int = 800, seed: int = 5) -> list[tuple[list[list[str]], list[int]]]:
    """Pages laid out from known parts, parsed like any other: features and labels of their blocks."""
    rng = random.Random(seed)
    split = [t.split() for t in samples]
    long = [own for own in split if len(own) > 12]

    def words(a, b):
        if split and rng.random() < 0.7:
            own = rng.choice(split)
            at = rng.randrange(len(own))
            return " ".join(own[at : at + rng.randint(a, b)])
        return " ".join("".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b)))

    def passage():
        return " ".join(rng.choice(long)[:150]) if long and rng.random() < 0.6 else words(8, 60).capitalize() + rng.choice(".!?.. ")

    def put(text, good):
        return html.escape((_YES if good else _NO) + text, quote=False)

    def named(tag, kinds):
        if rng.random() < 0.15:
            return f"<{tag}>"
        word = rng.choice([w for k in kinds for w in _KINDS[k].split()])
        word = rng.choice([word, word, f"{word}-{rng.choice(['box', 'area', 'wrap', 'list', 'x1'])}", f"site-{word}"])
        return f'<{tag} {rng.choice(["class", "id"])}="{word}">'

    def links(n, tag="li"):
        return "".join(f'<{tag}><a href="/{i}">{put(words(1, 4), False)}</a></{tag}>' for i in range(n))

    def heading(most):
        return "<h{0}>{1}</h{0}>".format(rng.randint(2, 5), put(words(1, most), False))

    def clutter():
        kind = rng.choice(["nav", "head", "foot", "side", "ad", "note", "form", "talk", "talk", "share"])
        semantic = {"nav": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(kind, "div")
        tag = semantic if rng.random() < 0.6 else rng.choice(["div", "section", "div", "ul"] if kind != "form" else ["div"])
        start = f"<{tag}>" if tag == semantic != "div" and rng.random() < 0.5 else f'<{tag} class="{rng.choice(_KINDS[kind].split())}">'
        if kind == "nav":
            inner = f"<ul>{links(rng.randint(2, 8))}</ul>"
        elif kind == "form":
            inner = f"<form><label>{put(words(1, 4), False)}</label><input><button>{put(words(1, 2), False)}</button><p>{put(words(3, 14), False)}</p></form>"
        elif kind == "talk":
            inner = "".join(f'<{x} class="{rng.choice(["comment", "comment-body", "reply", ""])}"><p>{put(words(1, 3), False)}</p><p>{put(passage(), False)}</p></{x}>'
                            for x in [rng.choice(["div", "li", "article"]) for _ in range(rng.randint(1, 4))])
            inner = heading(3) * (rng.random() < 0.5) + inner
        elif kind in ("side", "head", "share"):
            inner = heading(5) + rng.choice([f"<ul>{links(rng.randint(1, 6))}</ul>", f"<p>{put(passage() if kind == 'side' else words(2, 10), False)}</p>"])
        else:
            body = put(("© " if kind == "foot" and rng.random() < 0.7 else "") + rng.choice([words(2, 12), passage()]), False)
            inner = rng.choice([f"<p>{body}</p>", body])
        return f"{start}{inner}</{tag}>"

    def passage_block():
        return rng.choice([
            lambda: f"<p>{put(passage(), True)}</p>", lambda: f"<p>{put(passage(), True)}</p>", lambda: f"<p><b>{put(passage(), True)}<br>",
            lambda: "<h{0}>{1}</h{0}><p>{2}</p>".format(rng.randint(2, 5), put(words(1, 9), True), put(passage(), True)), lambda: f"<p>{put(words(1, 4), True)}</p>",
            lambda: f"<blockquote><p>{put(passage(), True)}</p></blockquote>",
            lambda: "<ul>" + "".join(f"<li>{put(words(2, 20), True)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>",
            lambda: f"<p>{put(words(4, 20), True)} <a href='#'>{html.escape(words(1, 3))}</a> {html.escape(words(3, 20))}.</p>",
            lambda: "<table>" + "".join(f"<tr><td>{put(words(1, 5), True)}</td><td>{put(words(1, 5), True)}</td></tr>" for _ in range(2)) + "</table>",
            lambda: f"<pre>{put(words(3, 15), True)}</pre>", lambda: f"<div>{put(passage(), True)}</div>",
        ])()

    out = []
    while len(out) < count:
        body = (f"<h1>{put(words(1, 12), True)}</h1>" if rng.random() < 0.75 else "") + "".join(passage_block() for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 6, 7])))
        if rng.random() < 0.35:
            cut = body.rfind("</p>") + 4 if "</p>" in body else len(body)
            body = body[:cut] + clutter() + body[cut:]
        tag = rng.choice(["article", "article", "article", "main", "div", "div", "section"])
        start = f"<{tag}>" if tag in ("article", "main") and rng.random() < 0.6 else named(tag, ["main"])
        whole = f"{start}{body}</{tag}>" if rng.random() < 0.88 else body
        page = "".join(clutter() for _ in range(rng.randint(0, 4))) + whole + "".join(clutter() for _ in range(rng.randint(0, 5)))
        if rng.random() < 0.4:
            page = f'<div class="{rng.choice(["page", "wrapper", "container", "site", "row", "main", "content"])}">{page}</div>'
        found = blocks(f"<!DOCTYPE html><html><head><title>x</title></head><body>{page}</body></html>")
        marks = [(t, f) for t, f in found if t[0] in _YES + _NO]
        if len(marks) == len(found) and any(t[0] == _YES for t, _ in marks):
            out.append(([f for _, f in marks], [int(t[0] == _YES) for t, _ in marks]))
    return out


def train(pages: DataFrame, key: str = "page_id", page: str = "html", max_pages: int = 40) -> Chain:
    """Chain trained on layouts filled with the block texts of at most max_pages pages, by hash of the key.

    The sampled pages are read whole, in a task; their distinct block texts come to the driver.
    """
    there = pages.where(F.col(page).isNotNull())
    h = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    some = thinned(there, key, max_pages, there.count()).select(h.alias("h"), F.col(page).cast("string").alias("p")).orderBy("h", "p").limit(max_pages)

    def texts(batches):
        for batch in batches:
            found = {t for p in batch.column(1).to_pylist() for t, _ in blocks(p)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["t"])

    return fit(labelled_pages(sorted({r.t for r in some.mapInArrow(texts, "t string").collect()})))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", max_pages: int = 40) -> DataFrame:
    """One row per page: key, url, text, n_chars (code points).

    A null, empty or text-free page has the text "". Malformed markup is read on: unclosed elements end with
    their parent or where the next one must begin. Null keys and urls and repeated rows pass through; extra
    columns are ignored; an empty table gives no rows. The sample of max_pages only fills training layouts;
    every page is read whole.
    """
    chain = train(pages, key, page, max_pages)

    def run(batches):
        for batch in batches:
            found = [chain.text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                names=[key, url, "text", "n_chars"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, url, F.col(page).cast("string").alias("_page")).mapInArrow(run, f"`{key}` {kind}, `{url}` string, text string, n_chars long")
