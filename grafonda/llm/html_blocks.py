"""Main-text extraction from HTML by a recurrent block labeller.

A page is read into blocks: stretches of text between block-level tags, each with the
tags, classes and ids on its path.  A bidirectional LSTM in numpy reads the page's
blocks in order, a multi-hot vector of the path and a hashed bag of the block's words
each, and labels every block with the whole page as context.  Blocks labelled as
main text are joined by line feeds.

The labeller is trained here, on a generated set of `pages` labelled pages with
varied layouts (`sample_page`): page headers, menus, sidebars, notices, adverts,
forms, reader comments and footers around and inside articles, with unclosed tags.
Training is seeded and takes some seconds on the driver; the weights go out with the
task closure.

Text: character references are decoded, white space inside a block (a line break tag
counts as such) becomes one blank, blocks are trimmed and empty ones dropped.
Scripts, styles, titles and other elements whose content is no text of the page are
never read; formulas, drawings and what stands in for objects and scripts are text
like any other.  An unread element without an end tag ends with the element around it.
Nulls and edges: null and empty pages, and pages without main text, give the empty
text; a null id or url stays null; repeated rows give repeated results; an empty table
gives an empty result; columns other than the named ones are not read, whatever their
names.  Pages of any length are read whole, in time linear in their length; the labeller
takes the blocks of a long page in stretches of bounded size and carries its state over.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafonda.llm import textkit as T
from grafonda.llm.common import in_arrow, read, require

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
EVENT = re.compile(r"""["'>]""")
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Elements whose content is not text of the page: code, titles, what is typed into forms, other pages (fixed values).
UNREAD = set("script style title template iframe textarea noembed noframes".split())
#: Elements inside a line of text (fixed values).
INLINE = set(
    "a abbr b bdi bdo big cite code del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label "
    "math svg object canvas audio video picture map noscript ruby rb rt rp rtc data output meter progress acronym nobr source track param embed".split()
)
#: Elements with a vocabulary of their own, all of it inside the line.
FOREIGN = ("math", "svg")
#: Elements without an end tag (fixed values).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end at the next one of their kind.
SAME = set("li dt dd tr td th option".split())
TAGS = (
    "html body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody tr td th blockquote pre figure "
    "figcaption form fieldset legend button select option details summary dialog address center hgroup menu search"
).split()
TAG_AT = {t: i for i, t in enumerate(TAGS)}
N_NAMES, N_WORDS, N_NUMBERS = 256, 64, 6
WIDTH = len(TAGS) + 1 + N_NAMES + N_WORDS + N_NUMBERS


class Tags:
    """The tags of a page in order, in time linear in the page.

    A tag ends at the first > outside quotes, or, where quotes do not pair up, at the
    first > at all; without a > after it, < is text.  Scans that fail remember the
    quotes they opened, so that none is followed twice.
    """

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self.hopeless: set[int] = set()  # places where an opening quote leads to no end
        self.known = {True: (0, -1), False: (0, -1)}  # (from, to): nothing lies between, `to` is the next quote or > (True) or the next > (False)
        self.ends: dict[str, int] = {}

    def _next(self, at: int, quotes: bool) -> int:
        low, high = self.known[quotes]
        if not low <= at <= high:
            if quotes:
                m = EVENT.search(self.page, at)
                high = m.start() if m else len(self.page)
            else:
                high = self.page.find(">", at)
            self.known[quotes] = (at, high)
        return high

    def _end(self, at: int) -> int:
        """The > that ends the tag whose name ends at `at`."""
        opened, spot = [], self._next(at, True)
        while spot < len(self.page):
            if self.page[spot] == ">":
                return spot
            if spot in self.hopeless:
                break
            opened.append(spot)
            close = self.page.find(self.page[spot], spot + 1)
            if close < 0:
                break
            spot = self._next(close + 1, True)
        self.hopeless.update(opened)
        return self._next(at, False)

    def after(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, is an end tag, attributes) of the next tag, comment or declaration; the latter two have no name."""
        page = self.page
        while True:
            start = page.find("<", at)
            if start < 0:
                return None
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, "", False, ""
            if start > self.last:
                start = page.find("<!--", start)
                return None if start < 0 else (start, len(page), "", False, "")
            if page[start + 1 : start + 2] in ("!", "?"):
                return start, self._next(start, False) + 1, "", False, ""
            m = NAME.match(page, start)
            if m and m.end() <= self.last:
                end = self._end(m.end())
                return start, end + 1, m[1].lower(), page[start + 1] == "/", page[m.end() : end]
            at = start + 1

    def past(self, name: str, at: int, parents: dict[str, int]) -> int:
        """Where the unread element that begins at `at` has ended: after its end tag, or, where none follows, at its parent's end."""
        if name not in self.ends:
            self.ends[name] = max((m.start() for m in re.finditer(rf"</{re.escape(name)}", self.page, re.IGNORECASE)), default=-1)
        if at <= self.ends[name]:
            stop = self.page.find(">", re.compile(rf"</{re.escape(name)}", re.IGNORECASE).search(self.page, at).end())
            return len(self.page) if stop < 0 else stop + 1
        for m in re.compile(r"</([a-zA-Z][^\s/>]*)").finditer(self.page, at):
            if parents.get(m[1].lower()):
                return m.start()
        return len(self.page)


def blocks(page: str) -> list[tuple[str, tuple, float]]:
    """(text, path, share of characters in links) of each block, in page order; path is (depth, slots that the elements around it set)."""
    out: list[tuple[str, tuple, float]] = []
    stack: list[tuple[str, tuple]] = []  # open block elements, each with its path
    opened: Counter = Counter()
    pieces: list[str] = []
    links = at = foreign = 0
    in_link = False
    tags = Tags(page)

    def add(raw: str) -> None:
        nonlocal links
        if raw:
            pieces.append(raw)
            if in_link:
                links += len(raw)

    def flush() -> None:
        nonlocal links
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append((text, stack[-1][1] if stack else (0, frozenset()), min(1.0, links / len(text))))
            pieces.clear()
            links = 0

    def pop() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    while True:
        tag = tags.after(at)
        if tag is None:
            add(page[at:])
            break
        start, end, name, closes, attributes = tag
        add(page[at:start])
        at = end
        if not name:
            continue
        if name == "br":
            add(" ")
            continue
        if name in UNREAD and not (foreign and name == "title"):
            if not closes and not attributes.endswith("/"):
                at = tags.past(name, at, opened)
            continue
        if name in INLINE or (foreign and name not in TAG_AT):
            if name == "a":
                in_link = not closes
            if name in FOREIGN and not attributes.endswith("/"):
                foreign = max(0, foreign + (-1 if closes else 1))
            continue
        flush()
        in_link, foreign = False, 0
        if closes:
            if opened[name]:
                while pop() != name:
                    pass
            continue
        if stack and stack[-1][0] == "p":
            pop()
        if name in SAME and stack and stack[-1][0] == name:
            pop()
        if name not in VOID:
            names = " ".join(a or b or c for a, b, c in NAMES.findall(attributes)) if attributes else ""
            depth, slots = stack[-1][1] if stack else (0, frozenset())
            own = _slots((name, names))
            stack.append((name, (depth + 1, slots if own <= slots else slots | own)))
            opened[name] += 1
    flush()
    return out


@lru_cache(maxsize=4096)
def _slots(element: tuple[str, str]) -> frozenset[int]:
    """Positions of an element's tag and of the parts of its names in the path vector."""
    base = len(TAGS) + 1
    names = {x.lower() for x in PART.findall(element[1])}
    return frozenset((TAG_AT.get(element[0], len(TAGS)), *(base + zlib.crc32(x.encode()) % N_NAMES for x in names)))


def features(found: list[tuple[str, tuple, float]], first: int = 0, total: int = 0) -> np.ndarray:
    """One row per block: path, hashed words, and a few numbers; the blocks may be a stretch, from `first` on, of `total` ones."""
    x = np.zeros((len(found), WIDTH), np.float32)
    first_word = len(TAGS) + 1 + N_NAMES
    for i, (text, (depth, slots), links) in enumerate(found):
        row = x[i]
        row[list(slots)] = 1
        words = text.lower().split()
        spots = [zlib.crc32(w.encode()) % N_WORDS for w in words]
        bag = np.bincount(spots, minlength=N_WORDS)
        row[first_word : first_word + N_WORDS] = 0.5 * np.sqrt(bag / max(len(words), 1))
        row[-N_NUMBERS:] = (np.log1p(len(text)) / 6, links, text[-1] in ".!?", min(depth, 12) / 12, (first + i) / (total or len(found)), 1)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    """Two LSTMs over the block sequence, one from each end, and a logistic output on both states."""

    def __init__(self, width: int, hidden: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in ("f", "b"):
            self.p["w" + d] = (rng.standard_normal((width, 4 * hidden)) / np.sqrt(24)).astype(np.float32)
            self.p["u" + d] = (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1
            self.p["c" + d] = bias
        self.p["o"] = (rng.standard_normal(2 * hidden) / np.sqrt(hidden)).astype(np.float32)
        self.p["z"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool, begin: tuple | None = None) -> tuple[np.ndarray, list]:
        """States of one direction; without `keep`, the list holds the last (state, cell), from which `begin` goes on."""
        n, steps, h = x.shape[0], x.shape[1], self.hidden
        pre = x @ self.p["w" + d] + self.p["c" + d]
        state, cell = begin or (np.zeros((n, h), np.float32), np.zeros((n, h), np.float32))
        out, trail = np.zeros((n, steps, h), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = pre[:, t] + state @ self.p["u" + d]
            s = _sigmoid(a)
            i, f, o, g = s[:, :h], s[:, h : 2 * h], s[:, 3 * h :], np.tanh(a[:, 2 * h : 3 * h])
            m = mask[:, t, None]
            new = f * cell + i * g
            tanh = np.tanh(new)
            if keep:
                trail.append((t, state, cell, i, f, g, o, tanh, m))
            cell = np.where(m, new, cell)
            state = np.where(m, o * tanh, state)
            out[:, t] = state
        return out, trail if keep else [state, cell]

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(pages, blocks) of log odds for padded inputs (pages, blocks, width)."""
        both = np.concatenate([self._run(x, mask, d, False)[0] for d in ("f", "b")], axis=2)
        return both @ self.p["o"] + self.p["z"]

    def long_logits(self, found: list, step: int) -> np.ndarray:
        """Log odds of the blocks of one long page, with the features of only `step` blocks at a time."""
        out = np.zeros(len(found), np.float32) + self.p["z"]
        starts = list(range(0, len(found), step))
        for k, d in enumerate(("f", "b")):
            begin = None
            for a in starts if d == "f" else reversed(starts):
                part = found[a : a + step]
                states, begin = self._run(features(part, a, len(found))[None], np.ones((1, len(part)), bool), d, False, begin)
                out[a : a + step] += states[0] @ self.p["o"][k * self.hidden : (k + 1) * self.hidden]
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        h = self.hidden
        runs = {d: self._run(x, mask, d, True) for d in ("f", "b")}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        p = _sigmoid(both @ self.p["o"] + self.p["z"])
        total = mask.sum()
        loss = -float((mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / total)
        err = ((p - y) * mask / total).astype(np.float32)
        grad = {"o": np.einsum("ps,psh->h", err, both), "z": err.sum(keepdims=True).reshape(1)}
        for k, d in enumerate(("f", "b")):
            d_out = err[:, :, None] * self.p["o"][k * h : (k + 1) * h]
            d_state, d_cell = np.zeros((len(x), h), np.float32), np.zeros((len(x), h), np.float32)
            d_pre = np.zeros((x.shape[0], x.shape[1], 4 * h), np.float32)
            gu = np.zeros_like(self.p["u" + d])
            for t, state, cell, i, f, g, o, tanh, m in reversed(runs[d][1]):
                ds = d_state + d_out[:, t]
                live = ds * m
                dc = d_cell * m + live * o * (1 - tanh**2)
                da = np.concatenate([dc * g * i * (1 - i), dc * cell * f * (1 - f), dc * i * (1 - g**2), live * tanh * o * (1 - o)], axis=1)
                d_pre[:, t] = da
                gu += state.T @ da
                d_state = da @ self.p["u" + d].T + ds * ~m
                d_cell = dc * f + d_cell * ~m
            flat = d_pre.reshape(-1, 4 * h)
            grad["w" + d] = x.reshape(-1, x.shape[2]).T @ flat
            grad["u" + d], grad["c" + d] = gu, flat.sum(0)
        return loss, grad


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(r) for r in rows)
    x, mask = np.zeros((len(rows), longest, WIDTH), np.float32), np.zeros((len(rows), longest), bool)
    for i, r in enumerate(rows):
        x[i, : len(r)], mask[i, : len(r)] = r, True
    return x, mask


#: Marks main text in generated pages; taken out before the features are made.
GOOD = ""
#: Names that pages give to their parts, and short texts that stand in them (fixed values).
PARTS = {
    "nav": ("nav menu navbar navigation main-menu breadcrumb breadcrumbs topnav site-nav links pagination tabs toc", "Home|About us|Contact|Menu|Startseite|Accueil|Inicio|Products|Blog|Next page|Log in"),
    "header": ("header site-header masthead top topbar page-header logo branding banner hero", "My site|Daily news|Welcome|Skip to content|Search"),
    "sidebar": ("sidebar side widget related recent-posts popular tags archive categories rail secondary", "Related articles|Most read|Tags|Archive|Recent posts|You may also like"),
    "ad": ("ad ads advert advertisement sponsored promo promotion banner-ad adsbygoogle sponsor ad-slot", "Advertisement|Anzeige|Publicité|Publicidad|Buy now|Sponsored"),
    "notice": ("notice cookie cookie-notice cookies consent gdpr alert warning popup modal banner newsletter subscribe disclaimer paywall overlay announcement", "We use cookies|Accept all|Subscribe to our newsletter|Cookies akzeptieren|This site uses cookies to improve"),
    "form": ("form search search-form login contact-form signup comment-form", "Your name|Email|Send|Search|Sign up|Password|Submit"),
    "comments": ("comments comment comment-list replies reader-comments discussion responses reply thread disqus", "Reply|3 comments|Leave a reply|Great post|Kommentare|Thanks for sharing"),
    "footer": ("footer site-footer bottom copyright page-footer colophon legal credits", "© 2020|All rights reserved|Privacy policy|Terms|Impressum|Copyright"),
    "share": ("share social social-links sharing share-buttons byline meta author-bio post-meta", "Share|Tweet|Like|Follow us|Posted by|Facebook"),
}
CONTENT = "content article post entry entry-content story article-body post-content main-content text body page-content prose article-content single main".split()
ELEMENT = {"nav": "nav", "header": "header", "sidebar": "aside", "form": "form", "footer": "footer", "comments": "section"}


def sample_page(rng: random.Random) -> str:
    """A page of random layout whose main text is marked."""
    parts = ["".join(rng.choice("bcdfghklmnprstvwz") + rng.choice("aeiouéüñ") for _ in range(rng.randint(1, 4))) for _ in range(60)]

    def sentence(low: int, high: int) -> str:
        words = [rng.choice(parts) for _ in range(rng.randint(low, high))]
        return (" ".join(words).capitalize() + rng.choice(["."] * 8 + ["!", "", "&amp;"])).replace(" ", rng.choice([" ", " ", "  ", "\n"]))

    def inline(text: str) -> str:
        roll = rng.random()
        tag = rng.choice(["b", "i", "em", "strong", "a href='/x'", "span"])
        if roll < 0.2:
            return f"<{tag}>{text}</{tag.split()[0]}>"
        return f"{text} <{tag}>{sentence(1, 4)}</{tag.split()[0]}> {sentence(1, 6)}" if roll < 0.35 else text

    def named(kind: str, body: str) -> str:
        tag = ELEMENT.get(kind, "div") if rng.random() < 0.55 else rng.choice(["div", "div", "section", "ul" if "<li>" in body else "div"])
        name = rng.choice(PARTS[kind][0].split())
        if tag in ("nav", "header", "aside", "footer", "form") and rng.random() < 0.5:
            return f"<{tag}>{body}</{tag}>"
        attribute = rng.choice(["class", "class", "id"])
        extra = rng.choice(["", "", f" {rng.choice(['box', 'row', 'wide', 'inner', 'col-3', 'clearfix'])}"]) if attribute == "class" else ""
        return f'<{tag} {attribute}="{name}{extra}">{body}</{tag}>'

    def filler(kind: str) -> str:
        if rng.random() < 0.3:
            return rng.choice(PARTS[kind][1].split("|"))
        return sentence(1, 25 if kind in ("ad", "notice", "comments", "footer", "sidebar") else 6)

    def junk(kind: str) -> str:
        if kind in ("nav", "sidebar", "footer", "share") and rng.random() < 0.6:
            items = "".join(f"<li><a href='/{i}'>{filler(kind)}</a></li>" for i in range(rng.randint(1, 8)))
            return named(kind, f"<ul>{items}</ul>")
        if kind == "form":
            return named(kind, "".join(rng.choice(["<label>{}</label><input>", "<p>{}</p>", "<button>{}</button>", "{}", "<select><option>{}</option></select>"]).format(filler(kind)) for _ in range(rng.randint(1, 4))))
        if kind == "comments":
            return named(kind, "".join(named(kind, f"<p>{filler(kind)}</p>" * rng.randint(1, 2)) for _ in range(rng.randint(1, 4))))
        return named(kind, "".join(rng.choice(["<p>{}</p>", "{}", "<div>{}</div>", "<h3>{}</h3>", "<span>{}</span>"]).format(filler(kind)) for _ in range(rng.randint(1, 3))))

    def good() -> str:
        text = GOOD + inline(sentence(1, 60))
        roll = rng.random()
        if roll < 0.62:
            return rng.choice([f"<p>{text}</p>"] * 6 + [f"<p>{text}", f"<p><b>{text}<br><p>{GOOD}{sentence(2, 30)}</p>"])
        if roll < 0.72:
            return "<{0}>{1}</{0}>".format(rng.choice(["h2", "h3", "h4"]), GOOD + sentence(1, 8))
        if roll < 0.80:
            return "<{0}>{1}</{0}>".format(rng.choice(["ul", "ol"]), "".join(f"<li>{GOOD}{sentence(1, 12)}</li>" for _ in range(rng.randint(1, 4))))
        if roll < 0.86:
            return rng.choice(["<blockquote>{}</blockquote>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>", "<figure><figcaption>{}</figcaption></figure>"]).format(text)
        if roll < 0.90:
            return f"<table><tr><td>{text}</td><td>{GOOD}{sentence(1, 5)}</td></tr></table>"
        return rng.choice([f"<div>{text}</div>", text + "<br>" + sentence(1, 20), f"<section><p>{text}</p></section>"])

    title = rng.choice([f"<h1>{GOOD}{sentence(1, 12)}</h1>"] * 4 + [f"<header><h1>{GOOD}{sentence(2, 9)}</h1></header>", ""])
    body = [good() for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 18]))]
    for _ in range(rng.choice([0, 0, 0, 1, 2])):
        body.insert(rng.randint(0, len(body)), junk(rng.choice(["ad", "notice", "share", "form", "sidebar"])))
    if rng.random() < 0.25:
        body.append(junk("comments"))
    roll, inside = rng.random(), title + "".join(body)
    if roll < 0.5:
        name = rng.choice(["", "", f' class="{rng.choice(CONTENT)}"'])
        main = f"<article{name}>{inside}</article>"
    elif roll < 0.65:
        main = f"<main>{inside}</main>"
    elif roll < 0.95:
        main = f'<{(t := rng.choice(["div", "div", "section", "td"]))} {rng.choice(["class", "id"])}="{rng.choice(CONTENT)}">{inside}</{t}>'
    else:
        main = inside
    if rng.random() < 0.4:
        main = f"<{(t := rng.choice(['main', 'div', 'section']))}{' class=' + rng.choice(['wrapper', 'container', 'page', 'row']) if t == 'div' else ''}>{main}</{t}>"
    before = [junk(k) for k in ("notice", "header", "nav", "nav", "ad", "form", "share") if rng.random() < 0.4]
    after = [junk(k) for k in ("share", "comments", "sidebar", "ad", "form", "notice", "nav", "footer") if rng.random() < 0.4]
    rng.shuffle(before)
    tail = rng.choice(["</body></html>", "</body></html>", "", "</div></body></html>"])
    return f"<!DOCTYPE html><html><head><title>{sentence(1, 9)}</title><style>p{{margin:0}}</style></head><body>{''.join(before)}{main}{''.join(after)}{tail}"


@lru_cache(maxsize=4)
def train(pages: int = 700, hidden: int = 20, epochs: int = 9, batch: int = 20, seed: int = 3, rate: float = 0.01) -> BiLstm:
    """The labeller, fitted with Adam to generated pages; the same for the same arguments."""
    rng = random.Random(seed)
    data = []
    for _ in range(pages):
        found = blocks(sample_page(rng))
        y = np.array([GOOD in text for text, _, _ in found], np.float32)
        clean = [(t.replace(GOOD, "") or "-", path, links) for t, path, links in found]
        if found:
            data.append((features(clean), y))
    model = BiLstm(WIDTH, hidden, seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = list(range(len(data)))
        rng.shuffle(order)
        order.sort(key=lambda i: len(data[i][0]) // 8)
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        rng.shuffle(groups)
        speed = rate * (0.15 if epoch >= epochs - 2 else 1)
        for group in groups:
            x, mask = padded([data[i][0] for i in group])
            hidden_pages = np.random.default_rng(step).random(len(group)) < 0.3  # their words and numbers are hidden: paths must do alone
            x[hidden_pages, :, -N_WORDS - N_NUMBERS :] = 0
            y = np.zeros(mask.shape, np.float32)
            for row, i in enumerate(group):
                y[row, : len(data[i][1])] = data[i][1]
            _, grad = model.gradients(x, mask, y)
            step += 1
            for k, g in grad.items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.p[k] -= (speed * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def label(model: BiLstm, pages: list[list[tuple[str, tuple, float]]], cells: int = 4096) -> list[np.ndarray]:
    """Log odds of each block of each page; pages of similar length share a batch of at most `cells` blocks, longer pages go through in stretches."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        if len(pages[order[at]]) > cells:
            out[order[at]] = model.long_logits(pages[order[at]], cells)
            at += 1
            continue
        to = at + 1
        while to < len(order) and len(pages[order[to]]) * (to + 1 - at) <= cells:
            to += 1
        group = order[at:to]
        x, mask = padded([features(pages[i]) for i in group])
        odds = model.logits(x, mask)
        for row, i in enumerate(group):
            out[i] = odds[row, : len(pages[i])]
        at = to
    return out


def main_texts(model: BiLstm, pages: list[str]) -> list[str]:
    found = [blocks(p) for p in pages]
    return ["\n".join(b[0] for b, s in zip(bs, odds.tolist(), strict=True) if s > 0) for bs, odds in zip(found, label(model, found), strict=True)]


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", model: BiLstm | None = None) -> DataFrame:
    """(id, text) of every page."""
    fitted = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in T.slices(whole, "html"):
                texts = main_texts(fitted, [p or "" for p in part.column("html").to_pylist()])
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(part.num_columns) if part.schema.names[i] != "html"], pa.array(texts, pa.string())], names=[*[n for n in part.schema.names if n != "html"], "text"])

    rows = require(pages, id_col, *[c for c in ("url",) if c in pages.columns], html_col)
    rows = rows.withColumnRenamed(html_col, "html")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "html")
    return in_arrow(rows, run, kept + ", text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: main text of every page."""
    found = extract(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
