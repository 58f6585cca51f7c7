"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: runs of text between block-level
tags, with the path of open tags above them. A bidirectional LSTM in numpy reads
for each block a vector of its tag path (names, classes and ids, hashed), a vector
of its hashed words and a few measures, and labels every block with the whole page
as context. It is trained here, by back-propagation through time, on pages that
``example_page`` makes: articles of running text among menus, headers, footers,
sidebars, notices, adverts, forms and comments in many arrangements. The trained
weights are kept in a file beside this module; ``python -m
lodestone.llm.html_blocks`` trains and writes them anew.

Pages are cut into blocks in time that grows with their length, and read in
portions of blocks that carry the LSTM's state, so a page of any length takes the
memory of its blocks and of two short states for each.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

#: Tags that end a run of text (fixed values).
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is never text of the page (fixed values).
SKIPPED = frozenset("script style noscript template iframe svg head title textarea object canvas audio video noembed noframes".split())
#: Of these, elements whose content is no markup: left open, they reach to the end of the page (fixed values).
RAW = frozenset("script style textarea iframe noembed noframes".split())
#: Elements without content (fixed values).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An open element that ends where one of these begins in it (fixed values).
_CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody"]),
    "th": frozenset(["td", "th", "tr", "tbody"]),
    "option": frozenset(["option", "optgroup"]),
}
_STOPS = frozenset("ul ol table dl select body html article section div main aside nav header footer form td th".split())
#: Elements around a text whose names its path holds, the outermost first; a page may be nested to any depth.
DEPTH = 256
#: Elements that a block may close or that keep it from closing what is outside.
_MET = _STOPS | set(_CLOSED_BY) | {"p"}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^'\">]*")
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[^\W_]+")

#: Widths of a block's vector: hashed tag path, hashed words, measures; and of the LSTM's state.
PATHS, WORDS, DENSE, HIDDEN = 1024, 256, 14, 14

Block = tuple[str, tuple[str, ...], int]


def _names(tag: str, attrs: str) -> tuple[str, ...]:
    """The tag's name and the parts of its class, id and role; "hidden" where it is not shown."""
    out = [tag]
    if attrs and not attrs.isspace():
        for key, value in _NAMED.findall(attrs):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                out.append("hidden")
            elif key in ("class", "id", "role"):
                out += _WORD.findall(value)
    return tuple(out)


class _Marks:
    """Markup of a page, one mark after another: (where it begins, where it ends, "/" or "", tag, attributes). The tag of comments and the like is empty."""

    def __init__(self, page: str):
        self.page = page
        self.gone: set[str] = set()  # what does not occur in the rest of the page

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.gone.add(what)
        return k

    def past(self, what: str, at: int) -> int:
        k = self.find(what, at)
        return k + len(what) if k >= 0 else len(self.page)

    def tag_end(self, at: int) -> int:
        """Where the tag whose attributes begin at ``at`` ends. A quote that nothing closes is an ordinary character."""
        while True:
            at = _PLAIN.match(self.page, at).end()
            c = self.page[at : at + 1]
            if c in (">", ""):
                return at
            k = self.find(c, at + 1)
            at = k + 1 if k >= 0 else at + 1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        page = self.page
        while (at := self.find("<", at)) >= 0:
            if m := _TAG.match(page, at):
                end = self.tag_end(m.end())
                return at, min(end + 1, len(page)), m[1], m[2].lower(), page[m.end() : end]
            if page.startswith("<!--", at):
                return at, self.past("-->", at + 4), "", "", ""
            if page.startswith("<![CDATA[", at):
                return at, self.past("]]>", at + 9), "", "", ""
            if page.startswith(("<!", "<?"), at):
                return at, self.past(">", at), "", "", ""
            at += 1
        return None


def blocks_of(page: str) -> list[Block]:
    """(text, path, letters inside links) of every run of text, in page order. Text is decoded, its white space single and trimmed; empty runs are left out."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    blank, linked, links = True, 0, 0
    path: tuple = ()
    # Places in the stack of each name, of blocks, and of what a block may meet, so that no search passes over what is nested in between.
    places: defaultdict[str, list[int]] = defaultdict(list)
    solid: list[int] = []
    met: list[int] = []
    marks = _Marks(page)
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal blank, linked
        if not blank:
            out.append((" ".join("".join(parts).split()), path, linked))
        parts.clear()
        blank, linked = True, 0

    def take(raw: str) -> None:
        nonlocal path, blank, linked
        if not raw:
            return
        text = _html.unescape(raw) if "&" in raw else raw
        if not text.isspace():
            if blank:
                path = tuple(n for _, names in stack[:DEPTH] for n in names)
                blank = False
            if links:
                linked += len(text)
        parts.append(text)

    def leave(k: int) -> None:
        nonlocal links
        for t, _ in stack[k:]:
            places[t].pop()
        links = len(places["a"])
        del stack[k:]
        for kept in (solid, met):
            while kept and kept[-1] >= k:
                kept.pop()

    at, end = 0, len(page)
    while at < end:
        mark = marks.next(at)
        if mark is None:
            take(page[at:])
            break
        take(page[at : mark[0]])
        _, at, closes, tag, attrs = mark
        if not tag:
            continue
        if closes:
            if tag in BLOCK_TAGS:
                flush()
            elif tag == "br":
                parts.append(" ")
            # What is not a block ends inside the innermost block only.
            if places[tag] and (tag in BLOCK_TAGS or not solid or places[tag][-1] > solid[-1]):
                leave(places[tag][-1])
            continue
        if tag in SKIPPED:
            if not attrs.rstrip().endswith("/"):
                close = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                if close is None:
                    unclosed.add(tag)
                    # An unclosed head or title ends where the body begins, raw text at the end; of others the tag alone is skipped.
                    if tag in ("head", "title") and "<body" not in unclosed:
                        close = re.compile(r"(?=<body\b)", re.I).search(page, at)
                        if close is None:
                            unclosed.add("<body")
                at = close.end() if close else end if tag in RAW else at
            continue
        if tag in BLOCK_TAGS:
            flush()
            for k in reversed(met):
                t = stack[k][0]
                if t == "p" or tag in _CLOSED_BY.get(t, ()):
                    leave(k)
                    break
                if t in _STOPS:
                    break
        elif tag == "br":
            parts.append(" ")
        if tag not in VOID and not attrs.endswith("/"):
            k = len(stack)
            stack.append((tag, _names(tag, attrs) if k < DEPTH else ()))
            places[tag].append(k)
            if tag in BLOCK_TAGS:
                solid.append(k)
            if tag in _MET:
                met.append(k)
            links = len(places["a"])
    flush()
    return out


@cache
def _slot(name: str, n: int) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % n


def vectors(blocks: list[Block], at: int = 0, total: int | None = None) -> np.ndarray:
    """A row for each block: its hashed tag path, its hashed words as shares, and its measures. ``blocks`` may be a part, from ``at``, of a page of ``total`` blocks."""
    n, width = total or len(blocks), PATHS + WORDS + DENSE
    x = np.zeros((len(blocks), width), np.float32)
    flat = x.ravel()
    where, share = [], []
    for k, (text, path, linked) in enumerate(blocks):
        for t in set(path):
            flat[k * width + _slot(f"any {t}", PATHS)] = 1
        for t in path[-2:]:
            flat[k * width + _slot(f"last {t}", PATHS)] = 1
        found = _WORD.findall(text.lower())
        size, c = len(text), max(len(found), 1)
        base = k * width + PATHS
        where += [base + zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS for w in found]
        share += [2 / c] * len(found)
        x[k, PATHS + WORDS :] = (
            min(np.log1p(c), 6) / 3, linked / size, min((text.count(".") + text.count(",")) / c, 1), sum(map(text.count, "0123456789")) / size,
            text[-1] in ".!?:;\"»”)", min(size / c / 10, 3), (at + k) / max(n - 1, 1), 1 - min(n, 100) / 100, c < 4, c > 25, "©" in text or "(c)" in text, "|" in text or "»" in text,
            min(len(path), 20) / 20, 1,
        )
    if where:
        u, inv = np.unique(np.array(where, np.int64), return_inverse=True)
        flat[u] = np.minimum(np.bincount(inv, weights=share), 3)
    return x


def _sig(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """A bidirectional LSTM over the vectors of a page's blocks."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {"out": r.normal(0, 0.3, 2 * h), "b": np.zeros(1)}
        for d in "fb":
            self.p |= {f"in{d}": r.normal(0, 0.1, (PATHS + WORDS + DENSE, 4 * h)), f"u{d}": r.normal(0, 0.2, (h, 4 * h))}
            self.p[f"in{d}"][-1, h : 2 * h] += 1.0
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def run(self, pages: list[np.ndarray], keep: bool = False):
        """Logits of all blocks (flat), and what back-propagation needs."""
        n = np.array([len(p) for p in pages])
        x = np.concatenate(pages)
        top = int(n.max())
        col = np.repeat(np.arange(len(pages)), n)
        row = np.concatenate([np.arange(k) for k in n])
        mask = np.zeros((top, len(pages), 1), np.float32)
        mask[row, col] = 1
        states, saved = [], {}
        for d in "fb":
            z = np.zeros((top, len(pages), 4 * HIDDEN), np.float32)
            z[row, col] = x @ self.p[f"in{d}"]
            h = c = np.zeros((len(pages), HIDDEN), np.float32)
            hs = np.zeros((top, len(pages), HIDDEN), np.float32)
            tape = []
            for t in range(top) if d == "f" else range(top - 1, -1, -1):
                a = z[t] + h @ self.p[f"u{d}"]
                i, f, o = (_sig(a[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
                g = np.tanh(a[:, 3 * HIDDEN :])
                c2 = (f * c + i * g) * mask[t]
                tc = np.tanh(c2)
                h2 = o * tc * mask[t]
                if keep:
                    tape.append((t, i, f, o, g, c, tc, h))
                h, c = h2, c2
                hs[t] = h
            states.append(hs)
            saved[d] = tape
        both = np.concatenate(states, axis=2)
        flat = both[row, col]
        return flat @ self.p["out"] + self.p["b"], (x, flat, row, col, top, mask, saved)

    def gradients(self, pages: list, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        logit, (x, flat, row, col, top, mask, saved) = self.run(pages, keep=True)
        p = _sig(logit)
        e = (p - y) / len(y)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["out"], grad["b"] = flat.T @ e, np.array([e.sum()])
        dh_all = np.zeros((top, len(pages), 2 * HIDDEN), np.float32)
        dh_all[row, col] = e[:, None] * self.p["out"][None]
        for k, d in enumerate("fb"):
            u = self.p[f"u{d}"]
            dz = np.zeros((top, len(pages), 4 * HIDDEN), np.float32)
            dh = dc = np.zeros((len(pages), HIDDEN), np.float32)
            for t, i, f, o, g, c, tc, h in reversed(saved[d]):
                dh = (dh + dh_all[t, :, k * HIDDEN : (k + 1) * HIDDEN]) * mask[t]
                dc = (dc + dh * o * (1 - tc * tc)) * mask[t]
                da = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                dz[t] = da
                grad[f"u{d}"] += h.T @ da
                dh, dc = da @ u.T, dc * f
            grad[f"in{d}"] = x.T @ dz[row, col]
        loss = float(-np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)))
        return loss, grad

    def states(self, pages: list[list[Block]], direction: str, x: list[np.ndarray] | None, portion: int = 2048) -> np.ndarray:
        """(step, page, HIDDEN): states of one direction, for pages in ascending order of length. Without their vectors ``x`` these are made for ``portion`` cells at a time."""
        n = np.array([len(p) for p in pages])
        top, step = int(n[-1]), max(portion // len(pages), 1)
        w, u = self.p[f"in{direction}"], self.p[f"u{direction}"]
        out = np.zeros((top, len(pages), HIDDEN), np.float32)
        h = c = np.zeros((len(pages), HIDDEN), np.float32)
        portions = range(0, top, step)
        for a in portions if direction == "f" else reversed(portions):
            b = min(a + step, top)
            z = np.zeros((b - a, len(pages), 4 * HIDDEN), np.float32)
            for k in range(int(np.searchsorted(n, a, "right")), len(pages)):
                z[: n[k] - a, k] = (vectors(pages[k][a:b], a, int(n[k])) if x is None else x[k][a:b]) @ w
            for t in range(a, b) if direction == "f" else range(b - 1, a - 1, -1):
                live = (n > t)[:, None].astype(np.float32)
                g = z[t - a] + h @ u
                i, f, o = (_sig(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
                c = (f * c + i * np.tanh(g[:, 3 * HIDDEN :])) * live
                h = o * np.tanh(c) * live
                out[t] = h
        return out

    def label(self, pages: list[list[Block]], cells: int = 1 << 16) -> list[np.ndarray]:
        """Per page a flag for each block. Pages of like length are read together, up to ``cells`` blocks with what fills the shorter ones up."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and end - at < 128 and len(pages[order[end]]) * (end - at + 1) <= cells:
                end += 1
            part = [pages[k] for k in order[at:end]]
            x = [vectors(p) for p in part] if sum(map(len, part)) <= cells // 8 else None
            logit = self.states(part, "f", x) @ self.p["out"][:HIDDEN] + self.states(part, "b", x) @ self.p["out"][HIDDEN:] + self.p["b"]
            for j, k in enumerate(order[at:end]):
                out[k] = logit[: len(pages[k]), j] > 0
            at = end
        return out


_SYLLABLES = "th re tion an le ou st der que men lo ka in or es pi ver ö é ng ta ung ble ción".split()
_SMALL = "the of and to in de la le und die el que for is on with".split()
_MENU = "Home About Contact News Sports Blog Login Search Products Archive Impressum Accueil Inicio Kontakt More Tags Help".split()
_NOISE = {
    "notice": ["We use cookies to improve your experience.", "This site uses cookies. Accept all", "Please enable JavaScript.", "You have 3 free articles left this month."],
    "promo": ["Subscribe to our newsletter", "Sign up today and save 20%", "Follow us on social media", "Share this article", "Advertisement", "Sponsored", "Download our app"],
    "legal": ["© 2021 All rights reserved.", "Terms of Service", "Privacy Policy", "Copyright 2019 Example Inc."],
    "form": ["Your email address", "Name", "Send", "Search", "Leave a reply", "Password", "Submit comment"],
    "meta": ["Read more", "Related posts", "Previous", "Next", "Posted in", "Tags:", "Comments (3)", "Reply", "Report", "Most read"],
}


def example_page(r: np.random.Generator) -> tuple[str, list[str]]:
    """A page and the texts of its article, made by rule."""

    def word() -> str:
        return _SMALL[r.integers(len(_SMALL))] if r.random() < 0.35 else "".join(_SYLLABLES[k] for k in r.integers(0, len(_SYLLABLES), r.integers(1, 5)))

    def prose(n: int) -> str:
        junk = r.choice(["###", "$$$", "&&&"]) if r.random() < 0.05 else ""
        ws = [word() + ("," if r.random() < 0.07 else ".") * (r.random() < 0.16) + junk for _ in range(n)]
        gap = " | " if r.random() < 0.04 else " "
        out = gap.join(ws).capitalize() + ("." if r.random() < 0.9 else "")
        return out.upper() if r.random() < 0.02 else out

    pick = lambda xs: xs[r.integers(len(xs))]
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    cls = lambda *names: f' {pick(["class", "class", "id"])}="{pick(names)}{pick(["", "", "-1", " box", " clearfix"])}"'
    article: list[str] = []

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{esc(pick(_MENU) if r.random() < 0.5 else word())}</a></li>' for k in range(n))

    def menu() -> str:
        k = int(r.integers(2, 9))
        return pick([f"<nav><ul>{links(k)}</ul></nav>", f"<ul{cls('menu', 'navigation', 'nav', 'navbar')}>{links(k)}</ul>", f"<div{cls('menu', 'nav', 'topbar', 'breadcrumb', 'breadcrumbs')}>{''.join(f'<a href=#>{esc(word())}</a> | ' for _ in range(k))}</div>", f"<nav{cls('main', 'top')}>{' '.join(f'<a href=#>{esc(word())}</a>' for _ in range(k))}</nav>"])

    def loose() -> str:
        t = esc(pick(pick(list(_NOISE.values()))) if r.random() < 0.4 else prose(int(r.integers(2, 60))))
        return pick([f"<p>{t}</p>", t, f"<div>{t}</div>", f"<span>{t}</span>", f"<h3>{esc(word())}</h3><p>{t}</p>"])

    def side() -> str:
        inner = "".join(loose() for _ in range(r.integers(1, 4)))
        return pick([f"<aside>{inner}</aside>", f"<div{cls('sidebar', 'widget', 'related', 'side', 'recommended')}>{inner}</div>", f"<aside{cls('sidebar', 'related')}><h2>{esc(word())}</h2><ul>{links(4)}</ul></aside>"])

    def advert() -> str:
        return f"<{(t := pick(['div', 'div', 'section', 'p']))}{cls('ad', 'ads', 'advert', 'advertisement', 'promo', 'sponsored', 'banner', 'newsletter', 'social', 'share')}>{esc(pick(_NOISE['promo']) if r.random() < 0.3 else prose(int(r.integers(2, 50))))}</{t}>"

    def notice() -> str:
        return f"<div{cls('notice', 'cookie', 'cookies', 'cookie-banner', 'consent', 'alert', 'popup', 'modal', 'gdpr', 'disclaimer')}>{pick(['', '<p>'])}{esc(pick(_NOISE['notice']) if r.random() < 0.5 else prose(int(r.integers(3, 40))))}</div>"

    def form() -> str:
        return f"<form{pick(['', cls('search', 'login', 'signup', 'subscribe')])}><label>{esc(pick(_NOISE['form']))}</label><input name=q><p>{esc(prose(int(r.integers(2, 15))))}</p><button>{esc(pick(_NOISE['form']))}</button><select><option>{esc(word())}<option>{esc(word())}</select></form>"

    def comments() -> str:
        one = lambda: pick([f"<div{cls('comment', 'reply', 'comment-body')}><b>{esc(word())}</b><p>{esc(prose(int(r.integers(3, 60))))}</p></div>", f"<li{cls('comment')}><p>{esc(prose(int(r.integers(3, 50))))}</p></li>", f"<p>{esc(prose(int(r.integers(3, 50))))}</p>", f"<article{cls('comment')}><p>{esc(prose(int(r.integers(3, 40))))}</p></article>"])
        inner = "".join(one() for _ in range(r.integers(1, 5)))
        return pick([f"<section{cls('comments', 'discussion', 'responses')}><h2>Comments</h2>{inner}</section>", f"<div{cls('comments', 'comment-list', 'disqus', 'replies')}>{inner}</div>", f"<ol{cls('comments', 'commentlist')}>{inner}</ol>"])

    def header() -> str:
        return pick([f"<header>{pick(['<h1>', '<div>', '<p>'])}{esc(word())}</header>", f"<header{cls('site', 'page', 'top')}><a href=/>{esc(word())}</a><p>{esc(prose(int(r.integers(2, 12))))}</p></header>", f"<div{cls('header', 'masthead', 'topbar', 'logo')}>{esc(prose(int(r.integers(1, 8))))}</div>"])

    def footer() -> str:
        t = esc(pick(_NOISE["legal"])) if r.random() < 0.5 else f"&copy; {esc(word())}.example &middot; {esc(word())}"
        return pick([f"<footer>{t}</footer>", f"<footer><p>{t}</p><p>{esc(prose(int(r.integers(2, 30))))}</p><ul>{links(3)}</ul></footer>", f"<div{cls('footer', 'bottom', 'copyright', 'legal')}>{t}</div>"])

    def piece() -> str:
        kind = r.random()
        if kind < 0.7:
            t = prose(int(r.integers(3, 110))) if r.random() < 0.85 else prose(int(r.integers(1, 4)))
            if r.random() < 0.1:
                t = t.rstrip(".,") or t
            article.append(t)
            return pick([f"<p>{esc(t)}</p>", f"<p>{esc(t)}", f"<p><b>{esc(t)}<br>", f"<p class=text>{esc(t)}</p>", f"<div>{esc(t)}</div>", f"<p><em>{esc(t)}</em></p>", f"<p><a href=#>{esc(t)}</a></p>" if len(t) < 60 else f"<p>{esc(t)}</p>"])
        if kind < 0.82:
            t = prose(int(r.integers(1, 9))).rstrip(".")
            article.append(t)
            k = pick(["h2", "h3", "h4"])
            return f"<{k}>{esc(t)}</{k}>"
        if kind < 0.9:
            ts = [prose(int(r.integers(2, 25))) for _ in range(r.integers(2, 5))]
            article.extend(ts)
            k = pick(["ul", "ol"])
            return f"<{k}>" + "".join(f"<li>{esc(t)}</li>" for t in ts) + f"</{k}>"
        if kind < 0.96:
            t = prose(int(r.integers(5, 50)))
            article.append(t)
            k = pick(["blockquote", "pre", "figure><figcaption"])
            return f"<{k}>{esc(t)}</{k.split('<')[-1]}>" + ("</figure>" if "figure" in k else "")
        ts = [prose(int(r.integers(1, 6))) for _ in range(4)]
        article.extend(ts)
        return "<table><tr>" + "".join(f"<td>{esc(t)}</td>" for t in ts[:2]) + "</tr><tr>" + "".join(f"<td>{esc(t)}" for t in ts[2:]) + "</table>"

    title = prose(int(r.integers(2, 10))).rstrip(".")
    body = ""
    if r.random() < 0.85:
        article.append(title)
        body += f"<h1>{esc(title)}</h1>"
    for k in range(int(r.integers(0 if body and r.random() < 0.1 else 1, 16))):
        body += piece()
        if r.random() < 0.06:
            body += pick([advert, side, notice, form])()
    open_, close = pick([("<article>", "</article>"), ("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), (f"<div{cls('content', 'post', 'entry-content', 'article', 'article-body', 'story', 'main', 'post-body', 'text')}>", "</div>"), (f"<section{cls('content', 'article', 'post')}>", "</section>"), (f"<div id=page><div{cls('content', 'post')}><article>", "</article></div></div>"), ("<div>", "</div>")])
    above = [f for f in (header, menu, advert, notice, form, menu) if r.random() < 0.45]
    below = [f for f in (side, comments, advert, notice, form, menu, side) if r.random() < 0.35]
    r.shuffle(above)
    r.shuffle(below)
    if "<article" in open_ and r.random() < 0.15:
        body += comments()
    head = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{esc(title)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
    page = head + "<body>" + "".join(f() for f in above) + pick(["", "<!-- start -->", "\n"]) + open_ + body + close + "".join(f() for f in below) + (footer() if r.random() < 0.85 else "") + "</body></html>"
    return page, article


def _marked(page: str, article: list[str]) -> tuple[list[Block], np.ndarray]:
    """Blocks and flags: the article's texts are met in order."""
    blocks = blocks_of(page)
    y, k = np.zeros(len(blocks), np.float32), 0
    want = [" ".join(t.split()) for t in article]
    for i, (text, _, _) in enumerate(blocks):
        if k < len(want) and text == want[k]:
            y[i], k = 1, k + 1
    return blocks, y


def train(seed: int = 11, pages: int = 1100, epochs: int = 12, batch: int = 30, rate: float = 0.015) -> Labeller:
    """A labeller fitted by Adam to made pages; the same for the same seed."""
    r = np.random.default_rng(seed)
    data = [(vectors(b), y) for b, y in (_marked(*example_page(r)) for _ in range(pages)) if len(b)]
    data.sort(key=lambda d: len(d[1]))
    net = Labeller(seed)
    m, v, step = {k: 0.0 for k in net.p}, {k: 0.0 for k in net.p}, 0
    starts = list(range(0, len(data), batch))
    for epoch in range(epochs):
        r.shuffle(starts)
        for s in starts:
            part = data[s : s + batch]
            _, grad = net.gradients([p for p, _ in part], np.concatenate([y for _, y in part]))
            step += 1
            for k, g in grad.items():
                g = g + 1e-5 * net.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.p[k] = (net.p[k] - rate * (0.6 ** (epoch / 3)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


#: Written by ``save``; the arrays of ``Labeller.p``.
WEIGHTS = Path(__file__).with_name("html_blocks.npz")


def save(path: Path = WEIGHTS) -> None:
    """Train and write the weights, in half precision."""
    np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in train().p.items()})


@cache
def trained() -> Labeller:
    """The labeller of the weights file."""
    net = Labeller()
    with np.load(WEIGHTS) as f:
        net.p = {k: f[k].astype(np.float32) for k in f.files}
    return net


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: page_id, url, text (content blocks joined by line feeds), n_chars.

    A null page counts as empty and has an empty text; rows that repeat are
    extracted each; other columns are ignored; an empty table gives an empty result.
    """
    net = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in tv.pieces(batches, "html", 1 << 20):
            blocks = [blocks_of(h.as_py() or "") for h in rows.column(2)]
            texts = ["\n".join(b[0] for b, ok in zip(bs, flags, strict=True) if ok) for bs, flags in zip(blocks, net.label(blocks), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in src.schema}
    return src.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


if __name__ == "__main__":
    save()
