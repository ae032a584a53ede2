"""HTML extraction: a recurrent labeller of a page's blocks.

A page is cut into leaf blocks: text between block-level tags, each with the path of tags above it. A block
becomes a vector of hashed path parts, hashed words and a few measures; a bidirectional LSTM in numpy reads a page's
blocks in order, and every block is classed as main text or not from both directions' states. The network is
trained here on pages made by rule, whose blocks carry their labels; inference runs in Arrow batches of pages.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PATH_DIM, WORD_DIM, MEASURES = 256, 128, 8
HIDDEN = 24
EPOCHS, BATCH, RATE = 6, 32, 0.01
PAGES = 600
#: Blocks of a page whose wide vectors are held at once.
ROWS = 4096

#: A comment, a tag, or another declaration. Each alternative matches to the end of the page if it is never closed, so that
#: no stretch is read twice. A quote counts after an equals sign and if it is closed; any other one is a character as others.
_tag = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL,
)
_attr = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
#: Elements whose content is no text, those of them that end only with their end tag, what a head holds, elements inside a line, elements that end an open one of their kind, and elements without content.
SILENT = {"title", "script", "style", "noscript", "template", "svg", "head", "iframe", "textarea", "select", "object"}
RAW = {"script", "style", "textarea", "title"}
HEAD_SILENT = {"title", "script", "style", "noscript", "template"}
HEAD = HEAD_SILENT | {"head", "meta", "link", "base"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
ENDS_ITS_KIND = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "tr", "td", "th", "option"}
VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class Block:
    """Text of a block, the hashed parts of its path (a bit for each), and how many of its characters are in links."""

    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: int, linked: int) -> None:
        self.text, self.path, self.linked = text, path, linked


class Path:
    """The open elements of a place in a page, and the parts of their path; keeping it costs no more than the tags read."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, list[int]]] = []
        self.open: dict[str, int] = {}
        self.times = [0] * PATH_DIM
        self.bits = 0

    def push(self, name: str, parts: list[str]) -> None:
        own = [crc32(p.encode()) % PATH_DIM for p in parts]
        for k in own:
            self.times[k] += 1
            self.bits |= 1 << k
        self.stack.append((name, own))
        self.open[name] = self.open.get(name, 0) + 1

    def pop(self) -> str:
        name, own = self.stack.pop()
        for k in own:
            self.times[k] -= 1
            if not self.times[k]:
                self.bits ^= 1 << k
        self.open[name] -= 1
        return name

    def end(self, name: str) -> None:
        """An end tag closes the last open element of its name and all within; without one it says nothing."""
        if self.open.get(name):
            while self.pop() != name:
                pass


def _silent_end(html: str, name: str, at: int, never: set[str]) -> int:
    """Where the content of a silent element ends. Without its end tag only RAW ones go on to the end of the page; of others the tag alone is skipped.

    never: names found to have no end tag any more.
    """
    over = None if name in never else re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(html, at)
    if over:
        return over.end()
    never.add(name)
    return len(html) if name in RAW else at


def _head_end(html: str, at: int, never: set[str]) -> int:
    """Where the head ends: after its end tag, or before the first tag or text that belongs to the body. never is the page's, as for _silent_end()."""
    while m := _tag.search(html, at):
        if html[at : m.start()].strip():
            return at
        name = (m[2] or "").lower()
        if name == "head" and m[1]:
            return m.end()
        if name and name not in HEAD:
            return m.start()
        at = m.end()
        if name in HEAD_SILENT and not m[1]:
            at = _silent_end(html, name, at, never)
    return at


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page with any text, in page order; character references decoded, white space made one space."""
    out: list[Block] = []
    path = Path()
    held: list[str] = []
    inside = linked = 0
    never: set[str] = set()

    def close() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(held)).split())
        if text:
            out.append(Block(text, path.bits, linked))
        held.clear()
        linked = 0

    at, end = 0, len(html)
    while at < end:
        m = _tag.search(html, at)
        piece = html[at : m.start() if m else end]
        held.append(piece)
        if inside:
            linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in SILENT:
            if not m[1] and not m[3].rstrip().endswith("/"):
                close()
                at = _head_end(html, at, never) if name == "head" else _silent_end(html, name, at, never)
            continue
        if name in INLINE:
            if name == "a":
                inside = 0 if m[1] else 1
            continue
        if name == "br" or name == "wbr":
            held.append(" ")
            continue
        close()
        inside = 0
        if name in VOID:
            continue
        if m[1]:
            path.end(name)
        else:
            if name in ENDS_ITS_KIND:
                while path.stack and path.stack[-1][0] in (name, "p"):
                    path.pop()
            path.push(name, [name, *(w for a in _attr.findall(m[3]) for w in re.split(r"[^a-z]+", "".join(a).lower()) if w)])
    close()
    return out


_buckets: dict[str, int] = {}


def _bucket(word: str) -> int:
    b = _buckets.get(word)
    if b is None:
        if len(_buckets) > 300_000:
            _buckets.clear()
        b = _buckets[word] = crc32(word.lower().encode()) % WORD_DIM
    return b


def vectors(page: list[Block], first: int = 0, last: int | None = None, total: int | None = None) -> np.ndarray:
    """One row per block from `first` to before `last`: hashed path parts, shares of hashed words (all of them), and measures of the block and its place."""
    total = sum(len(b.text) for b in page) if total is None else total
    part = page[first:last]
    x = np.zeros((len(part), PATH_DIM + WORD_DIM + MEASURES), np.float32)
    bits = np.frombuffer(b"".join(b.path.to_bytes(PATH_DIM // 8, "little") for b in part), np.uint8)
    x[:, :PATH_DIM] = np.unpackbits(bits.reshape(len(part), -1), axis=1, bitorder="little")
    for i, b in enumerate(part):
        words = b.text.split()
        n = len(words)
        counts = np.bincount(np.fromiter(map(_bucket, words), np.int64, n), minlength=WORD_DIM)
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = counts / max(n, 1) ** 0.5
        ends = b.text.count(".") + b.text.count(",")
        x[i, PATH_DIM + WORD_DIM :] = (
            min(np.log1p(n) / 5, 2), min(b.linked / len(b.text), 1), min(ends / max(n, 1), 1), (first + i) / len(page), len(b.text) / max(total, 1),
            b.text[-1] in ".!?…", sum(c.isdigit() for c in b.text) / len(b.text), 1,
        )
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """Input layer, an LSTM in each direction, and a logistic output on both states."""

    def __init__(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        h, d = HIDDEN, PATH_DIM + WORD_DIM + MEASURES
        mat = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {"in": mat(d, h) * 3, "out": mat(2 * h, 1), "bias": np.zeros(1, np.float32)}
        for k in "fb":
            self.p |= {f"{k}x": mat(h, 4 * h), f"{k}h": mat(h, 4 * h), f"{k}c": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)}

    def _run(self, u: np.ndarray, on: np.ndarray, k: str, tape: list | None = None) -> np.ndarray:
        """States of one direction over (pages, blocks, hidden); rows that have ended keep theirs. A tape, kept for training only, takes what each step went through."""
        n, length, h = u.shape
        s, c = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out = np.zeros((n, length, h), np.float32)
        for t in range(length) if k == "f" else range(length - 1, -1, -1):
            z = u[:, t] @ self.p[k + "x"] + s @ self.p[k + "h"] + self.p[k + "c"]
            i, f, o, g = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h]), np.tanh(z[:, 3 * h :])
            m = on[:, t, None]
            c2 = np.where(m, f * c + i * g, c)
            s2 = np.where(m, o * np.tanh(c2), s)
            if tape is not None:
                tape.append((t, s, c, c2, i, f, o, g))
            s, c = s2, c2
            out[:, t] = s
        return out

    def enter(self, x: np.ndarray) -> np.ndarray:
        """The input layer: HIDDEN numbers of each block."""
        return np.tanh(x @ self.p["in"])

    def forward(self, u: np.ndarray, on: np.ndarray, tapes: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """How likely each block is main text, from what entered, and both directions' states."""
        both = np.concatenate([self._run(u, on, k, tapes[i] if tapes else None) for i, k in enumerate("fb")], 2)
        return _sigmoid((both @ self.p["out"])[..., 0] + self.p["bias"]), both

    def gradient(self, x: np.ndarray, on: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy per block, by backpropagation through both directions."""
        u, tapes = self.enter(x), ([], [])
        q, both = self.forward(u, on, tapes)
        h = HIDDEN
        d = np.where(on, q - y, 0).astype(np.float32) / on.sum()
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"] = (both * d[..., None]).sum((0, 1))[:, None]
        g["bias"] = d.sum(keepdims=True).reshape(1)
        ds = d[..., None] * self.p["out"][:, 0]
        du = np.zeros_like(u)
        for k, tape, own in (("f", tapes[0], ds[..., :h]), ("b", tapes[1], ds[..., h:])):
            s_next, c_next = np.zeros_like(u[:, 0]), np.zeros_like(u[:, 0])
            for t, s, c, c2, i, f, o, gg in reversed(tape):
                m = on[:, t, None]
                s_in = s_next + own[:, t]
                th = np.tanh(c2)
                dc = np.where(m, s_in * o * (1 - th * th), 0) + c_next
                dz = np.where(m, np.concatenate([dc * gg * i * (1 - i), dc * c * f * (1 - f), s_in * th * o * (1 - o), dc * i * (1 - gg * gg)], 1), 0)
                g[k + "x"] += u[:, t].T @ dz
                g[k + "h"] += s.T @ dz
                g[k + "c"] += dz.sum(0)
                du[:, t] += dz @ self.p[k + "x"].T
                s_next = np.where(m, dz @ self.p[k + "h"].T, s_in)
                c_next = np.where(m, dc * f, c_next)
        du *= 1 - u * u
        g["in"] = x.reshape(-1, x.shape[2]).T @ du.reshape(-1, h)
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], seed: int = 5) -> Labeller:
        r = np.random.default_rng(seed)
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        it = 0
        for _ in range(EPOCHS):
            order = r.permutation(len(pages))
            for at in range(0, len(order), BATCH):
                x, on, y = padded([pages[i] for i in order[at : at + BATCH]])
                it += 1
                for k, g in self.gradient(x, on, y).items():
                    a, b = m[k]
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    self.p[k] -= (RATE * (a / (1 - 0.9**it)) / (np.sqrt(b / (1 - 0.99**it)) + 1e-8)).astype(np.float32)
        return self

    def main(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Which blocks of each page are main text, from the vectors that entered; pages of like length share a batch of bounded cells, a longer page is one alone."""
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        out: list[np.ndarray] = [np.zeros(0, bool) for _ in pages]
        at = 0
        while at < len(order):
            size = max(1, min(64, 20_000 // max(1, len(pages[order[min(at + 64, len(order)) - 1]]))))
            part = order[at : at + size]
            at += size
            x, on, _ = padded([(pages[i], np.zeros(len(pages[i]))) for i in part])
            q = self.forward(x, on)[0]
            for i, row in zip(part, q, strict=True):
                out[i] = row[: len(pages[i])] > 0.5
        return out

    def read(self, page: list[Block]) -> np.ndarray:
        """What enters of a page's blocks, a run of ROWS of their wide vectors at a time."""
        total = sum(len(b.text) for b in page)
        runs = [self.enter(vectors(page, at, at + ROWS, total)) for at in range(0, len(page), ROWS)]
        return np.concatenate([np.zeros((0, HIDDEN), np.float32), *runs])


def padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = max(1, max(len(y) for _, y in pages))
    x = np.zeros((len(pages), length, pages[0][0].shape[1]), np.float32)
    on, y = np.zeros((len(pages), length), bool), np.zeros((len(pages), length), np.float32)
    for i, (v, label) in enumerate(pages):
        x[i, : len(label)], on[i, : len(label)], y[i, : len(label)] = v, True, label
    return x, on, y


def training_page(r: random.Random) -> str:
    """A page made by rule. Its main blocks begin with the character \x01, which is taken off before they are read."""
    word = lambda: "".join(r.choice("the an er ti on re ou la que ei sch ción en ie ble nd".split()) for _ in range(r.randint(1, 4)))
    said = lambda a, b: " ".join(word() + r.choice(["", "", "", ",", ".", "***", "&amp;"]) for _ in range(r.randint(a, b))).capitalize() + r.choice([".", ".", "", "!"])
    pick = lambda *xs: r.choice(xs)
    links = lambda n: "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(n))
    menu = lambda: pick(f"<nav><ul>{links(r.randint(2, 9))}</ul></nav>", f'<ul class="{pick("menu", "nav", "navbar breadcrumb")}">{links(r.randint(2, 6))}</ul>', f'<div id="{pick("nav", "menu", "navigation")}"><a>{word()}</a> | <a>{word()}</a></div>')
    ad = lambda: f'<div class="{pick("ad", "ads", "advert", "banner ad", "sponsored", "promo")}">{said(1, 14)}</div>'
    notice = lambda: f'<div class="{pick("cookie", "notice", "cookie-banner", "consent", "alert notice", "popup newsletter")}">{pick(f"<p>{said(3, 15)}</p>", said(3, 15))}</div>'
    form = lambda: f'<form><label>{said(1, 3)}</label><p>{said(2, 6)}</p><input name="q"><button>{word()}</button></form>'
    side = lambda: f'{(t := pick("<aside>|</aside>", "<div class=sidebar>|</div>", chr(60) + "div id=" + chr(34) + "related" + chr(34) + ">|</div>").split("|"))[0]}<h3>{said(1, 3)}</h3><ul>{links(r.randint(1, 5))}</ul><p>{said(2, 20)}</p>{t[1]}'
    comments = lambda: f'<{(t := pick("section", "div"))} class="{pick("comments", "comment-list", "reader-comments")}"><h2>{pick("Comments", said(1, 3))}</h2>' + "".join(f'<{(e := pick("div", "article", "li"))} class="comment"><p>{said(2, 40)}</p></{e}>' for _ in range(r.randint(1, 4))) + f"</{t}>"
    header = lambda: f'<header>{pick(f"<h1>{said(1, 4)}</h1>", f"<p>{said(1, 6)}</p>", "")}<p class="{pick("tagline", "logo", "site-title")}">{said(1, 5)}</p></header>'
    footer = lambda: pick(f"<footer>&copy; {word()}.example.org &middot; {said(2, 20)}</footer>", f'<footer><p>{said(3, 15)}</p><ul>{links(r.randint(1, 4))}</ul></footer>', f'<div id="footer" class="footer"><p>&copy; {said(2, 14)}</p></div>')
    main = f"<h1>\x01{said(2, 10)}</h1>"
    for _ in range(r.choice([1, 2, 3, 6, 12, 25])):
        inner = r.random()
        main += (
            f"<p>\x01{said(1, 90)}</p>" if inner < 0.65 else f"<p><b>\x01{said(1, 40)}<br>" if inner < 0.75 else f"<h2>\x01{said(1, 6)}</h2>" if inner < 0.82
            else f"<ul>{''.join(f'<li>{chr(1)}{said(1, 15)}</li>' for _ in range(r.randint(1, 5)))}</ul>" if inner < 0.88 else f"<blockquote><p>\x01{said(3, 30)}</p></blockquote>" if inner < 0.91
            else f"<p>\x01{said(1, 9)} <a href='/x'>{said(1, 4)}</a> {said(1, 20)}</p>" if inner < 0.95 else f"<table><tr><td>\x01{said(1, 5)}</td><td>\x01{said(1, 5)}</td></tr></table>" if inner < 0.97 else pick(ad, form, notice, side)()
        )
    kind = r.random()
    around = ("<article>|</article>" if kind < 0.55 else "<main><article>|</article></main>" if kind < 0.7 else "<main>|</main>" if kind < 0.8 else f'<div class="{pick("content", "article-body", "post entry", "main-content")}">|</div>' if kind < 0.93 else '<div id="content">|</div>').split("|")
    before = [f() for f in r.sample([menu, ad, notice, header, form, side], r.randint(0, 5))]
    after = [f() for f in r.sample([ad, side, comments, form, notice, menu], r.randint(0, 4))] + [footer()] * (r.random() < 0.9)
    page = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{said(2, 8)}</title><style>p{{}}</style></head><body>{"".join(before)}<!-- {word()} -->{around[0]}{main}{around[1]}{"".join(after)}</body></html>'
    return page[: r.randint(len(page) * 2 // 3, len(page))] if r.random() < 0.1 else page


def labelled_pages(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    r = random.Random(seed)
    out = []
    for _ in range(n):
        page = blocks(training_page(r))
        y = np.array([b.text.startswith("\x01") for b in page], np.float32)
        for b in page:
            b.text = b.text.replace("\x01", "").strip() or "x"
        if page:
            out.append((vectors(page), y))
    return out


_labeller: Labeller | None = None


def trained() -> Labeller:
    """The labeller, trained on PAGES pages made by rule once per process."""
    global _labeller
    if _labeller is None:
        _labeller = Labeller().fit(labelled_pages(PAGES, 3))
    return _labeller


def _extract(model: Labeller):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                pages = [blocks(h or "") for h in part.column(2).to_pylist()]
                kept = model.main([model.read(p) for p in pages])
                texts = ["\n\n".join(x.text for x, k in zip(p, keep.tolist(), strict=True) if k) for p, keep in zip(pages, kept, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages.

    Null or empty html, or a page without main text, gives an empty text; null ids and urls stay null; repeated rows get
    a row each; other columns are ignored; an empty table gives an empty table. No shuffle.
    """
    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(_extract(trained()), "page_id long, url string, text string, n_chars long")


op9 = main_text
