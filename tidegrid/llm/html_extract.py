"""Main text of web pages by a recurrent block labeller.

A page is read once, by one pattern, into leaf blocks: runs of text between
the tags that begin or end a block. Each block is a vector: hashed names of
the elements and attributes on its tag path, hashed words, and a few shapes
(length, share inside links, marks). A bidirectional LSTM in numpy reads the
whole sequence of a page, so every block is judged in the context of all of
them, and labels it main text or not.

The labeller is trained here, on pages that ``training_pages`` makes from a
seed: articles among menus, headers, footers, sidebars, notices, adverts,
forms, comments and scripts, in varying mark-up, with names of classes from
common lists and at times with none. No page of the corpus is needed for it,
and training again gives the same weights.

Scripts, styles, comments, titles, frames, templates and form fields are never
text; what stands in a drawing, formula or object is judged like all else.
Character references are decoded, white space inside a block becomes one
space, blocks are joined in page order by a line break.

Defined results: a null or empty html, and one without main text, give the
empty text; unclosed and stray tags are tolerated, and a page that ends
inside a tag, comment or raw text (script, style, title, textarea, iframe)
loses only that; rows with one page_id are
extracted each; other columns pass through, and those named as the output
are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import html as entities
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidegrid.llm.common import slices, spread

TOKEN = re.compile(
    # Raw text runs to its end tag or the page's end; the others are skipped only where their own end tag comes first.
    r"<!--.*?(?:-->|\Z)|<(script|style|title|textarea|iframe)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(noscript|template|select)(?=[\s/>])[^>]*>(?:(?!<\2[\s/>]).)*?</\2\s*>"
    # A tag ends at the first > outside quotes, or, where a quote is not closed before the page or the next tag ends, at the first > at all.
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][\w:-]*)([^>]*)>"
    r"|<[!?][^>]*(?:>|\Z)|<[a-zA-Z/][^>]*\Z|([^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
WORDS = re.compile(r"[A-Za-z]+")
DIGITS = re.compile(r"\d")
#: Elements that stand inside a line of text; every other one begins and ends a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr button input".split())
#: So do drawings, formulas and objects, whose text is the labeller's to judge like that around it.
INLINE |= frozenset("svg g defs use symbol path circle ellipse rect line polyline polygon text tspan textpath desc image marker pattern mask filter stop clippath lineargradient radialgradient object".split())
INLINE |= frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd mfenced mspace mstyle mpadded mphantom menclose merror semantics annotation".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tag may be left out: a new one of the group ends an open one.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

PATH, WORD, SHAPES = 128, 48, 10
WIDTH = PATH + WORD + SHAPES


@functools.lru_cache(maxsize=1 << 16)
def bucket(kind: str, name: str, size: int) -> int:
    return zlib.crc32(f"{kind} {name}".encode("utf-8", "surrogatepass")) % size


@functools.lru_cache(maxsize=1 << 12)
def path_buckets(tag: str, attributes: str) -> tuple[int, ...]:
    """Of an element on a path: its tag, and the words of its class, id and role."""
    names = [bucket("tag", tag, PATH)]
    for _, value in ATTRIBUTE.findall(attributes):
        names += [bucket("name", w.lower(), PATH) for w in WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value))]
    return tuple(names)


@dataclass(frozen=True)
class Path:
    """The innermost open block element and those around it: blocks inside one element share it, whatever its depth."""

    tag: str
    names: frozenset[int]  # buckets of all elements on the path
    depth: int
    above: Path | None

    @classmethod
    def inside(cls, above: Path | None, tag: str, own: tuple[int, ...]) -> Path:
        names = above.names if above else frozenset()
        return cls(tag, names if names.issuperset(own) else names.union(own), above.depth + 1 if above else 1, above)


@dataclass
class Block:
    text: str
    path: Path | None
    linked: int  # characters inside links


def blocks_of(source: str) -> list[Block]:
    """The leaf blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, Path | None]] = []  # each open element, with the path of block elements up to it
    count: dict[str, int] = {}  # of the open elements, by name
    parts: list[str] = []
    linked = anchors = 0

    def close(at: int) -> None:
        nonlocal anchors
        for tag, _ in stack[at:]:
            count[tag] -= 1
            anchors -= tag == "a"
        del stack[at:]

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(text, stack[-1][1] if stack else None, linked))
            parts.clear()
        linked = 0

    for m in TOKEN.finditer(source):
        text = m[9]
        if text is not None:
            parts.append(text)
            if anchors:
                linked += len(text.strip())
            continue
        tag = m[4] or m[7]
        if tag is None:
            continue
        tag, ends, attributes = tag.lower(), m[3] or m[6], m[5] or m[8] or ""
        inline = tag in INLINE
        if not inline:
            flush()
        elif tag == "br":
            parts.append(" ")
        if tag in VOID:
            continue
        if ends:
            # An inline end tag never closes a block; a block's end tag closes what is open inside it. Both look no further than they may close, and only for what is open.
            at = len(stack) - 1 if count.get(tag) else -1
            while at >= 0 and stack[at][0] != tag:
                at = -1 if inline and stack[at][0] not in INLINE else at - 1
            if at >= 0:
                close(at)
        else:
            if tag in ENDS:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ENDS[tag]:
                        close(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
            if not attributes.endswith("/"):
                above = stack[-1][1] if stack else None
                stack.append((tag, above if inline else Path.inside(above, tag, path_buckets(tag, attributes if "=" in attributes else ""))))
                count[tag] = count.get(tag, 0) + 1
                anchors += tag == "a"
    flush()
    return out


def vectors(blocks: list[Block]) -> np.ndarray:
    n = len(blocks)
    x = np.zeros((n, WIDTH), np.float32)
    path, words, weights, shapes = [], [], [], []
    for i, b in enumerate(blocks):
        base = i * WIDTH
        if b.path:
            path += [base + k for k in b.path.names]
        own = b.text.lower().split()
        words += [base + PATH + (bucket if len(w) <= 40 else bucket.__wrapped__)("word", w, WORD) for w in own]
        # A block of up to 12 words adds them up, a longer one has the mean of 12.
        weights += [0.3 * min(1, 12 / len(own))] * len(own)
        size = len(b.text)
        shapes.append(
            (
                min(size, 400) / 400,
                min(size, 60) / 60,
                min(b.linked / size, 1),
                b.text[-1] in ".!?…:;\"'»”",
                (b.text.count(",") + b.text.count(".")) / (1 + size / 20),
                len(DIGITS.findall(b.text)) / size,
                i / n,
                1 / (1 + i),
                1 / (n - i),
                (b.path.depth if b.path else 0) / 10,
            )
        )
    x.ravel()[path] = 1
    np.add.at(x.ravel(), words, np.array(weights, np.float32))
    x[:, PATH + WORD :] = shapes
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction, over a batch of padded sequences (time x batch x width); padding does not change the state."""

    def __init__(self, wide: int, hidden: int, r: np.random.Generator):
        self.h = hidden
        self.wx = (r.normal(size=(wide, 4 * hidden)) * wide**-0.5).astype(np.float32)
        self.wh = (r.normal(size=(hidden, 4 * hidden)) * hidden**-0.5).astype(np.float32)
        self.b = np.zeros(4 * hidden, np.float32)
        self.b[hidden : 2 * hidden] = 1  # remember at first

    def forward(self, x, mask, keep=False):
        t, n, _ = x.shape
        k = self.h
        z = x.reshape(t * n, -1) @ self.wx
        z = z.reshape(t, n, -1) + self.b
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        out, held = np.zeros((t, n, k), np.float32), []
        for s in range(t):
            a = z[s] + h @ self.wh
            gates = sigmoid(a[:, : 3 * k])
            i, f, o, g = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :], np.tanh(a[:, 3 * k :])
            m = mask[s][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep:
                held.append((i, f, o, g, c, tanh, h))
            c = np.where(m, new, c)
            h = np.where(m, o * tanh, h)
            out[s] = h
        self.held = (x, mask, held)
        return out

    def backward(self, d_out):
        x, mask, held = self.held
        t, n, wide = x.shape
        k = self.h
        d_wh = np.zeros_like(self.wh)
        d_z = np.zeros((t, n, 4 * k), np.float32)
        d_h, d_c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        for s in range(t - 1, -1, -1):
            i, f, o, g, c, tanh, h = held[s]
            m = mask[s][:, None]
            d_h = d_h + d_out[s]
            dh, dc = np.where(m, d_h, 0), np.where(m, d_c, 0)
            dc = dc + dh * o * (1 - tanh**2)
            a = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            d_z[s] = a
            d_wh += h.T @ a
            d_h = np.where(m, a @ self.wh.T, d_h)
            d_c = np.where(m, dc * f, d_c)
        flat = d_z.reshape(t * n, -1)
        return [x.reshape(t * n, wide).T @ flat, d_wh, flat.sum(0)]


class Labeller:
    """Two directions and a logistic output for each block."""

    def __init__(self, hidden: int = 20, seed: int = 5):
        r = np.random.default_rng(seed)
        self.ahead, self.back = Lstm(WIDTH, hidden, r), Lstm(WIDTH, hidden, r)
        self.w = (r.normal(size=2 * hidden + WIDTH) * 0.1).astype(np.float32)
        self.b = np.zeros(1, np.float32)

    @property
    def weights(self):
        return [self.ahead.wx, self.ahead.wh, self.ahead.b, self.back.wx, self.back.wh, self.back.b, self.w, self.b]

    def logits(self, x, mask, keep=False):
        both = np.concatenate([self.ahead.forward(x, mask, keep), self.back.forward(x[::-1], mask[::-1], keep)[::-1], x], axis=2)
        return both @ self.w + self.b, both

    def step(self, x, mask, y):
        """Gradients of the mean log loss over the batch's blocks."""
        z, both = self.logits(x, mask, keep=True)
        d = np.where(mask, sigmoid(z) - y, 0).astype(np.float32) / mask.sum()
        d_both = d[:, :, None] * self.w
        k = self.ahead.h
        return [
            *self.ahead.backward(d_both[:, :, :k]),
            *self.back.backward(d_both[::-1, :, k : 2 * k]),
            np.einsum("tn,tnk->k", d, both),
            d.sum(keepdims=True).reshape(1),
        ]

    def label(self, pages: list[list[Block]]) -> list[list[bool]]:
        """Whether each block is main text; pages of like length go together."""
        out: list[list[bool]] = [[] for _ in pages]
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        start = 0
        while start < len(order):
            end = start + 1
            while end < len(order) and end - start < 256 and (end - start + 1) * len(pages[order[end]]) <= 8000:
                end += 1
            own = order[start:end]
            x, mask = padded([vectors(pages[i]) for i in own])
            z, _ = self.logits(x, mask)
            for j, i in enumerate(own):
                out[i] = (z[: len(pages[i]), j] > 0).tolist()
            start = end
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x, mask = np.zeros((t, len(pages), WIDTH), np.float32), np.zeros((t, len(pages)), bool)
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, True
    return x, mask


def train(pages: int = 1000, epochs: int = 5, batch: int = 24, rate: float = 0.01, seed: int = 5) -> Labeller:
    """Adam over made pages; the same seed gives the same weights."""
    from tidegrid.llm.html_training import training_pages

    made = []
    for source, main in training_pages(pages, seed):
        blocks = blocks_of(source)
        made.append((vectors(blocks), np.array([b.text in main for b in blocks], np.float32)))
    made.sort(key=lambda p: len(p[0]))
    model, r = Labeller(seed=seed), np.random.default_rng(seed)
    first = [np.zeros_like(w) for w in model.weights]
    second = [np.zeros_like(w) for w in model.weights]
    starts, n = list(range(0, len(made), batch)), 0
    for epoch in range(epochs):
        for s in r.permutation(starts):
            own = made[s : s + batch]
            x, mask = padded([p[0] for p in own])
            y = np.zeros(mask.shape, np.float32)
            for j, p in enumerate(own):
                y[: len(p[1]), j] = p[1]
            n += 1
            lr = rate * (0.5 ** max(0, epoch - 1))
            for w, g, a, b in zip(model.weights, model.step(x, mask, y), first, second):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= (lr * (a / (1 - 0.9**n)) / (np.sqrt(b / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
    model.ahead.held = model.back.held = None
    return model


@functools.lru_cache(maxsize=1)
def labeller() -> Labeller:
    return train()


def extract_text(model: Labeller, pages: list[str | None]) -> list[str]:
    """The main text of each page."""
    read = [blocks_of(p or "") for p in pages]
    return ["\n".join(b.text for b, keep in zip(blocks, kept) if keep) for blocks, kept in zip(read, model.label(read))]


def extract(df: DataFrame, model: Labeller | None = None, html: str = "html", text: str = "text") -> DataFrame:
    """Adds the main text; one pass, no shuffle. The model, some hundred kilobytes, goes with the tasks."""
    model = model or labeller()
    kept = [c for c in df.columns if c != text]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(text, T.StringType())])

    def run(batches):
        for batch in slices(batches, html):
            texts = extract_text(model, batch.column(html).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(texts, pa.string())], names=[*kept, text])

    return spread(df).mapInArrow(run, schema)
