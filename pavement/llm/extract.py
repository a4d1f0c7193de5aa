"""HTML extraction by a recurrent block labeller.

A page is a sequence of leaf blocks. Each becomes a vector of its hashed tag
path, its hashed words and a few figures of its text; a bidirectional LSTM in
numpy reads the whole sequence and says of every block whether it belongs to
the article, so that each verdict uses the context of the whole document.

The labeller is fitted here, in one Spark task, on a bounded sample of the
pages. Blocks of the sample get silver labels from the meaning of their tags,
and every page is shown in several dresses: its article and its surroundings
are put into other containers (main, content, post; sidebar, comments, notice,
form and so on), with texts of other pages as surroundings, so that the
labeller learns roles and context instead of one site's template.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pavement.llm.blocks import Block, blocks
from pavement.llm.columns import arrow_struct, order_key, with_struct

PATHS, WORDS, FIGURES, HIDDEN = 512, 32, 5, 12
WIDTH = PATHS + WORDS + FIGURES
#: Pages that the labeller is fitted on, at most, dresses per page, and blocks of a training sequence.
SAMPLE = 300
DRESSES = 3
LONGEST = 48
EPOCHS = 8

#: Tag and class words that tell a block's role in a page of the sample.
OUTSIDE = frozenset(
    "nav header footer aside form ad ads advert advertisement banner sidebar menu comment comments notice cookie consent "
    "promo sponsor share social related breadcrumb subscribe newsletter popup modal login search widget pager button".split())
INSIDE = frozenset("article main content post entry story".split())
_IN = (("article",), ("main",), ("main", "article"), ("div", "content"), ("div", "main", "content"), ("section", "post"),
       ("div", "article", "body"), ("div", "post", "entry", "content"), ("div", "story"), ("section", "article"))
_OUT = (("nav",), ("nav", "ul", "li"), ("header",), ("header", "div"), ("footer",), ("footer", "p"), ("aside",), ("aside", "p"),
        ("aside", "ul", "li"), ("div", "sidebar"), ("div", "sidebar", "ul", "li"), ("div", "ad"), ("div", "ads", "banner"),
        ("div", "advert"), ("div", "advertisement"), ("form",), ("form", "p"), ("form", "div"), ("div", "menu", "ul", "li"),
        ("div", "comments"), ("section", "comments", "div", "comment", "p"), ("div", "comment"), ("ul", "comments", "li", "comment", "p"),
        ("ol", "comment", "list", "li", "p"), ("div", "notice"), ("div", "cookie", "notice", "p"), ("div", "cookie", "consent"),
        ("div", "promo"), ("div", "sponsor"), ("div", "share"), ("div", "social"), ("div", "related"), ("section", "related", "ul", "li"),
        ("div", "breadcrumb"), ("div", "subscribe"), ("div", "newsletter", "form"), ("div", "popup"), ("div", "modal"), ("div", "login", "form"),
        ("div", "search"), ("div", "widget"), ("div", "footer"), ("div", "header"), ("div", "nav"), ("div", "pager"))


def path_slots(path: tuple[str, ...]) -> list[int]:
    """Slots of the distinct names of a tag path."""
    return sorted({zlib.crc32(name.encode()) % PATHS for name in path})


def text_vector(block: Block) -> np.ndarray:
    """Hashed words and figures of one block, over its whole text."""
    v = np.empty(WORDS + FIGURES, np.float32)
    words = block.text.encode("utf-8").split()
    at = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % WORDS
    v[:WORDS] = np.bincount(at, minlength=WORDS)
    v[:WORDS] /= np.sqrt(len(words))
    v[WORDS:] = (np.log1p(len(words)) / 4, block.linked / len(block.text), block.text[-1] in ".!?…\"'»”",
                 sum(map(block.text.count, ".,;:")) / len(words), min(len(block.path), 12) / 12)
    return v


def vector(block: Block) -> np.ndarray:
    """All features of one block."""
    v = np.zeros(WIDTH, np.float32)
    v[path_slots(block.path)] = 1
    v[PATHS:] = text_vector(block)
    return v


class Labeller:
    """A bidirectional LSTM with a logistic unit per block."""

    NAMES = ("xf", "hf", "bf", "xb", "hb", "bb", "o", "c")

    def __init__(self, parts: dict[str, np.ndarray]):
        self.p = parts
        self.paths: dict[tuple[str, ...], tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def new(cls, seed: int = 1) -> Labeller:
        g = np.random.default_rng(seed)
        p = {"o": g.normal(0, 0.3, 2 * HIDDEN), "c": np.zeros(1)}
        for d in "fb":
            p["x" + d] = g.normal(0, 0.1, (WIDTH, 4 * HIDDEN))
            p["h" + d] = g.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            p["b" + d] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str):
        """One direction over x (time, page, feature); the states and what the way back needs."""
        t, n, _ = x.shape
        return self._steps((x.reshape(t * n, -1) @ self.p["x" + d]).reshape(t, n, -1) + self.p["b" + d], mask, d)

    def _steps(self, into: np.ndarray, mask: np.ndarray, d: str, keep: bool = True):
        """The recurrence over what the features put into the gates."""
        t, n, _ = into.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        states, saved = np.zeros((t, n, HIDDEN), np.float32), []
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = into[s] + h @ self.p["h" + d]
            gate = 1 / (1 + np.exp(-z[:, :3 * HIDDEN]))
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN:2 * HIDDEN], gate[:, 2 * HIDDEN:]
            g = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[s][:, None]
            new = f * c + i * g
            if keep:
                saved.append((s, h, c, i, f, o, g, new, m))
            h, c = m * (o * np.tanh(new)) + (1 - m) * h, m * new + (1 - m) * c
            states[s] = h
        return states, saved

    def probability(self, pages: list[list[Block]]) -> np.ndarray:
        """(time, page): how likely each block of the pages belongs to the article."""
        t, n, places = max(map(len, pages)), len(pages), []
        mask, text = np.zeros((t, n), np.float32), np.zeros((t, n, WORDS + FIGURES), np.float32)
        for j, page in enumerate(pages):
            mask[:len(page), j] = 1
            for s, block in enumerate(page):
                text[s, j] = text_vector(block)
                places.append((s, j, self._path(block.path)))
        states = []
        for k, d in enumerate("fb"):
            into = (text.reshape(t * n, -1) @ self.p["x" + d][PATHS:]).reshape(t, n, -1) + self.p["b" + d]
            for s, j, path in places:
                into[s, j] += path[k]
            states.append(self._steps(into, mask, d, keep=False)[0])
        return 1 / (1 + np.exp(-(np.concatenate(states, axis=2) @ self.p["o"] + self.p["c"])))

    def _path(self, path: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        """What a tag path puts into the gates of both directions; paths repeat, so it is remembered."""
        got = self.paths.get(path)
        if got is None:
            if len(self.paths) > 20_000:
                self.paths.clear()
            at = path_slots(path)
            got = self.paths[path] = (self.p["xf"][at].sum(0), self.p["xb"][at].sum(0))
        return got

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over the real blocks."""
        runs = {d: self._run(x, mask, d) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        p = 1 / (1 + np.exp(-(both @ self.p["o"] + self.p["c"])))
        dz = (p - y) * mask / max(mask.sum(), 1)
        grad = {"o": np.einsum("tn,tnk->k", dz, both), "c": np.array([dz.sum()])}
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            dstates = dz[:, :, None] * self.p["o"][part]
            dinto = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            dh_rec = np.zeros_like(self.p["h" + d])
            dh, dc = np.zeros((mask.shape[1], HIDDEN), np.float32), np.zeros((mask.shape[1], HIDDEN), np.float32)
            for s, h0, c0, i, f, o, g, new, m in reversed(runs[d][1]):
                dh = dh + dstates[s]
                th = np.tanh(new)
                dnew = m * (dc + dh * o * (1 - th * th))
                a = np.concatenate([dnew * g * i * (1 - i), dnew * c0 * f * (1 - f), m * dh * th * o * (1 - o),
                                    dnew * i * (1 - g * g)], axis=1)
                dinto[s] = a
                dh_rec += h0.T @ a
                dh, dc = a @ self.p["h" + d].T + (1 - m) * dh, dnew * f + (1 - m) * dc
            flat = dinto.reshape(-1, 4 * HIDDEN)
            grad |= {"x" + d: x.reshape(len(flat), -1).T @ flat, "h" + d: dh_rec, "b" + d: flat.sum(0)}
        return grad

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.02, seed: int = 2) -> Labeller:
        """Adam over batches of sequences (vectors, labels)."""
        draw, step = np.random.default_rng(seed), 0
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for _ in range(epochs):
            order = draw.permutation(len(sequences))
            for at in range(0, len(order), 32):
                x, mask, y = padded([sequences[i] for i in order[at:at + 32]])
                step += 1
                for k, g in self.gradient(x, mask, y).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self

    def to_bytes(self) -> bytes:
        return b"".join(self.p[k].astype("<f4").tobytes() for k in self.NAMES)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Labeller:
        flat, at, parts = np.frombuffer(raw, "<f4"), 0, {}
        shapes = cls.new().p
        for k in cls.NAMES:
            parts[k] = flat[at:at + shapes[k].size].reshape(shapes[k].shape)
            at += shapes[k].size
        return cls(parts)


def padded(batch: list[tuple[np.ndarray, np.ndarray]]):
    t, n = max(len(y) for _, y in batch), len(batch)
    x, mask, y = np.zeros((t, n, WIDTH), np.float32), np.zeros((t, n), np.float32), np.zeros((t, n), np.float32)
    for j, (v, labels) in enumerate(batch):
        x[:len(labels), j], mask[:len(labels), j], y[:len(labels), j] = v, 1, labels
    return x, mask, y


def silver(page: list[Block]) -> list[int]:
    """What the tags of a page say of its blocks; where they name no article, long unlinked blocks are it."""
    inside = [bool(INSIDE & set(b.path)) and not OUTSIDE & set(b.path) for b in page]
    if any(inside):
        return [int(x) for x in inside]
    return [int(not OUTSIDE & set(b.path) and b.linked * 3 < len(b.text) and len(b.text.split()) >= 8) for b in page]


def dressed(page: list[Block], labels: list[int], others: list[str], draw: random.Random) -> tuple[list[Block], list[int]]:
    """The page's article in another container among other surroundings."""
    root = draw.choice([("html", "body"), ("html", "body", "div"), ("html", "body", "div", "page"), ("html", "body", "div", "wrapper", "container")])
    home = (*root, *draw.choice(_IN))
    within = [b for b, y in zip(page, labels) if y]

    def outer(most: int, base: tuple[str, ...]) -> list[Block]:
        found = []
        for _ in range(draw.randrange(most + 1)):
            role = (*base, *draw.choice(_OUT))
            for _ in range(draw.choice([1, 1, 2, 4])):
                text = draw.choice(others)
                text = " ".join(text.split()[:draw.choice([1, 2, 6, 15, 60])])
                found.append(Block(role, text, len(text) if draw.random() < 0.4 else 0))
        return found

    def inner(b: Block) -> Block:
        last = b.path[-1] if b.path else "p"
        text = b.text
        if draw.random() < 0.3:  # a short line or a headline
            last, text = draw.choice(("h1", "h2", "h3", "p", "li", "td", "p")), " ".join(text.split()[:draw.randrange(1, 8)])
        last = last if last in ("h1", "h2", "h3", "p", "li", "pre", "td") else draw.choice(("p", "h2", "li", "pre"))
        return Block((*home, last), text, min(b.linked, len(text)))

    front, body, back = outer(4, root), [inner(b) for b in within], outer(4, root)
    if body and draw.random() < 0.5:  # an advert, form or comment within the article
        at = draw.randrange(len(body) + 1)
        extra = outer(2, home)
        labels_ = [1] * at + [0] * len(extra) + [1] * (len(body) - at)
        body = body[:at] + extra + body[at:]
    else:
        labels_ = [1] * len(body)
    return front + body + back, [0] * len(front) + labels_ + [0] * len(back)


def fit_labeller(pages: list[str], seed: int = 4) -> Labeller:
    """A labeller from sample pages, as they are and in other dresses."""
    draw = random.Random(seed)
    parsed = [p for p in map(blocks, pages) if p]
    others = [b.text for p in parsed for b in p][:20_000] or ["nothing"]
    sequences = []
    for page in parsed:
        labels = silver(page)
        shown = [(page, labels)] + [dressed(page, labels, others, draw) for _ in range(DRESSES)]
        for found, y in shown:
            for at in range(0, len(found), LONGEST):
                part = found[at:at + LONGEST]
                sequences.append((np.stack([vector(b) for b in part]), np.array(y[at:at + LONGEST], np.float32)))
    return Labeller.new().fit(sequences) if sequences else Labeller.new()


def train(pages: DataFrame, id_: str = "page_id", html: str = "html", sample: int = SAMPLE, seed: int = 6) -> Labeller:
    """Fit on at most ``sample`` pages, those with the smallest seeded md5 of their id, in one task."""
    picked = (pages.where(F.col(f"`{html}`").isNotNull()).select(order_key(F.col(f"`{id_}`"), seed).alias("k"), F.col(f"`{html}`").alias("h"))
              .orderBy("k", F.md5(F.col("h").cast("binary"))).limit(sample).withColumn("g", F.lit(0)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"m": [fit_labeller(pdf.sort_values(["k", "h"])["h"].tolist()).to_bytes()]})

    got = picked.groupBy("g").applyInPandas(run, "m binary").collect()
    return Labeller.from_bytes(bytes(got[0].m)) if got else Labeller.new()


def label_pages(labeller: Labeller, pages: list[list[Block]], cells: int = 12_000) -> list[np.ndarray]:
    """Probabilities of the blocks of each page; pages of like length share a batch of bounded size."""
    order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
    out: list[np.ndarray] = [np.empty(0)] * len(pages)
    batch: list[int] = []

    def done() -> None:
        p = labeller.probability([pages[i] for i in batch])
        for j, i in enumerate(batch):
            out[i] = p[:len(pages[i]), j]

    for i in order:
        if not pages[i]:
            continue
        if batch and (len(batch) + 1) * len(pages[i]) > cells:
            done()
            batch = []
        batch.append(i)
    if batch:
        done()
    return out


def main_text(pages: DataFrame, labeller: Labeller, html: str = "html") -> tuple[DataFrame, str]:
    """``pages`` with a struct (text, n_chars, n_blocks, n_kept) per row, and the struct's name.

    Null and empty pages, and pages without an article, have an empty text.
    Repeated rows are treated alike; other columns pass through.
    """
    raw = labeller.to_bytes()
    fields = [("text", pa.string()), ("n_chars", pa.int64()), ("n_blocks", pa.int64()), ("n_kept", pa.int64())]

    @F.arrow_udf("text string, n_chars long, n_blocks long, n_kept long")
    def extract(column: pa.Array) -> pa.Array:
        model, rows = Labeller.from_bytes(raw), []
        for at in range(0, len(column), 256):
            found = [blocks(h.as_py()) for h in column[at:at + 256]]
            for page, p in zip(found, label_pages(model, found)):
                kept = [b.text for b, x in zip(page, p) if x >= 0.5]
                text = "\n".join(kept)
                rows.append((text, len(text), len(page), len(kept)))
        return arrow_struct(fields, rows)

    return with_struct(pages, html, extract, "_main")
