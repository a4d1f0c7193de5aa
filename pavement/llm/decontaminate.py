"""Benchmark decontamination: a hash set of normalised test n-grams scanned over training texts.

A benchmark item gives windows of ``width`` consecutive normalised words (one
shorter window if it has fewer words). The set of all windows is counted first;
below ``limit`` windows it is shipped to the executors and every text is scanned
once, in place, with no shuffle. Above it, texts send the hash of each of their
windows to a join with the windows of the benchmark, and only the hits come
back. In the scan a hash hit counts only after its words were compared; in the
join, equal 128-bit digests are taken as equal words.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pavement.llm.columns import arrow_struct, fresh, give_back, with_struct
from pavement.plans.storage import written

WIDTH = 10
LIMIT = 2_000_000
#: Words of the contract, over UTF-8 bytes: letters, digits and everything beyond ASCII.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The same words before lower-casing.
_CASED = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_MULT = 0x9E3779B97F4A7C15
_MASK = 0xFFFFFFFFFFFFFFFF

HITS = ("n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>")
_HITS = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
         ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]


def normalised(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text."""
    return _WORD.findall(text.encode("utf-8").lower()) if text else []


def item_windows(text: str | None, width: int = WIDTH) -> list[tuple[bytes, ...]]:
    """All windows of a benchmark item."""
    words = normalised(text)
    if not words:
        return []
    if len(words) <= width:
        return [tuple(words)]
    return [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]


class Windows:
    """The benchmark windows, looked up by length and rolling hash, then by their words."""

    def __init__(self, items: list[tuple[str, str | None]], width: int = WIDTH):
        self.items: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            for window in item_windows(text, width):
                self.items.setdefault(window, set()).add(item)
        self.code: dict[bytes, int] = {}
        for window in self.items:
            for word in window:
                self.code.setdefault(word, len(self.code) + 1)
        self.sizes = sorted({len(w) for w in self.items})
        self.known = {n: np.unique(np.array([self._hash(w) for w in self.items if len(w) == n], np.uint64))
                      for n in self.sizes}

    def _hash(self, window: tuple[bytes, ...]) -> int:
        h = 0
        for word in window:
            h = (h * _MULT + self.code[word]) & _MASK
        return h

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items that hit them."""
        codes = np.fromiter(map(self.code.get, words, [0] * len(words)), np.uint64, len(words))
        hit, items = np.zeros(len(words), bool), set()
        for n in self.sizes:
            if n > len(words):
                break
            m = len(words) - n + 1
            # windows of benchmark words only: the last unknown word lies before the window
            unknown = np.where(codes == 0, np.arange(len(words)), -1)
            last = np.maximum.accumulate(unknown)[n - 1:]
            starts = np.flatnonzero(last < np.arange(m))
            if not len(starts):
                continue
            h = np.zeros(len(starts), np.uint64)
            with np.errstate(over="ignore"):
                for i in range(n):
                    h = h * np.uint64(_MULT) + codes[starts + i]
            for at in starts[np.isin(h, self.known[n])].tolist():
                found = self.items.get(tuple(words[at:at + n]))  # the words decide, not the hash
                if found:
                    hit[at:at + n] = True
                    items |= found
        return hit, items


def word_spans(text: str) -> list[tuple[int, int]]:
    """Code-point spans of the normalised words, in order."""
    return [m.span() for m in _CASED.finditer(text)]


def hit_spans(text: str, hit: np.ndarray) -> list[dict]:
    """Maximal runs of hit words as code-point spans, from first to last word."""
    if not hit.any():
        return []
    places = word_spans(text)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in edge.reshape(-1, 2).tolist()]


def _scanner(items: list[tuple[str, str | None]], width: int):
    shared = {}

    @F.arrow_udf(HITS)
    def scan(texts: pa.Array) -> pa.Array:
        if "w" not in shared:
            shared["w"] = Windows(items, width)
        rows = []
        for scalar in texts:
            text = scalar.as_py()
            words = normalised(text)
            hit, found = shared["w"].scan(words)
            rows.append((len(words), int(hit.sum()), sorted(found), hit_spans(text or "", hit)))
        return arrow_struct(_HITS, rows)

    return scan


def bounded_items(benchmark: DataFrame, item: str, text: str, width: int, limit: int):
    """The items as a list if all their windows together are at most ``limit``, else None."""
    sizes = benchmark.agg(F.coalesce(F.sum(F.length(f"`{text}`")), F.lit(0)).alias("c"),
                          F.count("*").alias("n")).first()
    # a window begins at a word, a word has a character and, but for the last, a space behind it
    if sizes.c // 2 + sizes.n > limit * 4:
        return None
    rows = [(str(r[0]), r[1]) for r in benchmark.select(F.col(f"`{item}`"), F.col(f"`{text}`")).collect()]
    return rows if sum(len(item_windows(t, width)) for _, t in rows) <= limit else None


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                  item_text: str = "text", width: int = WIDTH, limit: int = LIMIT) -> tuple[DataFrame, str]:
    """``docs`` with a struct (n_words, n_hit, items, spans) per row, and the struct's name.

    ``items`` are the ids (as strings, sorted) with an occurring window, ``spans``
    the maximal hit runs in code points. Null and empty texts have no words and no
    hits; an empty benchmark hits nothing; items of null id count as item "None"
    of their own; repeated rows are treated alike; other columns pass through.
    """
    items = bounded_items(benchmark, item, item_text, width, limit)
    if items is not None:
        return with_struct(docs, text, _scanner(items, width), "_hits")
    return _joined(docs, benchmark, text, item, item_text, width)


def _joined(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str,
            width: int) -> tuple[DataFrame, str]:
    """The way for benchmarks of any size: windows meet in a join, keyed by their words' digest."""
    window = "array<struct<key:binary,at:int,n:int>>"
    shape = pa.list_(pa.struct([("key", pa.binary()), ("at", pa.int32()), ("n", pa.int32())]))

    def digest(words) -> bytes:
        return hashlib.blake2b(b" ".join(words), digest_size=16).digest()

    @F.arrow_udf(window)
    def of_items(texts: pa.Array) -> pa.Array:
        return pa.array([[{"key": digest(w), "at": 0, "n": len(w)} for w in item_windows(t.as_py(), width)]
                         for t in texts], shape)

    bench = (benchmark.select(F.col(f"`{item}`").cast("string").alias("_item"), of_items(F.col(f"`{item_text}`")).alias("_w"))
             .select(F.coalesce("_item", F.lit("None")).alias("_item"), F.explode("_w").alias("_w"))
             .select("_item", "_w.key", "_w.n").distinct())
    sizes = [r[0] for r in bench.select("n").distinct().collect()]  # at most ``width`` numbers

    @F.arrow_udf(window)
    def of_docs(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            words = normalised(t.as_py())
            rows.append([{"key": digest(words[i:i + n]), "at": i, "n": n}
                         for n in sizes for i in range(len(words) - n + 1)])
        return pa.array(rows, shape)

    row, out = fresh(docs, "_row"), fresh(docs, "_hits")
    ids, places = fresh(docs, "_items"), fresh(docs, "_places")
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()))
    hits = (keyed.select(row, F.explode(of_docs(F.col(f"`{text}`"))).alias("_w"))
            .select(row, F.col("_w.key").alias("key"), F.col("_w.at").alias("at"), F.col("_w.n").alias("n"))
            .join(bench.drop("n"), "key")
            .groupBy(row).agg(F.collect_set("_item").alias(ids),
                              F.collect_set(F.struct("at", "n")).alias(places)))

    @F.arrow_udf(HITS)
    def spans(texts: pa.Array, found: pa.Array, at: pa.Array) -> pa.Array:
        rows = []
        for t, i, p in zip(texts, found, at):
            text_, words = t.as_py(), normalised(t.as_py())
            hit = np.zeros(len(words), bool)
            for x in p.as_py() or []:
                hit[x["at"]:x["at"] + x["n"]] = True
            rows.append((len(words), int(hit.sum()), sorted(i.as_py() or []), hit_spans(text_ or "", hit)))
        return arrow_struct(_HITS, rows)

    joined = keyed.join(hits, row, "left").withColumn(out, spans(F.col(f"`{text}`"), F.col(ids), F.col(places)))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], out), out


def cut_spans(text: str, spans: list[dict]) -> str:
    """``text`` without the spans."""
    out, at = [], 0
    for s in spans:
        out.append(text[at:s["start"]])
        at = s["end"]
    return "".join([*out, text[at:]])


def _cleaner(items: list[tuple[str, str | None]], width: int):
    """Scan and cut in one function, so that a task needs one Python worker and not two."""
    shared = {}

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        if "w" not in shared:
            shared["w"] = Windows(items, width)
        out = []
        for scalar in texts:
            text = scalar.as_py()
            out.append(text and cut_spans(text, hit_spans(text, shared["w"].scan(normalised(text))[0])))
        cleaned = pa.array(out, pa.string())
        del out
        give_back()
        return cleaned

    return clean


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", text: str = "text", item: str = "item_id",
                   item_text: str = "text", width: int = WIDTH, limit: int = LIMIT) -> DataFrame:
    """``docs`` without what hits the benchmark: the hit spans, or whole ``documents`` that have any.

    The columns are those of ``docs``; null texts stay null.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is spans or documents, not {remove}")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    items = bounded_items(benchmark, item, item_text, width, limit)
    if remove == "spans" and items is not None:
        return docs.withColumn(text, _cleaner(items, width)(F.col(f"`{text}`"))).select(*columns)
    found, name = (with_struct(docs, text, _scanner(items, width), "_hits") if items is not None
                   else _joined(docs, benchmark, text, item, item_text, width))
    if remove == "documents":
        return found.where(F.col(f"{name}.n_hit") == 0).select(*columns)

    @F.arrow_udf("string")
    def clean(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([t.as_py() if t.as_py() is None or not s.as_py() else cut_spans(t.as_py(), s.as_py())
                         for t, s in zip(texts, spans)], pa.string())

    return found.withColumn(text, clean(F.col(f"`{text}`"), F.col(f"{name}.spans"))).select(*columns)
