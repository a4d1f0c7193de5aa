"""Exact repeats of ``WIDTH`` words anywhere in a text, whatever its lines and sentences.

Each window of ``WIDTH`` words names the smallest hash among its ``GRAM``-word
grams as its anchor, so that equal windows have equal anchors at equal offsets.
Neighbouring windows mostly share an anchor: an anchor stands for a range of
windows, and its context is all the words of that range. Only anchors that occur
twice are looked at again. An occurrence whose context has an earlier one
repeats as a whole; of an anchor with several contexts the first occurrences
are compared window by window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pavement.llm.columns import give_back, gram_hashes
from pavement.llm.neardup import BROADCAST_ROWS, keep_known
from pavement.plans.storage import dropped, written

WIDTH = 50
GRAM = 20
STEP = 5  # the hash of a window is made from the hashes of so many words each
BLOCK = 1 << 18  # characters of the texts that are cut by the same calls

#: What ``anchors`` finds, as flat columns: fingerprint, context, word of the anchor, first and last start of its windows.
ANCHOR = (("fp", np.int64), ("ctx", np.int64), ("at", np.int32), ("lo", np.int32), ("hi", np.int32))


def hashed(words: list[bytes]) -> np.ndarray:
    """One 64-bit code per word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def lowered(text: str) -> list[bytes]:
    """The lower-cased words: bytes are split at \\x20 and \\x09-\\x0D, which no letter's case depends on or turns into."""
    return text.lower().encode("utf-8").split()


def word_places(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words' spans in code points, the last byte of each and the line it is in."""
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.flatnonzero(np.diff(inside))
    start, last = edge[::2], edge[1::2] - 1
    lines = np.searchsorted(np.flatnonzero(raw == 10), start)
    if len(raw) == len(text):
        return start, last + 1, raw[last], lines
    points = np.cumsum((raw & 0xC0) != 0x80)
    return points[start] - 1, points[last], raw[last], lines


def _long_grams(codes: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash per run of ``n`` words, a multiple of ``STEP``."""
    parts = gram_hashes(codes, (STEP,), n)[0]
    count = max(0, len(codes) - n + 1)
    h = np.full(count, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, n, STEP):
            h ^= parts[k:k + count]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def _codes(text: str | None) -> np.ndarray:
    return hashed(lowered(text or ""))


class Words:
    """The words of several texts after each other: codes, code-point spans, last bytes, lines and the number of the text."""

    def __init__(self, texts: list[str]):
        whole = "\n".join(texts)  # a text ends a line, and no letter's case depends on what is beyond a line feed
        start, end, self.last, self.line = word_places(whole)
        base = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        self.text = np.searchsorted(base, start, "right") - 1
        self.start, self.end = start - base[self.text], end - base[self.text]
        self.codes = hashed(lowered(whole))
        #: the number of each text's first word
        self.first = np.searchsorted(self.text, np.arange(len(texts)))


def word_blocks(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """Ranges of texts (end exclusive) of about ``BLOCK`` characters and their words; null texts are empty."""
    begin, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t.as_py() or "")
        size += len(held[-1]) + 1
        if size >= BLOCK or i == len(texts) - 1:
            yield begin, i + 1, Words(held)
            begin, held, size = i + 1, [], 0


def named(codes: np.ndarray, begins: np.ndarray, stops: np.ndarray, seeds: np.ndarray | None = None) -> np.ndarray:
    """64-bit names of several runs of words."""
    raw, digest = memoryview(codes).cast("B"), xxhash.xxh3_64_intdigest
    ranges = zip((8 * begins).tolist(), (8 * stops).tolist(), (np.zeros_like(begins) if seeds is None else seeds).tolist())
    return np.fromiter((digest(raw[a:b], s) for a, b, s in ranges), np.uint64, len(begins)).view(np.int64)


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the first smallest of every ``width`` neighbours, by doubling."""
    at, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        right = values[step:] < values[:-step]
        at, values = np.where(right, at[step:], at[:-step]), np.where(right, values[step:], values[:-step])
        size += step
    return at


def anchors(words: Words) -> tuple[np.ndarray, ...]:
    """The anchors as columns (``ANCHOR``, places within their text) and the text of each; short texts have none."""
    codes, text = words.codes, words.text
    starts = np.flatnonzero(text[:max(0, len(codes) - WIDTH + 1)] == text[WIDTH - 1:])
    if not len(starts):
        return (*(np.empty(0, kind) for _, kind in ANCHOR), np.empty(0, np.int64))
    grams = gram_hashes(codes, (GRAM,), GRAM)[0]
    at = _smallest(grams, WIDTH - GRAM + 1)[starts]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    lows, highs, at = starts[first], starts[np.append(first[1:], len(starts)) - 1], at[first]
    ctx, owner = named(codes, lows, highs + WIDTH, at - lows), text[lows]
    base = words.first[owner]
    return (grams[at].view(np.int64), ctx, *((x - base).astype(np.int32) for x in (at, lows, highs)), owner)


def joined(parts: list[np.ndarray], kind) -> np.ndarray:
    """The parts of one flat column after each other."""
    return np.concatenate(parts) if parts else np.empty(0, kind)


def struct_lists(sizes: list[int], columns: list[tuple[str, np.ndarray]]) -> pa.ListArray:
    """Lists of structs from flat columns; ``sizes`` are the lists' lengths."""
    values = pa.StructArray.from_arrays([pa.array(c) for _, c in columns], names=[n for n, _ in columns])
    return pa.ListArray.from_arrays(np.cumsum([0, *sizes]).astype(np.int32), values)


def _hashes(texts: pa.Array, lows: pa.Array, highs: pa.Array) -> pa.Array:
    """For each range the hashes of its windows."""
    sizes, lengths, flat = [0], [], []
    for t, lo, hi in zip(texts, lows, highs):
        h = _long_grams(_codes(t.as_py()), WIDTH).view(np.int64)
        lo, hi = lo.values.to_numpy(), hi.values.to_numpy()
        sizes.append(len(lo))
        lengths.append(hi - lo + 1)
        flat += [h[a:b + 1] for a, b in zip(lo, hi)]
    inner = np.concatenate([[0], np.cumsum(joined(lengths, np.int64))]).astype(np.int32)
    made = pa.ListArray.from_arrays(np.cumsum(sizes).astype(np.int32), pa.ListArray.from_arrays(inner, joined(flat, np.int64)))
    del flat
    give_back()
    return made


def _placed(texts: pa.Array, begins: pa.Array, stops: pa.Array) -> pa.Array:
    """Word ranges, merged, with their code-point spans."""
    sizes, parts = [], []
    for t, begin, stop in zip(texts, begins, stops):
        begin, stop = begin.values.to_numpy(), stop.values.to_numpy()
        order = np.lexsort((stop, begin))
        begin, reach = begin[order], np.maximum.accumulate(stop[order])
        first = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]]))
        begin, stop = begin[first], np.append(reach[first[1:] - 1], reach[-1])
        start, end, _, _ = word_places(t.as_py())
        sizes.append(len(begin))
        parts.append((begin, stop, start[begin], end[stop - 1]))
    names = ("begin", "stop", "start", "end")
    return struct_lists(sizes, [(n, joined([p[i] for p in parts], np.int32).astype(np.int32)) for i, n in enumerate(names)])


def _few(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side


def repeated_windows(found: DataFrame, keyed: DataFrame) -> DataFrame:
    """(row, windows, window_ids) of the rows to cut, from their anchors and, where these do not decide, their texts.

    ``found``: (row, _id, body, a), ``a`` lists of ``ANCHOR`` structs; ``keyed``: (row,
    _text). Rows of one ``row`` are alike and count once. ``windows`` are the word
    ranges and spans covered by windows that occur earlier, by id, text digest and
    place; words of that first occurrence stay, also where it overlaps.
    ``window_ids`` are the ids of the first occurrences.
    """
    flat = found.select("row", "_id", "body", F.explode("a").alias("a")).select("row", "_id", "body", "a.*")
    # the places are compared, not counted, so that rows which repeat as a whole are no second occurrence
    where = F.xxhash64("row", "at")
    twice = written(flat.groupBy("fp").agg(F.min(where).alias("p1"), F.max(where).alias("p2"), F.min("ctx").alias("c1"), F.max("ctx").alias("c2"))
                    .where("p1 <> p2").select("fp", (F.col("c1") != F.col("c2")).alias("several")))
    rows = written(flat.join(_few(twice), "fp"))  # rows of one ``row`` give the same spans, which are sets below
    place = F.struct("_id", "body", "row", "at", "lo", "hi")
    firsts = written(rows.groupBy("fp", "ctx").agg(F.min(place).alias("f"), F.max("several").alias("several")))
    # the first occurrence keeps its words
    begin = lambda own, lo, stop: F.when(own, F.greatest(lo, stop)).otherwise(lo)
    later = (rows.join(firsts.select("fp", "ctx", "f"), ["fp", "ctx"])
             .where("row <> f.row OR at <> f.at")
             .select("row", begin(F.col("row") == F.col("f.row"), F.col("lo"), F.col("f.hi") + WIDTH).alias("begin"),
                     (F.col("hi") + WIDTH).alias("stop"), F.col("f._id").alias("first_id")))
    wanted = written(firsts.where("several").select("fp", "f.*").groupBy("row", "_id", "body")
                     .agg(F.collect_list(F.struct("fp", "at", "lo", "hi")).alias("r")))
    texts = keyed.select("row", "_text")  # the tables that meet them are written: the optimizer knows their bytes
    # only the texts that are asked for are shuffled
    made = (keep_known(texts, wanted.select("row"), "row").join(wanted, "row").dropDuplicates(["row"])
            .withColumn("h", F.arrow_udf(_hashes, "array<array<long>>")("_text", "r.lo", "r.hi"))
            .select("row", "_id", "body", F.explode(F.arrays_zip("r", "h")).alias("z"))
            .select("row", "_id", "body", "z.r.fp", "z.r.at", "z.r.lo", F.posexplode("z.h").alias("i", "h"))
            .select("row", "_id", "body", "fp", "h", (F.col("lo") + F.col("i")).alias("s"), (F.col("lo") + F.col("i") - F.col("at")).alias("off")))
    made = written(made)
    same = ["fp", "off", "h"]
    first = (made.groupBy(same).agg(F.count("*").alias("c"), F.min(F.struct("_id", "body", "row", "s")).alias("f")).where("c > 1"))
    partly = (made.join(first, same).where("row <> f.row OR s <> f.s")
              .select("row", begin(F.col("row") == F.col("f.row"), F.col("s"), F.col("f.s") + WIDTH).alias("begin"),
                      (F.col("s") + WIDTH).alias("stop"), F.col("f._id").alias("first_id")))
    spans = written(later.union(partly).where("begin < stop").groupBy("row")
                    .agg(F.collect_set(F.struct("begin", "stop")).alias("w"), F.collect_set("first_id").alias("window_ids")))
    dropped(twice, rows, firsts, wanted, made)
    return written(keep_known(texts, spans.select("row"), "row").join(spans, "row").dropDuplicates(["row"]).select(
        "row", F.arrow_udf(_placed, "array<struct<begin:int,stop:int,start:int,end:int>>")("_text", "w.begin", "w.stop").alias("windows"),
        "window_ids"))
