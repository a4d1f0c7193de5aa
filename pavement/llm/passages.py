"""Substring dedup: MinHash banding of paragraph pieces, exact verification, removals by component.

A paragraph (a line) is cut at its sentence ends, short sentences joining the
next one, so that a passage inside a longer paragraph has pieces of its own. The
pieces' sets of 5-word shingles are min-hashed; bands are tuned to a recall at
the similarity threshold. Pieces that share a band are compared with the
smallest of the bucket and, where that leaves several components, with each
other; every link is confirmed by exact Jaccard similarity. A component with
two or more occurrences is a repeat; all but its first occurrence are removed
where a run of repeated pieces has at least ``LEAST_RUN`` words, so that stock
phrases in clean documents stay.

Passages that do not line up with pieces are found by their words: what lies in
an equal run of ``windows.WIDTH`` words with an earlier occurrence is removed too.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pavement.llm.columns import give_back, gram_hashes
from pavement.llm.decontaminate import cut_spans
from pavement.llm.neardup import BROADCAST_ROWS, Joiner, branches_for, keep_known, signatures
from pavement.llm.windows import ANCHOR, anchors, joined, lowered, named, repeated_windows, struct_lists, word_blocks, word_places
from pavement.plans.storage import dropped, written

SHINGLE = 5
PERCENT = 80
RECALL = 0.99
ROWS = 2
LEAST_PIECE = 8
LEAST_RUN = 15

_DRAW = np.random.default_rng(77)


def bands_for(percent: int, rows: int = ROWS, recall: float = RECALL) -> int:
    """Bands of ``rows`` min-hashes that catch a pair at the threshold with the given probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** rows))


BANDS = bands_for(PERCENT)
#: Branches of large buckets, for the same recall of bands and branchings together.
BRANCHES = branches_for(PERCENT, lambda _, s: (1 - (PERCENT / 100) ** ROWS * s) ** BANDS)
_A = _DRAW.integers(1, 2 ** 62, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _DRAW.integers(0, 2 ** 63, ROWS * BANDS, dtype=np.uint64)


def _firsts(last: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The number of the word each piece begins with, and the end, from the words' last bytes and lines."""
    number, breaks = np.arange(len(line)), np.diff(line) > 0
    ends = (last == ord(".")) | (last == ord("!")) | (last == ord("?"))
    # a sentence's words are counted from the line's begin or the sentence end before
    sentence = np.maximum.accumulate(np.where(np.append(True, breaks | ends[:-1]), number, 0))
    closes = np.append(breaks, True) | (ends & (number - sentence + 1 >= LEAST_PIECE))
    return np.append(0, np.flatnonzero(closes) + 1)


def pieces(text: str | None) -> tuple[list[tuple[int, int]], list[int], list[bytes]]:
    """Code-point spans of the pieces, the number of the word each begins with (and the end), and all words.

    A piece ends at a line's end, and after a sentence end (. ! ? at a word's
    end) if the sentence has ``LEAST_PIECE`` words. Words are lower-cased.
    """
    start, end, last, line = word_places(text or "")
    if not len(start):
        return [], [0], []
    firsts = _firsts(last, line)
    return list(zip(start[firsts[:-1]].tolist(), end[firsts[1:] - 1].tolist())), firsts.tolist(), lowered(text)


def banded(grams: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Band hashes, one row of ``BANDS`` per range of ``grams``; the ranges ascend and have gaps between them."""
    places = np.stack([begins, stops], axis=1).ravel()
    places = places[:-1] if len(places) and places[-1] == len(grams) else places
    low = np.empty((ROWS * BANDS, len(begins)), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(ROWS * BANDS if len(begins) else 0):
            low[i] = np.minimum.reduceat((grams * _A[i] + _B[i]) >> np.uint64(24), places)[::2]
        h = np.zeros((BANDS, len(begins)), np.uint64)
        for r in range(ROWS):
            h = (h ^ low[r * BANDS:(r + 1) * BANDS]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        h += np.arange(BANDS, dtype=np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93)
    return h.T.view(np.int64)


CUT = ("u array<struct<start:int,end:int,n:int,key:long,bands:array<long>>>, "
       "a array<struct<fp:long,ctx:long,at:int,lo:int,hi:int>>")


def _cut(texts: pa.Array) -> pa.Array:
    """Per document its pieces (span, words, key and bands) and the anchors of its windows, as flat columns."""
    sizes, start, end, count, key, bands, has, met, found = [], [], [], [], [], [], [], [], []
    for a, b, words in word_blocks(texts):
        found.append(anchors(words))
        met.append(np.bincount(found[-1][-1], minlength=b - a))
        if not len(words.codes):
            sizes.append(np.zeros(b - a, np.int64))
            continue
        firsts = _firsts(words.last, words.line)
        begins, stops = firsts[:-1], firsts[1:]
        sizes.append(np.bincount(words.text[begins], minlength=b - a))
        start.append(words.start[begins].astype(np.int32))
        end.append(words.end[stops - 1].astype(np.int32))
        count.append((stops - begins).astype(np.int32))
        key.append(named(words.codes, begins, stops))
        # a piece of few words has too few shingles to be like another without being equal
        long_ = count[-1] >= LEAST_PIECE
        bands.append(banded(gram_hashes(words.codes, (SHINGLE,), SHINGLE)[0], begins[long_], stops[long_] - SHINGLE + 1).ravel())
        has.append(long_)
    ends = np.concatenate(([0], np.cumsum(joined(has, bool) * BANDS))).astype(np.int32)
    units = struct_lists(joined(sizes, np.int64), [("start", joined(start, np.int32)), ("end", joined(end, np.int32)), ("n", joined(count, np.int32)),
                                                   ("key", joined(key, np.int64)), ("bands", pa.ListArray.from_arrays(ends, joined(bands, np.int64)))])
    marked = struct_lists(joined(met, np.int64), [(n, joined([f[i] for f in found], kind)) for i, (n, kind) in enumerate(ANCHOR)])
    made = pa.StructArray.from_arrays([units, marked], names=["u", "a"])
    del start, end, count, key, bands, has, found
    give_back()
    return made


def _sets(texts: pa.Array, wanted: pa.Array | None = None) -> pa.Array:
    """Per document the keys of its pieces and their sets of shingle hashes, sorted.

    ``wanted``: the keys that are asked for in each text, given once each; else all pieces.
    """
    sizes, keys, lengths, flat = [], [], [], []
    for a, b, words in word_blocks(texts):
        firsts = _firsts(words.last, words.line) if len(words.codes) else np.zeros(1, np.int64)
        names = named(words.codes, firsts[:-1], firsts[1:])
        owner, take = words.text[firsts[:-1]], np.arange(len(names))
        if wanted is not None:
            left = [set(w.as_py() or []) for w in wanted[a:b]]
            take = np.array([i for i, (o, k) in enumerate(zip(owner.tolist(), names.tolist())) if k in left[o] and not left[o].remove(k)], np.int64)
        sizes.append(np.bincount(owner[take], minlength=b - a))
        if not len(take):
            continue
        keys.append(names[take])
        # a piece of fewer words is one shingle
        grams = gram_hashes(words.codes, tuple(range(1, SHINGLE + 1)), SHINGLE)
        held = [grams[min(SHINGLE, y - x) - 1][x:max(x, y - SHINGLE) + 1] for x, y in zip(firsts[take].tolist(), firsts[take + 1].tolist())]
        piece, values = np.repeat(np.arange(len(held)), [len(h) for h in held]), np.concatenate(held)
        order = np.lexsort((values, piece))
        values = values[order]
        once = (np.diff(values, prepend=values[0]) != 0) | (np.diff(piece, prepend=-1) != 0)  # the order leaves the pieces in place
        flat.append(values[once])
        lengths.append(np.bincount(piece[once]))
    ends = np.cumsum(np.concatenate([[0], 8 * joined(lengths, np.int64)])).astype(np.int32)
    flat = pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(joined(flat, np.uint64))])
    made = struct_lists(joined(sizes, np.int64), [("key", joined(keys, np.int64)), ("set", flat)])
    del keys, lengths
    give_back()
    return made


def _sets_of(texts: pa.Array, keys: pa.Array) -> pa.Array:
    return _sets(texts, keys)


def _signatures(sets: pa.Array) -> pa.Array:
    raw = [s.as_py() for s in sets]
    return pa.array(signatures(np.frombuffer(b"".join(raw), np.uint64), np.array([len(s) // 8 for s in raw], np.int64)), pa.binary())


class _Lists:
    """A column of lists of structs as flat columns and the place of each list in them; null lists are empty."""

    def __init__(self, lists: pa.ListArray):
        self.at = lists.offsets.to_numpy()
        self.values = lists.values

    def column(self, name: str) -> np.ndarray:
        return self.values.field(name).to_numpy(zero_copy_only=False)

    def place(self, i: int) -> slice:
        return slice(self.at[i], self.at[i + 1])


def _runs(units: pa.Array, marks: pa.Array, windows: pa.Array, ids: pa.Array) -> pa.Array:
    """Per document: its figures and the removed spans."""
    u, m, w = _Lists(units), _Lists(marks), _Lists(windows)
    n_words, starts, ends = u.column("n"), u.column("start"), u.column("end")
    seqs, own = m.column("seq"), m.column("first").astype(bool)
    sources, known = m.values.field("first_id").fill_null(0).to_numpy(), m.values.field("first_id").is_valid().to_numpy(zero_copy_only=False)
    range_ = [w.column(c) for c in ("begin", "stop", "start", "end")]
    figures, from_, span_start, span_end = [], [], [], []
    for i in range(len(units)):
        mine, marked = u.place(i), m.place(i)
        n, seq = n_words[mine], seqs[marked]
        if not len(seq) and w.place(i).start == w.place(i).stop:  # most documents have no repeats
            figures.append((len(n), 0, 0, 0, 0))
            from_.append(np.empty(0, np.int64))
            span_start.append(np.empty(0, np.int32))
            span_end.append(span_start[-1])
            continue
        words = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        # runs of neighbouring repeats; those of enough words count
        edge = np.zeros(len(n) + 2, np.int8)
        edge[seq + 1] = 1
        edge = np.flatnonzero(np.diff(edge))
        begins, stops = edge[::2], edge[1::2]
        enough = words[stops] - words[begins] >= LEAST_RUN
        change = np.zeros(len(n) + 1, np.int64)
        np.add.at(change, begins[enough], 1)
        np.add.at(change, stops[enough], -1)
        repeats = np.cumsum(change)[:-1] > 0
        counted = repeats[seq]
        removed = np.sort(seq[counted & ~own[marked]])
        ids_here = ids[i].values
        from_.append(np.unique(np.concatenate([sources[marked][counted & known[marked]],
                                               (ids_here.drop_null() if ids_here is not None else pa.array([], pa.int64())).to_numpy()])))
        parts = [np.concatenate([a, b[w.place(i)]]) for a, b in
                 zip((words[removed], words[removed + 1], starts[mine][removed], ends[mine][removed]), range_)]
        begin, stop, start, end = (p[np.lexsort(parts[::-1])] for p in parts)
        before = np.concatenate([[-1], np.maximum.accumulate(stop)])[:len(stop)]
        first = np.flatnonzero(begin > before)
        span_start.append(start[first])
        span_end.append(np.maximum.reduceat(end, first) if len(first) else end)
        figures.append((len(n), repeats.sum(), len(removed), np.maximum(0, stop - np.maximum(begin, before)).sum(),
                        (span_end[-1] - span_start[-1]).sum()))
    table = np.array(figures, np.int64).reshape(-1, 5)
    spans = struct_lists([len(s) for s in span_start], [("start", joined(span_start, np.int32).astype(np.int32)),
                                                        ("end", joined(span_end, np.int32).astype(np.int32))])
    first_ids = pa.ListArray.from_arrays(np.cumsum([0, *map(len, from_)]).astype(np.int32), joined(from_, np.int64).astype(np.int64))
    names = ["n_pieces", "n_repeated", "n_removed", "removed_words", "removed_chars", "first_ids", "spans"]
    made = pa.StructArray.from_arrays([*[pa.array(table[:, k].copy()) for k in range(5)], first_ids, spans], names=names)
    del figures, from_, span_start, span_end
    give_back()
    return made


RUNS = ("n_pieces long, n_repeated long, n_removed long, removed_words long, removed_chars long, first_ids array<long>, "
        "spans array<struct<start:int,end:int>>")


def _few(side: DataFrame) -> DataFrame:
    """A written side table of one or two 64-bit numbers a row: broadcast while it is small, else joined by a shuffle."""
    return F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side


def repeated_passages(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, row_hash, figures, ``first_ids`` and the removed spans (code points).

    ``n_repeated`` counts the pieces in runs of repeats, first occurrences
    included; ``n_removed`` those cut as repeats; ``removed_words`` and the spans
    hold these and the words of repeated windows; ``first_ids`` are the (integer) ids of the
    documents in which the repeats of this one occur first. Occurrences are
    ordered by id, then text digest, then place; rows of null id come first and
    give no first id. Fully repeated rows count as one document: what repeats
    only in them is no removal, and they are cut alike. Null and empty texts have
    no pieces. Only the two columns are read; builds tables while the plan is built.
    """
    body, ids = F.col(f"`{text}`"), F.col(f"`{id_}`").cast("long")
    # the text is left out: the tables below are narrow, and the last step reads the texts again
    row = F.xxhash64(ids, body)
    cut = written(docs.select(row.alias("row"), ids.alias("_id"), F.xxhash64(body).alias("body"), F.arrow_udf(_cut, CUT)(body).alias("c"))
                  .select("row", "_id", "body", "c.u", "c.a"))
    units = cut.select("row", "_id", "body", F.posexplode("u").alias("seq", "p")).select(
        "row", "_id", "body", "seq", F.col("p.key").alias("key"), F.col("p.bands").alias("bands"))
    # equal pieces fold before the shuffle, so bands are exploded once per different piece and not per occurrence
    # places are compared, not counted: rows that repeat as a whole are no second occurrence
    place = F.xxhash64("row", "seq")
    one = written(units.groupBy("key").agg(*[F.min(F.get("bands", F.lit(i))).alias(f"b{i}") for i in range(BANDS)],
                                           (F.min(place) != F.max(place)).alias("twice")).where("b0 IS NOT NULL OR twice"))
    hits = one.where("b0 IS NOT NULL").select("key", F.explode(F.array(*[f"b{i}" for i in range(BANDS)])).alias("node"))
    buckets = written(hits.groupBy("node").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("node"))
    nodes = written(hits.join(_few(buckets), "node").select("node", F.col("key").alias("class")))
    spent, labels = [one, buckets, nodes], None  # what is not read after the components are known
    if not nodes.isEmpty():
        wanted = written(nodes.select(F.col("class").alias("key")).distinct())
        # each piece is asked for in one text; nothing else of the texts is made
        where = written(units.join(_few(wanted), "key").groupBy("key").agg(F.min("body").alias("body"))
                        .groupBy("body").agg(F.collect_list("key").alias("keys")))
        made = (keep_known(docs.select(body.alias("_text"), F.xxhash64(body).alias("body")), where.select("body"), "body")
                .dropDuplicates(["body"]).join(where, "body")
                .select(F.explode(F.arrow_udf(_sets_of, "array<struct<key:long,set:binary>>")("_text", "keys")).alias("p"))
                .select(F.col("p.key").alias("class"), "p.set"))
        sets = written(made.withColumn("sig", F.arrow_udf(_signatures, "binary")("set")))
        spent += [wanted, where, sets]
        labels = Joiner(sets.select("class", "sig"), lambda needed: sets.join(needed, "class").select("class", "set"), PERCENT).grow(nodes, BRANCHES)
    exact = one.where("twice").select("key")
    if labels is None:
        comps = exact.select("key", F.col("key").alias("comp"))
    else:
        named = labels.select(F.col("id").alias("key"), F.col("label").alias("comp"))
        comps = named.union(exact.join(named, "key", "left_anti").select("key", F.col("key").alias("comp")))
    comps = written(comps)
    dropped(*spent)
    found = written(units.select("row", "_id", "body", "seq", "key").join(_few(comps), "key")
                    .select("row", "_id", "body", "seq", "comp").distinct())
    firsts = found.groupBy("comp").agg(F.count("*").alias("c"), F.min(F.struct("_id", "body", "row", "seq")).alias("f")).where("c > 1")
    marks = written(found.join(firsts, "comp")
                    .select("row", F.struct("seq", F.col("f._id").alias("first_id"),
                                            ((F.col("row") == F.col("f.row")) & (F.col("seq") == F.col("f.seq"))).alias("first")).alias("m"))
                    .groupBy("row").agg(F.collect_list("m").alias("marks")))
    dropped(comps, found)
    narrow = cut.select("row", "_id", F.expr("transform(u, x -> struct(x.start AS start, x.end AS end, x.n AS n))").alias("u"))
    # both sides hold arrays: written, so that the optimizer knows their bytes
    wide = repeated_windows(cut.select("row", "_id", "body", "a"), docs.select(row.alias("row"), body.alias("_text")))
    return (narrow.join(marks, "row", "left").join(wide, "row", "left")
            .withColumn("r", F.arrow_udf(_runs, RUNS)("u", "marks", "windows", "window_ids"))
            .select(F.col("_id").alias(id_), F.col("row").alias("row_hash"), "r.*"))


def without_repeats(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the removed spans cut out of the texts; columns and rows stay."""
    found = written(repeated_passages(docs, id_, text).where("size(spans) > 0")
                    .select(F.col("row_hash").alias("_row_hash"), F.col("spans").alias("_cut_spans")).dropDuplicates(["_row_hash"]))
    key = F.xxhash64(F.col(f"`{id_}`").cast("long"), F.col(f"`{text}`"))

    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([t.as_py() if not s.as_py() else cut_spans(t.as_py(), s.as_py()) for t, s in zip(texts, spans)], pa.string())

    return (docs.join(found, key == F.col("_row_hash"), "left")
            .withColumn(text, F.arrow_udf(cut, "string")(F.col(f"`{text}`"), F.col("_cut_spans")))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
