"""Phrase collocations by SON partitioning.

The corpus is dealt to ``SHARDS`` shards per language by a digest of the text. A
phrase with ``support`` occurrences has, in one shard at least, its share of them:
support times the shard's share of the language's words, rounded up. So every shard
is mined completely at its own lowered support, level by level (a phrase of k words
only where both its phrases of k - 1 words are frequent in the shard); what is
frequent in any shard is a candidate; and all candidates are counted over the whole
corpus, by their words.

A shard is a share of the corpus, not what one task holds: with a fixed support, a
shard per task would lower the local support to one occurrence, which rules out
nothing. Tasks count the phrases of their own rows in blocks of bounded size; an
aggregate over (phrase, shard) adds them up.

While mining, words and phrases are named by 64-bit digests, and what is frequent is
a bitmap of fixed size (``BITS``), so what every task gets does not grow with the
input. Digests that collide, in name or bitmap, can only add candidates, which the
count over the words then judges. In that count a block of a task names phrases by
their digest, too, before they are added up by their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pavement.llm.columns import gram_hashes
from pavement.plans.storage import written

SHARDS, LONGEST = 4, 4
#: log2 of the bits of a bitmap (16 MB).
BITS = 27
#: Bytes of text that are split at a time, phrases that a task holds before it counts them, words it remembers.
BLOCK, HELD, WORDS = 1 << 22, 1 << 21, 200_000

_BREAK = 0xFF  # never in UTF-8
_TABLE = bytes(_BREAK if chr(b) in ".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Names(dict):
    """64-bit names of words; 0 stands between pieces."""

    def __missing__(self, word: bytes) -> int:
        name = xxhash.xxh3_64_intdigest(word) or 1
        if len(self) < WORDS:
            self[word] = name
        return name


class Bitmap:
    """Membership of (phrase, shard) names, two bits each; may say yes to others."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, names: np.ndarray, cell: int) -> np.ndarray:
        h = names ^ np.uint64(cell & 0xFFFFFFFFFFFFFFFF)
        out = np.ones(len(h), bool)
        for part in (h, h >> np.uint64(32)):
            at = (part & np.uint64((1 << BITS) - 1)).astype(np.int64)
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def bitmap(names: DataFrame) -> Bitmap:
    """The bitmap of rows (name long, cell long), made by partial bitmaps and read by the driver: BITS bits."""
    mask, h = (1 << BITS) - 1, F.col("name").bitwiseXOR(F.col("cell"))
    places = names.select(F.explode(F.array(h.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(mask)))).alias("at"))
    size = 32768  # bits of one of Spark's bitmaps
    parts = (places.select(F.expr(f"at div {size}").alias("k"), (F.col("at") % size).alias("at"))
             .groupBy("k").agg(F.expr("bitmap_construct_agg(at)").alias("bits")))
    whole = np.zeros((1 << BITS) // 8, np.uint8)
    for r in parts.toLocalIterator():
        part = np.frombuffer(r["bits"], np.uint8)
        whole[r["k"] * size // 8:r["k"] * size // 8 + len(part)] = part
    return Bitmap(whole)


def _pieces(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Words of texts of about BLOCK bytes, with a break after each piece; a long text is cut at breaks."""
    held, size = [], 0
    for text in texts:
        text = text.translate(_TABLE)
        while len(text) > BLOCK and (cut := text.find(b"\xff", BLOCK)) >= 0:
            yield text[:cut].replace(b"\xff", b" \xff ").split() + [b"\xff"]
            text = text[cut + 1:]
        held.append(text)
        size += len(text)
        if size >= BLOCK:
            yield b"\xff".join([*held, b""]).replace(b"\xff", b" \xff ").split()
            held, size = [], 0
    if held:
        yield b"\xff".join([*held, b""]).replace(b"\xff", b" \xff ").split()


def _phrases(words: list[bytes], names: _Names, lang: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """By length: name of the phrase that begins at each word, and whether there is one."""
    codes = np.fromiter(map(names.__getitem__, words), np.uint64, len(words))
    grams = gram_hashes(codes, tuple(range(1, LONGEST + 1)), lang & 0x3FFFFFFFFFFFFFFF)
    inside = [codes != 0]
    for k in range(1, LONGEST):
        inside.append(inside[-1][:-1] & inside[0][k:])
    return grams, inside


def _by_cell(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    """(lang name, cell, texts) of a batch."""
    cells = batch.column("cell").to_numpy()
    langs = batch.column("name").to_numpy()
    texts = batch.column("text").cast(pa.binary())
    for cell in np.unique(cells):
        at = np.flatnonzero(cells == cell)
        yield int(langs[at[0]]), int(cell), texts.take(pa.array(at)).to_pylist()


def _miner(k: int, frequent):
    """Counts of the phrases of k words in a task's rows whose shorter phrases are frequent in the shard."""
    schema = pa.schema([("name", pa.int64()), ("cell", pa.int64()), ("n", pa.int64())])

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _Names({b"\xff": 0})
        held: dict[int, list[np.ndarray]] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for cell, parts in held.items():
                found, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(found), cell, np.int64)),
                                                  pa.array(n)], schema=schema)
            held.clear()

        size = 0
        for batch in batches:
            for lang, cell, texts in _by_cell(batch):
                for words in _pieces(texts):
                    grams, inside = _phrases(words, names, lang)
                    if len(grams[k - 1]) == 0:
                        continue
                    use = inside[k - 1]
                    if k > 1:
                        shorter = inside[k - 2].copy()
                        shorter[shorter] = frequent.value.has(grams[k - 2][shorter], cell)
                        use = use & shorter[:-1] & shorter[1:]
                    held.setdefault(cell, []).append(grams[k - 1][use])
                    size += int(use.sum())
                    if size >= HELD:
                        yield from counted()
                        size = 0
        if held:
            yield from counted()

    return mine


def _counter(candidates):
    """Counts of the candidates in a task's rows, by their words."""
    schema = pa.schema([("cell", pa.int64()), ("phrase", pa.string()), ("k", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _Names({b"\xff": 0})
        held: dict[tuple[int, int], dict[int, int]] = {}
        spelled: dict[int, bytes] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for (cell, k), found in held.items():
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(found), cell, np.int64)), pa.array([spelled[g] for g in found], pa.binary()).cast(pa.string()),
                    pa.array(np.full(len(found), k, np.int32)), pa.array(list(found.values()), pa.int64())], schema=schema)
            held.clear()
            spelled.clear()

        for batch in batches:
            for lang, cell, texts in _by_cell(batch):
                for words in _pieces(texts):
                    grams, inside = _phrases(words, names, lang)
                    for k in range(1, LONGEST + 1):
                        at = np.flatnonzero(inside[k - 1])
                        at = at[candidates.value.has(grams[k - 1][at], 0)]
                        found, first, n = np.unique(grams[k - 1][at], return_index=True, return_counts=True)
                        sums = held.setdefault((cell, k), {})
                        for g, i, c in zip(found.tolist(), at[first].tolist(), n.tolist()):
                            if g in sums:
                                sums[g] += c
                            else:
                                sums[g] = c
                                if g not in spelled:
                                    spelled[g] = b" ".join(words[i:i + k])
                    if len(spelled) >= HELD // 8:
                        yield from counted()
        if held:
            yield from counted()

    return count


def _lowered(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, name of the lang, cell, text): the cell is the shard of the language that the text is dealt to."""
    body = F.col(f"`{text}`")
    known = F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und"))
    return (docs.where(F.length(body) > 0)
            .select(known.alias("lang"), F.xxhash64(known).alias("name"),
                    F.xxhash64(known, F.pmod(F.xxhash64(body.cast("binary")), F.lit(SHARDS))).alias("cell"), body.alias("text")))


def phrase_counts(docs: DataFrame, support: int = 30, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, n) of all phrases of up to ``LONGEST`` words with ``support`` occurrences, and (lang, total) words.

    Null languages are ``und``; null and empty texts have no words. Both tables are
    written while the plan is built.
    """
    spark = docs.sparkSession
    rows = _lowered(docs, lang, text)
    cells = written(rows.select("lang", "cell").distinct())
    frequent, levels, local = None, [], None
    for k in range(1, LONGEST + 1):
        mined = rows.select("name", "cell", "text").mapInArrow(_miner(k, frequent), "name long, cell long, n long")
        # the tasks have added up what they could: one shuffle, no second partial sum
        counts = mined.repartition("name").groupBy("name", "cell").agg(F.sum("n").alias("n"))
        if k == 1:
            counts = written(counts)
            words = written(counts.groupBy("cell").agg(F.sum("n").alias("words")).join(cells, "cell"))
            totals = words.groupBy("lang").agg(F.sum("words").alias("total"))
            # ceil(support * words / total), exactly
            least = F.expr(f"(cast(words as decimal(20,0)) * {support} + total - 1) div total")
            local = written(words.join(totals, "lang").select("cell", least.alias("least")))
        level = written(counts.join(local, "cell").where("n >= least").select("name", "cell"))
        levels.append(level.select("name"))
        if k < LONGEST:
            frequent = spark.sparkContext.broadcast(bitmap(level))
    every = levels[0]
    for level in levels[1:]:
        every = every.union(level)
    candidates = spark.sparkContext.broadcast(bitmap(every.select("name", F.lit(0).cast("long").alias("cell"))))
    found = rows.select("name", "cell", "text").mapInArrow(_counter(candidates), "cell long, phrase string, k int, n long")
    of_lang = found.join(cells, "cell").select("lang", "phrase", "k", "n")
    counts = of_lang.repartition("lang", "phrase").groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n"))
    return written(counts.where(F.col("n") >= support)), written(totals)


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(2000000 a / (l + r)); the product in decimals, since it may pass 64 bits."""
    top, under = a.cast("decimal(19,0)") * F.lit(2_000_000).cast("decimal(7,0)"), l.cast("decimal(19,0)") + r.cast("decimal(19,0)")
    return F.floor((top - top % under) / under).cast("long")


def collocations(docs: DataFrame, support: int = 30, most: int = 2000, covered: int = 80, lang: str = "lang",
                 text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to 4 words of each language.

    A phrase's score is the lowest over its cuts in two; ties of the cuts go to the
    shortest first part, those of phrases to more occurrences, then to the phrase's
    bytes. A phrase inside a longer candidate that has ``covered`` percent of its
    occurrences is left out. Repeated rows count again. An empty table has no rows.
    """
    counts, totals = phrase_counts(docs, support, lang, text)
    words = F.split("phrase", " ")
    longer = counts.where("k > 1")
    # every part of a candidate, with the most occurrences of a candidate around it
    spans = [(i, j) for i in range(LONGEST) for j in range(1, LONGEST)]
    inner = (longer.withColumn("w", words)
             .select("lang", "n", F.explode(F.array_distinct(F.filter(F.array(*[
                 F.when((F.lit(j) < F.col("k")) & (F.lit(i + j) <= F.col("k")), F.array_join(F.slice("w", i + 1, j), " ")) for i, j in spans]),
                 lambda p: p.isNotNull()))).alias("phrase"))
             .groupBy("lang", "phrase").agg(F.max("n").alias("around")))
    kept = longer.join(inner, ["lang", "phrase"], "left").where(
        F.col("around").isNull() | (F.col("around").cast("decimal(19,0)") * 100 < F.col("n").cast("decimal(19,0)") * covered))
    cuts = (kept.withColumn("w", words)
            .select("lang", "phrase", F.col("n").alias("a"), F.explode(F.transform(
                F.sequence(F.lit(1), F.col("k") - 1), lambda c: F.struct(
                    c.alias("cut"), F.array_join(F.slice("w", F.lit(1), c), " ").alias("head"),
                    F.array_join(F.slice("w", c + 1, F.col("k") - c), " ").alias("tail")))).alias("c"))
            .select("lang", "phrase", "a", "c.*"))
    parts = counts.select("lang", F.col("phrase").alias("part"), F.col("n").alias("times"))
    scored = (cuts.join(parts.withColumnsRenamed({"part": "head", "times": "l"}), ["lang", "head"])
              .join(parts.withColumnsRenamed({"part": "tail", "times": "r"}), ["lang", "tail"])
              .withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
              .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
              .select("lang", "phrase", "a", "best.score", "best.l", "best.r"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                                           F.col("total").alias("n"), "score")
