"""MinHash near-dedup by a chosen-path set similarity join.

Equal shingle sets are one class, found by an aggregate over their digest. Each
class has ``COORDINATES`` min-hashes. A tree sends a class down the paths that
its min-hashes at chosen coordinates spell: at the roots of ``TREES`` trees about
1 / similarity coordinates each are chosen, all of them distinct. A node that is
small is compared exhaustively; a large one is branched again by more chosen
coordinates. The branches are so many that a pair at the threshold meets with a
chance of ``RECALL`` even if its nodes stay large at every level.

No large node is ever compared pair by pair. At the roots it is recentred first:
its pivot is the class nearest to the majority of the node, and the classes around
the pivot are told apart by their differences from it. Two of them can only be
linked if these differences share enough tokens, so that an exact prefix filter on
the rarer tokens proposes the pairs (``Joiner.recentre``). Classes whose every
possible partner is around the pivot, too, are done then; the others are branched.
The classes of nodes that are still large at the last level go through one such
filter on their whole sets.

Only components are asked for, which keeps large groups of copies linear: classes
are first compared with the pivot, and after that only classes of different
components are. A node whose classes are all in one component is done, whatever
its size. Candidates must look similar on one bit of each min-hash, which travels
with the node's rows (five standard deviations of slack), or share tokens of
their differences, then on their signatures (four), and every link is confirmed
on the full sets.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavement.llm.columns import arrow_struct, give_back, gram_hashes
from pavement.llm.components import components
from pavement.plans.storage import dropped, written

COORDINATES = 64
TREES = 8
SMALL = 16
#: Each branch of a large node reads as many coordinates at a time as leave a pair at the threshold
#: together with a chance of 0.4; nodes are branched DEPTH - 1 times at most.
TOGETHER = 0.4
DEPTH = 2
#: Coordinates on which a class agrees with its node's pivot to count as around it.
AROUND = 24
#: Bits that choose a pivot: the class of a node that differs least from the majority on them.
VOTES = 24
#: Ranges of differences that the prefix filter tells apart; each is twice as wide as the one before.
RANGES = 9
#: Before pairs are proposed, each class around a pivot meets one other class for each of so many of its rarest tokens.
MEETINGS = 8
#: Chance that a pair at the threshold meets, whatever the sizes of its nodes, over all levels.
RECALL = 0.99
#: Rows of a side that may be broadcast: 16-byte keys, so about 100 MB. Beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000

_DRAW = np.random.default_rng(20)
_A = (_DRAW.integers(1, 2 ** 62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_B = _DRAW.integers(0, 2 ** 63, COORDINATES, dtype=np.uint64)[:, None]


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; a shorter text is one shingle."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.unique(gram_hashes(codes, (min(k, len(words)),), k)[0])


def signature(hashes: np.ndarray) -> bytes:
    """The smallest of each of the seeded rehashes, as little-endian 32-bit integers."""
    low = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 2048):
            h = hashes[None, i:i + 2048] * _A + _B
            low = np.minimum(low, (h >> np.uint64(32)).min(axis=1).astype(np.uint32))
    return low.tobytes()


def signatures(flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The signatures of several sets, none empty, that follow each other."""
    if not len(sizes):
        return []
    starts, low = np.cumsum(np.append(0, sizes[:-1])), np.empty((len(sizes), COORDINATES), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(COORDINATES):
            low[:, i] = np.minimum.reduceat(((flat * _A[i] + _B[i]) >> np.uint64(32)).astype(np.uint32), starts)
    return [row.tobytes() for row in low]


def _signed(k: int):
    fields = [("n", pa.int64()), ("class", pa.binary()), ("sig", pa.binary())]

    @F.arrow_udf("n long, class binary, sig binary")
    def sign(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            h = shingles(t.as_py(), k)
            rows.append((len(h), xxhash.xxh3_128_digest(h.tobytes()), signature(h)) if len(h) else (0, None, None))
        signed = arrow_struct(fields, rows)
        del rows
        give_back()
        return signed

    return sign


def _as_sets(k: int):
    @F.arrow_udf("binary")
    def make(texts: pa.Array) -> pa.Array:
        made = pa.array([shingles(t.as_py(), k).tobytes() for t in texts], pa.binary())
        give_back()
        return made

    return make


def _agreeing(a: pa.Array, b: pa.Array) -> pa.Array:
    """Coordinates on which two signatures agree."""
    return pa.array([int((np.frombuffer(x.as_py(), "<u4") == np.frombuffer(y.as_py(), "<u4")).sum())
                     for x, y in zip(a, b)], pa.int32())


def _common(a: pa.Array, b: pa.Array) -> pa.Array:
    """Size of the intersection of two sorted sets."""
    return pa.array([len(np.intersect1d(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64),
                                        assume_unique=True)) for x, y in zip(a, b)], pa.int64())


def _differences(sets: pa.Array, pivots: pa.Array) -> pa.Array:
    """Tokens that are in one of two sorted sets only."""
    found = [np.setxor1d(np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64), assume_unique=True)
             for x, y in zip(sets, pivots)]
    sizes = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(sizes, pa.array(np.concatenate([np.empty(0, np.int64), *found])))


def keep_known(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is among ``keys`` (a written table): broadcast if few, else a shuffle join."""
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(keys) if few else keys, on, "left_semi")


def steps_for(percent: int) -> int:
    """Coordinates that a branch reads."""
    return max(1, round(math.log(TOGETHER) / math.log(min(percent / 100, 0.99))))


def recall(percent: int, branches: int, apart: Callable[[int, float], float], depth: int = DEPTH) -> float:
    """Chance that a pair at the threshold meets if all its nodes but the last are large.

    Its signatures are fixed: all levels read the same agreeing coordinates, so
    the chance is taken for each number of these and weighed. ``apart(agreeing,
    s)`` is the chance that no root brings the pair together if one that they
    share does with chance ``s``. A branch reads coordinates of its own node's
    choice, so that branches are independent for a given number.
    """
    t, steps, total = percent / 100, steps_for(percent), 0.0
    for agreeing in range(COORDINATES + 1):
        s = 1.0
        for _ in range(depth - 1):
            s = 1 - (1 - (agreeing / COORDINATES) ** steps * s) ** branches
        weight = math.comb(COORDINATES, agreeing) * t ** agreeing * (1 - t) ** (COORDINATES - agreeing)
        total += weight * (1 - apart(agreeing, s))
    return total


def apart_over(roots: int) -> Callable[[int, float], float]:
    """``apart`` of so many distinct root coordinates."""
    def apart(agreeing: int, s: float) -> float:
        return sum(math.comb(agreeing, h) * math.comb(COORDINATES - agreeing, roots - h) * (1 - s) ** h
                   for h in range(roots + 1)) / math.comb(COORDINATES, roots)

    return apart


def branches_for(percent: int, apart: Callable[[int, float], float], most: int = 64, depth: int = DEPTH) -> int | None:
    """The fewest branches that reach ``RECALL``; None if not even ``most`` do."""
    return next((b for b in range(1, most + 1) if recall(percent, b, apart, depth) >= RECALL), None)


def roots_and_branches(percent: int, trees: int = TREES, depth: int = DEPTH) -> tuple[int, int]:
    """Root coordinates of so many trees, more if these cannot reach ``RECALL``, and the branches of large nodes."""
    for roots in range(min(COORDINATES, math.ceil(100 * trees / percent)), COORDINATES + 1):
        branches = branches_for(percent, apart_over(roots), depth=depth)
        if branches:
            return roots, branches
    raise ValueError(f"{COORDINATES} coordinates are too few for a threshold of {percent} %")


def _bits(sigs: pa.Array) -> pa.Array:
    """The lowest bit of each coordinate."""
    flat = np.frombuffer(b"".join(s.as_py() for s in sigs), "<u4").reshape(len(sigs), COORDINATES)
    return pa.array(np.packbits((flat & 1).astype(np.uint8), axis=1).view("<i8")[:, 0], pa.int64())


class Joiner:
    """The links among classes, found level by level; holds the links confirmed so far."""

    def __init__(self, classes: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int):
        """``classes``: (class, sig), written. ``sets``: classes that are asked for -> (class, set)."""
        self.classes, self.sets, self.percent = classes, sets, percent
        t = percent / 100
        self.least = math.floor(COORDINATES * max(0.0, t - 4 * math.sqrt(t * (1 - t) / COORDINATES)))
        self.steps = steps_for(percent)
        same = (1 + t) / 2  # of the bits of a pair at the threshold
        self.differ = math.ceil(COORDINATES * (1 - same) + 5 * math.sqrt(COORDINATES * same * (1 - same)))
        self.links: list[DataFrame] = []

    def confirm(self, pairs: DataFrame, sets: DataFrame | None = None) -> None:
        """Add the pairs (a, b) that hold on the full sets to the links; ``sets`` if they are written already."""
        sig = self.classes
        likely = written(
            pairs.distinct()
            .join(sig.select(F.col("class").alias("a"), F.col("sig").alias("sa")), "a")
            .join(sig.select(F.col("class").alias("b"), F.col("sig").alias("sb")), "b")
            .where(F.arrow_udf(_agreeing, "int")("sa", "sb") >= self.least).select("a", "b"))
        if likely.isEmpty():
            return
        spent = [likely]
        if sets is None:
            sets = written(self.sets(likely.select(F.explode(F.array("a", "b")).alias("class")).distinct()))
            spent.append(sets)
        size = lambda c: F.octet_length(c) / 8
        self.add(likely.join(sets.select(F.col("class").alias("a"), F.col("set").alias("sa")), "a")
                 .join(sets.select(F.col("class").alias("b"), F.col("set").alias("sb")), "b")
                 .where(100 * F.least(size("sa"), size("sb")) >= self.percent * F.greatest(size("sa"), size("sb")))
                 .withColumn("c", F.arrow_udf(_common, "long")("sa", "sb"))
                 .where(100 * F.col("c") >= self.percent * (size("sa") + size("sb") - F.col("c"))).select("a", "b"))
        dropped(*spent)

    def add(self, links: DataFrame) -> None:
        links = written(links)
        if not links.isEmpty():
            self.links.append(links)

    def merged(self, rows: DataFrame) -> DataFrame:
        """``rows`` (class, comp, ...) with the components that the links make."""
        if not self.links:
            return rows
        labels = components(reduce(DataFrame.union, self.links))
        return (rows.join(labels.select(F.col("id").alias("class"), "label"), "class", "left")
                .withColumn("comp", F.coalesce("label", "comp")).drop("label"))

    def near(self, a: str, b: str) -> Column:
        """Whether the bits of two classes differ no more than those of a similar pair."""
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= self.differ

    def level(self, nodes: DataFrame, first: bool, last: bool) -> DataFrame | None:
        """Compare within the nodes (node, class, comp, bits); the rows of large nodes that stay open, if any.

        Classes of equal ``comp`` are known to be in one component.
        """
        # each node's size, its smallest class, and the majority of its classes for some bits
        ones = [F.sum(F.getbit("bits", F.lit(i)).cast("int")).alias(f"b{i}") for i in range(VOTES)]
        heads = nodes.groupBy("node").agg(F.count("*").alias("n"), F.min(F.struct("class", "comp", "bits")).alias("least"),
                                          F.min("comp").alias("lo"), F.max("comp").alias("hi"), *ones).where("lo <> hi")
        bit = lambda i: F.shiftleft((2 * F.col(f"b{i}") > F.col("n")).cast("long"), i)
        heads = heads.select("node", "n", "least", reduce(Column.bitwiseOR, map(bit, range(VOTES))).alias("majority"))
        rows = written(nodes.join(heads, "node"))
        self.small(rows.where(F.col("n") <= SMALL).drop("majority"))
        large = rows.where(F.col("n") > SMALL)
        if last:
            left = written(large.select("class", "comp").distinct())
            if not left.isEmpty():
                self.recentre(left.select(F.lit(0).alias("pivot"), "class", "comp"), False)
            return None
        far = F.bit_count(F.col("bits").bitwiseXOR(F.col("majority")).bitwiseAND(F.lit(2 ** VOTES - 1)))
        pivots = written(large.groupBy("node").agg(F.min(F.struct(far, "class")).alias("p")).select("node", F.col("p.class").alias("pivot")))
        if pivots.isEmpty():
            return None
        large = large.select("node", "class", "comp", "bits")
        if not first:
            return large
        centres = pivots.join(self.classes.select(F.col("class").alias("pivot"), F.col("sig").alias("centre")), "pivot")
        large = written(large.join(centres, "node").join(self.classes, "class")
                        .select("node", "class", "comp", "bits", "pivot", F.arrow_udf(_agreeing, "int")("sig", "centre").alias("agree")))
        self.recentre(large.where(F.col("agree") >= AROUND).select("pivot", "class", "comp").distinct())
        # a partner agrees with the pivot on so many coordinates less, at most
        rest = large.where(F.col("agree") < AROUND + COORDINATES - self.least).select("node", "class", "comp", "bits")
        rest = self.merged(rest)
        apart = rest.groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("node")
        rest = written(rest.join(apart, "node").select("node", "class", "comp", "bits"))
        return None if rest.isEmpty() else rest

    def small(self, rows: DataFrame) -> None:
        """Compare within small nodes: with their smallest class first, then the classes that are still apart."""
        self.confirm(rows.where((F.col("comp") != F.col("least.comp")) & self.near("bits", "least.bits"))
                     .select(F.col("least.class").alias("a"), F.col("class").alias("b")))
        rows = self.merged(rows.select("node", "class", "comp", "bits"))
        away = rows.groupBy("node").agg(F.min("comp").alias("home"), F.max("comp").alias("hi")).where("home <> hi").drop("hi")
        rows = written(rows.join(away, "node").select("node", "class", "comp", "bits", "home"))
        apart = rows.where("comp <> home").select("node", F.col("class").alias("a"), F.col("comp").alias("other"), F.col("bits").alias("others"))
        self.confirm(apart.join(rows, "node").where((F.col("comp") != F.col("other")) & self.near("bits", "others"))
                     .select(F.least("a", "class").alias("a"), F.greatest("a", "class").alias("b")))

    def recentre(self, members: DataFrame, centred: bool = True) -> None:
        """All links among the classes around each pivot (pivot, class, comp), by their differences from it.

        If not ``centred``, the pivots are names only and stand for empty sets.

        With d the tokens that a class and the pivot do not share and n the class's
        size, ``off`` = (100 + percent) |d| - (100 - percent) n. Two classes are linked
        if and only if their differences share (off + off') / (2 (100 + percent)) tokens
        or more. A class is linked to the pivot if ``off`` is at most the pivot's
        ``reach``, (100 - percent) times its size; of two classes of different components
        the one that is more off is beyond that. So the less off one needs only its rarest
        tokens looked up, as many as leave fewer than must be shared, and the other one
        is found under so many of its own. How many must be shared depends on how far off
        the other one is: ranges of that are looked up separately.
        """
        members = written(members)
        sets = written(self.sets(members.select("class").distinct()))
        size = lambda c: (F.octet_length(c) / 8).cast("long")
        centres = sets.select(F.col("class").alias("pivot"), F.col("set").alias("of"))
        more, less = 100 + self.percent, 100 - self.percent
        rows = members.join(sets, "class")
        rows = rows.join(centres, "pivot") if centred else rows.withColumn("of", F.lit(b""))
        moved = written(rows.select("pivot", "class", "comp", size("set").alias("n"), (less * size("of")).alias("reach"),
                                F.arrow_udf(_differences, "array<long>")("set", "of").alias("d"))
                        .withColumn("off", more * F.size("d") - less * F.col("n")))
        if centred:
            self.add(moved.where("off <= reach AND class <> pivot").select(F.col("pivot").alias("a"), F.col("class").alias("b")))
        tokens = moved.select("pivot", "class", (F.col("off") > F.col("reach")).alias("open"), F.explode("d").alias("token"))
        # tokens of one class alone, or of none that is open, propose no pair
        counted = (tokens.groupBy("pivot", "token").agg(F.count("*").alias("c"), F.max("open").alias("open"))
                   .where("c > 1 AND open").drop("open"))
        shared = (tokens.drop("open").join(counted, ["pivot", "token"])
                  .groupBy("pivot", "class").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("s"))
                  .withColumn("s", F.col("s.token")))
        rows = written(self.merged(moved.withColumn("d", F.size("d")).join(shared, ["pivot", "class"])))
        spent = [members, sets, moved, rows]
        # classes with a token meet the one least off, so a large group is mostly one component before its pairs are proposed
        held = rows.select("pivot", "class", "comp", "off", F.explode(F.slice("s", 1, MEETINGS)).alias("token"))
        one = held.groupBy("pivot", "token").agg(F.min(F.struct("off", "class", "comp")).alias("one"))
        met = held.join(one, ["pivot", "token"]).where(F.col("comp") != F.col("one.comp"))
        before = len(self.links)
        self.confirm(met.select(F.least("class", "one.class").alias("a"), F.greatest("class", "one.class").alias("b")), sets)
        if len(self.links) > before:
            rows = written(self.merged(rows))
            spent.append(rows)
        step = 2 * more
        over = F.col("off") - F.col("reach")
        range_ = F.when(over <= step, 0).otherwise(F.least(F.lit(RANGES - 1), F.floor(F.log2(over / step)).cast("int") + 1))
        # a partner is at most 100 / percent times as large and shares no more than its own difference
        must = F.greatest(F.lit(1), F.ceil((F.col("off") - less * 100 * F.col("n") / self.percent) / more))
        own = F.slice("s", 1, F.greatest(F.lit(0), F.size("s") - must + 1).cast("int"))
        far = (rows.where("off > reach").select("pivot", F.col("class").alias("b"), F.col("comp").alias("other"), F.col("off").alias("others"),
                                                F.col("n").alias("size"), range_.alias("range"), F.size("s").alias("all"),
                                                F.posexplode(own).alias("past", "token"))
               .select("pivot", "b", "other", "others", "size", "range", "token", (F.col("all") - F.col("past")).alias("most")))
        looked = []
        for r in range(RANGES):
            low = F.col("reach") + (1 if r == 0 else step * 2 ** (r - 1))
            must = F.greatest(F.lit(1), F.ceil((F.col("off") + F.greatest(low, F.col("off"))) / step))
            # what is not in s comes first and finds nothing
            many = F.greatest(F.lit(0), F.size("s") - must + 1).cast("int")
            if r < RANGES - 1:
                many = F.when(F.col("off") <= F.col("reach") + step * 2 ** r, many).otherwise(0)
            looked.append(F.transform(F.slice("s", 1, many), lambda t, i: F.struct(  # noqa: B023
                F.lit(r).alias("range"), t.alias("token"), (F.size("s") - i).alias("rest"))))  # noqa: B023
        rare = (rows.select("pivot", F.col("class").alias("a"), "comp", "off", "n", F.explode(F.flatten(F.array(*looked))).alias("l"))
                .select("pivot", "a", "comp", "off", "n", "l.range", "l.token", "l.rest"))
        ordered = F.struct("off", "a") < F.struct("others", "b")
        # the first token that two classes share leaves enough on both sides for what they must share; sizes are alike
        enough = step * F.least("rest", "most") >= F.col("off") + F.col("others")
        alike = 100 * F.least("n", "size") >= self.percent * F.greatest("n", "size")
        self.confirm(rare.join(far, ["pivot", "range", "token"]).where((F.col("comp") != F.col("other")) & ordered & enough & alike)
                     .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), sets)
        dropped(*spent)

    def run(self, trees: int = TREES, depth: int = DEPTH) -> DataFrame | None:
        """(id, label) of the linked classes, or None without any link."""
        roots, branches = roots_and_branches(self.percent, trees, depth)
        paths = [F.xxhash64(F.lit(c), F.substring("sig", 4 * c + 1, 4))
                 for c in sorted(random.Random(31).sample(range(COORDINATES), roots))]
        return self.grow(self.classes.select("class", F.explode(F.array(*paths)).alias("node")), branches, depth)

    def grow(self, nodes: DataFrame, branches: int, depth: int = DEPTH) -> DataFrame | None:
        """Compare within the nodes (node, class) and branch the large ones; (id, label) of the linked classes."""
        # a node of one class has nothing to compare, and its class needs no bits
        met = nodes.groupBy("node").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("node")
        bits = self.classes.select("class", F.arrow_udf(_bits, "long")("sig").alias("bits"))
        nodes = nodes.join(met, "node").join(bits, "class").withColumn("comp", F.col("class"))
        for at in range(depth):
            rest = self.level(nodes, at == 0, at == depth - 1)
            if rest is None:
                break
            # each node chooses its own coordinates for its branches
            pick = lambda i: F.pmod(F.xxhash64("node", F.lit(at), F.lit(i)), F.lit(COORDINATES)).cast("int")  # noqa: B023,E731
            value = lambda i: F.col("sig").substr(pick(i) * 4 + 1, F.lit(4))
            paths = [F.xxhash64("node", F.lit(b), *[value(b * self.steps + i) for i in range(self.steps)]) for b in range(branches)]
            nodes = rest.join(self.classes, "class").select("class", "comp", "bits", F.explode(F.array(*paths)).alias("node"))
        return components(reduce(DataFrame.union, self.links)) if self.links else None


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_: str = "doc_id", text: str = "text",
                    trees: int = TREES) -> DataFrame:
    """One row per row of ``docs``: id, text_md5, n_shingles, component_id, kept and component_key.

    Documents are linked when 100 * intersection >= percent * union of their sets
    of k-word shingles. ``component_id`` is the smallest id that can be reached.
    Null, empty and blank texts have no shingles and are linked with nothing. A
    null id takes part but is no component's smallest id unless all are null, and
    then the component has no id; ``kept`` compares the id with the component's,
    nulls as equal. ``component_key`` tells components apart even where ids repeat
    (null without shingles). Repeated rows are kept or not alike. Only the two columns are
    read. Builds its tables while the plan is built.
    """
    body = F.col(f"`{text}`")
    signed = written(docs.select(F.col(f"`{id_}`").alias("_id"), F.md5(body.cast("binary")).alias("_md5"),
                                 _signed(k)(body).alias("_s"))
                     .select("_id", "_md5", F.col("_s.n").alias("n"), F.col("_s.class").alias("class"), F.col("_s.sig").alias("sig")))
    some = signed.where("class IS NOT NULL")
    classes = written(some.groupBy("class").agg(F.min("_id").alias("low"), F.min("_md5").alias("md5"),
                                                F.min("sig").alias("sig")))

    def sets(needed: DataFrame) -> DataFrame:
        wanted = written(classes.join(needed, "class").select(F.col("md5").alias("_md5"), "class"))
        texts = docs.select(F.md5(body.cast("binary")).alias("_md5"), body.alias("_text")).where("_md5 IS NOT NULL")
        found = keep_known(texts, wanted.select("_md5"), "_md5").dropDuplicates(["_md5"])
        return found.join(wanted, "_md5").select("class", _as_sets(k)("_text").alias("set"))

    labels = Joiner(classes.select("class", "sig"), sets, percent).run(trees)
    if labels is None:
        named = classes.select("class", F.col("low").alias("_low"), F.col("class").alias("_key"))
    else:
        joined = classes.select("class", "low").join(labels.select(F.col("id").alias("class"), "label"), "class", "left")
        lows = joined.where("label IS NOT NULL").groupBy("label").agg(F.min("low").alias("_all"))
        named = (joined.join(lows, "label", "left")
                 .select("class", F.when(F.col("label").isNull(), F.col("low")).otherwise(F.col("_all")).alias("_low"),
                         F.coalesce("label", "class").alias("_key")))
    component = F.when(F.col("class").isNull(), F.col("_id")).otherwise(F.col("_low"))
    return (signed.drop("sig").join(named, "class", "left")
            .select(F.col("_id").alias(id_), F.col("_md5").alias("text_md5"), F.col("n").alias("n_shingles"),
                    component.alias("component_id"), component.eqNullSafe(F.col("_id")).alias("kept"),
                    F.col("_key").alias("component_key")))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates: that of the smallest id.

    Of fully repeated rows, and of rows that share both id and text, one stays;
    rows of one id with different texts of one group: the one whose text has the
    smallest md5. A group without any id keeps the row with the smallest md5.
    Documents without words are no one's duplicates, unless id and text repeat.
    """
    found = near_duplicates(docs, k, percent, id_, text)
    # a document without shingles is told apart by its id and text alone
    alone = F.when(F.col("n_shingles") == 0, F.struct(F.col(id_), F.coalesce("text_md5", F.lit(""))))
    group = F.struct(F.col("component_key").alias("k"), alone.alias("m"))
    rows = written(found.select(group.alias("g"), F.col(id_).alias("_id"), F.coalesce("text_md5", F.lit("")).alias("_md5")))
    best = rows.groupBy("g").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_md5")).alias("_best"))
    judged = (rows.groupBy("g", "_id", "_md5").agg(F.count("*").alias("times")).join(best, "g")
              .select("_id", "_md5", "times", (F.struct(F.col("_id").isNull(), "_id", "_md5") == F.col("_best")).alias("win")))
    judged = written(judged.where("times > 1 OR NOT win"))
    losers, repeated = judged.where("NOT win"), judged.where("win")
    keyed = docs.withColumn("_k_md5", F.coalesce(F.md5(F.col(f"`{text}`").cast("binary")), F.lit("")))
    same = lambda other: F.col(f"`{id_}`").eqNullSafe(other["_id"]) & (F.col("_k_md5") == other["_md5"])

    def sized(side: DataFrame) -> DataFrame:
        return F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side

    rest = keyed.join(sized(losers), same(losers), "left_anti")
    if not repeated.isEmpty():
        twice = sized(repeated)
        once = rest.join(twice, same(repeated), "left_semi").dropDuplicates([id_, "_k_md5"])
        rest = rest.join(twice, same(repeated), "left_anti").unionByName(once)
    return rest.select(*[F.col(f"`{c}`") for c in docs.columns])
