"""Distance joins between centres and map features.

A distance predicate alone would compare every centre of a city with every
feature of it. Here both sides meet on a grid cell instead:

* a feature has ONE home cell, that of its anchor (a point of the feature),
  on a grid chosen by its size: tier ``k`` holds features that reach at most
  ``r/4 * 2**k`` from their anchor. The large side is never replicated, so no
  pair can be met twice and nothing has to be deduplicated afterwards;
* a centre probes the cells that its disc (or box), widened by the tier's reach, touches:
  about twenty of the 5 x 5 around it, on every tier that occurs;
* the exact test runs inside the join.

The join key is (keys, tier, cell): never the city alone. A dense cell is a
skewed join partition, which adaptive execution splits on either side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pavement.functions import geometry as G
from pavement.operators.discs import block_sums
from pavement.plans.storage import written

# Relative margin of the reach, so rounding can never push a match out of it.
_MARGIN = 1.0 + 1e-9
# Cells per reach. Smaller cells follow the disc more closely, so fewer features are tested in vain, but a
# centre is sent to more cells. That pays where pairs are many: 8 cores, 10 times sf0.1, seconds of the
# joining tasks with 1 and 2: 27.4 and 19.2 (polygons), 13.2 and 11.0 (boxes).
_FINE = 2


def anchored(feats: DataFrame, kind: str) -> DataFrame:
    """Add the anchor and the reach of each feature, and its edges where needed (null for an empty geometry).

    ``points`` need ``x, y``; ``lines`` need ``x1, y1, x2, y2`` or ``path``;
    ``polygons`` need ``rings``.
    """
    if kind == "points":
        return feats.withColumns({"_ax": F.col("x"), "_ay": F.col("y"), "_half": F.lit(0.0)})
    if kind == "lines" and "path" not in feats.columns:
        return feats.withColumns({
            "_ax": (F.col("x1") + F.col("x2")) / 2,
            "_ay": (F.col("y1") + F.col("y2")) / 2,
            "_half": F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / 2,
        })
    start = F.lit(0)
    first, edges = ((F.get("path", start), G.path_edges(F.col("path"))) if kind == "lines"
                    else (F.get(F.get("rings", start), start), G.polygon_edges(F.col("rings"))))
    return (feats.withColumns({"_edges": edges, "_ax": first["x"], "_ay": first["y"]})
            .withColumn("_half", G.reach(F.col("_edges"), F.col("_ax"), F.col("_ay"))))


def exact_test(feats: DataFrame, kind: str, x: Column, y: Column, r: float) -> Column:
    """Does the disc of radius ``r`` around (x, y) meet the feature? (disc_intersects)"""
    if kind == "points":
        return G.distance_sq(x, y, F.col("x"), F.col("y")) <= F.lit(float(r) ** 2)
    if kind == "lines" and "path" not in feats.columns:
        return G.segment_hits(x, y, r, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    if kind == "lines":
        return G.edges_hit(x, y, r, F.col("_edges"))
    return G.polygon_hits(x, y, r, F.col("_edges"))


def disc_intersects(df: DataFrame, kind: str, x: str, y: str, r: float, out: str = "hit") -> DataFrame:
    """Flag rows whose feature meets the disc around their own (x, y)."""
    shaped = anchored(df, kind)
    hit = F.coalesce(exact_test(df, kind, F.col(x), F.col(y), r), F.lit(False))
    return shaped.withColumn(out, hit).select(*df.columns, out)


def _reach(r: float) -> Column:
    """How far from a centre the anchor of a feature of the tier can be."""
    return (F.lit(float(r)) + F.lit(r / 4.0) * F.pow(F.lit(2.0), F.col("_tier"))) * _MARGIN


def _side(r: float) -> Column:
    return _reach(r) / _FINE


def _cell(coordinate: str, r: float) -> Column:
    """Cell number. The coalesce makes it non-nullable, so the optimizer infers no
    null filter that would evaluate the whole expression again below the join; a
    feature without coordinates still fails the exact test."""
    return F.coalesce(F.floor(F.col(coordinate) / _side(r)), F.lit(0).cast("bigint"))


def _at_home(feats: DataFrame, r: float) -> DataFrame:
    """Tier and home cell of every anchored feature."""
    small = F.lit(r / 4.0)
    tier = F.when(F.col("_half") <= small, 0).otherwise(F.ceil(F.log2(F.col("_half") / small))).cast("int")
    return (feats.withColumn("_tier", F.coalesce(tier, F.lit(0)))
            .withColumns({"_ci": _cell("_ax", r), "_cj": _cell("_ay", r)}))


def _probes(centres: DataFrame, sizes: DataFrame, kind: str, r: float, keys: list[str],
            centre_id: str) -> DataFrame:
    """Each centre in the cells its widened disc (of boxes: its widened box) touches, on every tier that has features."""
    tiers = (F.array(F.lit(0)) if kind == "points"
             else sizes.agg(F.collect_set("_tier")).scalar())  # a handful of small integers
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                        for i in range(-_FINE, _FINE + 1) for j in range(-_FINE, _FINE + 1)])

    def gap(position: str, cell: str) -> Column:
        low = F.col(cell) * F.col("_side")
        return F.greatest(low - F.col(position), F.col(position) - low - F.col("_side"), F.lit(0.0))

    away = F.greatest if kind == "boxes" else F.hypot
    touched = away(gap("_px", "_ci"), gap("_py", "_cj")) <= _reach(r)
    return (
        centres.select(*keys, centre_id, F.col("x").alias("_px"), F.col("y").alias("_py"))
        .withColumn("_tier", F.explode(tiers))
        .withColumn("_side", _side(r))
        .withColumn("_o", F.explode(offsets))
        .withColumns({"_ci": _cell("_px", r) + F.col("_o.i"), "_cj": _cell("_py", r) + F.col("_o.j")})
        .where(touched)
        .drop("_o", "_side")
    )


def _met(centres: DataFrame, home: DataFrame, kind: str, r: float, keys: list[str],
         centre_id: str, test: Column, rest: list[str], within: Column | None = None) -> DataFrame:
    """Pairs of a centre and an anchored feature that share a cell and pass the test; of polygons, if ``within`` is given, those
    that fulfil it or pass the exact test as well."""
    # a feature without coordinates meets nothing; left in, they would all share one cell
    home = _at_home(home.where(F.col("_ax").isNotNull() & F.col("_ay").isNotNull()), r)
    probes = _probes(centres, home, kind, r, keys, centre_id)
    pairs = home.join(probes, [*keys, "_tier", "_ci", "_cj"]).where(test)
    if within is not None:
        # functions of arrays in its condition would keep the join from being compiled; behind columns that count as not
        # deterministic they stay above it, and a whole feature leaves the join only where its bounds do not decide
        pairs = (pairs.select(*keys, centre_id, *[c for c in rest if c != "_edges"], "_px", "_py", within.alias("_within"),
                              F.when(within, None).otherwise(F.col("_edges")).alias("_edges"),
                              F.monotonically_increasing_id().alias("_at"))
                 .where((F.col("_at") >= 0) & (F.col("_within") | G.polygon_hits(F.col("_px"), F.col("_py"), r, F.col("_edges")))))
    return pairs.select(*keys, centre_id, *rest)


def _bounded(feats: DataFrame) -> DataFrame:
    """Add to anchored polygons their outermost vertices in four directions and their box (null if a vertex is not whole)."""
    def outermost(sx: int, sy: int) -> Column:
        return F.array_max(F.transform("_edges", lambda e: F.struct(
            (sx * e["x1"] + sy * e["y1"]).alias("far"), e["x1"].alias("x"), e["y1"].alias("y"))))

    whole = F.forall("_edges", lambda e: F.coalesce(F.abs(e["x1"]) + F.abs(e["y1"]) < F.lit(float("inf")), F.lit(False)))
    ends = {f"_{name}_{axis}": F.when(whole, fn(F.transform("_edges", lambda e: e[f"{axis}1"])))  # noqa: B023
            for axis in "xy" for name, fn in (("min", F.array_min), ("max", F.array_max))}
    corners = {f"_v{k}": outermost(sx, sy) for k, (sx, sy) in enumerate(_CORNERS)}
    return (feats.withColumns({**ends, **corners})
            .withColumns({f"_v{k}{axis}": F.col(f"_v{k}")[axis] for k in range(len(_CORNERS)) for axis in "xy"})
            .drop(*corners))


_CORNERS = ((1, 1), (1, -1), (-1, 1), (-1, -1))


def disc_join(centres: DataFrame, feats: DataFrame, kind: str, r: float, keys=("city",),
              centre_id: str = "pid") -> DataFrame:
    """Pairs (centre, feature) where the feature meets the disc, whole feature kept.

    The pairs are the result: their number grows with centres times features under a disc.
    """
    px, py = F.col("_px"), F.col("_py")
    test = exact_test(feats, kind, px, py, r)
    rest = [c for c in feats.columns if c not in keys]
    if kind == "points":
        return _met(centres, anchored(feats, kind), kind, r, list(keys), centre_id, test, rest)
    # squared once a feature, not once a pair, and to the next whole number, which packs better in a shuffle
    widest = (F.lit(float(r)) + F.col("_half")) * _MARGIN
    home = anchored(feats, kind).withColumn("_near", F.rint(widest * widest) + 1)
    # what follows from the ends of a segment does not travel
    ax, ay = (((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2) if kind == "lines" and "path" not in feats.columns
              else (F.col("_ax"), F.col("_ay")))
    away = G.distance_sq(px, py, ax, ay)
    # the anchor is a point of its feature; less than the radius by more than any rounding
    inner, outer = F.lit((float(r) / _MARGIN) ** 2), F.lit((float(r) * _MARGIN) ** 2)
    near, within = away <= F.col("_near"), away <= inner
    if kind == "polygons":  # so are its vertices, and nothing of it is outside its box
        home = _bounded(home)
        gaps = [F.greatest(F.col(f"_min_{axis}") - p, p - F.col(f"_max_{axis}"), F.lit(0.0)) for axis, p in (("x", px), ("y", py))]
        near = near & (F.col("_min_x").isNull() | (gaps[0] * gaps[0] + gaps[1] * gaps[1] <= outer))
        within = F.least(*[G.distance_sq(px, py, F.col(f"_v{k}x"), F.col(f"_v{k}y")) for k in range(len(_CORNERS))], away) <= inner
        return _met(centres, home, kind, r, list(keys), centre_id, near, rest, within)
    # a whole feature is looked at only where its bounds do not decide
    return _met(centres, home, kind, r, list(keys), centre_id, near & (within | test), rest)


def disc_join_points(centres, feats, r, keys=("city",), centre_id="pid") -> DataFrame:
    return disc_join(centres, feats, "points", r, keys, centre_id)


def disc_join_lines(centres, feats, r, keys=("city",), centre_id="pid") -> DataFrame:
    return disc_join(centres, feats, "lines", r, keys, centre_id)


def disc_join_polygons(centres, feats, r, keys=("city",), centre_id="pid") -> DataFrame:
    return disc_join(centres, feats, "polygons", r, keys, centre_id)


def box_candidates(centres, feats, r, keys=("city",), centre_id="pid") -> DataFrame:
    """Index prefilter: features whose box (min_x .. max_y) meets the disc's box."""
    r = float(r)
    sizes = [F.abs(F.col(f"max_{axis}") - F.col(f"min_{axis}")) for axis in "xy"]
    middle = {f"_a{axis}": (F.col(f"min_{axis}") + F.col(f"max_{axis}")) / 2 for axis in "xy"}
    home = (feats.withColumns({**middle, "_half": F.greatest(*sizes) / 2})
            .where(F.col("_half") < F.lit(float("inf"))))  # a box without an end meets nothing
    meets = ((F.col("min_x") <= F.col("_px") + r) & (F.col("max_x") >= F.col("_px") - r)
             & (F.col("min_y") <= F.col("_py") + r) & (F.col("max_y") >= F.col("_py") - r))
    return _met(centres, home, "boxes", r, list(keys), centre_id, meets, [c for c in feats.columns if c not in keys])


def zero_fill(centres: DataFrame, agg: DataFrame, on: list[str]) -> DataFrame:
    """Left join of an aggregate onto all centres, absent = 0."""
    values = [c for c in agg.columns if c not in on]
    return centres.join(agg, on, "left").fillna(0, subset=values)


def merge_copies(feats: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """Replace features of equal geometry by one that carries their summed measures.

    The map-side combine collapses a group of copies before anything is shuffled,
    however large the group is.
    """
    return feats.groupBy(*by).agg(*[F.sum(v).alias(n) for n, v in sums.items()])


# Most features and most centres of a block that one group holds; beyond, the block is cut by hashes.
_FEATURES, _CENTRES = 1_000_000, 200_000


def _block_totals(centres: DataFrame, feats: DataFrame, kind: str, shape: list[str], sums: dict[str, Column],
                  r: float, keys: list[str], centre_id: str) -> DataFrame:
    """Sums of the measures per centre and group of features that may meet its disc (partial sums).

    Blocks are four reaches wide, by tier, so a feature of any size enters at most two by
    two of them and a centre one a tier. The features are counted by block first, in a small
    job of their own; a block with too many features or centres for one group is cut.
    """
    block = [*keys, "_tier", "_bi", "_bj"]
    there = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys], F.lit(True))
    side = 4 * _reach(r)

    def located(layer: DataFrame) -> DataFrame:
        known = F.abs("_ax") + F.abs("_ay") < F.lit(float("inf"))  # null, NaN and infinite anchors meet nothing
        home = _at_home(anchored(layer, kind).where(there).where(known), r).drop("_ci", "_cj")
        for axis, out in (("_ax", "_bi"), ("_ay", "_bj")):
            ends = [F.floor((F.col(axis) + sign * _reach(r)) / side) for sign in (-1, 1)]
            home = home.withColumn(out, F.explode(F.sequence(*ends)))
        return home

    bare = feats.select(*keys, *shape)
    tiers = (F.array(F.lit(0)) if kind == "points"
             else _at_home(anchored(bare, kind).where(there), r).agg(F.collect_set("_tier")).scalar())
    spots = (centres.select(*keys, centre_id, F.col("x").cast("double").alias("_px"), F.col("y").cast("double").alias("_py"))
             .where(there & (F.abs("_px") + F.abs("_py") < F.lit(float("inf"))))
             .withColumn("_tier", F.explode(tiers))
             .withColumns({"_bi": F.floor(F.col("_px") / side), "_bj": F.floor(F.col("_py") / side)}))
    counts = (located(bare).groupBy(*block).agg(F.count("*").alias("_nf"), F.lit(0).cast("bigint").alias("_nc"))
              .unionByName(spots.groupBy(*block).agg(F.lit(0).cast("bigint").alias("_nf"), F.count("*").alias("_nc"))))
    heavy = written(counts.groupBy(*block).agg(F.max("_nf").alias("_nf"), F.max("_nc").alias("_nc"))
                    .where((F.col("_nf") > _FEATURES) | (F.col("_nc") > _CENTRES))
                    .select(*block, F.ceil(F.col("_nf") / _FEATURES).alias("_fp"), F.ceil(F.col("_nc") / _CENTRES).alias("_cp")))

    def cut(df: DataFrame, own: tuple[str, str], name: list[str], other: tuple[str, str]) -> DataFrame:
        """Each row in one part of its own side and in all parts of the other."""
        parts = {p: F.greatest(F.coalesce(F.col(p), F.lit(1)), F.lit(1)) for p in ("_fp", "_cp")}
        return (df.join(heavy, block, "left")
                .withColumn(own[1], F.pmod(F.xxhash64(*name), parts[own[0]]).cast("int"))
                .withColumn(other[1], F.explode(F.sequence(F.lit(0), (parts[other[0]] - 1).cast("int"))))
                .drop("_fp", "_cp"))

    segments = kind == "lines" and "path" not in shape
    geometry = ["_ax", "_ay"] if kind == "points" else shape if segments else ["_ax", "_ay", "_half", "_edges"]
    merged = merge_copies(feats, keys + shape, sums)
    names = list(sums)
    held = located(merged).select(*block, *[F.col(c) if c == "_edges" else F.col(c).cast("double") for c in geometry],
                                  *[F.col(n).cast("double").alias(n) for n in names])
    groups = [*block, "_f", "_c"]
    left = cut(spots, ("_cp", "_c"), [centre_id, "_px", "_py"], ("_fp", "_f"))
    # keys of their own names: both sides may come from one table
    right = cut(held, ("_fp", "_f"), geometry, ("_cp", "_c")).withColumnsRenamed({k: f"_key_{k}" for k in keys})
    own = [f"_key_{k}" for k in keys] + groups[len(keys):]
    keep, radius, what = [*keys, centre_id], float(r), "segments" if segments else kind

    def totals(a, b):
        return block_sums(a, b, what, radius, keep, names)

    schema = StructType([*[centres.schema[k] for k in keep], *[StructField(n, DoubleType()) for n in names]])
    return left.groupBy(*groups).cogroup(right.groupBy(*own)).applyInArrow(totals, schema)


def disc_sums(centres: DataFrame, layers: list[tuple[DataFrame, str, list[str], dict[str, Column]]],
              r: float, keys=("city",), centre_id: str = "pid") -> DataFrame:
    """Sums of feature measures over the disc of every centre, zero where nothing is met.

    ``layers`` holds (features, kind, geometry columns, measures). No pair is ever a row: centres
    and features meet in blocks, whose groups return partial sums (:mod:`discs`). These
    and a zero row per centre go through one aggregation, so there is no outer join.
    The layers are read twice.
    """
    keys = list(keys)
    names = list(dict.fromkeys(n for _, _, _, sums in layers for n in sums))
    parts = [centres.select(*keys, centre_id, *[F.lit(0.0).alias(n) for n in names])]
    for feats, kind, shape, sums in layers:
        met = _block_totals(centres, feats, kind, shape, sums, r, keys, centre_id)
        parts.append(met.select(*keys, centre_id, *[
            (F.col(n) if n in sums else F.lit(0.0)).alias(n) for n in names]))
    return (reduce(DataFrame.unionByName, parts).groupBy(*keys, centre_id)
            .agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names]))
