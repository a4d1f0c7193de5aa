"""Normalisation of labels, pixels and features, and its inverse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LABEL_MAX = 80_000.0
STD_FLOOR = 1e-4
DEM_RANGE = (-50.0, 3000.0)
LANDUSE_CLASSES = 8
REFLECTANCE_MAX = 3000.0
IMAGENET_MEAN = {"red": 0.485, "green": 0.456, "blue": 0.406}
IMAGENET_STD = {"red": 0.229, "green": 0.224, "blue": 0.225}
CHANNELS = ("red", "green", "blue")


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def log_clip(value: Column, high: float = LABEL_MAX) -> Column:
    return F.log1p(clip(value, 0.0, high))


def zscore(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / std


def inverse_target(z: Column, mean: Column, std: Column) -> Column:
    """Back from a z-score of the log label to a count."""
    return F.expm1(z * std + mean)


def dem_norm(height: Column) -> Column:
    low, high = DEM_RANGE
    return (clip(height, low, high) - low) / (high - low)


def one_hot_landuse(landuse: Column, n: int = LANDUSE_CLASSES) -> Column:
    """``n`` binary values; all zero for a class outside 0 .. n-1."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda k: F.coalesce((landuse == k).cast("tinyint"), F.lit(0).cast("tinyint")))


def city_prewarp(value: Column, channel: str, city_mean: Column, city_std: Column) -> Column:
    """Value whose later ImageNet normalisation is the z-score within its city."""
    return IMAGENET_MEAN[channel] + IMAGENET_STD[channel] * (value - city_mean) / city_std


def imagenet_norm(value: Column, channel: str) -> Column:
    """Channels other than the three colours pass unchanged."""
    if channel not in IMAGENET_MEAN:
        return value
    return (value - IMAGENET_MEAN[channel]) / IMAGENET_STD[channel]


def reflectance_to_byte(value: Column) -> Column:
    """0 .. 3000 to 0 .. 255, truncated; null (never seen clear) is black."""
    return F.floor(F.coalesce(clip(value, 0.0, REFLECTANCE_MAX), F.lit(0.0)) / REFLECTANCE_MAX * 255)


def ndvi(nir: Column, red: Column) -> Column:
    """Vegetation index, null where both bands are zero."""
    return (nir - red) / F.nullif(nir + red, F.lit(0).cast("double"))


def percent_error(pred: Column, target: Column) -> Column:
    return 100 * F.abs(pred - target) / F.greatest(target, F.lit(1.0))


def huber_loss(pred: Column, target: Column) -> Column:
    d = F.abs(pred - target)
    return F.when(d <= 1, 0.5 * d * d).otherwise(d - 0.5)


def default_features(features: Column, n: int = 15) -> Column:
    """The feature list if it is there and complete, else ``n`` zeros."""
    return F.when(F.size(features) == n, features).otherwise(F.array_repeat(F.lit(0.0), n))
