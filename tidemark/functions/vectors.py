"""Histograms and embeddings as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def intersection(a: Column, b: Column) -> Column:
    """Histogram intersection: sum of the smaller values."""
    return total(F.zip_with(a, b, lambda x, y: F.least(x, y)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """L2-normalised; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x / F.when(n > 0, n).otherwise(F.lit(1.0)))


def unit_mass(a: Column) -> Column:
    """Absolute values that add up to 1."""
    mass = total(F.transform(a, lambda x: F.abs(x)))
    return F.transform(a, lambda x: F.abs(x).cast("double") / F.nullif(mass, F.lit(0.0)))


def similarity(torso_a: Column, torso_b: Column, legs_a: Column, legs_b: Column, emb_a: Column | None = None, emb_b: Column | None = None) -> Column:
    """Likeness of two looks: torso, legs if both have them, embeddings if both have them; 0 without a torso."""
    upper = intersection(torso_a, torso_b)
    look = F.when(legs_a.isNotNull() & legs_b.isNotNull(), 0.7 * upper + 0.3 * intersection(legs_a, legs_b)).otherwise(upper)
    if emb_a is not None and emb_b is not None:
        near = F.least(F.greatest((dot(emb_a, emb_b) - 0.5) / 0.5, F.lit(0.0)), F.lit(1.0))
        look = F.when(emb_a.isNotNull() & emb_b.isNotNull(), 0.5 * look + 0.5 * near).otherwise(look)
    return F.when(torso_a.isNotNull() & torso_b.isNotNull(), look).otherwise(F.lit(0.0))


def mean_vectors(df: DataFrame, keys: list[str], vector: str, out: str = "mean") -> DataFrame:
    """Elementwise mean of array rows by key, added up before the shuffle; order kept by position."""
    parts = df.select(*keys, F.posexplode(vector).alias("pos", "v")).groupBy(*keys, "pos").agg(F.avg("v").alias("v"))
    sorted_ = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return parts.groupBy(*keys).agg(F.transform(sorted_, lambda s: s["v"]).alias(out))


def colour_histogram(pixels: DataFrame, keys: list[str], hues: int = 12, sats: int = 3, values: int = 8, least_sat: float = 0.2, least_val: float = 0.2) -> DataFrame:
    """Histogram of pixels (h 0-360, s and v 0-1): hue x saturation where there is colour, else value; unit mass.

    Gives one row a key with ``hist``, an array of hues * sats + values shares.
    """
    chromatic = (F.col("s") >= least_sat) & (F.col("v") >= least_val)
    hue = F.least(F.floor(F.col("h") / (360.0 / hues)), F.lit(hues - 1))
    sat = F.least(F.floor((F.col("s") - least_sat) / ((1 - least_sat) / sats)), F.lit(sats - 1))
    val = F.least(F.floor(F.col("v") * values), F.lit(values - 1))
    cell = F.when(chromatic, hue * sats + sat).otherwise(hues * sats + val).cast("int")
    n = hues * sats + values
    counts = pixels.withColumn("cell", cell).groupBy(*keys, "cell").agg(F.count("*").alias("n"))
    table = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("m"), F.sum("n").alias("all"))
    share = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)) / F.col("all"))
    return table.select(*keys, share.alias("hist"))
