"""Brand kits and voice profiles: checked settings over defaults, palettes, samples."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import hex_colour, luminance, saturation

NEUTRAL, DARK = 0.15, 140


def valid_colour(x: Column) -> Column:
    return x.rlike("^#[0-9A-Fa-f]{6}$")


def kit_errors(kit: DataFrame) -> DataFrame:
    """Kits with the names of their bad fields: colours that aren't hex, fewer than 1 or more than 10 words a cue, margins outside 0 to 0.45; an absent field is no error."""
    bad = [("primary", ~valid_colour(F.col("primary"))), ("accent", ~valid_colour(F.col("accent"))), ("max_words", ~F.col("max_words").between(1, 10)), ("margin", ~F.col("margin").between(0.0, 0.45))]
    return kit.withColumn("errors", F.filter(F.array(*[F.when(c, n) for n, c in bad]), lambda x: x.isNotNull()))


def palette(pixels: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """(colour, n, saturation, neutral, text_colour, role) of pixels (r, g, b): k-means colours by size; the largest is primary, the most saturated that isn't neutral the accent."""
    vectors = VectorAssembler(inputCols=["r", "g", "b"], outputCol="features").transform(pixels)
    model = KMeans(k=k, seed=seed).fit(vectors)
    sizes = model.transform(vectors).groupBy("prediction").agg(F.count("*").alias("n"))
    centres = pixels.sparkSession.createDataFrame([(i, *map(float, c)) for i, c in enumerate(model.clusterCenters())], "prediction int, r double, g double, b double")
    c = [F.round(x) for x in ("r", "g", "b")]
    found = centres.join(sizes, "prediction").select(hex_colour(*c).alias("colour"), "n", saturation(*c).alias("saturation"), F.when(luminance(*c) > DARK, "#000000").otherwise("#ffffff").alias("text_colour")).withColumn("neutral", F.col("saturation") < NEUTRAL)
    tops = found.agg(F.max_by("colour", F.struct("n", "colour")).alias("p"), F.max_by("colour", F.when(~F.col("neutral"), F.struct("saturation", "colour"))).alias("a"))
    return found.join(F.broadcast(tops)).withColumn("role", F.when(F.col("colour") == F.col("p"), "primary").when(F.col("colour") == F.col("a"), "accent")).drop("p", "a")


def niche(idf: DataFrame, most: int = 5) -> DataFrame:
    """The rarest terms of five letters or more, ties by name."""
    return idf.filter(F.length("term") >= 5).orderBy(F.desc("idf"), "term").limit(most).select("term")
