"""Training samples and agreement between labellers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def draw(frame: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows in the order of a seeded hash of their key (md5 of the parts as text), numbered as observation (a top-n, no full sort)."""
    mark = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), *[F.col(c).cast("string") for c in key]))
    marked = frame.withColumn("_mark", mark).orderBy("_mark", *key).limit(n)
    return marked.withColumn("observation", F.row_number().over(Window.orderBy("_mark", *key))).drop("_mark")  # at most n rows


def training_samples(pairs: DataFrame, *key: str, seed: int = 0, total: int = 1500, sizes: tuple[int, ...] = (350, 800, 350), negatives: int = 800) -> dict[str, DataFrame]:
    """Overlapping parts to label by hand, and rows whose label a rule gives."""
    rough = draw(pairs.withColumn("match", F.lit(None).cast("double")), total, seed, *key)
    parts = {f"part_{i + 1}": draw(rough.withColumnRenamed("observation", "_o"), n, seed + i + 1, "_o").drop("observation").withColumnRenamed("_o", "observation") for i, n in enumerate(sizes)}
    suffixed = pairs.where(F.col("Voters_NameSuffix") == "MD").withColumn("match", F.lit(1.0)) if "Voters_NameSuffix" in pairs.columns else pairs.limit(0).withColumn("match", F.lit(1.0))
    too_young = draw(pairs.where("year_dist < 10"), negatives, seed + 1, *key).withColumn("match", F.lit(0.0))
    return {"rough": rough, **parts, "positives": suffixed, "negatives": too_young}


def joined_labels(first: DataFrame, second: DataFrame, on: str = "observation", label: str = "match") -> DataFrame:
    """Two coders' labels of the observations that both have: label.x and label.y."""
    side = lambda f, end: f.select(on, F.col(label).alias(f"{label}.{end}"))
    return side(first, "x").join(side(second, "y"), on)


def coder_agreement(frame: DataFrame, first: str, second: str) -> DataFrame:
    """n, raw agreement and Cohen's kappa of two coders' labels of the same rows."""
    x, y = F.col(f"`{first}`"), F.col(f"`{second}`")
    cells = frame.where(x.isNotNull() & y.isNotNull()).groupBy(x.alias("a"), y.alias("b")).agg(F.count("*").cast("double").alias("n"))
    margin = lambda c: cells.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(f"m_{c}"))
    chance = margin("a").join(margin("b"), "label").agg(F.sum(F.col("m_a") * F.col("m_b")).alias("e"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0.0)).alias("same"))
    po, pe = F.col("same") / F.col("n"), F.coalesce("e", F.lit(0.0)) / (F.col("n") * F.col("n"))
    return total.join(F.broadcast(chance)).select(F.col("n").cast("long").alias("n"), po.alias("agreement"), F.try_divide(po - pe, 1 - pe).alias("kappa"))
