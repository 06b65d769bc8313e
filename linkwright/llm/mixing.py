"""Mixing sources to target weights by the cube method.

``mix_sources(docs)`` gives every document the words that a mix takes from it. Sources in code
point order (NULL last) weigh 5, 2, 1, repeating, and share 100% of all words; a target stops at
``MOST`` times its source's size and the excess goes to the others by weight, until none is above.
With r = target / source size each document is taken floor(r) times, and once more with inclusion
probability r - floor(r). The cube method settles these probabilities: its flight moves three
documents' probabilities at a time along the direction that keeps both the number of documents and
the number of words, until one of them is 0 or 1; at most two documents a block stay open.

Equal rows (id, source and size) are counted before the flight: of c of them floor(c * probability)
are taken at once and one of them flies with what is left. Sources are dealt into blocks by a hash,
however large they are; the open documents of all blocks fly again in the next round. About
``RESERVE`` documents of each source and size class (powers of two) do not fly: they and a source's
last two open documents are the landing problem, settled by the subset whose words are nearest to
those expected. A source so misses its target by less than its smallest documents, unless it has
too few documents to come nearer. Random steps are seeded by source, block and round, so reruns
agree.

Cases: NULL text has size 0; a source of size 0 has target 0; NULL source is a source of its own;
repeated ids and rows are separate documents; an empty table gives an empty result; other columns
are not carried.
"""

from __future__ import annotations

import random
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import durable, prepared

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
BLOCK_ROWS = 20_000
#: Documents of a source and size class that wait for the landing (their number varies by a hash; all of them where there are no more).
RESERVE = 16
#: Words of the landing documents that the exact choice ranges over; the larger ones beyond are rounded one after the other before it.
LAND_WORDS = 1 << 20
#: With up to so many sources their table is broadcast (under 10 MB), and joined by shuffling beyond; rows are the same.
BROADCAST_SOURCES = 100_000
_NEAR = 1e-9


def n_words(column: str = "text"):
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, n, sid, target) of each source of (source, size) rows."""
    spark = sized.sparkSession
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    # ranks of range-partitioned, sorted rows: the partition's place in the order (one row for each partition) and the row's in it
    placed = sums.repartitionByRange(F.col("source").isNull(), F.col("source")).sortWithinPartitions(F.col("source").isNull(), "source")
    placed = durable(placed.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = placed.join(F.broadcast(parts), "_part").withColumn("sid", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = durable(ranked.withColumn("weight", weight))
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    # targets are min(most * size, rate * weight); the rate only rises, so few rounds settle it (sums of whole numbers, so in any order the same)
    rate, last = 0.0, -1.0
    while rate != last:
        capped = F.col("weight") * rate > most * F.col("source_size")
        fixed, free = ranked.agg(F.sum(F.when(capped, F.col("source_size")).otherwise(0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        last, rate = rate, (total - most * (fixed or 0)) / free if free else rate
    return ranked.withColumn("target", F.least(most * F.col("source_size"), rate * F.col("weight"))).drop("weight")


def fly(sizes: list[float], chance: list[float], rng: random.Random) -> list[float]:
    """The flight: chances moved to 0 or 1, keeping their sum and the sum of size * chance; two may stay open."""
    chance = list(chance)
    window: list[int] = []
    for k in range(len(chance)):
        if _NEAR < chance[k] < 1 - _NEAR:
            window.append(k)
        else:
            chance[k] = float(round(chance[k]))
        while len(window) == 3:
            a, b, c = window
            v = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            if not any(v):
                v = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for k3, x in zip(window, v, strict=True):
                if x > 0:
                    up, down = min(up, (1 - chance[k3]) / x), min(down, chance[k3] / x)
                elif x < 0:
                    up, down = min(up, -chance[k3] / x), min(down, -(1 - chance[k3]) / x)
            step = up if rng.random() * (up + down) < down else -down
            still = []
            for k3, x in zip(window, v, strict=True):
                chance[k3] = p = min(1.0, max(0.0, chance[k3] + step * x))
                if _NEAR < p < 1 - _NEAR:
                    still.append(k3)
                else:
                    chance[k3] = float(round(p))
            window = still
    return chance


def land(sizes: list[int], chance: list[float], words: int = LAND_WORDS) -> list[float]:
    """Settles the open chances by the choice whose words are nearest to those expected."""
    chance = list(chance)
    still = sorted((k for k, p in enumerate(chance) if 0 < p < 1), key=lambda k: (sizes[k], k))
    total = list(accumulate(sizes[k] for k in still))
    exact = bisect_right(total, words)
    want = 0.0
    for k in reversed(still[exact:]):  # one after the other, the error carried on
        want += chance[k] * sizes[k]
        chance[k] = float(2 * want >= sizes[k])
        want -= chance[k] * sizes[k]
    for k in (own := still[:exact]):
        want += chance[k] * sizes[k]
    reach = [1]  # bit s: the first documents have a subset of s words
    for k in own:
        reach.append(reach[-1] | reach[-1] << sizes[k])
    goal = max(0, round(want))
    below, above = (reach[-1] & ((2 << goal) - 1)).bit_length() - 1, reach[-1] >> goal
    above = goal + (above & -above).bit_length() - 1 if above else None
    s = below if above is None or want - below <= above - want else above
    for k, had in zip(reversed(own), reversed(reach[:-1]), strict=True):
        chance[k] = float(not had >> s & 1) if sizes[k] else float(round(chance[k]))
        s -= int(chance[k]) * sizes[k]
    return chance


def _fly_block(seed: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("mark", "ascending"), ("doc_id", "ascending")])
        sid, block = table["sid"][0].as_py(), table["block"][0].as_py()
        chance = fly(table["size"].to_pylist(), table["chance"].to_pylist(), random.Random(f"{seed}/{sid}/{block}"))
        return table.set_column(table.schema.get_field_index("chance"), "chance", pa.array(np.array(chance, float)))

    return run


def _land_source(table: pa.Table) -> pa.Table:
    table = table.sort_by([("size", "ascending"), ("mark", "ascending"), ("doc_id", "ascending")])
    chance = land(table["size"].to_pylist(), table["chance"].to_pylist())
    return table.set_column(table.schema.get_field_index("chance"), "chance", pa.array(np.array(chance, float)))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken) of every row of docs."""
    prepared(docs.sparkSession)
    sized = durable(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text_col).alias("size")))
    targets = source_targets(sized)
    few = targets.count() <= BROADCAST_SOURCES
    spread = lambda f: F.broadcast(f) if few else f
    named = targets.withColumnRenamed("source", "_source")
    rows = sized.join(spread(named), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(ratio + _NEAR)).withColumn("chance", F.greatest(F.lit(0.0), ratio - F.col("whole")))
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    # of equal rows the whole part is taken at once (again), and one flies
    rows = rows.withColumn("again", F.floor(F.col("copies") * F.col("chance") + _NEAR)).withColumn("chance", F.greatest(F.lit(0.0), F.col("copies") * F.col("chance") - F.col("again")))
    kind = F.floor(F.log2(F.col("size") + F.lit(1.0))).cast("int")
    rows = durable(rows.withColumn("mark", F.xxhash64("doc_id", "size")).withColumn("kind", kind))
    classes = rows.groupBy("sid", "kind").agg(F.count("*").alias("n_kind"))
    waits = F.pmod(F.xxhash64("mark", F.lit("reserve")), "n_kind") < RESERVE
    # some ten classes a source
    rows = rows.join(spread(classes), ["sid", "kind"]).withColumn("waits", waits).drop("kind", "n_kind")
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS)).withColumn("block", F.pmod(F.xxhash64("mark"), "blocks")).withColumn("open", F.col("chance").between(_NEAR, 1 - _NEAR))
    schema, level = rows.schema, 0
    landing, done = rows.where("open and waits"), rows.where("not open").withColumn("chance", F.round("chance"))
    rows = rows.where("open and not waits")
    while True:
        rows = durable(rows.groupBy("sid", "block").applyInArrow(_fly_block(level), schema))
        done = done.unionByName(rows.where("chance in (0.0, 1.0)"))
        rows = rows.where("chance not in (0.0, 1.0)")
        landing = landing.unionByName(rows.where("blocks = 1"))
        rows = rows.where("blocks > 1")
        if rows.isEmpty():
            break
        level += 1
        # two documents a block are open: the next round has so much fewer blocks
        rows = rows.withColumn("blocks", F.ceil(2 * F.col("blocks") / BLOCK_ROWS)).withColumn("block", F.pmod(F.xxhash64("mark", F.lit(level)), "blocks"))
    done = done.unionByName(landing.groupBy("sid").applyInArrow(_land_source, schema))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    more = (F.col("copy") <= F.col("again") + F.col("chance")).cast("long")
    return done.select("*", copy).select(F.col("doc_id").alias(id_col), "size", "source_size", "target", (F.col("size") * (F.col("whole") + more)).cast("long").alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    from .frames import documents

    return mix_sources(documents(spark, sf_dir))
