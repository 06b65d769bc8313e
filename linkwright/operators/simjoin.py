"""Exact set-similarity join on character n-grams, by prefix filtering.

Pairs with Jaccard >= t must share one of the first |x| - ceil(t |x|) + 1 grams of both sides when
grams are ordered rarest first. Rows with equal sets and blocks are one row with the list of their
keys (of CHUNK keys or so; more make further rows), so copies are compared once and only listed
in the result. Each row goes to every gram of its prefix; what meets there in more than PART rows
of a side is dealt out in pairs of parts. Where rows meet they are compared in NumPy: first by
their places in the prefixes (what shares nothing before a gram shares at most what follows it),
then by short signatures, whose distance never exceeds that of the sets, then by the sets as bits
over the grams that the rows at hand share. A pair counts only at the first gram that both prefixes
share, so no pair is made twice, and nothing is joined back. The sets and their prefixes are computed when
the join is planned and kept in the checkpoint folder, as every later step reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ngrams
from .durable import durable

#: Keys that a row lists, and rows of a side that meet in a block, on average.
CHUNK, PART = 64, 8_000


def _sets(side: DataFrame, key: str, text: str, blocks: list[str], k: int, chunk: int) -> DataFrame:
    """(blocks, s, ids): the grams of a set, sorted and one after the other, and keys that have it."""
    names = [f"b{i}" for i in range(len(blocks))]
    rows = side.select(F.col(key).alias("id"), *[F.col(b).alias(n) for n, b in zip(names, blocks, strict=True)], F.array_join(F.array_sort(ngrams(F.col(text), k)), "").alias("s"))
    rows = rows.where(F.col("s") != "").dropna(subset=names).distinct() if names else rows.where(F.col("s") != "").distinct()
    many = rows.groupBy(*names, "s").agg(F.count("*").alias("c")).where(f"c > {chunk}")
    rows = rows.join(many, [*names, "s"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / chunk)), F.lit(0)))
    return rows.groupBy(*names, "s", "part").agg(F.collect_list(F.struct("id")).alias("ids")).drop("part")


def _compared(keys: list[str], k: int, t: float, itself: bool, ascending: bool):
    """Batches sorted by keys and left -> (left_id, right_id, sim). A closure, so that workers need no package."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def tables(most=4_000):
            """Whole groups and where they start."""
            held, rows = [], 0
            for batch in batches:
                held.append(batch)
                rows += batch.num_rows
                if rows >= most:
                    table = pa.Table.from_batches(held)
                    starts = bounds(table)
                    if starts[-1]:
                        yield table.slice(0, starts[-1]), starts[:-1]
                    held = table.slice(starts[-1]).combine_chunks().to_batches()
                    rows = 0  # the last group goes on, perhaps
            if held and (table := pa.Table.from_batches(held)).num_rows:
                yield table, bounds(table)

        def bounds(table):
            new = np.zeros(table.num_rows, bool)
            new[:1] = True
            for c in keys:
                column = table[c].combine_chunks()
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
            return np.flatnonzero(new)

        def coded(texts):
            """A number for each k characters, in their order."""
            points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, k)
            out = points[:, 0]
            for j in range(1, k):
                if j >= 3:
                    out = np.unique(out, return_inverse=True)[1].astype(np.uint64)
                out = (out << np.uint64(21)) | points[:, j]
            return out

        def as_bits(row, rank, rows, words):
            out = np.zeros((rows, words), np.uint64)
            np.bitwise_or.at(out, (row, rank >> 6), np.uint64(1) << (rank & 63).astype(np.uint64))
            return out

        def keyed(column):
            column = column.combine_chunks()
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            return column.flatten().field("id"), size, np.cumsum(size) - size

        def listed(a, b, sim, left, right, alone):
            """All keys of rows a with all keys of rows b; alone: a row with itself."""
            for i in range(0, len(a), 20_000):
                x, y = a[i : i + 20_000], b[i : i + 20_000]
                both = left[1][x] * right[1][y]
                ends = np.cumsum(both)
                for j in range(0, int(both.sum()), 200_000):
                    at = np.arange(j, min(j + 200_000, ends[-1]))
                    pair = np.searchsorted(ends, at, side="right")
                    at = at - (ends - both)[pair]
                    l = left[0].take(pa.array(left[2][x][pair] + at // right[1][y][pair]))  # noqa: E741
                    r = right[0].take(pa.array(right[2][y][pair] + at % right[1][y][pair]))
                    s = pa.array(sim[i : i + 20_000][pair])
                    if ascending:
                        up = pc.fill_null(pc.less(l, r), False)
                        if itself and not alone:
                            l, r, up = pc.if_else(up, l, r), pc.if_else(up, r, l), pc.fill_null(pc.not_equal(l, r), False)  # noqa: E741
                        l, r, s = l.filter(up), r.filter(up), s.filter(up)  # noqa: E741
                    yield pa.RecordBatch.from_arrays([l, r, s], names=["left_id", "right_id", "sim"])

        for table, starts in tables():
            rows = table.num_rows
            sets, prefixes, grams = (table[c].to_pylist() for c in ("s", "prefix", "gram"))
            n, p = (np.array([len(x) // k for x in xs], np.int64) for xs in (sets, prefixes))
            code = coded(sets + prefixes + grams)
            own, prefix, here = code[: n.sum()], code[n.sum() : n.sum() + p.sum()], code[n.sum() + p.sum() :]
            row = np.repeat(np.arange(rows), n)
            names, rank, count = np.unique(own, return_inverse=True, return_counts=True)
            shared = count > 1  # other grams are in no two sets
            place = np.empty(len(names), np.int64)
            place[np.argsort(-np.where(shared, count, 0), kind="stable")] = np.arange(len(names))  # the commonest grams stand in the first word
            words = max(1, -(-int(shared.sum()) // 64))
            kept = shared[rank]
            bits = as_bits(row[kept], place[rank[kept]], rows, words)
            rank_p, row_p = np.searchsorted(names, prefix), np.repeat(np.arange(rows), p)
            local = np.arange(len(prefix)) - np.repeat(np.cumsum(p) - p, p)
            at = local[prefix == np.repeat(here, p)]  # where in its prefix a row stands
            kept = (local < np.repeat(at, p)) & shared[rank_p]
            earlier = as_bits(row_p[kept], place[rank_p[kept]], rows, words)
            wide = min(16, max(2, -(-3 * int(n.sum()) // (64 * rows))))
            short = as_bits(row, ((own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % (64 * wide), rows, wide)
            share = (1 - t) / (1 + t)
            sums = np.arange(2 * int(n.max()) + 1)
            most = np.floor(sums * share + 1e-6).astype(np.int64)  # the greatest distance of a pair, by the sum of its sizes
            need = (-(-(sums - most) // 2)).astype(np.int32)  # the grams that it shares at least
            size, reach = n.astype(np.int32), (n - at).astype(np.int32)  # reach: grams left where none was shared before

            left = keyed(table["lids"])
            right = left if itself else keyed(table["rids"])
            is_left = table["left"].combine_chunks().to_numpy(zero_copy_only=False)
            diagonal = table["diagonal"].combine_chunks().to_numpy(zero_copy_only=False)

            def exact(a, b):
                fits = (earlier[a, 0] & earlier[b, 0]) == 0  # noqa: B023  most of those that have met before
                a, b = a[fits], b[fits]
                for i in range(0, len(a), step := max(1, 2_000_000 // words)):  # noqa: B023
                    x, y = a[i : i + step], b[i : i + step]
                    fits = ~(earlier[x] & earlier[y]).any(axis=1)  # noqa: B023
                    x, y = x[fits], y[fits]
                    common = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64)  # noqa: B023
                    sim = common / (n[x] + n[y] - common)  # noqa: B023
                    fits = sim >= t
                    yield from listed(x[fits], y[fits], sim[fits], left, right, False)  # noqa: B023

            def close(x, y):
                """Those that can share enough, by place and then by signature."""
                fits = np.minimum(reach[x], reach[y]) >= need[size[x] + size[y]]  # noqa: B023
                x, y = x[fits], y[fits]
                fits = np.bitwise_count(short[x] ^ short[y]).sum(axis=1, dtype=np.int64) <= most[size[x] + size[y]]  # noqa: B023
                return x[fits], y[fits]

            def by_size(rows):
                """Size and (rows, -reach) of each size, what reaches farthest first."""
                rows = rows[np.lexsort((-reach[rows], size[rows]))]  # noqa: B023
                found, begin = np.unique(size[rows], return_index=True)  # noqa: B023
                return [(v, x, -reach[x]) for v, x in zip(found.tolist(), np.split(rows, begin[1:]), strict=True)]  # noqa: B023

            def dense(a, b, square):
                """Pairs of many rows. square: of a with itself."""
                u = by_size(a)
                v = u if square else by_size(b)
                if len(u) * len(v) * 8_000 > len(a) * len(b):  # too many sizes to go through one by one
                    for i in range(0, len(a), step := max(1, 400_000 // len(b))):
                        x = a[i : i + step]
                        y = b[i:] if square else b
                        x, y = np.nonzero(np.minimum(reach[x][:, None], reach[y][None, :]) >= need[size[x][:, None] + size[y][None, :]])  # noqa: B023
                        x, y = a[x + i], b[y + i * square]
                        yield close(x[x < y], y[x < y]) if square else close(x, y)
                    return
                for size_a, rows_a, far_a in u:
                    for size_b, rows_b, far_b in v:
                        least = int(need[size_a + size_b])  # noqa: B023
                        if least > min(size_a, size_b) or square and size_b < size_a:
                            continue
                        x, y = (rows[: np.searchsorted(far, -least, side="right")] for rows, far in ((rows_a, far_a), (rows_b, far_b)))  # noqa: B023
                        limit = min(int(most[size_a + size_b]), 255 if wide <= 3 else 65_535)  # noqa: B023
                        for i in range(0, len(x) * bool(len(y)), step := max(1, 400_000 // max(1, len(y)))):
                            far = np.zeros((len(x[i : i + step]), len(y)), np.uint8 if wide <= 3 else np.uint16)  # noqa: B023
                            for w in range(wide):  # noqa: B023
                                far += np.bitwise_count(short[x[i : i + step], w][:, None] ^ short[y, w][None, :])  # noqa: B023
                            c, d = np.nonzero(far <= limit)
                            if square and size_a == size_b:
                                c, d = c[c + i < d], d[c + i < d]
                            yield x[c + i], y[d]

            ends = np.append(starts[1:], rows)
            lefts = np.add.reduceat(is_left.astype(np.int64), starts)
            whole = diagonal[starts]
            lefts[whole] = (ends - starts)[whole]
            rights = np.where(whole, lefts, ends - starts - lefts)
            first_right = np.where(whole, starts, starts + lefts)
            large = lefts * rights > 4_096

            def candidates():
                for s, c, f, d, square in zip(starts[large].tolist(), lefts[large].tolist(), first_right[large].tolist(), rights[large].tolist(), whole[large].tolist(), strict=True):  # noqa: B023
                    yield from dense(np.arange(s, s + c), np.arange(f, f + d), square)  # noqa: B023
                small = np.flatnonzero(~large & (lefts * rights > 0))  # noqa: B023
                group = np.repeat(small, lefts[small])  # noqa: B023
                if not len(group):
                    return
                a = starts[group] + np.arange(len(group)) - np.repeat(np.cumsum(lefts[small]) - lefts[small], lefts[small])  # noqa: B023
                done = np.cumsum(rights[group])  # noqa: B023
                for i in range(0, len(a), 20_000):  # at most 4,096 pairs of a row
                    part = slice(i, i + 20_000)
                    cuts = np.unique(np.searchsorted(done[part], np.arange(done[part][0], done[part][-1] + 500_000, 500_000)))
                    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(a[part])], strict=True):
                        if hi <= lo:
                            continue
                        u, v = a[part][lo:hi], group[part][lo:hi]
                        r = rights[v]  # noqa: B023
                        x = np.repeat(u, r)
                        y = np.repeat(first_right[v], r) + np.arange(len(x)) - np.repeat(np.cumsum(r) - r, r)  # noqa: B023
                        fits = np.repeat(~whole[v], r) | (x < y)  # noqa: B023
                        yield close(x[fits], y[fits])

            held, many = [], 0
            for x, y in candidates():
                held.append((x, y))
                many += len(x)
                if many >= 50_000:
                    yield from exact(*map(np.concatenate, zip(*held, strict=True)))
                    held, many = [], 0
            if many:
                yield from exact(*map(np.concatenate, zip(*held, strict=True)))
            if itself:  # copies meet in their own row, at its least gram
                x = np.flatnonzero(diagonal & (left[1] > 1) & (at == 0))
                yield from listed(x, x, np.ones(len(x)), left, right, True)

    return run


def similarity_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_text: str, right_text: str | None = None, *, k: int = 3, threshold: float = 0.7, blocks: list[str] | dict[str, str] | None = None, ascending: bool = False, chunk: int = CHUNK, part: int = PART) -> DataFrame:
    """(left_id, right_id, sim) of all pairs with equal blocks and n-gram Jaccard >= threshold (above 0).

    blocks: columns that must be equal (names on the left mapped to those on the right if they
    differ). ascending: only pairs with left_id < right_id, as a join of a table with itself needs.
    Rows that repeat a key, its blocks and its set of grams count once; with another set they may
    give a pair again. Texts shorter than k have no grams and pair with nothing; NULL blocks pair
    with nothing. chunk and part change the plan only.
    """
    spark = left.sparkSession
    blocks = blocks if isinstance(blocks, dict) else {b: b for b in blocks or []}
    names = [f"b{i}" for i in range(len(blocks))]
    itself = ascending and left is right and not right_text and all(x == y for x, y in blocks.items()) and left_key == right_key
    kinds = [left.schema[left_key].dataType, right.schema[right_key].dataType]
    listed = [T.ArrayType(T.StructType([T.StructField("id", kind)])) for kind in kinds]
    a = _sets(left, left_key, left_text, list(blocks), k, chunk).select(*names, "s", F.col("ids").alias("lids"), F.lit(None).cast(listed[1]).alias("rids"), F.lit(True).alias("left"))
    every = a
    if not itself:
        b = _sets(right, right_key, right_text or left_text, list(blocks.values()), k, chunk)
        every = a.unionByName(b.select(*names, "s", F.lit(None).cast(listed[0]).alias("lids"), F.col("ids").alias("rids"), F.lit(False).alias("left")))
    every = durable(every)
    classes = every.select(*names, "s").distinct()
    size = F.char_length("s") / k
    grams = classes.select(*names, "s", F.explode(F.transform(F.sequence(F.lit(0), size.cast("int") - 1), lambda i: F.substring(F.col("s"), i * k + 1, F.lit(k)))).alias("gram"))
    frequency = grams.groupBy(*names, "gram").agg(F.count("*").alias("df"))
    n = F.size("g")
    # with room for the product's rounding
    first = F.slice("g", F.lit(1), n - F.ceil(F.lit(threshold) * n - F.lit(1e-9)).cast("int") + 1)
    ranked = grams.join(frequency, [*names, "gram"]).groupBy(*names, "s").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "gram"))), lambda x: x["gram"]).alias("g"))
    prefixes = durable(ranked.select(*names, "s", first.alias("g")))
    posted = every.join(prefixes, [*names, "s"]).select(*names, "s", "lids", "rids", "left", F.array_join("g", "").alias("prefix"), F.explode("g").alias("gram"))
    met = posted.groupBy(*names, "gram").agg(F.count_if("left").alias("nl"), F.count_if(~F.col("left")).alias("nr"), F.max(F.size("lids")).alias("most"))
    parts = lambda c: F.ceil(F.col(c) / part).cast("int")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    if itself:
        met = met.where("nl > 1 or most > 1").select(*names, "gram", parts("nl").alias("ps"))
        posted = posted.join(met, [*names, "gram"]).withColumn("own", F.pmod(F.xxhash64("s", "lids"), F.col("ps")).cast("int")).withColumn("other", F.explode(upto("ps")))
        posted = posted.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other"), "diagonal": F.col("own") == F.col("other")}).withColumn("left", F.col("own") == F.col("p"))
    else:
        met = met.where("nl > 0 and nr > 0").select(*names, "gram", parts("nl").alias("pl"), parts("nr").alias("pr"))
        posted = posted.join(met, [*names, "gram"]).withColumn("own", F.pmod(F.xxhash64("s", "lids", "rids"), F.when(F.col("left"), F.col("pl")).otherwise(F.col("pr"))).cast("int"))
        posted = posted.withColumn("other", F.explode(F.when(F.col("left"), upto("pr")).otherwise(upto("pl"))))
        posted = posted.withColumns({"p": F.when(F.col("left"), F.col("own")).otherwise(F.col("other")), "q": F.when(F.col("left"), F.col("other")).otherwise(F.col("own")), "diagonal": F.lit(False)})
    keys = [*names, "gram", "p", "q"]
    # a number of its own: few bytes can be much work, and what is dealt by bytes would meet in a few tasks
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    posted = posted.select(*keys, "left", "diagonal", "s", "prefix", "lids", "rids").repartition(tasks, *keys).sortWithinPartitions(*keys, F.desc("left"))
    schema = T.StructType([T.StructField("left_id", kinds[0]), T.StructField("right_id", kinds[1]), T.StructField("sim", T.DoubleType())])
    return posted.mapInArrow(_compared(keys, k, threshold, itself, ascending), schema)
