"""MinHash near-dedup: documents whose sets of five-word shingles have a Jaccard index of a given threshold.

``near_duplicates(docs, share=85)`` gives each document its set size and component: documents are
linked when 100 * intersection >= share * union of their full shingle sets, and the component is
the least id reachable over links. Trees, the signatures' likely agreement and the bound on sizes
follow from the threshold (``Limit``).

1. Documents with equal sets form a class; from here on each class counts once, under a number of
   its own. Classes that hold the same id are joined.
2. Each class has a MinHash signature (one permutation, empty bins filled by optimal
   densification), read as an LSH forest: trees that are each a sequence of ``DEPTH`` values.
   Sorted by such a sequence, classes with a common prefix stand together. Prefixes of
   ``LEAST_DEPTH`` values make the regions; a region with more than ``REGION`` classes is cut at a
   greater depth, and at full depth dealt out at random, in each tree anew.
3. Within a region the longest-common-prefix neighbours whose signatures agree in 0.70 of the
   values (at 0.85; less below) join provisional groups (only edges that join two groups are kept).
4. Provisional groups hold every link, so links are confirmed inside them on the full sets. A
   group over ``GROUP`` classes or ``GROUP_SHINGLES`` shingles is cut by the forest's regions, at
   the depth that keeps them bounded.
5. Regions over ``REGION`` classes were cut, so their pairs are settled exactly: the classes outside
   a region's largest component so far are searched among all of the region's classes, in blocks of
   bounded size, and links between different components are confirmed on full sets.

A pair at the limit shares no region of four values with a chance of 7e-6 at 0.85 (16 trees) and
3e-6 at 0.80 (24 trees), and less the more alike it is.

Cases: NULL or empty text has an empty set and links with nothing; a NULL id stays alone with a
NULL component and is kept; repeated ids count as one document for links; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import U64, group_bounds, group_starts, mix, pack, ranges, shingle_sets, slices, text_bytes, unpack, words
from .components import connected_components
from .frames import durable, prepared, release

DEPTH, LEAST_DEPTH = 8, 4
#: The greatest chance that a pair at the limit shares no region, and the deviations that its signatures may fall short by.
MISS, DEVIATIONS = 1e-5, 4.75
REGION = 1_000
PART, PART_SHINGLES = 500, 500_000
GROUP, GROUP_SHINGLES = 1_000, 1_000_000
#: The threshold of op7's contract, in hundredths.
SHARE = 85


class Limit(NamedTuple):
    """What follows from a threshold of share hundredths."""

    share: int
    trees: int
    likely: float

    @classmethod
    def of(cls, share: int) -> Limit:
        if not 0 < share <= 100:
            raise ValueError(f"share is in hundredths, above 0 and up to 100: {share}")
        s, trees = share / 100, 8
        while (1 - s**LEAST_DEPTH) ** trees > MISS:
            trees += 8
        return cls(share, trees, s - DEVIATIONS * math.sqrt(s * (1 - s) / (trees * DEPTH)))

    @property
    def bins(self) -> int:
        return self.trees * DEPTH

    def alike(self, agree: np.ndarray, n, m) -> np.ndarray:
        """Whether pairs of sets of n and m shingles can be links, by agreeing values and by sizes."""
        return (agree >= self.likely * self.bins) & (100 * np.minimum(n, m) >= self.share * np.maximum(n, m))


def signature(shingles: np.ndarray, bins: int) -> np.ndarray:
    """bins values of 16 bits of a sorted, non-empty set of 64-bit hashes."""
    edges = np.searchsorted(shingles, np.array([(k << 64) // bins for k in range(bins)], U64))
    ends = np.append(edges[1:], len(shingles))
    full = ends > edges
    out = np.zeros(bins, U64)
    out[full] = shingles[edges[full]]
    empty, attempt = np.flatnonzero(~full), 0
    while len(empty):
        donor = (mix(empty.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(attempt)) % U64(bins)).astype(np.int64)
        got = full[donor]
        out[empty[got]] = out[donor[got]]
        empty, attempt = empty[~got], attempt + 1
    return (mix(out) & U64(0xFFFF)).astype(np.uint16)


def _sums(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    return int(shingles.sum(dtype=U64)), int(np.bitwise_xor.reduce(mix(shingles + U64(1)))) ^ len(shingles)


def _digests(batches, limit: Limit):
    """Id, set size, hash of the set, signature."""
    for batch in batches:
        ids = batch.column(0)
        data, offsets = text_bytes(batch.column(1))
        for i, j in slices(offsets):
            codes, rows = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            sets = shingle_sets(codes, rows)
            sums = [_sums(x) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(i, j - i).cast(pa.int64()),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array(np.array([s[0] for s in sums], U64).view(np.int64)),
                    pa.array(np.array([s[1] for s in sums], U64).view(np.int64)),
                    pa.array([signature(x, limit.bins).tobytes() if len(x) else b"" for x in sets], pa.binary()),
                ],
                names=["id", "n", "h1", "h2", "sig"],
            )


def _keys(batches, limit: Limit):
    """One row for each class and tree: the prefix at three depths."""
    trees = limit.trees
    for batch in batches:
        ids = np.asarray(batch.column(0))
        if not len(ids):
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, trees, DEPTH).astype(U64)
        code = np.tile(mix(np.arange(1, trees + 1, dtype=U64)), (len(ids), 1))
        at = {}
        for d in range(DEPTH):
            code = mix(code + sig[:, :, d] + U64(1))
            at[d + 1] = code.ravel().view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, trees)), *(pa.array(at[d]) for d in (LEAST_DEPTH, (LEAST_DEPTH + DEPTH) // 2, DEPTH))], names=["id", "k4", "k6", "k8"])


def _regions(keys: DataFrame) -> DataFrame:
    """(id, block): each class's block in each tree, cut so that blocks keep to REGION or so."""
    for k in ("k4", "k6", "k8"):
        n = keys.groupBy(k).agg(F.count("*").alias(f"n_{k}")).where("n_k4 > 1" if k == "k4" else f"n_{k} > 0")
        if k == "k4":
            keys = keys.join(n, k)
            big = keys.where(f"n_k4 > {REGION}")
        else:
            big = big.join(n, k)
    parts = F.ceil(F.col("n_k8") / REGION)
    block = F.when(F.col("n_k6") <= REGION, F.xxhash64("k6")).when(parts == 1, F.xxhash64("k8", F.lit(0))).otherwise(F.xxhash64("k8", F.pmod(F.xxhash64("id", "k4"), parts)))
    return keys.where(f"n_k4 <= {REGION}").select("id", F.col("k4").alias("block")).unionByName(big.select("id", block.alias("block")))


class Groups:
    """Union-find with path halving."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b

    def roots(self) -> np.ndarray:
        return np.array([self.find(x) for x in range(len(self.up))], np.int64)


def _sorted_blocks(batches, columns: tuple[str, ...], most: int):
    """Whole blocks (rows come sorted by block), some thousand rows at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def table(parts):
        t = pa.Table.from_batches(parts)
        return {c: t[c].combine_chunks() for c in columns}

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            block = np.asarray(batch.column(batch.schema.get_field_index("block")))
            cut = int(np.searchsorted(block, block[-1]))
            if cut == 0 and np.asarray(held[0].column(held[0].schema.get_field_index("block")))[0] == block[-1]:
                continue
            if cut:
                yield table([*held[:-1], batch.slice(0, cut)])
                held = [batch.slice(cut)]
            else:  # the last block began in an earlier batch
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                block = np.asarray(whole.column(whole.schema.get_field_index("block")))
                cut = int(np.searchsorted(block, block[-1]))
                yield table([whole.slice(0, cut)])
                held = [whole.slice(cut)]
            rows = sum(x.num_rows for x in held)
    if held:
        yield table(held)


def _likely(batches, limit: Limit):
    """Edges that join classes of a region whose signatures agree well enough."""
    for t in _sorted_blocks(batches, ("block", "id", "n", "sig"), 4_000):
        block, ids, size = (np.asarray(t[c]) for c in ("block", "id", "n"))
        names, local = np.unique(ids, return_inverse=True)
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(-1, limit.bins)
        groups, edges = Groups(len(names)), []

        def joined(a, b, agree):
            fits = limit.alike(agree, size[a], size[b])
            for x, y in zip(local[a[fits]].tolist(), local[b[fits]].tolist(), strict=True):
                if groups.join(x, y):
                    edges.append((x, y))

        start = group_starts(block)
        count = np.diff(np.append(start, len(block)))
        for gap in range(1, 8):  # small regions all at once, by distance in the order
            a = ranges(start[(count > gap) & (count <= 8)], count[(count > gap) & (count <= 8)] - gap)
            for k in range(0, len(a), 50_000):
                x = a[k : k + 50_000]
                joined(x, x + gap, (sig[x] == sig[x + gap]).sum(axis=1))
        for s, c in zip(start[count > 8].tolist(), count[count > 8].tolist(), strict=True):
            order = s + np.lexsort(sig[s : s + c].T[::-1])
            for i in range(c - 1):
                rest = order[i + 1 :]
                own = groups.find(int(local[order[i]]))
                if i % 16 == 0:
                    root = np.array([groups.find(x) for x in local[order].tolist()])
                rest = rest[root[i + 1 :] != own]
                if len(rest):
                    joined(np.full(len(rest), order[i]), rest, (sig[rest] == sig[order[i]]).sum(axis=1))
        e = np.array(edges, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(names[e[:, 0]]), pa.array(names[e[:, 1]])], names=["a", "b"])


def _full_sets(batches):
    """Shingle sets of the classes that came through the forest; rows of the same id and another class go."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(4))
        hashes = [np.asarray(batch.column(k)).view(U64).tolist() for k in (2, 3)]
        for i, j in slices(offsets):
            codes, rows = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            sets = shingle_sets(codes, rows)
            own = [k for k, x in enumerate(sets) if _sums(x) == (hashes[0][i + k], hashes[1][i + k])]
            at = pa.array([i + k for k in own], pa.int64())
            packed = [pack(np.diff(sets[k], prepend=U64(0))) for k in own]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(packed, pa.binary())], names=["id", "root", "set"])


def _class_sets(texts: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, root, set) of the classes of wanted (id, root), from texts by the classes' least documents."""
    rows = classes.join(wanted, "id").withColumnRenamed("rep", "doc").join(texts.withColumnRenamed("id", "doc"), "doc")
    sets = rows.select("id", "root", "h1", "h2", "text").mapInArrow(_full_sets, "id long, root long, set binary")
    return sets.dropDuplicates(["id"])


def _same_ids(digests: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between the classes that hold the same id."""
    rows = digests.where("n > 0 and id is not null").select("id", F.struct("h1", "h2").alias("h"))
    twice = rows.groupBy("id").agg(F.min("h").alias("least"), F.max("h").alias("most")).where("least != most")
    pairs = rows.join(twice, "id").where("h != least").select(F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"), F.col("least.h1").alias("g1"), F.col("least.h2").alias("g2")).distinct()
    pairs = pairs.join(classes.select("h1", "h2", F.col("id").alias("a")), ["h1", "h2"])
    return pairs.join(classes.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("id").alias("b")), ["g1", "g2"]).select("a", "b")


def linked(sets: list[np.ndarray], share: int) -> np.ndarray:
    """Of each set, the first set that it is joined with by links (exact, on full sets)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    groups, own = Groups(len(sets)), np.repeat(np.arange(len(sets)), sizes)
    values, number = np.unique(np.concatenate(sets), return_inverse=True)
    by = np.argsort(number, kind="stable")
    holders, first = own[by], np.searchsorted(number[by], np.arange(len(values) + 1))
    starts = np.cumsum(sizes) - sizes
    shared = np.diff(first) > 1
    for i in np.argsort(-np.add.reduceat(shared[number].astype(np.int64), starts), kind="stable").tolist():
        root = groups.find(i)
        mine = number[starts[i] : starts[i] + sizes[i]]
        mine = mine[shared[mine]]
        both = np.bincount(holders[ranges(first[mine], first[mine + 1] - first[mine])], minlength=len(sets))
        near = np.flatnonzero(100 * both >= share * (sizes[i] + sizes - both))
        for j in near.tolist():
            if groups.find(j) != root:
                groups.join(i, j)
                root = groups.find(i)
        if all(groups.find(j) == root for j in range(len(sets))):
            break
    return groups.roots()


def _confirm(batches, limit: Limit):
    """Links within blocks, as edges to the least id of each joined group."""
    for t in _sorted_blocks(batches, ("block", "id", "set"), 2_000):
        block, ids, blobs = np.asarray(t["block"]), np.asarray(t["id"]), t["set"].to_pylist()
        out = []
        for a, b in group_bounds(block):
            if b - a < 2:
                continue
            _, only = np.unique(ids[a:b], return_index=True)
            sets = [np.cumsum(unpack(blobs[a + k], U64)[0], dtype=U64) for k in only.tolist()]
            root = linked(sets, limit.share)
            own = ids[a:b][only]
            out.append(np.stack((own, own[root]))[:, root != np.arange(len(root))])
        e = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(e[0]), pa.array(e[1])], names=["a", "b"])


def _strangers(batches, limit: Limit):
    """Links between a block's queries and its rows of other components, one for each two components."""
    for t in _sorted_blocks(batches, ("block", "id", "root", "asks", "sig", "set"), 2_000):
        block, ids, roots, asks = (np.asarray(t[c].to_numpy(zero_copy_only=False)) for c in ("block", "id", "root", "asks"))
        sigs, blobs, edges = t["sig"], t["set"], []
        for a, b in group_bounds(block):
            ask, held = a + np.flatnonzero(asks[a:b]), a + np.flatnonzero(~asks[a:b])
            sets = {k: np.cumsum(unpack(blobs[k].as_py(), U64)[0], dtype=U64) for k in (*ask.tolist(), *held.tolist())}
            size = np.array([len(sets[k]) for k in held.tolist()], np.int64)
            sig = np.frombuffer(b"".join(sigs[k].as_py() for k in held.tolist()), np.uint16).reshape(-1, limit.bins)
            names, local = np.unique(roots[a:b], return_inverse=True)
            groups = Groups(len(names))
            for q in ask.tolist():
                agree = (sig == np.frombuffer(sigs[q].as_py(), np.uint16)).sum(axis=1)
                n = len(sets[q])
                fits = limit.alike(agree, size, n)
                for r in held[fits].tolist():
                    x, y = int(local[q - a]), int(local[r - a])
                    if groups.find(x) == groups.find(y):
                        continue
                    both = len(np.intersect1d(sets[q], sets[r], assume_unique=True))
                    if 100 * both >= limit.share * (n + len(sets[r]) - both):
                        groups.join(x, y)
                        edges.append((ids[q], ids[r]))
        e = np.array(edges, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])


def _rest(texts: DataFrame, classes: DataFrame, reps: DataFrame, keys: DataFrame, joined: DataFrame, limit: Limit) -> DataFrame | None:
    """Links of regions over REGION classes that the cut blocks cannot have seen; None where there are none to seek."""
    held = keys.groupBy("k4").agg(F.count("*").alias("n_k4")).where(f"n_k4 > {REGION}")
    held = keys.select("id", "k4").join(held.select("k4"), "k4").join(joined.withColumnRenamed("node", "id"), "id", "left").join(reps.select("id", "n"), "id")
    held = durable(held.select("id", "k4", F.coalesce("root", "id").alias("root"), "n"))
    sums = held.groupBy("k4", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    most = F.max_by("root", F.struct("c", "root"))
    sums = sums.groupBy("k4").agg(most.alias("main"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.max("c").alias("c_main"), F.max_by("s", F.struct("c", "root")).alias("s_main")).where("c > c_main")
    parts = lambda c, s: F.greatest(F.ceil(c / PART), F.ceil(s / PART_SHINGLES))
    sums = sums.select("k4", "main", parts(F.col("c"), F.col("s")).alias("rows"), parts(F.col("c") - F.col("c_main"), F.col("s") - F.col("s_main")).alias("queries"))
    held = durable(held.join(sums, "k4"))
    if held.isEmpty():
        return None
    sets = _class_sets(texts, classes, held.select("id", "root").distinct())
    sets = durable(sets.join(reps.select("id", "sig"), "id"))
    spread = lambda own, other: (F.pmod(F.xxhash64("id", "k4"), own), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
    own, other = spread("queries", "rows")
    asked = held.where("root != main").select("id", "k4", own.alias("q"), other.alias("r"), F.lit(True).alias("asks"))
    own, other = spread("rows", "queries")
    rows = held.select("id", "k4", other.alias("q"), own.alias("r"), F.lit(False).alias("asks"))
    blocks = asked.unionByName(rows).select("id", "asks", F.xxhash64("k4", "q", "r").alias("block")).join(sets, "id")
    blocks = blocks.select("block", "id", "root", "asks", "sig", "set")
    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(partial(_strangers, limit=limit), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of docs; share: the threshold in hundredths."""
    spark, limit = docs.sparkSession, Limit.of(share)
    prepared(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    digests = durable(texts.mapInArrow(partial(_digests, limit=limit), "id long, n long, h1 long, h2 long, sig binary"))
    classes = digests.where("n > 0 and id is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    # a class is numbered by its least document; further classes of that document have numbers above all ids, and are joined with the first
    again = F.row_number().over(Window.partitionBy("rep").orderBy("h1", "h2")) > 1
    classes = durable(classes.withColumn("id", F.when(again, F.lit((1 << 63) - 1) - F.monotonically_increasing_id()).otherwise(F.col("rep"))))
    own = classes.select("h1", "h2", "rep", F.col("id").alias("class"))
    reps = digests.join(own, ["h1", "h2"]).where("id = rep").select(F.col("class").alias("id"), "n", "sig").dropDuplicates(["id"])
    reps = durable(reps)
    keys = durable(reps.select("id", "sig").mapInArrow(partial(_keys, limit=limit), "id long, k4 long, k6 long, k8 long"))
    regions = durable(_regions(keys))
    sorted_by_block = lambda f: f.repartition("block").sortWithinPartitions("block")
    likely = sorted_by_block(regions.join(reps, "id")).mapInArrow(partial(_likely, limit=limit), "a long, b long")
    groups = connected_components(likely)
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root")).distinct()
    release(spark)
    volume = groups.join(reps.select(F.col("id").alias("node"), "n"), "node").groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    groups = durable(groups.join(volume, "root").withColumn("big", F.expr(f"size > {GROUP} or shingles > {GROUP_SHINGLES}")).select(F.col("node").alias("id"), "root", "big"))
    sets = durable(_class_sets(texts, classes, groups.select("id", "root")).withColumnRenamed("root", "block"))
    whole = sets.join(groups.where("not big").select("id"), "id", "left_semi")
    cut = regions.join(groups.where("big").select("id"), "id", "left_semi").distinct()
    blocks = whole.select("block", "id", "set").unionByName(cut.join(sets.select("id", "set"), "id").select("block", "id", "set"))
    confirmed = sorted_by_block(blocks).mapInArrow(partial(_confirm, limit=limit), "a long, b long")
    joined = connected_components(confirmed.unionByName(_same_ids(digests, classes)))
    release(spark)
    links = _rest(texts, classes, reps, keys, joined, limit)
    if links is not None:
        joined = connected_components(links.unionByName(joined.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        release(spark)
    component = classes.join(joined.withColumnRenamed("node", "id"), "id", "left").select("h1", "h2", F.coalesce("root", "id").alias("component"))
    out = digests.select("id", "n", "h1", "h2").join(component, ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(component)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    from .frames import documents

    return near_duplicates(documents(spark, sf_dir), share=SHARE)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)
), r AS (
  SELECT doc_id AS x, doc_id AS z FROM documents
  UNION
  SELECT l.x, r.z FROM l JOIN r ON l.y = r.x WHERE r.z < l.x
), c AS (
  SELECT x, min(z) AS component_id FROM r GROUP BY x
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.x = d.doc_id
"""
