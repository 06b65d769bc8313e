"""LM scoring: stupid-backoff scores of every document under the n-gram counts of the other ones.

Tables and joins, in packed columns (a row holds the n-grams that one shard of texts has of one hash
bucket: their hashes, and counts aligned with them):

* exploded n-grams: each shard's distinct n-grams with its own count of each, by hash bucket
  (counted before anything is sent, so a frequent n-gram is one entry a shard);
* count table: for each bucket, its n-grams with the sums of their counts over all shards;
* join: each entry of the exploded n-grams meets its row of the count table, and goes back to its
  shard, where the scores of its documents are summed.

Orders 1 and 2 go first; a longer n-gram is only sent where both of its shorter parts occur in
another document, as it cannot otherwise. ``ngram_counts`` gives the count table alone, one row for
each n-gram. The document's own occurrences are taken off, so that no text vouches for itself:

    S(w | context) = c(context w) / c(context) where c(context w) > 0, else ALPHA * S(w | shorter context)
    S(w) = c(w) / T, or ALPHA / (T + 1) for a word that no other document has

with c and T (the number of words) counted in the other documents. Hashes have 64 bits.

Output: id, n_words, log_score (natural, sum over the words, rounded to 4 places) and mean_log
(per word, 6 places). Cases: NULL or empty texts have no words, log_score 0 and mean_log NULL; a
NULL id is carried; repeated ids and rows are separate documents; an empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U64, group_starts, ngrams, pack, slices, text_bytes, unpack, words
from .frames import durable, prepared, release, text_volume
from .suffix_dedup import _pack_shards, open_shard

ORDER = 3
ALPHA = 0.4
SHARD_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
_COUNTS = "bucket long, shard long, total long, blob binary"
_SCHEMA = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("total", pa.int64()), ("blob", pa.binary())])


class Grams:
    """A shard's words and, by order, its distinct n-grams with counts in and outside each document."""

    def __init__(self, blob: bytes, text_col: str = "text"):
        self.table = open_shard(blob)
        data, offsets = text_bytes(self.table[text_col])
        parts = [words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets, 256 << 10)]
        self.codes = np.concatenate([c for c, _ in parts]) if parts else np.zeros(0, U64)
        self.n_words = np.concatenate([np.diff(r) for _, r in parts]) if parts else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(len(self.n_words)), self.n_words)
        self.others: dict[int, np.ndarray] = {}

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the n-grams that need a count."""
        m = len(self.codes) - order + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        inside = self.doc[:m] == self.doc[order - 1 :]
        if order > 2:
            shorter = self.others[order - 1] > 0
            inside &= shorter[:m] & shorter[1 : m + 1]
        at = np.flatnonzero(inside)
        return at, ngrams(self.codes, order)[at]

    def pieces(self, order: int, buckets: int):
        """bucket, first and last of the distinct n-grams, these, their counts, and each place's n-gram."""
        at, code = self.grams(order)
        names, which, count = np.unique(code, return_inverse=True, return_counts=True)
        bucket = ((names >> U64(40)) * U64(buckets)) >> U64(24)
        head = group_starts(bucket)
        cuts = list(zip((bucket[head].astype(np.int64) + order * buckets).tolist(), head.tolist(), np.append(head, len(names))[1:].tolist(), strict=True)) if len(head) else []
        return at, names, which, count, cuts

    def learn(self, order: int, buckets: int, replies: dict[int, bytes]) -> None:
        """Counts of the order's n-grams in the other documents, by place; 0 where there is none."""
        at, names, which, _, cuts = self.pieces(order, buckets)
        every = np.zeros(len(names), np.int64)
        for bucket, a, b in cuts:
            every[a:b] = unpack(replies[bucket], np.int64)[0]
        _, mine, own = np.unique(which * len(self.n_words) + self.doc[at], return_inverse=True, return_counts=True)
        out = np.zeros(len(self.codes), np.int64)
        out[at] = every[which] - own[mine]
        self.others[order] = out

    def scores(self, order: int, total: int) -> np.ndarray:
        n = len(self.codes)
        place = np.arange(n) - np.repeat(np.cumsum(self.n_words) - self.n_words, self.n_words)
        highest = np.minimum(place + 1, order)
        rest = total - self.n_words[self.doc]
        score, open_ = np.zeros(n), np.ones(n, bool)
        for k in range(order, 1, -1):
            num, den = np.zeros(n, np.int64), np.ones(n, np.int64)
            num[k - 1 :], den[k - 1 :] = self.others[k][: n - k + 1], self.others[k - 1][: n - k + 1]
            hit = open_ & (highest >= k) & (num > 0)
            score[hit] = np.log(num[hit] / den[hit]) + (highest[hit] - k) * math.log(ALPHA)
            open_ &= ~hit
        num = self.others[1]
        seen, new = open_ & (num > 0), open_ & (num <= 0)
        score[seen] = np.log(num[seen] / rest[seen]) + (highest[seen] - 1) * math.log(ALPHA)
        score[new] = highest[new] * math.log(ALPHA) - np.log(rest[new] + 1.0)
        sums = np.zeros(len(self.n_words))
        np.add.at(sums, self.doc, score)
        return sums


def _requests(shard: int, grams: Grams, orders, buckets: int) -> pa.Table:
    out = {k: [] for k in _SCHEMA.names}
    for order in orders:
        _, names, _, count, cuts = grams.pieces(order, buckets)
        for bucket, a, b in cuts:
            out["bucket"].append(bucket)
            out["shard"].append(shard)
            out["total"].append(int(count[a:b].sum()))
            out["blob"].append(pack(np.diff(names[a:b], prepend=U64(0)), count[a:b].astype(np.int64)))
    return pa.table(out, schema=_SCHEMA)


def _first(orders, buckets: int):
    def run(batches):
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from _requests(shard, Grams(blob), orders, buckets).to_batches()

    return run


def _informed(blob: bytes, known, buckets: int, replies: pa.Table) -> Grams:
    grams = Grams(blob)
    got = dict(zip(replies["bucket"].to_pylist(), replies["blob"].to_pylist(), strict=True))
    for order in known:
        grams.learn(order, buckets, got)
    return grams


def _next(order: int, buckets: int):
    def run(shard: pa.Table, replies: pa.Table) -> pa.Table:
        if not shard.num_rows:
            return _SCHEMA.empty_table()
        grams = _informed(shard["blob"][0].as_py(), range(1, order), buckets, replies)
        return _requests(shard["shard"][0].as_py(), grams, (order,), buckets)

    return run


def _exploded(table: pa.Table) -> list[list[np.ndarray]]:
    """A bucket's entries by shard: hashes and own counts."""
    pieces = [unpack(x, U64, np.int64) for x in table["blob"].to_pylist()]
    return [[np.cumsum(names, dtype=U64), count] for names, count in pieces]


def count_table(pieces: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-gram hashes of a bucket with the sums of their counts (64 bits)."""
    names = np.concatenate([names for names, _ in pieces])
    order = np.argsort(names)
    names = names[order]
    head = group_starts(names)
    return names[head], np.add.reduceat(np.concatenate([count for _, count in pieces])[order], head)


def _count(table: pa.Table) -> pa.Table:
    """Joins the entries of a bucket with its count table: a count for each entry, in its shard's order."""
    pieces = _exploded(table)
    names, sums = count_table(pieces)
    joined = [pack(sums[np.searchsorted(names, own)]) for own, _ in pieces]
    return table.set_column(3, "blob", pa.array(joined, pa.binary()))


def _counts_alone(table: pa.Table) -> pa.Table:
    names, sums = count_table(_exploded(table))
    return pa.table({"gram": names.view(np.int64), "n": sums})


def _score(order: int, buckets: int, total: int, schema: pa.Schema):
    def run(shard: pa.Table, replies: pa.Table) -> pa.Table:
        if not shard.num_rows:
            return schema.empty_table()
        grams = _informed(shard["blob"][0].as_py(), range(1, order + 1), buckets, replies)
        return pa.table([grams.table["id"], pa.array(grams.n_words, pa.int64()), pa.array(grams.scores(order, total))], schema=schema)

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, shard_bytes: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, n_words, log_score, mean_log) of every row of docs."""
    spark = docs.sparkSession
    prepared(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    buckets = max(4, -(-text_volume(rows) // bucket_bytes))
    shards = durable(rows.mapInArrow(_pack_shards("id", "text", shard_bytes), "shard long, blob binary"))
    counted = lambda f: durable(f.groupBy("bucket").applyInArrow(_count, _COUNTS))
    replies = counted(shards.mapInArrow(_first(range(1, min(2, order) + 1), buckets), _COUNTS))
    total = int(replies.where(F.col("bucket") < 2 * buckets).agg(F.sum("total")).first()[0] or 0)
    for k in range(3, order + 1):
        release(spark, 1.0)
        # no name is kept for the n-grams sent, so that their shuffle files can go before the scores
        replies = replies.unionByName(counted(shards.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(_next(k, buckets), _COUNTS)))
    release(spark, 1.0)
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64())])
    scored = shards.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(_score(order, buckets, total, schema), "id long, n_words long, log_score double")
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6))
    return scored.select(F.col("id").alias(id_col), "n_words", F.round("log_score", 4).alias("log_score"), mean.alias("mean_log"))


def ngram_counts(docs: DataFrame, order: int, text_col: str = "text", shard_bytes: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(gram, n): 64-bit hashes of all n-grams of one order (1 or 2; longer ones with shorter parts in two documents only come with scores), partitioned by hash."""
    if order not in (1, 2):
        raise ValueError("order is 1 or 2")
    prepared(docs.sparkSession)
    rows = docs.select(F.lit(0).cast("long").alias("id"), F.col(text_col).alias("text"))
    buckets = max(4, -(-text_volume(rows) // bucket_bytes))
    shards = durable(rows.mapInArrow(_pack_shards("id", "text", shard_bytes), "shard long, blob binary"))
    return shards.mapInArrow(_first((order,), buckets), _COUNTS).groupBy("bucket").applyInArrow(_counts_alone, "gram long, n long")


def query(spark, sf_dir: str) -> DataFrame:
    from .frames import documents

    return lm_scores(documents(spark, sf_dir))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), t AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d
), g AS (
  SELECT doc_id, i, w, lag(w, 1) OVER o AS p, lag(w, 2) OVER o AS q FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), k AS (
  SELECT *, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY w, doc_id) AS c1,
    CASE WHEN p IS NOT NULL THEN count(*) OVER (PARTITION BY p, w) - count(*) OVER (PARTITION BY p, w, doc_id) ELSE 0 END AS c2,
    CASE WHEN q IS NOT NULL THEN count(*) OVER (PARTITION BY q, p, w) - count(*) OVER (PARTITION BY q, p, w, doc_id) ELSE 0 END AS c3,
    count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS rest
  FROM g
), s AS (
  SELECT doc_id, i, least(i, 3) AS hi, c1, c2, c3, rest, lag(c1, 1) OVER o AS d2, lag(c2, 1) OVER o AS d3
  FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), v AS (
  SELECT doc_id, CASE WHEN c3 > 0 THEN ln(c3 / d3) WHEN c2 > 0 THEN ln(c2 / d2) + (hi - 2) * ln(0.4)
    WHEN c1 > 0 THEN ln(c1 / rest) + (hi - 1) * ln(0.4) ELSE hi * ln(0.4) - ln(rest + 1.0) END AS x FROM s
), r AS (
  SELECT doc_id, count(*) AS n_words, sum(x) AS x FROM v GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(x, 0.0), 4) AS log_score, CASE WHEN n_words > 0 THEN round(x / n_words, 6) END AS mean_log
FROM d LEFT JOIN r USING (doc_id)
"""
