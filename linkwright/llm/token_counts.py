"""Token counts: the exact histogram of encoded lengths, and what suffix sums of it answer.

``length_histogram(docs)`` encodes every whole text with a public byte-level BPE vocabulary (rank
file and pattern are parameters) and counts the documents of each length. ``context_report`` adds,
for a context limit at each length, exact totals: documents and tokens from there on, and the
tokens left when every document is cut at the limit. Any quantile is the least length whose share
of documents reaches it (``quantiles``); ``truncated_totals`` answers limits that no document has.

Suffix sums are taken in two levels (blocks of ``SPAN`` lengths, then within a block), so that no
task holds the whole histogram.

Cases: NULL and empty texts have length 0; an empty table gives an empty report; the text of
special tokens is ordinary text.
"""

from __future__ import annotations

import base64
from collections import Counter
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import prepared

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that goes with the rank files of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A vocabulary file is read by the driver and sent to the executors; larger ones are refused.
MOST_VOCABULARY_BYTES = 64 << 20
SPAN = 1_024


def encoding(raw: bytes, pattern: str = PATTERN):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
    return tiktoken.Encoding("linkwright", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


_made: dict[int, object] = {}


def _lengths(shared, pattern: str):
    def run(batches):
        raw = shared.value
        key = hash((raw, pattern))
        if key not in _made:  # a worker builds the encoder once
            _made[key] = encoding(raw, pattern)
        encode, counts = _made[key].encode_ordinary, Counter()
        for batch in batches:
            counts.update(len(encode(t)) if t else 0 for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(list(counts), pa.int64()), "docs": pa.array(list(counts.values()), pa.int64())})

    return run


def length_histogram(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens, docs): how many documents have each encoded length."""
    prepared(docs.sparkSession)
    path = Path(vocabulary)
    if path.stat().st_size > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} is larger than {MOST_VOCABULARY_BYTES} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(path.read_bytes())
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_lengths(shared, pattern), "n_tokens long, docs long")
    return counted.groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def context_report(histogram: DataFrame) -> DataFrame:
    """Each length with sums from there on: docs_ge, tokens, tokens_ge, docs_share, truncated_total."""
    rows = histogram.withColumn("tokens", F.col("n_tokens") * F.col("docs")).withColumn("span", F.floor(F.col("n_tokens") / SPAN))
    spans = rows.groupBy("span").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    wide = spans.withColumn("wide", F.floor(F.col("span") / SPAN))
    later = Window.partitionBy("wide").orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    outer = wide.groupBy("wide").agg(F.sum("d").alias("wd"), F.sum("t").alias("wt"))
    above = Window.orderBy(F.desc("wide")).rowsBetween(Window.unboundedPreceding, -1)  # one row for 2**20 lengths
    outer = outer.select("wide", F.coalesce(F.sum("wd").over(above), F.lit(0)).alias("wd"), F.coalesce(F.sum("wt").over(above), F.lit(0)).alias("wt"))
    spans = wide.select("wide", "span", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t")).join(outer, "wide").select("span", (F.col("d") + F.col("wd")).alias("d"), (F.col("t") + F.col("wt")).alias("t"))
    within = Window.partitionBy("span").orderBy(F.desc("n_tokens"))
    rows = rows.join(spans, "span").withColumn("docs_ge", F.sum("docs").over(within) + F.col("d")).withColumn("tokens_ge", F.sum("tokens").over(within) + F.col("t"))
    total = histogram.agg(F.sum("docs").alias("total_docs"), F.sum(F.col("docs") * F.col("n_tokens")).alias("total_tokens"))
    rows = rows.join(F.broadcast(total))  # one row
    docs_le = F.col("total_docs") - F.col("docs_ge") + F.col("docs")
    cut = F.col("total_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")
    return rows.select("n_tokens", "docs", "tokens", "docs_ge", "tokens_ge", (docs_le / F.col("total_docs")).alias("docs_share"), cut.alias("truncated_total"))


def quantiles(report: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length at or under which that share of the documents lies."""
    found = [report.where(F.col("docs_share") >= s).agg(F.lit(s).alias("share"), F.min("n_tokens").alias("n_tokens")) for s in shares]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, truncated_total) for any context limits."""
    each = F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("limit")
    return histogram.select("n_tokens", "docs", each).groupBy("limit").agg(F.sum(F.col("docs") * F.least("n_tokens", "limit")).alias("truncated_total"))


def query(spark, sf_dir: str) -> DataFrame:
    from .frames import documents, durable

    return context_report(durable(length_histogram(documents(spark, sf_dir))))
