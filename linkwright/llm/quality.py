"""Quality classifier: hashed word n-gram logistic regression trained with FTRL-proximal updates.

``score_quality(docs, labels)`` learns from a bounded sample of the labelled documents and scores
every document as a sparse dot product. A text is cut into runs of letters, digits and other signs.
Its features are hashed 1- and 2-grams of the lower-cased runs and hashed 1- to 3-grams of their
shapes (kind, case, length class), each family scaled to length one. Scores see the text alone.

Training rows are those whose crc32(id as text) mod 3 is not 1 (the rest is held out): at most
``rows`` of them in the order of a hash of the id, only texts of up to ``row_bytes`` bytes each, and
of these the first with up to ``all_bytes`` bytes together. These three parameters bound the one task
that learns; nothing else is bounded, and every document is scored. The weights (``1 << BITS``
floats) are the only thing that the driver gets. A row's score does not depend on the rows around it.

Cases: NULL and empty texts have no features and score the bias alone; a NULL id is not held out
and never trained on; labels other than 0 and 1 are passed over; a document with several labels is
learnt with each; with no labels every score is 0.5 (predicted 1); input columns named as an output
column are replaced (``names`` gives the output other names).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import U64, lower_ascii, mix, ngrams, prefix_codes, slices, span_hashes, text_bytes
from .frames import prepared, release

BITS = 18
#: Default bounds of the training sample: rows, bytes of one text, bytes of all texts.
TRAIN_ROWS, ROW_BYTES, ALL_BYTES = 6_000, 1 << 17, 64 << 20
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-5

_KIND = np.full(256, 3, np.uint8)  # 0 white space, 1 letters, 2 digits, 3 other signs
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[65:91] = _KIND[97:123] = _KIND[128:256] = 1
_KIND[48:58] = 2


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: where each row's features begin, feature numbers, values."""
    n = len(offsets) - 1
    kind = _KIND[data]
    cut = np.empty(len(data), bool)
    if len(data):
        cut[0] = True
        cut[1:] = kind[1:] != kind[:-1]
        cut[offsets[(offsets < len(data))]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(data))
    seen = kind[start] != 0
    start, end = start[seen], end[seen]
    rows = np.searchsorted(start, offsets)
    code = span_hashes(prefix_codes(lower_ascii(data)), start, end)
    upper = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90))))
    capitals, length = upper[end] - upper[start], end - start
    case = np.where(capitals == 0, 0, np.where(2 * capitals > length, 2, 1))
    signs = kind[start] == 3
    shape = kind[start].astype(np.int64) * 1000 + case * 100 + np.minimum(length, 3) * 10 + (length > 8)
    shape = mix(np.where(signs, code, shape.astype(U64)) + U64(77))
    row = np.repeat(np.arange(n), np.diff(rows))
    every, owner, family = [], [], []
    for k, (base, size) in enumerate(((code, 1), (code, 2), (shape, 1), (shape, 2), (shape, 3))):
        grams = ngrams(base, size) + U64(k + 1)
        same = row[: len(grams)] == row[size - 1 :][: len(grams)] if len(grams) else np.zeros(0, bool)
        every.append(mix(grams[same]) >> U64(64 - BITS))
        owner.append(row[: len(grams)][same])
        family.append(np.full(int(same.sum()), k // 2))
    key = (np.concatenate(owner) << (BITS + 2)) | (np.concatenate(family) << BITS) | np.concatenate(every).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    block = key >> BITS
    norm = np.sqrt(np.bincount(block, count.astype(float) ** 2, minlength=1))
    value = count / norm[block]
    return np.searchsorted(key >> (BITS + 2), np.arange(n + 1)), key & ((1 << BITS) - 1), value


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal weights, the bias last, of (features, values, label) rows in a fixed order."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        s = np.where(np.abs(z[at]) > L1, np.sign(z[at]) * L1 - z[at], 0.0)
        return s / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at, x, y = rows[k]
            at, x = np.append(at, size - 1), np.append(x, 1.0)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            if len(np.unique(at)) != len(at):
                at, to = np.unique(at, return_inverse=True)
                g, w = np.bincount(to, g), weights(at)
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    return weights(np.arange(size)).astype(np.float32)


def _train_task(all_bytes: int):
    def run(batches):
        rows, left = [], all_bytes
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            labels = batch.column(1).to_pylist()
            fits = int(np.searchsorted(offsets, left, side="right")) - 1
            left = left - int(offsets[fits]) if fits == batch.num_rows else -1
            for i, j in slices(offsets[: fits + 1]):
                first, at, x = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                rows += [(at[a:b], x[a:b], y) for a, b, y in zip(first[:-1], first[1:], labels[i:j], strict=True)]
        yield pa.RecordBatch.from_pydict({"weights": pa.array([train(rows).tobytes()] if rows else [], pa.binary())})

    return run


def _score_task(raw: bytes, text_col: str, schema: pa.Schema, names: tuple[str, str, str]):
    def run(batches):
        w = np.frombuffer(raw, np.float32)
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            score = np.full(batch.num_rows, float(w[-1]) if len(w) else 0.0)
            for i, j in slices(offsets, 512 << 10) if len(w) else ():
                first, at, x = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                score[i:j] += np.bincount(np.repeat(np.arange(j - i), np.diff(first)), w[at].astype(float) * x, minlength=j - i)
            score = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            new = {names[1]: pa.array(score), names[2]: pa.array((score >= 0.5).astype(np.int32))}
            yield pa.RecordBatch.from_arrays([new[k] if k in new else batch.column(batch.schema.get_field_index(k)) for k in schema.names], schema=schema)

    return run


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS, row_bytes: int = ROW_BYTES, all_bytes: int = ALL_BYTES) -> bytes:
    """Weights learnt from the sample that rows, row_bytes and all_bytes bound; empty where nothing is labelled."""
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").where(~held_out("_id"))
    known = known.distinct().orderBy(F.xxhash64("_id"), "_id", "_y").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).where(F.octet_length("_text") <= row_bytes)
    # the sample has a fixed size, so it is broadcast and the documents are not shuffled
    # and an id that stands on several rows is learnt by one of its texts
    drawn = texts.join(F.broadcast(known), "_id").groupBy("_id", "_y").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    drawn = drawn.repartition(1).sortWithinPartitions(F.xxhash64("_id"), "_id", "_y")
    found = drawn.select("_text", "_y").mapInArrow(_train_task(all_bytes), "weights binary").collect()
    return bytes(found[0][0]) if found else b""


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", names: tuple[str, str, str] = ("held_out", "score", "predicted")) -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (0 or 1); names: what these columns are called."""
    from pyspark.sql.pandas.types import to_arrow_schema

    prepared(docs.sparkSession)
    docs = docs.select(*[c for c in docs.columns if c not in names or c in (id_col, text_col)])
    raw = fit_quality(docs, labels, id_col, text_col, label_col)
    release(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.IntegerType())])
    scored = docs.mapInArrow(_score_task(raw, text_col, to_arrow_schema(schema), names), schema)
    return scored.withColumn(names[0], held_out(id_col))


def query(spark, sf_dir: str) -> DataFrame:
    from .frames import documents

    return score_quality(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")
