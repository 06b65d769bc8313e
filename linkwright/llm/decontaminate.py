"""Benchmark decontamination: a BM25 index of the test items, searched by every passage of every text.

``find_leaks(docs, items)`` gives (document, item) pairs where the document holds the item:

1. Each item has BM25 weights for its terms, with document frequencies and the mean length taken over
   all items, and a threshold: its whole weight less the heaviest terms that a passage with
   ``OVERLAP`` of the item's five-word shingles may lack. Weights are divided by it, so every
   threshold is 1. Items of one length class make one inverted index: postings by term, and the
   greatest weight of each term in each block of ``BLOCK`` items that has it.
2. Texts are cut into overlapping passages of twice the items' length class, so that any occurrence
   lies within one. Block-max WAND: terms whose greatest weights together stay under 1/2 are not
   essential; a passage goes on only if the maxima of its terms can reach 1, first over all items,
   then for each block that an essential term has. What is left is scored over the postings, and
   every item of at least 1 is retrieved.
3. Retrieved pairs are verified: ``OVERLAP`` of the item's shingles stand in the passage, and half
   of those of its question (first half of its words) and of its answer (the rest).

Items are broadcast up to ``chunk_bytes`` of text at a time; a pass over the documents searches one
such chunk, and only a larger benchmark needs more passes. Scores do not depend on the chunks.

Cases: NULL or empty texts match nothing, items without words are never found; an item, question or
answer under five words counts as one shingle of its length, an answer of no words as found; a NULL id is carried; repeated rows of documents give repeated pairs,
repeated items are searched once; of several passages the best overlap is reported, the first on
ties; no items, no pairs; other columns are not carried, drop_leaks() keeps all.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U64, group_starts, ngrams, ranges, slices, text_bytes, words
from .frames import durable, prepared

OVERLAP = 0.8
PART_OVERLAP = 0.5
SHINGLE = 5
BLOCK = 8
CHUNK_BYTES = 32 << 20
K1, B = 1.2, 0.75


def shingles(codes: np.ndarray) -> np.ndarray:
    return np.unique(ngrams(codes, min(SHINGLE, len(codes)))) if len(codes) else np.zeros(0, U64)


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their weights."""
    names, which = np.unique(keys, return_inverse=True)
    return names, np.bincount(which, weights, minlength=len(names))


class Index:
    """An inverted index of the items of one length class; weights are divided by the items' thresholds."""

    def __init__(self, items: list[tuple[int, np.ndarray, dict[int, int]]], total: int, mean: float):
        self.ids = [number for number, _, _ in items]
        coded = [codes for _, codes, _ in items]
        self.length = 1 << max(3, int(max(map(len, coded))).bit_length())
        self.vocabulary = np.unique(np.concatenate(coded))
        terms, owners, weights = [], [], []
        for k, (_, codes, frequency) in enumerate(items):
            term, tf = np.unique(codes, return_counts=True)
            df = np.array([frequency[int(t)] for t in term])
            idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
            weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(codes) / mean))
            lack = int((1 - OVERLAP) * max(0, len(codes) - SHINGLE + 1) + 1e-9)
            limit = weight.sum() - np.sort(weight)[::-1][:lack].sum()
            terms.append(np.searchsorted(self.vocabulary, term))
            owners.append(np.full(len(term), k))
            weights.append(weight / max(limit, 1e-12))
        term, self.item, self.weight = (np.concatenate(x) for x in (terms, owners, weights))
        by = np.lexsort((self.item, term))
        term, self.item, self.weight = term[by], self.item[by], self.weight[by]
        size = len(self.vocabulary)
        self.postings = np.searchsorted(term, np.arange(size + 1))
        self.n_blocks = -(-len(items) // BLOCK)
        head = group_starts(term * self.n_blocks + self.item // BLOCK)
        self.block, self.block_max = self.item[head] // BLOCK, np.maximum.reduceat(self.weight, head)
        self.block_postings = np.searchsorted(term[head], np.arange(size + 1))
        self.most = np.maximum.reduceat(self.weight, self.postings[:-1])
        lightest = np.argsort(self.most, kind="stable")
        lightest = lightest[: int(np.searchsorted(np.cumsum(self.most[lightest]), 0.5))]
        self.essential = np.ones(size, bool)
        self.essential[lightest] = False
        self.slack = float(self.most[lightest].sum())
        light = ~self.essential[term[head]]
        self.block_slack = np.bincount(self.block[light], self.block_max[light], minlength=self.n_blocks)
        # of each item, its first half (the question) and the rest (the answer): the length of its shingles, and these
        half = [-(-len(c) // 2) for c in coded]
        self.sets = [[(min(SHINGLE, len(x)), shingles(x)) for x in (c, c[:h], c[h:])] for c, h in zip(coded, half, strict=True)]
        self.mask = U64((1 << max(20, (8 * size).bit_length())) - 1)
        self.seen = np.zeros(int(self.mask) + 1, bool)
        self.seen[(self.vocabulary & self.mask).astype(np.int64)] = True

    def retrieve(self, codes: np.ndarray, rows: np.ndarray, stretch: np.ndarray):
        """(passage, item, score) of every item whose threshold a passage reaches.

        A passage is numbered by its first stretch of ``length`` words and has that one and the next of
        its text; stretch: the number of each text's first one.
        """
        at = np.flatnonzero(self.seen[(codes & self.mask).astype(np.int64)])
        term = np.searchsorted(self.vocabulary, codes[at])
        term[term == len(self.vocabulary)] = 0
        same = self.vocabulary[term] == codes[at]
        at, term = at[same], term[same]
        row = np.searchsorted(rows, at, side="right") - 1
        first = stretch[row]
        place = first + (at - rows[row]) // self.length
        size = len(self.vocabulary)

        def in_passages(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            earlier = which[place[which] > first[which]]
            pairs = np.unique(np.concatenate((place[which] * size + term[which], (place[earlier] - 1) * size + term[earlier])))
            return pairs // size, pairs % size

        passage, terms = in_passages(np.flatnonzero(self.essential[term]))
        able, bound = _summed(passage, self.most[terms])
        able = able[bound + self.slack >= 1 - 1e-9]
        left = np.isin(passage, able)
        passage, terms = passage[left], terms[left]
        n = self.block_postings[terms + 1] - self.block_postings[terms]
        there = ranges(self.block_postings[terms], n)
        blocks, bound = _summed(np.repeat(passage, n) * self.n_blocks + self.block[there], self.block_max[there])
        blocks = blocks[bound + self.block_slack[blocks % self.n_blocks] >= 1 - 1e-9]
        if not len(blocks):
            return ()
        able = np.unique(blocks // self.n_blocks)
        passage, terms = in_passages(np.flatnonzero(np.isin(place, np.concatenate((able, able + 1)))))
        n = self.postings[terms + 1] - self.postings[terms]
        there = ranges(self.postings[terms], n)
        passage, item = np.repeat(passage, n), self.item[there]
        left = np.isin(passage * self.n_blocks + item // BLOCK, blocks)
        found, score = _summed(passage[left] * len(self.ids) + item[left], self.weight[there[left]])
        hit = score >= 1 - 1e-9
        return zip((found[hit] // len(self.ids)).tolist(), (found[hit] % len(self.ids)).tolist(), score[hit].tolist(), strict=True)

    def search(self, codes: np.ndarray, rows: np.ndarray):
        """(row, item, score, overlap, question overlap, answer overlap) of verified pairs."""
        best: dict[tuple[int, int], tuple] = {}
        stretch = rows[:-1] // self.length + np.arange(len(rows) - 1)
        last, held = -1, {}
        for p, k, score in self.retrieve(codes, rows, stretch):
            if p != last:
                r = int(np.searchsorted(stretch, p, side="right")) - 1
                start = int(rows[r] + (p - stretch[r]) * self.length)
                last, passage, held = p, codes[start : min(start + 2 * self.length, int(rows[r + 1]))], {}
            share = []
            for n, own in self.sets[k]:
                if n not in held:
                    held[n] = ngrams(passage, n) if n else passage
                share.append(float(np.isin(own, held[n]).mean()) if n else 1.0)
            if share[0] >= OVERLAP and min(share[1:]) >= PART_OVERLAP and share[0] > best.get((r, k), (0, 0))[1]:
                best[r, k] = (score, *share)
        return [(r, self.ids[k], *v) for (r, k), v in sorted(best.items())]


def item_words(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return words(raw, np.array([0, len(raw)]))[0]


def build_indexes(items: list[tuple[int, str, list[int], list[int]]], total: int, mean: float) -> list[Index]:
    """Indexes by length class of (id, text, terms, their frequencies over all items)."""
    classes: dict[int, list] = {}
    for number, text, term, frequency in items:
        codes = item_words(text)
        classes.setdefault(max(3, len(codes).bit_length()), []).append((number, codes, dict(zip((t & 0xFFFFFFFFFFFFFFFF for t in term), frequency, strict=True))))
    return [Index(x, total, mean) for _, x in sorted(classes.items())]


_built: dict[str, list[Index]] = {}


def _indexes(shared, name: str) -> list[Index]:
    """The indexes of a chunk; a worker builds them once."""
    if name not in _built:
        _built.clear()
        _built[name] = build_indexes(*shared.value)
    return _built[name]


def _matches(indexes: list[Index], texts: pa.Array):
    data, offsets = text_bytes(texts)
    for i, j in slices(offsets):
        codes, rows = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for index in indexes:
            for r, *rest in index.search(codes, rows):
                yield i + r, *rest


def _pairs(shared, name: str):
    def run(batches):
        indexes = _indexes(shared, name)
        for batch in batches:
            got = list(zip(*_matches(indexes, batch.column(1)), strict=True)) or [()] * 6
            row, kinds = pa.array(got[0], pa.int64()), (pa.int64(), *[pa.float64()] * 4)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), *(pa.array(v, t) for v, t in zip(got[1:], kinds, strict=True))], names=["id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"])

    return run


def _without(shared, name: str, text_col: str):
    def run(batches):
        indexes = _indexes(shared, name)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for row, *_ in _matches(indexes, batch.column(batch.schema.get_field_index(text_col))):
                keep[row] = False
            yield batch.filter(pa.array(keep))

    return run


def _terms(batches):
    """Items with words: their texts, lengths and distinct terms."""
    for batch in batches:
        codes = [item_words(t) for t in batch.column(1).to_pylist()]
        full = [k for k, c in enumerate(codes) if len(c)]
        terms = [np.unique(codes[k]).view(np.int64) for k in full]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(full, pa.int64())) for c in (0, 1)), pa.array([len(codes[k]) for k in full], pa.int64()), pa.array(terms, pa.list_(pa.int64()))], names=["id", "text", "n", "terms"])


def _chunks(items: DataFrame, item_col: str, text_col: str, chunk_bytes: int):
    """Broadcasts of at most chunk_bytes of items each (or one item), with what all items say of their terms, and names for them."""
    spark = items.sparkSession
    named = items.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).alias("text")).distinct()
    coded = durable(named.mapInArrow(_terms, "id long, text string, n long, terms array<bigint>"))
    total, mean = coded.agg(F.count("*"), F.avg("n")).first()
    each = coded.select("id", "text", F.explode("terms").alias("term"))
    known = each.join(each.groupBy("term").agg(F.count("*").alias("df")), "term").groupBy("id", "text").agg(F.collect_list(F.struct("term", "df")).alias("terms"))
    known = known.select("id", "text", F.col("terms.term").alias("term"), F.col("terms.df").alias("df"))
    held, size = [], 0
    for x in known.orderBy("id", "text").toLocalIterator():
        if held and size + len(x[1]) > chunk_bytes:
            yield spark.sparkContext.broadcast((held, total, mean)), uuid.uuid4().hex
            held, size = [], 0
        held.append(tuple(x))
        size += len(x[1])
    if held:
        yield spark.sparkContext.broadcast((held, total, mean)), uuid.uuid4().hex


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, item_id, score, overlap, question_overlap, answer_overlap) of every leak."""
    prepared(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    for shared, name in _chunks(items, item_col, item_text_col, chunk_bytes):
        out = out.unionByName(rows.mapInArrow(_pairs(shared, name), schema))
    return out.withColumnRenamed("id", id_col)


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs without the documents that hold an item."""
    prepared(docs.sparkSession)
    for shared, name in _chunks(items, item_col, item_text_col, chunk_bytes):
        docs = docs.mapInArrow(_without(shared, name, text_col), docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    from .frames import documents

    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
