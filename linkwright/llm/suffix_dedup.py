"""Suffix-array dedup: removes every byte covered by a string that a smaller document also has.

``suffix_dedup(docs)`` takes documents (an integer id and a text, other columns are carried) and
removes each byte covered by a ``width``-byte string (50) that also starts in a document with a
smaller id. Matches never cross documents; strings are judged on the input.

How it works, without comparing everything with everything:

1. Texts are packed into shards (compressed tables of about ``shard_bytes``), kept in the shared
   checkpoint folder.
2. Every window of ``width`` bytes has an anchor: its least 16-gram by hash, the leftmost on ties.
   Equal windows have equal anchors at equal places, so no repeat is lost by looking only at
   anchors that two documents share. A shard sends each distinct (anchor, context) once, with its
   least document; the context is all text that a window with this anchor can reach.
3. Where a smaller document has the same context, all of it is covered. Anchors that several
   documents have in *different* contexts go on as contexts' bytes.
4. These contexts are laid out in shards by anchor. Each shard gets a suffix array by
   Larsson-Sadakane refinement, and common prefixes by Kasai's rule; suffixes with a common prefix
   of ``width`` bytes form groups, whose members in larger documents are covered. An anchor with
   more contexts than ``hot_contexts`` is dealt over several shards; each sends its distinct windows
   in suffix order, once each with its least document, the sorted lists are merged by binary
   search, and the least document of all lists goes back to each. (The result is the same for any
   value; it only decides where windows meet.)
5. Each shard of texts collects its verdicts and cuts the covered bytes.

Cases: a NULL text is empty; a NULL id counts as the largest; rows with equal ids never remove
bytes from each other; texts shorter than ``width`` stay whole; an empty table gives an empty
result; input columns named as an output column are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import BYTE_CODES, U64, group_bounds, group_starts, mix, pack, prefix_codes, ranges, slices, span_hashes, text_bytes, unpack
from .frames import durable, prepared, release, text_volume

WIDTH = 50
GRAM = 16
SHARD_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
#: More distinct contexts of one anchor than this are dealt over shards.
HOT_CONTEXTS = 4_000
#: Contexts in one suffix array, unless one anchor has more (up to hot_contexts).
BLOCK = 4_000
COVERED, FIRST, ASK, HOT = 1, 2, 4, 8
_LAST = np.iinfo(np.int64).max


# --- suffix arrays ---------------------------------------------------------------------------


def packed_symbols(text: np.ndarray) -> tuple[np.ndarray, int]:
    """The first eight symbols of every suffix (four, if there are symbols over 254) as one number, and how many."""
    n, h = len(text), 8 if text.max(initial=0) < 255 else 4
    first, symbols = np.zeros(n, U64), (text + 1).astype(U64)
    for k in range(min(h, n)):
        first[: n - k] |= symbols[k:] << U64(64 - 64 // h * (k + 1))
    return first, h


def suffix_array(text: np.ndarray, depth: int | None = None, packed: tuple[np.ndarray, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of non-negative symbols below 2**15, by Larsson-Sadakane refinement.

    Suffixes are ordered by their first packed_symbols(); then every group of suffixes that still tie
    is ordered by the ranks that stand h places on, h doubling, and settled groups are left alone.
    With ``depth`` it stops when ties agree in that many symbols; equal ranks then mark such ties.
    """
    n = len(text)
    kind = np.int32 if n < 1 << 31 else np.int64
    if not n:
        return np.zeros(0, kind), np.zeros(0, kind)
    first, h = packed or packed_symbols(text)
    order = np.argsort(first).astype(kind)
    first = first[order]
    head = group_starts(first).astype(kind)
    del first
    rank = np.empty(n, kind)
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    while h < (depth or n):
        at = rank[order]
        tied = np.zeros(n, bool)
        same = at[1:] == at[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        place = np.flatnonzero(tied)
        if not len(place):
            break
        members, group = order[place], at[place]
        beyond = members.astype(np.int64) + h
        after = np.where(beyond < n, rank[np.minimum(beyond, n - 1)].astype(np.int64) + 1, 0)
        del at, tied, same, beyond
        by = np.lexsort((after, group)) if n >= 1 << 31 else np.argsort((group.astype(np.int64) << 32) | after)
        members, group, after = members[by], group[by], after[by]
        order[place] = members
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])))
        rank[members] = place[np.flatnonzero(new)][np.cumsum(new) - 1].astype(kind)
        h *= 2
    return order, rank


def common_prefixes(text: np.ndarray, order: np.ndarray, width: int, limit: int, span: int | None = None, packed: tuple[np.ndarray, int] | None = None) -> np.ndarray:
    """Length, up to ``limit``, of each suffix's common prefix with the one before it in ``order``.

    Kasai's rule - a suffix's common prefix is at least that of the suffix one place to the left,
    less one - is followed from every ``width``-th place of the text at once. ``order`` may leave
    suffixes out or tie those that agree in ``limit`` symbols: the rule is used where the suffix
    that it rests on stands before. ``span``: only the first places of each ``width`` are in order.
    """
    n = len(text)
    keys, per = packed or packed_symbols(text)
    flat = np.concatenate((text, np.full(limit + 1, -1, text.dtype)))
    keys = np.concatenate((keys, np.zeros(limit + 1, U64)))
    where = np.full(n + 1, -1, order.dtype)
    where[order] = np.arange(len(order), dtype=order.dtype)
    out = np.zeros(len(order), np.int64 if limit >= 1 << 15 else np.int16)
    base = np.arange(0, n, width)
    known, before = np.zeros(len(base), np.int64), np.full(len(base), n - 1)
    for offset in range(min(width, span or width)):
        mine = base[base + offset < n] + offset
        at = where[mine]
        rests = where[before[: len(mine)] + 1]
        known = np.where((rests >= 0) & (rests < at), np.maximum(known[: len(mine)] - 1, 0), 0)
        live = np.flatnonzero(at > 0)
        before = np.full(len(mine), n - 1)  # no suffix stands at n
        before[live] = order[at[live] - 1]
        going = live
        while len(going):  # several symbols at once; a number with symbols beyond the text is no other's, unless it is of the same length
            reach = known[going]
            x, y = mine[going] + reach, before[going] + reach
            going = going[(reach + per <= limit) & (np.maximum(x, y) + per <= n) & (keys[x] == keys[y])]
            known[going] += per
        going = live
        while len(going):
            reach = known[going]
            going = going[(reach < limit) & (flat[mine[going] + reach] == flat[before[going] + reach])]
            known[going] += 1
        out[at[live]] = known[live]
    return out


def window_groups(contexts: np.ndarray, length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the contexts in suffix order: context, start, and group (equal windows share one)."""
    size = contexts.shape[1]
    text = contexts.ravel()
    packed = packed_symbols(text)
    order, _ = suffix_array(text, width, packed)
    context, start = order // size, order % size
    whole = start + width <= length[context]
    order, context, start = order[whole], context[whole], start[whole]
    group = np.cumsum(common_prefixes(text, order, size, width, size - width + 1, packed) < width, dtype=order.dtype)
    return context.astype(np.int64), start, group


# --- anchors ---------------------------------------------------------------------------------


def anchors(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The anchors of all windows of each row: key, context hash, row, and the context's range."""
    found = {k: [] for k in ("key", "context", "row", "start", "end")}
    reach = width - gram
    for i, j in slices(offsets, 128 << 10):  # arrays that stay in the cache
        base, off = offsets[i], offsets[i : j + 1] - offsets[i]
        part = data[base : offsets[j]]
        n = len(part)
        if n < width:
            continue
        code = BYTE_CODES[part]
        step = 1
        while step < gram:
            code = code[:-step] * U64(pow(0x2545F4914F6CDD1D, step, 1 << 64)) + code[step:]
            step *= 2
        code = mix(code)
        least = (code & U64(0xFFFFFFFF00000000)) | np.arange(len(code), dtype=U64)
        span, step = reach + 1, 1
        while 2 * step <= span:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if span > step:
            least = np.minimum(least[: len(least) - (span - step)], least[span - step :])
        place = (least & U64(0xFFFFFFFF)).astype(np.int64)
        row = np.repeat(np.arange(j - i), np.diff(off))[: len(place)]
        whole = np.arange(len(place)) + width <= off[row + 1]
        place, row = place[whole], row[whole]
        if not len(place):
            continue
        new = np.concatenate(([True], place[1:] != place[:-1]))
        place, row = place[new], row[new]
        start, end = np.maximum(place - reach, off[row]), np.minimum(place + gram + reach, off[row + 1])
        prefix = prefix_codes(part)
        shape = ((place - start) * 256 + (end - place)).astype(U64)
        found["key"].append(mix(code[place] ^ U64(0xA5A5A5A5A5A5A5A5)))
        found["context"].append(mix(span_hashes(prefix, start, end) + shape) >> U64(16))
        found["row"].append(row + i)
        found["start"].append(start + base)
        found["end"].append(end + base)
    kinds = {"key": U64, "context": U64, "row": np.int64, "start": np.int64, "end": np.int64}
    return {k: np.concatenate(v) if v else np.zeros(0, kinds[k]) for k, v in found.items()}


def open_shard(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()


class Shard:
    """A block of texts in id order, its anchors, and the distinct (key, context) entries of these."""

    def __init__(self, blob: bytes, id_col: str, text_col: str, width: int):
        self.table = open_shard(blob)
        ids = self.table[id_col].combine_chunks()
        self.ids = np.asarray(ids.cast(pa.int64()).fill_null(_LAST))
        self.data, self.offsets = text_bytes(self.table[text_col])
        self.anchors = found = anchors(self.data, self.offsets, width)
        mark = (found["key"] & U64(0xFFFFFF0000000000)) | (mix(found["key"] + found["context"]) >> U64(24))
        self.order = np.argsort(mark, kind="stable")
        self.heads = group_starts(mark[self.order])
        self.first = self.order[self.heads]  # of each entry, the occurrence in the least document
        self.key = found["key"][self.first]

    def pieces(self, buckets: int):
        """Entry ranges by bucket: bucket, first, last."""
        bucket = ((self.key >> U64(40)) * U64(buckets)) >> U64(24)
        for a, b in group_bounds(bucket):
            yield int(bucket[a]), int(a), int(b)


def _pack_shards(id_col: str, text_col: str, shard_bytes: int):
    def run(batches):
        task, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def shard():
            table = pa.Table.from_batches(held)
            at = table[id_col].combine_chunks()
            by = np.argsort(np.asarray(at.cast(pa.int64()).fill_null(_LAST)), kind="stable")
            table = table.take(pa.array(by))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            blob = zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_pydict({"shard": pa.array([(task << 32) + seq], pa.int64()), "blob": pa.array([blob], pa.binary())})

        for batch in batches:
            _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            for i, j in slices(offsets, shard_bytes // 2):
                if held and size + offsets[j] - offsets[i] > shard_bytes:
                    yield shard()
                    seq, held, size = seq + 1, [], 0
                held.append(batch.slice(i, j - i))
                size += int(offsets[j] - offsets[i])
        if held:
            yield shard()

    return run


def _entries(buckets: int, id_col: str, text_col: str, width: int):
    def run(batches):
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = Shard(blob, id_col, text_col, width)
                context, doc = s.anchors["context"][s.first], s.ids[s.anchors["row"][s.first]]
                out = {"bucket": [], "shard": [], "blob": []}
                for bucket, a, b in s.pieces(buckets):
                    out["bucket"].append(bucket)
                    out["shard"].append(number)
                    c = context[a:b]
                    out["blob"].append(pack(np.diff(s.key[a:b], prepend=U64(0)), (c >> U64(16)).astype(np.uint32), c.astype(np.uint16), doc[a:b]))
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("blob", pa.binary())]))

    return run


_VERDICT = pa.schema([("shard", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])


def _judge(table: pa.Table, hot_contexts: int) -> pa.Table:
    """For every entry of a bucket: covered here, first here, contexts to be asked for."""
    pieces = [unpack(x, U64, np.uint32, np.uint16, np.int64) for x in table["blob"].to_pylist()]
    sizes = [len(p[0]) for p in pieces]
    key = np.concatenate([np.cumsum(p[0], dtype=U64) for p in pieces])
    context = np.concatenate([(p[1].astype(U64) << U64(16)) | p[2] for p in pieces])
    doc = np.concatenate([p[3] for p in pieces])
    code = np.zeros(len(key), np.uint8)
    order = np.argsort(key)
    head = group_starts(key[order])
    count = np.diff(np.append(head, len(key)))
    shared = np.repeat(count > 1, count)
    order = order[shared]
    if len(order):
        order = order[np.lexsort((doc[order], context[order], key[order]))]
        k, c, d = key[order], context[order], doc[order]
        new_key = np.concatenate(([True], k[1:] != k[:-1]))
        new = new_key | np.concatenate(([True], c[1:] != c[:-1]))
        at = np.flatnonzero(new)
        each = np.diff(np.append(at, len(k)))
        least = np.repeat(d[at], each)
        mark = np.where(d > least, COVERED, FIRST).astype(np.uint8)
        # of each key: its contexts and whether their first documents differ
        which = np.cumsum(new_key[at]) - 1
        contexts = np.bincount(which)
        lo = np.minimum.reduceat(d[at], np.flatnonzero(new_key[at]))
        hi = np.maximum.reduceat(d[at], np.flatnonzero(new_key[at]))
        ask = np.where((contexts > 1) & (hi > lo), ASK + HOT * (contexts > hot_contexts), 0).astype(np.uint8)
        mark |= np.where(mark & FIRST, np.repeat(ask[which], each), 0).astype(np.uint8)
        code[order] = mark
    cuts = np.cumsum([0, *sizes])
    blobs = [pack(code[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"shard": table["shard"], "bucket": table["bucket"], "kind": pa.array([0] * len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary())}, schema=_VERDICT)


def _codes(s: Shard, buckets: int, verdicts: pa.Table) -> np.ndarray:
    code = np.zeros(len(s.key), np.uint8)
    got = {b: x for b, k, x in zip(verdicts["bucket"].to_pylist(), verdicts["kind"].to_pylist(), verdicts["blob"].to_pylist(), strict=True) if k == 0}
    for bucket, a, b in s.pieces(buckets):
        code[a:b] = unpack(got[bucket], np.uint8)[0]
    return code


_ASKED = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("blob", pa.binary()), ("bytes", pa.binary())])


def _ask(buckets: int, id_col: str, text_col: str, width: int):
    """The contexts of anchors that documents share in different contexts, to shards by anchor."""
    size = 2 * width - GRAM

    def run(shard: pa.Table, verdicts: pa.Table) -> pa.Table:
        out = {k: [] for k in _ASKED.names}
        if shard.num_rows:
            s = Shard(shard["blob"][0].as_py(), id_col, text_col, width)
            code = _codes(s, buckets, verdicts)
            entry = np.flatnonzero(code & ASK)
            at = s.first[entry]
            start, end, doc = s.anchors["start"][at], s.anchors["end"][at], s.ids[s.anchors["row"][at]]
            salt = buckets + (s.anchors["context"][at] % U64(4 * buckets)).astype(np.int64)
            to = np.where(code[entry] & HOT, salt, (((s.key[entry] >> U64(40)) * U64(buckets)) >> U64(24)).astype(np.int64))
            by = np.argsort(to, kind="stable")
            for a, b in group_bounds(to[by]):
                x = by[a:b]
                grid = np.minimum(start[x][:, None] + np.arange(size), end[x][:, None] - 1)
                out["bucket"].append(int(to[x[0]]))
                out["shard"].append(shard["shard"][0].as_py())
                out["blob"].append(pack(entry[x].astype(np.uint32), (end - start)[x].astype(np.uint8), doc[x], s.key[entry[x]]))
                out["bytes"].append(zstandard.ZstdCompressor(level=1).compress(s.data[grid].tobytes()))
        return pa.table(out, schema=_ASKED)

    return run


def _asked(table: pa.Table, width: int):
    size = 2 * width - GRAM
    parts = [unpack(x, np.uint32, np.uint8, np.int64, U64) for x in table["blob"].to_pylist()]
    shard = np.repeat(np.asarray(table["shard"]), [len(p[0]) for p in parts])
    entry, length, doc, anchor = (np.concatenate([p[k] for p in parts]) for k in range(4))
    raw = b"".join(zstandard.ZstdDecompressor().decompress(x) for x in table["bytes"].to_pylist())
    contexts = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return shard, entry, length.astype(np.int64), doc, contexts, anchor


def _marks(shard: np.ndarray, entry: np.ndarray, start: np.ndarray) -> pa.Table:
    """Covered windows of entries, by shard."""
    by = np.argsort(shard, kind="stable")
    cut = [by[a:b] for a, b in group_bounds(shard[by])]
    return pa.table({"shard": pa.array([int(shard[x[0]]) for x in cut], pa.int64()), "bucket": pa.array([-1] * len(cut), pa.int64()), "kind": pa.array([1] * len(cut), pa.int32()), "blob": pa.array([pack(entry[x], start[x]) for x in cut], pa.binary())}, schema=_VERDICT)


def _in_blocks(contexts: np.ndarray, length: np.ndarray, width: int, order: np.ndarray, bound: np.ndarray):
    """window_groups() of blocks of contexts that end where an anchor's contexts end."""
    at = 0
    while at < len(order):
        to = int(np.searchsorted(bound, at + BLOCK, side="right"))
        to = int(bound[to - 1]) if to and bound[to - 1] > at else int(bound[min(to, len(bound) - 1)])
        x = order[at:to]
        c, start, group = window_groups(contexts[x].astype(np.int16), length[x], width)
        yield x[c], start, group
        at = to


def _search(width: int):
    """Covered windows among the contexts of a shard's anchors."""

    def run(table: pa.Table) -> pa.Table:
        shard, entry, length, doc, contexts, anchor = _asked(table, width)
        order = np.argsort(anchor, kind="stable")
        bound = np.append(group_starts(anchor[order])[1:], len(order))
        hits, starts = [], []
        for c, start, group in _in_blocks(contexts, length, width, order, bound):
            least = np.full(int(group.max(initial=0)) + 1, _LAST)
            np.minimum.at(least, group, doc[c])
            covered = doc[c] > least[group]
            hits.append(c[covered])
            starts.append(start[covered])
        hit, start = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hits, starts))
        return _marks(shard[hit], entry[hit], start.astype(np.uint8))

    return run


def _hot_blocks(table: pa.Table, width: int):
    """A shard of hot anchors' contexts in blocks: windows in suffix order (context, start), where each distinct one begins, its bytes."""
    table = table.sort_by("shard")  # both readers of the shard see the same order
    shard, entry, length, doc, contexts, _ = _asked(table, width)
    for i in range(0, len(doc), BLOCK):
        block = slice(i, i + BLOCK)
        c, start, group = window_groups(contexts[block].astype(np.int16), length[block], width)
        if len(c):
            head = group_starts(group)
            names = contexts[(i + c[head])[:, None], start[head][:, None] + np.arange(width)]
            yield i, shard, entry, doc, c + i, start, head, names


def _part(names: np.ndarray, parts: int) -> np.ndarray:
    code = np.zeros(len(names), U64)
    for k in range(names.shape[1]):
        code = code * U64(0x2545F4914F6CDD1D) + BYTE_CODES[names[:, k]]
    return (mix(code) % U64(parts)).astype(np.int64)


_LISTS = pa.schema([("part", pa.int64()), ("bucket", pa.int64()), ("block", pa.int64()), ("windows", pa.binary()), ("blob", pa.binary())])
_REPLIES = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("part", pa.int64()), ("blob", pa.binary())])


def _sorted_lists(parts: int, width: int):
    """The distinct windows of a shard of hot anchors' contexts in suffix order, each with its least document, by part."""

    def run(table: pa.Table) -> pa.Table:
        out = {k: [] for k in _LISTS.names}
        for i, _, _, doc, c, _, head, names in _hot_blocks(table, width):
            least, part = np.minimum.reduceat(doc[c], head), _part(names, parts)
            by = np.argsort(part, kind="stable")  # within a part the suffix order stays
            for a, b in group_bounds(part[by]):
                x = by[a:b]
                out["part"].append(int(part[x[0]]))
                out["bucket"].append(table["bucket"][0].as_py())
                out["block"].append(i)
                out["windows"].append(zstandard.ZstdCompressor(level=1).compress(names[x].tobytes()))
                out["blob"].append(pack(least[x]))
        return pa.table(out, schema=_LISTS)

    return run


def _sortable(windows: bytes, width: int) -> np.ndarray:
    """Windows as byte strings; one byte more is kept, as a string that ends in a zero byte would lose it in comparisons."""
    rows = np.frombuffer(zstandard.ZstdDecompressor().decompress(windows), np.uint8).reshape(-1, width)
    return np.ascontiguousarray(np.concatenate((rows, np.full((len(rows), 1), 1, np.uint8)), axis=1)).view(f"S{width + 1}").ravel()


def merged(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Two by two, sorted lists of distinct names with their least documents become one, by binary search."""
    while len(lists) > 1:
        longer = []
        for k in range(0, len(lists) - 1, 2):
            (names, least), (other, least2) = lists[k], lists[k + 1]
            at = np.searchsorted(names, other)
            there = at < len(names)
            there[there] = names[at[there]] == other[there]
            least = least.copy()
            least[at[there]] = np.minimum(least[at[there]], least2[there])
            longer.append((np.insert(names, at[~there], other[~there]), np.insert(least, at[~there], least2[~there])))
        lists = longer + lists[len(lists) - len(lists) % 2 :]
    return lists[0]


def _merge(width: int):
    """Merges a part's sorted lists and tells each list the least document of each of its windows."""

    def run(table: pa.Table) -> pa.Table:
        lists = [(_sortable(w, width), unpack(b, np.int64)[0]) for w, b in zip(table["windows"].to_pylist(), table["blob"].to_pylist(), strict=True)]
        names, least = merged(lists)
        blobs = [pack(least[np.searchsorted(names, own)]) for own, _ in lists]
        return pa.table([table["bucket"], table["block"], table["part"], pa.array(blobs, pa.binary())], schema=_REPLIES)

    return run


def _told(parts: int, width: int):
    """Marks the windows of a shard of hot anchors' contexts that a smaller document has in any shard."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        got = {(i, p): x for i, p, x in zip(replies["block"].to_pylist(), replies["part"].to_pylist(), replies["blob"].to_pylist(), strict=True)}
        hits = []
        for i, shard, entry, doc, c, start, head, names in _hot_blocks(table, width) if table.num_rows else ():
            part = _part(names, parts)
            by = np.argsort(part, kind="stable")
            least = np.empty(len(head), np.int64)
            for a, b in group_bounds(part[by]):
                x = by[a:b]
                least[x] = unpack(got[i, int(part[x[0]])], np.int64)[0]
            later = doc[c] > np.repeat(least, np.diff(np.append(head, len(c))))
            hits.append((shard[c[later]], entry[c[later]], start[later].astype(np.uint8)))
        if not hits:
            return _VERDICT.empty_table()
        return _marks(*(np.concatenate(x) for x in zip(*hits, strict=True)))

    return run


def _cut(buckets: int, id_col: str, text_col: str, width: int, schema: pa.Schema):
    def run(shard: pa.Table, verdicts: pa.Table) -> pa.Table:
        if not shard.num_rows:
            return schema.empty_table()
        s = Shard(shard["blob"][0].as_py(), id_col, text_col, width)
        code, found = _codes(s, buckets, verdicts), s.anchors
        entry_of = np.empty(len(s.order), np.int64)
        entry_of[s.order] = np.repeat(np.arange(len(s.heads)), np.diff(np.append(s.heads, len(s.order))))
        doc, own = s.ids[found["row"]], code[entry_of]
        first = s.ids[found["row"][s.first]][entry_of]
        whole = (own & COVERED).astype(bool) | (doc > first)  # by another shard's document, or by one of this shard
        change = np.zeros(len(s.data) + 1, np.int32)
        spans = [(found["start"][whole], found["end"][whole])]
        for kind, blob in zip(verdicts["kind"].to_pylist(), verdicts["blob"].to_pylist(), strict=True):
            if kind == 1:
                entry, start = unpack(blob, np.uint32, np.uint8)
                lo = s.heads[entry]
                count = np.append(s.heads, len(s.order))[entry + np.uint32(1)] - lo
                at = s.order[ranges(lo, count)]
                begin, least = np.repeat(start.astype(np.int64), count), np.repeat(s.ids[found["row"][s.first[entry]]], count)
                same = doc[at] == least
                begin = found["start"][at[same]] + begin[same]
                spans.append((begin, begin + width))
        for begin, end in spans:
            wide = end - begin >= width
            np.add.at(change, begin[wide], 1)
            np.add.at(change, end[wide], -1)
        gone = np.cumsum(change[:-1]) > 0
        n_removed, n_spans, kept, digest = [], [], [], []
        for a, b in zip(s.offsets[:-1], s.offsets[1:], strict=True):
            out = gone[a:b]
            left = s.data[a:b][~out].tobytes()
            n_removed.append(int(out.sum()))
            n_spans.append(int((out[1:] & ~out[:-1]).sum() + out[:1].sum()))
            kept.append(left)
            digest.append(hashlib.sha256(left).hexdigest())
        new = {"n_bytes": pa.array(np.diff(s.offsets), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary()), "kept_text": pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()), "kept_sha256": pa.array(digest, pa.string())}
        return pa.table([new[k] if k in new else s.table[k] for k in schema.names], schema=schema)

    return run


RESULT = T.StructType(
    [*(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType()), T.StructField("kept_text", T.StringType()), T.StructField("kept_sha256", T.StringType())]
)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, shard_bytes: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept (the remaining bytes), kept_text (these without parts of characters) and kept_sha256."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    prepared(spark)
    docs = docs.select(*[c for c in docs.columns if c not in RESULT.names or c in (id_col, text_col)])
    schema = T.StructType([*docs.schema.fields, *RESULT.fields])
    buckets = max(4, -(-text_volume(docs, text_col) // bucket_bytes))
    own = (id_col, text_col, width)
    shards = durable(docs.mapInArrow(_pack_shards(id_col, text_col, shard_bytes), "shard long, blob binary"))
    entries = shards.mapInArrow(_entries(buckets, *own), "bucket long, shard long, blob binary")
    verdicts = durable(entries.groupBy("bucket").applyInArrow(lambda table: _judge(table, hot_contexts), "shard long, bucket long, kind int, blob binary"))
    release(spark, 1.0)
    asked = durable(shards.groupBy("shard").cogroup(verdicts.groupBy("shard")).applyInArrow(_ask(buckets, *own), "bucket long, shard long, blob binary, bytes binary"))
    release(spark, 1.0)
    marks = asked.where(F.col("bucket") < buckets).groupBy("bucket").applyInArrow(_search(width), "shard long, bucket long, kind int, blob binary")
    marks = durable(marks)
    if not (hot := asked.where(F.col("bucket") >= buckets)).isEmpty():
        release(spark, 1.0)
        parts = 4 * buckets
        lists = hot.groupBy("bucket").applyInArrow(_sorted_lists(parts, width), "part long, bucket long, block long, windows binary, blob binary")
        replies = lists.groupBy("part").applyInArrow(_merge(width), "bucket long, block long, part long, blob binary")
        told = hot.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(_told(parts, width), "shard long, bucket long, kind int, blob binary")
        marks = marks.unionByName(durable(told))
    del asked, hot
    release(spark, 1.0)
    return shards.groupBy("shard").cogroup(verdicts.unionByName(marks).groupBy("shard")).applyInArrow(_cut(buckets, *own, to_arrow_schema(schema)), schema)


def query(spark, sf_dir: str) -> DataFrame:
    from .frames import documents

    return suffix_dedup(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
