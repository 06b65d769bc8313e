from __future__ import annotations

import hashlib
import io
import itertools
import math
import operator
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkwright.llm import arrays, components, decontaminate, html_text, licenses, lm_scores, media, mixing, near_dedup, quality, suffix_dedup, token_counts

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_bytes string, shard string"
ODD = [None, "", " ", "one", "Two words", "x" * 5000, "é ü  ñ", "a b c d e", "A b C d e"]


def frame(spark, texts, ids=None, parts=3):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, None, None if k % 5 == 0 else f"src{k % 3}", None, "x", "y", "z") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA).repartition(parts)


def made_texts(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90))) for _ in range(14)]
    out = []
    for _ in range(n):
        words = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary).upper()
        if rng.random() < 0.3:
            words += rng.choice(base).split(" ")[: rng.randint(0, 60)]
        out.append(rng.choice([" ", " ", "\n"]).join(words))
    return out + ODD


def brute_cut(rows, width=50):
    key = lambda i: 1 << 63 if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            first[b[p : p + width]] = min(first.get(b[p : p + width], 1 << 64), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < key(i):
                gone[p : p + width] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4_000, 2])
@pytest.mark.parametrize("shard", [6_000, 1 << 20])
def test_suffix_dedup(spark, hot, shard):
    texts = made_texts(hot)
    ids = [None if k == 7 else 3 if k in (20, 21) else k for k in range(len(texts))]
    got = suffix_dedup.suffix_dedup(frame(spark, texts, ids), shard_bytes=shard, bucket_bytes=4000, hot_contexts=hot)
    have = got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(str, map(tuple, have))) == sorted(map(str, brute_cut(list(zip(ids, texts, strict=True)))))
    assert got.columns.count("n_bytes") == 1 and "shard" in got.columns
    assert suffix_dedup.suffix_dedup(frame(spark, texts).limit(0)).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        text = rng.integers(0, 3, n)
        order, _ = suffix_dedup.suffix_array(text)
        suffixes = [tuple(text[i:]) for i in range(n)]
        assert order.tolist() == sorted(range(n), key=lambda i: suffixes[i])
        common = suffix_dedup.common_prefixes(text, order, 7, 1000)
        for k in range(1, n):
            a, b = suffixes[order[k - 1]], suffixes[order[k]]
            assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def families(seed, n=240):
    """Texts of one long base: families near the limit of similarity, linked in chains or just not."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(160)]
    heads = []
    for f in range(12):
        head = list(base)
        for k in range(f % 5):
            head[(37 * k + 11 * f) % 160] = f"f{f}k{k}"
        heads.append(head)
    out = []
    for i in range(n):
        words = list(rng.choice(heads))
        for k in range(rng.randint(0, 3)):
            words[rng.randrange(160)] = f"v{i}k{k}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("make", "bound", "part"), [(made_texts, 1_000, 500), (made_texts, 4, 500), (families, 4, 500), (families, 1, 3)])
def test_near_dedup(spark, monkeypatch, make, bound, part):
    for name in ("REGION", "GROUP"):
        monkeypatch.setattr(near_dedup, name, bound)
    monkeypatch.setattr(near_dedup, "PART", part)
    texts = make(bound)
    sets, first = [shingle_set(t) for t in texts], least_linked(texts, 85)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), first[i], first[i] == i) for i in range(len(texts))}
    alone = near_dedup.near_duplicates(frame(spark, ["a b c"] * 3, [None, 4, 4])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in alone) == [("4", "4", True), ("4", "4", True), ("None", "None", True)]
    assert near_dedup.near_duplicates(frame(spark, texts).limit(0)).count() == 0


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 120), (120, 110), (7, 7)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(1, 41)}, 110: 100, 120: 100}


def test_lm_scores_match_sql(spark):
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = {r[0]: r[1:] for r in db.sql(lm_scores.SQL).fetchall()}
    have = {r.doc_id: tuple(r)[1:] for r in lm_scores.query(spark, SF).collect()}
    assert set(have) == set(want) and all(have[k] == pytest.approx(want[k], abs=1e-4) for k in want)
    odd = {r.doc_id: r for r in lm_scores.lm_scores(frame(spark, ODD), shard_bytes=2000).collect()}
    assert odd[0].n_words == 0 and odd[0].log_score == 0 and odd[0].mean_log is None and odd[7].mean_log == pytest.approx(odd[8].mean_log)
    assert lm_scores.lm_scores(frame(spark, ODD).limit(0)).count() == 0
    texts = made_texts(3)
    for n in (1, 2):
        want = Counter()
        for t in texts:
            w = WORD.findall((t or "").translate(LOWER))
            want.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        counts = lm_scores.ngram_counts(frame(spark, texts), n, shard_bytes=2000, bucket_bytes=3000).collect()
        assert sorted(r.n for r in counts) == sorted(want.values()) and len({r.gram for r in counts}) == len(want)
    rows = {}
    for r in lm_scores.lm_scores(frame(spark, ["a b c", "a b c", "a b d", "w " * 700_000], [1, 1, None, 4])).collect():
        rows.setdefault(r.doc_id, []).append((r.n_words, r.log_score))
    total = 700_009
    # of the rows with id 1 each is the other's corpus
    one = math.log(2 / (total - 3)) + math.log(2 / 2) + math.log(1 / 2)
    assert rows[1] == [(3, pytest.approx(one, abs=1e-4))] * 2 and rows[4][0][0] == 700_000 and len(rows[None]) == 1


def npy(raw):
    return np.load(io.BytesIO(raw))


def area_means(image, size):
    """Means over size x size equal areas, by cutting every pixel into size x size parts."""
    fine = np.kron(image.astype(float), np.ones((size, size, 1)))
    h, w, c = image.shape
    return fine.reshape(size, h, size, w, c).mean(axis=(1, 3))


def plain_hash(image):
    h, w, _ = image.shape
    fine = np.kron(image.astype(float).mean(axis=2), np.ones((8, 9)))
    grey = np.round(fine.reshape(8, h, 9, w).mean(axis=(1, 3)), 9)
    bits = "".join("1" if grey[r, k + 1] > grey[r, k] else "0" for r in range(8) for k in range(8))
    return f"{int(bits, 2):016x}"


def test_media_round_trip(spark):
    texts = [*ODD, "y" * 192, "z" * 193, "x" * 5000, "long ü text " * 200_000, "x" * 5000]
    images = media.stored(media.texts_as_media(frame(spark, texts)))
    for r in media.media_as_texts(images).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert media.decode(bytes(r.media)).tobytes() == payload and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
        if len(payload) < 10_000:
            image = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)
            assert r.feature == plain_hash(image) and np.abs(npy(r.tile) - area_means(image, 32)).max() <= 0.5 + 1e-9
        assert npy(r.tile).shape == (32, 32, 3) and r.score == "x"  # other columns are carried
    assert media.texts_as_media(frame(spark, texts[:3]).limit(0)).count() == 0


def test_suffix_dedup_of_long_and_repeated_texts(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3_000_000))
    part = long[1_000_000:1_200_000]
    rows = [(5, long), (2, part), (2, part), (7, "ab" * 40), (7, "ab" * 40), (9, "ab" * 60), (None, part[:500])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(5, 3_000_000, 200_000, 1), (2, 200_000, 0, 0), (2, 200_000, 0, 0), (7, 80, 0, 0), (7, 80, 0, 0), (9, 120, 120, 1), (None, 500, 500, 1)]))


def test_hot_windows_are_merged():
    """Over hot_contexts contexts an anchor's windows meet by the merge of sorted lists."""
    rng = np.random.default_rng(3)
    lists = []
    for _ in range(7):
        names = np.unique(rng.integers(0, 40, 30)).astype("S4")
        names.sort()
        lists.append((names, rng.integers(0, 100, len(names))))
    want = {}
    for names, least in lists:
        for n, x in zip(names.tolist(), least.tolist(), strict=True):
            want[n] = min(want.get(n, 100), x)
    names, least = suffix_dedup.merged(lists)
    assert names.tolist() == sorted(want) and least.tolist() == [want[n] for n in sorted(want)]
    key = np.repeat(np.arange(1, 4, dtype=np.uint64), (5, 2, 1))
    blob = suffix_dedup.pack(np.diff(key, prepend=np.uint64(0)), np.arange(8, dtype=np.uint32), np.zeros(8, np.uint16), np.arange(8))
    table = pa.table({"bucket": [0], "shard": [0], "blob": pa.array([blob], pa.binary())})
    for hot, marks in ((4, [True] * 5 + [False] * 3), (1, [True] * 7 + [False]), (9, [False] * 8)):
        code = suffix_dedup.unpack(suffix_dedup._judge(table, hot)["blob"][0].as_py(), np.uint8)[0]
        assert ((code & suffix_dedup.HOT) > 0).tolist() == marks and ((code & suffix_dedup.ASK) > 0).tolist() == [True] * 7 + [False]


def test_hashes_do_not_depend_on_place_or_length():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 200_000).astype(np.uint8)
    start = np.array([0, 5, 40_000, 70_001, 150_000])
    end = start + np.array([30, 0, 1, 65_000, 50_000])
    got = arrays.span_hashes(arrays.prefix_codes(data), start, end)
    for a, b, h in zip(start, end, got, strict=True):
        alone = data[a:b]
        assert arrays.span_hashes(arrays.prefix_codes(alone), np.array([0]), np.array([b - a]))[0] == h
    assert len(set(got.tolist())) == 5


def test_media_formats(spark):
    image = np.arange(5 * 7 * 3, dtype=np.uint8).reshape(5, 7, 3)
    ppm = media.encode_ppm(image)
    grey = b"P5 # c\n2 2\n255\n" + bytes((1, 2, 3, 4))
    stride = 24
    rows = b"".join(image[k, :, ::-1].tobytes().ljust(stride, b"\0") for k in range(4, -1, -1))

    def bitmap(width, height, rows=rows):
        return b"BM" + (54 + len(rows)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + width.to_bytes(4, "little", signed=True) + height.to_bytes(4, "little", signed=True) + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24) + rows

    bmp = bitmap(7, 5)
    assert (media.decode(ppm) == image).all() and (media.decode(bmp) == image).all() and media.decode(grey).ravel().tolist() == [1, 2, 3, 4]
    assert media.decode(b"P2\n2 1\n9\n3 4").ravel().tolist() == [3, 4] and media.decode(b"P1\n2 1\n01").ravel().tolist() == [255, 0]
    assert media.decode(b"P4\n9 1\n" + bytes((128, 128))).ravel().tolist() == [0, *[255] * 7, 0]
    resized = media.area_resize(image.astype(float), 5, 7)
    assert np.allclose(resized, image) and np.allclose(media.area_resize(image.astype(float), 1, 1).ravel(), image.reshape(-1, 3).mean(axis=0))
    assert np.allclose(media.area_resize(image.astype(float), 4, 4), area_means(image, 4))
    bad = [b"junk", None, b"P2\n2 1\n255\n300 4", b"P2\n2 1\n255\n-4 4", b"P2\n2 1\n9\n10 4", b"P5\n999999999999 9\n255\n1", b"P5\n99999999999999999999999999 9\n255\n1", b"P1\n2 1\n02", b"P5\n0 0\n255\n", bitmap(0, 5), bitmap(7, 0), bitmap(-7, 5), bitmap(7, 50), b"P6\n2 2\n255\nx", b"BM", b"P3"]
    rows = [(1, bytearray(ppm), "kept"), *((k + 2, None if x is None else bytearray(x), "kept") for k, x in enumerate(bad))]
    got = media.media_tiles(spark.createDataFrame(rows, "id int, media binary, width string")).orderBy("id").collect()
    assert (got[0].width, got[0].height) == (7, 5) and np.abs(npy(got[0].tile) - area_means(image, 32)).max() <= 0.5 + 1e-9 and got[0].dhash == plain_hash(image)
    assert all(r.width is r.height is r.tile is r.dhash is None for r in got[1:]) and len(got) == len(rows)


def holds(item, text):
    """Whether a text holds a benchmark item: the shares of shingles of the item, of its question and of its answer."""

    def shingles(w):
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    words = lambda t: WORD.findall((t or "").translate(LOWER))
    w = words(item)
    if not w:
        return False
    have = words(text)
    grams = {n: {tuple(have[i : i + n]) for i in range(len(have) - n + 1)} for n in range(1, 6)}
    near = lambda part: sum(g in grams[len(g)] for g in shingles(part)) / len(shingles(part)) if part else 1.0
    half = -(-len(w) // 2)
    return near(w) >= 0.8 and near(w[:half]) >= 0.5 and near(w[half:]) >= 0.5


def test_decontaminate(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, say(rng.randint(6, 70))) for k in range(30)] + [(30, None), (31, "")]
    texts = [say(rng.randint(0, 300)) for _ in range(60)] + ODD
    for k in range(0, 40, 2):
        texts[k] = f"{say(rng.randint(0, 150))} {items[k % 30][1].upper()} {say(rng.randint(0, 150))}"
    texts[41] = " ".join(items[29][1].split()[: len(items[29][1].split()) // 2])

    want = {(i, k) for i, t in enumerate(texts) for k, item in items if holds(item, t)}
    docs, bench = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()} == want and len(want) >= 15
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()} == set(range(len(texts))) - {i for i, _ in want}
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0 == decontaminate.find_leaks(docs.limit(0), bench).count()
    # scores do not depend on how items are dealt over passes
    scores = lambda **k: sorted(map(tuple, decontaminate.find_leaks(docs, bench, **k).collect()))
    assert scores() == scores(chunk_bytes=300)
    # rows that repeat, an item that repeats, and a text of several megabytes
    many = frame(spark, [texts[0], texts[0], f"{'word ' * 600_000}{items[4][1]}"], [1, 1, None])
    twice = bench.unionByName(bench)
    have = sorted((r.doc_id or -1, r.item_id) for r in decontaminate.find_leaks(many, twice).collect())
    assert have == sorted([(-1, 4)] + 2 * [(1, k) for i, k in want if i == 0])


def test_decontaminate_index_against_plain_bm25():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, say(rng.randint(5, 40))) for k in range(700)]
    coded = [decontaminate.item_words(t) for _, t in items]
    frequency = Counter(x for c in coded for x in set(c.view(np.int64).tolist()))
    mean = sum(map(len, coded)) / len(coded)
    known = [(k, t, list(set(c.view(np.int64).tolist())), [frequency[x] for x in set(c.view(np.int64).tolist())]) for (k, t), c in zip(items, coded, strict=True)]
    texts = [f"{say(30)} {items[k][1]} {say(50)}" for k in range(0, 700, 50)] + [say(400)]
    for index in decontaminate.build_indexes(known, len(items), mean):
        for text in texts:
            codes = decontaminate.item_words(text)
            rows = np.array([0, len(codes)])
            got = {(p, index.ids[k]): s for p, k, s in index.retrieve(codes, rows, np.array([0]))}
            want = {}
            for p in range(-(-len(codes) // index.length)):
                held = set(codes[p * index.length : (p + 2) * index.length].view(np.int64).tolist())
                for number in index.ids:
                    tf = Counter(coded[number].view(np.int64).tolist())
                    weight = {t: math.log(1 + (len(items) - frequency[t] + 0.5) / (frequency[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(coded[number]) / mean)) for t, f in tf.items()}
                    lack = int(0.2 * max(0, len(coded[number]) - 4) + 1e-9)
                    limit = sum(sorted(weight.values())[: len(weight) - lack])
                    score = sum(w for t, w in weight.items() if t in held) / limit
                    if score >= 1 - 1e-9:
                        want[p, number] = score
            assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_licenses(spark):
    texts = ["Words before.\nReleased under the MIT License.\nAnd after.", "LICENSED under the apache licence, version 2.0", "Licensed under CC BY-NC 4.0.", "Released under pressure, the license of MIT", *ODD]
    got = {(r.doc_id, r.license_id): r for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    assert got[0, "MIT"].dice == 1.0 and got[0, "MIT"].first_word == 2 and got[0, "MIT"].n_words == 5
    assert (2, "CC-BY-NC-4.0") in got and not [k for k in got if k[0] in (3, 5, 6)]
    half = licenses.TEMPLATES["BSD-3-Clause"].rpartition(" provided")
    far = f"{half[0]} {'filler ' * 120}provided{half[2]}"  # repeated words do not end a passage
    long = f"{'other words here ' * 300_000}{licenses.TEMPLATES['MIT-text']} {'and more ' * 10}"
    more = {(r.doc_id, r.license_id): r.dice for r in licenses.scan_licenses(frame(spark, [far, long, long, licenses.TEMPLATES["Zlib-text"] * 50], [1, 2, 2, None])).collect()}
    assert more[1, "BSD-3-Clause"] == pytest.approx(0.905, abs=1e-3) and more[2, "MIT-text"] == 1 and more[None, "Zlib-text"] == 1
    assert licenses.scan_licenses(frame(spark, texts).limit(0)).count() == 0
    # every passage of every text, compared in full
    sets = licenses.template_bigrams(licenses.TEMPLATES)
    for i, t in enumerate(texts):
        w = re.findall(r"[0-9a-z\u0080-￿]+", (t or "").lower())
        for name, template in licenses.TEMPLATES.items():
            m = re.findall(r"[0-9a-z]+", template.lower())
            m = set(zip(m, m[1:], strict=False))
            assert len(m) == len(sets[name])
            best = max((2 * len(s & m) / (len(s) + len(m)) for a in range(len(w)) for b in range(a + 2, len(w) + 1) if (s := set(zip(w[a : b - 1], w[a + 1 : b], strict=True)))), default=0)
            assert ((i, name) in got) == (best >= licenses.DICE) and (best < licenses.DICE or got[i, name].dice == pytest.approx(best))


def test_best_license_passage():
    rng = np.random.default_rng(5)
    for n in (3, 12, 40, 70):
        for _ in range(40):
            grams = rng.integers(0, 14, n).astype(np.uint64)
            template = np.unique(rng.integers(0, 14, 5)).astype(np.uint64)
            at = np.flatnonzero(np.isin(grams, template))
            got = licenses.best_passage(licenses.occurrences(grams), at, len(template), 0.7)
            best = max(2 * len(set(grams[a:b].tolist()) & set(template.tolist())) / (len(set(grams[a:b].tolist())) + len(template)) for a in range(n) for b in range(a + 1, n + 1))
            assert (got[0] if got else 0) == pytest.approx(best if best >= 0.7 else 0)
            if got:
                own = set(grams[got[1] : got[2] + 1].tolist())
                assert 2 * len(own & set(template.tolist())) / (len(own) + len(template)) == pytest.approx(got[0])


def test_html_text(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><ul><li><a>Menu</a></ul></nav><div class='cookie-notice'>We use</div><article><h1>Head &amp; line</h1><script>var t='</p>';</script><p>One\n two<b> three</b><p>Four&nbsp;&lt;five <div id=\"comments\"><p>bad</p></div><aside>side</aside><p>Six</p><form>f</form></article><footer>&copy; x</footer>"
    same = "<div>Welcome to our site a b c d e f g h</div><p>%s</p><div>all rights reserved by us here in this very place</div>"
    pages = [(1, "http://a.example/x", page, "t"), (2, None, None, None), (3, None, "", None)] + [(10 + k, "http://b.example/", same % f"{k}unique words here{k}", None) for k in range(4)]
    got = {r.page_id: r for r in html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string, text string")).collect()}
    assert got[1].text == "Head & line\nOne two three\nFour <five\nSix" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "" == got[3].text and got[2].n_chars == 0
    assert [got[10 + k].text for k in range(4)] == [f"{k}unique words here{k}" for k in range(4)]
    assert html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string, text string").limit(0)).count() == 0


def test_mixing(spark):
    rng = random.Random(3)
    data = [(k, " ".join("w" * rng.randint(0, 60)), "abcdef"[min(5, rng.randint(0, 9))] if k % 11 else None) for k in range(3000)]
    docs = spark.createDataFrame(data + [(5, None, "zero")], "doc_id long, text string, source string").repartition(4)
    got = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == 3001
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = [*sorted(s for s in sizes if s), "zero", None]
    sizes["zero"] = 0
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rate = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in sizes if s not in capped)
        more = {s for s in sizes if s not in capped and rate * weight[s] > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    want = {s: 3 * sizes[s] if s in capped else rate * weight[s] for s in sizes}
    source = {k: s for k, _, s in data}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        if r.source_size:
            assert r.target == pytest.approx(want[source[r.doc_id]])
            taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    counts = Counter(r.doc_id for r in got)
    assert counts[5] == 2 and got[0].asDict().keys() == {"doc_id", "size", "source_size", "target", "taken"}
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    chance = [rng.random() for _ in range(200)]
    size = [float(rng.randint(1, 9)) for _ in range(200)]
    out = mixing.fly(size, chance, random.Random(1))
    assert sum(0 < p < 1 for p in out) <= 2 and sum(out) == pytest.approx(sum(chance)) and np.dot(out, size) == pytest.approx(np.dot(chance, size))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_mixing_of_real_sources(spark, sf):
    """Every source is within its smallest documents of the target."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = mixing.mix_sources(docs).join(docs.select("doc_id", "source"), "doc_id")
    sums = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.sort_array(F.collect_list("size")).alias("sizes")).collect()
    assert sum(r.target for r in sums) == pytest.approx(sum(sum(r.sizes) for r in sums))
    for r in sums:
        if r.target < 3 * sum(r.sizes):
            assert abs(r.taken - r.target) <= max(2, next(x for x in r.sizes if x))
        else:
            assert r.taken == 3 * sum(r.sizes)


def test_mixing_of_repeated_rows(spark):
    rows = [(None, "a b c", "s")] * 3000 + [(7, "a b", "s")] * 500 + [(8, None, "t"), (9, "x " * 2_000_000, "u"), (10, "y", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)
    own = [r for r in got if r.doc_id in (None, 7)]
    assert abs(sum(r.taken for r in own) - own[0].target) <= 2


def test_landing_is_the_nearest_subset():
    rng = random.Random(4)
    for n in (1, 2, 5, 10):
        for _ in range(30):
            sizes, chance = [rng.choice((0, 1, 7, 50, 333)) for _ in range(n)], [rng.random() for _ in range(n)]
            want = sum(map(operator.mul, sizes, chance))
            out = mixing.land(sizes, chance)
            best = min(abs(sum(s for k, s in enumerate(sizes) if m >> k & 1) - round(want)) for m in range(1 << n))
            assert set(out) <= {0.0, 1.0} and abs(sum(map(operator.mul, sizes, out)) - round(want)) <= best + 1
    big = mixing.land([10**9, 3, 10**9, 5], [0.5, 0.5, 0.4, 0.5])
    assert sum(big[::2]) == 1 and set(big) == {0.0, 1.0}


def plain_features(text):
    """The classifier's features by dictionaries, from the bytes of the text."""
    kinds = lambda b: 0 if b in b" \t\n\v\f\r" else 1 if chr(b).isalpha() and b < 128 or b >= 128 else 2 if 48 <= b <= 57 else 3
    runs = [bytes(g) for k, g in itertools.groupby((text or "").encode(), kinds) if k]
    words = [r.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))) for r in runs]
    shapes = []
    for r, w in zip(runs, words, strict=True):
        capitals = sum(65 <= b <= 90 for b in r)
        kind = kinds(r[0])
        shapes.append(w if kind == 3 else (kind, 0 if not capitals else 2 if 2 * capitals > len(r) else 1, min(len(r), 3), len(r) > 8))
    families = [Counter() for _ in range(3)]
    for family, units, sizes in ((0, words, (1, 2)), (1, shapes, (1, 2)), (2, shapes, (3,))):
        for n in sizes:
            families[family].update((n, *units[k : k + n]) for k in range(len(units) - n + 1))
    return [{g: c / math.sqrt(sum(x * x for x in f.values())) for g, c in f.items()} for f in families]


def test_quality_features_against_dictionaries():
    texts = [t or "" for t in made_texts(6)[:40] + ODD] + ["One, two; THREE 123 abcdefghijk!", "...", "a" * 3_000_000]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    first, at, value = quality.features(data, offsets)
    names = {}
    for k, text in enumerate(texts):
        want = {(k, g): v for k, family in enumerate(plain_features(text)) for g, v in family.items()}
        alone_first, alone_at, alone_value = quality.features(np.frombuffer(raw[k], np.uint8), np.array([0, len(raw[k])]))
        assert alone_at.tolist() == at[first[k] : first[k + 1]].tolist() and alone_value.tolist() == value[first[k] : first[k + 1]].tolist()
        assert sorted(alone_value) == pytest.approx(sorted(want.values()), abs=1e-9) or len(alone_value) < len(want)  # hashes may meet
        names[text] = len(want)
    assert sum(names.values()) * 0.999 <= len(set(zip(np.repeat(range(len(texts)), np.diff(first)).tolist(), at.tolist(), strict=True))) + 5


def test_quality_training_against_a_plain_loop():
    rng = random.Random(2)
    rows = [(np.array([rng.randrange(8) for _ in range(5)]), np.array([rng.random() for _ in range(5)]), rng.randint(0, 1)) for _ in range(60)]
    z, n = [0.0] * 9, [0.0] * 9

    def weight(i):
        return 0.0 if abs(z[i]) <= quality.L1 else (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for epoch in range(2):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at, x, y = rows[k]
            x_of = Counter({8: 1.0})
            for i, v in zip(at.tolist(), x.tolist(), strict=True):
                x_of[i] += v
            p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x_of.items())))
            for i, v in x_of.items():
                g, w = (p - y) * v, weight(i)
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w
                n[i] += g * g
    assert quality.train(rows, bits=3, epochs=2).tolist() == pytest.approx([weight(i) for i in range(9)], rel=1e-5, abs=1e-7)


def test_quality_of_repeated_and_long_rows(spark):
    docs = frame(spark, ["good words " * 30, "!! 99 ##", "good words " * 30, "good words " * 30, "word " * 700_000, None], [1, 2, 1, 4, 5, None])
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 7), (None, 1), (5, 1), (6, 0)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels, names=("h", "s", "p")).collect()
    same = {r.s for r in got if r.doc_id in (1, 4)}
    assert len(got) == 6 and len(same) == 1 and got[0].score == "x" and all(0 <= r.s <= 1 for r in got)
    assert quality.fit_quality(docs, labels, row_bytes=1) == b"" == quality.fit_quality(docs, labels, rows=0) == quality.fit_quality(docs, labels, all_bytes=1) != quality.fit_quality(docs, labels)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and np.mean([r.predicted == r.quality for r in held]) > 0.95
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in quality.score_quality(frame(spark, ODD), labels).collect()} == {(0.5, 1)}
    assert quality.score_quality(frame(spark, ODD).limit(0), labels).count() == 0


def test_token_counts(spark):
    encoding = token_counts.encoding(open(token_counts.VOCABULARY, "rb").read())
    texts = [t for t in made_texts(4) if t] + [None, "", "long text " * 300_000, "twice", "twice"]
    lengths = [len(encoding.encode_ordinary(t or "")) for t in texts]
    histogram = token_counts.length_histogram(frame(spark, texts))
    report = token_counts.context_report(histogram)
    for r in report.collect():
        n = r.n_tokens
        assert (r.docs, r.docs_ge, r.tokens_ge) == (lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert r.truncated_total == sum(min(x, n) for x in lengths) and r.docs_share == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    assert {r.limit: r.truncated_total for r in token_counts.truncated_totals(histogram, [3, 10**6]).collect()} == {k: sum(min(x, k) for x in lengths) for k in (3, 10**6)}
    assert token_counts.quantiles(report, [0.5]).first().n_tokens == sorted(lengths)[-(-len(lengths) // 2) - 1]
    assert token_counts.context_report(token_counts.length_histogram(frame(spark, texts).limit(0))).count() == 0


def least_linked(texts, share):
    """Of each text, the first one that it is joined with by links of share hundredths."""
    sets = [shingle_set(t) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        return x if up[x] == x else find(up[x])

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(x) for x in range(len(up))]


def test_pipeline_stages(spark):
    """Each stage on its own input: scores by a plain dot product, links, repeats and leaks by brute force, the mix by its targets."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        inputs, docs = docs, stage(spark, docs, SF).persist()
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == names and set(after) <= set(before)
        seen[name] = (inputs, before, after)
    inputs, before, after = seen["quality_classifier"]
    w = np.frombuffer(quality.fit_quality(inputs, spark.read.parquet(f"{SF}/labels.parquet")), np.float32).astype(float)
    kept = set()
    for i, t in before.items():
        raw = (t or "").encode()
        _, at, x = quality.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        if w[-1] + w[at] @ x >= -1e-12:
            kept.add(i)
    assert set(after) == kept and 0 < len(kept) < len(before) and all(after[i] == before[i] for i in kept)
    _, before, after = seen["near_dedup"]
    ids = sorted(before)
    first = least_linked([before[i] for i in ids], 80)
    assert set(after) == {i for k, i in enumerate(ids) if first[k] == k} and len(after) < len(before)
    _, before, after = seen["suffix_dedup"]
    changed = 0
    for i, n, removed, _, digest in brute_cut(list(before.items())):
        assert (i in after) == (removed == 0 or removed < n)
        changed += removed > 0
        if removed == 0:
            assert after[i] == before[i]
        elif i in after and after[i].isascii():
            assert hashlib.sha256(after[i].encode()).hexdigest() == digest
    assert changed
    _, before, after = seen["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(after) == {i for i, t in before.items() if not any(holds(x, t) for x in items)}
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in mixed) == sorted(after) and mixed[0].asDict().keys() == {"doc_id", "size", "source_size", "target", "taken"}
    assert all(r.size == len(WORD.findall(after[r.doc_id] or "")) and r.taken <= 3 * r.size for r in mixed)
    source = {r.doc_id: r.source for r in docs.collect()}
    for s in set(source.values()):
        own = [r for r in mixed if source[r.doc_id] == s]
        if not own[0].source_size:
            continue
        ratio, sums = own[0].target / own[0].source_size, 1  # bit s: documents taken floor(ratio) times or once more can have s words
        for r in own:
            sums <<= r.size * math.floor(ratio + 1e-9)
            sums |= sums << r.size if ratio % 1 > 1e-9 else 0
        best = min(abs(k - own[0].target) for k, bit in enumerate(bin(sums)[:1:-1]) if bit == "1")
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(best + 1, min(r.size for r in own if r.size))
    assert docs.where(F.col("n_chars") != F.length("text")).count() == 0


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls in any column, repeated rows, a text of megabytes, and columns named as the operators' own."""
    base = " ".join(f"b{k}" for k in range(60))
    texts = [None, "", base, base, f"{base} {'x y z ' * 3}", "word " * 500_000, "!!!", base]
    ids = [None, 1, 2, 2, 3, 4, 5, None]
    names = ["doc_id", "text", "lang", "source", "n_chars", "score", "predicted", "held_out", "n_bytes", "n_removed", "kept", "kept_text", "item_id", "size", "target", "component_id"]
    schema = ", ".join(f"{c} {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in names)
    docs = spark.createDataFrame([(i, t, None, None if k % 2 else "s", None, *[f"{c}{k}" for c in names[5:]]) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], schema)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == names
        kept[name] = out.collect()
        for r in kept[name]:
            k = r.score.removeprefix("score")
            assert all(r[c] == f"{c}{k}" for c in names[5:])
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert sorted(str(r.doc_id) for r in kept["near_dedup"]) == ["1", "2", "2", "4", "5", "None", "None"]
    assert len(kept["decontamination"]) == len(texts)
    cut = {r.score: r.text for r in kept["suffix_dedup"]}
    assert cut["score2"] == cut["score3"] == base and cut["score4"].endswith("x y z x y z x y z ") and "score7" not in cut and cut["score1"] == ""
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert mix.count() == len(texts) and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("make", [made_texts, families])
def test_near_dedup_stage_by_brute_force_at_080(spark, make):
    base = [f"b{k}" for k in range(60)]
    texts = [*make(8), " ".join(base), " ".join(base[:48] + ["new"] + base[49:])]  # the last two stand at 51 / 61 = 0.836
    sets = [shingle_set(t) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        return x if up[x] == x else find(up[x])

    between = 0
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                between += 100 * len(sets[i] & sets[j]) < 85 * len(sets[i] | sets[j])
                a, b = sorted((find(i), find(j)))
                up[b] = a
    got = {r.doc_id for r in corpus_pipeline.one_of_each(spark, frame(spark, texts), SF).collect()}
    assert between and got == {i for i in range(len(up)) if find(i) == i}


def test_near_dedup_limits():
    for share in (80, 85):
        limit = near_dedup.Limit.of(share)
        assert (1 - (share / 100) ** near_dedup.LEAST_DEPTH) ** limit.trees < 1e-5
    assert near_dedup.Limit.of(85)[:2] == (85, 16) and near_dedup.Limit.of(80)[:2] == (80, 24)


def test_html_repeats_do_not_depend_on_host_size(spark):
    # one host: a menu on every page, another on five of sixty, a copied page, and a short one; each page has words of its own
    body = lambda k: " ".join(f"w{k}n{j}" for j in range(k % 12))
    section = "<div>section menu a b c d e f g h</div>"
    pages = [(k, "http://c.example/", f"<div>all pages share this very line of nine words</div>{section if k % 12 == 3 else ''}<p>{body(k)}</p>") for k in range(60)]
    pages += [(60, "http://c.example/", pages[5][2]), (61, "http://c.example/", "<p>short</p>"), (62, "http://d.example/", section), (63, None, None), (64, None, f"<article>{section}</article>{section}")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    whole = {r.page_id: r.text for r in html_text.extract_text(frame).collect()}
    assert all(whole[k] == body(k) for k in range(60)) and whole[60] == whole[5] and whole[61] == "short" and "section" in whole[62] and whole[63] == "" and whole[64].startswith("section")
    dealt = html_text.extract_text(frame, host_pages=2).collect()
    assert len(dealt) == 65 and {r.page_id: r.text for r in dealt} == whole and all(r.n_chars == len(r.text) for r in dealt)
    assert {r.page_id: r.n_boilerplate for r in dealt} == {r.page_id: r.n_boilerplate for r in html_text.extract_text(frame).collect()}


def article(page):
    return "\n".join(text for kind, text in html_text.page_blocks(page) if kind == "a")


def test_html_structure():
    page = "<article><p>Before <math><mi>x</mi><mo>=</mo><mn>2</mn></math> after</p><figure><img src='a'><figcaption>A <i>fine</i> caption</figcaption></figure><p>End</p><nav>menu</nav></article>"
    assert article(page) == "Before x=2 after\nA fine caption\nEnd"
    # what holds the article is wanted, whatever its class says
    assert article("<div class='layout has-sidebar'><article><p>one</p></article></div>") == "one" == article("<div id='page-with-menu'><article>one</article>") == article("<div class=sidebar><article>one</article></div>")
    assert article("<div class=menu>m</div><main class=comments><p>one</p><div class='comment-list'>two</div></main>") == "one"
    # words beside a mark
    assert article("<article><p class='social-science'>a</p><section class='share-price'>b</section><div class='ad-slot'>c</div><div class='share-buttons top'>d</div><p id=comments>e</p><span class='ads'>f</span></article>") == "a\nb"
    # teasers
    long = "long text " * 20
    assert article(f"<article>{long}</article><article>teaser</article><div class='related'><article>{long * 9}</article></div>") == long.strip()
    assert article("<main><p>m</p><div class=related><article>tease</article></div></main>") == "m"
    # inline elements, hidden or not, do not end a block
    assert article("<article><p>Click <button>no</button>here <b>now</b> or <a href='#'>later</a>.</p>x<select><option>1<option>2</select>y</article>") == "Click here now or later.\nxy"
    assert article("<article>one<button>two</article>") == "one" and article("<p>no mark</p>") == ""
    assert article("<ul><li>a<li>b</ul><article><table><tr><td>1<td>2<tr><td>3</table><dl><dt>t<dd>d</dl></article>") == "1\n2\n3\nt\nd"


@pytest.mark.parametrize("unit", ["<b>x ", "<div>", "</b>", "<p>x<b>", "<span class='ad'>x", "<option>", '<a "', "<li><ul>", "<button>", "<!--"])
def test_html_parser_is_linear(unit):
    def took(n):
        began = time.perf_counter()
        html_text.page_blocks(unit * (n // len(unit)))
        return time.perf_counter() - began

    took(10_000)
    assert took(1_000_000) < max(12.0, 40 * took(100_000))  # quadratic: a hundred times as long, minutes


def test_html_repeats_against_brute_force():
    rng = random.Random(7)
    words = [f"w{k}" for k in range(12)]
    for _ in range(30):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(6)]
        pages = [[(rng.choice("llc"), rng.choice(lines) if rng.random() < 0.7 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 20)))) for _ in range(rng.randint(0, 5))] for _ in range(9)]
        pages += [pages[0], [("a", "kept whole"), *pages[1]]]
        flat = [[t for _, text in p for t in [*text.split(" "), "|"]] if p[:1] != [("a", "kept whole")] else [t for _, text in p[1:] for t in [*text.split(" "), "|"]] for p in pages]
        holders = {}
        for key, stream in zip(map(tuple, pages), flat, strict=True):
            for k in range(len(stream) - 7):
                holders.setdefault(tuple(stream[k : k + 8]), set()).add(key)
        want = []
        for blocks, stream in zip(pages, flat, strict=True):
            gone = [False] * len(stream)
            for k in range(len(stream) - 7):
                if len(holders[tuple(stream[k : k + 8])]) >= 3:
                    gone[k : k + 8] = [True] * 8
            want.append(html_text.settled(blocks, np.array(gone, bool)))
        assert html_text.settled_host(pages) == want
        marked = html_text.settled_host(pages)[-1][0]
        assert marked == "kept whole"


def test_near_dedup_keeps_every_class_of_a_repeated_id(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(5, a), (5, b), (8, f"{a} more"), (9, f"{b} more"), (20, c), (21, c), (21, d), (30, f"{d} more"), (40, "other words than these here")]
    for parts in (1, 3, 7):
        got = near_dedup.near_duplicates(frame(spark, [t for _, t in rows], [i for i, _ in rows], parts)).collect()
        assert {r.doc_id: r.component_id for r in got} == {5: 5, 8: 5, 9: 5, 20: 20, 21: 20, 30: 20, 40: 40} and len(got) == len(rows)
