"""Resampling, repeated byte strings and centroids, against plain versions and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from secondcart.llm import column_bwt, ptolemy, resample
from tests.llm import cases

BY_ID = {"clean": cases.text_rows(), "dirty": cases.dirty_rows()}
FEATURE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bag(rows):
    return Counter(map(tuple, rows))


@pytest.fixture(scope="module", params=list(BY_ID))
def table(request, spark):
    rows = BY_ID[request.param]
    return rows, cases.docs(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return cases.docs(spark, cases.text_rows()).limit(0)


# --- op11 ------------------------------------------------------------------------------------


def plain_buckets(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = FEATURE_WORD.findall(lower)
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def plain_ranks(rows, target):
    """(doc_id, n_features, weight, score) of all rows and the drawn ones in order."""
    source, wanted = Counter(), Counter()
    own = [(i, *plain_buckets(t)) for i, t in rows]
    for _, _, b in own:
        source.update(b)
    for t in target:
        wanted.update(plain_buckets(t)[1])
    s, t = sum(source.values()), sum(wanted.values())
    gain = [
        math.floor(
            1000 * math.log((wanted[b] + 1) * float(s + 10000) / ((source[b] + 1) * float(t + 10000)))
        )
        for b in range(10000)
    ]
    out = []
    for i, n, b in own:
        name = "" if i is None else i
        h = int(hashlib.sha256(f"42:{name}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        weight = sum(gain[x] for x in b)
        out.append((n, i, len(b), weight, weight + noise))
    able = sorted(
        (r for r in out if r[0] >= 20), key=lambda r: (-r[4], math.inf if r[1] is None else r[1])
    )
    return [r[1:] for r in out], [r[1:] for r in able[: 5 * len(able) // 100]]


TARGET = ["one two words and RANE lone xou", None, "", "Mine, téx. 7 rast"]


def benchmark(spark, texts):
    rows = [(k, t, "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "item_id long, text string, b string").toDF(
        "item_id", "text", "Text"
    )


def many(rows):
    """Copies under further ids, so that some are drawn."""
    return rows + [(1000 + k, f"{k % 40} " + (rows[5 + k % 4][1] or "")) for k in range(90)]


@pytest.mark.parametrize("name", list(BY_ID))
def test_op11(spark, name):
    rows = many(BY_ID[name])
    every, drawn = plain_ranks(rows, TARGET)
    assert len(drawn) >= 4
    docs = cases.docs(spark, rows)
    got = resample.importance_ranks(docs, benchmark(spark, TARGET)).collect()
    assert bag(r[:4] for r in got) == bag(every)
    ranks = sorted((r.rank, *r[:4]) for r in got if r["rank"] is not None)
    assert ranks == [(k + 1, *r) for k, r in enumerate(drawn)]
    texts = resample.resample(docs, benchmark(spark, TARGET))
    assert texts.columns == docs.columns and texts.count() == len(drawn)


def test_op11_equal_rows_and_ids_are_ranked_each(spark):
    text = " ".join(f"w{k}" for k in range(25))
    docs = spark.createDataFrame([(None, text)] * 60 + [(7, text)] * 40, "doc_id long, text string")
    got = resample.importance_ranks(docs, benchmark(spark, [])).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5]


def test_op11_long_text_and_long_word(spark):
    rows = [(1, "x" * 3_000_000 + " end"), (2, "a b " * 300_000), (3, "\x00é\x7f日 本")]
    every, _ = plain_ranks(rows, ["a b"])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = resample.importance_ranks(docs, benchmark(spark, ["a b"])).collect()
    assert bag(r[:4] for r in got) == bag(every)


def test_op11_empty(spark, empty):
    assert resample.importance_ranks(empty, benchmark(spark, TARGET)).collect() == []
    assert resample.resample(empty, benchmark(spark, [])).collect() == []


# --- op12 ------------------------------------------------------------------------------------


def plain_bytes(rows, window=50):
    texts = [(math.inf if i is None else i, (t or "").encode()) for i, t in rows]
    least: dict[bytes, float] = {}
    for i, b in texts:
        for k in range(len(b) - window + 1):
            w = b[k : k + window]
            least[w] = min(least.get(w, math.inf), i)
    out = []
    for (i, b), (doc_id, _) in zip(texts, rows, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if least[b[k : k + window]] < i:
                gone[k : k + window] = b"\x01" * window
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = len(re.findall(b"\x01+", bytes(gone)))
        out.append((doc_id, len(b), len(b) - len(kept), runs, kept))
    return out


def with_digest(rows):
    return bag((i, n, r, s, hashlib.sha256(k).hexdigest(), k) for i, n, r, s, k in rows)


def got_bytes(df):
    return bag((*r[:5], bytes(r.kept)) for r in df.collect())


@pytest.mark.parametrize("hot, wide", [(column_bwt.HOT, column_bwt.WIDE), (2, 50), (1, 1)])
def test_op12(table, hot, wide):
    rows, docs = table
    expected = plain_bytes(rows)
    assert sum(r[2] for r in expected) > 1000
    assert got_bytes(column_bwt.remove_repeated_bytes(docs, hot=hot, wide=wide)) == with_digest(expected)


@pytest.mark.parametrize("seed", range(3))
def test_op12_small_alphabets(spark, seed):
    """Texts that repeat inside themselves and each other, with a short window."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab é") for _ in range(rng.randrange(5, 40))) for _ in range(6)]
    rows = [
        (rng.randrange(40), "".join(rng.choice(pool) for _ in range(rng.randrange(8))))
        for _ in range(60)
    ]
    rows += [(k, "periodic " * 20) for k in (50, 51)] + [(60, "z" * 200), (61, "z" * 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for options in ({}, {"hot": 0, "wide": 4}):
        got = column_bwt.remove_repeated_bytes(docs, window=12, gram=5, **options)
        assert got_bytes(got) == with_digest(plain_bytes(rows, 12))


def test_op12_very_many_copies(spark):
    passage = "the same passage of more than fifty bytes in every one of these texts, "
    rows = [(k, f"{k * 7919} " + passage + f"{k}") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_bytes(column_bwt.remove_repeated_bytes(docs)) == with_digest(plain_bytes(rows))


def test_op12_empty(empty):
    assert column_bwt.remove_repeated_bytes(empty).collect() == []


def test_columns_in_files(tmp_path):
    """The transform, suffix by suffix, with all sequences in files."""
    rng = random.Random(3)
    for _ in range(20):
        strings = [
            bytes(rng.choice(b"abc") for _ in range(rng.randrange(5, 20)))
            for _ in range(rng.randrange(1, 12))
        ]
        lengths = np.array([len(s) for s in strings])
        starts = np.cumsum(lengths) - lengths
        files = column_bwt.ColumnFiles(str(tmp_path / "columns"), 0)
        text = np.frombuffer(b"".join(strings), np.uint8)
        suffixes, common = column_bwt.column_transform(text, starts, lengths, files)
        in_order = sorted(
            (s[i:], k, int(starts[k]) + i) for k, s in enumerate(strings) for i in range(len(s) + 1)
        )
        assert suffixes.tolist() == [x[2] for x in in_order]
        shared = [0]
        for (a, *_), (b, *_) in zip(in_order, in_order[1:]):
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            shared.append(n)
        assert common.tolist() == shared
        assert list((tmp_path / "columns").iterdir()) != []
        files.close()
        assert list((tmp_path / "columns").iterdir()) == []


# --- op13 ------------------------------------------------------------------------------------


def plain_clusters(rows, k=8, rounds=10):
    """One result row per kept vector."""
    kept = [
        (i, [math.floor(1024 * float(x)) for x in v])
        for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = lambda i: "" if i is None else i
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{name(r[0])}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in first[:k]]
    for at in range(rounds + 1):
        near = []
        for _, v in kept:
            d = [sum((x - y) ** 2 for x, y in zip(v, c, strict=True)) for c in centres]
            near.append((d.index(min(d)), min(d)))
        if at == rounds:
            break
        for j in range(len(centres)):
            own = [v for (_, v), (c, _) in zip(kept, near, strict=True) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    inertia = Counter()
    for c, d in near:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [
        (i, c, d, inertia[c], sum(inertia.values()), digest[c])
        for (i, _), (c, d) in zip(kept, near, strict=True)
    ]


def vectors(spark, rows):
    table = [(i, v, 1, [0.5]) for i, v in rows]
    schema = "vec_id long, embedding array<double>, a int, b array<double>"
    return spark.createDataFrame(table, schema).repartition(3).toDF(
        "vec_id", "embedding", "cluster", "Embedding"
    )


def vector_rows():
    rng = np.random.default_rng(9)
    middle = rng.normal(size=(5, 64))
    rows = [(k, (middle[k % 5] + rng.normal(size=64) * 0.4).tolist()) for k in range(150)]
    rows += [(200 + k, rows[3][1]) for k in range(40)] + [(7, rows[9][1]), (None, rows[2][1])]
    odd = list(rows[0][1])
    rows += [(300, None), (301, []), (302, odd[:63]), (303, odd + [1.0]), (304, [None, *odd[1:]])]
    rows += [(305, [math.nan, *odd[1:]]), (306, [math.inf, *odd[1:]]), (307, [0.0] * 64)]
    return rows


def test_op13(spark):
    rows = vector_rows()
    got = ptolemy.cluster_vectors(vectors(spark, rows))
    assert bag(r[:6] for r in got.collect()) == bag(plain_clusters(rows))


def test_op13_ties_go_to_the_smaller_number(spark):
    """Few different points, so that centres coincide and distances are equal."""
    rows = [(k, [float(k % 3)] + [0.0] * 63) for k in range(40)]
    got = ptolemy.cluster_vectors(vectors(spark, rows))
    assert bag(r[:6] for r in got.collect()) == bag(plain_clusters(rows))


@pytest.mark.parametrize("n", [0, 1, 5])
def test_op13_few_vectors(spark, n):
    rows = vector_rows()[:n]
    got = ptolemy.cluster_vectors(vectors(spark, rows + [(9, None)]))
    assert bag(r[:6] for r in got.collect()) == bag(plain_clusters(rows) if n else [])


def test_op13_too_large_components_are_refused(spark):
    with pytest.raises(ValueError):
        ptolemy.cluster_vectors(vectors(spark, [(1, [1e300] * 64)]))


def test_bounds_never_exceed_the_distance_and_spare_work():
    rng = np.random.default_rng(2)
    middle = rng.integers(-3000, 3000, (8, 64))
    points = middle[rng.integers(0, 8, 2000)] + rng.integers(-300, 300, (2000, 64))
    points = np.concatenate([points, middle, points[:50]])
    pivots = points[:6]
    bounds = ptolemy.Bounds(middle, pivots)
    cached = ptolemy.to_pivots(points, pivots)
    exact = np.stack([ptolemy.exact_distances(points, c) for c in middle], axis=1)
    assert (bounds.squared(cached) <= exact).all()
    cluster, distance, measured = bounds.nearest(points, cached)
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert measured < 0.6 * exact.size
    # Huge values, whose squares do not fit a double.
    large = points * 40_000
    far = ptolemy.Bounds(middle * 40_000, large[:6])
    assert (far.squared(ptolemy.to_pivots(large, large[:6])) <= exact * 1_600_000_000).all()
