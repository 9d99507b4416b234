"""The stage near_dedup against Jaccard similarities of all pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from secondcart.llm import near_copies, simhash
from tests.llm import cases

STAGE = dict(corpus_pipeline.STAGES)["near_dedup"]


def shingles(text):
    words = (text or "").lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def plain_kept(rows):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    near = [(a, b) for a in range(n) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8]
    group = cases.groups(n, near)
    return [rows[k][0] for k in range(n) if group[k] == k]


@pytest.fixture(scope="module")
def rows():
    """Texts, and copies of them with 1 to 12 words replaced, some of copies of copies."""
    rng = np.random.default_rng(11)
    pool = [f"w{k}" for k in range(3000)]
    texts = [rng.choice(pool, int(rng.integers(60, 400))).tolist() for _ in range(50)]
    for _ in range(250):
        words = list(texts[int(rng.integers(len(texts)))])
        for at in rng.integers(0, len(words), int(rng.integers(1, 13))):
            words[at] = str(rng.choice(pool))
        texts.append(words)
    order = rng.permutation(len(texts))
    out = [" ".join(texts[k]) for k in order]
    out += [out[3].upper(), out[4], "", None, "two words", "Two words", "two other"]
    return list(enumerate(out))


@pytest.mark.parametrize("chunk", [near_copies.CHUNK, 2])
def test_stage_drops_what_similarity_links(spark, monkeypatch, rows, chunk):
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    expected = plain_kept(rows)
    sets = [shingles(t) for _, t in rows[:300]]
    alike = [
        (a, b) for a in range(300) for b in range(a) if 0.8 <= jaccard(sets[a], sets[b]) < 0.95
    ]
    assert len(alike) > 50 and len(expected) < 200
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = STAGE(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == expected
    # what the stage did before
    assert simhash.drop_near_copies(docs).count() > len(expected)


def test_later_bands_find_all_links(spark, monkeypatch, rows):
    """Where the first bands say nothing, the others find all links."""
    monkeypatch.setattr(near_copies, "FIRST_BANDS", 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in STAGE(spark, docs, "").collect()) == plain_kept(rows)


def test_agreeing_hashes_estimate_the_similarity(rows):
    texts = [t for _, t in rows[:300]]
    signs = near_copies.signatures(*simhash.shingle_hashes(pa.array(texts), 5))
    sets = [shingles(t) for t in texts]
    off = [
        (signs[a] == signs[b]).mean() - jaccard(sets[a], sets[b])
        for a in range(300)
        for b in range(a)
        if jaccard(sets[a], sets[b]) > 0.5
    ]
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.05


def test_links_join_what_similarity_joins(rows):
    """Without bands: all texts under one key, in one task."""
    texts = [t for _, t in rows]
    hashes, offsets = simhash.shingle_hashes(pa.array(texts), 5)
    sets = [np.unique(hashes[a:b]) for a, b in zip(offsets, offsets[1:])]
    ends = np.cumsum([0] + [len(s) for s in sets])
    for component in (np.arange(len(rows)), np.arange(len(rows)) // 3):
        links = near_copies.links_between(np.concatenate(sets), ends, component)
        assert len(links) < len(np.unique(component))
        given = [(a, a - 1) for a in range(1, len(rows)) if component[a] == component[a - 1]]
        plain = [shingles(t) for t in texts]
        near = [
            (a, b)
            for a in range(len(rows))
            for b in range(a)
            if plain[a] and jaccard(plain[a], plain[b]) >= 0.8
        ]
        assert cases.groups(len(rows), given + links) == cases.groups(len(rows), given + near)


def test_a_large_group_needs_few_rows(spark):
    """600 near copies of one text make no more links than texts in each band."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(600):
        words = list(base)
        for at in rng.integers(0, 200, 2):
            words[at] = f"x{k}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert [r.doc_id for r in STAGE(spark, docs, "").collect()] == plain_kept(rows)


def test_rows_without_own_ids(spark):
    text = " ".join(f"x{k}" for k in range(60))
    table = [(None, text), (7, text + " y"), (7, "other words"), (None, None), (8, "")]
    docs = spark.createDataFrame(table, "doc_id long, text string").coalesce(1)
    kept = [r.text for r in STAGE(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([text, "other words", None], key=str)


def test_simhash_brings_texts_together(spark, monkeypatch):
    """Near copies within four bits are found where no MinHash band says anything."""
    rng = np.random.default_rng(5)
    base = [[f"w{k}" for k in rng.integers(0, 3000, 8000)] for _ in range(4)]
    rows = []
    for k in range(40):
        words = list(base[k % 4])
        words[1000 + k] = f"x{k}"
        rows.append((k, " ".join(words)))
    marks = simhash.fold(*simhash.shingle_hashes(pa.array([t for _, t in rows])))
    far = [bin(int(marks[k] ^ marks[k % 4])).count("1") for k in range(40)]
    assert max(far) <= simhash.RADIUS and max(far) > 0

    def own_keys(signs):
        return np.random.default_rng().integers(0, 1 << 63, (len(signs), 25)).astype(np.uint64)

    monkeypatch.setattr(near_copies, "band_keys", own_keys)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in STAGE(spark, docs, "").collect()) == [0, 1, 2, 3]


@pytest.mark.parametrize("chunk", [near_copies.CHUNK, 2])
def test_equal_fingerprints_are_compared_exactly(spark, monkeypatch, rows, chunk):
    """Texts that are far apart stay, even if all have the same fingerprint."""
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    monkeypatch.setattr(near_copies, "fold", lambda h, o: np.zeros(len(o) - 1, np.uint64))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(r.doc_id for r in STAGE(spark, docs, "").collect()) == plain_kept(rows)


def test_a_cut_group_of_fingerprints_is_compared_whole(spark, monkeypatch):
    """Texts that share nothing but their fingerprint link over all chunks, not only inside one."""
    monkeypatch.setattr(near_copies, "CHUNK", 2)
    text = " ".join(f"w{k}" for k in range(30))
    marks = spark.createDataFrame(
        [(k, 26, 7, [100 + k]) for k in range(12)], "node long, size long, fp long, keys array<long>"
    )
    texts = spark.createDataFrame([(k, text) for k in range(12)], "id long, text string")
    found = near_copies.near_components(marks, texts).collect()
    assert sorted((r["node"], r["component"]) for r in found) == [(k, 0) for k in range(1, 12)]
