"""The pipeline as a whole, against a plain version of all its stages."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from secondcart.llm import fertility, hilbert_pack, mixing
from secondcart.llm.queries import QUERIES, second_vocabulary, vocabulary
from tests.llm import cases
from tests.llm.test_near_copies import jaccard, shingles


def plain_quality(text, lang):
    """The verdict on one text alone, so that nothing leaks between the texts of a batch."""
    m = fertility.measure(
        pa.array([text], pa.string()), vocabulary("piece_bpe_32k.model"), second_vocabulary()
    )
    counts = cases.rule_counts(text)
    if counts["n_words"] < 50 or 100 * counts["n_repeat_words"] > 50 * counts["n_words"]:
        return False
    return not fertility.outside_band(m, [lang], fertility.BANDS)[0]


def plain_copies(doc_id, rate):
    count = 0
    draws = max(1, math.ceil(rate / mixing.MEAN_PER_DRAW))
    for j in range(1, draws + 1):
        u = int(hashlib.md5(f"42|mix|{doc_id}|{j}".encode()).hexdigest()[:15], 16) / (1 << 60)
        p = cdf = math.exp(-rate / draws)
        k = 0
        while cdf <= u:
            k += 1
            p *= rate / draws / k
            cdf += p
            count += 1
    return count


def plain_pipeline(rows):
    """(doc_id, text) of every copy that reaches the last stage."""
    rows = [r for r in rows if plain_quality(r[1], r[2])]
    kept = {}
    for r in sorted(rows):
        kept.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r)
    rows = sorted(kept.values())
    sets = [shingles(r[1]) for r in rows]
    n = len(rows)
    near = [(a, b) for a in range(n) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8]
    group = cases.groups(n, near)
    rows = [r for k, r in enumerate(rows) if group[k] == k]
    sizes = Counter(r[3] for r in rows)
    weight = {s: math.sqrt(c) for s, c in sizes.items()}
    out = []
    for r in rows:
        share = weight[r[3]] / sum(weight.values())
        out += [r] * plain_copies(r[0], share * len(rows) / sizes[r[3]])
    return out


def documents(spark, path, n=120):
    rng = np.random.default_rng(5)
    pool = [f"{a}{b}{c}" for a in ("ra", "lo", "mi", "te") for b in ("ne", "st", "x") for c in "aeo"]
    rows = []
    for i in range(n):
        words = rng.choice(pool, int(rng.integers(20, 120))).tolist()
        kind = i % 6
        if kind == 1 and rows:
            text = rows[-1][1].replace(" ", "  ", 2)
        elif kind == 2 and rows:
            near = rows[-1][1].split()
            near[-1] = "changed"
            text = " ".join(near)
        elif kind == 3:
            text = " ".join(words[:5] * 20)
        else:
            text = " ".join(words)
        rows.append((i, text, "en", "hot" if i % 3 else f"s{i % 5}"))
    rows += [(n, None, "en", "s0"), (n + 1, "", None, None)]
    table = [(*r, len(r[1] or "")) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(table, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    return rows


def test_pipeline(spark, tmp_path):
    rows = documents(spark, tmp_path)
    expected = plain_pipeline(rows)
    assert 20 < len({r[0] for r in expected}) < 80
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    plain = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    raw = {
        i: np.array(plain.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes()
        for i, t, *_ in expected
    }
    got = Counter(p.doc_id for p in pieces if p.start == 0)
    assert got == Counter(r[0] for r in expected)
    for p in pieces:
        part = raw[p.doc_id][4 * p.start : 4 * (p.start + p.length)]
        assert zlib.crc32(part) == p.ids_crc32 and len(raw[p.doc_id]) == 4 * p.doc_tokens
    assert sum(p.length for p in pieces) == sum(len(raw[r[0]]) // 4 for r in expected)


def test_stages_pass_on_the_columns(spark, tmp_path):
    documents(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def test_an_empty_table_passes(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stretches_are_even():
    assert hilbert_pack.even_stretches([1, 1, 1, 1, 8, 1, 1, 1, 1], 4) == (
        [0, 4, 12],
        [0, 0, 0, 0, 1, 2, 2, 2, 2],
    )
    assert hilbert_pack.even_stretches([0], 4) == ([0], [0])


def test_every_operator_has_a_query():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{k}" for k in range(1, 14)]
