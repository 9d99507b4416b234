"""Log counts of hashed words against a plain computation."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from itertools import pairwise

from secondcart.operators.log_ratio import BUCKETS, PAIR_FACTOR, SCALE, log_ratio_scores

SCHEMA = "review_id long, text string, label int, fold int, g0 string"


def grams(text: str) -> Counter:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = [w for w in re.split(r"[\x09-\x0D ]+", lower) if w]
    found = [int(hashlib.md5(w.encode()).hexdigest()[:4], 16) for w in words]
    return Counter(found + [(a * PAIR_FACTOR + b) % BUCKETS for a, b in pairwise(found)])


def log(a: int, b: int) -> int:
    return math.floor(math.log(a / b) * SCALE)


def plain_scores(rows):
    out = {}
    for key, text, _, fold, _ in rows:
        rest = [(grams(t), c) for _, t, c, f, _ in rows if f != fold and c is not None]
        n_docs = sum(1 for r in rest)
        scores = []
        for c in range(3):
            counts = sum((g for g, k in rest if k == c), Counter())
            score = log(sum(k == c for _, k in rest) + 1, n_docs + 3)
            for b, n in grams(text).items():
                score += n * log(counts[b] + 1, counts.total() + BUCKETS)
            scores.append(score)
        out[key] = (*scores, scores.index(max(scores)))
    return out


def made_rows():
    moods = [["late", "broken", "never came"], ["fine", "so so"], ["good", "Great", "very good"]]
    rows = []
    for k in range(60):
        words = moods[k % 3]
        text = f"{words[k % len(words)]} item\n{words[(k * 7) % len(words)]}  ÀB ção {'x' * (k % 4)}"
        rows.append((k, text, k % 3, (k // 3) % 4, "clash"))
    rows.append((60, " ", 1, 0, "clash"))
    rows.append((61, "word " * 20_000, 2, 1, "clash"))
    rows.append((62, "good good good", None, 2, "clash"))
    rows.append((63, " ", 0, 3, "clash"))
    return rows


def test_scores_as_computed_plainly(spark):
    rows = made_rows()
    found = log_ratio_scores(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    expected = plain_scores(rows)
    for r in found:
        assert (r.score_neg, r.score_neu, r.score_pos, r.prediction) == expected[r.review_id]
        assert abs(r.prob_neg + r.prob_neu + r.prob_pos - 1) < 1e-12
    right = sum(r.prediction == r.label for r in found)
    assert right > 0.9 * len(found)


def test_empty_table_and_no_python(spark):
    empty = log_ratio_scores(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and "prob_pos" in empty.columns
    plan = empty._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
