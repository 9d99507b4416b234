"""Single pieces of the operators, against plain versions."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from secondcart.llm import fm_index, hilbert_pack, html_text, records, simhash, url_filter
from secondcart.llm.common import sums, words
from secondcart.llm.queries import vocabulary
from secondcart.llm.tokens import WordTokenizer
from tests.llm import cases


def test_words_and_sums():
    flat, offsets = words(pa.array([" a  b", None, "", "\x0b\x0cc\n"]))
    assert flat.to_pylist() == ["a", "b", "c"]
    assert offsets.tolist() == [0, 2, 2, 2, 3]
    assert sums(np.array([5, 6, 7]), offsets).tolist() == [11, 0, 0, 7]


def test_ids_equal_the_librarys():
    path = vocabulary("word_bpe_49k.json")
    odd = [
        "It's <|endoftext|> he'LL ΣΑΣ é x́ ́a ﬁ ½ m² ªº µ a\x85b 12'3 don''t _a_b' "
        "x<|startoftext|>y ÿß×÷ \x00\x01\x1c a b",
        *(t for _, t in cases.text_rows()),
    ]
    tokenizer, plain = WordTokenizer(path), Tokenizer.from_file(path)
    for _ in range(2):  # from the library, then from memory
        ids, offsets = tokenizer.encode(pa.array(odd))
        for i, text in enumerate(odd):
            expected = plain.encode(text or "", add_special_tokens=False).ids
            assert ids[offsets[i] : offsets[i + 1]].tolist() == expected


def test_ids_without_room_to_remember(monkeypatch):
    from secondcart.llm import tokens

    monkeypatch.setattr(tokens, "KEPT_PIECES", 3)
    path = vocabulary("word_bpe_49k.json")
    tokenizer, plain = WordTokenizer(path), Tokenizer.from_file(path)
    for text in ("some words here", "here are other words", "some words"):
        ids, _ = tokenizer.encode(pa.array([text]))
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_shard_search(seed):
    rng, window = random.Random(seed), 8
    base = [rng.choice("abcd") for _ in range(200)]
    texts = set()
    for _ in range(60):
        a, n = rng.randint(0, 150), rng.randint(1, 10)
        t = base[a : a + n + window - 1]
        if rng.random() < 0.5:
            t[rng.randrange(len(t))] = rng.choice("abcdz")
        texts.add(" ".join(t))
    texts = sorted(texts)
    copies = np.array([rng.choice([1, 1, 1, 2]) for _ in texts])
    n_windows = np.array([len(t.split()) - window + 1 for t in texts])
    found = fm_index.search_shard(pa.array(texts), copies, n_windows, window)
    seen = Counter()
    for t, c in zip(texts, copies, strict=True):
        w = t.split()
        for j in range(len(w) - window + 1):
            seen[tuple(w[j : j + window])] += c
    for t, bits in zip(texts, found, strict=True):
        w = t.split()
        expected = [seen[tuple(w[j : j + window])] > 1 for j in range(len(w) - window + 1)]
        assert [bool(bits >> j & 1) for j in range(len(expected))] == expected


def test_wavelet_rank():
    rng = np.random.default_rng(0)
    symbols = rng.integers(0, 37, 1000)
    tree = fm_index.WaveletMatrix(symbols, 37)
    for _ in range(50):
        c, at = int(rng.integers(0, 37)), int(rng.integers(0, 1001))
        got = tree.rank(np.array([c]), np.array([at]))[0]
        assert got == (symbols[:at] == c).sum()


@pytest.mark.parametrize("seed", range(5))
def test_bit_sliced_links(seed):
    rng = np.random.default_rng(seed)
    fps = []
    for base in rng.integers(0, 1 << 62, 30):
        for _ in range(rng.integers(1, 25)):
            x = int(base)
            for _ in range(rng.integers(0, 7)):
                x ^= 1 << int(rng.integers(0, 64))
            fps.append(x)
    fps = np.array(list(dict.fromkeys(fps)), np.uint64)
    rng.shuffle(fps)
    n = len(fps)
    group = np.sort(rng.integers(0, 3, n))
    side = np.where(group == 1, rng.integers(1, 3, n), 0)
    linked = [
        (i, j)
        for i in range(n)
        for j in range(i + 1, n)
        if group[i] == group[j]
        and (side[i] == 0 or side[i] != side[j])
        and int(fps[i] ^ fps[j]).bit_count() <= 4
    ]
    at = {int(x): i for i, x in enumerate(fps)}
    a, b = simhash.links_in(fps, group, side)
    found = [(at[int(x)], at[int(y)]) for x, y in zip(a, b, strict=True)]
    assert cases.groups(n, found) == cases.groups(n, linked)


def test_keys_miss_no_link():
    rng = random.Random(0)
    for n in (10, 10**6, 10**9, 10**12):
        masks = simhash.key_masks(simhash.blocks_for(n))
        for _ in range(200):
            change = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(change & m == 0 for m in masks)
    assert simhash.blocks_for(1000) < simhash.blocks_for(10**9)


def test_hilbert_curve_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = hilbert_pack.hilbert_key(grid, 3)
    assert sorted(keys) == list(range(512))
    steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_record_checksums():
    import io

    framed = records.frame(b"payload")
    assert records.read_record(io.BytesIO(framed), "x") == b"payload"
    assert records.read_record(io.BytesIO(b""), "x") is None
    for at in range(len(framed)):
        wrong = bytearray(framed)
        wrong[at] ^= 1
        with pytest.raises(ValueError):
            records.read_record(io.BytesIO(bytes(wrong)), "x")
    with pytest.raises(ValueError):
        records.read_record(io.BytesIO(framed[:-1]), "x")


PAGE = """<!DOCTYPE html><html><head><title>No</title><script>var t="</p>x";</script></head><body>
<nav><ul><li><a href=/a>Menu</a></ul></nav><!-- <p>not this</p> --><div class="ad">Buy</div>
<div class='cookie-notice'>We use cookies</div><form><label>Name</label><input></form>
<article><h1>Title &amp; more</h1><p>First  <b>bo</b>ld<br>line &lt;x&gt;&nbsp;1 &lt 2</p>
<aside>Side</aside><p>To.<p>Last<div class=sharing>Share</div>
<section id="comments"><p>A reader says</p></section></article>
<p class="widget">out</p><footer>&copy; foot</footer>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE) == "Title & more First bold line <x> 1 < 2 To. Last"
    assert html_text.main_text(None) == html_text.main_text("") == ""
    assert html_text.main_text("<p></p><!-- open") == ""
    assert html_text.main_text("just text < here") == "just text < here"


def test_main_text_without_an_article_element():
    links = "".join(f"<li><a href=/{i}>Some link number {i}</a></li>" for i in range(30))
    prose = ["This is a sentence of the body that is long enough to be read." * 2] * 6
    body = "".join(f"<p>{p}</p>" for p in prose)
    page = f"<body><ul>{links}</ul><div></div>{body}<ul>{links}</ul></body>"
    assert html_text.main_text(page) == " ".join(prose)


def test_deep_pages_take_linear_time():
    page = "<div>" * 50_000 + "deep" + "</span>" * 50_000 + "<!-- " * 10_000
    assert html_text.main_text(page) == "deep"


def test_best_split():
    total = 1e6
    known = {"cheap": 500, "pills": 300, "pill": 100, "s": 1000, "he": 5000, "a": 9000}
    token = "cheappillsqzx"
    found = {
        (a, b - a): float(np.log(known[token[a:b]] / total))
        for a in range(len(token))
        for b in range(a + 1, len(token) + 1)
        if token[a:b] in known
    }
    assert url_filter.best_split(token, found, total) == ["cheap", "pills", "qzx"]
    assert url_filter.best_split("zzz", {}, total) == ["zzz"]
