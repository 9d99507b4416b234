"""Repeated passages: FM-indexes over wavelet trees, one per shard of the corpus.

Every window of words belongs to the shard of its smallest k-gram hash, so equal windows meet in
one shard whichever documents they come from. Neighbouring windows with the same smallest k-gram
form one fragment of text. A shard indexes its fragments and streams them against the index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondcart.llm.common import (
    codes,
    exact_columns,
    joined,
    offsets_of,
    text_slices,
    words,
)
from secondcart.llm.rows import ROW, identified
from secondcart.operators.joins import lookup_by_hot_key
from secondcart.sources.writers import materialize

WINDOW = 35
GRAM = 16
# Words in one index; fragments with one smallest k-gram are never divided between indexes.
INDEX_WORDS = 1_500_000
# A k-gram with more different fragments than this is taken apart into single windows, which are
# grouped by their whole text.
HOT_FRAGMENTS = 20_000
BASE = 0x9E3779B97F4A7C15


# --- the index -------------------------------------------------------------------------------


class WaveletMatrix:
    """Symbols as one packed bit vector per bit of their code, most significant first."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bits = ((symbols >> level) & 1).astype(np.uint8)
            packed = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
            part = np.packbits(bits, bitorder="little")
            packed[: len(part)] = part
            packed = packed.view("<u8")
            counts = np.bitwise_count(packed).astype(np.int32)
            self.words.append(packed)
            self.before.append(np.cumsum(counts, dtype=np.int32) - counts)
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        every = np.arange(n_symbols)
        self.base = self._descend(every, np.zeros(n_symbols, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for depth in range(self.levels):
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            mask = (np.uint64(1) << bit) - np.uint64(1)
            ones = self.before[depth][word] + np.bitwise_count(self.words[depth][word] & mask)
            high = (symbol >> (self.levels - 1 - depth)) & 1
            at = np.where(high, self.zeros[depth] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._descend(symbol, at) - self.base[symbol]


class FMIndex:
    """Index of a text of word codes (0 ends a fragment) for patterns of up to ``length`` words.

    Suffixes are sorted by their first words only, a power of two that is at least ``length``,
    which is all that patterns of that length can tell apart. ``weights`` counts the copies that
    each position of the text stands for.
    """

    def __init__(self, text: np.ndarray, weights: np.ndarray, length: int):
        n = len(text)
        self.length = length
        ranks = {1: text.astype(np.int64)}
        k, order = 1, np.argsort(text, kind="stable")
        while k < length:
            later = np.zeros(n, np.int64)
            later[: max(0, n - k)] = ranks[k][k:] + 1
            key = ranks[k] * (int(later.max()) + 1) + later
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            k *= 2
            ranks[k] = new
        n_symbols = int(text.max()) + 1
        self.symbols_before = np.concatenate(
            [[0], np.cumsum(np.bincount(text, minlength=n_symbols))]
        )
        self.tree = WaveletMatrix(text[order - 1], n_symbols)
        self.weight_before = offsets_of(weights[order])
        # Where, in suffix order, the first ``length - 1`` words change: cutting a match at its
        # right end by one word widens its interval to the borders of this group.
        change = np.zeros(n, bool)
        change[0] = True
        at, left = order.copy(), length - 1
        while left:
            part = 1 << (left.bit_length() - 1)
            inside = at < n
            rank = np.where(inside, ranks[part][np.minimum(at, n - 1)], -1)
            change[1:] |= np.diff(rank) != 0
            at, left = at + part, left - part
        starts = np.flatnonzero(change)
        group = np.cumsum(change) - 1
        self.group_start = starts[group]
        self.group_end = np.append(starts[1:], n)[group]

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray):
        """Backward search: intervals of the matches with one more word in front."""
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        first = self.symbols_before[symbol]
        return first + both[: len(low)], first + both[len(low) :]

    def repeated(self, text: np.ndarray, starts: np.ndarray, n_windows: np.ndarray) -> np.ndarray:
        """Bit j of a fragment's result: its window j stands for two or more places.

        All fragments are streamed at once from their right ends. The matching statistic of a
        place is cut off at the threshold: a match of ``length`` words is reported if its
        interval holds two or more, and is then cut to ``length - 1`` words for the next place.
        Each fragment is in the index itself, so no match is ever empty.
        """
        out = np.zeros(len(starts), np.int64)
        low = np.zeros(len(starts), np.int64)
        high = np.full(len(starts), len(self.group_start), np.int64)
        last = starts + n_windows + self.length - 2
        for k in range(self.length - 1):
            low, high = self.extend(low, high, text[last - k])
        for k in range(int(n_windows.max(initial=0))):
            live = np.flatnonzero(n_windows > k)
            window = n_windows[live] - 1 - k
            lo, hi = self.extend(low[live], high[live], text[starts[live] + window])
            many = self.weight_before[hi] - self.weight_before[lo] >= 2
            out[live] |= np.where(many, np.int64(1) << window, 0)
            low[live], high[live] = self.group_start[lo], self.group_end[lo]
        return out


# --- fragments -------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(distinct: pa.Array) -> np.ndarray:
    from xxhash import xxh64_intdigest

    some = joined(distinct).split(" ")
    return np.fromiter(map(xxh64_intdigest, some), np.uint64, len(some))


def fragments_of(
    hashes: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM
) -> tuple[np.ndarray, ...]:
    """Fragments of consecutive documents, given all their words' hashes.

    Returns owner, first word (within the owner), number of windows, and smallest k-gram hash. A
    fragment's windows share the place of their leftmost smallest k-gram, so it has at most
    ``window - gram + 1`` of them.
    """
    n = len(hashes)
    empty = np.zeros(0, np.int64)
    if n < window:
        return empty, empty, empty, empty
    grams, size, step = hashes, 1, BASE
    while size < gram:
        grams = grams[:-size] * np.uint64(step) + grams[size:]
        step, size = step * step % (1 << 64), size * 2
    value = _mixed(grams)
    place = np.arange(len(value))
    span, width = window - gram + 1, 1
    while width < span:
        shift = min(width, span - width)
        later = value[shift:] < value[:-shift]
        place = np.where(later, place[shift:], place[:-shift])
        value = np.where(later, value[shift:], value[:-shift])
        width += shift
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = owner[: len(value)] == owner[window - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return empty, empty, empty, empty
    own, where = owner[at], place[at]
    cut = np.concatenate([[True], (np.diff(own) != 0) | (np.diff(where) != 0)])
    first = np.flatnonzero(cut)
    count = np.diff(np.append(first, len(at)))
    start = at[first] - offsets[own[first]]
    return own[first], start, count, value[at][first].view(np.int64)


def _anchors(batches, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        flat, offsets = words(batch.column("text"))
        if len(flat) < window:
            continue
        distinct, index = codes(flat)
        own, start, count, key = fragments_of(word_hashes(distinct)[index], offsets, window, gram)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(ROW).take(pa.array(own)),
                pa.array(start, pa.int32()),
                pa.array(count, pa.int32()),
                pa.array(key),
            ],
            names=[ROW, "start", "windows", "key"],
        )


def _fragment_texts(batches, window: int) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        flat, offsets = words(batch.column("text"))
        lengths = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        line = joined(flat).encode()
        spans = batch.column("spans")
        inner = spans.flatten()
        owner = np.repeat(
            np.arange(batch.num_rows), np.diff(spans.offsets.to_numpy().astype(np.int64))
        )
        start = inner.field("start").to_numpy().astype(np.int64)
        count = inner.field("windows").to_numpy().astype(np.int64)
        first = offsets[owner] + start
        a, b = starts[first].tolist(), ends[first + count + window - 2].tolist()
        texts = [line[x:y] for x, y in zip(a, b, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(ROW).take(pa.array(owner)),
                pa.array(start, pa.int32()),
                inner.field("windows"),
                inner.field("key"),
                pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()),
                pa.array(texts, pa.binary()).cast(pa.string()),
            ],
            names=[ROW, "start", "windows", "key", "fragment", "text"],
        )


# --- shards ----------------------------------------------------------------------------------


def search_shard(
    texts: pa.Array, copies: np.ndarray, n_windows: np.ndarray, window: int
) -> np.ndarray:
    """Repeated windows, as bits, of every different fragment of one shard.

    A fragment with copies is repeated as a whole; the others are searched. All are indexed.
    """
    flat, offsets = words(texts)
    _, index = codes(flat)
    lengths = np.diff(offsets)
    # One separator, code 0, after every fragment.
    text = np.zeros(len(flat) + len(lengths), np.int64)
    starts = offsets[:-1] + np.arange(len(lengths))
    places = np.arange(len(flat)) + np.repeat(np.arange(len(lengths)), lengths)
    text[places] = index.astype(np.int64) + 1
    weights = np.repeat(copies, lengths + 1)
    out = (np.int64(1) << n_windows) - 1
    alone = np.flatnonzero(copies == 1)
    if len(alone):
        found = FMIndex(text, weights, window).repeated(text, starts[alone], n_windows[alone])
        out[alone] = found
    return out


def _search(batches, window: int) -> Iterator[pa.RecordBatch]:
    def result(table: pa.Table) -> pa.RecordBatch:
        key = table["key"].to_numpy()
        copies = table["copies"].to_numpy()
        count = table["windows"].to_numpy().astype(np.int64)
        masks = np.where(copies > 1, (np.int64(1) << count) - 1, 0)
        # A k-gram with a single different fragment has nothing to be searched for.
        same = np.concatenate([[False], key[1:] == key[:-1]])
        shared = np.flatnonzero(same | np.append(same[1:], False))
        if len(shared):
            texts = table["text"].combine_chunks().take(pa.array(shared))
            masks[shared] = search_shard(texts, copies[shared], count[shared], window)
        return pa.RecordBatch.from_arrays(
            [table["fragment"].combine_chunks(), pa.array(copies), pa.array(masks)],
            names=["fragment", "copies", "mask"],
        )

    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        size += int(pc.sum(batch.column("windows")).as_py()) + window * batch.num_rows
        if size < INDEX_WORDS:
            continue
        table = pa.Table.from_batches(kept)
        change = np.flatnonzero(np.diff(table["key"].to_numpy()))
        if len(change):
            cut = int(change[-1]) + 1
            yield result(table.slice(0, cut))
            rest = table.slice(cut).combine_chunks()
            kept = rest.to_batches()
            size = int(pc.sum(rest["windows"]).as_py()) + window * rest.num_rows
    if kept:
        yield result(pa.Table.from_batches(kept))


def _hot_masks(hot: DataFrame, window: int) -> DataFrame:
    """Results for fragments whose k-gram is in very many: each window is grouped by its text."""
    split = F.split("text", " ")
    every = F.transform(
        F.sequence(F.lit(0), F.col("windows") - 1),
        lambda j: F.struct(
            j.alias("j"), F.array_join(F.slice(F.col("parts"), j + 1, window), " ").alias("words")
        ),
    )
    singles = (
        hot.withColumn("parts", split)
        .select("fragment", "copies", F.explode(every).alias("w"))
        .select("fragment", "copies", "w.j", F.md5(F.col("w.words").cast("binary")).alias("id"),
                F.col("w.words").alias("words"))
    )
    repeated = (
        singles.groupBy("id", "words")
        .agg(F.sum("copies").alias("places"))
        .where(F.col("places") >= 2)
        .groupBy("id")
        .agg(F.sum("places").alias("n"))
    )
    found = lookup_by_hot_key(singles.drop("words"), repeated, "id", "n")
    bit = F.when(F.col("n").isNotNull(), F.expr("shiftleft(1L, j)")).otherwise(F.lit(0))
    return found.groupBy("fragment").agg(
        F.max("copies").alias("copies"), F.sum(bit).cast("long").alias("mask")
    )


def _kept(batches, window: int) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        flat, offsets = words(batch.column("text"))
        counts = np.diff(offsets)
        change = np.zeros(len(flat) + 1, np.int64)
        spans = batch.column("spans")
        inner = spans.flatten()
        if len(inner):
            filled = pc.fill_null(pc.list_value_length(spans), 0).to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), filled)
            first = offsets[owner] + inner.field("start").to_numpy().astype(np.int64)
            mask = inner.field("mask").to_numpy()
            for j in range(int(mask.max()).bit_length()):
                at = first[(mask >> j) & 1 == 1] + j
                np.add.at(change, at, 1)
                np.add.at(change, at + window, -1)
        keep = np.cumsum(change[:-1]) == 0
        left = np.diff(offsets_of(keep)[offsets])
        some = flat.filter(pa.array(keep))
        cut = offsets_of(left)
        digests = [
            hashlib.sha256(joined(some.slice(cut[i], left[i])).encode()).hexdigest()
            for i in range(batch.num_rows)
        ]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(counts, pa.int64()),
                pa.array(counts - left, pa.int64()),
                pa.array(digests),
                *([pc.binary_join(
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), some), " ")]),
            ],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Every row without the passages that occur anywhere else as well.

    A word goes if a window of ``window`` consecutive words of its document covers it whose words
    start at another place too, in any document or the same one; all copies go, and windows are
    judged on the input. Columns: doc_id, n_words, n_removed, kept_sha256, kept_text.

    Only windows whose smallest k-gram hash occurs as such in two places can repeat; the rest of
    the text stays where it is. Copies of a fragment are counted before shards are formed, so a
    passage in very many documents is one fragment with a count, and fragments that share a
    k-gram but differ, in very large numbers, are taken apart into windows.

    A NULL text has no words. Rows may share ids or have none (they are numbered then); equal rows
    repeat each other. Very long texts are windows like any others; ties of hashes go to the leftmost
    k-gram. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    if not gram < window <= 64 or gram & (gram - 1) or window - gram + 1 > 62:
        raise ValueError("gram must be a power of two below window, and window at most 64")
    rows = identified(exact_columns(docs, "doc_id", "text")).select(
        ROW, F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    anchors = materialize(
        rows.select(ROW, "text").mapInArrow(
            lambda batches: _anchors(batches, window, gram),
            f"{ROW} long, start int, windows int, key long",
        ),
        "anchors",
    )
    shared = anchors.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= 2)
    candidates = (
        lookup_by_hot_key(anchors, shared, "key", "n")
        .where(F.col("n").isNotNull())
        .groupBy(ROW)
        .agg(F.collect_list(F.struct("start", "windows", "key")).alias("spans"))
    )
    fragments = materialize(
        rows.select(ROW, "text")
        .join(candidates, ROW)
        .mapInArrow(
            lambda batches: _fragment_texts(batches, window),
            f"{ROW} long, start int, windows int, key long, fragment binary, text string",
        ),
        "fragments",
    )
    different = materialize(
        fragments.groupBy("key", "fragment", "windows", "text").agg(F.count("*").alias("copies")),
        "different-fragments",
    )
    hot = materialize(
        different.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_FRAGMENTS),
        "hot-keys",
    )
    if hot.isEmpty():
        ordinary, singles = different, None
    else:
        marked = lookup_by_hot_key(different, hot, "key", "n")
        ordinary = marked.where(F.col("n").isNull()).drop("n")
        singles = _hot_masks(marked.where(F.col("n").isNotNull()).drop("n"), window)
    masks = (
        ordinary.select("key", "fragment", "windows", "copies", "text")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(
            lambda batches: _search(batches, window), "fragment binary, copies long, mask long"
        )
    )
    if singles is not None:
        masks = masks.unionByName(singles)
    masks = masks.where(F.col("mask") != 0)
    found = (
        lookup_by_hot_key(fragments.select(ROW, "start", "fragment"), masks, "fragment", "copies")
        .where(F.col("mask").isNotNull())
        .groupBy(ROW)
        .agg(F.collect_list(F.struct("start", "mask")).alias("spans"))
    )
    return (
        rows.join(found, ROW, "left")
        .drop(ROW)
        .mapInArrow(
            lambda batches: _kept(batches, window),
            "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string",
        )
    )
