"""SimHash near-duplicates: 64-bit fingerprints, compared in bit-sliced blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secondcart.llm.common import exact_columns, joined, sums, text_slices, words
from secondcart.llm.components import components
from secondcart.llm.rows import ROW, identified, without
from secondcart.operators.joins import lookup_by_hot_key
from secondcart.sources.writers import materialize

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
# Fingerprints that share a key are compared in one task up to this many; more are cut into
# chunks, and every pair of chunks is a task of its own.
CHUNK = 16_384
# Aimed-at number of fingerprints that share a key by chance.
PER_KEY = 32
# Planes looked at before blocks of 64 pairs that are all too far apart are given up.
FIRST_PLANES = 32
SUM_ROWS = 1 << 18


def shingle_hashes(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of lower-cased words, flat, and the offsets per text.

    A text with fewer words than ``size`` has one shingle, the whole sequence; one without words
    has none.
    """
    from xxhash import xxh64_intdigest

    flat, offsets = words(pc.ascii_lower(pc.fill_null(texts, "")))
    n_words = np.diff(offsets)
    n_shingles = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    out = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(n_shingles, out=out[1:])
    if out[-1] == 0:
        return np.zeros(0, np.uint64), out
    lengths = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    first = np.repeat(offsets[:-1] - out[:-1], n_shingles) + np.arange(out[-1])
    last = np.minimum(first + size, np.repeat(offsets[1:], n_shingles)) - 1
    line = joined(flat).encode()
    spans = zip(starts[first].tolist(), ends[last].tolist(), strict=True)
    hashes = (xxh64_intdigest(line[a:b], SEED) for a, b in spans)
    return np.fromiter(hashes, np.uint64, int(out[-1])), out


def fold(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprint per text: each bit is 1 if it is set in over half of the text's hashes."""
    n = np.diff(offsets)
    counts = np.zeros((len(n), BITS), np.int64)
    filled = np.flatnonzero(n)
    owner = np.repeat(np.arange(len(n)), n)
    for a in range(0, len(hashes), SUM_ROWS):
        part = hashes[a : a + SUM_ROWS]
        bits = np.unpackbits(
            part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
        )
        own = owner[a : a + SUM_ROWS]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
        counts[own[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    out = np.zeros(len(n), np.uint64)
    if len(filled):
        ones = (2 * counts[filled] > n[filled, None]).astype(np.uint8)
        packed = np.packbits(ones, axis=1, bitorder="little")
        out[filled] = np.ascontiguousarray(packed).view("<u8").ravel()
    return out


def _fingerprints(batches) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        marks = fold(*shingle_hashes(batch.column("text")))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(marks.view(np.int64))], names=["id", "fp"]
        )


def fingerprints(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``(id, fp)`` of every row, ``fp`` as a signed long. NULL text: no words, so 0."""
    rows = exact_columns(docs, id_column, "text").select(
        F.col(id_column).cast("long").alias("id"), "text"
    )
    return rows.mapInArrow(_fingerprints, "id long, fp long")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- bit-sliced comparison -------------------------------------------------------------------


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row k holds bit k of all fingerprints, 64 fingerprints to a word. One empty
    word stands at the end."""
    n_words = -(-len(fps) // 64) + 1
    bits = np.zeros((n_words * 64, BITS), np.uint8)
    bits[: len(fps)] = np.unpackbits(
        fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
    )
    packed = np.packbits(bits.T.copy(), axis=1, bitorder="little")
    # Neighbouring planes belong to one block of a key and so often agree; look at planes from
    # all over the fingerprint first.
    order = np.arange(BITS).reshape(8, 8).T.ravel()
    return np.ascontiguousarray(packed).view("<u8")[order]


def _add(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save addition of rows of one weight: what is left of that weight, and the carries."""
    carries = []
    while len(rows) > 1:
        if len(rows) == 2:
            carries.append((rows[0] & rows[1])[None])
            rows = (rows[0] ^ rows[1])[None]
            break
        k = len(rows) // 3
        a, b, c = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k]
        half = a ^ b
        carries.append((a & b) | (c & half))
        rows = np.concatenate([half ^ c, rows[3 * k :]])
    width = rows.shape[1]
    return rows, np.concatenate(carries) if carries else np.zeros((0, width), rows.dtype)


class Counters:
    """A bitwise counter per lane: three bit rows count to 7, a fourth remembers more."""

    def __init__(self, width: int):
        self.ones = np.zeros((0, width), np.uint64)
        self.twos = np.zeros((0, width), np.uint64)
        self.fours = np.zeros((0, width), np.uint64)
        self.over = np.zeros(width, np.uint64)

    def update(self, differing: np.ndarray) -> None:
        self.ones, carry = _add(np.concatenate([self.ones, differing]))
        self.twos, carry = _add(np.concatenate([self.twos, carry]))
        self.fours, carry = _add(np.concatenate([self.fours, carry]))
        if len(carry):
            self.over |= np.bitwise_or.reduce(carry, axis=0)

    def keep(self, words: np.ndarray) -> None:
        self.ones, self.twos = self.ones[:, words], self.twos[:, words]
        self.fours, self.over = self.fours[:, words], self.over[words]

    def far(self) -> np.ndarray:
        """Lanes that count more than 4."""
        one, two, four = (
            x[0] if len(x) else np.zeros_like(self.over) for x in (self.ones, self.twos, self.fours)
        )
        return self.over | (four & (one | two))


def _shifted(planes: np.ndarray, at: np.ndarray, distance: int) -> np.ndarray:
    """Per lane of the words ``at`` the bits of the lane ``distance`` further on."""
    q, r = divmod(distance, 64)
    low = planes[:, at + q]
    if r == 0:
        return low
    return (low >> np.uint64(r)) | (planes[:, at + q + 1] << np.uint64(64 - r))


def near_lanes(planes: np.ndarray, n: int, distance: int, wanted: np.ndarray) -> np.ndarray:
    """Lanes i for which fingerprints i and i + distance differ in at most 4 bits.

    ``wanted`` has a bit per lane; blocks (words) without a wanted lane are skipped, and a block
    is abandoned as soon as all its wanted lanes are too far apart.
    """
    at = np.flatnonzero(wanted)
    alive = wanted[at]
    counters = Counters(len(at))
    for a, b in ((0, FIRST_PLANES), (FIRST_PLANES, BITS)):
        if not len(at):
            break
        part = planes[a:b]
        counters.update(part[:, at] ^ _shifted(part, at, distance))
        alive = alive & ~counters.far()
        left = np.flatnonzero(alive)
        if b < BITS and len(left) < len(at):
            at, alive = at[left], alive[left]
            counters.keep(left)
    if not len(at) or not alive.any():
        return np.zeros(0, np.int64)
    bits = np.unpackbits(alive.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, bit = np.nonzero(bits)
    return at[word] * 64 + bit


class Forest:
    """Connected lanes; every lane points to the smallest lane it is known to be linked to."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _lane_bits(flags: np.ndarray, width: int) -> np.ndarray:
    bits = np.zeros(width * 64, np.uint8)
    bits[: len(flags)] = flags
    return np.packbits(bits, bitorder="little").view("<u8").astype(np.uint64)


def links_in(fps: np.ndarray, group: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each group of neighbouring lanes.

    Lane i is compared with lane i + d of its group for every d. ``side`` is 0 where all pairs of
    a group are wanted; elsewhere only pairs of side 1 with side 2 are.
    """
    n = len(fps)
    planes = planes_of(fps)
    width = planes.shape[1]
    planes = np.concatenate([planes, np.zeros_like(planes)], axis=1)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
    sizes = np.diff(np.concatenate([starts, [n]]))
    lane_end = np.repeat(starts + sizes, sizes)
    reach = lane_end - np.arange(n) - 1
    forest = Forest(n)
    for distance in range(1, int(reach.max(initial=0)) + 1):
        flags = reach >= distance
        mixed = np.zeros(n, bool)
        mixed[: n - distance] = side[distance:] != side[: n - distance]
        flags &= (side == 0) | mixed
        lanes = near_lanes(planes, n, distance, _lane_bits(flags, width))
        if len(lanes):
            forest.link(lanes, lanes + distance)
    moved = np.flatnonzero(forest.root != np.arange(n))
    return fps[moved], fps[forest.root[moved]]


def _runs(batches, limit: int = 1 << 16) -> Iterator[tuple[np.ndarray, ...]]:
    """Whole groups of sorted rows, many at a time."""
    kept: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        kept.append(
            tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        )
        size += batch.num_rows
        if size < limit:
            continue
        whole = tuple(np.concatenate(c) for c in zip(*kept, strict=True))
        keys = whole[:4]
        change = np.zeros(size - 1, bool)
        for k in keys:
            change |= k[1:] != k[:-1]
        last = np.flatnonzero(change)
        if len(last):
            cut = int(last[-1]) + 1
            yield tuple(c[:cut] for c in whole)
            kept, size = [tuple(c[cut:] for c in whole)], size - cut
        else:
            kept = [whole]
    if size:
        yield tuple(np.concatenate(c) for c in zip(*kept, strict=True))


def _compare(batches) -> Iterator[pa.RecordBatch]:
    for table, key, i, j, side, fp in _runs(batches):
        change = np.zeros(len(fp) - 1, bool)
        for k in (table, key, i, j):
            change |= k[1:] != k[:-1]
        group = np.concatenate([[0], np.cumsum(change)])
        a, b = links_in(fp.view(np.uint64), group, side)
        if len(a):
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
            )


# --- candidates ------------------------------------------------------------------------------


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """Into how many blocks of bits to cut a fingerprint.

    Two fingerprints that differ in at most ``radius`` bits agree in all but ``radius`` blocks
    whatever the number of blocks. More blocks make longer keys, shared by fewer fingerprints,
    but more keys; the number only affects cost, never which links are found. Six blocks (15 keys
    of 21 bits) serve up to 67 million different fingerprints.
    """
    blocks = radius + 2
    while blocks < 2 * radius and n > PER_KEY << (BITS * (blocks - radius) // blocks):
        blocks += 1
    return blocks


def key_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(block, blocks - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_links(distinct: DataFrame, n: int) -> DataFrame:
    """Links ``(a, b)`` that connect all of the ``n`` distinct fingerprints (column ``fp``) that
    differ in at most 4 bits: within each set of fingerprints with a common key, a forest."""
    masks = key_masks(blocks_for(n))
    keys = F.array(
        *[
            F.struct(
                F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")
            )
            for k, m in enumerate(masks)
        ]
    )
    keyed = distinct.select("fp", F.explode(keys).alias("x")).select("x.t", "x.key", "fp")
    large = (
        keyed.groupBy("t", "key")
        .count()
        .where(F.col("count") > CHUNK)
        .select(
            F.col("t").alias("_t"),
            F.col("key").alias("_key"),
            F.ceil(F.col("count") / (CHUNK // 2)).cast("int").alias("chunks"),
        )
    )
    # Few keys are large; they are found once and written, so that the join below knows its size.
    large = materialize(large, "large-keys")
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pairs = F.when(
        F.col("chunks").isNotNull(),
        F.transform(
            F.sequence(F.lit(0), F.col("chunks") - 1),
            lambda other: F.struct(
                F.least(mine, other).alias("i"),
                F.greatest(mine, other).alias("j"),
                F.when(mine == other, 0).when(mine < other, 1).otherwise(2).alias("side"),
            ),
        ),
    ).otherwise(
        F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")))
    )
    tasks = (
        keyed.join(large, (F.col("t") == F.col("_t")) & (F.col("key") == F.col("_key")), "left")
        .select("t", "key", "fp", F.explode(pairs).alias("p"))
        .select("t", "key", "p.i", "p.j", "p.side", "fp")
    )
    return (
        tasks.repartition("t", "key", "i", "j")
        .sortWithinPartitions("t", "key", "i", "j")
        .mapInArrow(_compare, "a long, b long")
    )


def fingerprint_components(nodes: DataFrame) -> DataFrame:
    """``(node, component)`` of the different fingerprints ``fp`` that link to a smaller one."""
    links = materialize(near_links(nodes.select("fp"), nodes.count()).distinct(), "links")
    return components(links)


def near_groups(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Near-duplicate group of every row: doc_id, fingerprint, component_id.

    Fingerprints link at 4 or fewer differing bits; ``component_id`` is the smallest id reachable
    over links. Rows with equal fingerprints are one node however many they are, so a group of
    copies costs what one document costs; no pairs of documents are ever made. A NULL text is
    empty: fingerprint 0. Very long texts are hashed whole, a bounded number of shingles at a time.
    Rows without id belong to their fingerprint's group; a group without any id has a NULL
    ``component_id``. Rows with equal ids or texts have a result each, and ties of bits (set in
    exactly half the hashes) are 0. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    marked = materialize(fingerprints(docs, id_column), "fingerprints")
    nodes = materialize(
        marked.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "nodes"
    )
    groups = fingerprint_components(nodes)
    in_group = nodes.join(groups, nodes["fp"] == groups["node"], "left").select(
        "fp", "n", "first", F.coalesce("component", "fp").alias("component")
    )
    smallest = in_group.groupBy("component").agg(F.min("first").alias("component_id"))
    per_mark = in_group.join(smallest, "component").select("fp", "n", "component_id")
    return lookup_by_hot_key(marked, per_mark, "fp", "n").select(
        F.col("id").alias("doc_id"), hex_of(F.col("fp")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest ``doc_id``,
    or the first where ids are missing or repeated."""
    rows = identified(docs)
    groups = near_groups(rows, ROW)
    return without(rows, groups.where("doc_id != component_id").select("doc_id"))
