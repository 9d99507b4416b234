"""Near copies by exact Jaccard similarity of five-word shingles.

Texts whose SimHash fingerprints link meet first and are compared exactly. Fingerprints reach less far
than the similarity does (at 0.8 about ten of 64 bits differ, and four link), so MinHash bands bring
together what is then not joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secondcart.llm.common import exact_columns, offsets_of, ragged, text_slices
from secondcart.llm.components import components
from secondcart.llm.rows import BROADCAST_ROWS, ROW, identified, without
from secondcart.llm.simhash import fingerprint_components, fold, shingle_hashes
from secondcart.operators.joins import lookup_by_hot_key
from secondcart.sources.writers import materialize

SHINGLE = 5
SIMILARITY = 0.8
# Texts become candidates where all hashes of one band agree: at similarity 0.8 that fails in all
# bands for one pair in 20,000.
BANDS, PER_BAND = 25, 5
HASHES = BANDS * PER_BAND
# Bands whose keys are searched first. They join most of each group, and what is joined already
# need not meet again under the keys of the other bands.
FIRST_BANDS = 4
# In place of a band's number: the key is a group of linked SimHash fingerprints.
FINGERPRINTS = -1
# Texts that share a key meet in one task up to this many, with up to so many shingles; more are
# cut into chunks. Chunks meet in pairs, but only while they hold texts that are not joined.
CHUNK = 4096
CHUNK_SHINGLES = 1_000_000
# Bytes of shingle sets that a task handles at a time.
TABLE_BYTES = 4 << 20

_RANDOM = np.random.default_rng(42)
MASKS = _RANDOM.integers(0, 1 << 64, HASHES, np.uint64)
FACTORS = _RANDOM.integers(0, 1 << 64, HASHES, np.uint64) | np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The least value of every hash function over each text's shingles; 0 without shingles."""
    out = np.zeros((len(offsets) - 1, HASHES), np.uint64)
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled):
        starts = offsets[filled]
        for k in range(HASHES):
            out[filled, k] = np.minimum.reduceat((hashes ^ MASKS[k]) * FACTORS[k], starts)
    return out


def band_keys(signs: np.ndarray) -> np.ndarray:
    """A key per band; keys of different bands differ as well."""
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(signs), BANDS))
    for k in range(PER_BAND):
        keys = (keys ^ signs[:, k::PER_BAND]) * MIX
        keys = keys ^ (keys >> np.uint64(29))
    return keys


def _sets(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Each text's different shingles, in order, as bytes."""
    return [np.unique(hashes[a:b]).tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]


MARKS = "id long, content long, size long, fp long, keys array<long>"


def _marks(batches) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh64_intdigest

    for batch in text_slices(batches):
        hashes, offsets = shingle_hashes(batch.column("text"), SHINGLE)
        signs = signatures(hashes, offsets)
        fps = fold(*shingle_hashes(batch.column("text")))
        sets = _sets(hashes, offsets)
        contents = np.fromiter(map(xxh64_intdigest, sets), np.uint64, len(sets))
        ends = pa.array(np.arange(len(signs) + 1, dtype=np.int32) * BANDS)
        keys = np.ascontiguousarray(band_keys(signs)).view(np.int64).ravel()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array(contents.view(np.int64)),
                pa.array([len(s) // 8 for s in sets], pa.int64()),
                pa.array(fps.view(np.int64)),
                pa.ListArray.from_arrays(ends, pa.array(keys)),
            ],
            names=["id", "content", "size", "fp", "keys"],
        )


def _shingle_sets(batches) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        sets = _sets(*shingle_hashes(batch.column("text"), SHINGLE))
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"]
        )


# --- links under one key ---------------------------------------------------------------------


def links_between(
    shingles: np.ndarray, offsets: np.ndarray, component: np.ndarray
) -> list[tuple[int, int]]:
    """Links that join all texts of different components whose similarity is high enough, as far
    as they are not joined by the others: at most one fewer than there are components.

    One text at a time is compared with all others, through the lists of the texts that hold each
    of its shingles. Texts of the component with the most texts left need not be taken: when only
    that one is left, no two texts of different components have yet to be compared.
    """
    sizes = np.diff(offsets)
    if len(sizes) == 2:
        a, b = shingles[: offsets[1]], shingles[offsets[1] :]
        shared = len(np.intersect1d(a, b, assume_unique=True))
        alike = shared >= SIMILARITY * (len(a) + len(b) - shared)
        return [(0, 1)] if alike and component[0] != component[1] else []
    different, code = np.unique(shingles, return_inverse=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    holders = owner[np.argsort(code, kind="stable")]
    first_of = offsets_of(np.bincount(code, minlength=len(different)))
    label = np.unique(component, return_inverse=True)[1]
    left = np.ones(len(sizes), bool)
    found = []
    while True:
        open_texts = np.flatnonzero(left)
        labels = label[open_texts]
        outside = open_texts[labels != np.bincount(labels).argmax()] if len(labels) else labels
        if not len(outside):
            return found
        x = int(outside[0])
        left[x] = False
        own = code[offsets[x] : offsets[x + 1]]
        places = ragged(first_of[own + 1] - first_of[own], first_of[own])
        shared = np.bincount(holders[places], minlength=len(sizes))
        alike = shared >= SIMILARITY * np.maximum(sizes[x] + sizes - shared, 1)
        near = np.flatnonzero(alike & (label != label[x]))
        joined, at = np.unique(label[near], return_index=True)
        found += [(x, int(y)) for y in near[at]]
        label[np.isin(label, joined)] = label[x]


def _whole_groups(batches, names: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables of a bounded size that never end inside a group, and the borders of
    their groups."""

    def borders(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows - 1, bool)
        for name in names:
            values = table[name].to_numpy()
            change |= values[1:] != values[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])

    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in text_slices([batch], "shingles", TABLE_BYTES):
            kept.append(part)
            size += part.nbytes
            if size < TABLE_BYTES:
                continue
            table = pa.Table.from_batches(kept)
            cut = int(borders(table)[-2])
            if cut:
                whole = table.slice(0, cut)
                yield whole, borders(whole)
                rest = table.slice(cut).combine_chunks()
                kept, size = rest.to_batches(), rest.nbytes
    if kept:
        table = pa.Table.from_batches(kept)
        yield table, borders(table)


def _links(batches) -> Iterator[pa.RecordBatch]:
    for table, cuts in _whole_groups(batches, ("key", "i", "j")):
        node, component = table["node"].to_numpy(), table["component"].to_numpy()
        lengths = pc.binary_length(table["shingles"]).to_numpy() // 8
        ends = offsets_of(lengths)
        flat = np.frombuffer(b"".join(table["shingles"].to_pylist()), np.uint64)
        found = []
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e - s > 1:
                own = flat[ends[s] : ends[e]]
                links = links_between(own, ends[s : e + 1] - ends[s], component[s:e])
                found += [(node[s + a], node[s + b]) for a, b in links]
        a, b = (np.array(x, np.int64) for x in (zip(*found, strict=True) if found else ((), ())))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"]
        )


def _is_whole() -> Column:
    """Whether the ``n`` texts of a key, with ``total`` shingles, meet in one task."""
    return (F.col("n") <= CHUNK) & (F.col("total") <= CHUNK_SHINGLES)


def _tasks(in_pairs: bool) -> Column:
    """The chunk of a member of a key with ``n`` texts and ``total`` shingles, or all pairs of
    chunks that its own one is in."""
    wanted = F.greatest(F.col("n") / (CHUNK / 2), F.col("total") / (CHUNK_SHINGLES / 2))
    chunks = F.when(_is_whole(), 1).otherwise(F.ceil(wanted)).cast("int")
    mine = F.pmod(F.xxhash64("node"), chunks).cast("int")
    if not in_pairs:
        return F.array(F.struct(mine.alias("i"), mine.alias("j")))
    return F.transform(
        F.sequence(F.lit(0), chunks - 1),
        lambda other: F.struct(F.least(mine, other).alias("i"), F.greatest(mine, other).alias("j")),
    )


def _found_links(members: DataFrame, sets: DataFrame, in_pairs: bool) -> DataFrame:
    """Links between ``members(key, node, component, n, total)`` of one key, written."""
    placed = members.select(
        "key", "node", "component", F.explode(_tasks(in_pairs)).alias("task")
    ).select("key", "task.i", "task.j", "node", "component")
    described = (
        placed.join(sets, "node")
        .select("key", "i", "j", "node", "component", "shingles")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
    )
    return materialize(described.mapInArrow(_links, "a long, b long").distinct(), "links")


def _keyed_by_fingerprint(marks: DataFrame) -> DataFrame:
    """``(node, size, t, key)``: texts whose fingerprints link, over any others, have one key."""
    different = materialize(marks.groupBy("fp").agg(F.count("*").alias("n")), "fingerprints")
    groups = fingerprint_components(different)
    named = different.join(groups, different["fp"] == groups["node"], "left").select(
        "fp", "n", F.coalesce("component", "fp").alias("group")
    )
    found = lookup_by_hot_key(marks.select("node", "size", "fp"), named, "fp", "n")
    key = F.xxhash64(F.lit("fingerprints"), "group")
    return found.select("node", "size", F.lit(FINGERPRINTS).alias("t"), key.alias("key"))


def near_components(marks: DataFrame, texts: DataFrame) -> DataFrame:
    """``(node, component)`` of every text that is linked to one with a smaller number.

    ``marks(node, size, fp, keys)`` has one row per set of shingles. Texts that share a key, which
    is a group of SimHash fingerprints or a MinHash band, meet with their sets and are linked by
    exact similarity on the spot, so no pair is ever written that is not a link, and no more links
    than it takes to join the texts of a key. The fingerprints and the first bands join most of each
    group. Of the other bands' keys, and of all keys that were cut into chunks, those with texts of
    several components are left; their chunks meet in pairs.
    """
    banded = marks.select("node", "size", F.posexplode("keys").alias("t", "key"))
    keyed = banded.unionByName(_keyed_by_fingerprint(marks))
    shared = (
        keyed.groupBy("key")
        .agg(F.count("*").alias("n"), F.sum("size").alias("total"))
        .where("n > 1")
    )
    active = lookup_by_hot_key(keyed, shared, "key", "n").where(F.col("n").isNotNull())
    active = materialize(active.select("t", "key", "node", "n", "total"), "members")
    needed = materialize(active.select("node").distinct(), "needed")
    if needed.count() <= BROADCAST_ROWS:
        needed = F.broadcast(needed)
    own = texts.select(F.col("id").alias("node"), "text").join(needed, "node", "left_semi")
    sets = materialize(own.mapInArrow(_shingle_sets, "node long, shingles binary"), "sets")
    first = active.where(F.col("t") < FIRST_BANDS).withColumn("component", F.col("node"))
    links = _found_links(first, sets, in_pairs=False)
    groups = materialize(components(links), "groups")
    compared = (F.col("t") < FIRST_BANDS) & _is_whole()
    labelled = active.where(~compared).join(groups, "node", "left").select(
        "key", "node", "n", "total", F.coalesce("component", "node").alias("component")
    )
    several = (
        labelled.groupBy("key")
        .agg(
            F.count("*").alias("rows"),
            F.min("component").alias("low"),
            F.max("component").alias("high"),
        )
        .where("low < high")
        .select("key", "rows")
    )
    still = lookup_by_hot_key(labelled, several, "key", "rows").where(F.col("rows").isNotNull())
    still = materialize(still.drop("rows"), "open")
    more = _found_links(still, sets, in_pairs=True)
    return components(links.unionAll(more))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest ``doc_id``,
    or the first where ids are missing or repeated.

    Two texts link if their sets of five-word shingles (lower-cased; a shorter text is one
    shingle) have a Jaccard similarity of 0.8 or more. Texts without words are copies of each
    other. SimHash fingerprints and MinHash bands only say which texts to compare: every link is
    compared exactly; a pair at 0.8 is missed with a chance of about 0.00005, a more similar one
    with less. A NULL text is empty, a very long one is a set of its shingles
    like any other; repeated rows and ids are numbered. An empty table gives an empty result. All
    columns are passed on by position, so clashing names do no harm.
    """
    rows = identified(docs)
    texts = exact_columns(rows, ROW, "text").select(F.col(ROW).alias("id"), "text")
    marked = materialize(texts.mapInArrow(_marks, MARKS), "marks")
    marks = materialize(
        marked.groupBy("content", "size", "keys").agg(
            F.min("id").alias("node"), F.min("fp").alias("fp")
        ),
        "nodes",
    )
    linked = near_components(marks, texts).select("node")
    kept = marks.join(linked, "node", "left_anti").select(F.col("node").alias("id"))
    return without(rows, marked.select("id").join(kept, "id", "left_anti"))
