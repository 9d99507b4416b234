"""Byte strings that repeat in other documents, found in Burrows-Wheeler transforms that grow by
one column of symbols a round.

Every window of bytes belongs to the shard of its smallest gram hash, so equal windows meet in one
shard whichever documents they come from. Neighbouring windows with one smallest gram form a
fragment. A shard's fragments are a collection of short strings: each round puts the next symbol
of every string in front of its last suffix, finds the place of the longer suffix from the symbols
before it, and writes the transform and the common prefixes anew, front to back. After as many
rounds as the longest fragment has bytes, suffixes with a common prefix as long as a window stand
side by side; a walk through the transform says which they are.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondcart.llm.common import exact_columns, offsets_of, ragged, text_slices
from secondcart.llm.records import open_store
from secondcart.llm.rows import BROADCAST_ROWS, ROW, identified
from secondcart.operators.joins import lookup_by_hot_key
from secondcart.sources.writers import materialize, new_path

WINDOW = 50
GRAM = 20
# Rows that are looked up together: so many ids next to each other, or a single long text.
SLICE_ROWS = 9  # bits
LONG_TEXT = 256 << 10
# Bytes of fragments in one shard; fragments with one key are never divided between shards.
SHARD_BYTES = 512 << 10
# Rows with one key, some two megabytes of fragments, from which equal ones are merged before they
# meet.
HOT = 32_768
# Different fragments of one key from which they are cut again by a longer gram.
WIDE = 16_384
# A shard's files are kept in memory up to this size.
FILE_BYTES = 64 << 20
# Bytes of a key that are compared before fragments are formed.
KEY_BYTES = 6
BASE = 0x9E3779B97F4A7C15
NONE = np.iinfo(np.int64).max


# --- the transform ---------------------------------------------------------------------------


class ColumnFiles:
    """A shard's growing sequences. Each round reads a sequence from front to back and writes the
    next one; beyond ``limit`` bytes they lie in ``folder``, which all executors share."""

    def __init__(self, folder: str | None = None, limit: int = FILE_BYTES):
        self.limit, self.kept, self.paths = limit, {}, {}
        self.folder, self.name = folder, uuid.uuid4().hex

    def write(self, name: str, values: np.ndarray) -> None:
        self.delete(name)
        if self.folder is None or values.nbytes <= self.limit:
            self.kept[name] = values
            return
        store, root = open_store(self.folder)
        store.create_dir(root, recursive=True)
        path = posixpath.join(root, f"{self.name}.{name}")
        with store.open_output_stream(path) as out:
            out.write(values.tobytes())
        self.paths[name] = (store, path, values.dtype)

    def read(self, name: str) -> np.ndarray:
        if name in self.kept:
            return self.kept[name]
        store, path, kind = self.paths[name]
        with store.open_input_stream(path) as stream:
            return np.frombuffer(stream.read(), kind)

    def delete(self, name: str) -> None:
        self.kept.pop(name, None)
        if name in self.paths:
            store, path, _ = self.paths.pop(name)
            store.delete_file(path)

    def close(self) -> None:
        for name in list(self.paths):
            self.delete(name)


def range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least value between two positions, both included, for many pairs of them."""
    out = np.empty(len(first), values.dtype)
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    table = values
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[first[at]], table[last[at] - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def merged(old: np.ndarray, new: np.ndarray, is_new: np.ndarray) -> np.ndarray:
    out = np.empty(len(is_new), old.dtype)
    out[is_new] = new
    out[~is_new] = old
    return out


def column_transform(
    text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, files: ColumnFiles
) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of all strings in order, as positions in ``text``, and the length of the prefix
    that each shares with the one before. The end of a string is smaller than any byte, and ends
    are in the order of their strings; they come first.

    A string's last inserted suffix stands at ``place``; the symbol there is what comes before it.
    How many equal symbols stand before that place, and how many smaller symbols there are at all,
    is where the longer suffix goes. It shares one symbol more with its new neighbour than the
    places of the two symbols share between them.
    """
    present = np.flatnonzero(np.bincount(text, minlength=256))
    code = np.zeros(256, np.uint8)
    code[present] = np.arange(1, len(present) + 1)
    m = len(starts)
    ends = starts + lengths
    string, place = np.arange(m), np.arange(m)
    files.write("symbols", code[text[ends - 1]])
    files.write("common", np.zeros(m, np.uint8))
    column = 0
    while len(string):
        column += 1
        symbols, common = files.read("symbols"), files.read("common")
        order, rank, sizes = symbol_order(symbols, len(present) + 1)
        first_of = offsets_of(sizes)[:-1]
        at = rank[place]
        by_rank = np.argsort(at)
        at, string = at[by_rank], string[by_rank]
        # The longer suffixes and those that will follow them have new neighbours.
        beside = np.zeros(len(order) + 1, bool)
        beside[at] = beside[at + 1] = True
        beside[first_of] = False
        near = np.flatnonzero(beside[:-1])
        shared = range_minima(common, order[near - 1] + 1, order[near]) + np.uint8(1)
        shift = m - sizes[0]
        before = ends[string] - column - 1
        last = before < starts[string]
        symbol = np.where(last, 0, code[text[np.maximum(before, 0)]]).astype(np.uint8)
        place = at + shift
        is_new = np.zeros(len(order) + len(at), bool)
        is_new[place] = True
        common = merged(common, np.zeros(len(at), np.uint8), is_new)
        common[near + shift] = shared
        starts_of = first_of[1:] + shift
        common[starts_of[starts_of < len(common)]] = 0
        files.write("common", common)
        files.write("symbols", merged(symbols, symbol, is_new))
        string, place = string[~last], place[~last]
    return suffixes_of(files.read("symbols"), ends, len(present) + 1), files.read("common")


def symbol_order(symbols: np.ndarray, n_symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the order of their symbols, each place's rank in that order, and symbol counts."""
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return order, rank, np.bincount(symbols, minlength=n_symbols)


def suffixes_of(symbols: np.ndarray, ends: np.ndarray, n_symbols: int) -> np.ndarray:
    """Where the suffix at each place of the transform starts, by walking through all strings at
    once from their ends."""
    _, rank, sizes = symbol_order(symbols, n_symbols)
    out = np.empty(len(symbols), np.int64)
    place, at = np.arange(len(ends)), ends.astype(np.int64)
    while len(place):
        out[place] = at
        more = symbols[place] != 0
        place, at = rank[place[more]] + (len(ends) - sizes[0]), at[more] - 1
    return out


def least_ids(
    text: np.ndarray, lengths: np.ndarray, ids: np.ndarray, window: int, files: ColumnFiles
) -> np.ndarray:
    """For every window of every string the least id of the strings that hold it, flat."""
    starts = offsets_of(lengths)[:-1]
    suffixes, common = column_transform(text, starts, lengths, files)
    suffixes, common = suffixes[len(lengths) :], common[len(lengths) :]
    owner = np.repeat(np.arange(len(lengths)), lengths)
    cut = common < window
    cut[:1] = True
    groups = np.flatnonzero(cut)
    least = np.minimum.reduceat(ids[owner[suffixes]], groups)
    at = np.empty(len(text), np.int64)
    at[suffixes] = np.repeat(least, np.diff(np.append(groups, len(suffixes))))
    return at[ragged(lengths - window + 1, starts)]


# --- fragments -------------------------------------------------------------------------------


def gram_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` bytes."""
    doubled, step, width = values.astype(np.uint64), BASE, 1
    out, done = None, 0
    while True:
        if size & width:
            if out is None:
                out = doubled
            else:
                n = len(values) - done - width + 1
                out = out[:n] * np.uint64(step) + doubled[done : done + n]
            done += width
        if width * 2 > size:
            break
        doubled = doubled[:-width] * np.uint64(step) + doubled[width:]
        step, width = step * step % (1 << 64), width * 2
    x = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fragments_of(
    values: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fragments of consecutive texts: owner, first byte within the owner, windows, key.

    The low bits of a hash give way to those of its place, so that a running minimum finds both.
    Among equal hashes any place may win: their key is the same.
    """
    empty = np.zeros(0, np.int64)
    if len(values) < window:
        return empty, empty, empty, empty
    span = window - gram + 1
    hashes = gram_hashes(values, gram)
    low = np.uint64(63)
    least = (hashes & ~low) | (np.arange(len(hashes), dtype=np.uint64) & low)
    width = 1
    while width < span:
        shift = min(width, span - width)
        least = np.minimum(least[shift:], least[:-shift])
        width += shift
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(owner[: len(least)] == owner[window - 1 :])
    if not len(at):
        return empty, empty, empty, empty
    own, least = owner[at], least[at]
    place = at + (((least & low).astype(np.int64) - at) & 63)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 0) | (np.diff(place) != 0)]))
    count = np.diff(np.append(first, len(at)))
    keys = (least[first] >> np.uint64(64 - 8 * KEY_BYTES)).view(np.int64)
    return own[first], at[first] - offsets[own[first]], count, keys


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column and the offsets of its rows."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def _binaries(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    ends = offsets_of(lengths).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))]
    )


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Borders of the runs in which no column changes."""
    n = len(columns[0])
    change = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [n]]) if n else np.zeros(1, np.int64)


def _packed(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])


def _unpacked(data: bytes) -> np.ndarray:
    some = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    out = np.zeros((len(some), 8), np.uint8)
    out[:, :KEY_BYTES] = some
    return out.view("<i8").ravel()


SLICE_KEYS = "bucket int, slice long, keys binary, counts binary"


def _slice_keys(buckets: int, window: int, gram: int):
    """Keys of each slice and in how many of its rows they are, packed by bucket."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "data"):
            values, offsets = _bytes_of(batch.column("data"))
            own, _, _, keys = fragments_of(values, offsets, window, gram)
            if not len(own):
                continue
            part = batch.column("slice").to_numpy()[own]
            bucket = keys % buckets
            order = np.lexsort((own, keys, bucket, part))
            part, bucket, keys, own = part[order], bucket[order], keys[order], own[order]
            first = _runs(part, keys)[:-1]
            new_row = np.ones(len(own), np.int64)
            new_row[1:] = own[1:] != own[:-1]
            new_row[first] = 1
            # No slice has nearly as many rows as this type can count.
            counts = np.add.reduceat(new_row, first).astype("<u2")
            part, bucket, packed = part[first], bucket[first], _packed(keys[first])
            rows = _runs(part, bucket)
            sizes = np.diff(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[rows[:-1]], pa.int32()),
                    pa.array(part[rows[:-1]]),
                    _binaries(packed.ravel(), sizes * KEY_BYTES),
                    _binaries(counts.view(np.uint8), sizes * 2),
                ],
                names=["bucket", "slice", "keys", "counts"],
            )

    return run


FOUND_KEYS = "slice long, hot boolean, keys binary"


def _shared_keys(hot: int):
    """Of one bucket's keys those that several rows have, given back to each of their slices."""

    def run(table: pa.Table) -> pa.Table:
        keys = _unpacked(b"".join(table["keys"].to_pylist()))
        counts = np.frombuffer(b"".join(table["counts"].to_pylist()), "<u2").astype(np.int64)
        sizes = pc.binary_length(table["counts"]).to_numpy() // 2
        part = np.repeat(table["slice"].to_numpy(), sizes)
        order = np.argsort(keys, kind="stable")
        borders = _runs(keys[order])
        first, n = borders[:-1], np.diff(borders)
        total = np.add.reduceat(counts[order], first)
        kind = np.repeat(np.where(total > 1, np.where(total > hot, 2, 1), 0), n)
        left = np.flatnonzero(kind)
        order, kind = order[left], kind[left]
        by_slice = np.lexsort((kind, part[order]))
        order, kind = order[by_slice], kind[by_slice]
        rows = _runs(part[order], kind)
        at = rows[:-1]
        return pa.table(
            {
                "slice": pa.array(part[order][at]),
                "hot": pa.array(kind[at] == 2),
                "keys": _binaries(_packed(keys[order]).ravel(), np.diff(rows) * KEY_BYTES),
            }
        )

    def guarded(table: pa.Table) -> pa.Table:
        if table.num_rows:
            return run(table)
        none = {"slice": pa.int64(), "hot": pa.bool_(), "keys": pa.binary()}
        return pa.table({k: pa.array([], t) for k, t in none.items()})

    return guarded


FRAGMENTS = "shard long, key long, hot boolean, row long, id long, starts binary, text binary"


def _merged(own: np.ndarray, start: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """One entry for equal fragments of one row: the place of a first one, and all their starts."""
    code = texts.dictionary_encode().indices.to_numpy().astype(np.int64)
    order = np.lexsort((start, code, own))
    borders = _runs(own[order], code[order])
    starts = np.ascontiguousarray(start[order].astype("<i4")).view(np.uint8)
    return order[borders[:-1]], _binaries(starts, np.diff(borders) * 4)


def _fragment_rows(batch, own, start, count, keys, hot, values, offsets, window) -> pa.RecordBatch:
    length = count + window - 1
    texts = _binaries(values[ragged(length, offsets[own] + start)], length)
    first, starts = _merged(own, start, texts)
    rows = batch.column("row").to_numpy()[own[first]]
    # Hot fragments are only passed on, wherever they land.
    spread = (rows * 1_000_003 + start[first]) * 0x9E3779B97F4A7C1
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.where(hot[first], spread, keys[first])),
            pa.array(keys[first]),
            pa.array(hot[first]),
            pa.array(rows),
            batch.column("id").take(pa.array(own[first])),
            starts,
            texts.take(pa.array(first)),
        ],
        names=["shard", "key", "hot", "row", "id", "starts", "text"],
    )


def _fragments(window: int, gram: int):
    """Fragments whose keys several rows have. Rows come sorted by slice, its keys first."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        current, lists, keys, is_hot = None, [], None, None
        for batch in batches:
            parts = batch.column("slice").to_numpy()
            kinds = batch.column("kind").to_numpy()
            borders = _runs(parts, kinds)
            for a, b in zip(borders, borders[1:], strict=False):
                if parts[a] != current:
                    current, lists, keys = parts[a], [], None
                piece = batch.slice(a, b - a)
                if kinds[a] == 0:
                    lists += zip(piece["data"].to_pylist(), piece["hot"].to_pylist(), strict=True)
                    continue
                if not lists:
                    continue
                if keys is None:
                    own = [_unpacked(k) for k, _ in lists]
                    keys = np.concatenate(own)
                    is_hot = np.repeat([h for _, h in lists], [len(k) for k in own])
                    order = np.argsort(keys)
                    keys, is_hot = keys[order], is_hot[order]
                for part in text_slices([piece], "data"):
                    values, offsets = _bytes_of(part.column("data"))
                    own, start, count, key = fragments_of(values, offsets, window, gram)
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    left = np.flatnonzero(keys[at] == key)
                    if len(left):
                        yield _fragment_rows(
                            part, own[left], start[left], count[left], key[left],
                            is_hot[at[left]], values, offsets, window,
                        )

    return run


def _cut_again(window: int, gram: int):
    """The windows of fragments in new fragments, by a longer gram."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            values, offsets = _bytes_of(batch.column("text"))
            own, start, count, keys = fragments_of(values, offsets, window, gram)
            length = count + window - 1
            # Every start of the fragment is one of the new one as well.
            flat, ends = _bytes_of(batch.column("starts"))
            before, n = flat.view("<i4"), np.diff(ends)[own] // 4
            places = before[ragged(n, ends[own] // 4)] + np.repeat(start, n)
            starts = np.ascontiguousarray(places.astype("<i4")).view(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys),
                    batch.column("row").take(pa.array(own)),
                    batch.column("id").take(pa.array(own)),
                    _binaries(starts, n * 4),
                    _binaries(values[ragged(length, offsets[own] + start)], length),
                ],
                names=["key", "row", "id", "starts", "text"],
            )

    return run


# --- shards ----------------------------------------------------------------------------------


def search_shard(
    texts: pa.Array, keys: np.ndarray, ids: np.ndarray, window: int, folder: str | None = None,
    limit: int = FILE_BYTES,
) -> tuple[np.ndarray, np.ndarray]:
    """Least id of each window of different fragments, flat, and the offset of each fragment.

    A key with a single fragment has nothing to be compared with.
    """
    values, offsets = _bytes_of(texts)
    lengths = np.diff(offsets)
    n_windows = lengths - window + 1
    out, ends = np.repeat(ids, n_windows), offsets_of(n_windows)
    _, of_key, per_key = np.unique(keys, return_inverse=True, return_counts=True)
    several = np.flatnonzero(per_key[of_key] > 1)
    if len(several):
        files = ColumnFiles(folder, limit)
        own = lengths[several]
        flat = values[ragged(own, offsets[several])]
        found = least_ids(flat, own, ids[several], window, files)
        files.close()
        out[ragged(n_windows[several], ends[several])] = found
    return out, ends


def _in_shards(batches, size_of: str) -> Iterator[pa.Table]:
    """Rows sorted by key in tables of about ``SHARD_BYTES``, cut between keys only."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in text_slices([batch], size_of, SHARD_BYTES):
            kept.append(part)
            size += pc.sum(pc.binary_length(part.column(size_of))).as_py() or 0
            if size < SHARD_BYTES:
                continue
            table = pa.Table.from_batches(kept)
            cut = int(_runs(table["shard"].to_numpy())[-2])
            if cut:
                yield table.slice(0, cut)
                rest = table.slice(cut).combine_chunks()
                kept = rest.to_batches()
                size = pc.sum(pc.binary_length(rest[size_of])).as_py() or 0
    if kept:
        yield pa.Table.from_batches(kept)


RESULTS = "row long, starts binary, mask long, key long, id long, text binary"
RESULT_NAMES = ["row", "starts", "mask", "key", "id", "text"]


def _bits(smaller: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One number per range of flags, whose bit j is flag j of the range."""
    place = np.arange(len(smaller)) - np.repeat(offsets[:-1], np.diff(offsets))
    value = np.where(smaller, np.int64(1) << place, 0)
    return np.add.reduceat(value, offsets[:-1]) if len(value) else np.zeros(0, np.int64)


def _search(window: int, folder: str):
    """Windows of each fragment that a row with a smaller id holds too, as bits; fragments without
    any are left out. Hot fragments are passed on with their text."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for table in _in_shards(batches, "text"):
            hot = table["hot"].to_numpy()
            passed = table.filter(pa.array(hot)).combine_chunks()
            for b in passed.to_batches():
                columns = {name: b.column(name) for name in ("row", "starts", "key", "id", "text")}
                columns["mask"] = pa.nulls(b.num_rows, pa.int64())
                yield _results(columns, b.num_rows)
            cold = table.filter(pa.array(~hot)).combine_chunks()
            if not cold.num_rows:
                continue
            coded = cold["text"].combine_chunks().dictionary_encode()
            if isinstance(coded, pa.ChunkedArray):
                coded = coded.chunk(0)
            which = coded.indices.to_numpy()
            ids, keys = cold["id"].to_numpy(), cold["key"].to_numpy()
            least = np.full(len(coded.dictionary), NONE)
            np.minimum.at(least, which, ids)
            key_of = np.empty(len(least), np.int64)
            key_of[which] = keys
            found, ends = search_shard(coded.dictionary, key_of, least, window, folder)
            count = np.diff(ends)[which]
            smaller = found[ragged(count, ends[which])] < np.repeat(ids, count)
            mask = _bits(smaller, offsets_of(count))
            left = np.flatnonzero(mask)
            some = cold.take(pa.array(left)).combine_chunks()
            columns = {name: some[name].combine_chunks() for name in ("row", "starts")}
            yield _results(columns | {"mask": pa.array(mask[left])}, len(left))

    return run


def _results(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    arrays = []
    for name, kind in zip(RESULT_NAMES, kinds, strict=True):
        column = columns.get(name, pa.nulls(n, kind))
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], kind)
        arrays.append(column)
    return pa.RecordBatch.from_arrays(arrays, names=RESULT_NAMES)


def _search_different(window: int, folder: str):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for table in _in_shards(batches, "text"):
            texts = table["text"].combine_chunks()
            found, ends = search_shard(
                texts, table["shard"].to_numpy(), table["id"].to_numpy(), window, folder
            )
            yield pa.RecordBatch.from_arrays(
                [
                    table["fragment"].combine_chunks(),
                    table["n"].combine_chunks(),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found)),
                ],
                names=["fragment", "n", "least"],
            )

    return run


def hot_masks(
    hot: DataFrame, window: int, gram: int, folder: str, wide: int
) -> list[DataFrame]:
    """``row, starts, mask`` of fragments with frequent keys.

    Equal fragments become one with its least id before they meet, and each finds its result by
    its digest. Where that leaves very many under one key, they are cut again by a longer gram,
    in the end by the whole window, of which a key has a single one.
    """
    out = []
    for gram in ((gram + window) // 2, window, None):
        hot = hot.withColumn("fragment", F.sha2("text", 256))
        different = materialize(
            hot.groupBy("key", "fragment", "text").agg(
                F.min("id").alias("id"), F.count("*").alias("n")
            ),
            "different",
        )
        per_key = different.groupBy("key").agg(
            F.count("*").alias("different"), F.sum("n").alias("rows")
        )
        crowded = materialize(per_key.where(F.col("different") > wide), "crowded")
        some = None
        if gram is not None and not crowded.isEmpty():
            marked = materialize(lookup_by_hot_key(hot, crowded, "key", "rows"), "marked")
            some = marked.where(F.col("rows").isNotNull())
            hot = marked.where(F.col("rows").isNull())
            different = different.join(crowded, "key", "left_anti")
        searched = (
            different.select(F.col("key").alias("shard"), "fragment", "id", "n", "text")
            .repartition("shard")
            .sortWithinPartitions("shard")
            .mapInArrow(_search_different(window, folder), "fragment string, n long, least array<long>")
        )
        found = lookup_by_hot_key(
            hot.select("row", "id", "starts", "fragment"), searched, "fragment", "n"
        )
        bits = F.transform(
            "least", lambda x, j: F.when(x < F.col("id"), F.expr("1L")).otherwise(F.lit(0)) * F.pow(F.lit(2), j).cast("long")
        )
        mask = F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: acc + x)
        out.append(found.select("row", "starts", mask.alias("mask")).where(F.col("mask") != 0))
        if some is None:
            break
        hot = some.select("key", "row", "id", "starts", "text").mapInArrow(
            _cut_again(window, gram), "key long, row long, id long, starts binary, text binary"
        )
    return out


# --- the operator ----------------------------------------------------------------------------

KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _kept(window: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "data"):
            values, offsets = _bytes_of(batch.column("data"))
            change = np.zeros(len(values) + 1, np.int64)
            spans = batch.column("spans")
            inner = spans.flatten()
            if len(inner):
                filled = pc.fill_null(pc.list_value_length(spans), 0).to_numpy()
                flat, ends = _bytes_of(inner.field("starts"))
                n = np.diff(ends) // 4
                first = np.repeat(offsets[np.repeat(np.arange(batch.num_rows), filled)], n)
                first = first + flat.view("<i4")
                mask = np.repeat(inner.field("mask").to_numpy(), n)
                for j in range(int(mask.max()).bit_length()):
                    at = first[(mask >> j) & 1 == 1] + j
                    np.add.at(change, at, 1)
                    np.add.at(change, at + window, -1)
            keep = np.cumsum(change[:-1]) == 0
            # A run starts where a byte goes and the one before, in the same text, does not.
            begins = ~keep
            begins[1:] &= keep[:-1]
            inside = offsets[:-1][offsets[:-1] < len(values)]
            begins[inside] = ~keep[inside]
            per_row = lambda flags: np.diff(offsets_of(flags)[offsets])
            left = per_row(keep)
            kept = _binaries(values[keep], left)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(offsets)),
                    pa.array(np.diff(offsets) - left),
                    pa.array(per_row(begins)),
                    pa.array([hashlib.sha256(k.as_buffer()).hexdigest() for k in kept]),
                    kept,
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def found_windows(
    rows: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, wide: int = WIDE
) -> DataFrame:
    """``row, starts, mask``: windows of ``rows(row, id, slice, data)`` that a smaller id holds.

    Bit j of a mask stands for the window j bytes after each of the starts."""
    spark = rows.sparkSession
    folder = new_path(spark, "columns")
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    long_enough = rows.where(F.octet_length("data") >= window)
    shared = (
        long_enough.select("slice", "data")
        .mapInArrow(_slice_keys(buckets, window, gram), SLICE_KEYS)
        .groupBy("bucket")
        .applyInArrow(_shared_keys(hot), FOUND_KEYS)
    )
    nothing = F.lit(None).cast("long")
    keys = shared.select(
        "slice", F.lit(0).alias("kind"), nothing.alias("row"), nothing.alias("id"), "hot",
        F.col("keys").alias("data"),
    )
    texts = long_enough.select(
        "slice", F.lit(1).alias("kind"), "row", "id", F.lit(False).alias("hot"), "data"
    )
    fragments = (
        keys.unionAll(texts)
        .repartition("slice")
        .sortWithinPartitions("slice", "kind")
        .mapInArrow(_fragments(window, gram), FRAGMENTS)
    )
    found = materialize(
        fragments.repartition("shard")
        .sortWithinPartitions("shard")
        .mapInArrow(_search(window, folder), RESULTS),
        "windows",
    )
    masks = found.where(F.col("mask").isNotNull()).select("row", "starts", "mask")
    frequent = found.where(F.col("mask").isNull()).drop("mask")
    if not frequent.isEmpty():
        for more in hot_masks(frequent, window, gram, folder, wide):
            masks = masks.unionAll(more)
    return masks


def remove_repeated_bytes(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, wide: int = WIDE
) -> DataFrame:
    """Every row without the bytes that a row with a smaller ``doc_id`` holds in a like place:
    doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    Texts are taken as UTF-8 bytes. A byte goes if a string of ``window`` bytes of its row covers
    it that also starts in a row with a smaller id; strings are judged on the input, never cross
    rows, and overlap freely. ``n_spans`` counts maximal runs of removed bytes; ``kept`` are the
    bytes that are left, in order, which need not be whole characters.

    A NULL or empty text has no bytes, one shorter than ``window`` loses none, a very long one is
    a slice of its own. Rows with the same id do not remove from each other, whether their texts
    are equal or not; a NULL id is larger than any other. Repeats inside one row stay. Passages in
    very many rows, or keys in very many passages, are merged or cut before they meet in a task.
    An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    if not gram < window <= 100 or window - gram + 1 > 62:
        raise ValueError("window must be above gram, by less than 62, and at most 100")
    rows = identified(exact_columns(docs, "doc_id", "text")).select(
        F.col(ROW).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NONE))).alias("id"),
        F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")).alias("data"),
    )
    near = F.shiftright("row", SLICE_ROWS)
    own_slice = F.when(F.octet_length("data") > LONG_TEXT, -1 - F.abs("row")).otherwise(near)
    copies = _few(materialize(later_copies(rows, window), "copies"))
    firsts = rows.join(copies, "row", "left_anti")
    masks = found_windows(firsts.withColumn("slice", own_slice), window, gram, hot, wide)
    spans = materialize(
        masks.groupBy("row").agg(F.collect_list(F.struct("starts", "mask")).alias("spans")), "spans"
    )
    # Texts that lose nothing need not meet the others.
    changed = _few(spans.select("row"))
    none = F.lit(None).cast(spans.schema["spans"].dataType)
    whole = firsts.join(changed, "row", "left_anti").select("doc_id", "data", none.alias("spans"))
    cut = (
        firsts.join(changed, "row", "left_semi").join(spans, "row").select("doc_id", "data", "spans")
    )
    done = whole.unionAll(cut).mapInArrow(_kept(window), KEPT)
    size, nothing = F.octet_length("data").cast("long"), F.lit(b"")
    gone = rows.join(copies, "row", "left_semi").select(
        "doc_id",
        size.alias("n_bytes"),
        size.alias("n_removed"),
        F.lit(1).cast("long").alias("n_spans"),
        F.sha2(nothing, 256).alias("kept_sha256"),
        nothing.alias("kept"),
    )
    return done.unionAll(gone)


def _few(rows: DataFrame) -> DataFrame:
    """Row numbers that are broadcast up to a million of them (8 MB), and joined beyond."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def later_copies(rows: DataFrame, window: int) -> DataFrame:
    """Rows that go as a whole: a row with a smaller id has the same bytes, at least a window of
    them. Whatever they hold the first of their copies holds too, so no other row needs them."""
    texts = rows.where(F.octet_length("data") >= window).select(
        "row", "id", F.sha2("data", 256).alias("digest")
    )
    first = texts.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    first = first.where(F.col("n") > 1)
    found = lookup_by_hot_key(texts, first, "digest", "n")
    return found.where(F.col("id") > F.col("first")).select("row")
