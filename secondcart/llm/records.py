"""Token ids as length-delimited binary records with an offset index.

A record is ``length (u64) | mask(crc32(length)) (u32) | payload | mask(crc32(payload)) (u32)``,
all little-endian, and the payload is a document's ids as u16 or u32 (the shard's ``width``).
Beside every shard ``part-N.rec`` lies ``part-N.idx``: one fixed-size entry per record with its
byte offset, so that records can be read in any order without scanning the shard.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secondcart.llm.common import exact_columns, text_slices
from secondcart.llm.tokens import word_tokenizer
from secondcart.sources.writers import shared_folder

# Added to a rotated checksum, as record formats do, so that data which itself holds checksums
# does not check itself.
MASK_DELTA = 0xA282EAD8
HEAD = "<QI"
HEAD_SIZE = 12
TAIL = "<I"
TAIL_SIZE = 4
# The index: position of the record, its ids, and its document (``has_id`` 0: NULL).
ENTRY = np.dtype([("at", "<u8"), ("n", "<u4"), ("has_id", "u1"), ("doc_id", "<i8")])
CHUNK = 4 << 20

SHARD_SCHEMA = "shard int, path string, width int, n_docs long, n_ids long, n_bytes long"
ROW_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join(
        [
            length,
            struct.pack(TAIL, masked(zlib.crc32(length))),
            payload,
            struct.pack(TAIL, masked(zlib.crc32(payload))),
        ]
    )


def open_store(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a folder given as a path or URI (file, hdfs, s3, gs, ...)."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(uri)


def read_record(stream, where: str) -> bytes | None:
    """Next payload of a shard, or None at its end; raises if a checksum is wrong."""
    head = stream.read(HEAD_SIZE)
    if not head:
        return None
    if len(head) < HEAD_SIZE:
        raise ValueError(f"{where}: cut off in a record's length")
    length, check = struct.unpack(HEAD, head)
    if masked(zlib.crc32(head[:8])) != check:
        raise ValueError(f"{where}: wrong checksum of a length")
    payload = stream.read(length)
    tail = stream.read(TAIL_SIZE)
    if len(payload) < length or len(tail) < TAIL_SIZE:
        raise ValueError(f"{where}: cut off in a record")
    if masked(zlib.crc32(payload)) != struct.unpack(TAIL, tail)[0]:
        raise ValueError(f"{where}: wrong checksum of a record")
    return payload


def _write_shard(batches, folder: str, vocabulary: str, end_id: int) -> Iterator[pa.RecordBatch]:
    store, root = open_store(folder)
    shard = TaskContext.get().partitionId()
    name = f"part-{shard:06d}"
    # Each attempt writes files of its own and renames them when they are whole, so that a lost
    # or repeated attempt leaves nothing half-written under the final names.
    attempt = uuid.uuid4().hex
    tokenizer = word_tokenizer(vocabulary)
    end = np.array([end_id], dtype=tokenizer.dtype)
    n_docs = n_ids = at = 0
    paths = {x: (f"{root}/_{name}.{attempt}.{x}", f"{root}/{name}.{x}") for x in ("rec", "idx")}
    records = index = None
    for batch in text_slices(batches):
        if records is None:
            records = store.open_output_stream(paths["rec"][0])
            index = store.open_output_stream(paths["idx"][0])
        ids, offsets = tokenizer.encode(batch.column("text"))
        entries = np.zeros(batch.num_rows, ENTRY)
        framed = []
        for i in range(batch.num_rows):
            payload = np.concatenate([ids[offsets[i] : offsets[i + 1]], end]).tobytes()
            framed.append(frame(payload))
            entries["at"][i] = at
            at += len(framed[-1])
        entries["n"] = np.diff(offsets) + 1
        doc_ids = batch.column("doc_id")
        entries["has_id"] = doc_ids.is_valid().to_numpy(zero_copy_only=False)
        entries["doc_id"] = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
        records.write(b"".join(framed))
        index.write(entries.tobytes())
        n_docs += batch.num_rows
        n_ids += int(entries["n"].sum())
    if records is None:
        return
    records.close()
    index.close()
    for temporary, final in paths.values():
        # An earlier attempt may have got here; not every store renames over a file.
        if store.get_file_info(final).type != arrow_fs.FileType.NotFound:
            store.delete_file(final)
        store.move(temporary, final)
    yield pa.RecordBatch.from_pydict(
        {
            "shard": pa.array([shard], pa.int32()),
            "path": [name],
            "width": pa.array([np.dtype(tokenizer.dtype).itemsize], pa.int32()),
            "n_docs": [n_docs],
            "n_ids": [n_ids],
            "n_bytes": [at],
        }
    )


def write_records(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int, shards: int | None = None
) -> DataFrame:
    """Write one record per row of ``docs`` in ascending ``doc_id`` order; return the shards.

    The rows are range-partitioned by ``doc_id`` (NULL first, equal ids by text), and partition N
    becomes shard N, so that reading the shards in order gives the documents in order. Text
    crosses the network once and is tokenised where it arrives. A NULL or empty text is a record
    with the end id alone, a very long one is a single record; an empty table has no shards. Rows
    with equal ids and texts are a record each. Other columns are ignored, whatever their names.
    The result has one row per shard, with ``start``, the ids in all shards before it; it is written as ``shards`` beside them.
    """
    spark = docs.sparkSession
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = exact_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    written = (
        rows.repartitionByRange(n, *order)
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
        .mapInArrow(
            lambda batches: _write_shard(batches, folder, vocabulary, end_id), SHARD_SCHEMA
        )
        .collect()  # one row per shard
    )
    listed, start = [], 0
    for row in sorted(written, key=lambda r: r["shard"]):
        listed.append((*row, start))
        start += row["n_ids"]
    table = spark.createDataFrame(listed, SHARD_SCHEMA + ", start long")
    table.coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/shards")
    return spark.read.parquet(f"{folder.rstrip('/')}/shards")


def _read_index(store, path: str) -> np.ndarray:
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), ENTRY)


def _read_shards(batches, folder: str) -> Iterator[pa.RecordBatch]:
    store, root = open_store(folder)
    for batch in batches:
        for shard in batch.to_pylist():
            base = posixpath.join(root, shard["path"])
            index = _read_index(store, f"{base}.idx")
            kind = {2: "<u2", 4: "<u4"}[shard["width"]]
            start, done = shard["start"], 0
            with store.open_input_stream(f"{base}.rec", buffer_size=CHUNK) as stream:
                while done < len(index):
                    part = index[done : done + 4096]
                    crcs = np.zeros(len(part), np.int64)
                    sizes = np.zeros(len(part), np.int64)
                    for i in range(len(part)):
                        payload = read_record(stream, shard["path"])
                        if payload is None:
                            raise ValueError(f"{shard['path']}: fewer records than its index")
                        ids = np.frombuffer(payload, kind)
                        sizes[i], crcs[i] = len(ids), zlib.crc32(ids.astype("<u4").tobytes())
                    if (sizes != part["n"]).any():
                        raise ValueError(f"{shard['path']}: records differ from the index")
                    starts = start + np.cumsum(sizes) - sizes
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(part["doc_id"], mask=part["has_id"] == 0),
                            "start": starts,
                            "n_tokens": sizes,
                            "ids_crc32": crcs,
                        }
                    )
                    start += int(sizes.sum())
                    done += len(part)
                if read_record(stream, shard["path"]) is not None:
                    raise ValueError(f"{shard['path']}: more records than its index")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Read every shard front to back, check all checksums, and describe each record.

    Columns: doc_id, start (ids in all records before it), n_tokens, ids_crc32 (of the ids as
    little-endian u32).
    """
    shards = spark.read.parquet(f"{folder.rstrip('/')}/shards")
    n = max(1, shards.count())
    return (
        shards.select("shard", "path", "width", "start")
        .repartition(n, "shard")
        .mapInArrow(lambda batches: _read_shards(batches, folder), ROW_SCHEMA)
    )


def _fetch(batches, folder: str) -> Iterator[pa.RecordBatch]:
    store, root = open_store(folder)
    for batch in batches:
        rows = batch.to_pylist()
        streams: dict = {}
        for row in rows:
            if row["path"] not in streams:
                path = posixpath.join(root, row["path"] + ".rec")
                streams[row["path"]] = store.open_input_file(path)
            streams[row["path"]].seek(row["at"])
            row["payload"] = read_record(streams[row["path"]], row["path"])
        for stream in streams.values():
            stream.close()
        ids = [np.frombuffer(r["payload"], f"<u{r['width']}").astype(np.int64) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r["doc_id"] for r in rows], pa.int64()),
                pa.array(ids, pa.list_(pa.int64())),
            ],
            names=["doc_id", "ids"],
        )


def _index_rows(batches, folder: str) -> Iterator[pa.RecordBatch]:
    store, root = open_store(folder)
    for batch in batches:
        for shard in batch.to_pylist():
            index = _read_index(store, posixpath.join(root, shard["path"] + ".idx"))
            yield pa.RecordBatch.from_pydict(
                {
                    "path": [shard["path"]] * len(index),
                    "width": pa.array([shard["width"]] * len(index), pa.int32()),
                    "at": pa.array(index["at"].astype(np.int64)),
                    "doc_id": pa.array(index["doc_id"], mask=index["has_id"] == 0),
                }
            )


def read_shuffled(spark: SparkSession, folder: str, seed: int) -> DataFrame:
    """All records in a seeded random order, ``(doc_id, ids)``: the small index is shuffled and
    each task then fetches its records by offset."""
    shards = spark.read.parquet(f"{folder.rstrip('/')}/shards")
    n = max(1, shards.count())
    index = shards.repartition(n, "shard").mapInArrow(
        lambda batches: _index_rows(batches, folder),
        "path string, width int, at long, doc_id long",
    )
    draw = F.xxhash64(F.lit(seed), "path", "at")
    return (
        index.withColumn("draw", draw)
        .repartition(n, "draw")
        .sortWithinPartitions("draw")
        .drop("draw")
        .mapInArrow(lambda batches: _fetch(batches, folder), "doc_id long, ids array<long>")
    )


def new_folder(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark).rstrip('/')}/secondcart/{app}/records-{uuid.uuid4().hex}"
