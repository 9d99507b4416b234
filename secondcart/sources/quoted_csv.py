"""CSV whose quoted fields span lines, read by many tasks per file.

A line break ends a record if the number of quotes before it in the file is even. Spark cuts the
files into byte ranges and reads their lines; a first pass gives the parity of every range, and sums
over the earlier ranges of the file say whether a range begins inside a quoted field. In the second
pass each task puts the records of its ranges together, and only records that a cut goes through
are shuffled, in a third one. Spark does all reading, so any file system it knows will do.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

QUOTE = '"'
# Quotes stand around a whole field only, and are doubled inside it.
_FIELD = r'(?:"[^"]*(?:""[^"]*)*"|[^",]*)'
WELL_QUOTED = rf"\A{_FIELD}(?:,{_FIELD})*\z"

# Parts of a record that a cut goes through: its end, an inner part, its start.
HEAD, MIDDLE, TAIL = 1, 2, 3
RECORDS = "header boolean, text string"
PARTS = "file string, block long, kind int, header boolean, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
    )


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parity of the quotes of every range of lines: one row for each range of a batch."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table.append_column("n", pc.count_substring(table["value"], QUOTE))
        sums = table.group_by(["file", "block"]).aggregate([("n", "sum")])
        yield from sums.rename_columns(["file", "block", "quotes"]).cast(
            pa.schema([("file", pa.string()), ("block", pa.int64()), ("quotes", pa.int64())])
        ).to_batches()


def _inside(lines: DataFrame) -> dict[str, frozenset[int]]:
    """Ranges that begin inside a quoted field, by file: at most one entry for each range, as in
    the list of splits that the driver holds for any scan."""
    ranges = (
        lines.mapInArrow(_parities, "file string, block long, quotes long")
        .groupBy("file", "block")
        .agg(F.sum("quotes").alias("quotes"))
    )
    upto = Window.partitionBy("file").orderBy("block")
    sums = ranges.withColumns(
        {
            "before": F.sum("quotes").over(upto) - F.col("quotes"),
            "open": (F.sum("quotes").over(Window.partitionBy("file")) % 2) == 1,
        }
    )
    found: dict[str, set[int]] = {}
    for file, block, left_open in (
        sums.where("open or before % 2 = 1").select("file", "block", "open").collect()
    ):
        if left_open:
            raise ValueError(f"odd number of quotes in {file}")
        found.setdefault(file, set()).add(block)
    return {file: frozenset(blocks) for file, blocks in found.items()}


def _check(records: pa.Array, file: str) -> None:
    bad = pc.invert(pc.match_substring_regex(records, WELL_QUOTED))
    if pc.any(bad).as_py():
        record = records.filter(bad)[0].as_py()
        raise ValueError(f"quote inside an unquoted field in {file}: {record[:200]!r}")


def _without_cr(records: pa.Array) -> pa.Array:
    ending = pc.ends_with(records, "\r")
    if not pc.any(ending).as_py():
        return records
    return pc.if_else(ending, pc.utf8_slice_codeunits(records, 0, -1), records)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """Lines of a batch by range; ranges follow each other and do not mix."""
    files, blocks = batch.column("file"), batch.column("block")
    n = batch.num_rows
    if n == 0:
        return
    changed = pc.or_(
        pc.not_equal(files[1:], files[:-1]), pc.not_equal(blocks[1:], blocks[:-1])
    ).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), n]
    for start, stop in pairwise(cuts):
        yield (
            files[start].as_py(), blocks[start].as_py(),
            batch.column("value")[start:stop],
        )


class _Range:
    """Records of one range, whose lines come in file order."""

    def __init__(self, file: str, block: int, inside: bool):
        self.file, self.block = file, block
        self.odd = inside  # inside a quoted field
        self.continued = inside  # inside a record of an earlier range
        self.first = block == 0
        self.open: list[pa.Array] = []

    def add(self, lines: pa.Array) -> tuple[pa.Array, bool]:
        """Takes lines; returns the records they end and whether the first of them began in an
        earlier range."""
        if self.block == 0 and self.first and not self.open:
            start = lines[:1].to_pylist()[0].removeprefix("\ufeff")
            lines = pa.concat_arrays([pa.array([start], lines.type), lines[1:]])
        quotes = pc.count_substring(lines, QUOTE).to_numpy(zero_copy_only=False)
        odd = (np.cumsum(quotes) + self.odd) % 2 == 1
        self.odd = bool(odd[-1])
        ends = np.flatnonzero(~odd)
        if len(ends) == 0:
            self.open.append(lines)
            return lines[:0], False
        held = sum(map(len, self.open))
        lines = pa.concat_arrays([*self.open, lines])
        stops = ends + held + 1
        self.open = [lines[stops[-1] :]] if stops[-1] < len(lines) else []
        offsets = pa.array(np.concatenate([[0], stops]), pa.int32())
        records = pc.binary_join(pa.ListArray.from_arrays(offsets, lines), "\n")
        continued, self.continued = self.continued, False
        return _without_cr(records), continued

    def rest(self) -> str | None:
        if not self.open:
            return None
        return "\n".join(line for lines in self.open for line in lines.to_pylist())


def _ranges(batches, inside) -> Iterator[tuple[_Range, pa.Array, bool, bool]]:
    """Every range with the records its lines end, batch by batch, and last without any."""
    now = None
    for batch in batches:
        for file, block, lines in _runs(batch):
            if now is None or (file, block) != (now.file, now.block):
                if now is not None:
                    yield now, lines[:0], False, True
                now = _Range(file, block, block in inside.get(file, ()))
            records, continued = now.add(lines)
            yield now, records, continued, False
    if now is not None:
        yield now, pa.array([], pa.string()), False, True


def _whole_records(batches, inside) -> Iterator[pa.RecordBatch]:
    """Records that begin and end in the same range; empty lines are none."""
    for place, records, continued, _ in _ranges(batches, inside):
        records = records[1:] if continued else records
        records = records.filter(pc.not_equal(records, ""))
        if len(records) == 0:
            continue
        _check(records, place.file)
        header = np.zeros(len(records), bool)
        header[0], place.first = place.first, False
        yield pa.RecordBatch.from_arrays([pa.array(header), records], ["header", "text"])


def _cut_parts(batches, inside) -> Iterator[pa.RecordBatch]:
    """Ends, inner parts and starts of records that a cut goes through."""
    for place, records, continued, last in _ranges(batches, inside):
        text = records[0].as_py() if continued else place.rest() if last else None
        if not continued and pc.any(pc.not_equal(records, "")).as_py():
            place.first = False
        if text is None:
            continue
        kind = HEAD if continued else MIDDLE if place.continued else TAIL
        row = {
            "file": [place.file], "block": [place.block], "kind": pa.array([kind], pa.int32()),
            "header": [kind == TAIL and place.first], "text": [text],
        }
        yield pa.RecordBatch.from_pydict(row)


def _joined(parts: DataFrame) -> DataFrame:
    """Records that a cut goes through. A record's parts follow its start in the order of the
    ranges; the window of a file has at most two parts for each of its ranges."""
    order = Window.partitionBy("file").orderBy("block", "kind")
    # An end comes before the next start in its range.
    in_order = F.array_sort(F.collect_list(F.struct("block", "kind", "text")))
    return (
        parts.withColumn("record", F.count_if(F.col("kind") == TAIL).over(order))
        .groupBy("file", "record")
        .agg(in_order.alias("parts"), F.bool_or("header").alias("header"))
        .select(
            "file",
            "header",
            F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"),
        )
    )


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            _check(batch.column("text")[i : i + 1], batch.column("file")[i].as_py())
        yield batch.select(["header", "text"])


def split_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files as they are written: ``header`` (first of its file), ``text``.

    Empty lines are no records. A quote inside an unquoted field is an error, because then line
    breaks cannot be told by counting quotes. An empty file has no record, and a field left open
    at the end of its file is an error.
    """
    lines = _lines(spark, path)
    inside = _inside(lines)
    whole = lines.mapInArrow(lambda batches: _whole_records(batches, inside), RECORDS)
    if not inside:
        return whole
    parts = lines.mapInArrow(lambda batches: _cut_parts(batches, inside), PARTS)
    return whole.unionByName(_joined(parts).mapInArrow(_checked, RECORDS))


def read_quoted_csv(
    spark: SparkSession, path: str, schema: StructType, options: dict[str, str]
) -> DataFrame:
    """Rows of CSV files with a header. Spark's own parser reads each record, with ``options``.

    Texts stay as written, line breaks of either kind included. Header names are compared without
    regard to case. A row that does not fit the schema is an error in mode FAILFAST.
    """
    records = split_records(spark, path)
    options = {**options, "quote": QUOTE, "escape": QUOTE, "multiLine": "true", "lineSep": "\n"}
    names = StructType([StructField(f.name, StringType()) for f in schema])
    found = F.from_csv("text", names.simpleString(), options)
    same = F.lit(True)
    for name in schema.names:
        same = same & F.coalesce(F.lower(found[name]) == name.lower(), F.lit(False))
    message = F.concat(F.lit("CSV header does not conform to the schema: "), F.col("text"))
    # assert_true is NULL where it holds, so that a header in order is no row
    is_row = F.when(F.col("header"), F.assert_true(same, message).isNotNull()).otherwise(True)
    row = F.from_csv("text", schema.simpleString(), options)
    return records.where(is_row).select(row.alias("row")).select("row.*")
