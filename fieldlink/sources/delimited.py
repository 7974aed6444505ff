"""Records of delimited text, read side by side: files are split at any line, quoted fields may hold line ends.

1. One pass over the lines gives each block of a file what it does to the two states a line can
   begin in, outside quotes or inside: the state after the block, and how many records begin in it.
   Each delimiter that a file may have is tried. A file's first block also gives its first lines.
2. Block by block these compose, so each block's own state and first record are
   known, as are the file's delimiter (most often in its first five lines) and header.
3. A second pass cuts records. Pieces of a record that goes over lines meet by file and record.

A row's place is its file, in the order of paths, and its record there: it doesn't depend on how files are split.
A quote counts at the start of a field only; inside quotes two stand for one. A quoted field that is
never closed, or is followed by anything but spaces and a delimiter, is an error, as in any file that a
parser of whole texts refuses. Short and long rows are none: they are filled up or cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values as V
from .shared import written

#: Delimiters that are tried, the earlier of equally frequent ones first (fixed values).
DELIMITERS = [",", "\t", "|", ";"]
OUT, IN, BROKEN = 0, 1, 2
#: Lines of a file that its delimiter is found from; first lines by which its header is looked for.
COUNTED, HEAD = 5, 64
#: Blocks whose plan (a few numbers each) is broadcast; beyond, lines are dealt out by block.
PLANNED = 200_000


def after(line: str, state: int, sep: str) -> int:
    """The state after a line that begins in `state`."""
    if state == BROKEN:
        return BROKEN
    at, inside = 0, state == IN
    while True:
        if inside:
            at = line.find('"', at)
            while at >= 0 and line.startswith('"', at + 1):
                at = line.find('"', at + 2)
            if at < 0:
                return IN
            at += 1
            while line.startswith(" ", at):
                at += 1
            if at >= len(line):
                return OUT
            if line[at] != sep:
                return BROKEN
            at, inside = at + 1, False
        if line.startswith('"', at):
            at, inside = at + 1, True
            continue
        at = line.find(sep, at) + 1
        if not at:
            return OUT


def cells_of(record: str, sep: str) -> list[str]:
    """The cells of a record that is whole."""
    if '"' not in record:
        return record.split(sep)
    out, at = [], 0
    while True:
        if record.startswith('"', at):
            end = record.find('"', at + 1)
            while record.startswith('"', end + 1):
                end = record.find('"', end + 2)
            out.append(record[at + 1 : end].replace('""', '"'))
            at = record.find(sep, end)
        else:
            end = record.find(sep, at)
            out.append(record[at:] if end < 0 else record[at:end])
            at = end
        if at < 0:
            return out
        at += 1


def blank(cells: list[str]) -> bool:
    return not "".join(cells).strip()


def delimiter_of(lines: list[str]) -> str:
    """The delimiter found most often in the first lines; the earlier of equals."""
    return max(DELIMITERS, key=lambda d: (sum(line.count(d) for line in lines[:COUNTED]), -DELIMITERS.index(d)))


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, text): the lines of all files, as they stand in each split of a file. Spark's reader drops a mark of the byte order."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))


def _runs(batches) -> Iterator[tuple[tuple[str, int], list[str], list[int]]]:
    """((file, block), texts, lines) of neighbouring rows of one block."""
    for batch in batches:
        where = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()))
        text, line, start = batch.column("text").to_pylist(), batch.column("line").to_pylist(), 0
        for i in range(1, len(where) + 1):
            if i == len(where) or where[i] != where[start]:
                yield where[start], text[start:i], line[start:i]
                start = i


BLOCK = "file string, block long, ends array<int>, records array<long>, head array<string>, lines long"


def blocks(lines: DataFrame, seps: list[str]) -> DataFrame:
    """A row for each block: for each delimiter and each state it may begin in, the state after it and the number of records that begin in it."""

    tried = [sep for sep in seps for _ in (OUT, IN)]

    def run(batches):
        now, states, counts, head, n = None, [], [], [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([states], pa.list_(pa.int32())), pa.array([counts], pa.list_(pa.int64())), pa.array([head], pa.list_(pa.string())), pa.array([n], pa.int64())], names=["file", "block", "ends", "records", "head", "lines"])

        for where, texts, _ in _runs(batches):
            if where != now:
                if now is not None:
                    yield row()
                now, states, counts, head, n = where, [s for _ in seps for s in (OUT, IN)], [0] * (2 * len(seps)), [], 0
            if where[1] == 0 and len(head) < HEAD:
                head = head + texts[: HEAD - len(head)]
            n += len(texts)
            quoted, before = [i for i, t in enumerate(texts) if '"' in t], 0
            # lines without a quote leave every state as it is
            for i in [*quoted, len(texts)]:
                counts = [c + (i - before if s == OUT else 0) for c, s in zip(counts, states)]
                if i < len(texts):
                    counts = [c + (s == OUT) for c, s in zip(counts, states)]
                    states = [after(texts[i].lstrip("\\ufeff") if where[1] == 0 else texts[i], s, seps[k // 2]) for k, s in enumerate(states)]
                before = i + 1
        if now is not None:
            yield row()

    return lines.mapInArrow(run, BLOCK)


def first_record(head: list[str], sep: str) -> tuple[int, list[str]] | None:
    """(number, cells) of the first record of a file's first lines that isn't blank; None if they don't hold one as a whole."""
    state, pieces, record = OUT, [], -1
    for text in head:
        if state == OUT:
            pieces, record = [], record + 1
        pieces.append(text)
        state = after(text, state, sep)
        if state == OUT and not blank(found := cells_of("\\n".join(pieces), sep)):
            return record, found
    return None


PLAN = "file string, block long, sep string, state int, record long, header long, skip long, names array<string>, fault string, several boolean"


def named(cells: list[str]) -> bool:
    """Whether a first record names the columns: it has a cell with a value."""
    return any(c.strip(" \t\n\x0b\x0c\r").lower() not in V.NULL_WORDS for c in cells)


def planned(made: DataFrame, seps: list[str]) -> DataFrame:
    """A row for each block: its delimiter, state and first record, and of its file: the first record that isn't blank (-1: not in its first lines), the record that is left out as it names the columns, and what is wrong; names on the file's first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        head = list(pdf["head"].iloc[0])
        k = seps.index(delimiter_of(head)) if len(seps) > 1 else 0
        state, record, rows = OUT, 0, []
        for file, block, ends, records in zip(pdf["file"], pdf["block"], pdf["ends"], pdf["records"]):
            rows.append((file, block, seps[k], state, record))
            if state != BROKEN:
                record += int(records[2 * k + state])
                state = int(ends[2 * k + state])
        first = first_record(head, seps[k])
        out = pd.DataFrame(rows, columns=["file", "block", "sep", "state", "record"])
        out["header"], out["skip"] = (-1, -1) if first is None else (first[0], first[0] if named(first[1]) else -1)
        out["names"] = [None if first is None else first[1]] + [None] * (len(out) - 1)
        out["fault"] = {OUT: None, IN: "a quoted field is never closed", BROKEN: "a quoted field isn't followed by a delimiter"}[state]
        out["several"] = record < pdf["lines"].sum()
        return out

    return made.groupBy("file").applyInPandas(run, PLAN)


def cut(lines: DataFrame, plan: DataFrame, n_blocks: int) -> DataFrame:
    """(file_no, record, cells, block, line, text, sep): a row for each record that is a line, with its cells, and for each line of those that aren't, with its text. Blank records and those that name the columns are left out."""
    own = plan.select("file", "block", "file_no", "sep", "state", "record", "skip")
    if n_blocks <= PLANNED:
        placed = lines.join(F.broadcast(own), ["file", "block"])
    else:
        placed = lines.join(own, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "line")
    names = ["file_no", "record", "cells", "block", "line", "text", "sep"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        now, state, record = None, OUT, 0
        for batch in batches:
            facts = [batch.column(c).to_pylist() for c in ("file_no", "block", "sep", "state", "record", "skip", "line", "text")]
            out = []
            for file_no, block, sep, begins, first, skip, line, text in zip(*facts):
                if (file_no, block) != now:
                    now, state, record = (file_no, block), begins, first
                opens = state == OUT
                record += opens  # records begun so far; this line is of the last of them
                if '"' in text:
                    state = after(text, state, sep)
                if record - 1 == skip:
                    continue
                if opens and state == OUT:
                    cells = cells_of(text, sep)
                    if not blank(cells):
                        out.append((file_no, record - 1, cells, None, None, None, None))
                else:
                    out.append((file_no, record - 1, None, block, line, text, sep))
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return placed.mapInArrow(run, "file_no long, record long, cells array<string>, block long, line long, text string, sep string")


def whole(pieces: DataFrame) -> DataFrame:
    """(file_no, record, cells) of records that go over lines, from their lines."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "text"))), lambda p: p["text"]), "\n")
    joined = pieces.groupBy("file_no", "record").agg(text.alias("text"), F.first("sep").alias("sep"))

    def run(batches):
        for batch in batches:
            cells = [cells_of(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("sep").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("file_no"), batch.column("record"), pa.array(cells, pa.list_(pa.string()))], names=["file_no", "record", "cells"])

    return joined.mapInArrow(run, "file_no long, record long, cells array<string>").where(F.btrim(F.array_join("cells", "")) != "")


class Source:
    """The files of a path, planned: raises ValueError for one with broken quotes."""

    def __init__(self, spark: SparkSession, path: str, delimiter: str | None = None):
        seps = [delimiter] if delimiter else DELIMITERS
        self.lines = lines_of(spark, path)
        made = written(planned(blocks(self.lines, seps), seps), "blocks")
        numbers = made.select("file").distinct().withColumn("file_no", F.row_number().over(Window.orderBy("file")).cast("long"))
        self.plan = written(made.join(F.broadcast(numbers), "file"), "plan")
        broken = self.plan.where("fault is not null").orderBy("file").limit(1).collect()
        if broken:
            raise ValueError(f"{broken[0].file}: {broken[0].fault}")
        self.n_blocks = self.plan.count()
        if self.plan.where("header < 0").limit(1).count():
            self._look_further()

    def _look_further(self) -> None:
        """Files whose first lines hold no record: the first one anywhere."""
        late = self.plan.where("header < 0").select("file_no").distinct()
        first = self.records().join(late, "file_no", "left_semi").groupBy("file_no").agg(F.min("record").alias("_at"), F.min_by("cells", "record").alias("_names"))
        names = F.exists("_names", V.has_value)
        found = self.plan.join(written(first, "first-records"), "file_no", "left").withColumn("header", F.coalesce("_at", "header")).withColumn("skip", F.when(names, F.col("_at")).otherwise(F.col("skip")))
        self.plan = written(found.withColumn("names", F.when(F.col("block") == 0, F.coalesce("names", "_names"))).drop("_at", "_names"), "plan")

    def records(self) -> DataFrame:
        """(file_no, record, cells): all records but blank ones and those that name the columns."""
        made = cut(self.lines, self.plan, self.n_blocks)
        plain = made.where("cells is not null").select("file_no", "record", "cells")
        return plain.unionByName(whole(made.where("cells is null"))) if self.plan.where("several").limit(1).count() else plain

    def delimiters(self) -> DataFrame:
        return self.plan.where("block = 0").select("file", "sep")

    def names(self) -> list[str] | None:
        """The names that the first file with a record gives; None if it gives none."""
        first = self.plan.where("block = 0 and names is not null").orderBy("file_no").limit(1).collect()
        if not first or first[0].skip < 0:
            return None
        trimmed = [c.strip(" \t\n\x0b\x0c\r") for c in first[0]["names"]]
        return [c if named([c]) else f"Column_{i + 1}" for i, c in enumerate(trimmed)]


def table(spark: SparkSession, path: str, delimiter: str | None = None, order: str | None = None) -> DataFrame:
    """All cells of the files of a path as text, null for an empty one; `order` names a column for a row's place.

    Each file has its own delimiter and header; columns go by position and have the names of the first
    file with a row. With a header a table is as wide as that, without one as its longest row; files
    without any row add none.
    """
    from ..operators.melt import safe_names

    source = Source(spark, path, delimiter)
    rows, names = source.records(), source.names()
    if names is None:
        width = rows.agg(F.max(F.size("cells"))).first()[0] or 0
        names = [f"Column_{i + 1}" for i in range(width)]
    cells = [F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(name) for i, name in enumerate(safe_names(names))]
    place = [(F.col("file_no") * F.lit(1 << 40) + F.col("record")).alias(order)] if order else []
    return rows.select(*cells, *place)
