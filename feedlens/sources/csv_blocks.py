"""CSV records of splittable files, quoted newlines included.

Spark's text reader cuts a file into blocks at line ends, wherever quotes are.
What a line does to the reader's state (at a record's start, or inside quotes)
is a function of two states, and so is what a block does; functions compose, so
one pass over the lines gives a small row per block, a window over those rows
gives the state in which each block starts, and a second pass cuts each block
into records by itself.  Only a record that crosses a block border comes in
pieces, which meet by file and block.  A file of any size is parsed by as many
tasks as it has blocks.

The state is exact for what the CSV parser accepts, not only for balanced
quotes: a quote inside a field that does not begin with one is text, and what
follows a closing quote belongs to the field up to the comma.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARK = "\ufeff"       # some files begin with it
_INSIDE = r'(?:[^"]|"")*+'
#: from a field's start: whole fields, then one whose quote stays open
OPENS = re.compile(rf'(?:(?:"{_INSIDE}"[^,]*+|[^",][^,]*+|),)*+"{_INSIDE}\Z')
#: from inside quotes: the rest of that field
CLOSES = re.compile(rf'{_INSIDE}"[^,]*+(,|\Z)')


def after(line: str, inside: bool) -> bool:
    """Whether a line that starts (not) inside quotes ends inside quotes."""
    if not inside:
        return OPENS.match(line) is not None
    m = CLOSES.match(line)
    return m is None or (m[1] == "," and OPENS.match(line, m.end()) is not None)


def lines_of(spark: SparkSession, files) -> DataFrame:
    """``(value, file, block)`` of every line; a block's lines follow each other."""
    return (spark.read.option("lineSep", "\n").text(files)
            .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")))


def _runs(batches, width: int):
    """``(key, lines, has a quote)``: the batches' lines by runs of equal ``(file, block, ...)``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column("value")
        quoted = pc.match_substring(values, '"').to_pylist()
        values, keys = values.to_pylist(), list(zip(*(c.to_pylist() for c in batch.columns[1:width]), strict=True))
        lo = 0
        while lo < len(keys):
            hi = lo + 1
            if keys[-1] == keys[lo]:
                hi = len(keys)
            else:
                while keys[hi] == keys[lo]:
                    hi += 1
            yield keys[lo], values[lo:hi], quoted[lo:hi]
            lo = hi


def blocks(lines: DataFrame, multi_line: bool) -> DataFrame:
    """``(file, block, outside, inside, header)``: whether a block that starts outside
    (inside) quotes ends inside them, and the first record of a file's first block."""
    def run(batches):
        held = []
        at, out, ins, header, done = None, False, True, [], False

        def close():
            whole = "\n".join(header) if done else None
            held.append((*at, out, ins, whole if at[1] == 0 else None))

        for key, values, quoted in _runs(batches, 3):
            if key != at:
                if at is not None:
                    close()
                at, out, ins, header, done = key, False, multi_line, [], False
                if at[1] == 0:
                    values[0] = values[0].lstrip(MARK)
            for line, q in zip(values, quoted, strict=True):
                before = out
                if q and multi_line:
                    same = out == ins
                    out = after(line, out)
                    ins = out if same else after(line, ins)
                if not done and at[1] == 0 and (before or line.rstrip("\r")):
                    header.append(line)
                    done = not out
        if at is not None:
            close()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)],
                                             ["file", "block", "outside", "inside", "header"])

    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
    return lines.mapInArrow(run, "file string, block long, outside boolean, inside boolean, header string")


def starts(table: DataFrame) -> DataFrame:
    """``(file, block, started)``: whether each block of ``blocks`` starts inside quotes.

    The last earlier block that ends alike from both states decides, turned
    over by every block since that ends in the state it did not start in."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum((F.col("outside") & ~F.col("inside")).cast("int")).over(before), F.lit(0))
    t = table.withColumn("turns", turns)
    known = F.last(F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").cast("int").alias("v"), "turns")), True).over(before)
    t = t.withColumn("known", known)
    state = F.coalesce(F.col("known.v") + F.col("turns") - F.col("known.turns"), F.col("turns"))
    return t.select("file", "block", (state % 2 == 1).alias("started"))


def records(spark: SparkSession, files, started: DataFrame, multi_line: bool) -> DataFrame:
    """``(file, block, row, record)`` of every record but the header and empty lines;
    ``row`` counts the records that start in a block.

    ``started`` has one row a file block: at the least block size it is smaller
    than the files by that factor, and is sent to every task."""
    lines = lines_of(spark, files).join(F.broadcast(started), ["file", "block"]).select("value", "file", "block", "started")

    def run(batches):
        out, size = [], 0
        at, inside, row, parts, head, header = None, False, 0, [], False, False

        def flush():
            nonlocal out, size
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                                               ["file", "block", "row", "part", "record"])
            out, size = [], 0
            return batch

        def put(part):
            nonlocal row, parts, head, header, size
            text = "\n".join(parts)
            parts = []
            if head:                       # the rest of an earlier block's record
                head = False
                out.append((at[0], at[1], -1, "more", text))
            elif part == "whole" and not text.rstrip("\r"):
                return
            elif header:
                header = False
                return
            else:
                out.append((at[0], at[1], row, part, text))
                row += 1
            size += len(text) + 60

        for key, values, quoted in _runs(batches, 4):
            if key != at:
                if parts:
                    put("open")
                at, inside, row, parts = key, bool(key[2]), 0, []
                head, header = inside, key[1] == 0
                if header:
                    values[0] = values[0].lstrip(MARK)
            for line, q in zip(values, quoted, strict=True):
                parts.append(line)
                if q and multi_line:
                    inside = after(line, inside)
                if not inside:
                    put("whole")
                    if size > 4 << 20:
                        yield flush()
        if parts:
            put("open")
        if out:
            yield flush()

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    cut = lines.mapInArrow(run, "file string, block long, row long, part string, record string")
    if not multi_line:
        return cut.select("file", "block", "row", F.regexp_replace("record", "\r$", "").alias("record"))
    by = Window.partitionBy("file").orderBy("block", "row")
    pieces = cut.where("part <> 'whole'").withColumn("of", F.last(F.when(F.col("part") == "open", F.struct("block", "row")), True).over(by))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "row", "record"))), lambda p: p["record"]), "\n")
    joined = pieces.groupBy("file", "of").agg(text.alias("record")).select("file", "of.block", "of.row", "record")
    whole = cut.where("part = 'whole'").select("file", "block", "row", "record").unionByName(joined)
    return whole.withColumn("record", F.regexp_replace("record", "\r$", ""))
