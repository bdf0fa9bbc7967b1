"""File sources: labelled CSV, unlabelled batch CSV, text lines, examples.

CSV is read with every column as a string (no schema inference, so a text
that looks numeric stays text), RFC-4180 quotes (``""`` inside quotes) and,
with ``multi_line``, quoted newlines.  Files are cut into records block by
block (``csv_blocks``), so a large file is parsed by many tasks whatever its
quotes hold, and headers come from the same pass.  Files of one folder may
order their columns differently: files are grouped by header and each group
has its own schema.  Rows that do not fit their header are counted; they
raise, or are left out and reported, as the caller says.

The rows are parsed once and written as Parquet with a dense row number
(``ord``: file by path, then position), so everything after the parse is split
and a second read costs no parsing.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlens.functions import fixed
from feedlens.functions.text import na_to_null, ustrip
from feedlens.session import materialize
from feedlens.sources import csv_blocks

BAD = "_malformed"


def header_groups(table: DataFrame) -> list[tuple[list[str], list[str]]]:
    """``(columns, files)`` for each distinct header, names stripped (P1), from
    the first records that ``csv_blocks.blocks`` found."""
    files = sorted((r["file"], r["header"]) for r in table.where("block = 0").select("file", "header").collect())   # one short row a file
    by: dict[str, list[str]] = {}
    for f, h in files:
        if h is None:
            raise ValueError(f"{f} has no header, or one longer than a block")
        by.setdefault(h, []).append(f)
    return [([c.strip() for c in next(csv.reader(io.StringIO(h.rstrip("\r"), newline="")))], fs) for h, fs in by.items()]


def parse_csv(spark: SparkSession, path, want: tuple[str, ...], multi_line: bool = True,
              malformed: str = "fail") -> DataFrame:
    """The written rows ``(ord, *columns of all files)`` of CSV files.

    ``want`` columns must be in every header.  ``malformed``: ``fail`` raises
    if any row does not fit its header, ``drop`` leaves such rows out; the
    count is the attribute ``malformed`` of the result."""
    if malformed not in ("fail", "drop"):
        raise ValueError("malformed must be 'fail' or 'drop'")
    found = materialize(csv_blocks.blocks(csv_blocks.lines_of(spark, path), multi_line), "csv-blocks")
    groups = header_groups(found)
    if not groups:
        raise ValueError(f"no CSV file with a header in {path}")
    for names, files in groups:
        missing = [c for c in want if c not in names]
        if missing:
            raise ValueError(f"{files[0]} has no column {', '.join(map(repr, missing))}")
    columns = list(dict.fromkeys(c for names, _ in groups for c in names))
    order = {f: i for i, f in enumerate(sorted(f for _, fs in groups for f in fs))}
    rows, started = None, csv_blocks.starts(found)
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    for names, files in groups:
        schema = ", ".join([*[f"`{c}` string" for c in names], f"{BAD} string"])
        part = csv_blocks.records(spark, files, started, multi_line).withColumn("_r", F.from_csv("record", schema, options))
        part = part.select(*[F.col("_r").getField(c).alias(c) if c in names else F.lit(None).cast("string").alias(c) for c in columns],
                           F.col("_r").getField(BAD).alias(BAD), F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("row").alias("_row"))
        rows = part if rows is None else rows.unionByName(part)
    rows = materialize(rows, "csv-rows")
    bad = rows.where(F.col(BAD).isNotNull()).count()
    if bad and malformed == "fail":
        raise ValueError(f"{bad} CSV rows do not fit their header")
    good = rows.where(F.col(BAD).isNull()).drop(BAD)
    out = numbered(good, order)
    out.malformed = bad
    return out


def numbered(rows: DataFrame, order: dict[str, int]) -> DataFrame:
    """``ord``: the dense number of each row by file, block and position.

    One small row per file block gives the offsets; they are smaller than the
    files by the size of a block and are sent to every task, so no row moves."""
    spark = rows.sparkSession
    names = spark.createDataFrame(list(order.items()), "_file string, _at int")
    blocks = rows.groupBy("_file", "_block").agg(F.min("_row").alias("_first"), F.max("_row").alias("_last"),
                                                 F.count(F.lit(1)).alias("_n")).join(names, "_file")
    before = Window.orderBy("_at", "_block").rowsBetween(Window.unboundedPreceding, -1)
    off = blocks.select("_file", "_block", F.coalesce(F.sum(F.col("_last") - F.col("_first") + 1).over(before), F.lit(0)).alias("_off"), "_first")
    j = rows.join(F.broadcast(off), ["_file", "_block"])
    return j.select((F.col("_off") + F.col("_row") - F.col("_first")).alias("ord"),
                    *[F.col(f"`{c}`") for c in rows.columns if c not in ("_file", "_block", "_row")])


def read_feedback_csv(spark: SparkSession, path, multi_line: bool = True,
                      na_values=fixed.PANDAS_NA_VALUES, malformed: str = "fail") -> DataFrame:
    """Labelled feedback ``(ord, ..., text, sentiment, ...)``.

    Pandas' missing-value strings become null, so the prepare step turns them
    into ``'nan'`` as the original does."""
    df = parse_csv(spark, path, ("text", "sentiment"), multi_line, malformed)
    out = df.withColumns({c: na_to_null(F.col(c), na_values) for c in ("text", "sentiment")})
    out.malformed = df.malformed
    return out


def read_batch_csv(spark: SparkSession, path, multi_line: bool = True,
                   na_values=fixed.PANDAS_NA_VALUES, malformed: str = "fail") -> DataFrame:
    """Unlabelled batch ``(ord, text)``; the headers must have a ``text``
    column.  Texts are not cleaned (a null becomes ``'nan'`` and is scored, as
    in the original)."""
    df = parse_csv(spark, path, ("text",), multi_line, malformed)
    out = df.select("ord", F.coalesce(na_to_null(F.col("text"), na_values), F.lit(fixed.NULL_TEXT)).alias("text"))
    out.malformed = df.malformed
    return out


def split_lines(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """S3 on a column: one row per line (split on ``\\n``), stripped, blank
    lines dropped; ``line_no`` keeps the position inside the text."""
    ex = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    ex = ex.withColumn("line", ustrip(F.col("line")))
    return ex.filter(F.char_length("line") > 0)


def read_text_lines(spark: SparkSession, path) -> DataFrame:
    """S3 on files: ``(ord, text)``, one text per line, stripped, blank lines
    dropped; written once, like the CSV rows."""
    df = spark.read.option("lineSep", "\n").text(path)
    df = df.select(ustrip(F.col("value")).alias("text"), F.col("_metadata.file_path").alias("_file"),
                   F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    rows = materialize(df.filter(F.char_length("text") > 0), "text-lines")
    files = sorted(r["_file"] for r in rows.select("_file").distinct().collect())
    return numbered(rows, {f: i for i, f in enumerate(files)})


def examples(spark: SparkSession) -> DataFrame:
    """The example catalogue flattened to ``(category, idx, text)``."""
    rows = [(cat, i, t) for cat, texts in fixed.EXAMPLES.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "category string, idx int, text string")
