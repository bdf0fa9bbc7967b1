"""Line dedup: range-partitioned line hashes, first occurrences streamed.

DataFrame and SQL functions only.  Every text is split at line feeds (null or
empty: one empty line).  A line's key is the line without ``[\\x20\\x09-\\x0D]``
at both ends and with A-Z lower-cased; keys of ``min_chars`` code points or
more that at least ``min_docs`` documents hold lose all their lines except in
the document with the largest doc_id among them.

1. One row per eligible line: ``(key hash, doc, position)``, written once.
   The hash is the key's 128-bit MD5.
2. The rows are range-partitioned on (hash, salt) and sorted inside each
   partition by document (largest first) and position; a window streams over
   each (hash, salt) run and marks where a document first holds the line.  The
   salt comes from the document, so a line held by a third of all documents is
   spread over ``salts`` runs.
3. Each run is summed up in one row; the rows of one hash (at most ``salts``)
   give its document count and its keeper.
4. The lines of repeated hashes but their keeper's join back on (hash, salt)
   and become, per document, a keep bitmap in run-length form: alternating
   lengths of kept and dropped lines, starting with kept, ending with the last
   dropped run.  Text is not shuffled up to here.

Defined cases.  Null text is the empty text.  Rows that share a doc_id are
separate texts but one document in the counts; which of them holds a line
does not matter.  A null doc_id counts as one document that is smaller than
all others.  Lines that repeat inside their keeper all stay.  Extra columns
of ``docs`` are carried by ``drop_lines`` and not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlens.session import materialize

STRIP = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text):
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line):
    """Stripped and with A-Z lower-cased; ``lower`` is exact on ASCII lines."""
    bare = F.btrim(line, F.lit(STRIP))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(
        F.translate(bare, UPPER, LOWER))


def text_id(text):
    """Tells texts under one doc_id apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def line_hashes(docs: DataFrame, min_chars: int, salts: int) -> DataFrame:
    """``(h, salt, id, doc, pos)`` of every line long enough to count."""
    long_enough = F.char_length(F.btrim(F.col("line"), F.lit(STRIP))) >= min_chars
    return (docs.select(F.col("doc_id").cast("long").alias("doc"), text_id(F.col("text")).alias("id"),
                        F.posexplode(lines(F.col("text"))).alias("pos", "line"))
                .where(long_enough)
                .select(F.unhex(F.md5(line_key(F.col("line")).cast("binary"))).alias("h"),
                        F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int").alias("salt"), "id", "doc", "pos"))


def repeated(hashes: DataFrame, min_docs: int) -> DataFrame:
    """``(h, salt, keeper)`` for each run of a hash that ``min_docs`` documents hold."""
    ranged = hashes.repartitionByRange("h", "salt")
    stream = Window.partitionBy("h", "salt").orderBy(F.col("doc").desc(), "pos")
    before = F.lag(F.struct("doc")).over(stream)
    first = (before.isNull() | ~before["doc"].eqNullSafe(F.col("doc"))).cast("int")
    runs = (ranged.select("h", "salt", "doc", first.alias("first")).groupBy("h", "salt")
                  .agg(F.sum("first").alias("n"), F.max("doc").alias("top")))
    total = Window.partitionBy("h")          # at most `salts` rows each
    return (runs.select("h", "salt", F.sum("n").over(total).alias("n"), F.max("top").over(total).alias("keeper"))
                .where(F.col("n") >= min_docs).select("h", "salt", "keeper"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, salts: int = 64) -> DataFrame:
    """``(doc, id, rle, n_dropped)`` for every text that loses lines."""
    hashes = materialize(line_hashes(docs, min_chars, salts), "line-hashes")
    again = repeated(hashes, min_docs)
    gone = (hashes.join(again, ["h", "salt"]).where(~F.col("doc").eqNullSafe(F.col("keeper")))
                  .select("doc", "id", "pos").distinct())
    mine = Window.partitionBy("doc", "id").orderBy("pos")
    runs = (gone.withColumn("run", F.col("pos") - F.row_number().over(mine))
                .groupBy("doc", "id", "run").agg(F.min("pos").alias("at"), F.count(F.lit(1)).cast("int").alias("len")))
    gaps = runs.withColumn("gap", F.col("at") - F.coalesce(F.lag(F.col("at") + F.col("len")).over(
        Window.partitionBy("doc", "id").orderBy("at")), F.lit(0)))
    return (gaps.groupBy("doc", "id")
                .agg(F.sort_array(F.collect_list(F.struct("at", "gap", "len"))).alias("runs"),
                     F.sum("len").alias("n_dropped"))
                .select("doc", "id", F.flatten(F.transform("runs", lambda r: F.array(r["gap"], r["len"]))).alias("rle"),
                        "n_dropped"))


def kept_text(text, rle):
    """The text without its dropped lines; a null bitmap keeps every line."""
    flags = F.flatten(F.transform(rle, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    left = F.zip_with(lines(text), flags, lambda line, keep: F.when(F.coalesce(keep, F.lit(True)), line))
    return F.when(rle.isNull(), F.coalesce(text.cast("string"), F.lit(""))).otherwise(F.array_join(left, "\n"))


def drop_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``__kept`` (the text left) and ``__rle``, ``__dropped``."""
    b = bitmaps.select(F.col("doc").alias("__doc"), F.col("id").alias("__id"), F.col("rle").alias("__rle"),
                       F.col("n_dropped").alias("__dropped"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (text_id(F.col("text")) == F.col("__id"))
    out = docs.join(b, same, "left").drop("__doc", "__id")
    return out.withColumn("__kept", kept_text(F.col("text"), F.col("__rle")))
