"""Token ids in Parquet: one row a document, ids as a list column.

Texts are encoded where they are read; what is shuffled are ids. Ranges of doc_id become files, which Spark sorts and
writes without Python. Ids are dictionary-encoded and compressed, numbers are delta-encoded; row groups and pages are
kept small, so that with the pages' indexes a reader of some documents (:func:`read_documents`), or of the columns
beside the ids (:func:`document_starts`), reads little else.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm._bpe import encoded, ids_crc32
from stratalog.llm._common import column, partitions_for, prepare, written

#: Input bytes for each token file, as stored.
FILE_BYTES = 32 << 20
ROW_GROUP, PAGE = 8 << 20, 1 << 17
LAYOUT = {
    "compression": "zstd", "parquet.block.size": str(ROW_GROUP), "parquet.page.size": str(PAGE), "parquet.page.row.count.limit": "1000", "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20), "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#n_tokens": "false",
}
#: Ids that :func:`read_documents` puts into the scan's filter at most.
FILTER_IDS = 10_000


class Ranges:
    """Consecutive parts by doc_id. A point (known, id, after) begins a part; null is the smallest id.

    An id with more rows than a part is to hold has several parts to itself; which of them a row goes to is left to
    the caller, as these rows have no order by id.
    """

    def __init__(self, cuts: Sequence, hot: dict, parts: int, rows: int) -> None:
        points: dict[tuple, int] = {(True, c, 0): 1 for c in cuts}
        for key, n in hot.items():
            points[key is not None, key, 0] = max(1, -(-n * parts // max(1, rows)))
            points.setdefault((key is not None, key, 1), 1)
        self.points = sorted(points)
        widths = [1, *(points[p] for p in self.points)]
        self.first, self.widths = np.concatenate([[0], np.cumsum(widths)]).tolist(), widths
        self.parts = self.first.pop()

    def of(self, key) -> tuple[int, int]:
        """The first part for an id, and how many there are."""
        i = bisect_right(self.points, (key is not None, key, 0))
        return self.first[i], self.widths[i]


def id_ranges(docs: DataFrame, parts: int) -> Ranges:
    """About ``parts`` ranges with like numbers of rows. Only ids are read; the driver gets a row a part at most."""
    ids = docs.select(column(docs, "doc_id").alias("doc_id"))
    rows = ids.count()
    if parts <= 1 or not rows:
        return Ranges([], {}, 1, 1)
    # Fewer than ``parts`` ids can have more than rows / parts rows.
    hot = {r[0]: r[1] for r in ids.groupBy("doc_id").count().where(F.col("count") * parts > max(rows, parts)).collect()}
    cold = ids.where("doc_id is not null")
    if known := [k for k in hot if k is not None]:
        cold = cold.where(~F.col("doc_id").isin(known))
    cuts = cold.repartitionByRange(parts, "doc_id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("least")).collect()
    return Ranges([r["least"] for r in cuts], hot, parts, rows)


def write_token_files(docs: DataFrame, vocabulary: str) -> tuple[DataFrame, DataFrame]:
    """Write the ids of all texts in ascending doc_id order; returns the files' table and their manifest.

    Files: ``part``, ``doc_id``, ``n_tokens``, ``ids``, in the order of parts and within one of (doc_id, n_tokens).
    Manifest, a row a file: ``part`` (files in order), ``first_id``, ``start`` (ids in files before) and ``n_ids``.
    Null texts are empty and get their end id only; null ids come first; rows with equal ids are all written, in the
    order of their number of tokens and the checksum of these within a file. Texts of any length are read whole; an
    empty table gives files and a manifest without rows; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    ranges = id_ranges(docs, partitions_for(docs, FILE_BYTES))
    rows = docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "text").alias("text"), F.spark_partition_id().alias("task"))
    kind = dict(rows.dtypes)["doc_id"]

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [ids for _, ids in encoded(vocabulary, batch.column(1))]
            if not own:
                continue
            n = np.fromiter(map(len, own), np.int64, len(own))
            crc = [ids_crc32(x) for x in own]
            # An id's rows are dealt by checksum and task, so equal rows of a task stay together however they come.
            places = [first + (c + 40_503 * t) % width for (first, width), c, t in zip(map(ranges.of, batch.column(0).to_pylist()), crc, batch.column(2).to_pylist(), strict=True)]
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(own).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), batch.column(0), pa.array(n), pa.array(crc, pa.int64()), ids], ["part", "doc_id", "n_tokens", "crc", "ids"])

    dealt = rows.mapInArrow(tokens, f"part int, doc_id {kind}, n_tokens long, crc long, ids array<int>").repartitionById(ranges.parts, F.col("part"))
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", "crc").drop("crc")
    files = written(ordered, "tokens", **LAYOUT)
    totals = sorted((r["part"], r["first_id"], r["n_ids"]) for r in files.groupBy("part").agg(F.min("doc_id").cast("string").alias("first_id"), F.sum("n_tokens").alias("n_ids")).collect())  # a row a file
    before, listed = 0, []
    for part, first, n in totals:
        listed.append((part, first, before, n))
        before += n
    manifest = spark.createDataFrame(listed, "part int, first_id string, start long, n_ids long").coalesce(1)
    return files, manifest


def _started(rows: DataFrame, manifest: DataFrame, *tie: str) -> DataFrame:
    """``rows`` (part, doc_id, n_tokens and more) with ``start``, the ids of all documents before.

    The manifest has a row a file, and partitions_for allows 200,000 of these; so it is broadcast.
    """
    order = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "n_tokens", *tie).rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(manifest.select(F.col("part").alias("of"), F.col("start").alias("before")))
    within = rows.withColumn("local", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    return within.join(starts, F.col("part") == F.col("of")).withColumn("start", F.col("before") + F.col("local")).drop("of", "before", "local")


def document_starts(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens) of every document; the ids' column is not read."""
    return _started(files.select("part", "doc_id", "n_tokens"), manifest).select("doc_id", "start", "n_tokens")


def read_documents(files: DataFrame, ids: Sequence, columns: Sequence[str] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """The given columns of the documents with these ids; pages without them are skipped by their index.

    Up to FILTER_IDS ids go into the scan's filter, more into a join whose side Spark chooses.
    """
    wanted = sorted({i for i in ids if i is not None})
    if len(wanted) <= FILTER_IDS:
        return files.where(F.col("doc_id").isin(wanted)).select(*columns)
    table = files.sparkSession.createDataFrame([(i,) for i in wanted], f"doc_id {dict(files.dtypes)['doc_id']}")
    near = files.where(F.col("doc_id").between(wanted[0], wanted[-1]))
    return near.join(table, "doc_id", "left_semi").select(*columns)


def read_token_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, ``start`` in the whole sequence, ``n_tokens`` and ``ids_crc32``."""
    kind = dict(files.dtypes)["doc_id"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
            crc = [ids_crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["part", "doc_id", "n_tokens", "ids_crc32"])

    read = files.select("part", "doc_id", "ids").mapInArrow(summed, f"part int, doc_id {kind}, n_tokens long, ids_crc32 long")
    return _started(read, manifest, "ids_crc32").select("doc_id", "start", "n_tokens", "ids_crc32")
