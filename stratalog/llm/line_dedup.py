"""Line deduplication: keep bitmaps from one pass over sorted line hashes.

Hashes of long enough lines are range-partitioned by (hash, document descending, text) and sorted, so the first
document of a run of equal hashes is the one that keeps its lines, and a run is judged by streaming past it. Ranges
split a hash that very many documents hold; what a partition knows of the runs at its two ends is a row each, and
those rows together decide such runs. Texts are not shuffled for that: what comes out are bitmaps of kept lines.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm._common import column, fresh, partitions_for, prepare, python_texts, tidied, written

_TRIM = " \t\n\x0b\x0c\r"
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MIN_CHARS, MIN_DOCS = 40, 5
PART_BYTES = 16 << 20


def line_key(line: str) -> str:
    return line.strip(_TRIM).translate(_UPPER)


def packed(keep: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpacked(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=n).astype(bool)


def line_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, n_lines, keep): a compressed bitmap for each row of ``docs`` that loses lines.

    Lines whose key has ``min_chars`` code points or more and is found in ``min_docs`` documents or more are lost
    except in the largest doc_id that holds it. Rows with one doc_id count as one document; null is a document, the
    smallest. Null text: one empty line. Ids are read as whole numbers, and one that is none fails the job. Repeated
    rows share a bitmap; texts of any length are read whole; an empty table gives no bitmaps; columns beside doc_id and
    text, whatever their names, are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(column(docs, "doc_id").cast("long").alias("doc_id"), column(docs, "text").alias("text"), F.xxhash64(column(docs, "text")).alias("mark"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys, places, counts = [], [], [], []
            for row, text in enumerate(python_texts(batch.column(1))):
                lines = text.split("\n")
                found: dict[str, list[int]] = {}
                for place, line in enumerate(lines):
                    if len(line) >= min_chars and len(key := line_key(line)) >= min_chars:
                        found.setdefault(key, []).append(place)
                for key, where in found.items():
                    at.append(row)
                    keys.append(hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    places.append(where)
                    counts.append(len(lines))
            of = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(0).take(of), batch.column(2).take(of), pa.array(places, pa.list_(pa.int32())), pa.array(counts, pa.int32())], ["h", "doc_id", "text_hash", "places", "n_lines"])

    parts = partitions_for(docs, PART_BYTES)
    order = ["h", F.col("doc_id").desc_nulls_last(), "text_hash"]
    lines = rows.mapInArrow(tidied(hashes), "h binary, doc_id long, text_hash long, places array<int>, n_lines int")
    # Written first: finding the ranges' bounds reads them once more, which must not hash all texts again.
    held = written(written(lines, "hashes").repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "lines")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first and the last run of each file, or of what a task reads of it."""
        out: list[list] = []  # hash, documents, largest, smallest
        first = last = None
        here = -1
        for batch in batches:
            for h, doc, part in zip(*(batch.column(c).to_pylist() for c in ("h", "doc_id", "part")), strict=True):
                if part != here:
                    out += [x for x in (first, last) if x is not None]
                    here, first, last = part, None, None
                if last is None or last[0] != h:
                    if first is None:
                        first, last = last, None
                    last = [h, 1, doc, doc]
                elif doc != last[3]:
                    last[1] += 1
                    last[3] = doc
        out += [x for x in (first, last) if x is not None]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), *[pa.array([x[k] for x in out], pa.int64()) for k in (1, 2, 3)]], ["h", "n", "high", "low"])

    # Two rows a file: bounded by the number of partitions.
    ends: dict[bytes, list] = {}
    for r in held.mapInArrow(edges, "h binary, n long, high long, low long").collect():
        ends.setdefault(bytes(r["h"]), []).append((r["n"], r["high"], r["low"]))
    rank = lambda x: (x is not None, x or 0)
    decided: dict[bytes, tuple[int, int | None]] = {}
    for h, got in ends.items():
        got.sort(key=lambda x: (rank(x[1]), rank(x[2])), reverse=True)
        n = sum(x[0] for x in got) - sum(a[2] == b[1] for a, b in zip(got, got[1:], strict=False))  # a document cut in two
        decided[h] = (n, got[0][1])

    def drops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list = []  # rows of the present run while it may still have too few documents
        state = {"h": None, "n": 0, "top": None, "doc": None, "sure": False}

        def out(found: list) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) if found else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int32())), pa.array(cols[3], pa.int32())], ["doc_id", "text_hash", "places", "n_lines"])

        for batch in batches:
            found: list = []
            cols = [batch.column(c).to_pylist() for c in ("h", "doc_id", "text_hash", "places", "n_lines")]
            for h, doc, mark, places, n_lines in zip(*cols, strict=True):
                if h != state["h"]:
                    run = []
                    n, top = decided.get(h, (None, doc))
                    state = {"h": h, "n": 1, "top": top, "doc": doc, "sure": n is not None and n >= min_docs, "never": n is not None and n < min_docs}
                elif doc != state["doc"]:
                    state["n"] += 1
                    state["doc"] = doc
                if state.get("never"):
                    continue
                if not state["sure"] and state["n"] >= min_docs:
                    state["sure"] = True
                    found += run
                    run = []
                if doc != state["top"]:
                    (found if state["sure"] else run).append((doc, mark, places, n_lines))
            yield out(found)

    lost = held.mapInArrow(tidied(drops), "doc_id long, text_hash long, places array<int>, n_lines int")

    def bitmap(places: list, n_lines: int) -> bytes:
        keep = np.ones(n_lines, bool)
        keep[[p for x in places for p in x]] = False
        return packed(keep)

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_lines").to_pylist()
            bits = [bitmap(p, k) for p, k in zip(batch.column("places").to_pylist(), n, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int32()), pa.array(bits, pa.binary())], ["doc_id", "text_hash", "n_lines", "keep"])

    grouped = lost.groupBy("doc_id", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.collect_list("places").alias("places"))  # one text's lines
    return grouped.mapInArrow(tidied(bitmaps), "doc_id long, text_hash long, n_lines int, keep binary")


def _joined(docs: DataFrame, bitmaps: DataFrame) -> tuple[DataFrame, str]:
    """Rows of ``docs`` with their bitmap. A hash of the text tells rows that share a doc_id apart; equal rows are alike."""
    mark, keep, of, of_mark = fresh(docs, "text_mark", "keep_bits", "keep_doc", "keep_mark")
    right = bitmaps.select(F.col("doc_id").alias(of), F.col("text_hash").alias(of_mark), F.col("keep").alias(keep))
    left = docs.withColumn(mark, F.xxhash64(column(docs, "text")))
    joined = left.join(right, F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.col(mark) == F.col(of_mark)), "left")
    return joined.select(*[f"`{c}`" for c in docs.columns], keep), keep


def kept_text(text: str | None, bits: bytes | None) -> tuple[str, int, int]:
    lines = (text or "").split("\n")
    if bits is None:
        return text or "", len(lines), 0
    keep = unpacked(bits, len(lines))
    return "\n".join(x for x, k in zip(lines, keep, strict=True) if k), len(lines), int((~keep).sum())


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with repeated lines gone from ``text`` (and ``n_chars``, where it is a column, counted anew).

    Every row stays, one that loses all lines with an empty text; null text stays null. Other columns, whatever their
    names, are unchanged; an empty table stays empty.
    """
    joined, keep = _joined(docs, line_bitmaps(docs, min_chars, min_docs))
    names = docs.columns
    at, bits_at = names.index("text"), len(names)

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns)
            bits = cols.pop(bits_at).to_pylist()
            texts = cols[at].to_pylist()
            new = [t if b is None else kept_text(t, b)[0] for t, b in zip(texts, bits, strict=True)]
            cols[at] = pa.array(new, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    out = joined.mapInArrow(tidied(applied), docs.schema)
    if "n_chars" in names:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_dropped and the SHA-256 of what stays."""
    narrow = docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "text").alias("text"))
    kind = dict(narrow.dtypes)["doc_id"]
    joined, _ = _joined(narrow, line_bitmaps(narrow, min_chars, min_docs))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [kept_text(t, b) for t, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64()), pa.array([hashlib.sha256(x[0].encode("utf-8", "surrogatepass")).hexdigest() for x in got], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return joined.mapInArrow(tidied(told), f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")
