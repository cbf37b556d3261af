"""Best-two-fit packing of tokenized documents into sequences of a fixed length.

Pieces as long as a sequence are sequences by themselves. The others are dealt at random to partitions, and each
partition fills its bins: greedily with the longest piece that fits, then the bin's smallest piece is exchanged for
two unpacked pieces if those fill the gap that opens more tightly. Pieces of one length are alike, so the work is on
counts of lengths, and only lengths and checksums are shuffled, no ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm._bpe import encoded, ids_crc32
from stratalog.llm._common import column, partitions_for, prepare, tidied

LENGTH = 2048
#: Stored bytes of input whose pieces one partition packs; a partition wastes one or two bins.
PACK_BYTES = 16 << 20
_PIECES = "piece int, start long, length long, ids_crc32 long"


def fill_bins(counts: np.ndarray, length: int = LENGTH) -> list[list[int]]:
    """Bins of piece lengths for ``counts[n]`` pieces of each length n from 1 to ``length``; uses up ``counts``."""
    counts = counts.copy()
    present = np.flatnonzero(counts)

    def fits(gap: int) -> int:
        """The longest length there is up to ``gap``, or 0."""
        k = int(np.searchsorted(present, gap, "right"))
        return int(present[k - 1]) if k else 0

    def take(n: int, by: int = 1) -> None:
        nonlocal present
        was = counts[n]
        counts[n] -= by
        if (was > 0) != (counts[n] > 0):
            present = np.flatnonzero(counts)

    bins: list[list[int]] = []
    while len(present):
        own, gap = [], length
        while gap and (n := fits(gap)):
            own.append(n)
            take(n)
            gap -= n
        if gap and len(own) > 1 and len(present):
            least = own[-1]
            room = gap + least
            first = present[: int(np.searchsorted(present, room - 1, "right"))]
            first = first[first * 2 <= room]
            if len(first):
                k = np.searchsorted(present, room - first, "right") - 1
                second = present[k]
                second = np.where((second == first) & (counts[first] < 2), 0, second)
                sums = np.where(second >= first, first + second, 0)
                i = int(sums.argmax())
                if sums[i] > least:
                    a, b = int(first[i]), int(second[i])
                    own.pop()
                    take(least, -1)
                    take(a)
                    take(b)
                    own += [b, a]
        bins.append(own)
    return bins


def token_pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32. Only documents over ``length`` ids (the end id counts) are
    cut; their first piece is the shorter one. Null texts are empty: one piece with the end id alone. Texts of any
    length are encoded whole."""
    prepare(docs.sparkSession)
    rows = docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "text").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for row, ids in encoded(vocabulary, batch.column(1)):
                n = len(ids)
                starts = [0, *range(n % length or length, n, length)]
                for k, s in enumerate(starts):
                    e = starts[k + 1] if k + 1 < len(starts) else n
                    at.append(row)
                    out.append((k, s, e - s, ids_crc32(ids[s:e])))
            if out:
                piece, start, size, crc = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(tidied(cut), f"doc_id {kind}, {_PIECES}")


def pack_documents(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """The pieces of :func:`token_pieces` with ``sequence_id`` and ``offset``; offsets in a sequence have no gaps.

    Repeated rows are packed as often as they stand; pieces are dealt by their own hash and the task that read them, so
    that equal ones spread too, and however a task's rows come they are dealt alike. An empty table gives an empty
    result; columns beside doc_id and text, whatever their names, are not read.
    """
    pieces = token_pieces(docs, vocabulary, length)
    kind = dict(pieces.dtypes)["doc_id"]
    parts = partitions_for(docs, PACK_BYTES, 1)
    spread = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "length", F.spark_partition_id()), F.lit(parts)).cast("int")
    dealt = pieces.withColumn("part", spread).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "length", "doc_id", "piece", "ids_crc32")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        part = int(table.column("part")[0].as_py())
        size = table.column("length").to_numpy()
        order = np.argsort(size, kind="stable")
        counts = np.bincount(size, minlength=length + 1)
        next_of = np.concatenate([[0], np.cumsum(counts)])[: length + 1]
        own_bins = [[length]] * int(counts[length])
        rest = counts.copy()
        rest[length] = 0
        own_bins += fill_bins(rest, length)
        sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for k, lengths in enumerate(own_bins):
            at = 0
            for n in lengths:
                row = order[next_of[n]]
                next_of[n] += 1
                sequence[row], offset[row] = (part << 33) + k, at
                at += n
        out = table.drop_columns(["part"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from out.to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(tidied(pack), f"doc_id {kind}, {_PIECES}, sequence_id long, offset long")
