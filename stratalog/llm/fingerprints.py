"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range is retained.

The sketch of two texts together is the union of their sketches, and as the fraction is the same for all documents,
containment of a short document in a very long one can be told from their sketches alone. The smallest hash is kept
in any case, so that only texts without words have an empty sketch.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm._common import column, partitions_for, prepare, shingle_hashes, text_chunks

#: One in so many hashes is kept.
SCALE = 4
SPAN_BYTES = 16 << 20


def sketch(hashes: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sorted distinct hashes below 2**64 / scale, or else the smallest."""
    if not len(hashes):
        return hashes
    small = hashes[hashes < np.uint64((1 << 64) // scale)] if scale > 1 else hashes
    return np.unique(small if len(small) else hashes.min())


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of what either sketch stands for."""
    return sketch(np.concatenate([a, b]), scale)


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; two empty sketches are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated part of a's shingles that b has; an empty a is within any b."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def to_string(a: np.ndarray) -> str:
    return base64.b64encode(np.ascontiguousarray(a, "<u8").tobytes()).decode()


def from_string(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def sketches(texts: list[str], scale: int = SCALE) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, data, offsets in text_chunks(pa.array(texts, pa.large_string())):
        hashes, at = shingle_hashes(data, offsets)
        out += [sketch(hashes[a:b], scale) for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many code points from the start of ``following``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and with
    in_edited and in_next the containment of its fingerprint in the other.

    The next document is the one after it by descending doc_id (null last, equal ids by text), after the last the
    first; a single row is its own next. Null text is empty. Rows are dealt once, into ranges of doc_id that are read
    in order; the first row of each range is also given to the range before it. Ids are read as whole numbers, and one
    that is none fails the job. Texts of any length are read whole; repeated rows follow each other; an empty table
    gives an empty result; columns beside doc_id and text, whatever their names, are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(column(docs, "doc_id").alias("doc_id"), F.coalesce(column(docs, "text"), F.lit("")).alias("text"))
    parts = partitions_for(docs, SPAN_BYTES)
    # Bounds of ranges from a range partitioning of the ids alone: at most one a partition.
    ids = docs.select(column(docs, "doc_id").cast("long").alias("i")).where("i is not null")
    least = ids.repartitionByRange(parts, "i").groupBy(F.spark_partition_id().alias("p")).agg(F.min("i").alias("least")).collect() if parts > 1 else []
    cuts = sorted((r["least"] for r in least), reverse=True)[:-1]
    # Range k holds ids from cuts[k] up, below cuts[k - 1]; the last also holds nulls. Found in two steps of sqrt(n).
    number, last = F.col("doc_id").cast("long"), len(cuts)
    if cuts:
        step = math.isqrt(last) + 1
        groups = [cuts[k : k + step] for k in range(0, last, step)]
        coarse = F.size(F.filter(F.lit([g[-1] for g in groups]), lambda c: c > number))
        fine = F.size(F.filter(F.get(F.array(*[F.lit(g) for g in groups]), coarse), lambda c: c > number))
        rank = F.when(number.isNull() | (coarse >= len(groups)), F.lit(last)).otherwise(coarse * step + fine)
    else:
        rank = F.lit(0)
    ranged = rows.withColumn("part", rank.cast("int"))
    # The largest key of each range that has rows: a row a range.
    heads = [tuple(r) for r in ranged.groupBy("part").agg(F.max(number).alias("top")).orderBy("part").collect()]
    columns = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, in_edited double, in_next double"
    if not heads:
        return spark.createDataFrame([], columns)
    # The rows with that key also go to the range before; from the first range to the last. partitions_for allows
    # 200,000 ranges, so the table is small.
    hand_on = F.broadcast(spark.createDataFrame([(part, top, heads[k - 1][0]) for k, (part, top) in enumerate(heads)], "of int, top long, before int").coalesce(1))
    tagged = ranged.join(hand_on, (F.col("part") == F.col("of")) & number.eqNullSafe(F.col("top")), "left").withColumn("to", F.explode(F.filter(F.array(F.struct(F.col("part").alias("p"), F.lit(0).alias("extra")), F.struct(F.col("before").alias("p"), F.lit(1).alias("extra"))), lambda x: x["p"].isNotNull())))
    dealt = tagged.select(F.col("to.p").alias("part"), F.col("to.extra").alias("extra"), "doc_id", "text").repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("extra", F.col("doc_id").desc_nulls_last(), "text")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows whose next row is still to come
        size = 0

        def out(pairs: list[tuple], following: list[str]) -> pa.RecordBatch:
            texts = [x[1] for x in pairs]
            new = [edited(t, f) for t, f in zip(texts, following, strict=True)]
            own, other, nxt = sketches(texts, scale), sketches(new, scale), sketches(following[-1:], scale)
            after = [*own[1:], *nxt]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in pairs], key_type), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]), pa.array([to_string(x) for x in own]), pa.array([to_string(x) for x in other]),
                    *[pa.array([f(a, b) for a, b in zip(own, x, strict=True)], pa.float64()) for f in (resemblance, containment) for x in (other, after)],
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "in_edited", "in_next"],
            )

        key_type = pa.int64()
        ended = False
        for batch in batches:
            key_type = batch.schema.field("doc_id").type
            for extra, doc, text in zip(batch.column("extra").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if ended:
                    continue
                if size > 1 << 20 and len(held) > 1:
                    yield out(held[:-1], [x[1] for x in held[1:]])
                    held = held[-1:]
                    size = len(held[0][1])
                if extra:
                    yield out(held, [*[x[1] for x in held[1:]], text])
                    held, ended = [], True
                    continue
                held.append((doc, text))
                size += len(text)

    return dealt.mapInArrow(judged, columns)
