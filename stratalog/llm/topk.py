"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length (norm) into blocks, longest first. A query gets a first threshold, its k-th best score
in the block of the longest vectors. For every other block the score that is still needed, over the query's and the
block's lengths, is a local cosine threshold: above 1 the block is skipped; where it is high, candidates are taken from
the block's sorted coordinate lists (a vector that close to the query must lie in a range of each coordinate); else
they are the vectors long enough. Queries are only sent to the parts of the index whose longest vector can still reach
their threshold. Products of all candidates are then computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm._common import column, partitions_for, prepare, written

BLOCK, QUERY_BLOCK = 4096, 256
PART_BYTES = 16 << 20
#: Local cosine threshold from which coordinate lists are used, and the coordinates looked at.
COORDINATE_FROM, FOCUS = 0.6, 4
_SLACK = 1e-9


def scaled(flat: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(flat.astype(np.float64) * scale)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer products; sums that floats can't hold are computed with big integers and stop at 64 bits."""
    if not queries.size or not vectors.size:
        return np.zeros((len(queries), len(vectors)), np.int64)
    if np.abs(queries).max() * np.abs(vectors).max() * queries.shape[1] < 2**53:
        return (queries @ vectors.T).astype(np.int64)
    exact = np.array([[int(x) for x in v] for v in queries], object) @ np.array([[int(x) for x in v] for v in vectors], object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _below(score: int) -> float:
    """A score as a float that isn't larger."""
    return float(score) if abs(score) <= 2**53 else float(np.nextafter(float(score), -np.inf))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to smaller ids."""
    if len(scores) > k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep].astype(object) if len(keep) and scores[keep].min() == -(2**63) else -scores[keep]))[:k]]


class Block:
    """Vectors of one dimension and of similar lengths, in order of falling length."""

    def __init__(self, ids: bytes, norms: bytes, vectors: bytes) -> None:
        self.ids, self.norms = np.frombuffer(ids, np.int64), np.frombuffer(norms, np.float64)
        self.vectors = np.frombuffer(vectors, np.float64).reshape(len(self.ids), -1)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def near(self, f: int, low: float, high: float) -> np.ndarray:
        """Vectors whose unit vector's coordinate f is in a range."""
        if f not in self.lists:
            unit = self.vectors[:, f] / np.maximum(self.norms, 1e-300)
            order = np.argsort(unit, kind="stable")
            self.lists[f] = (order, unit[order])
        order, unit = self.lists[f]
        return order[np.searchsorted(unit, low, "left") : np.searchsorted(unit, high, "right")]

    def search(self, query: np.ndarray, norm: float, own: int, least: float | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best that have the score ``least`` or more."""
        at = np.arange(len(self.ids))
        if least is not None and least > 0:
            local = least / max(norm * self.norms[0], 1e-300)
            if local > 1 + _SLACK:
                return self.ids[:0], np.zeros(0, np.int64)
            long = int(np.searchsorted(-self.norms, -(least / max(norm, 1e-300)) * (1 - _SLACK), "right"))
            at = at[:long]
            if local >= COORDINATE_FROM:
                unit = query / norm
                for f in np.argsort(-np.abs(unit))[:FOCUS].tolist():
                    spread = ((1 - min(1.0, unit[f] ** 2)) * (1 - min(1.0, local**2))) ** 0.5
                    # Cosines within the threshold bound each coordinate from below or above; the far side is open.
                    low = unit[f] * local - spread - _SLACK if unit[f] > 0 else -2.0
                    high = unit[f] * local + spread + _SLACK if unit[f] < 0 else 2.0
                    found = self.near(f, low, high)
                    if len(found) < len(at):
                        at = np.sort(found[found < long])
        scores = products(query[None], self.vectors[at])[0]
        fit = (self.ids[at] != own) & (scores >= least if least is not None else True)
        at, scores = at[fit], scores[fit]
        keep = best(scores, self.ids[at], k)
        return self.ids[at][keep], scores[keep]


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for each row whose vec_id is divisible by ``every``.

    Vectors or ids that are null and vectors with null or non-finite components take no part. Vectors of different
    dimension aren't compared. Rows with a query's own id are not its candidates; other repeated rows are candidates
    each. Equal rows with a query id are one query. The empty vector has length 0 and score 0. An empty table gives an
    empty result; columns beside vec_id and embedding, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(column(vectors, "vec_id").cast("long").alias("vec_id"), column(vectors, "embedding").alias("embedding")).where("vec_id is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            at = lists.offsets.to_numpy()
            flat = scaled(lists.values.to_numpy(zero_copy_only=False), scale)
            own = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(v) for v in own], pa.int32()), pa.array([float(np.sqrt((v * v).sum())) for v in own], pa.float64()), pa.array([v.tobytes() for v in own], pa.binary())], ["vec_id", "dim", "norm", "v"])

    parts = partitions_for(vectors, PART_BYTES)
    ready = rows.mapInArrow(measured, "vec_id long, dim int, norm double, v binary")
    shape = "part int, dim int, block int, ids binary, norms binary, vectors binary"

    def blocks_of(size: int, part_at: int):
        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            n, part = 0, 0

            def out() -> pa.RecordBatch:
                nonlocal n
                ids, norms, vs = zip(*[(x[0], x[2], x[3]) for x in held], strict=True)
                row = [[part], [held[0][1]], [n], [np.array(ids, np.int64).tobytes()], [np.array(norms).tobytes()], [b"".join(vs)]]
                n += 1
                return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "dim", "block", "ids", "norms", "vectors"])

            for batch in batches:
                for x in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                    part = x[part_at]
                    if held and (len(held) >= size or held[0][1] != x[1]):
                        yield out()
                        held = []
                    held.append(x)
            if held:
                yield out()

        return blocks

    order = ["dim", F.col("norm").desc(), "vec_id", "v"]
    ranged = ready.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    index = written(ranged.mapInArrow(blocks_of(BLOCK, 4), shape), "vectors")
    queries = ready.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]).repartition(max(1, parts // 8), "vec_id").sortWithinPartitions("dim", "vec_id").withColumn("part", F.spark_partition_id())
    asked = written(queries.mapInArrow(blocks_of(QUERY_BLOCK, 4), shape), "queries")

    def searched(first: bool):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[int, Block]] = []
            for batch in batches:
                out: list[tuple] = []
                for dim, is_query, ids, norms, vs, least in zip(*(batch.column(c).to_pylist() for c in ("dim", "is_query", "ids", "norms", "vectors", "least")), strict=True):
                    if not is_query:
                        held.append((dim, Block(ids, norms, vs)))
                        continue
                    q = Block(ids, norms, vs)
                    bounds = np.frombuffer(least, np.float64) if least else None
                    for i in range(len(q.ids)):
                        bound = None if bounds is None or np.isnan(bounds[i]) else float(bounds[i])
                        own: list[tuple[int, int]] = []
                        for d, block in held:
                            if d != dim:
                                continue
                            got, scores = block.search(q.vectors[i], float(q.norms[i]), int(q.ids[i]), bound, k)
                            own = sorted([*own, *zip(scores.tolist(), got.tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
                            if len(own) == k:
                                bound = _below(own[-1][0]) if bound is None else max(bound, _below(own[-1][0]))
                        mark = q.vectors[i].tobytes() if not first else None
                        if first:
                            out.append((int(q.ids[i]), mark, q.vectors[i].tobytes(), own[-1][0] if len(own) == k else None))
                        else:
                            out += [(int(q.ids[i]), v, s, q.vectors[i]) for s, v in own]
                if first:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary()), pa.array([None if x[3] is None else _below(x[3]) for x in out], pa.float64())], ["vec_id", "v", "least"])
                else:
                    marks = [int.from_bytes(_digest(x[3].tobytes()), "little", signed=True) for x in out]
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array(marks, pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], ["query_id", "mark", "vec_id", "score"])

        return search

    none = F.lit(None).cast("binary")
    as_query = asked.select("dim", F.lit(True).alias("is_query"), "ids", "norms", "vectors", none.alias("least"))
    # First thresholds: every query against one block, that of the longest vectors of its dimension.
    n_index = 1 + (index.agg(F.max("part")).first()[0] or 0)
    longest = index.groupBy("dim").agg(F.min_by(F.struct("ids", "norms", "vectors"), F.struct("part", "block")).alias("b")).select("dim", F.lit(False).alias("is_query"), "b.ids", "b.norms", "b.vectors", none.alias("least"))
    spread = max(1, min(n_index, parts))
    to_all = lambda df, n: df.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))  # noqa: E731  a block of queries goes to every part
    dealt = to_all(longest, spread).unionByName(as_query.withColumn("to", F.pmod(F.xxhash64("ids"), F.lit(spread)).cast("int"))).repartitionById(spread, F.col("to")).sortWithinPartitions("is_query")
    bounds = written(dealt.drop("to").mapInArrow(searched(True), "vec_id long, v binary, least double"), "bounds")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of queries that need vectors of like lengths, with the least length that any of a block needs."""
        for batch in batches:
            yield from _query_blocks(batch, batch.column("least").to_pylist())

    def longest_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = [float(np.frombuffer(x, np.float64)[0]) for x in batch.column("norms").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("dim"), batch.column("part"), pa.array(norms, pa.float64())], ["dim", "part", "norm"])

    def _query_blocks(batch: pa.RecordBatch, least: list) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, list[int]] = {}
        vs, ids = batch.column("v").to_pylist(), batch.column("vec_id").to_pylist()
        for i, v in enumerate(vs):
            by_dim.setdefault(len(v) // 8, []).append(i)
        for dim, own in by_dim.items():
            every = np.frombuffer(b"".join(vs[i] for i in own), np.float64).reshape(len(own), -1)
            least_of = np.array([0.0 if least[i] is None else max(0.0, least[i]) for i in own])
            needs = np.where(least_of > 0, least_of / np.maximum(np.sqrt((every * every).sum(1)), 1e-300), 0.0) * (1 - _SLACK)
            order = np.argsort(needs, kind="stable")
            for a in range(0, len(own), QUERY_BLOCK):
                part = [own[i] for i in order[a : a + QUERY_BLOCK].tolist()]
                m = np.frombuffer(b"".join(vs[i] for i in part), np.float64).reshape(len(part), -1)
                bound = np.array([np.nan if least[i] is None else least[i] for i in part], np.float64)
                row = [[dim], [True], [np.array([ids[i] for i in part], np.int64).tobytes()], [np.sqrt((m * m).sum(1)).tobytes()], [m.tobytes()], [bound.tobytes()], [float(needs[order[a]])]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.float64()), strict=True)], ["dim", "is_query", "ids", "norms", "vectors", "least", "need"])

    shape2 = "dim int, is_query boolean, ids binary, norms binary, vectors binary, least binary, need double"
    # A row a dimension and in it one a part, of which partitions_for allows 200,000.
    tops = index.select("dim", "part", "norms").mapInArrow(longest_of, "dim int, part int, norm double").groupBy("dim", "part").agg(F.max("norm").alias("norm"))
    tops = F.broadcast(tops.groupBy(F.col("dim").alias("of")).agg(F.collect_list(F.struct("part", "norm")).alias("tops")))
    reached = F.filter("tops", lambda x: x["norm"] >= F.col("need"))
    again = bounds.mapInArrow(bounded, shape2).join(tops, F.col("dim") == F.col("of")).withColumn("to", F.explode(F.transform(reached, lambda x: x["part"]))).drop("of", "tops", "need")
    dealt = again.unionByName(index.select("dim", F.lit(False).alias("is_query"), "ids", "norms", "vectors", none.alias("least"), F.col("part").alias("to"))).repartitionById(n_index, F.col("to")).sortWithinPartitions("is_query")
    found = dealt.drop("to").mapInArrow(searched(False), "query_id long, mark long, vec_id long, score long")
    by_query = Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _digest(data: bytes) -> bytes:
    import hashlib

    return hashlib.blake2b(data, digest_size=8).digest()
