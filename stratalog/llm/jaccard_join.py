"""Exact self-join of documents' shingle sets at a Jaccard threshold, and its connected components.

Shingles (48 bits of their hash) are dealt once, in blobs, to ranges of the hash. A range knows which of its shingles
are in more than one set and in how many. Only those shared shingles go back to their sets: a set of n shingles with
fewer than ceil(0.75 n) shared ones can have no partner, which leaves near copies. Equal sets are one set throughout.
A shingle that many sets of one run of documents have is sent to its range once, with their number, while the list of
these sets waits elsewhere for the answer; so a range stays small even if a third of all documents have its shingle.

Their shingles are then ordered from rare to frequent, and two sets that match share a shingle within the first
n - ceil(0.75 n) + 1 places of each (shingles of one set count as the rarest, so the lists are short). The index has a
list of sets for each shingle in those places. Lists are answered by set relations:

- one set of a list and a band of sizes is its leader, first the one with the most frequent shingles, which of near
  copies is the one that most others match; others are verified against it first, and a set that matches takes over the
  leader's answers, its component, instead of being compared with all the leader's partners;
- lists whose sets are in one component already are skipped as blocks;
- what remains, pairs in different components, is skipped by position, size and a sketch of the set's parities where
  these rule a match out (differing bits are differing shingles, so no match is skipped), and by the leader's known overlap: a set differing from its leader by d shingles has at most d more in common with a third.

Every pair that is left is verified, so no link between two components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm._common import column, fresh, partitions_for, prepare, shingle_hashes, text_chunks, tidied, written

#: Matches have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Stored bytes of input whose shingles one range holds, and shingles that are dealt out together.
RANGE_BYTES, FLUSH = 8 << 20, 1 << 21
#: Documents that are dealt out together at most.
FLUSH_DOCS = 1 << 18
#: A shingle of so many sets of one run of documents is dealt out once for all of them.
HOT = 64
LEADER_ROUNDS = 3
#: Lists that hold more than this part of all entries, one in so many, join their leaders without a shuffle.
LONG_LISTS = 1000
#: Longs of the sketch of a set: 512 bits.
SKETCH = [f"s{i}" for i in range(8)]


def _six(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens, "<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


#: Sets are named by 128 bits: among 2e10 sets two are expected to share a name with a chance of 1e-18. Within a set and
#: between two, shingles are told apart by 48 bits: sets of 1000 are miscounted by one with a chance of 4e-9.
KEY = "V16"


def set_key(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a set of sorted hashes."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _keys(names: list[bytes] | bytes) -> np.ndarray:
    return np.frombuffer(names if isinstance(names, bytes) else b"".join(names), KEY)


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part that each set belongs to."""
    return (np.ascontiguousarray(keys).view("<u8")[::2] % np.uint64(parts)).astype(np.int64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and for each key its place among them."""
    halves = np.ascontiguousarray(keys).view("<u8").reshape(-1, 2)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    ranked = halves[order]
    new = np.r_[True, (ranked[1:] != ranked[:-1]).any(1)] if len(keys) else np.zeros(0, bool)
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return keys[order[new]], back


def _least_overlap(n):
    """ceil(0.75 n): what a set shares at least with any match."""
    return -(-PERCENT * n // 100)


_BLOBS = "kind int, part int, keys binary, counts binary, tokens binary, more binary"
_BLOB_FIELDS = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary()), ("more", pa.binary())])
#: Rows of blobs. Sets' tokens, documents, sizes of sets; of runs' frequent tokens: how many sets have each (to the
#: range), which sets (waiting), and the range's answer.
_TOKENS, _DOCS, _SIZES, _GROUPS, _WAITING, _ANSWERS = range(6)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _BLOB_FIELDS, strict=True)], schema=_BLOB_FIELDS)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) >= 64:
            yield _batch(out)
            out = []
    yield _batch(out)


def _by_part(kind: int, part: np.ndarray, owner: np.ndarray, tokens: np.ndarray, keys: np.ndarray, more: np.ndarray | None) -> Iterator[tuple]:
    """Blob rows: for each part its sets' keys, how many tokens each has, and the tokens in order of their sets."""
    order = np.argsort(part, kind="stable")
    part, owner, tokens = part[order], owner[order], tokens[order]
    more = None if more is None else more[order]
    cuts = np.flatnonzero(np.r_[len(part) > 0, part[1:] != part[:-1]])
    for a, b in zip(cuts, np.r_[cuts[1:], len(part)], strict=False):
        own = owner[a:b]
        at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        yield kind, int(part[a]), keys[own[at]].tobytes(), np.diff(np.r_[at, b - a]).astype("<u4").tobytes(), _six(tokens[a:b]), b"" if more is None else more[a:b].tobytes()


def frequent(tokens: np.ndarray, hot: int) -> np.ndarray:
    """Which of the tokens occur at least ``hot`` times."""
    bins = (tokens & np.uint64(0xFFFFF)).astype(np.int64)
    maybe = np.flatnonzero(np.bincount(bins, minlength=1 << 20)[bins] >= hot)
    out = np.zeros(len(tokens), bool)
    _, back, counts = np.unique(tokens[maybe], return_inverse=True, return_counts=True)
    out[maybe] = counts[back] >= hot
    return out


def _range_of(tokens: np.ndarray, parts: int) -> np.ndarray:
    return ((tokens >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _run_rows(keys: np.ndarray, owner: np.ndarray, tokens: np.ndarray, parts: int, hot: int) -> Iterator[tuple]:
    """Rows for the tokens of a run of documents: rare ones with their sets, frequent ones once for all."""
    many = frequent(tokens, hot)
    yield from _by_part(_TOKENS, _range_of(tokens[~many], parts), owner[~many], tokens[~many], keys, None)
    if many.any():
        tokens, owner = tokens[many], owner[many]
        order = np.argsort(tokens, kind="stable")
        each, counts = np.unique(tokens, return_counts=True)
        group = _keys(set_key(np.concatenate([np.ascontiguousarray(keys).view("<u8"), each])))
        yield from _by_part(_GROUPS, _range_of(each, parts), np.zeros(len(each), np.int64), each, group, counts.astype("<u4"))
        yield _WAITING, int(_part_of(group, parts)[0]), group.tobytes() + keys.tobytes(), counts.astype("<u4").tobytes(), _six(each), owner[order].astype("<u4").tobytes()


def _dealt(docs: DataFrame, parts: int, hot: int) -> DataFrame:
    """Blobs of shingles by range, of sizes by set, and of documents (id, set, size)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[bytes, int] = {}
        tokens: list[np.ndarray] = []
        owners: list[int] = []
        rows: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if tokens:
                owner = np.repeat(np.array(owners, np.int64), [len(t) for t in tokens])
                yield from _batches(_run_rows(_keys(list(index)), owner, np.concatenate(tokens), parts, hot))
            if rows:
                n = np.array([r[2] for r in rows], "<u4")
                key = _keys([r[1] for r in rows])
                ids = pa.array([r[0] for r in rows], pa.int64())
                yield _batch([(_DOCS, int(_part_of(key[:1], parts)[0]), key.tobytes(), n.tobytes(), np.array(ids.fill_null(0)).tobytes(), np.array(ids.is_null()).tobytes())])
                sizes = {r[1]: r[2] for r in rows}
                key, n = _keys(list(sizes)), np.array(list(sizes.values()), "<u4")
                to = _part_of(key, parts)
                yield from _batches((_SIZES, int(p), key[to == p].tobytes(), n[to == p].tobytes(), b"", b"") for p in np.unique(to))

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, _, data, offsets in text_chunks(batch.column(1)):
                hashes, at = shingle_hashes(data, offsets)
                for i in range(len(at) - 1):
                    own = np.unique(hashes[at[i] : at[i + 1]])
                    key = set_key(own)
                    rows.append((ids[first + i], key, len(own)))
                    if len(own) and key not in index:
                        index[key] = len(index)
                        owners.append(index[key])
                        tokens.append(own >> np.uint64(16))
                        size += len(own)
                if size >= FLUSH or len(rows) >= FLUSH_DOCS:
                    yield from flush()
                    index, tokens, owners, rows, size = {}, [], [], [], 0
        yield from flush()

    rows = docs.select(column(docs, "doc_id").cast("long").alias("doc_id"), column(docs, "text").alias("text"))
    return rows.mapInArrow(tidied(deal), _BLOBS)


def _unpack(rows: list[tuple[bytes, bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, and for each token its key's index, the token, and its byte in ``more`` (or none)."""
    if not rows:
        return np.zeros(0, KEY), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    keys, back = _distinct(_keys([r[0] for r in rows]))
    counts = np.frombuffer(b"".join(r[1] for r in rows), "<u4")
    return keys, np.repeat(back, counts), np.concatenate([_from_six(r[2]) for r in rows]), np.frombuffer(b"".join(r[3] for r in rows), np.uint8)


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in ("kind", "part", "keys", "counts", "tokens", "more")), strict=True)


def _shared(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Of a range's tokens, those in two sets or more, with the logarithm of that number; to their sets' parts."""
    held: list[tuple] = []
    weights: list[np.ndarray] = []
    groups: set[bytes] = set()
    for batch in batches:
        passed = []
        for row in _rows_of(batch):
            if row[0] == _TOKENS:
                held.append((*row[2:5], b""))
                weights.append(np.ones(len(row[4]) // 6, np.int64))
            elif row[0] == _GROUPS:
                held.append((*row[2:5], b""))
                weights.append(np.frombuffer(row[5], "<u4").astype(np.int64))
                groups.add(row[2])
            else:
                passed.append(row)
        if passed:
            yield _batch(passed)
    if not held:
        return
    keys, owner, tokens, _ = _unpack(held)
    weight = np.concatenate(weights)
    held.clear()
    weights.clear()
    order = np.argsort(tokens, kind="stable")
    tokens, owner, weight = tokens[order], owner[order], weight[order]
    more = weight > 1
    same = tokens[1:] == tokens[:-1]
    more[1:] |= same
    more[:-1] |= same
    tokens, owner, weight = tokens[more], owner[more], weight[more]
    order = np.lexsort((owner, tokens))
    tokens, owner, weight = tokens[order], owner[order], weight[order]
    once = np.r_[True, (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])] if len(tokens) else np.zeros(0, bool)
    tokens, owner, weight = tokens[once], owner[once], weight[once]
    _, back = np.unique(tokens, return_inverse=True)
    df = np.bincount(back, weight)[back] if len(tokens) else np.zeros(0)
    keep = df >= 2
    tokens, owner, level = tokens[keep], owner[keep], np.minimum(255, 8 * np.log2(df[keep])).astype(np.uint8)
    order = np.argsort(owner, kind="stable")
    tokens, owner, level = tokens[order], owner[order], level[order]
    of_group = np.fromiter((k in groups for k in keys.tolist()), bool, len(keys))[owner]
    for kind, own in ((_TOKENS, ~of_group), (_ANSWERS, of_group)):
        yield from _batches(_by_part(kind, _part_of(keys, parts)[owner[own]], owner[own], tokens[own], keys, level[own]))


def _answered(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The frequent tokens of runs with their levels, to the parts of the sets that waited for them."""
    waiting: list[tuple] = []
    answers: list[tuple] = []
    for batch in batches:
        for kind, _, *row in _rows_of(batch):
            (waiting if kind == _WAITING else answers).append(tuple(row))
    groups, owner, tokens, level = _unpack(answers)
    order = np.lexsort((tokens, owner))
    owner, tokens, level = owner[order], tokens[order], level[order]
    place = {k: i for i, k in enumerate(groups.tolist())}
    while waiting:
        keys, counts, each, sets = waiting.pop()
        group, keys, each = keys[:16], _keys(keys[16:]), _from_six(each)
        a, b = np.searchsorted(owner, place[group] + np.array([0, 1]))
        counts, sets = np.frombuffer(counts, "<u4"), np.frombuffer(sets, "<u4").astype(np.int64)
        of_each = level[a:b][np.searchsorted(tokens[a:b], each)]
        order = np.argsort(sets, kind="stable")
        sets, every, levels = sets[order], np.repeat(each, counts)[order], np.repeat(of_each, counts)[order]
        yield from _batches(_by_part(_TOKENS, _part_of(keys, parts)[sets], sets, every, keys, levels))


_SKETCH = ", ".join(f"{c} long" for c in SKETCH)
_SET = f"name binary, n int, shared int, tokens binary, central double, {_SKETCH}"
_SET_FIELDS = pa.schema([("name", pa.binary()), ("n", pa.int32()), ("shared", pa.int32()), ("tokens", pa.binary()), ("central", pa.float64()), *((c, pa.int64()) for c in SKETCH)])


def sketch(tokens: np.ndarray, owner: np.ndarray, sets: int) -> np.ndarray:
    """512 bits of each of ``sets`` sets as eight longs: every token turns the bit that its low bits name.

    Two sketches differ in at most as many bits as there are tokens in only one of the two sets.
    """
    bits = 64 * len(SKETCH)
    turned = np.bincount(owner * bits + (tokens % np.uint64(bits)).astype(np.int64), minlength=sets * bits)
    return np.packbits((turned & 1).astype(np.uint8)).view(np.int64).reshape(sets, len(SKETCH))


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets that share enough, with their shared tokens from rare to frequent, and how frequent tokens are on average."""
    held: list[tuple] = []
    sizes: dict[bytes, int] = {}
    for batch in batches:
        for kind, _, keys, counts, tokens, more in _rows_of(batch):
            if kind == _SIZES:
                sizes.update(zip(_keys(keys).tolist(), np.frombuffer(counts, "<u4").tolist(), strict=True))
            else:
                held.append((keys, counts, tokens, more))
    keys, owner, tokens, level = _unpack(held)
    held.clear()
    n = np.array([sizes[k] for k in keys.tolist()], np.int64)
    pick = (np.bincount(owner, minlength=len(keys)) >= _least_overlap(n))[owner]
    owner, tokens, level = owner[pick], tokens[pick], level[pick]
    order = np.lexsort((tokens, level, owner))
    owner, tokens, level = owner[order], tokens[order], level[order]
    # Equal sets of several runs may have had a token by itself and by a run.
    once = np.r_[True, (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])] if len(tokens) else np.zeros(0, bool)
    owner, tokens, level = owner[once], tokens[once], level[once]
    shared = np.bincount(owner, minlength=len(keys))
    stays = shared >= _least_overlap(n)
    pick = stays[owner]
    owner, tokens, level = owner[pick], tokens[pick], level[pick]
    own = np.flatnonzero(stays)
    central = np.bincount(owner, level, len(keys)) / np.maximum(n, 1)
    at = np.searchsorted(owner, own)
    ends = np.r_[at[1:], len(owner)]
    for a in range(0, len(own), 1024):
        part = slice(a, a + 1024)
        blobs = [_six(tokens[x:y]) for x, y in zip(at[part], ends[part], strict=True)]
        x, y = at[part][0], ends[part][-1]
        drawn = sketch(tokens[x:y], np.searchsorted(own[part], owner[x:y]), len(blobs))
        yield pa.RecordBatch.from_arrays([pa.array(keys[own[part]].tolist(), pa.binary()), pa.array(n[own[part]].astype(np.int32)), pa.array(shared[own[part]].astype(np.int32)), pa.array(blobs, pa.binary()), pa.array(central[own[part]]), *map(pa.array, np.ascontiguousarray(drawn.T))], schema=_SET_FIELDS)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each place of a set's prefix that a match can share: token, set, size, and place in the whole order."""
    for batch in batches:
        for key, n, shared, tokens, central in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
            m = shared - int(_least_overlap(n)) + 1
            own = _from_six(tokens[: 6 * m]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(m, key, np.int64)), pa.array(np.full(m, n, np.int32)), pa.array(np.arange(n - shared, n - shared + m, dtype=np.int32)), pa.array(np.full(m, central))], ["token", "key", "n", "place", "central"])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intersection sizes of pairs; the tokens of a set that comes again are kept."""
    last: dict[int, np.ndarray] = {}

    def tokens(key: int, blob: bytes) -> np.ndarray:
        if key not in last:
            if len(last) >= 256:
                last.clear()
            last[key] = np.sort(_from_six(blob))
        return last[key]

    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        got = []
        for x, y, s, t in zip(a, b, batch.column("tokens_a").to_pylist(), batch.column("tokens_b").to_pylist(), strict=True):
            left, right = tokens(x, s), tokens(y, t)
            at = np.searchsorted(left, right)
            at[at == len(left)] = 0
            got.append(int((left[at] == right).sum()) if len(left) else 0)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "na", "nb")), pa.array(got, pa.int32())], ["a", "b", "na", "nb", "both"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with sizes and the size of their intersection."""
    left = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("tokens_a"))
    right = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tokens_b"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(tidied(_overlaps), "a long, b long, na int, nb int, both int")


def _matches():
    return 100 * F.col("both").cast("long") >= PERCENT * (F.col("na").cast("long") + F.col("nb") - F.col("both"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node that edges (a, b) reach; nodes without edges are not listed.

    Labels spread to neighbours and then jump to their labels' labels, a table a round, until none changes.
    """
    both = written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = written(labels.join(near, "node", "left").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")), "labels")
        jump = spread.select(F.col("node").alias("at"), F.col("label").alias("next"))
        jumped = written(spread.join(jump, F.col("label") == F.col("at"), "left").select("node", F.least("label", "next").alias("label"), "was"), "labels")
        labels = jumped.select("node", "label")
        if not jumped.where("label <> was").limit(1).count():
            return labels


def _merged(known: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Components (node, label) after more edges between nodes of the known ones."""
    if known is None:
        return components(edges)
    lift = lambda df, c: df.join(known.select(F.col("node").alias("_n"), F.col("label").alias("_l")), F.col(c) == F.col("_n"), "left").withColumn(c, F.coalesce("_l", c)).drop("_n", "_l")
    above = components(lift(lift(edges.select("a", "b"), "a"), "b"))
    up = above.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    old = known.join(up, F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_l", "label").alias("label"))
    new = above.join(known.select(F.col("node").alias("_n")), F.col("node") == F.col("_n"), "left_anti")
    return written(old.unionByName(new), "components")


def _sized(n: str, m: str):
    """Sizes between which a match is possible."""
    return (100 * F.col(n).cast("long") >= PERCENT * F.col(m).cast("long")) & (100 * F.col(m).cast("long") >= PERCENT * F.col(n).cast("long"))


def _needed(n, m):
    """The intersection that sets of these sizes need."""
    return F.ceil(PERCENT * (n.cast("long") + m) / F.lit(100.0 + PERCENT))


def set_components(docs: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, key, n) and components (node, label) of those sets that have links; nodes are keys."""
    spark = docs.sparkSession
    prepare(spark)
    parts = partitions_for(docs, RANGE_BYTES)
    dealt = _dealt(docs, parts, hot).repartitionById(parts, F.col("part"))
    shared = written(dealt.mapInArrow(tidied(lambda it: _shared(it, parts)), _BLOBS), "shared", by="kind").select("kind", "part", "keys", "counts", "tokens", "more")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts, ids, null in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                ids = pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(null, bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(_keys(keys).tolist(), pa.binary()), pa.array(np.frombuffer(counts, "<u4").astype(np.int64))], ["doc_id", "key", "n"])

    documents = shared.where(F.col("kind") == _DOCS).select("keys", "counts", "tokens", "more").mapInArrow(listed, "doc_id long, key binary, n long")
    answered = shared.where(F.col("kind").isin(_WAITING, _ANSWERS)).repartitionById(parts, F.col("part")).mapInArrow(tidied(lambda it: _answered(it, parts)), _BLOBS)
    own = shared.where(F.col("kind").isin(_TOKENS, _SIZES)).unionAll(answered)
    # From here on sets have numbers, which are shorter than their names.
    sets = written(own.repartitionById(parts, F.col("part")).mapInArrow(tidied(_survivors), _SET).withColumn("key", F.monotonically_increasing_id()), "sets")
    postings = written(sets.select("key", "n", "shared", "tokens", "central").mapInArrow(_postings, "token long, key long, n int, place int, central double"), "postings")

    known: DataFrame | None = None
    answers: DataFrame | None = None  # of each set, a leader and their overlap

    def placed() -> DataFrame:
        """Postings with components, without lists that lie in one component."""
        with_c = postings.withColumn("c", F.col("key")) if known is None else postings.join(known.select(F.col("node").alias("key"), F.col("label").alias("c0")), "key", "left").withColumn("c", F.coalesce("c0", "key")).drop("c0")
        split = with_c.groupBy("token").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("token")
        return written(with_c.join(split, "token", "left_semi"), "lists")

    for r in range(LEADER_ROUNDS):
        # Sets of a list that match have sizes of one band or of neighbouring ones; the bands' bounds move with the rounds.
        table = placed()
        lists = table.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / PERCENT)) + F.lit(r / LEADER_ROUNDS)))
        leads = F.struct(-F.col("central"), "key") if r == 0 else F.struct(F.xxhash64("key", F.lit(r)))
        chosen = lists.groupBy("token", "band").agg(F.min_by(F.struct("key", "n", "c"), leads).alias("z"), F.count("*").alias("entries"))
        leaders = written(chosen.select("token", "band", F.col("z.key").alias("b"), F.col("z.n").alias("m"), F.col("z.c").alias("d"), "entries"), "leaders")
        # No more than LONG_LISTS lists can hold more than one in LONG_LISTS of the entries.
        is_long = F.col("entries") * LONG_LISTS > table.count()
        long = leaders.where(is_long).drop("entries")
        short = lists.join(F.broadcast(long.select("token", "band")), ["token", "band"], "left_anti").join(leaders.where(~is_long).drop("entries"), ["token", "band"])
        tried = lists.join(F.broadcast(long), ["token", "band"]).unionByName(short).where((F.col("c") != F.col("d")) & _sized("n", "m")).select(F.col("key").alias("a"), "b").distinct()
        checked = written(_verified(tried, sets), "checked")
        edges = checked.where(_matches())
        if not edges.limit(1).count():
            break
        if answers is None:
            answers = written(edges.groupBy("a").agg(F.max_by(F.struct("b", "nb", "both"), "both").alias("z")).select("a", F.col("z.b").alias("leader"), F.col("z.nb").alias("n_leader"), F.col("z.both").alias("with_leader")), "answers")
        known = _merged(known, edges)

    # Only the lists that are left get the sketches of their sets.
    lists = placed().join(sets.select("key", "shared", *SKETCH), "key")
    left = lists.select("token", F.col("key").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("shared").alias("sa"), F.col("c").alias("ca"), *(F.col(c).alias(f"{c}a") for c in SKETCH))
    right = lists.select("token", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("shared").alias("sb"), F.col("c").alias("cb"), *(F.col(c).alias(f"{c}b") for c in SKETCH))
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    # The first common token of a match lies where enough of both sets is still to come.
    at = (F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b")) & _sized("na", "nb") & (room >= _needed(F.col("na"), F.col("nb")))
    # Bits in which sketches differ are shared tokens of only one set; of sa + sb, a match leaves so many at most.
    differ = sum((F.bit_count(F.col(f"{c}a").bitwiseXOR(F.col(f"{c}b"))) for c in SKETCH[1:]), F.bit_count(F.col(f"{SKETCH[0]}a").bitwiseXOR(F.col(f"{SKETCH[0]}b"))))
    at = at & (differ <= F.col("sa") + F.col("sb") - 2 * _needed(F.col("na"), F.col("nb")))
    rest = written(left.join(right, "token").where(at).select("a", "b", "na", "nb").distinct(), "rest")
    if answers is not None:
        # What the leader of a has in common with b bounds what a has.
        led = written(rest.join(answers, "a", "left"), "led")
        asked = led.where("leader is not null and leader <> b").select(F.col("leader").alias("a"), "b").distinct()
        known_overlap = _verified(asked, sets).select(F.col("a").alias("leader"), "b", F.col("both").alias("leader_b"))
        derived = led.join(known_overlap, ["leader", "b"], "left").where(F.col("leader_b").isNull() | (F.col("leader_b") + F.col("na") - F.col("with_leader") >= _needed(F.col("na"), F.col("nb"))))
        rest = derived.select("a", "b")
    last = written(_verified(rest.select("a", "b"), sets).where(_matches()), "last")
    if last.limit(1).count():
        known = _merged(known, last)
    if known is None:
        known = spark.createDataFrame([], "node long, label long")
    return documents, known.join(sets.select("key", "name"), F.col("node") == F.col("key")).select(F.col("name").alias("node"), "label")


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, ``n_shingles`` and ``component_id``, the smallest doc_id that links reach, itself included.

    Null texts and texts without words have no shingles and no links. Rows with equal sets are linked; a null doc_id
    is never the smallest unless a component has no other. Ids are read as whole numbers. Texts of any length are read
    whole. An empty table gives an empty result; columns beside doc_id and text, whatever their names, are not read.
    """
    kind = dict(docs.dtypes)["doc_id"]
    documents, known = set_components(docs, hot)
    classes = written(documents.groupBy("key").agg(F.min("doc_id").alias("first")), "classes")
    of_class = known.join(classes.select(F.col("key").alias("node"), "first"), "node")
    smallest = of_class.groupBy("label").agg(F.min("first").alias("least"))
    linked = known.join(smallest, "label").select(F.col("node").alias("key"), "least")
    labels = written(classes.join(linked, "key", "left").select(F.col("key").alias("k"), F.coalesce("least", "first").alias("component_id")), "class_labels")
    found = documents.join(labels, F.col("key") == F.col("k"), "left")
    return found.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).cast(kind).alias("component_id"))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest doc_id. Documents without words stay.

    Rows that repeat a doc_id that stays all stay; rows with a null doc_id stay only if nothing else is linked to them.
    Columns, whatever their names, are unchanged; an empty table stays empty.
    """
    report = near_duplicates(docs)
    (gone_id,) = fresh(docs, "gone_id")
    gone = report.where("component_id <> doc_id or (doc_id is null and component_id is not null)").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, column(docs, "doc_id").eqNullSafe(F.col(gone_id)), "left_anti")
