"""What the operators share: shared scratch tables, Arrow access to texts, word and shingle hashes."""

from __future__ import annotations

import ctypes
import gc
import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch sent to Python. Texts may be long, so batches are kept short.
BATCH_ROWS = 512
#: Bytes of text that one vectorised step works on; about 40 times as much memory is used.
CHUNK_BYTES = 1 << 21

UNKNOWN_BYTES = 1 << 50

ROOT = Path(__file__).resolve().parents[2]


@lru_cache(maxsize=1)
def _ship(context: SparkContext) -> None:
    """Send this package to the executors as a file of the application, from the shared folder."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((ROOT / "stratalog").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark = SparkSession(context)
    target = f"{_base(spark)}/code-{context.applicationId}/stratalog-code.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(held.getvalue())
    out.close()
    context.addPyFile(target)


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and bound their Arrow batches for this session from now on."""
    _ship(spark.sparkContext)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def _base(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, which only a local master may, a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="stratalog-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder for scratch tables, which all executors share."""
    return f"{_base(spark)}/llm-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, by: str | None = None, **options: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: cuts lineage, outlives lost executors.

    ``by``: a column whose values get folders of their own, so that a filter on it reads only those.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    writer = df.write.options(**options)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def trim_memory() -> None:
    """Give memory that Arrow and the C library have freed back to the system, where they can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def release_memory() -> None:
    """Collect what this process has dropped, and give its memory back."""
    gc.collect()
    trim_memory()


def tidied(of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``of`` as a task that gives back what it has freed: its worker stays for other tasks, beside more workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from of(batches)
        trim_memory()

    return run


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; call it once no result that reads them is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions_for(df: DataFrame, bytes_each: int, least: int | None = None) -> int:
    """Partitions of about ``bytes_each`` of the input's stored size; at least ``least``, by default
    spark.sql.shuffle.partitions.

    The size is the optimizer's estimate of the input files, so the count follows the data and costs no job. From
    UNKNOWN_BYTES on it is no estimate (tables that aren't read from files); then four times ``least`` is taken.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if least is None else least
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 4 * least if size >= UNKNOWN_BYTES else max(least, min(size // bytes_each, 200_000))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has in any letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def column(df: DataFrame, name: str):
    """The column of exactly this name, whatever dots or odd characters other names hold."""
    return F.col(f"`{name}`")


def python_texts(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


# --- words and shingles ---------------------------------------------------------------------------------------------

SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SEPARATORS)] = False
#: Byte values from 1 on, A-Z as a-z.
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
SHINGLE = 5


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, an invertible scrambling of 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_PLACES = mix(np.arange(1, 2 * SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)


@lru_cache(maxsize=2)
def _powers(n: int, inverse: bool) -> np.ndarray:
    out = np.full(n, _BASE_INVERSE if inverse else _BASE, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``values[s:e]`` for each span: a polynomial by prefix sums, then scrambled."""
    n = 1 << max(12, (len(values)).bit_length())
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _powers(n, False)[: len(values)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * _powers(n, True)[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts laid end to end in UTF-8: a hash of each word (A-Z lower-cased), and the number of words before
    each text and after the last. Words are runs without space, tab, LF, VT, FF, CR and don't cross texts."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, ~inside[:-1]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, ~inside[1:]
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return span_hashes(_LOWER[data], starts, ends), np.searchsorted(starts, offsets)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' shingles of five words, repeats included, and how many precede each text.

    A text of one to four words has its whole sequence as its one shingle; one without words has none.
    """
    words, at = word_hashes(data, offsets)
    n = np.diff(at)
    counts = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(first[-1], np.uint64)
    with np.errstate(over="ignore"):
        if len(words) >= SHINGLE:
            runs = sum((words[k : len(words) - SHINGLE + 1 + k] * _PLACES[k] for k in range(1, SHINGLE)), words[: len(words) - SHINGLE + 1] * _PLACES[0])
            long = np.repeat(n >= SHINGLE, counts)
            within = np.arange(first[-1]) - np.repeat(first[:-1], counts) + np.repeat(at[:-1], counts)
            out[long] = runs[within[long]]
        for i in np.flatnonzero((n > 0) & (n < SHINGLE)):
            own = words[at[i] : at[i + 1]]
            out[first[i]] = (own * _PLACES[: len(own)]).sum(dtype=np.uint64) + _PLACES[SHINGLE + len(own) - 1]
    return mix(out), first


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and end row, bytes and offsets of successive runs of texts of about CHUNK_BYTES (a longer text alone)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, where, body = column.buffers()
    offsets = np.frombuffer(where, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
