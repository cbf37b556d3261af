"""URL filter: rules by host and path first, then logistic regression on hashed character n-grams.

The model reads the n-grams of host and path apart and is trained on the driver from a small labelled table of URLs;
its weights, a fixed number of floats, go to the executors with the function.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm._common import column, prepare

BUCKETS, GRAMS = 1 << 14, (3, 4, 5)
#: Rows of the labelled table that are used for training at most, by order of their hash.
TRAIN_ROWS = 20_000

#: Fixed values: (verdict, host, path). A rule holds for its host and the hosts below it.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

#: Parts of syllables. Names made of them stand for hosts whose words are not known, which are allowed.
ONSETS, NUCLEI, CODAS = "b br ch d f gr h l m n p r s sh st t th tr w".split(), "a e i o u ea ou".split(), ["", "n", "r", "s", "t", "nd", "ng", "st"]
#: Words of hosts and of paths that the labelled table is made of; the first two lists mean block.
BAD_HOSTS = "adult affiliate banner bets betting bonus cams cash casino cheap clicks coins dating deals discount doubler escort farm fast followers free gambling jackpot keygen loans lottery meds miracle money payday pharmacy pills poker popup prize promo replica singles slots spam torrent track viagra warez win xxx".split()
BAD_PATHS = "buy-now claim-prize click-here free-coins free-trial-offer get-rich hot-singles make-money order-pills redirect-ad spin-and-win verify-account".split()
HOSTS = "archive art atelier baker berg bibliothek biology blog books bridge casa castle chapter city college cuisine culture docs ecole escuela farmers film forest forum garden geschichte harbor health history house jardin journal kitchen lab library livre maps market math medizin mountain musee museum music news ocean paper physics planet poetry radio recipes reise research river schule science society sports stadt studio theatre tiempo travel universe valley verein village wasser weather wiki wind zeitung".split()
PATHS = "/ /en/ /fr/12 /de/3.html /es/about /a/b /page?x=1 /posts/2020 /guide/index.html".split()


def _labelled() -> list[tuple[str, int]]:
    """A small labelled table, 1 for block: pairs of words as hosts with paths that tell nothing, and hosts of ordinary
    words with paths that do. Made-up names keep the model from blocking what it just doesn't know."""
    place = lambda k: (("", "www.", "m.", "blog.")[k % 4], ("example.com", "example.org", "example.net", "test")[k // 4 % 4])
    out = []
    for label, words in ((1, BAD_HOSTS), (0, HOSTS)):
        for k, w in enumerate(words):
            for j in range(4):
                front, end = place(k + j)
                name = (w, f"{w}-{words[(k * 7 + 3) % len(words)]}", f"{words[(k * 5 + 11) % len(words)]}{w}", f"{w}-{k + 2}")[j]
                out.append((f"http{'s' * (j % 2)}://{front}{name}.{end}{PATHS[(k + 2 * j) % len(PATHS)]}", label))
    for k, w in enumerate(BAD_PATHS):
        for j in range(3):
            front, end = place(k + j)
            out.append((f"https://{front}{HOSTS[(k * 11 + j * 17) % len(HOSTS)]}.{end}/{w}{('', '/', f'/{k}')[j]}", 1))
    syllable = lambda k: ONSETS[k % len(ONSETS)] + NUCLEI[k // 3 % len(NUCLEI)] + CODAS[k // 5 % len(CODAS)]
    for k in range(400):
        front, end = place(k)
        out.append((f"https://{front}{syllable(k * 37)}{syllable(k * 53 + 9)}{syllable(k * 71 + 4) if k % 3 else ''}.{end}{PATHS[k % len(PATHS)]}", 0))
    return out


LABELLED = _labelled()

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _PARTS, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(url, _PARTS, 2)


def split_url(url: str | None) -> tuple[str, str]:
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    ends = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    host, tail = rest[: min(ends, default=len(rest))], rest[min(ends, default=len(rest)) :]
    path = tail[: min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))]
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), path


class Rules:
    """Finds the longest rule for a host and path: by the host's suffixes, then its paths from the longest."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]) -> None:
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best: tuple[int, str, str] | None = None
        labels = host.split(".")
        for k in range(len(labels)):
            suffix = ".".join(labels[k:])
            for prefix, verdict in self.by_host.get(suffix, ()):
                if path.startswith(prefix) and (best is None or len(suffix) + len(prefix) > best[0]):
                    best = (len(suffix) + len(prefix), suffix + prefix, verdict)
        return best and best[1:]


def grams(host: str, path: str, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of all character n-grams of the host and of the path, each once."""
    found = set()
    for mark, part in (("h", host), ("p", path)):
        part = f"^{part}$"
        for n in GRAMS:
            found.update(zlib.crc32(f"{mark}{part[i : i + n]}".encode("utf-8", "surrogatepass")) % buckets for i in range(len(part) - n + 1))
    return np.fromiter(found, np.int64, len(found))


def train(rows: Sequence[tuple[str, int]], buckets: int = BUCKETS, steps: int = 400, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent; features of a URL weigh 1 / sqrt of their number."""
    feats = [grams(*split_url(u), buckets) for u, _ in rows]
    y = np.array([float(t) for _, t in rows])
    if not len(y):
        return np.zeros(buckets), 0.0
    at = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    cols = np.concatenate(feats)
    value = 1 / np.sqrt(np.maximum(1, [len(f) for f in feats]))[at]
    w, b, squares = np.zeros(buckets), 0.0, np.full(buckets, 1e-8)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(at, value * w[cols], len(y)) + b)))
        g = np.bincount(cols, value * (p - y)[at], buckets) / len(y) + decay * w
        squares += g * g
        w -= rate * g / np.sqrt(squares)
        b -= rate * float((p - y).mean())
    return w, b


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Per row: page_id, host, path, rule (null if none fits), verdict and ``score`` (the model's, for blocking).

    ``labelled`` has columns url and label (1: block); at most TRAIN_ROWS of it are used. A null URL, or one without
    ``://``, has an empty host and path; with these there is nothing to judge, the score is 0 and the verdict allow.
    URLs of any length are read whole; repeated rows are judged each; an empty table gives an empty result; columns
    beside page_id and url, whatever their names, are not read.
    """
    prepare(pages.sparkSession)
    rows = LABELLED
    if labelled is not None:
        taken = labelled.where("url is not null and label is not null").select("url", F.col("label").cast("int")).orderBy(F.xxhash64("url"), "url", "label").limit(TRAIN_ROWS)
        rows = [(r[0], r[1]) for r in taken.collect()]
    weights, bias = train(rows)
    host, path = host_and_path(column(pages, "url"))
    parts = pages.select(column(pages, "page_id").alias("page_id"), host.alias("host"), path.alias("path"))
    kind = dict(parts.dtypes)["page_id"]
    weights = weights.astype(np.float32)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Rules(rules)
        for batch in batches:
            rule, verdict, score = [], [], []
            for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = grams(h, p)
                s = 1 / (1 + float(np.exp(-(weights[own].sum(dtype=np.float64) / max(1, len(own)) ** 0.5 + bias)))) if h or p else 0.0
                hit = table.find(h, p)
                rule.append(hit and hit[0])
                verdict.append(hit[1] if hit else "block" if s >= threshold else "allow")
                score.append(s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(score, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "score"])

    return parts.mapInArrow(judged, f"page_id {kind}, host string, path string, rule string, verdict string, score double")
