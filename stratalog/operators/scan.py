"""Point reads, ordered scans and positioning over a log."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from stratalog.functions.mergers import Merger
from stratalog.operators.resolve import resolve


def within(log: DataFrame, lower=None, upper=None) -> DataFrame:
    """Entries with lower <= key < upper; None is open. An empty upper bound leaves nothing."""
    if lower is not None:
        log = log.where(F.col("user_key") >= F.lit(lower))
    if upper is not None:
        log = log.where(F.col("user_key") < F.lit(upper))
    return log


class Reader:
    """Reads of one log at a sequence number and clock, fixed when it is made.

    ``skewed=False`` says that no key has very many versions, which saves a small shuffle.
    """

    def __init__(self, log: DataFrame, seq: int | None = None, now_ns: int = 0, merger: Merger | None = None, merges: bool = True, lower=None, upper=None, skewed: bool = True) -> None:
        self.log, self.seq, self.now_ns, self.merger, self.merges, self.skewed = log, seq, now_ns, merger, merges, skewed
        self.lower, self.upper = lower, upper

    def _resolved(self, log: DataFrame) -> DataFrame:
        return resolve(log, self.seq, self.now_ns, self.merger, self.merges, self.skewed)

    def get(self, key) -> DataFrame:
        """The key's row, or none; bounds don't matter here."""
        return self._resolved(self.log.where(F.col("user_key") == F.lit(key)))

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """Rows of the keys in a table with a column user_key."""
        return self._resolved(self.log.join(keys.select("user_key").distinct(), "user_key", "left_semi"))

    def scan(self, lower=None, upper=None, reverse: bool = False, limit: int | None = None, values: bool = True) -> DataFrame:
        """Live rows within the reader's and these bounds in key order."""
        found = self._resolved(within(within(self.log, self.lower, self.upper), lower, upper))
        found = found if values else found.select("user_key")
        ordered = found.orderBy(F.col("user_key").desc() if reverse else F.col("user_key").asc())
        return ordered if limit is None else ordered.limit(limit)

    def first(self) -> DataFrame:
        return self.scan(limit=1)

    def last(self) -> DataFrame:
        return self.scan(reverse=True, limit=1)

    def seek_ge(self, key) -> DataFrame:
        """The first live row from a key on, clamped to the bounds."""
        return self.scan(lower=key, limit=1)

    def seek_lt(self, key) -> DataFrame:
        """The last live row before a key, clamped to the bounds."""
        return self.scan(upper=key, reverse=True, limit=1)

    def next_after(self, key) -> DataFrame:
        return self._resolved(within(self.log, self.lower, self.upper).where(F.col("user_key") > F.lit(key))).orderBy("user_key").limit(1)

    def cursor(self, page: int = 1000) -> Cursor:
        return Cursor(self, page)


class Cursor:
    """Walks a reader's rows both ways, a page of rows at a time. Once past an end it stays invalid until a seek."""

    def __init__(self, reader: Reader, page: int = 1000) -> None:
        self.reader, self.page = reader, page
        self.rows: list[Row] = []
        self.at, self.forward, self.row = 0, True, None

    def _load(self, rows: list[Row], forward: bool) -> bool:
        self.rows, self.at, self.forward = rows, 0, forward
        self.row = rows[0] if rows else None
        return self.valid()

    def valid(self) -> bool:
        return self.row is not None

    def key(self):
        return self.row["user_key"]

    def value(self):
        return self.row["value"]

    def first(self) -> bool:
        return self._load(self.reader.scan(limit=self.page).collect(), True)

    def last(self) -> bool:
        return self._load(self.reader.scan(reverse=True, limit=self.page).collect(), False)

    def seek_ge(self, key) -> bool:
        return self._load(self.reader.scan(lower=key, limit=self.page).collect(), True)

    def seek_lt(self, key) -> bool:
        return self._load(self.reader.scan(upper=key, reverse=True, limit=self.page).collect(), False)

    def _step(self, forward: bool) -> bool:
        if self.row is None:
            return False
        if forward == self.forward and self.at + 1 < len(self.rows):
            self.at += 1
            self.row = self.rows[self.at]
            return True
        here = self.row["user_key"]
        if not forward:
            return self.seek_lt(here)
        log = within(self.reader.log, self.reader.lower, self.reader.upper).where(F.col("user_key") > F.lit(here))
        return self._load(self.reader._resolved(log).orderBy("user_key").limit(self.page).collect(), True)

    def next(self) -> bool:
        return self._step(True)

    def prev(self) -> bool:
        return self._step(False)

    def all(self) -> Iterator[tuple]:
        """Every row from the first on."""
        ok = self.first()
        while ok:
            yield self.key(), self.value()
            ok = self.next()
