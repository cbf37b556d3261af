"""Mergers: how the operands of a key, oldest first, are combined with the value they are applied to.

A merger gives Catalyst expressions. ``operands`` aggregates the operands of a key (null without any); ``full`` joins
that with the existing value, of which it may only look at ``existing`` where ``exists`` holds.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Merger:
    """Base: values of the type of the log's value column, unless ``result`` names another.

    ``combine`` aggregates what ``operands`` gave for parts of a key's operands; ``place`` orders the parts.
    """

    result: str | None = None

    def combine(self, partial: Column, place: Column) -> Column:
        raise NotImplementedError

    def result_type(self, values: T.DataType) -> str | T.DataType:
        """The type of resolved values over a log with values of a type; bytes stay bytes."""
        return values if values.typeName() == "binary" or self.result is None else self.result

    def operands(self, value: Column, seq: Column) -> Column:
        raise NotImplementedError

    def full(self, key: Column, existing: Column, exists: Column, operands: Column) -> Column:
        raise NotImplementedError


class _Algebraic(Merger):
    """Order doesn't matter: operands are combined map-side. ``codec``: to and from a number, for stores of bytes."""

    def __init__(self, decode: Callable[[Column], Column] = lambda c: c, encode: Callable[[Column], Column] = lambda c: c) -> None:
        self.decode, self.encode = decode, encode


class SumMerger(_Algebraic):
    """Operands are added."""

    def operands(self, value, seq):
        return F.sum(self.decode(value))

    def combine(self, partial, place):
        return F.sum(partial)

    def full(self, key, existing, exists, operands):
        return self.encode(F.coalesce(F.when(exists, self.decode(existing)), F.lit(0)) + F.coalesce(operands, F.lit(0)))


class MaxMerger(_Algebraic):
    """The largest of value and operands."""

    def operands(self, value, seq):
        return F.max(self.decode(value))

    def combine(self, partial, place):
        return F.max(partial)

    def full(self, key, existing, exists, operands):
        return self.encode(F.greatest(F.when(exists, self.decode(existing)), operands))


class MinMerger(_Algebraic):
    """The smallest of value and operands."""

    def operands(self, value, seq):
        return F.min(self.decode(value))

    def combine(self, partial, place):
        return F.min(partial)

    def full(self, key, existing, exists, operands):
        return self.encode(F.least(F.when(exists, self.decode(existing)), operands))


class LastMerger(Merger):
    """The newest operand replaces the value."""

    def operands(self, value, seq):
        return F.max_by(value, seq)

    def combine(self, partial, place):
        return F.max_by(partial, F.when(partial.isNotNull(), place))

    def full(self, key, existing, exists, operands):
        return operands


class _Ordered(Merger):
    def operands(self, value, seq):
        return F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(seq.alias("s"), value.alias("v"))))), lambda x: x["v"])

    def combine(self, partial, place):
        return F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size(partial) > 0, F.struct(place.alias("s"), partial.alias("v"))))), lambda x: x["v"]))


class AppendMerger(_Ordered):
    """Text operands are appended with a separator, oldest first."""

    result = "string"

    def __init__(self, separator: str = ",") -> None:
        self.separator = separator

    def full(self, key, existing, exists, operands):
        text = F.transform(operands, lambda x: x.cast("string"))
        return F.concat_ws(self.separator, F.when(exists, existing.cast("string")), F.array_join(text, self.separator))


class UdfMerger(_Ordered):
    """Any function (key, existing or None, exists, operands oldest first) -> value, run on Arrow batches."""

    def __init__(self, function: Callable, result: str | T.DataType = "binary") -> None:
        self.function, self.result = function, result

    def full(self, key, existing, exists, operands):
        function, empty = self.function, b"" if self.result in ("binary", T.BinaryType()) else None

        @F.pandas_udf(self.result)
        def merge(k: pd.Series, e: pd.Series, x: pd.Series, o: pd.Series) -> pd.Series:
            got = [function(a, b if c else None, bool(c), list(d)) if d is not None and len(d) else None for a, b, c, d in zip(k, e, x, o, strict=True)]
            return pd.Series([empty if g is None else g for g in got], dtype=object)

        return merge(key, existing, exists, operands)
