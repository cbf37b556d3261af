"""The entry model: schema, kinds, limits, errors, options."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import types as T

DELETE, SET, MERGE, SET_TTL = 0, 1, 3, 4
MAX_SEQ = (1 << 56) - 1
MAX_KEY, MAX_BATCH = 65_536, 64 << 20

#: user_key and value are bytes in a store; logs over other tables may hold any orderable type there.
ENTRY = T.StructType([T.StructField("user_key", T.BinaryType(), False), T.StructField("seq", T.LongType(), False), T.StructField("kind", T.ByteType(), False), T.StructField("value", T.BinaryType()), T.StructField("expiry_ns", T.LongType())])


class StoreError(Exception):
    """Any failure that a store reports."""


class NotFound(StoreError):
    """The key has no visible value."""


class Corruption(StoreError):
    """Stored data is damaged or contradicts itself."""


class Closed(StoreError):
    """The store was closed."""


class Locked(StoreError):
    """Another writer holds the store."""


class Exists(StoreError):
    """The store exists and must not."""


class DoesNotExist(StoreError):
    """The store doesn't exist and must."""


class KeyTooLarge(StoreError):
    """A key has more than MAX_KEY bytes."""


class BatchTooLarge(StoreError):
    """A batch has more than MAX_BATCH bytes."""


class InvalidBatch(StoreError):
    """A batch or a record of one contradicts itself."""


class NoMerger(StoreError):
    """A merge operand was written or met without a merger."""


class InvalidOptions(StoreError):
    """An option is out of its range."""


class ForeignSnapshot(StoreError):
    """A snapshot belongs to another store, or was released."""


def _bytewise(key):
    return key


@dataclass(frozen=True)
class Comparer:
    """A named order of keys. Only the order of bytes is built, so a store rejects any other ``sort_key``."""

    name: str = "bytewise"
    sort_key: Callable = field(default=_bytewise, compare=False)


@dataclass
class Options:
    """Settings of a store; sizes are bytes."""

    create_if_missing: bool = True
    error_if_exists: bool = False
    comparer: Comparer = field(default_factory=Comparer)
    memtable_size: int = 4 << 20
    #: Bytes of a Parquet page and of a row group.
    block_size: int = 64 << 10
    row_group_size: int = 8 << 20
    #: Bits of a segment's Bloom filter for each key; 0 for none.
    bloom_bits_per_key: int = 10
    compression: str = "snappy"
    target_file_size: int = 2 << 20
    l0_compaction_trigger: int = 4
    l0_slowdown_trigger: int = 8
    l0_stop_trigger: int = 12
    num_levels: int = 7
    l1_max_bytes: int = 10 << 20
    level_multiplier: int = 10
    strategy: str = "leveled"
    tiered_width: int = 4
    tiered_ratio: float = 1.5
    tiered_space_percent: int = 200
    merger: object = None
    #: (level, key, value) -> whether the newest version of a key is to go, as a column.
    compaction_filter: Callable | None = None
    clock: Callable[[], int] | None = None
    best_effort_recovery: bool = False
    paranoid_checks: bool = False
    disable_automatic_compactions: bool = False
    #: Edits after which the manifest is folded into one record.
    max_manifest_edits: int = 64
    #: Time that a lease lasts, and that segments without readers stay after the version that had them.
    lease_seconds: float = 60.0
    retention_seconds: float = 3600.0

    def validate(self) -> None:
        """Raise InvalidOptions for the first setting out of its range."""
        rules = [
            (self.comparer.sort_key is _bytewise and bool(self.comparer.name), "comparer"),
            (4 << 10 <= self.memtable_size <= 4 << 30, "memtable_size"),
            (128 <= self.block_size <= 64 << 20, "block_size"),
            (self.row_group_size >= self.block_size, "row_group_size"),
            (0 <= self.bloom_bits_per_key <= 64, "bloom_bits_per_key"),
            (self.compression in ("none", "uncompressed", "snappy", "zstd"), "compression"),
            (self.target_file_size >= self.block_size, "target_file_size"),
            (1 <= self.l0_compaction_trigger <= self.l0_slowdown_trigger <= self.l0_stop_trigger, "l0 triggers"),
            (2 <= self.num_levels <= 7, "num_levels"),
            (self.l1_max_bytes > 0, "l1_max_bytes"),
            (self.level_multiplier >= 2, "level_multiplier"),
            (self.strategy in ("leveled", "tiered"), "strategy"),
            (self.tiered_width >= 2, "tiered_width"),
            (self.tiered_ratio >= 1, "tiered_ratio"),
            (self.tiered_space_percent >= 1, "tiered_space_percent"),
            (self.merger is None or callable(getattr(self.merger, "full", None)), "merger"),
            (self.max_manifest_edits >= 1, "max_manifest_edits"),
            (self.lease_seconds > 0, "lease_seconds"),
            (self.retention_seconds >= 0, "retention_seconds"),
        ]
        for ok, name in rules:
            if not ok:
                raise InvalidOptions(name)
