"""Filter parameters: one frozen record per filter, checked when it is made."""

from __future__ import annotations

import math
import warnings
from dataclasses import asdict, dataclass
from enum import Enum


class Variant(str, Enum):
    """Names a filter can be created under; several share one bit layout."""

    SYNC_BASIC = "SYNC_BASIC"
    BASIC = "BASIC"
    SYNC_CACHE = "SYNC_CACHE"
    CACHE = "CACHE"
    PIM = "PIM"


FLAT, BLOCKED, SHARDED = "flat", "blocked", "sharded"
LAYOUT = {Variant.SYNC_BASIC: FLAT, Variant.BASIC: FLAT, Variant.SYNC_CACHE: BLOCKED, Variant.CACHE: BLOCKED, Variant.PIM: SHARDED}
SINGLE_THREAD = {Variant.BASIC, Variant.CACHE}

#: Bits in the window that a sharded filter spreads an item's other hashes over.
SHARD_WINDOW_BITS = 4096
#: Largest sub-filter of a shard, as a power of two.
MAX_SHARD_SIZE2 = 21
SPEC_SCHEMA = "variant STRING, size2 INT, nb_hash INT, nb_threads INT, block_size2 INT, nb_ranks INT, units_per_rank INT, nb_subshards INT"


@dataclass(frozen=True)
class FilterSpec:
    """All that fixes which bits an item sets.

    ``nb_threads`` never changes bits: Spark decides the parallelism. It is kept
    since the single-thread variants refuse more than one.
    """

    variant: Variant = Variant.SYNC_BASIC
    size2: int = 20
    nb_hash: int = 8
    nb_threads: int = 1
    block_size2: int = 6
    nb_ranks: int = 8
    units_per_rank: int = 64
    nb_subshards: int = 16

    def __post_init__(self) -> None:
        object.__setattr__(self, "variant", Variant(self.variant))
        if not 3 <= self.size2 <= 62:
            raise ValueError("size2 must be between 3 and 62")
        if self.nb_hash < 1:
            raise ValueError("the number of hash functions must be at least 1")
        if self.variant in SINGLE_THREAD and self.nb_threads > 1:
            raise ValueError(f"{self.variant.value} takes one thread; use SYNC_{self.variant.value}")
        if self.layout == SHARDED:
            if self.nb_ranks < 1 or self.units_per_rank < 1 or self.nb_subshards < 1:
                raise ValueError("ranks, units and sub-shards must be at least 1")
            if self.nb_hash > 63:
                raise ValueError("a sharded filter takes at most 63 hash functions")
            if 1 << self.size2 < 8 * self.nb_shards:
                raise ValueError("the filter has less than one byte for each shard")
            if self.shard_size2 > MAX_SHARD_SIZE2:
                raise ValueError("not enough shards for a filter of this size")
        elif self.nb_hash > 9:
            raise ValueError("the number of hash functions must be below 10")
        if not 1 <= self.block_size2 <= 6:
            raise ValueError("block_size2 must be between 1 and 6")

    @classmethod
    def create(cls, variant: Variant | str, size2: int, nb_hash: int, nb_threads: int = 1, **more) -> FilterSpec:
        """Factory: single-thread variants asked for with more threads warn and take one."""
        variant = Variant(variant)
        if variant in SINGLE_THREAD and nb_threads > 1:
            warnings.warn(f"{variant.value} runs on one thread", stacklevel=2)
            nb_threads = 1
        return cls(variant=variant, size2=size2, nb_hash=nb_hash, nb_threads=nb_threads, **more)

    @property
    def layout(self) -> str:
        return LAYOUT[self.variant]

    @property
    def nb_units(self) -> int:
        return self.nb_ranks * self.units_per_rank

    @property
    def nb_shards(self) -> int:
        return self.nb_units * self.nb_subshards if self.layout == SHARDED else 1

    @property
    def shard_size2(self) -> int:
        """Power of two of the bits in one sub-filter, without its window's overhang."""
        return math.ceil(math.log2((1 << self.size2) // self.nb_shards)) if self.layout == SHARDED else self.size2

    @property
    def shard_bits(self) -> int:
        """Bits that positions in a shard may reach."""
        overhang = {FLAT: 0, BLOCKED: (1 << self.block_size2) - 1, SHARDED: SHARD_WINDOW_BITS}[self.layout]
        return (1 << self.shard_size2) + overhang

    @property
    def words_per_shard(self) -> int:
        return -(-self.shard_bits // 64)

    @property
    def total_bits(self) -> int:
        return self.nb_shards * self.words_per_shard * 64

    def as_row(self) -> tuple:
        return tuple(v.value if isinstance(v, Variant) else v for v in asdict(self).values())

    def same_bits(self, other: FilterSpec) -> bool:
        """True if both specs give every item the same positions."""
        keys = {FLAT: (), BLOCKED: ("block_size2",), SHARDED: ("nb_ranks", "units_per_rank", "nb_subshards")}[self.layout]
        return all(getattr(self, k) == getattr(other, k) for k in ("layout", "size2", "nb_hash", *keys))
