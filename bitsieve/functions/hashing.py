"""Hash functions over BIGINT items, as columns and as plain Python for reference."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitsieve.functions.u64 import MASK64, lit64, signed, srl

#: The ten seed bases of the hash family.
SEED_BASES = (
    0xAAAAAAAA55555555,
    0x33333333CCCCCCCC,
    0x6666666699999999,
    0xB5B5B5B54B4B4B4B,
    0xAA55AA5555335533,
    0x33CC33CCCC66CC66,
    0x6699669999B599B5,
    0xB54BB54B4BAA4BAA,
    0xAA33AA3355CC55CC,
    0x33663366CC99CC99,
)
#: Spark's Murmur3 starts at 42; hashing this INT first leaves a running seed of 0.
MURMUR_SEED_ZERO = -1693959553


@lru_cache
def seeds(user_seed: int = 0) -> tuple[int, ...]:
    """Effective seeds. Each is multiplied by the one three places on, in ascending order and in place."""
    s = list(SEED_BASES)
    for i in range(len(s)):
        s[i] = (s[i] * s[(i + 3) % len(s)] + user_seed) & MASK64
    return tuple(s)


def hash64(key: int, seed: int) -> int:
    """Reference model of :func:`with_hash64` for one key."""
    h = seed ^ (seed << 7 & MASK64) ^ (key * (seed >> 3) & MASK64) ^ (~((seed << 11) + (key ^ (seed >> 5))) & MASK64)
    h = ((~h & MASK64) + (h << 21)) & MASK64
    h ^= h >> 24
    h = h * 265 & MASK64
    h ^= h >> 14
    h = h * 21 & MASK64
    h ^= h >> 28
    return (h + (h << 31)) & MASK64


def with_hash64(df: DataFrame, item: str, outs: dict[str, int]) -> DataFrame:
    """Add ``outs``: column name -> seed. Build it inside ``wrapping``.

    Each step is a projection of its own, so that no step's expression is
    repeated inside the next one.
    """
    x = F.col(item)

    def start(s: int) -> Column:
        a = lit64(s ^ (s << 7))
        b = x * lit64(s >> 3)
        c = F.bitwise_not(lit64(s << 11) + x.bitwiseXOR(lit64(s >> 5)))
        return a.bitwiseXOR(b).bitwiseXOR(c)

    def over(f) -> DataFrame:
        return df.withColumns({o: f(F.col(o)) for o in outs})

    df = df.withColumns({o: start(s) for o, s in outs.items()})
    df = over(lambda h: F.bitwise_not(h) + F.shiftleft(h, 21))
    df = over(lambda h: h.bitwiseXOR(srl(h, 24)))
    df = over(lambda h: h * lit64(265))
    df = over(lambda h: h.bitwiseXOR(srl(h, 14)))
    df = over(lambda h: h * lit64(21))
    df = over(lambda h: h.bitwiseXOR(srl(h, 28)))
    return over(lambda h: h + F.shiftleft(h, 31))


#: Multiplier and shift of the rule that spreads a byte over 24 bits.
MIX_FACTOR, MIX_SHIFT = 0x9E3779B97F4A7C15, 40


def mixing_table() -> tuple[int, ...]:
    """What the rule gives for each byte."""
    return tuple((i * MIX_FACTOR & MASK64) >> MIX_SHIFT for i in range(256))


def mix16(x: Column, i: int, bits: int) -> Column:
    """Low ``bits`` bits of the xor of the spread bytes i..i+7 and i+8..i+15 of the item. Build it inside ``wrapping``."""
    byte = lambda n: srl(srl(x, n).bitwiseAND(lit64(255)) * lit64(MIX_FACTOR), MIX_SHIFT)
    return byte(i).bitwiseXOR(byte(i + 8)).bitwiseAND(lit64((1 << bits) - 1))


def mix16_model(x: int, i: int, bits: int) -> int:
    t = mixing_table()
    return (t[(x >> i) & 255] ^ t[(x >> (i + 8)) & 255]) & ((1 << bits) - 1)


def fold16(x: Column, i: int) -> Column:
    """Xor of the four 16-bit lanes of ``x >>> i``."""
    y = srl(x, i) if i else x
    out = y.bitwiseXOR(srl(y, 16)).bitwiseXOR(srl(y, 32)).bitwiseXOR(srl(y, 48))
    return out.bitwiseAND(lit64(0xFFFF))


def fold16_model(x: int, i: int) -> int:
    y = x >> i
    return (y ^ (y >> 16) ^ (y >> 32) ^ (y >> 48)) & 0xFFFF


def murmur32(x: Column) -> Column:
    """Murmur3 x86 32-bit of the item's eight bytes at seed 0, zero-extended to BIGINT."""
    return F.hash(F.lit(MURMUR_SEED_ZERO).cast("int"), x).cast("bigint").bitwiseAND(lit64(0xFFFFFFFF))


def fastrange32(key: Column, n: int) -> Column:
    """(key * n) >>> 32 for a 32-bit key: a position in 0..n-1 without a division."""
    return srl(key * F.lit(n).cast("bigint"), 32)


def string_key(c: Column) -> Column:
    """BIGINT items out of keys of any other type."""
    return F.xxhash64(c)


__all__ = ["SEED_BASES", "fastrange32", "fold16", "fold16_model", "hash64", "mix16", "mix16_model", "mixing_table", "murmur32", "seeds", "signed", "string_key", "with_hash64"]
