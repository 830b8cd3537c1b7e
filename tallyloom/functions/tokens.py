"""Keyed tokens and Bloom-filter encodings, as Column expressions."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(name: str) -> bytes:
    """A key from the environment; there is no default, so that no token is ever made under a known key."""
    value = os.environ.get(name)
    if not value:
        raise RuntimeError(f"{name} isn't set")
    return value.encode()


def hmac_sha256(c: Column, secret: bytes) -> Column:
    """HMAC-SHA256 of a text, as lower-case hex; null stays null. Runs in the JVM."""
    import hashlib

    k = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in k))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(c, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def token(c: Column, secret: bytes, length: int = 20) -> Column:
    """The keyed token of an identifier; null for null and ''."""
    return F.when(c != "", F.substring(hmac_sha256(c, secret), 1, length))


# fixed values: 1,024 bits, 20 positions a bigram
BITS, HASHES = 1024, 20


def bigrams(c: Column) -> Column:
    p = F.concat(F.lit("_"), c, F.lit("_"))
    return F.transform(F.sequence(F.lit(1), F.length(p) - 1), lambda i: p.substr(i, F.lit(2)))


def clk(c: Column, secret: bytes, tag: str) -> Column:
    """The Bloom filter of a text's padded bigrams as 16 longs; null for null and ''. Position i of a bigram is
    h1 + i*h2 modulo 1,024, h1 and h2 being the low bits of the first 8 bytes of two keyed hashes."""
    low = lambda g, n: F.conv(F.substring(hmac_sha256(F.concat(F.lit(n + tag), g), secret), 14, 3), 16, 10).cast("int") % BITS
    hashed = F.transform(F.array_distinct(bigrams(c)), lambda g: F.struct(low(g, "1").alias("a"), low(g, "2").alias("b")))
    at = F.flatten(F.transform(hashed, lambda h: F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda i: (h.a + i * h.b) % BITS)))
    bits = F.array_distinct(at)
    word = lambda w: F.aggregate(F.filter(bits, lambda p: F.floor(p / 64) == w), F.lit(0).cast("long"), lambda acc, p: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))))
    return F.when(c != "", F.transform(F.sequence(F.lit(0), F.lit(BITS // 64 - 1)), word))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two bit sets held as arrays of longs; null where both are empty."""
    ones = lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + F.bit_count(y))
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, y: s + y)
    return 2.0 * both / F.nullif((ones(a) + ones(b)).cast("double"), F.lit(0.0))
