"""Messages as bits and hashes as seeds, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_seed(*parts: Column, little: bool = False) -> Column:
    """The first eight bytes of the SHA-256 of the parts joined by colons, high byte first (or last), as decimal(20,0)."""
    digits = F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 16)
    if little:
        digits = F.concat(*[F.substring(digits, at, 2) for at in range(15, 0, -2)])
    return F.conv(digits, 16, 10).cast("decimal(20,0)")


def hash_bits(c: Column, width: int = 32) -> Column:
    """The first bits of a SHA-256 as a text of 0 and 1; width is a multiple of 4 up to 60."""
    return F.lpad(F.conv(F.substring(F.sha2(c, 256), 1, width // 4), 16, 2), width, "0")


def message_bits(c: Column, width: int = 32) -> Column:
    """A text that is already width bits stays; any other is hashed."""
    return F.when(c.rlike(f"^[01]{{{width}}}$"), c).otherwise(hash_bits(c, width))


def to_bits(value: Column, width: int) -> Column:
    """An integer as bits, high bit first."""
    return F.lpad(F.bin(value), width, "0")


def sign_bits(values: Column) -> Column:
    """The signs of an array of up to 63 numbers as one integer, the first number as the highest bit."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda n, x: n * 2 + F.when(x > 0, 1).otherwise(0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bit_metrics(expected: Column, found: Column, width: int) -> list[Column]:
    """bit_accuracy, ber and complete_recovery of two messages given as integers."""
    wrong = hamming(expected, found)
    return [((width - wrong) / width).alias("bit_accuracy"), (wrong / width).alias("ber"), (wrong == 0).cast("int").alias("complete_recovery")]


def fingerprint(parts: dict[str, Column]) -> Column:
    """SHA-256 of named values in the order of their names, as one JSON object without blanks."""
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)])), 256)
