"""Repeatable randomness and content hashes, equal in any engine that has md5 and sha256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BUCKET = 3  # hex digits: 4,096 even buckets of a hash order


def draw(seed, *parts) -> Column:
    """32 hex digits that stand for a random draw for (seed, parts)."""
    cols = [seed if isinstance(seed, Column) else F.lit(str(seed))]
    cols += [p if isinstance(p, Column) else F.col(p) for p in parts]
    return F.md5(F.concat_ws("|", *[x.cast("string") for x in cols]))


def u01(hex_digits: Column) -> Column:
    """First eight hex digits as a number in [0, 1)."""
    return F.conv(F.substring(hex_digits, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_bucket(hex_digits: Column, digits: int = HASH_BUCKET) -> Column:
    return F.substring(hex_digits, 1, digits)


def content_hash(*parts) -> Column:
    """Twelve-digit content hash of one row."""
    cols = [p if isinstance(p, Column) else F.col(p) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *[x.cast("string") for x in cols]), 256), 1, 12)


def set_hash(*parts) -> Column:
    """Aggregate: order-free twelve-digit hash of a set of rows.

    Row hashes are summed, so partial sums combine before the shuffle and no group is ever collected.
    """
    cols = [p if isinstance(p, Column) else F.col(p) for p in parts]
    row = F.sha2(F.concat_ws("|", *[x.cast("string") for x in cols]), 256)
    total = F.sum(F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
    return F.substring(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), total.cast("string")), 256), 1, 12)


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    weights = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    return F.transform(weights, lambda w: w / total)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
