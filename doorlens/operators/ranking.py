"""Ranks, running sums and look-backs that stay spread out when one group holds a large share of the rows.

A plain window sorts each group in one task. Here a group is first cut into buckets that follow the wanted order;
windows run inside (group, bucket) and a small per-bucket table carries totals or last values from one bucket to
the next. Only that table, one row per bucket, is ever windowed per group.
"""

from __future__ import annotations

from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doorlens.functions.geometry import c
from doorlens.functions.hashing import hash_bucket

SPAN = 4096  # frames per timeline block

_START = Window.unboundedPreceding


def two_level_prefix(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Sequence[Column],
    order: Sequence[Column],
    sums: Mapping[str, Column],
    inclusive: bool = True,
) -> DataFrame:
    """Running sums of ``sums`` per ``keys`` in ``order``; ``bucket`` must be a coarsening of that order.

    Keys and buckets are one struct, in which nulls are values like others: the join with the totals and the window
    then need the rows dealt alike, so they are shuffled once.
    """
    keys = list(keys)
    marks, vals = [f"_b{i}" for i in range(len(bucket))], [f"_s{i}" for i in range(len(sums))]
    group = F.struct(F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0), F.struct(*[b.alias(m) for b, m in zip(bucket, marks)]))
    d = df.select("*", group.alias("_g"))
    before = Window.partitionBy("_g.col1").orderBy("_g.col2").rowsBetween(_START, -1)
    offsets = d.groupBy("_g").agg(*[F.sum(v).alias(n) for v, n in zip(sums.values(), vals)])
    offsets = offsets.select("_g", *[F.sum(n).over(before).alias(f"_o{n}") for n in vals])
    inside = Window.partitionBy("_g").orderBy(*order).rowsBetween(_START, 0 if inclusive else -1)
    d = d.join(offsets, "_g", "left")
    out = [
        (F.coalesce(F.col(f"_o{n}"), F.lit(0)) + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(name)
        for (name, v), n in zip(sums.items(), vals)
    ]
    return d.select(*[F.col(x) for x in df.columns], *out)


def hash_rank(df: DataFrame, keys: Sequence[str], digest: str, out: str, ties: Sequence[str] = ()) -> DataFrame:
    """1-based rank per ``keys`` in the order of a hex digest column."""
    ranked = two_level_prefix(
        df, keys, [hash_bucket(F.col(digest))], [F.col(digest), *[F.col(t) for t in ties]], {out: F.lit(1).cast("bigint")}
    )
    return ranked


def number_rows(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], out: str) -> DataFrame:
    """Dense 1-based row number per ``keys``; ``bucket`` (a day, an hour) cuts long groups along the order."""
    return two_level_prefix(df, keys, [bucket], [F.col(o) for o in order], {out: F.lit(1).cast("bigint")})


def block_of(order: str, span: int = SPAN) -> Column:
    return F.floor(c(order) / span)


def look_back(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    rows: int,
    build: Callable[[DataFrame, Callable[[int, int], Window]], DataFrame],
    span: int = SPAN,
) -> DataFrame:
    """Row windows of at most ``rows`` (<= ``span``) preceding rows, whatever gaps the frame numbers have.

    Rows are numbered first; blocks hold ``span`` rows each and the last ``rows`` of a block are also sent to the next
    one, so every window finds its look-back inside its own (keys, block) partition. ``build`` receives the frame and
    a window factory ``w(lo, hi)``.
    """
    numbered = number_rows(df, keys, block_of(order, span), [order], "_no")
    own = F.floor((F.col("_no") - 1) / span)
    tail = F.pmod(F.col("_no") - 1, F.lit(span)) >= span - rows
    d = numbered.withColumn("_blk", F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))))

    def w(lo: int, hi: int):
        return Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(lo, hi)

    d = build(d, w)
    return d.filter(F.col("_blk") == own).drop("_blk", "_no")


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Mapping[str, Column],
    exclusive: bool = False,
    span: int = SPAN,
) -> DataFrame:
    """Last non-null value so far of each expression, over the whole timeline of ``keys``."""
    keys = list(keys)
    names = [f"_v{i}" for i in range(len(values))]
    d = df.select("*", block_of(order, span).alias("_blk"), *[v.alias(n) for v, n in zip(values.values(), names)])
    ends = d.groupBy(*keys, "_blk").agg(*[F.max_by(n, F.when(c(n).isNotNull(), c(order))).alias(f"_e{n}") for n in names])
    past = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(_START, -1)
    carried = ends.select(*keys, "_blk", *[F.last(f"_e{n}", True).over(past).alias(f"_c{n}") for n in names])
    inside = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(_START, -1 if exclusive else 0)
    d = d.join(carried, [*keys, "_blk"], "left")
    out = [F.coalesce(F.last(n, True).over(inside), c(f"_c{n}")).alias(name) for name, n in zip(values, names)]
    return d.select(*[F.col(x) for x in df.columns], *out)


def recent_values(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, k: int, out: str, span: int = SPAN
) -> DataFrame:
    """Array of the last ``k`` non-null values up to each row, oldest first, however far back they lie."""
    keys = list(keys)
    d = df.select("*", block_of(order, span).alias("_blk"), value.alias("_v"))
    d = d.withColumn("_hit", c("_v").isNotNull())
    hits = Window.partitionBy(*keys, "_blk", "_hit").orderBy(order).rowsBetween(-(k - 1), 0)
    inside = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(_START, 0)
    d = d.withColumn("_tail", F.when(c("_hit"), F.collect_list("_v").over(hits)))

    def newest(a: Column) -> Column:
        return F.slice(a, F.greatest(F.size(a) - (k - 1), F.lit(1)), k)

    ends = d.groupBy(*keys, "_blk").agg(F.max_by("_tail", F.when(c("_hit"), c(order))).alias("_end"))
    ends = ends.withColumn("_any", c("_end").isNotNull())
    chain = Window.partitionBy(*keys, "_any").orderBy("_blk").rowsBetween(-(k - 1), 0)
    past = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(_START, -1)
    ends = ends.withColumn("_run", F.when(c("_any"), newest(F.flatten(F.collect_list("_end").over(chain)))))
    carried = ends.select(*keys, "_blk", F.last("_run", True).over(past).alias("_carry"))
    none = F.array().cast(f"array<{dict(d.dtypes)['_v']}>")
    both = F.concat(F.coalesce(c("_carry"), none), F.coalesce(F.last("_tail", True).over(inside), none))
    d = d.join(carried, [*keys, "_blk"], "left").withColumn("_both", both)
    return d.select(*[F.col(x) for x in df.columns], newest(c("_both")).alias(out))


def _prefix(d: DataFrame, keys: list[str], order: str, block: Column, names: list[str], longest: int, radix: int = 8) -> DataFrame:
    """Composes maps x -> a x + b with all earlier ones of their block: after the step of width w every row holds the
    composition of the last ``radix`` w maps. ``names``: the column of a, then those of b."""
    quoted = [f"`{x.replace('`', '``')}`" for x in [*keys, "_blk", order]]
    over = f"OVER (PARTITION BY {', '.join(quoted[:-1])} ORDER BY {quoted[-1]})"
    a, *bs = names
    rest = [f"`{x.replace('`', '``')}`" for x in d.columns if x not in names]
    d, width = d.withColumn("_blk", block), 1
    while width < longest:
        lags = [f"lag({n}, {width * k}, {1 if n == a else 0}D) {over} AS {n}_{k}" for k in range(1, radix) for n in names]
        d = d.selectExpr("*", *lags)
        step = [""] + [f"_{k}" for k in range(1, radix)]
        composed = [f"{a}{' * '.join([''] + [a + k for k in step[1:]])} AS {a}"]
        for b in bs:
            x = f"{b}{step[-1]}"
            for k in reversed(step[:-1]):
                x = f"({b}{k} + {a}{k} * {x})"
            composed.append(f"{x} AS {b}")
        d = d.selectExpr(*rest, "_blk", *composed)
        width *= radix
    return d


def affine_scan(
    df: DataFrame, keys: Sequence[str], order: str, factor: Column, offsets: Mapping[str, Column], span: int = 512, levels: int = 2
) -> DataFrame:
    """Adds x(k) = factor(k) x(k - 1) + offset(k) in ``order`` per ``keys``, for every named offset; x starts at 0.

    Affine maps compose, so a timeline needs no pass from end to end: rows are numbered and cut into blocks of ``span``
    rows, each row composes the maps of its block up to itself, and one row per block, the composition of the whole
    block, goes through the same scan one level up. The last level is one block of span ** levels times fewer rows (at
    most 32,768, or 8 * 10 ** 9 rows per key by default). Null factors and offsets count as 0.
    """
    keys = list(keys)
    names = ["_a", *[f"_x{i}" for i in range(len(offsets))]]
    d = number_rows(df, keys, block_of(order), [order], "_no")
    zero = F.lit(0.0)
    maps = [F.coalesce(v.cast("double"), zero).alias(n) for n, v in zip(names, [factor, *offsets.values()])]
    d = d.select("*", *maps)

    def scan(rows: DataFrame, order: str, level: int) -> DataFrame:
        if level == 0:
            return _prefix(rows, keys, order, F.lit(0), names, 1 << 15).drop("_blk")
        inside = _prefix(rows, keys, order, F.floor((c(order) - 1) / span), names, span)
        # one row per block, numbered from 1: the composition of the whole block
        ends = inside.groupBy(*keys, "_blk").agg(*[F.max_by(n, order).alias(n) for n in names])
        above = scan(ends.withColumn("_up", c("_blk") + 1), "_up", level - 1)
        carried = above.select(*[c(k).alias(f"_k{i}") for i, k in enumerate(keys)], c("_up").alias("_next"), *[c(n).alias(f"_c{n}") for n in names])
        same = c("_blk") == c("_next")
        for i, k in enumerate(keys):
            same = same & inside[k].eqNullSafe(c(f"_k{i}"))
        joined = inside.join(carried, same, "left")
        a, *bs = names
        whole = [(c(b) + c(a) * F.coalesce(c(f"_c{b}"), zero)).alias(b) for b in bs]
        whole.append((c(a) * F.coalesce(c(f"_c{a}"), F.lit(1.0))).alias(a))
        return joined.select(*[x for x in rows.columns if x not in names], *whole)

    out = scan(d, "_no", levels)
    return out.select(*df.columns, *[c(n).alias(name) for n, name in zip(names[1:], offsets)])
