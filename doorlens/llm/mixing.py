"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Every document of a source is to be taken target / source size times. The whole part is certain; the fraction is a
probability. A pivotal step takes two documents with open probabilities and moves words from one to the other, up or
down at random so that no probability changes on average, until one of them is whole. Groups of bounded size are
folded so, each leaves at most one open document, and these meet again in a reduction tree with a fixed fan-in. The
words taken from a source differ from its target by less than its last open document.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doorlens.llm.shared import numbered_rows, stored

WORD = r"[^\x20\x09-\x0D]+"
ITEM = "struct<key:bigint,number:bigint,doc_id:bigint,size:bigint,p:double>"
DONE = "array<struct<number:bigint,doc_id:bigint,size:bigint,up:int>>"


@dataclass(frozen=True)
class MixConfig:
    weights: tuple[int, ...] = (1, 2, 3)  # of the sources in code point order, repeating
    most: int = 3  # a source, and a document, counts at most so many times its size
    fan_in: int = 64
    seed: int = 5
    ranked_rows: int = 50_000  # equal rows that one ranking window holds on average


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """source, source_size, n, target: weights share the whole size; targets stop at ``most`` times the source's size.

    A source stops if its limit per weight lies below the common level; the level is the greatest of those that
    result when the first k sources in order of that ratio are stopped. One row per source: these windows stay small.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.partitionBy(F.lit(0)).orderBy("_limit", F.col("source").asc_nulls_last())
    unbounded = Window.unboundedPreceding
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    weights = F.array(*[F.lit(float(w)) for w in config.weights])
    s = s.withColumn("_w", F.element_at(weights, (F.row_number().over(by_name) - 1) % len(config.weights) + 1))
    s = s.withColumn("_limit", config.most * F.col("source_size") / F.col("_w"))
    stopped = F.coalesce(F.sum(config.most * F.col("source_size")).over(by_limit.rowsBetween(unbounded, -1)), F.lit(0))
    rest = F.sum("_w").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumn("_level", (F.sum("source_size").over(everything) - stopped) / rest)
    level = F.max("_level").over(everything)
    target = F.least((config.most * F.col("source_size")).cast("double"), level * F.col("_w"))
    return s.select("source", "source_size", "n", target.alias("target"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def draw(a: Column, b: Column, seed: int) -> Column:
    """Reproducible uniform number in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), a, b), F.lit(1 << 53)) / F.lit(float(1 << 53))


def pivot(state: Column, b: Column, seed: int) -> Column:
    """One step between the open document of a group and the next one."""
    a = state["open"]

    def item(x: Column, p: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("key", "number", "doc_id", "size")], p.alias("p")).cast(ITEM)

    def done(x: Column, up: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("number", "doc_id", "size")], up.cast("int").alias("up"))

    room = F.struct(
        (a["size"] * (1 - a["p"])).alias("a_up"), (a["size"] * a["p"]).alias("a_down"),
        (b["size"] * (1 - b["p"])).alias("b_up"), (b["size"] * b["p"]).alias("b_down"),
    )

    def move(r: Column) -> Column:
        gain, loss = F.least(r["a_up"], r["b_down"]), F.least(r["a_down"], r["b_up"])
        rises = draw(a["key"], b["key"], seed) * (gain + loss) < loss
        return F.struct(
            rises.alias("rises"),
            F.when(rises, r["a_up"] <= r["b_down"]).otherwise(r["a_down"] <= r["b_up"]).alias("a_whole"),
            F.when(rises, r["b_down"] <= r["a_up"]).otherwise(r["b_up"] <= r["a_down"]).alias("b_whole"),
            F.when(rises, gain).otherwise(-loss).alias("words"),
        )

    def settle(m: Column) -> Column:
        none = F.array().cast(DONE)
        left = F.when(m["a_whole"] & m["b_whole"], F.lit(None).cast(ITEM)).when(
            m["a_whole"], item(b, b["p"] - m["words"] / b["size"])
        )
        whole_a = F.when(m["a_whole"], F.array(done(a, m["rises"]))).otherwise(none)
        whole_b = F.when(m["b_whole"], F.array(done(b, ~m["rises"]))).otherwise(none)
        return F.struct(
            left.otherwise(item(a, a["p"] + m["words"] / a["size"])).alias("open"),
            F.concat(state["done"], whole_a, whole_b).alias("done"),
        )

    first = F.struct(item(b, b["p"]).alias("open"), state["done"].alias("done"))
    return F.when(a.isNull(), first).otherwise(let(let(room, move), settle))


def folded(items: DataFrame, seed: int) -> DataFrame:
    """Per (source_no, g): the decided documents and the open one. ``items``: source_no, g, item."""
    start = F.struct(F.lit(None).cast(ITEM).alias("open"), F.array().cast(DONE).alias("done"))
    grouped = items.groupBy("source_no", "g").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return grouped.select("source_no", "g", F.aggregate("items", start, lambda s, b: pivot(s, b, seed)).alias("r")).select(
        "source_no", "g", F.col("r.open").alias("open"), F.col("r.done").alias("done")
    )


def sized(docs: DataFrame, number: Column) -> DataFrame:
    """number, doc_id, source, size and a hash of the text of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        number.alias("number"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"), F.xxhash64(text).alias("text_hash"),
    )


def keyed(sizes: DataFrame, config: MixConfig) -> DataFrame:
    """Adds ``key``, a hash of the row and of its rank among equal rows: equal rows are drawn and dealt apart.

    Equal rows may be swapped, so ranks by number leave the result the same in every run. Ranking windows run per
    bucket of numbers, and a small table carries on from bucket to bucket.
    """
    content = F.xxhash64(F.lit(config.seed), "doc_id", "source", F.col("source").isNull(), "size", "text_hash")
    rows = sizes.withColumn("content", content)
    several = rows.groupBy("content").agg(F.count("*").alias("c")).filter("c > 1").select("content")
    buckets = max(1, -(-sizes.count() // config.ranked_rows))
    dealt = rows.join(several, "content", "left_semi").withColumn("b", F.pmod(F.xxhash64("number"), F.lit(buckets)))
    before = Window.partitionBy("content").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("content", "b").agg(F.count("*").alias("c"))
    offsets = offsets.select("content", "b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("content", "b").orderBy("number")) - 1
    ranked = dealt.withColumn("rank", rank).join(offsets, ["content", "b"])
    apart = ranked.withColumn("key", F.xxhash64("content", F.col("rank") + F.col("before"))).select(*sizes.columns, "key")
    single = rows.join(several, "content", "left_anti").withColumn("key", F.xxhash64("content", F.lit(0).cast("bigint")))
    return single.select(*sizes.columns, "key").unionByName(apart)


def mix(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every row.

    Null texts have size 0, and documents of size 0 are taken 0 times; a null source is a source; null ids and
    repeated rows are documents of their own. Extra columns are ignored; an empty table gives no rows.
    """
    return mixed(stored(sized(docs, F.monotonically_increasing_id()), "sizes"), config).drop("number")


def mixed(sizes: DataFrame, config: MixConfig) -> DataFrame:
    """number, doc_id, size, source_size, target, copies, taken of rows as ``sized`` gives them, stored."""
    per_source = targets(sizes, config).withColumn("source_no", F.xxhash64(F.coalesce("source", F.lit("null")), F.col("source").isNull()))
    per_source = stored(per_source, "targets")
    rows = keyed(sizes, config)
    rows = rows.join(per_source, rows["source"].eqNullSafe(per_source["source"])).drop("source")
    rows = rows.withColumn("_times", F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    rows = rows.withColumn("_whole", F.floor("_times").cast("bigint")).withColumn("_p", F.col("_times") - F.col("_whole"))
    groups = F.greatest(F.ceil(F.col("n") / config.fan_in), F.lit(1))
    item = F.struct("key", "number", "doc_id", "size", F.col("_p").alias("p")).cast(ITEM)
    items = rows.filter("_p > 0").select("source_no", F.pmod("key", groups).cast("bigint").alias("g"), item.alias("item"))
    level = stored(folded(items, config.seed), "fold")
    decided = [level.select("source_no", F.explode("done").alias("d"))]
    most = per_source.agg(F.max("n")).first()[0] or 0
    width = -(-most // config.fan_in)
    while width > 1:
        again = level.filter("open is not null").select(
            "source_no", F.floor(F.col("g") / config.fan_in).cast("bigint").alias("g"), F.col("open").alias("item")
        )
        level = stored(folded(again, config.seed), "fold")
        decided.append(level.select("source_no", F.explode("done").alias("d")))
        width = -(-width // config.fan_in)
    last = draw(F.col("open.key"), F.lit(0), config.seed) < F.col("open.p")
    final = F.struct("open.number", "open.doc_id", "open.size", last.cast("int").alias("up"))
    decided.append(level.filter("open is not null").select("source_no", final.alias("d")))
    rounded = decided[0]
    for more in decided[1:]:
        rounded = rounded.unionByName(more)
    per = per_source.select("source_no", "source_size", "target")
    rounded = rounded.select("source_no", "d.*").join(per, "source_no")
    whole = F.floor(F.col("target") / F.col("source_size")).cast("bigint")
    rounded = rounded.select("number", "doc_id", "size", "source_size", "target", (whole + F.col("up")).alias("copies"))
    certain = rows.filter("_p <= 0").select("number", "doc_id", "size", "source_size", "target", F.col("_whole").alias("copies"))
    return rounded.unionByName(certain).withColumn("taken", F.col("copies") * F.col("size"))


def repeat_rows(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """Documents as often as the mix takes them; columns unchanged. Every row counts for itself, with or without id."""
    rows = numbered_rows(docs, "rows")
    sizes = stored(sized(rows.select("number", "row.doc_id", "row.source", "row.text"), F.col("number")), "sizes")
    copies = mixed(sizes, config).filter("copies > 0").select("number", F.col("copies").cast("int").alias("copies"))
    taken = rows.join(copies, "number")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
