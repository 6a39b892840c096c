"""Document fingerprints by SimHash, with DataFrame functions only.

Terms are pairs of neighbouring words. Every occurrence votes with the 64 bits of its hash, for or against each bit of
the fingerprint, weighted by the pair's length (long words are rare words). Texts that share most terms share most
bits. Near fingerprints are found by permuted block tables: the bits are cut into blocks, and two fingerprints within
the radius agree in all bits of some choice of (blocks - radius) blocks; each choice is one table keyed by those bits.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doorlens.llm.shared import stored, words

BITS = 64
ID_BLOCK = 1 << 16  # ids that one window over ids holds at most


def terms(found: Column) -> Column:
    """(h, w) of all pairs of neighbouring words; a single word is a term of its own, no words give none."""

    def term(*parts: Column) -> Column:
        length = F.char_length(parts[0]) if len(parts) == 1 else F.char_length(parts[0]) + F.char_length(parts[1])
        return F.struct(F.xxhash64(*parts).alias("h"), length.cast("bigint").alias("w"))

    n = F.size(found)
    pairs = F.zip_with(F.slice(found, 1, n - 1), F.slice(found, 2, n - 1), lambda a, b: term(a, b))
    return F.when(n > 1, pairs).otherwise(F.transform(found, lambda a: term(a)))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Fingerprint (long) per combination of ``keys``, which must name one text each; texts without words get 0."""
    found = texts.select(*keys, words(F.col(text)).alias("_words")).select(*keys, terms(F.col("_words")).alias("_terms"))
    rows = found.select(*keys, F.explode_outer("_terms").alias("_t")).select(*keys, "_t.h", "_t.w")
    votes = [F.sum(F.getbit("h", F.lit(b)) * F.col("w")).alias(f"_v{b}") for b in range(BITS)]
    counted = rows.groupBy(*keys).agg(F.sum("w").alias("_all"), *votes)
    print_ = None
    for b in range(BITS):
        bit = F.when(2 * F.col(f"_v{b}") > F.col("_all"), F.shiftleft(F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))
        print_ = bit if print_ is None else print_.bitwiseOR(bit)
    return counted.select(*keys, print_.alias("fingerprint"))


def as_text(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / BITS


def block_masks(blocks: int, radius: int) -> list[int]:
    """One mask per choice of blocks that two fingerprints within the radius must share in some table."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) & ~((1 << edges[i]) - 1) for i in range(blocks)]
    kept = [sum(masks[i] for i in c) for c in combinations(range(blocks), blocks - radius)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in kept]


def within(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All (query, fingerprint) within the Hamming radius, each once; both sides hold distinct longs ``fingerprint``.

    A pair meets in every table whose blocks agree; the first of them reports it. Keys have BITS * (blocks - radius) /
    blocks bits: more blocks give more selective tables for more fingerprints.
    """
    masks = block_masks(blocks, radius)
    entries = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)]))
    q = queries.select(F.col("fingerprint").alias("query"), entries.alias("e")).select("query", "e.t", "e.k")
    p = prints.select("fingerprint", entries.alias("e")).select("fingerprint", F.col("e.t").alias("t2"), F.col("e.k").alias("k2"))
    apart = F.col("query").bitwiseXOR(F.col("fingerprint"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)])
    near = (F.col("t") == F.col("t2")) & (F.col("k") == F.col("k2")) & (F.bit_count(apart) <= radius) & (first == F.col("t"))
    return q.join(p, near).select("query", "fingerprint")


def in_blocks(ids: DataFrame, rows: int) -> DataFrame:
    """Stored ``ids`` with ``_b``: ranges of ascending ids that hold about ``ID_BLOCK`` of ``rows`` rows, however sparse."""
    ranges = ids.repartitionByRange(max(1, -(-rows // ID_BLOCK)), "doc_id")
    return stored(ranges.withColumn("_b", F.spark_partition_id()), "ids")


def neighbours(blocked: DataFrame) -> DataFrame:
    """Adds next_id, prev_id and prev_n to distinct ids (doc_id, n, _b), in a circle by ascending id.

    Windows hold one block of ids each; a table with one row per block carries over from block to block.
    """
    ends = blocked.groupBy("_b").agg(F.min("doc_id").alias("_lo"), F.max(F.struct("doc_id", "n")).alias("_hi"))
    order = Window.partitionBy(F.lit(0)).orderBy("_b")
    everything = Window.partitionBy(F.lit(0))
    ends = ends.select(
        "_b",
        F.coalesce(F.lead("_lo").over(order), F.min("_lo").over(everything)).alias("_after"),
        F.coalesce(F.lag("_hi").over(order), F.max("_hi").over(everything)).alias("_before"),
    )
    inside = Window.partitionBy("_b").orderBy("doc_id")
    before = F.coalesce(F.lag(F.struct("doc_id", "n")).over(inside), F.col("_before"))
    kept = [c for c in blocked.columns if c != "_b"]
    linked = blocked.join(ends, "_b").select(*kept, F.coalesce(F.lead("doc_id").over(inside), F.col("_after")).alias("next_id"), before.alias("_p"))
    return linked.select(*kept, "next_id", F.col("_p.doc_id").alias("prev_id"), F.col("_p.n").alias("prev_n"))


def compare_edits(docs: DataFrame, radius: int = 3, blocks: int = 6, every: int = 20) -> DataFrame:
    """Fingerprints of every text and of its edited text (last quarter replaced by the start of the next document's).

    Also ``near_count``: for ids divisible by ``every``, how many other rows lie within the radius. Null texts count as
    empty; rows without id are left out; of repeated ids all rows are kept, and the first by digest is the one that
    neighbours see. Extra columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    # Both joins below read this one exchange of the texts.
    base = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), text)
    lengths = base.select("doc_id", F.struct(F.md5("text").alias("k"), F.char_length("text").cast("bigint").alias("n")).alias("s"))
    ids = lengths.groupBy("doc_id").agg(F.min("s").alias("s")).select("doc_id", F.col("s.n").alias("n"), F.col("s.k").alias("text_key"))
    ring = stored(neighbours(in_blocks(ids, docs.count())), "ring")
    # A repeated id may hold longer texts than its first: the starts are cut to the longest quarter of the id's rows.
    longest = lengths.groupBy("doc_id").agg(F.max("s.n").alias("longest"))
    need = ring.select("doc_id", "prev_id", "text_key").join(longest.withColumnRenamed("doc_id", "prev_id"), "prev_id")
    cut = F.substring(F.col("text"), F.lit(1), F.floor(F.col("longest") / 4).cast("int"))
    # Not as a filter: an equality of digests would become a join key and deal the texts out once more.
    start = F.when(F.md5("text") == F.col("text_key"), cut).alias("start")
    starts = base.join(need, "doc_id").select(F.col("prev_id").alias("doc_id"), start).groupBy("doc_id").agg(F.max("start").alias("start"))
    n = F.char_length("text").cast("bigint")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - quarter).cast("int")), F.substring(F.col("start"), F.lit(1), quarter))
    row = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.md5("text")))
    both = base.join(starts, "doc_id").withColumn("row", row).withColumn("n_chars", n).withColumn("edited", edited)
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.lit("").alias("sha"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.sha2("edited", 256).alias("sha"), F.col("edited").alias("t")))
    keys = ["doc_id", "row", "n_chars", "kind", "sha"]
    texts = both.select("doc_id", "row", "n_chars", F.explode(kinds).alias("k")).select("doc_id", "row", "n_chars", "k.*")
    prints = stored(fingerprints(texts, keys, "t"), "prints")
    own = prints.filter("kind = 0").drop("kind", "sha")
    changed = prints.filter("kind = 1").select("doc_id", "row", F.col("sha").alias("edited_sha256"), F.col("fingerprint").alias("_edited"))
    following = own.filter("row = 1").select(F.col("doc_id").alias("next_id"), F.col("fingerprint").alias("_next"))
    distinct = own.groupBy("fingerprint").agg(F.count("*").alias("_copies"))
    asked = own.filter(F.col("doc_id") % every == 0).select("fingerprint").distinct()
    near = within(asked, distinct.select("fingerprint"), radius, blocks).join(distinct, "fingerprint")
    near = near.groupBy(F.col("query").alias("fingerprint")).agg((F.sum("_copies") - 1).alias("_near"))
    out = own.join(changed, ["doc_id", "row"]).join(ring.select("doc_id", "next_id"), "doc_id").join(following, "next_id")
    out = out.join(near, "fingerprint", "left")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("fingerprint")).alias("fingerprint"),
        as_text(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("_edited")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"),
        F.when(F.col("doc_id") % every == 0, F.col("_near")).alias("near_count"),
    )
