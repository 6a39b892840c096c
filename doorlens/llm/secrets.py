"""Secret scans by multipart credential linking, with DataFrame functions only.

Strong parts (an assignment of a secret, an access identifier, a long hex string) are reported wherever they stand.
Weak parts (an opaque token, a user or client id, an endpoint) mean nothing alone: an interval join brings together
the parts that lie within one scope of each other, and a weak part is reported only where its complements stand near:
an opaque token near an access identifier, an identifier near a secret, an endpoint near both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorlens.llm.shared import row_of, stored

# fixed values: patterns of the strong parts
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # runs of 16 characters and more
HEX = r"[0-9a-f]{32,}"
# weak parts
OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}"
IDENTIFIER = r"""(?i:(user(?:name)?|login|client_?id|account_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=@-]{3,})"""
ENDPOINT = r"(?i:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+"

KINDS = ("assign", "access", "hex", "opaque", "identifier", "endpoint")
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


@dataclass(frozen=True)
class SecretConfig:
    scope: int = 200  # code points between complementary parts
    cell: int = 512  # code points of one cell of the interval join
    mark: str = "[SECRET]"


def spans_of(text: Column, kind: int, pattern: str, least: int = 0) -> Column:
    """Spans (start, kind, end) in code points of all leftmost matches; with ``least``, group 2 must be that long."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + F.char_length(part["gap"])
        end = begin + F.char_length(part["match"])
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        if least:
            long_enough = F.char_length(F.regexp_extract(part["match"], pattern, 2)) >= least
            span = F.when(long_enough, span).otherwise(F.array().cast(SPAN))
        return F.struct(end.alias("at"), F.concat(state["spans"], span).alias("spans"))

    parts = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("match"))
    some = F.aggregate(parts, start, step, lambda state: state["spans"])
    return F.when(F.size(found) > 0, some).otherwise(F.array().cast(SPAN))


def parts_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, the strong spans of each kind and all weak parts of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    strong = [spans_of(text, 0, ASSIGN, 8), spans_of(text, 1, ACCESS), spans_of(text, 2, HEX)]
    weak = F.concat(spans_of(text, 3, OPAQUE), spans_of(text, 4, IDENTIFIER), spans_of(text, 5, ENDPOINT))
    return docs.select(
        "doc_id", F.md5(text).alias("text_key"), *[s.alias(k) for s, k in zip(strong, KINDS)], weak.alias("weak")
    )


def linked(parts: DataFrame, config: SecretConfig) -> DataFrame:
    """text_key and the weak spans (array) that have their complements within the scope and overlap no strong span."""
    once = parts.filter(F.size("weak") > 0).dropDuplicates(["text_key"])  # equal texts have equal parts
    strong = F.concat("assign", "access", "hex")

    def cells(lo: Column, hi: Column) -> Column:
        return F.explode(F.sequence(F.floor(F.greatest(lo, F.lit(0)) / config.cell), F.floor(hi / config.cell)))

    def placed(spans: Column) -> DataFrame:
        return once.select("text_key", F.explode(spans).alias("s")).select("text_key", "s.*")

    weak = placed(F.col("weak"))
    left = weak.select(
        F.col("text_key"), "start", "kind", "end", cells(F.col("start") - config.scope, F.col("end") + config.scope).alias("cell")
    )
    every = placed(F.concat(strong, "weak"))
    right = every.select(
        F.col("text_key").alias("k2"), F.col("start").alias("s2"), F.col("kind").alias("kind2"), F.col("end").alias("e2"),
        cells(F.col("start"), F.col("end")).alias("cell2"),
    )
    near = (F.col("s2") <= F.col("end") + config.scope) & (F.col("start") <= F.col("e2") + config.scope)
    other = (F.col("s2") != F.col("start")) | (F.col("kind2") != F.col("kind"))
    met = left.join(right, (F.col("text_key") == F.col("k2")) & (F.col("cell") == F.col("cell2")) & near & other)
    over = (F.col("s2") < F.col("end")) & (F.col("start") < F.col("e2"))

    def any_of(condition: Column) -> Column:
        return F.coalesce(F.max(condition), F.lit(False))

    seen = met.groupBy("text_key", "start", "kind", "end").agg(
        any_of(over & (F.col("kind2") < 3)).alias("covered"),
        any_of(~over & F.col("kind2").isin(1, 4)).alias("identifier"),
        any_of(~over & F.col("kind2").isin(0, 2, 3)).alias("secret"),
    )
    complete = (
        F.when(F.col("kind") == 3, F.col("identifier"))
        .when(F.col("kind") == 4, F.col("secret"))
        .otherwise(F.col("identifier") & F.col("secret"))
    )
    return (
        seen.filter(~F.col("covered") & complete)
        .groupBy("text_key")
        .agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    )


def scan(docs: DataFrame, config: SecretConfig = SecretConfig()) -> DataFrame:
    """doc_id, text_key, assign, access, hex and linked (arrays of spans) for every row; null texts count as empty.

    Repeated rows give repeated rows, null ids stay, extra columns are ignored, an empty table gives no rows.
    """
    parts = stored(parts_of(docs), "parts")
    found = parts.drop("weak").join(linked(parts, config), "text_key", "left")
    return found.withColumn("linked", F.coalesce("linked", F.array().cast(SPAN)))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def show(s: Column) -> Column:
        return F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))

    return F.concat_ws(",", F.transform(F.sort_array(spans), show))


def report(docs: DataFrame, config: SecretConfig = SecretConfig()) -> DataFrame:
    """Counts and spans per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    base = F.concat("assign", "access", "hex")
    return scan(docs, config).select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.concat(base, "linked")).alias("spans"),
        F.size("linked").cast("bigint").alias("n_linked"),
    )


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """Text with every span (sorted; they may overlap) replaced by one mark."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        more = F.concat(state["out"], gap, F.lit(mark))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(s["start"] >= state["at"], more).otherwise(state["out"]).alias("out"),
        )

    def tail(state: Column) -> Column:
        return F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.char_length(text)))

    return F.aggregate(F.sort_array(spans), start, step, tail)


def redact(docs: DataFrame, config: SecretConfig = SecretConfig()) -> DataFrame:
    """The same rows with every reported span replaced by a mark and ``n_chars`` (if there) kept true; others unchanged."""
    spans = F.concat("assign", "access", "hex", "linked")
    found = scan(docs, config).select("text_key", spans.alias("spans")).filter(F.size("spans") > 0).dropDuplicates(["text_key"])
    joined = docs.select(row_of(docs), F.md5("text").alias("text_key")).join(found, "text_key", "left")
    row = F.col("row")
    text = F.when(F.col("spans").isNull(), row["text"]).otherwise(redacted(row["text"], F.col("spans"), config.mark))
    new = joined.select("row", text.alias("text"), F.col("spans").isNull().alias("same"))
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("same"), row["n_chars"]).otherwise(F.char_length("text").cast("bigint"))}
    return new.select(*[(changed[c] if c in changed else row.getField(c)).alias(c) for c in docs.columns])
