"""The registered queries of this package: name -> function of (spark, folder), and SQL where SQL can express one."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doorlens.llm import alignment, chosen_path, debruijn, differencing, fim, mixing, multi_index, packing, ppm, secrets, seekable, simhash, toxicity
from doorlens.llm.shared import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_language")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document; fold 2 of 4 is never learned from."""
    docs = table(spark, folder, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    guessed = ppm.identify(docs.select("doc_id", "text"), ppm.fit(docs.filter(~held_out)))
    return guessed.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


@query(
    "op2_jaccard_join",
    f"""WITH RECURSIVE t AS (SELECT doc_id, {_WORDS.format("lower(coalesce(text, ''))")} AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM t WHERE len(ws) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8::DOUBLE * (x.n + y.n - c) - 1e-9::DOUBLE),
  r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT t.doc_id, coalesce(least(k.b, t.doc_id), t.doc_id) AS class_id, coalesce(m.links, 0) AS links FROM t
  LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY 1) k ON k.a = t.doc_id LEFT JOIN (SELECT a, count(*) AS links FROM l GROUP BY 1) m ON m.a = t.doc_id""",
)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Class and number of near-duplicate links of every document (five-word shingles, Jaccard 0.8)."""
    return chosen_path.jaccard_join(table(spark, folder, "documents"))


@query("op3_nearest")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    return multi_index.nearest(table(spark, folder, "embeddings"), "vec_id % 50 = 0")


@query("op4_fingerprints")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash of every text and of its edited text; near fingerprints of the ids divisible by 20."""
    return simhash.compare_edits(table(spark, folder, "documents"))


@query("op5_secrets")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Strong and linked secret spans of every document."""
    return secrets.report(table(spark, folder, "documents"))


@query("op6_mixing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of every document the mix of sources takes."""
    return mixing.mix(table(spark, folder, "documents"))


@query(
    "op7_substring_dedup",
    f"""WITH t AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
  w AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM t WHERE len(ws) >= 20)),
  d AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
  c AS (SELECT DISTINCT doc_id, i + j AS i FROM d, (SELECT unnest(range(0, 20)) AS j)),
  o AS (SELECT x.doc_id, x.i, x.w, c.i IS NULL AS kept FROM (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM t) x LEFT JOIN c ON c.doc_id = x.doc_id AND c.i = x.i),
  k AS (SELECT doc_id, count(*) FILTER (NOT kept) AS gone, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (kept), '') AS left_over FROM o GROUP BY 1)
SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256 FROM t LEFT JOIN k ON k.doc_id = t.doc_id""",
)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the words of repeated 20-word windows."""
    return debruijn.deduplicate(table(spark, folder, "documents")).drop("kept")


@query("op8_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document; labels of fold 0 of 5 are never seen."""
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").filter(fold(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels))
    held_out = fold(F.col("doc_id"), 5) == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op9_token_files")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids, written to seekable files and read back."""
    return seekable.round_trip(table(spark, folder, "documents"))


@query("op10_packing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's token pieces with their places in sequences of 4096 ids."""
    return packing.pack(table(spark, folder, "documents"))


@query(
    "op11_fill_in_middle",
    """WITH t AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
  u AS (SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS x, ('0x' || h[9:16])::BIGINT % (n + 1) AS y, ('0x' || h[17:24])::BIGINT % 100 AS f, ('0x' || h[25:32])::BIGINT % 100 AS g FROM t),
  v AS (SELECT doc_id, t, n, least(x, y) AS a, greatest(x, y) AS b,
    CASE WHEN n = 0 OR f >= 90 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN g < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
  w AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM v)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM w""",
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Every document rearranged for fill-in-middle training, and restored from that."""
    return fim.transform(table(spark, folder, "documents")).drop("output")


@query("op12_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Links between the tokens of two tokenizers in every document, with corpus-wide counts."""
    return alignment.report(table(spark, folder, "documents"))


@query("op13_differencing")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's token pieces with their places in near-equal windows of at most 2048 ids."""
    return differencing.pack(table(spark, folder, "documents"))
