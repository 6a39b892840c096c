"""Extra columns of any name pass through the pipeline's stages: each helper name of the modules is tried."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from doorlens.llm import chosen_path, mixing, ppm, secrets, toxicity
from tests.llm.helpers import docs, rows

LLM = Path(chosen_path.__file__).parent
NAMES = sorted(
    {n for m in ("chosen_path", "components", "mixing", "secrets", "toxicity", "ppm", "shared") for n in re.findall(r"[\"'](_?[a-z][a-z_0-9]*)[\"']", (LLM / f"{m}.py").read_text())}
    - {"doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score"}
)


@pytest.fixture(scope="module")
def crowded(spark):
    """Documents with one extra column per helper name, and a name that needs quoting."""
    d = docs(spark, rows()[:12]).select("doc_id", "text", "lang", "source", "n_chars")
    return d.select("*", *[F.lit(f"own {n}").alias(n) for n in [*NAMES, "a.b `c`", "_score", "_row", "_first"] if n not in d.columns])


def stages(spark):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)], "doc_id bigint, toxic int")
    return {
        "toxicity": lambda d: toxicity.drop_toxic(d, labels),
        "near duplicates": chosen_path.keep_first,
        "secrets": secrets.redact,
        "mixing": mixing.repeat_rows,
        "language": lambda d: ppm.identify(d, ppm.fit(d)).drop("lang_pred", "score"),
    }


@pytest.mark.parametrize("stage", ["toxicity", "near duplicates", "secrets", "mixing", "language"])
def test_extra_columns_stay(spark, crowded, stage):
    got = stages(spark)[stage](crowded)
    assert got.columns == crowded.columns
    for r in got.collect():
        assert all(value == f"own {n}" for n, value in zip(got.columns, r) if n not in ("doc_id", "text", "lang", "source", "n_chars"))
