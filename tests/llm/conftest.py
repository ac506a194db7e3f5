import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("llm-tests").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts or (doc_id, text[, lang, source]) rows, with extra columns whose names the operators use inside."""

    def build(rows):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            doc_id, text, lang, source = (*r, *(None, None)[len(r) - 2 :]) if len(r) < 4 else r
            full.append((doc_id, text, lang, source, len(text or ""), "x", 7, "y", "z"))
        return spark.createDataFrame(full, DOCS + ", key string, n int, `row` string, `a.b` string")

    return build
