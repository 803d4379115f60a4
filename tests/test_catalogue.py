"""Every query with SQL gives the rows of its SQL, at the smallest scale that has the fixture's vocabulary."""

import math

import duckdb
import pytest

from weft.plans.catalogue import QUERIES
from weft.plans.oracle import ORACLE_SQL

SF = "/root/testdata/sf0.01"
TABLES = ("events", "part", "embeddings")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame, columns):
    frame = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(repr, frame.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, db, name):
    expected, found = db.sql(ORACLE_SQL[name]).df(), QUERIES[name](spark, SF).toPandas()
    columns = sorted(expected.columns)
    assert columns == sorted(found.columns)
    assert rows(expected, columns) == rows(found, columns)


@pytest.mark.parametrize("name", ["kmeans_fit", "kmeanspp_fit", "bisecting_fit"])
def test_clusterings_label_every_user_once(spark, name):
    found = QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    assert found.user_id.is_unique and len(found) == 15
    assert set(found.cluster) <= {0, 1, 2, 3} and (found.dist2 >= 0).all()


def test_recommend_random_is_repeatable(spark):
    a, b = (QUERIES["recommend_random"](spark, SF).toPandas() for _ in range(2))
    assert a.equals(b) and 0 < len(a) <= 5 and not math.isnan(a["rank"].max())


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_only_the_optional_parts_may_be_missing():
    import __spark_entry__ as entry

    def missing(name):
        def load():
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

        return load

    assert entry._optional(missing("weft.llm")) is None and entry._optional(missing("weft.llm.queries")) is None and entry._optional(missing("corpus_pipeline")) is None
    for name in ("public_tokenizers", "weft.plans", "xxhash"):
        with pytest.raises(ImportError):
            entry._optional(missing(name))
