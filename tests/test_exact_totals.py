"""Queries give the same rows in whatever order the log's clicks are, where classes and genres have equal totals."""

import datetime as dt

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from weft.plans.catalogue import QUERIES
from weft.plans.oracle import ORACLE_SQL

PART = "/root/testdata/sf0.001/part.parquet"


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    """Two folders with the same clicks, one in reverse: each user's mornings last as long as the afternoons, in another order."""
    rng = np.random.RandomState(0)
    part = pq.read_table(PART).slice(0, 100).to_pylist()
    by_day = [[p for p in part if p["p_size"] % 10 and p["p_name"] < "k"], [p for p in part if p["p_size"] % 10 and p["p_name"] >= "k"]]
    rows, n = [], 0
    for user in range(12):
        values = [round(v, 2) for v in rng.exponential(50, 6 + user % 4)]
        for hour, part_of_day, own in ((9, by_day[0], values), (13, by_day[1], values[::-1])):
            key = part_of_day[rng.randint(len(part_of_day))]["p_partkey"]
            for v in own:
                n += 1 if (n + 1) % 7 and (n + 1) % 11 else 2
                rows.append((n, dt.datetime(2024, 1, 1 + rng.randint(28), hour), user, "click", v, f'{{"k": {key}}}'))
    folders = []
    for name, given in (("forward", rows), ("backward", rows[::-1])):
        folder = tmp_path_factory.mktemp(name)
        pq.write_table(pa.table(dict(zip(("event_id", "ts", "user_id", "event_type", "value", "props"), map(list, zip(*given))))), f"{folder}/events.parquet")
        pq.write_table(pa.Table.from_pylist(part), f"{folder}/part.parquet")
        folders.append(str(folder))
    return folders


@pytest.mark.parametrize("name", ["user_features", "user_features_imputed", "component_scatter", "bisecting_fit", "kmeans_fit", "centroid_scatter", "kmeanspp_fit", "clustering_report", "elbow"])
def test_same_rows_in_any_order(spark, logs, name):
    forward, backward = (sorted(map(repr, QUERIES[name](spark, f).collect())) for f in logs)
    assert len(forward) > 2 and forward == backward


@pytest.mark.parametrize("name", ["component_scatter", "kmeans_fit", "bisecting_fit", "clustering_report", "user_features_imputed"])
def test_same_rows_as_sql_with_exact_sums(spark, logs, name):
    """The SQL sums doubles, whose last digits break ties by the order of rows; with sums of decimals it has one result."""
    sql = ORACLE_SQL[name].replace("sum(duration)", "CAST(sum(CAST(duration AS DECIMAL(28, 9))) AS DOUBLE)")
    for folder in logs:
        db = duckdb.connect()
        for t in ("events", "part"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        found = db.execute(sql)
        columns = [c[0] for c in found.description]
        expected = sorted(map(repr, found.fetchall()))
        assert len(expected) > 2 and expected == sorted(repr(tuple(r)) for r in QUERIES[name](spark, folder).select(columns).collect())
