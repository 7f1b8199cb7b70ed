"""Queries over all frames, groups and pairs: on groups on both sides of the thresholds of pairs."""

import duckdb
import pytest
from lamina import catalog

from test_queries import rows

#: Queries over all frames, groups and pairs.
WHOLE = ("valid_renormalise", "nearest_edge", "owner_propagation", "descriptor_matches", "silhouette_residual", "list_filter", "pairwise_join", "pair_sampling")


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """60 frames, all events, and conversations on both sides of the thresholds of pairs."""
    d, c = tmp_path_factory.mktemp("small"), duckdb.connect()
    source = "/root/testdata/sf0.001"
    for name, sql in {
        "embeddings": f"SELECT * FROM '{source}/embeddings.parquet' WHERE vec_id < 60",
        "events": f"SELECT event_id, ts, user_id + 40 AS user_id, event_type, value, props FROM '{source}/events.parquet'",
        "conversations": "SELECT s AS conv_id, t AS turn, 'user' AS role, 'x' AS text FROM (SELECT unnest([3, 6, 7, 24, 25, 40, 41, 60])::BIGINT AS s), generate_series(0, 59) AS g(t) WHERE t < s",
    }.items():
        c.sql(f"COPY ({sql}) TO '{d}/{name}.parquet' (FORMAT parquet)")
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    return str(d), c


@pytest.mark.parametrize("name", WHOLE)
def test_whole_job(spark, small, name):
    folder, duck = small
    got = catalog.queries()[name](spark, folder).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert len(want) and rows(got) == rows(want)


def test_descriptor_matches_on_copies_and_missing_values(spark, tmp_path):
    """Copies of two to four, a group of one, rows without a group, a descriptor or some of its values."""
    c = duckdb.connect()
    source = "/root/testdata/sf0.001/embeddings.parquet"
    c.sql(f"""COPY (SELECT vec_id + 1000 * k AS vec_id, CASE WHEN vec_id % 50 = 7 THEN NULL WHEN vec_id % 50 = 8 THEN [CASE WHEN n % 3 > 0 THEN embedding[n] END FOR n IN range(1, 65)]::FLOAT[] ELSE embedding END AS embedding,
        CASE WHEN vec_id = 11 THEN NULL WHEN vec_id = 12 THEN 77 + k ELSE label % 3 END AS label FROM '{source}', generate_series(0, 3) AS s(k) WHERE vec_id < 120 AND k <= vec_id % 4) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)""")
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got = catalog.queries()["descriptor_matches"](spark, str(tmp_path)).toPandas()
    want = c.sql(catalog.oracle_sql()["descriptor_matches"]).df()
    assert len(want) and rows(got) == rows(want)
