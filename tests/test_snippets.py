"""Windows of normalised traces against the registered SQL on movies of odd and of great length."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from framelake.queries import ORACLE, QUERIES

NAME = "normalised_snippets"


def stored(folder, ids):
    """A folder with a random movie of these frames."""
    images = np.random.default_rng(len(ids)).normal(size=(len(ids), 64)).astype("float32")
    table = {"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(images.tolist(), pa.list_(pa.float32())), "label": pa.array([0] * len(ids), pa.int32())}
    pq.write_table(pa.table(table), folder / "embeddings.parquet")
    return str(folder)


def same_as_sql(df, d):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    cols = ["comp", "start", "i", "value"]
    a, b = (x[cols].sort_values(cols[:3]).reset_index(drop=True) for x in (df.toPandas(), c.sql(ORACLE[NAME]).df()))
    assert len(a) == len(b) > 0 and (a[cols[:3]] == b[cols[:3]]).all(axis=None)
    assert np.allclose(a["value"], b["value"], rtol=0, atol=2e-6)


@pytest.mark.parametrize("n", [2, 39, 40, 41, 60, 61, 100])
def test_lengths_around_the_windows(spark, tmp_path, n):
    d = stored(tmp_path, list(range(n)))
    same_as_sql(QUERIES[NAME](spark, d), d)


def test_gaps_repeats_and_rows_without_id(spark, tmp_path):
    ids = [k for k in range(130) if k % 7 and not 40 <= k < 60]
    d = stored(tmp_path, [*reversed(ids), 5, 5, None, None])
    same_as_sql(QUERIES[NAME](spark, d), d)


def test_a_single_frame_has_no_deviation(spark, tmp_path):
    assert QUERIES[NAME](spark, stored(tmp_path, [0])).collect() == []


def test_a_long_movie_is_read_once_and_no_trace_is_one_row(spark, tmp_path):
    d = stored(tmp_path, list(range(20_011)))
    df = QUERIES[NAME](spark, d)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "collect_list(struct(frame" not in plan
    same_as_sql(df, d)
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan parquet") == 1
