"""Networks of far and repeated places against their SQL, and responses read more than once."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from ringfold.queries import extraction
from ringfold.sources.derived import Derived


@pytest.fixture
def far(spark, tmp_path):
    """Three outlines: an ordinary one, one that stays on a place, one far north."""
    rows = np.random.default_rng(3).normal(0, 0.1, (3, 64))
    rows[1, 10:14] = np.tile(rows[1, 10:12], 2)
    values = [(k, [float(v) for v in row]) for k, row in zip((0, 1, 2500), rows, strict=True)]
    spark.createDataFrame(values, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["s03_street_network", "s04_decode_way", "s05_region_network", "w04_running_decode"])
def test_every_vertex_is_decoded(spark, far, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{far}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(entry.oracle_sql()[name]).fetchall())
    assert sorted(tuple(r) for r in entry.queries()[name](spark, far).collect()) == want


def test_places_in_a_response_do_not_depend_on_the_run(spark, sf):
    own = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    found = []
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for parts in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append(sorted(map(tuple, extraction.elements(Derived(spark, sf)).select("pos", "type", "id").collect())))
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)
    assert found[0] == found[1]
