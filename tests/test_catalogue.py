"""Every query of the catalogue against its SQL, over the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from marlstone.functions import reprs
from marlstone.plans import catalogue, derived  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(frame: pd.DataFrame) -> list[tuple]:
    shown = lambda x: "NULL" if pd.isna(x) else repr(round(float(x), 9)) if isinstance(x, float) and not math.isinf(x) else str(x)
    return sorted(tuple(map(shown, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, DIR).toPandas(), duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_order_covers_all_nodes(spark):
    imports, nodes = catalogue.imports_of(spark, DIR)
    place = {r["path"]: r["pos"] for r in catalogue.QUERIES["q_topo_order"](spark, DIR).collect()}
    assert len(place) == nodes.count()
    edges = catalogue.QUERIES["q_dependency_edges"](spark, DIR).collect()
    assert all(place[e["dst"]] < place[e["src"]] for e in edges)


def test_all_rows_take_part(spark):
    """Every document is a file of its own, and none is left out of the states."""
    files = catalogue.corpus_files(spark, DIR)
    assert files.select("path").distinct().count() == files.count() == catalogue.QUERIES["q_change_status"](spark, DIR).count()


def test_value_reprs_at_the_limit(spark, tmp_path):
    """Texts about as long as a context shows whole: the query's quotes don't count, those of the operator do."""
    turns = pd.DataFrame([(1, i, "x" * n) for i, n in enumerate((57, 60, 61, 1197, 1198, 1199, 1200, 1201))], columns=["conv_id", "turn", "text"])
    spark.createDataFrame(turns).write.parquet(f"{tmp_path}/conversations.parquet")
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        assert rows(catalogue.QUERIES["q_value_reprs"](spark, str(tmp_path)).toPandas()) == rows(c.sql(catalogue.ORACLES["q_value_reprs"]).df())
    assert reprs.context_of(["x" * 1199]) == f"list ['{'x' * 1196}...]"
