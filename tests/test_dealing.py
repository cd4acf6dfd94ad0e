"""Queries that make a text of each key and parse it: the work is dealt over tasks, and texts are read by the faster loader."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import yaml
from pyspark.sql import functions as F

from pagegraph import catalog
from pagegraph.operators import openapi

ROWS = 11_000
#: Queries whose rows keep the task they were made in, and their table.
DEALT = {"yaml_keys": "part", "links_script": "customer", "links_button": "customer", "openapi_load": "part", "openapi_v3": "part", "openapi_order": "part", "openapi_ref": "part", "forms": "customer", "code_paths": "customer", "base_href": "customer", "form_params": "customer"}
#: Queries that shuffle what they made.
SUMMED = {"login_form": "customer", "openapi_params": "part", "form_drop_empty": "customer"}
KEYS = {"part": "p_partkey", "customer": "c_custkey"}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Tables of a single row group, which a file's splits can't divide."""
    at = tmp_path_factory.mktemp("dealing")
    for name, key in KEYS.items():
        pq.write_table(pa.table({key: pa.array(range(1, ROWS + 1), pa.int64())}), at / f"{name}.parquet")
    return str(at)


@pytest.mark.parametrize("name", DEALT)
def test_dealt_over_tasks(spark, folder, name):
    found = catalog.QUERIES[name](spark, folder)
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {DEALT[name]} AS SELECT * FROM read_parquet('{folder}/{DEALT[name]}.parquet')")
    assert sum(tasks) == con.execute(f"SELECT count(*) FROM ({catalog.ORACLES[name]})").fetchone()[0]
    assert len(tasks) == 3
    assert max(tasks) < 1.2 * min(tasks)


@pytest.mark.parametrize("name", SUMMED)
def test_dealt_and_summed(spark, folder, name):
    found = catalog.QUERIES[name](spark, folder)
    assert "RoundRobinPartitioning(3)" in found._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {SUMMED[name]} AS SELECT * FROM read_parquet('{folder}/{SUMMED[name]}.parquet')")
    expected = con.execute(f"SELECT {', '.join(found.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(expected)


PLAIN = "openapi: 3.0.0\npaths:\n  /a: {get: {parameters: [{name: 7, in: query}, {name: 'été', in: query}]}}\n"
ODD = [
    PLAIN, "a:\tb", "a: b\t# c\n", "\ufeffa: b", "a:\n\ufeff  b: c", "{a?b: c}", "{a: b?}", "{a:,b}", "{a:, b: c}", "e: ! #x\n", "e: !!str 1", "- - - a\n- ? b", "%YAML 1.2\n---\na: b", "a: b\r\nc: d\rx: y",
    "a: \x85b", "a: b\u2028c", "a: \x07", "x: &k {a: 1}\ny: *k\n<<: *k", "a: *none", "a: @b", "a: `b", "a: |\n  b\n   c\n", "a: >-\n  b\n\n  c", "2020-01-01: x", "a: [b, c", "free text", "", "a: b\n---\nc: d", "a: \U0001f600",
]


def outcome(load, text):
    try:
        return load(text)
    except Exception as e:
        return type(e)


@pytest.mark.parametrize("text", ODD)
def test_yaml_as_before(text):
    assert outcome(openapi.yaml_tree, text) == outcome(yaml.safe_load, text)


@pytest.mark.skipif(not yaml.__with_libyaml__, reason="no libyaml")
def test_yaml_by_libyaml(monkeypatch):
    expected = yaml.safe_load(PLAIN)
    monkeypatch.setattr(yaml, "safe_load", lambda text: pytest.fail("the slow loader was asked"))
    assert openapi.yaml_tree(PLAIN) == expected


@pytest.mark.parametrize("text", ["a: " + "[" * 100_000, "- " * 100_000])
def test_yaml_deep(text):
    """libyaml's composer would end the worker here."""
    assert openapi.loaded(text) is None
