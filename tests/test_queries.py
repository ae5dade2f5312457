"""Every registered query against its reference SQL, and some against themselves under other partitionings."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry_points
from check_queries import rows_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = entry_points.queries()
ORACLES = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_reference_sql(name, spark, database):
    result = QUERIES[name](spark, SF)
    mine = rows_of(result.columns, result.collect())
    if name not in ORACLES:
        assert mine[1]
        return
    cursor = database.execute(ORACLES[name])
    theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert mine == theirs


@pytest.mark.parametrize(
    "name",
    ["i17_low_performing_questions", "e1_dedup_evaluations", "i6_profile_changes", "e6_shuffled_chunks", "i16_top_up_prompts", "h17_seeded_draw"],
)
def test_result_does_not_depend_on_partitions(name, spark):
    def run(partitions):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            result = QUERIES[name](spark, SF)
            return rows_of(result.columns, result.collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")

    assert run(3) == run(17)


def test_entry(spark):
    result = entry_points.entry(spark)
    assert result.columns == ["model", "language", "dataset", "shots", "sample_index", "average_score", "question"]
    assert result.count() > 0


def test_other_queries_are_there_without_an_optional_library():
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); print(len([n for n in q if not n.startswith(('op', 'pipeline'))]), any(n.startswith('op') for n in q))"
    root = os.path.dirname(os.path.abspath(entry_points.__file__))
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert out == [str(len([n for n in QUERIES if not n.startswith(("op", "pipeline"))])), "False"]
