"""Registered queries beside their SQL on the smallest tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
SAMPLE = ("master_merge", "list_cells", "urgency_scores", "label_distribution", "posting_techs",
          "related_techs", "region_top_techs", "recommendation_pool", "recommend_filtered",
          "text_fallback", "group_split", "overlap_report", "parsed_pages", "fallback_grid",
          "tfidf_vectors")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def plain(value):
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if value is None or isinstance(value, (str, bool)):
        return repr(value)
    try:
        number = float(value)
    except (TypeError, ValueError):
        return str(value)
    return "nan" if math.isnan(number) else f"{number:.9g}"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(SF + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, SF)
    cursor = duck.execute(entry_points.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(str(plain(r)) for r in cursor.fetchall())
    got = sorted(str(plain([r[c] for c in columns])) for r in df.collect())
    assert got == want


def test_registry():
    names = entry_points.queries()
    assert len(names) > 120 and set(entry_points.oracle_sql()) <= set(names)
    assert not [sql for sql in entry_points.oracle_sql().values() if "ROLLUP" in sql.upper()]


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["tech", "n", "match_count", "rate_pct"]
