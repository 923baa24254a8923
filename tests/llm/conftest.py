import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "conversations", "embeddings")


@pytest.fixture(scope="session")
def against_sql(spark):
    """Compares a query with its SQL, row by row, on the small tables."""
    from gonggo.llm.queries import CHECKS, QUERIES

    def check(name, sf_dir=SF):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        done = con.execute(CHECKS[name])
        columns = [c[0] for c in done.description]
        want = [dict(zip(columns, row)) for row in done.fetchall()]
        frame = QUERIES[name](spark, sf_dir)
        got = [row.asDict() for row in frame.collect()]
        assert sorted(frame.columns) == sorted(columns)
        rows = [sorted(repr([r[c] for c in sorted(columns)]) for r in side) for side in (got, want)]
        assert rows[0] == rows[1]
        return frame.toPandas()
    return check
