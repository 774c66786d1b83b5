"""Registered queries: the entry file imports with and without the training-data part, and SQL agrees with Spark."""

import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
TINY = Path("/root/testdata/sf0.001")


def test_import_without_the_training_data_part(tmp_path):
    for name in ("__spark_entry__.py", "gleaner"):
        (tmp_path / name).symlink_to(REPO / name) if name.endswith(".py") else None
    (tmp_path / "gleaner").mkdir()
    for p in (REPO / "gleaner").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "gleaner" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((REPO / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": "/tmp"}, check=True)


def test_sql_belongs_to_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not TINY.is_dir(), reason="the given tables are not here")
@pytest.mark.parametrize("name", ["rating_distribution", "period_metrics", "distinctive_phrases", "category_stats", "pair_join", "feed_frame", "typed_review", "store_rows", "reviews_csv", "population_compare", "unit_candidates", "representatives", "pair_strata", "mart_category_precision"])
def test_sql_agrees(spark, name):
    import duckdb

    from gleaner.plans import registry

    c = duckdb.connect()
    for p in TINY.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = registry.QUERIES[name](spark, str(TINY))
    cols = ", ".join(f'"{x}"' for x in sorted(df.columns))
    same = lambda rows: sorted(tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert same(c.sql(f"SELECT {cols} FROM ({registry.SQL[name]})").fetchall()) == same(df.select(*sorted(df.columns)).collect())


def test_feed_pages_are_bounded(spark, tmp_path):
    import json

    from gleaner.plans import demo, registry

    spark.range(4000).selectExpr("id AS conv_id", "explode(array(0, 1)) AS turn").write.parquet(str(tmp_path / "conversations.parquet"))
    sizes = [len(json.loads(r["value"])["feed"]["entry"]) for r in demo.feed_pages(spark, str(tmp_path)).collect()]
    assert max(sizes) == 50 and sum(sizes) == 8000
    assert registry.QUERIES["feed_frame"](spark, str(tmp_path)).count() == 120
