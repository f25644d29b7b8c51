"""Registered queries against their SQL, and the registry without the subpackage of training-data operators."""

import csv
import subprocess
import sys

import duckdb
import numpy as np
import pytest

from nearfield import evaluate, queries
from tests.conftest import ROOT, SF01

NAMES = sorted(queries.ORACLE_SQL)


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return list(v) if isinstance(v, (list, tuple)) else v


def compared(rows, columns):
    return sorted((tuple(str(plain(r[c])) for c in columns) for r in rows))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in SF01.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, str(SF01))
    found = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert compared(df.collect(), df.columns) == compared([dict(zip(names, r, strict=True)) for r in found.fetchall()], df.columns)


def test_generated_clusters(spark):
    rows = queries.QUERIES["clustered_exact"](spark, str(SF01)).collect()
    assert len(rows) == 200
    n, dim = 500, 64
    v, q = evaluate.clustered(n, dim).astype(float), evaluate.normal_queries(20, dim).astype(float)
    far = 1 - (v @ q.T) / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(q, axis=1))
    for r in rows:
        assert int(np.argsort(far[:, r["qid"]], kind="stable")[r["rank"] - 1]) == r["id"]


def test_sweep_and_its_file(spark, tmp_path):
    vectors, asked = evaluate.frame(spark, evaluate.clustered(300, 8)), evaluate.frame(spark, evaluate.clustered(300, 8)[:10], "qid", "qvec")
    rows = evaluate.sweep(vectors, asked, 5, cells=6, probes=(1, 6), m=(8,), ef=(10, 300))
    assert [r["method"] for r in rows] == ["exact", "cells", "cells", "graph", "graph"]
    assert rows[0]["recall"] == rows[2]["recall"] == rows[4]["recall"] == 1.0 and all(0 < r["recall"] <= 1 and r["qps"] > 0 for r in rows)
    evaluate.write_csv(rows, tmp_path / "sweep.csv")
    with open(tmp_path / "sweep.csv", newline="") as f:
        told = list(csv.DictReader(f))
    assert [r["method"] for r in told] == [r["method"] for r in rows] and float(told[1]["recall"]) == rows[1]["recall"]


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_registry_without_the_optional_parts(tmp_path):
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    package = tmp_path / "nearfield"
    package.mkdir()
    for f in (ROOT / "nearfield").iterdir():
        if f.name not in ("llm", "__pycache__"):
            (package / f.name).symlink_to(f)
    code = "import __spark_entry__ as e; names = set(e.queries()); assert 'knn_cosine_batch' in names and 'pipeline' not in names and not any(n.startswith('op') for n in names)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=True)
