import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from vellum.queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_as_duckdb(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    found = duck.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in df.columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=repr) == want


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'scan_all' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, check=True, env={"PYTHONPATH": str(copy), "PATH": "/usr/bin:/bin"})
