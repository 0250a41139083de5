"""Registered queries against DuckDB where there is SQL, and the guard of the entry point."""
import os
import subprocess
import sys

import pytest

import corpus_pipeline
from delayspark.llm import queries as L
from tests.llm.conftest import SF
from tools.check_oracle import compare, duck


@pytest.mark.parametrize("name", sorted(L.ORACLE))
def test_query_matches_sql(spark, name):
    assert compare(spark, duck(SF), name, L.QUERIES[name], L.ORACLE[name], SF).startswith("OK")


def test_one_query_for_each_operator():
    numbers = [n.split("_")[0] for n in L.QUERIES if n.startswith("op")]
    assert sorted(numbers) == sorted(f"op{k}" for k in range(1, 14)) and "pipeline" in L.QUERIES
    assert L.ORACLE.get("pipeline") == corpus_pipeline.ORACLE_SQL


def test_entry_works_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = tmp_path / "repo"
    code.mkdir()
    for name in ("__spark_entry__.py", "delayspark"):
        subprocess.run(["cp", "-r", os.path.join(root, name), code], check=True)
    subprocess.run(["rm", "-r", code / "delayspark" / "llm"], check=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q[:2] == 'op'])"],
                         cwd=code, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": str(code)})
    assert out.stdout.strip().endswith("[]") and int(out.stdout.split()[0]) > 50
