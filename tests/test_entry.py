import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from weftline import queries
from weftline.__main__ import main

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (bool, str)):
        return x
    return int(x) if hasattr(x, "__index__") else round(float(x), 6)


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(cell(r[k]) for k in at) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert ordered(got.columns, got.collect()) == ordered(columns, want.fetchall())


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_corpus_operators():
    code = "import sys; sys.modules['weftline.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q and not any(k.startswith('op') for k in q)"
    root = Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)


def test_command_line(spark, tmp_path, capsys):
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.py").write_text("import b\n\n\ndef f():\n    return b.g(input())\n")
    (tree / "b.py").write_text("def g(x):\n    return open(x)\n")
    out = tmp_path / "r.json"
    assert main([str(tree), "--out", str(out), "--top", "2", "--markdown", str(tmp_path / "r.md"), "--ask", "which file does g open", "--bundle-dir", str(tmp_path / "b")]) == 0
    assert '"nodes": 2' in out.read_text() and (tmp_path / "r.md").read_text().startswith("# Structure report") and (tmp_path / "b/answer.json").exists()
    assert main(["--diff", str(out), str(out)]) == 0 and "unchanged" in capsys.readouterr().out
    assert main([str(tree), "--why", "a:f"]) == 0 and "b:g" in capsys.readouterr().out
    bad = tmp_path / "bad.json"
    bad.write_text('{"final_claim": "no such claim", "completion_state": "in_progress"}')
    assert main(["--validate-result", str(bad), "--against", str(tmp_path / "b/answer.json"), "--out", str(tmp_path / "v.json")]) == 1
    assert "must_respect_allowed_claims" in (tmp_path / "v.json").read_text()
