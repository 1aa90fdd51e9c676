import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_entry_and_oracle(spark):
    import duckdb

    assert entry.entry(spark).count() > 0
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    for name in ("exact_dup_groups", "run_summary", "near_pairs_confirmed", "complete_linkage_12", "group_winner", "chat_trim", "image_hashes", "image_scores", "image_run", "edit_plan_adjusted", "telemetry_jsonl", "dest_name_probe"):
        got = entry.queries()[name](spark, SF)
        want = con.sql(entry.oracle_sql()[name])
        order = [want.columns.index(c) for c in got.columns]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall()), name


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_stands_without_the_subpackage(tmp_path):
    """A copy without the subpackage, its tests and the pipeline imports and keeps its own queries."""
    root = Path(entry.__file__).parent
    shutil.copytree(root, tmp_path / "copy", ignore=lambda folder, names: [n for n in names if n in ("llm", "corpus_pipeline.py", ".git", "__pycache__")])
    code = "import __spark_entry__ as e; q = e.queries(); assert 'image_run' in q and len(q) > 60 and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=env, check=True, timeout=120)
