"""The entry module, with and without the training-data subpackage."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() == 1


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_training_data_operators(tmp_path):
    """A copy without that folder and the pipeline still lists all other queries."""
    for path in ROOT.rglob("*.py"):
        name = path.relative_to(ROOT)
        if "llm" not in name.parts and "tests" not in name.parts and name.name != "corpus_pipeline.py":
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_text(path.read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    n, rest = map(int, said.stdout.split())
    assert n > 50 and rest == 0
