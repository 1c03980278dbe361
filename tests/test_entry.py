import ast
import re
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    assert e.entry(spark).count() > 0


def test_every_form_has_its_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_outside_imports_the_llm_subpackage():
    for f in ROOT.glob("anomalake/**/*.py"):
        if "llm" in f.parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(re.search(r"\bllm\b|corpus_pipeline", n) for n in names), f
