import ast
import pathlib

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["z", "tx", "ty", "bin_x", "bin_y", "value"]


def test_nothing_else_imports_the_optional_package():
    for path in (ROOT / "quadrille").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "quadrille").parts:
            names = [n for x in ast.walk(ast.parse(path.read_text())) for n in ([a.name for a in x.names] if isinstance(x, ast.Import) else [x.module or ""] if isinstance(x, ast.ImportFrom) else [])]
            assert not [n for n in names if n.startswith("quadrille.llm") or n == "corpus_pipeline"], path
