import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_imports_without_the_subpackage(tmp_path):
    """A copy without the llm folders and the pipeline still registers all other queries."""
    for source in [ROOT / "__spark_entry__.py", *ROOT.glob("filegrove/**/*.py"), *ROOT.glob("tests/**/*.py")]:
        at = source.relative_to(ROOT)
        if "llm" not in at.parts:
            (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / at).write_text(source.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'exact_groups' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    # the rest's tests are found and pass without it; all are collected, those of plain functions and of the stream are run
    found = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only"], cwd=tmp_path, check=True, capture_output=True, text=True)
    assert "error" not in found.stdout.lower() and "test_catalogue.py" in found.stdout
    subprocess.run([sys.executable, "-m", "pytest", "tests/test_functions.py", "tests/test_streaming.py", "-q"], cwd=tmp_path, check=True)
