import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_only_a_missing_subpackage_is_excused(tmp_path):
    """What the subpackage itself lacks is told, not swallowed."""
    for source in ROOT.glob("filegrove/**/*.py"):
        at = source.relative_to(ROOT)
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text("import no_such_module\n" if at.as_posix() == "filegrove/llm/queries.py" else source.read_text())
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        (tmp_path / name).write_text((ROOT / name).read_text())
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True)
    assert found.returncode != 0 and "no_such_module" in found.stderr
