import os
import shutil
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), *[q for q in e.queries() if q.startswith('op') or q == 'pipeline'])"


def _names(*without: str) -> list[str]:
    copy = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/repo"
    hidden = shutil.ignore_patterns(".git", "__pycache__", *[os.path.basename(w) for w in without])
    shutil.copytree(ROOT, copy, ignore=hidden)
    return subprocess.run([sys.executable, "-c", SAY], cwd=copy, capture_output=True, text=True, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}).stdout.split()


def test_entry_works_without_the_corpus_operators():
    n, oracles, *found = _names("llm", "corpus_pipeline.py")
    assert int(n) > 90 and int(oracles) > 80 and found == []
    assert _names("llm") == [n, oracles]  # the pipeline alone adds nothing


def test_entry_without_the_pipeline_alone():
    found = _names("corpus_pipeline.py")[2:]
    assert "pipeline" not in found and len(found) in (0, 13)  # 0: the operators aren't there either
