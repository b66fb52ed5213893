import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(set(e.oracle_sql()) - set(e.queries())), 'tracewell.llm' in __import__('sys').modules)"


def names(folder):
    done = subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=folder, env={**os.environ, "PYTHONPATH": folder}, capture_output=True, text=True, check=True)
    return done.stdout.split()[-3:]


def test_the_rest_works_without_the_training_data_folders(tmp_path):
    shutil.copytree(os.path.join(ROOT, "tracewell"), tmp_path / "tracewell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    n, unknown, loaded = names(str(tmp_path))
    assert int(n) > 100 and unknown == "0" and loaded == "False"


def test_every_sql_has_a_query():
    n, unknown, _ = names(ROOT)
    assert int(n) > 100 and unknown == "0"


def test_nothing_outside_imports_the_training_data_folder():
    for folder, _, files in os.walk(os.path.join(ROOT, "tracewell")):
        if "llm" in folder.split(os.sep):
            continue
        for name in files:
            if name.endswith(".py"):
                text = open(os.path.join(folder, name), encoding="utf-8").read()
                assert "tracewell.llm" not in text, name
