"""What the entry module does where parts of the corpus package are absent or broken."""
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
COUNT = "import __spark_entry__ as e; q = e.queries(); print('accuracy' in q, 'op9_shards' in q, 'pipeline' in q)"


def run(before):
    done = subprocess.run([sys.executable, "-c", f"{before}\n{COUNT}"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    return done.returncode, done.stdout.strip(), done.stderr


def test_all_there():
    assert run("")[:2] == (0, "True True True")


def test_absent_package_or_library():
    code, out, err = run("import sys; sys.modules['corpus_pipeline'] = None")
    assert (code, out, "left out" in err) == (0, "True False False", False)
    code, out, err = run("import sys; sys.modules['ahocorasick'] = None")
    assert (code, out) == (0, "True False False") and "no module ahocorasick" in err


def test_broken_package_is_not_hidden():
    assert run("import colloquy.llm.common as c; del c.saved")[0] != 0
    assert run("import sys; sys.modules['colloquy.llm.warc'] = None")[0] != 0
    assert run("import sys; sys.modules['colloquy.operators.scale'] = None")[0] != 0
