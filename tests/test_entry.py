"""The entry imports whether or not the training-data folder, or what it needs, is there."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(blocked):
    code = (f"import sys; sys.path.insert(0, {ROOT!r}); sys.modules.update(dict.fromkeys({blocked!r})); "
            "import __spark_entry__ as e; print('NAMES', *sorted(e.queries()))")
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr[-500:]
    return set(said.stdout.rpartition("NAMES")[2].split())


def test_without_the_folder_or_what_it_needs():
    every = names([])
    for blocked in (["gonggo.llm"], ["public_tokenizers"]):
        left = names(blocked)
        assert "related_techs" in left and "pipeline" not in left
        assert left == {n for n in every if n != "pipeline" and not (n.startswith("op") and n[2].isdigit())}
