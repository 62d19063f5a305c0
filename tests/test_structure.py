"""What may import what."""

import pathlib
import re

ROOT = pathlib.Path(__file__).parent.parent / "runsieve"


def test_nothing_imports_the_training_data_part():
    for f in ROOT.rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert not re.search(r"\bimport .*\bllm\b|from .*\bllm\b", f.read_text()), f


def test_detection_and_policy_know_no_proposer():
    for name in ("history", "policy", "identity"):
        assert "causes" not in (ROOT / "operators" / f"{name}.py").read_text()
