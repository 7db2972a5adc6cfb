"""Rules that all of the subpackage keeps."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parents[2]
FILES = [*sorted((ROOT / "quire" / "llm").glob("*.py")), ROOT / "corpus_pipeline.py"]


def test_no_local_checkpoint_rdd_cross_join_or_row_udf():
    for path in FILES:
        text = path.read_text()
        assert not re.search(r"localCheckpoint|\.rdd\b|crossJoin|F\.udf\(|@udf\b|toLocalIterator|/tmp\b|mkdtemp", text), path


def test_what_comes_to_the_driver_is_bounded():
    """Every collect or toPandas stands where its bound is stated, and there are no others."""
    found = {p.name: len(re.findall(r"\.(?:collect|toPandas)\(\)", p.read_text())) for p in FILES}
    assert {k: v for k, v in found.items() if v} == {
        "decontaminate.py": 2,  # at most 13 levels; 512 blocks of the bitmap
        "importance.py": 5,  # 256 blocks of counts; two histograms; the bounded held-out sample, its clean rows first
        "pseudolikelihood.py": 2,  # 4,096 counts; one network
        "rules.py": 1,  # the bounded labelled sample
        "targeted.py": 3,  # buckets; scores (integers of a bounded range); partitions of a sort
    }


def test_only_the_entry_guards_the_import():
    for path in FILES:
        assert "ImportError" not in path.read_text() and "ModuleNotFoundError" not in path.read_text(), path
    for path in (ROOT / "quire").rglob("*.py"):
        if "llm" not in path.parts:
            assert "quire.llm" not in path.read_text(), path
