"""The answer ledger: calls are paid for once, also when a run is killed."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from quire.operators import completion
from quire.sources.ledger import AnswerLedger


def requests(spark, prompts):
    return spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "request_id long, prompt string")


def provider(folder, deadly=None, failing=None):
    """Notes every call as a file; dies hard at one prompt, raises at another."""
    def call(prompt, options):
        if prompt == deadly and not os.path.exists(os.path.join(folder, "revived")):
            os._exit(17)
        with open(os.path.join(folder, f"call-{uuid.uuid4().hex}"), "w") as out:
            out.write(prompt)
        if prompt == failing and not os.path.exists(os.path.join(folder, "revived")):
            raise RuntimeError("busy")
        return {"content": f"<{prompt}>", "model": options.get("model"), "prompt_tokens": len(prompt)}

    return {"own": call}


def calls(folder):
    return sorted(open(os.path.join(folder, f)).read() for f in os.listdir(folder) if f.startswith("call-"))


def run(spark, rows, ledger, functions, partitions=None):
    out = completion.complete_batch(rows, F.col("prompt"), "own", functions=functions, ledger=ledger, partitions=partitions)
    return {r.request_id: (r.content, r.error_kind) for r in out.collect()}


@pytest.fixture
def place(scratch):
    folder = os.path.join(scratch, "calls")
    os.makedirs(folder)
    return folder, os.path.join(scratch, "ledger")


def test_equal_requests_are_asked_once_and_a_rerun_asks_nothing(spark, place):
    folder, root = place
    ledger = AnswerLedger(spark, root)
    rows = requests(spark, ["a", "b", "a", "", "a"] * 3)
    got = run(spark, rows, ledger, provider(folder))
    assert got == {i: (f"<{p}>", None) for i, p in enumerate(["a", "b", "a", "", "a"] * 3)}
    assert calls(folder) == ["", "a", "b"]
    assert run(spark, rows.union(requests(spark, ["c"]).selectExpr("99L", "prompt")), ledger, provider(folder)) == got | {99: ("<c>", None)}
    assert calls(folder) == ["", "a", "b", "c"]


def test_other_options_are_other_requests(spark, place):
    folder, root = place
    ledger = AnswerLedger(spark, root)
    for model in ("m1", "m2", "m1"):
        run(spark, requests(spark, ["a"]).withColumn("model", F.lit(model)), ledger, provider(folder))
    assert calls(folder) == ["a", "a"]


def test_failed_calls_are_asked_again_answers_are_not(spark, place):
    folder, root = place
    ledger = AnswerLedger(spark, root)
    rows = requests(spark, ["a", "bad", "b"])
    got = run(spark, rows, ledger, provider(folder, failing="bad"))
    assert got[0] == ("<a>", None) and got[1] == (None, "completion") and got[2] == ("<b>", None)
    open(os.path.join(folder, "revived"), "w").close()
    assert run(spark, rows, ledger, provider(folder, failing="bad"))[1] == ("<bad>", None)
    assert calls(folder) == ["a", "b", "bad", "bad"]


def test_a_killed_run_keeps_the_answers_of_ended_tasks(spark, place):
    folder, root = place
    ledger = AnswerLedger(spark, root)
    rows = requests(spark, [f"p{i}" for i in range(40)])
    with pytest.raises(Exception):
        run(spark, rows, ledger, provider(folder, deadly="p7"), partitions=20)
    saved = {r.content[1:-1] for r in ledger.answers(completion.RESULT_SCHEMA).collect()}
    assert 0 < len(saved) < 40 and "p7" not in saved
    before = calls(folder)
    open(os.path.join(folder, "revived"), "w").close()
    got = run(spark, rows, ledger, provider(folder, deadly="p7"), partitions=20)
    assert got == {i: (f"<p{i}>", None) for i in range(40)}
    again = sorted(set(calls(folder)) - set(before)) + [p for p in set(before) if calls(folder).count(p) > before.count(p)]
    assert saved.isdisjoint(again) and "p7" in again
