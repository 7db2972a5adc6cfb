import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import chat as C

ROWS = "conv_id long, turn long, role string, text string"
AWKWARD = [(1, 0, "user", "a<|end|>\nb \\ <\\| \\\\<|turn|>x\ny<"), (1, 1, "assistant", None), (2, 0, None, "x"), (2, 1, "to\nol\\n<|", "|y"),
           (3, 0, "system", None), (3, 1, "user", ""), (3, 2, "assistant", "ok\\"), (4, 0, "user", None), (4, 1, "assistant", "z😀"),
           (None, None, "user", "q"), (5, 0, "assistant", ""), (5, 0, "assistant", None), (6, 0, "user", None),
           (7, 0, "user", "t"), (7, 0, "user", "t"), (7, 1, "assistant", "<|end|>\n" * 2000 + "\\" * 999), (8, 0, "assistant", "<"),
           (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def turns_of(rows, conv):
    key = lambda r: tuple((v is not None, v if v is not None else 0 if i == 0 else "") for i, v in enumerate(r[1:]))
    return [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]


def check(spark, rows):
    out = C.format_conversations(spark.createDataFrame(rows, ROWS).withColumn("record", F.lit(1)).withColumn("t", F.lit(1))).collect()
    assert sorted((r.conv_id for r in out), key=repr) == sorted({r[0] for r in rows}, key=repr)
    for r in out:
        want = turns_of(rows, r.conv_id)
        assert [(t.role, t.text) for t in r.read] == want
        assert r.loss_texts == [t for role, t in want if role == "assistant"]
        assert [m.loss for m in r["mask"]] == [role == "assistant" for role, _ in want]
        assert r.formatted.count("<|") == 2 * len(want)  # control strings only
        for m, (_, text) in zip(r["mask"], want):
            span = r.formatted[m.start:m.start + m.length]
            assert span.replace("\\\\", "\0").replace("\\|", "|").replace("\0", "\\") == text
    return out


def test_round_trip_of_awkward_rows(spark):
    out = check(spark, AWKWARD)
    assert {r.layout for r in out} >= {"rows", "prompt_completion", "instruction"}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.sampled_from(["user", "assistant", "system", "a\\\n", "<|", None]),
                          st.one_of(st.none(), st.text(alphabet="<|>\\n\n ae😀turned", max_size=25))), min_size=1, max_size=14))
def test_round_trip(spark, rows):
    check(spark, rows)


def test_layouts_and_fingerprints(spark):
    given_ = {
        "messages": {"messages": [{"role": "user", "content": "q", "id": 1}, {"content": "a", "role": "assistant"}], "source": {"x": [1]}},
        "from_value": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        "authored_parts": {"thread": [{"author": {"role": "user"}, "content": {"parts": ["q"]}},
                                      {"author": {"role": "assistant", "name": "x"}, "content": {"parts": ["a"]}}]},
        "prompt_completion": {"completion": "a", "prompt": "q"},
        "instruction": {"instruction": "q", "output": "a"},
        "rows": {"rows": [{"turn": 2, "role": "assistant", "text": "a"}, {"turn": 1, "role": "user", "text": "q"}]},
    }
    records = spark.createDataFrame([(k, json.dumps(v)) for k, v in given_.items()], "want string, j string").select(
        "want", F.parse_json("j").alias("record"))
    for r in C.canonical_turns(records).collect():
        assert r.layout == r.want and [(t.role, t.text) for t in r.turns] == [("user", "q"), ("assistant", "a")]
    known = [p for x in C.LAYOUTS for p in x.fingerprints()]
    assert len(set(known)) == len(known)


@pytest.mark.parametrize("record", ['{"messages":[]}', '{"a":1}', "[1]", "null", '{"prompt":1}', None])
def test_unknown_layouts_stay_with_null_turns(spark, record):
    df = spark.createDataFrame([(record,)], "j string").select(F.parse_json("j").alias("record"))
    row = C.read_back(C.formatted(C.canonical_turns(df))).first()
    assert row.layout is None and row.turns is None and row.formatted is None
    assert record is None or len(row.fingerprint) == 64


def test_empty_and_native(spark):
    df = C.format_conversations(spark.createDataFrame([], ROWS))
    assert df.count() == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("sizes", [[], [5], list(range(127)), list(range(128)), list(range(1, 130)), [3] * 1000])
def test_running_starts(spark, sizes):
    df = spark.createDataFrame([(sizes,)], "sizes array<long>")
    assert df.select(C.running_starts("sizes")).first()[0] == [sum(sizes[:i]) for i in range(len(sizes))]


def test_time_follows_the_turns(spark):
    """One conversation of 40,000 turns takes less than six times what one of 10,000 takes."""
    import time

    def took(n):
        rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                     F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                     F.format_string("turn %d <| \\\\ says", "id").alias("text"))
        begun = time.time()
        got = C.format_conversations(rows).select(F.size("read"), F.size("loss_texts"), F.length("formatted")).collect()
        assert got[0][:2] == (n, n // 2)
        return time.time() - begun

    took(1000)
    small = took(10_000)
    assert took(40_000) < 6 * small + 2, small
