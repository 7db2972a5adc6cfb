from hypothesis import given, settings
from hypothesis import strategies as st

from quire.functions import text as T

WS = "".join(chr(c) for c in T.PY_WHITESPACE_CODEPOINTS)
alphabet = st.sampled_from(list(WS) + list("ab.é​᠎") + ["\U0001F600"])


def test_whitespace_set_is_pythons():
    import sys
    assert [c for c in range(sys.maxunicode + 1) if chr(c).isspace()] == T.PY_WHITESPACE_CODEPOINTS


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=alphabet, max_size=12), min_size=1, max_size=40))
def test_strip_split_blank_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", T.strip("t").alias("s"), T.token_count("t").alias("n"),
                     T.is_blank("t").alias("b")).collect()
    for r in rows:
        t = texts[r.i]
        assert r.s == t.strip()
        assert r.n == len(t.split())
        assert r.b == (not t.strip())


def test_null_handling(spark):
    df = spark.createDataFrame([(None,)], "t string")
    r = df.select(T.strip("t").alias("s"), T.token_count("t").alias("n")).first()
    assert r.s is None and r.n == 0
