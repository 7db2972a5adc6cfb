"""Inputs with every awkward case, and plain Python versions to compare with."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid string, kept string, score long, piece long"
#: More columns whose names operators use themselves.
CLASH = ("digest", "group", "place", "hash", "label", "n_words", "_row", "sequence_id")


def prose(seed: int, n: int, vocabulary: int = 5000) -> list[str]:
    import random

    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def nasty_texts() -> list[str | None]:
    long = " ".join(prose(1, 30_000))
    return [None, "", "   \n\t ", "\n\n\n", "one", "One two", "É ß 漢字 😀 a\x00b \x1c x", "a b c", long, long, "x" * 400_000,
            " ".join(prose(2, 60)), " ".join(prose(2, 60)), "line one\nline one\n\nline two\r\nline one", "\\ <| <|endoftext|> |> %%%",
            " ".join(prose(3, 12)), "same same same same same same same same same same same same same same same same same same same same"]


def nasty_docs(spark, extra=()):
    rows = []
    for i, t in enumerate([*nasty_texts(), *extra]):
        rows.append((None if i % 7 == 3 else i, t, None if i % 2 else "en", "src", None if t is None else len(t), "u", "k", 1, 2))
    rows += [rows[4], rows[11], rows[11]]
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASH:
        df = df.selectExpr("*", f"'x' as {c}")
    return df


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain_words(text: str | None) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text or ""))


def blank_words(text: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
