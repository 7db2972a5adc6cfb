from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.sql import register_sql_functions
from quire.operators import intake, prompts

SAMPLES = ["", "  a b  ", "\x1ca\x1c", " x　y ", "a\tb\nc\x0bd", "   ", "it's \\ fine", None]


def test_sql_functions_match_the_column_helpers(spark):
    names = register_sql_functions(spark)
    assert "py_token_count" in names
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    df.createOrReplaceTempView("samples")
    got = spark.sql("SELECT i, py_strip(s) AS st, py_token_count(s) AS n, py_is_blank(s) AS b, "
                    "parse_prompt(NULL, s) AS p FROM samples ORDER BY i").collect()
    want = df.select("i", T.strip("s").alias("st"), T.token_count("s").alias("n"), T.is_blank("s").alias("b"),
                     prompts.parse_prompt(F.lit(None).cast("string"), F.col("s")).alias("p")).orderBy("i").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_sql_classification(spark):
    register_sql_functions(spark)
    rows = [("a.PDF", "application/x"), ("png", None), ("n", "IMAGE/PNG"), ("d.txt", "application/pdf")]
    df = spark.createDataFrame(rows, "file_name string, content_type string")
    df.createOrReplaceTempView("ups")
    got = spark.sql("SELECT is_image_file(content_type, file_name) AS i, is_pdf_file(content_type, file_name) AS p,"
                    " unsupported_message(content_type, file_name) AS m FROM ups").collect()
    want = df.select(intake.is_image(F.col("content_type"), F.col("file_name")).alias("i"),
                     intake.is_pdf(F.col("content_type"), F.col("file_name")).alias("p"),
                     intake.unsupported_message(F.col("content_type"), F.col("file_name")).alias("m")).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
