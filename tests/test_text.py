from pyspark.sql import functions as F

from parleyspark.functions import text
from parleyspark.functions.patterns import CATEGORIES, java, python
from parleyspark.operators.relational import conversation_url, file_category, version_folder


def one(spark, expr, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", expr.alias("x")).orderBy("i").toPandas()["x"].tolist()


def test_titles(spark):
    long = "this sentence has so many words that it has to be cut at the border of one of them after eighty"
    got = one(spark, text.extract_title(F.col("v")), "", "Hi", '```js\nconsole.log("test")\n```\nThis is the real content.', "Use `npm install` to install dependencies in your project.", "## Section Title\nSome actual content here.", "**Bold text** in the sentence for context.", long, "hello world sentence that is long enough.", None,
              "TypeScript generics allow you to write reusable code. More stuff follows.")
    assert got[0] is None and got[1] is None and got[8] is None
    assert "This is the real content" in got[2] and "console.log" not in got[2]
    assert "`" not in got[3] and "Section Title" in got[4] and "##" not in got[4] and "**" not in got[5]
    assert len(got[6]) <= 82 and got[6].endswith("…") and got[7].startswith("H") and got[9] == "TypeScript generics allow you to write reusable code"
    assert one(spark, text.extract_title(F.col("v"), True), "Sure, I'd be happy to help you with that. The actual answer is here.") == ["The actual answer is here"]


def test_small_functions(spark):
    assert one(spark, text.slugify(F.col("v")), "Héllo, World!  x", "--", None) == ["h-llo-world-x", "", None]
    assert one(spark, text.url_template(F.col("v")), "https://a.b/c/123456789/x?q=1", "https://a.b", "no url", "https://a.b/1b808607-e921-4dd5-85c9-6b1eea5fb883") == ["https://a.b/c/{n}/x", "https://a.b/", "no url", "https://a.b/{uuid}"]
    assert one(spark, conversation_url(F.col("v"), "https://h"), "session_1", "abc") == ["https://h/code/session_1", "https://h/chat/abc"]
    assert one(spark, file_category(F.col("v"), F.lit("human")), "a.PDF", "b.png", "c") == ["sources", "photos", "photos"]
    assert one(spark, version_folder(F.col("v")), "page_1", "V2_x", "zz") == ["v01", "v02", "v05-latest"]


SAMPLES = ["git commit -m x; docker run y && npm install z in src/app.ts", "const fooBar = async () => { return TypeError }", "port 8080 localhost:3000 GET /v1/x Xx/api/users", "SELECT a FROM t GROUP BY b", "$HOME process.env.X v1.2.3-beta see README @param", "what is it? How do I, i.e. means é should never avoid café",
           "few-shot chain of thought prompt injection", "a@scope/pkg é@scope/pkg pip install foo ```py\nx\n```", "", "héfunction functioné"]


def test_java_and_python_forms_agree(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "t string")
    for name, p, case in CATEGORIES:
        native = [r[0] for r in df.select(F.size(F.regexp_extract_all("t", F.lit(java(p, case)), F.lit(0)))).collect()]
        assert native == [sum(1 for _ in python(p, case).finditer(s)) for s in SAMPLES], name
