import math

import pytest
from pyspark.sql import functions as F

from matchloom.functions import text as T
from matchloom.functions import vectors as V



@pytest.mark.parametrize(("text", "want"), [
    ("C++ and C# 3D Node.js", ["c++", "and", "node", "js"]), ("Señor étude co-op x_y", ["se", "or", "tude", "co-op", "x_y"]),
    ("PySpark SQL-tools, 10x ML", ["pyspark", "sql-tools", "ml"]), ("a I x", []), ("", []), (None, [])])
def test_tokenize(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.tokenize(F.col("t")).alias("x")).first()["x"] == want


@pytest.mark.parametrize(("a", "b", "want"), [(["python", "sql", "spark"], ["python", "java", "sql"], 0.5), ([], [], 1.0), (["a"], [], 0.0), ([], ["a"], 0.0)])
def test_jaccard(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(T.jaccard(F.col("a"), F.col("b")).alias("x")).first()["x"] == want == df.select(T.jaccard(F.col("b"), F.col("a")).alias("x")).first()["x"]


def test_coverage_and_criteria(spark):
    df = spark.createDataFrame([("python sql spark", ["Python developer", "SQL", "!!"], {"Python": 60.0, "Java Spring": 40.0, "SQL design": 0.0, "#": None})], "s string, i array<string>, m map<string,double>")
    got = df.select(T.coverage(T.token_set(F.col("s")), F.col("i")).alias("c"), T.criteria_overlap(T.token_set(F.col("s")), T.entries_of(F.col("m"))).alias("m"),
                    T.coverage(T.token_set(F.col("s")), F.array().cast("array<string>")).alias("none"), T.criteria_overlap(T.token_set(F.col("s")), T.entries_of(F.lit(None))).alias("empty")).first()
    assert got["c"] == 0.75 and got["m"] == 60.5 / 102 and got["none"] == 0.0 and got["empty"] == 0.0


def test_text_assembly(spark):
    df = spark.createDataFrame([(None, "x", True, ["a", None, "b"], "", "fallback")], "a string, b string, c boolean, d array<string>, e string, f string")
    got = df.select(T.safe_text(F.col("a"), "string").alias("a"), T.safe_text(F.col("c"), "boolean").alias("c"), T.safe_text(F.col("d"), "array<string>").alias("d"), T.safe_list(F.col("a"), "string").alias("l"),
                    T.safe_list(F.col("b"), "string").alias("m"), T.assemble(F.col("b"), F.col("e"), F.lit("  "), F.col("f")).alias("t"), T.either(F.col("e"), F.col("f")).alias("e")).first()
    assert tuple(got) == ("", "True", "a\nb", [], ["x"], "x\n\nfallback", "fallback")


def test_sigma():
    want = {0.5: 9.689610525210778, 1: 4.844805262605389, 2: 2.4224026313026945, 4: 1.2112013156513473, 8: 0.6056006578256736}
    assert all(V.gaussian_sigma(e) == pytest.approx(s, rel=1e-14) for e, s in want.items())
    for bad in ((0, 1e-5), (-1, 1e-5), (1, 0), (1, 1)):
        with pytest.raises(ValueError):
            V.gaussian_sigma(*bad)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [4.0, 3.0])], "a array<double>, z array<double>, b array<double>")
    got = df.select(V.l2_normalize(F.col("a")).alias("n"), V.l2_normalize(F.col("z")).alias("z"), V.cosine(F.col("a"), F.col("b")).alias("c"), V.cosine(F.col("a"), F.col("z")).alias("cz"),
                    V.scaled(F.col("a"), V.clip_scale(V.norm(F.col("a")), 1.0)).alias("k"), V.scaled(F.col("a"), V.clip_scale(V.norm(F.col("a")), 9.0)).alias("w")).first()
    assert got["n"] == pytest.approx([0.6, 0.8]) and got["z"] == [0, 0] and got["c"] == pytest.approx(0.96) and got["cz"] == 0 and got["k"] == pytest.approx([0.6, 0.8]) and got["w"] == [3, 4]


def test_noise_is_normal_repeatable_and_keyed(spark):
    z = spark.range(4000).select("id", F.explode(V.keyed_noise(F.lit(8), F.lit(3407), F.lit("l"), F.col("id"))).alias("z"))
    m = z.agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s"), F.count_distinct("z").alias("n")).first()
    assert abs(m["m"]) < 0.02 and abs(m["s"] - 1) < 0.02 and m["n"] > 31_900
    assert sorted(z.where("id = 5").collect()) == sorted(z.repartition(7).where("id = 5").collect())
    fresh = spark.range(2000).select(F.explode(V.random_noise(4)).alias("z")).agg(F.stddev_pop("z").alias("s")).first()["s"]
    assert abs(fresh - 1) < 0.05
    p = spark.range(200).select(V.private_vector(F.array(F.lit(3.0), F.lit(4.0)), V.keyed_noise(F.lit(2), F.lit(1), F.lit("l"), F.col("id")), F.lit(0.5)).alias("v")).select(V.norm(F.col("v")).alias("n"))
    assert all(math.isclose(r["n"], 1.0) for r in p.collect())


def test_rounding_keeps_the_sign_of_zero(spark):
    from matchloom.plans.base import rounded

    df = spark.createDataFrame([([-1e-9, 1e-9, -0.0, 0.0, -0.1234567],)], "v array<double>")
    unit = df.select(F.transform("v", lambda x: rounded(x)).alias("u")).first()["u"]
    assert [math.copysign(1, x) for x in unit] == [-1, 1, -1, 1, -1] and unit == [0, 0, 0, 0, -0.123457]
    assert str(df.select(rounded(F.col("v")[0]).alias("x")).first()["x"]) == "-0.0"
