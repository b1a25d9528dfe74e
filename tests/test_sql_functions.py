"""The codec from SQL, steered tokens, counters of streams."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import codec
from corpusloom.functions import sql as names
from corpusloom.streaming import metrics


@pytest.fixture(scope="module")
def session(spark):
    names.register(spark)
    names.register(spark)
    rows = [(1, "[CH3]<0.1,-2.5,3>[NH2+]<1,2,3>(=[O]<0,0,0>)%12"), (2, "C1=CC(=O)Cl"), (3, "[C]<1,2>"), (4, None), (5, "x?"), (6, "[cH]<1,2,3.5e-1>")]
    spark.createDataFrame(rows, "id int, s string").createOrReplaceTempView("strings")
    return spark


def test_functions_say_what_the_columns_say(session):
    got = session.sql("SELECT id, strip_text(s) AS a, normalize_descriptor(s) AS b, format_descriptor('N', id, id - 3) AS c, bin_index_even(id * 0.1D, 0.2D, 0.1D, 3) AS d, bin_center(id, 0.5D, 0.25D) AS e FROM strings ORDER BY id").collect()
    t = session.table("strings")
    want = t.select("id", codec.strip_text(F.col("s")), codec.normalize_descriptor(F.col("s")), codec.format_descriptor(F.lit("N"), F.col("id"), F.col("id") - 3), codec.bin_index_even(F.col("id") * 0.1, 0.2, 0.1, 3), codec.bin_center(F.col("id"), 0.5, 0.25)).orderBy("id").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    plan = session.sql("SELECT strip_text(s) FROM strings")._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_the_table_function_gives_the_same_tokens(session):
    got = session.sql("SELECT id, collect_list(struct(pos, type, text, coords)) AS t FROM strings, LATERAL tokens('cartesian_v2', s) GROUP BY id").collect()
    want = {r["id"]: [tuple(x) for x in r["t"]] for r in session.table("strings").select("id", codec.tokenize_enriched(F.col("s")).alias("t")).filter("t is not null").collect()}
    assert {r["id"]: [tuple(x)[1:] for x in sorted(r["t"])] for r in got} == {k: v for k, v in want.items() if v}
    plain = session.sql("SELECT id, count(*) AS n FROM strings, LATERAL tokens('plain', s) GROUP BY id").collect()
    sizes = {r["id"]: r["n"] for r in session.table("strings").select("id", F.size(codec.tokenize_plain(F.col("s"))).alias("n")).collect()}
    assert {r["id"]: r["n"] for r in plain} == {k: n for k, n in sizes.items() if n and n > 0}
    assert session.sql("SELECT * FROM tokens('plain', 'CO')").columns == ["pos", "type", "text"]


@pytest.mark.parametrize("call", ["tokens('none', s)", "tokens(s, s)"])
def test_unknown_encoders_fail(session, call):
    with pytest.raises(Exception, match="unknown encoder"):
        session.sql(f"SELECT * FROM strings, LATERAL {call}").collect()


@pytest.mark.parametrize("text,expected,want", [
    ("Sc", ["Sc"], ["Sc"]), ("Sc", ["S", "c"], ["S", "c"]), ("Cnc", ["Cn", "c"], ["Cn", "c"]), ("Cnc", ["C", "n", "c"], ["C", "n", "c"]), ("CoCo", ["Co", "C", "o"], ["Co", "C", "o"]), ("C(Cl)[Co+2]n", ["C", "Cl", "Co", "n"], ["C", "Cl", "[Co+2]", "n"]),
    ("Sc", ["S"], None), ("Sc", ["C", "s"], None), ("C", ["C", "C"], None), ("C?", ["C"], None), ("CCl", None, ["C", "Cl"]), ("Sc1", None, ["Sc"]), ("Cq", None, None), ("Ccc", None, ["C", "c", "c"]), ("", [], []), (None, ["C"], None),
])
def test_steered_tokens(spark, text, expected, want):
    df = spark.createDataFrame([(text, expected)], "s string, e array<string>")
    tokens = codec.tokenize_steered(F.col("s"), None if expected is None else F.col("e"))
    got = df.select(tokens.alias("t")).first()["t"]
    assert (got and [x["text"] for x in got if x["type"] == "atom"]) == want if want else got == want


def test_annotated_strings_decode_again(spark):
    df = spark.createDataFrame([("C(Sc)Co", ["C", "Sc", "C", "o"], [[1.0, 2.0, 3.0]] * 4), ("CC", ["C", "C"], [[1.0, 2.0, 3.0]]), ("CC", ["C", "C"], None)], "s string, e array<string>, p array<array<double>>")
    text = codec.annotate(F.col("s"), F.col("p"), F.col("e"))
    rows = df.select(text.alias("t"), codec.decode_enriched(text).alias("d")).collect()
    assert rows[0]["t"] == "[C]<1.0000,2.0000,3.0000>([Sc]<1.0000,2.0000,3.0000>)[C]<1.0000,2.0000,3.0000>[o]<1.0000,2.0000,3.0000>"
    assert rows[0]["d"]["plain"] == "C([Sc])Co" and len(rows[0]["d"]["coords"]) == 4 and rows[1]["t"] is None and rows[2]["t"] is None


def test_counters_without_a_second_pass(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)
    source = str(tmp_path / "in")
    for part in ([1, 2, 3], [4, 5]):
        spark.createDataFrame([(x,) for x in part], "x int").coalesce(1).write.mode("append").parquet(source)

    @F.udf("int")
    def touched(x):
        read.add(1)
        return x

    def work(rows, batch):
        rows.write.mode("overwrite").parquet(str(tmp_path / f"out/{batch}"))

    def run():
        stream = spark.readStream.schema("x int").option("maxFilesPerTrigger", 1).parquet(source).withColumn("x", touched("x"))
        return metrics.counted(stream, work, {"rows": F.count("*"), "total": F.sum("x"), "most": F.max("x")}, str(tmp_path / "metrics"), str(tmp_path / "state"))

    run().awaitTermination()
    assert read.value == 5
    t = metrics.totals(spark, str(tmp_path / "metrics"), ["rows", "total"]).first()
    assert (t["batches"], t["rows"], t["total"]) == (2, 5.0, 15.0)
    # the last batch's commit is lost: it is run again and counts once
    for file in (tmp_path / "state/commits").glob("*1*"):
        file.unlink()
    run().awaitTermination()
    t = metrics.totals(spark, str(tmp_path / "metrics"), ["rows", "total"]).first()
    assert (t["batches"], t["rows"], t["total"]) == (2, 5.0, 15.0) and read.value == 7
