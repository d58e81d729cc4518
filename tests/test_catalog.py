"""Each query of the library against its SQL on the same tables."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewater.plans import catalog, lineage, records, retrieving, searching, shapes  # noqa: F401  (registers queries)

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DIR}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return db


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None:
            return "~"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)) and not math.isnan(v):
            return f"{float(v):.5f}".replace("-0.00000", "0.00000")
        return str(v)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    found = canonical(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    expected = canonical([d[0] for d in cursor.description], cursor.fetchall())
    assert found[0] == expected[0]
    assert found[1] and len(found[1]) == len(expected[1])
    unlike = [(a, b) for a, b in zip(found[1], expected[1]) if a != b]
    assert not unlike, "\n".join(f"{a}\n{b}" for a, b in unlike[:2])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0


def test_ewm_of_null_keys_and_long_numbers(spark):
    from tidewater.operators import windows

    df = spark.createDataFrame([(None, 1, 1.0, 2**53 + 1), (None, 2, 3.0, None), (1, 1, 1.0, 5), (1, 2, 3.0, 6)], "k int, i int, x double, big long")
    found = {(r["k"], r["i"]): (r["ewm"], r["big"]) for r in windows.ewm(df, "x", ["k"], ["i"], span=2).collect()}
    assert found[None, 2][0] == found[1, 2][0] == 2.5 and found[None, 1][1] == 2**53 + 1


def test_cumulative_product_is_exact(spark):
    from tidewater.operators import windows

    df = spark.range(1, 8).selectExpr("id", "cast(id as double) as x", "0 as k")
    assert [r["p"] for r in windows.cumulative(df, "x", ["k"], ["id"], "product", "p").orderBy("id").collect()] == [1.0, 2.0, 6.0, 24.0, 120.0, 720.0, 5040.0]


def test_samples(spark):
    from tidewater.operators import sorting

    df = spark.range(1000)
    assert sorting.sample(df, 10, ["id"]).count() == 10 and 200 < sorting.sample_share(df, 0.25, ["id"]).count() < 300
    assert sorting.sample_share(df, 2.0, ["id"]).count() == 2000
    drawn = [r["id"] for r in sorting.sample_with_replacement(df, 500, 3).collect()]
    assert len(drawn) == 500 and len(set(drawn)) < 500 and set(drawn) <= set(range(1000))
    assert sorting.sample_with_replacement(df.limit(0), 5).count() == 0


def test_sentence_chunks(spark):
    from tidewater.operators import retrieval

    text = "One two. Three four! Five six? " + "x" * 50
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    chunks = [r["chunk"] for r in retrieval.chunked(df, "id", "text", "sentence", size=24, overlap=12).orderBy("chunk_no").collect()]
    assert chunks[:2] == ["One two. Three four!", "Three four! Five six?"] and all(len(c) <= 24 for c in chunks)


def test_retrieval_of_questions(spark):
    from tidewater.operators import retrieval

    docs = spark.createDataFrame([(1, "the red fox runs"), (2, "a red fox and a dog"), (3, "blue sea")], "id long, text string")
    asked = spark.createDataFrame([(1, "the red fox")], "q int, question string")
    found = retrieval.search_index(docs, "id", "text", asked, "q", "question", 2).orderBy("place").collect()
    assert [r["id"] for r in found] == [1, 2] and found[0]["final"] > found[0]["score"]
    assert spark.range(1).select(retrieval.clauses(F.lit("What is it and who made it? No")).alias("c")).first()["c"] == ["what is it", "who made it"]
    assert spark.range(1).select(retrieval.citations(F.lit("as S2 and S10, S2 say")).alias("c")).first()["c"] == ["S2", "S10"]
    relevant = spark.createDataFrame([(1, 2)], "q int, id long")
    assert abs(retrieval.ndcg(retrieval.top_k(retrieval.bm25(docs, "id", "text", asked, "q", "question"), "q", "id", 2), relevant, "q", "id", 2).first()[0] - 1 / math.log2(3)) < 1e-9


def test_fuzzy_and_text_functions(spark):
    from tidewater.functions import fuzzy, strings

    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    pairs = spark.createDataFrame([("ca", "ac"), ("kitten", "sitting"), ("", "ab"), (None, "a")], "a string, b string")
    assert [r[0] for r in pairs.select(fuzzy.damerau("a", "b")).collect()] == [1, 3, 2, None]
    assert one(fuzzy.hamming(F.lit("karolin"), F.lit("kathrin"))) == 3 and one(fuzzy.hamming(F.lit("a"), F.lit("ab"))) == float("inf")
    codes = {"Ashcraft": "A226", "Tymczak": "T522", "Pfister": "P236", "": "0000", "Robert": "R163", "a": "A000", "o'Hara": "O600"}
    assert {w: one(fuzzy.soundex(F.lit(w))) for w in codes} == codes
    assert one(fuzzy.token_jaccard(F.lit("foo-bar baz"), F.lit("foo bar baz"))) == 0.25 and one(fuzzy.token_jaccard(F.lit("Foo-bar, baz"), F.lit("foo bar baz"), normalize=True)) == 1
    assert one(fuzzy.token_similarity(F.lit(" a"), F.lit("a b"))) == 1 / 3 and one(fuzzy.token_similarity(F.lit(""), F.lit("a"))) == 0
    assert one(fuzzy.weighted_similarity(F.lit(""), F.lit(""))) == 1 and abs(one(fuzzy.weighted_similarity(F.lit("ab"), F.lit("abc"))) - 7 / 12) < 1e-12
    assert one(fuzzy.weighted([(F.lit(1.0), 3.0), (F.lit(0.0), 1.0)])) == 0.75
    assert one(strings.decrypt(strings.encrypt(F.lit("text"), "a secret"), "a secret")) == "text"
    assert one(strings.pad(F.lit("7"), 3, "left", "0")) == "007" and one(strings.strip(F.lit(" a "))) == "a"


def test_metrics_pack_and_sync(spark):
    from tidewater.operators import retrieval

    ranked = spark.createDataFrame([(1, 10, 1, "a" * 40), (1, 11, 2, "b" * 40), (1, 12, 3, "c" * 40)], "q int, id int, rank int, text string")
    relevant = spark.createDataFrame([(1, 11), (1, 99)], "q int, id int")
    m = retrieval.metrics(ranked, relevant, "q", "id", 2).first()
    assert (m["precision"], m["recall"], m["mrr"]) == (0.5, 0.5, 0.5)
    assert [r["id"] for r in retrieval.pack(ranked, "q", "text", 20).orderBy("rank").collect()] == [10, 11]
    new = ranked.filter("id != 10").withColumn("text", F.when(F.col("id") == 11, "x").otherwise(F.col("text")))
    assert {r["id"]: r["state"] for r in retrieval.sync(ranked, new, "id", ["text"]).collect()} == {10: "removed", 11: "changed", 12: "same"}


def test_dates_beside_those_of_the_tables(spark, tmp_path):
    days = ["2024-01-01 00:59:59.9995", "2024-01-01 00:59:59.999499", "2023-12-31 23:30:00", "2023-12-31 22:59:59.9996", "1969-12-31 23:59:59.9995", "1969-12-31 23:59:59.9985", "0999-05-05 01:02:03", "0001-01-01 00:00:00",
            "0001-05-05 (BC) 00:00:00", "0044-03-15 (BC) 12:00:00", "9999-12-31 23:59:59.999", "10000-01-05 00:00:00", "200000-01-31 05:59:59.999", "2024-01-31 10:00:00", "2100-01-31 10:00:00"]
    rows = ", ".join(f"({i}::BIGINT, TIMESTAMP '{d}')" for i, d in enumerate(days))
    path = f"{tmp_path}/events.parquet"
    db = duckdb.connect()
    db.execute(f"COPY (SELECT * FROM (VALUES {rows}, (99::BIGINT, NULL)) v(event_id, ts)) TO '{path}' (FORMAT parquet)")
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    found = sorted(tuple(r) for r in catalog.QUERIES["date_functions"](spark, str(tmp_path)).collect())
    assert found == sorted(db.execute(catalog.ORACLE_SQL["date_functions"]).fetchall())
