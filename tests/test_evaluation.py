"""Metrics of sources, facts and abstentions, and two runs compared."""

from tidewater.operators import evaluation


def test_metrics_and_comparison(spark):
    samples = spark.createDataFrame([(1,), (2,), (3,), (None,), (1,)], "q int")
    expected = spark.createDataFrame([(1, "A.txt"), (1, "a.TXT "), (1, "b"), (2, "c"), (None, "n"), (3, ""), (3, None)], "q int, s string")
    observed = spark.createDataFrame([(1, "a.txt"), (1, "x"), (1, "y"), (1, "X"), (None, "N"), (3, "z"), (9, "c")], "q int, s string")
    sources = evaluation.source_metrics(expected, observed, "q", "s")
    assert {r.q: tuple(r)[1:] for r in sources.collect()} == {1: (1.0, 1 / 3, 0.5), 2: (0.0, 0.0, 0.0), None: (1.0, 1.0, 1.0)}
    facts = spark.createDataFrame([(1, " Red "), (1, "red"), (1, "red\t"), (1, "blue"), (1, "blue"), (2, "x"), (3, "ÄRGER"), (None, "n"), (1, ""), (1, None)], "q int, f string")
    answers = spark.createDataFrame([(1, "A RED ring", "a"), (2, None, "b"), (3, "lauter ärger", "c"), (None, "N", "d")], "q int, text string, f string")
    found = evaluation.fact_recall(facts, answers, "q", "f", "text")
    assert {r.q: tuple(r)[1:] for r in found.collect()} == {1: (2, 3, 2 / 3), 2: (0, 1, 0.0), 3: (1, 1, 1.0), None: (1, 1, 1.0)}
    said = spark.createDataFrame([(1, True, True), (2, True, False), (3, None, True)], "q int, should boolean, did boolean")
    item = evaluation.items(samples, "q", [sources, found, evaluation.abstentions(said, "q", "should", "did")])
    assert item.count() == 4
    total = evaluation.totals(item).first()
    assert (total.evaluated, total.hit, total.precision, total.recall, total.fact_recall, total.abstention_correct) == (4, 0.666667, 0.444444, 0.5, 0.666667, 0.5)
    got = {r.metric: tuple(r)[1:] for r in evaluation.compare(item, item.filter("q = 1").drop("abstention_correct")).collect()}
    assert got["evaluated"] == (4.0, 1.0, -3.0) and got["recall"] == (0.5, 0.5, 0.0) and got["hit"] == (0.666667, 1.0, 0.333333) and got["abstention_correct"] == (0.5, None, None)
    assert evaluation.totals(item.limit(0)).first().hit is None
