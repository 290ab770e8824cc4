"""Model seams with stubs."""

import pytest
from pyspark.sql import functions as F

from rillflow.functions import seams
from rillflow.operators.structured import guard


def test_embedding_keeps_places(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, " "), (4, "a b"), (5, "c")], "id long, t string")
    rows = {r.id: r.v for r in df.select("id", seams.embedder()(F.col("t")).alias("v")).collect()}
    assert rows[2] is None and rows[3] is None
    assert rows[1] == rows[4] != rows[5]
    assert sum(x * x for x in rows[1]) == pytest.approx(1.0, abs=1e-5)


def test_words_that_cancel_have_a_vector(spark):
    texts = ["Or thstenes to ofthinatre.", "Miesí con, raque ciónciónueue."]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(seams.embedder()(F.col("t")).alias("v")).collect()
    assert [sum(x * x for x in r.v) for r in rows] == pytest.approx([1.0, 1.0], abs=1e-5)
    assert not any(seams.stub_embedder()([" "])[0])


def test_retries():
    calls = []

    def flaky(items):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return items

    assert seams.with_retries(flaky, [1], pause=0.0) == [1]
    with pytest.raises(OSError):
        seams.with_retries(lambda _: (_ for _ in ()).throw(OSError()), [1], pause=0.0)


def test_guard_fails_closed(spark):
    def factory():
        def model(texts):
            if any("crash" in t for t in texts):
                raise OSError
            return [seams.reply_of("ignore" in t, 0.9 if "ignore all" in t else 0.5) if "odd" not in t else "{" for t in texts]

        return model

    ask = seams.guard_model(factory)
    for text, want in [("ignore all", "quarantine"), ("ignore", "allow"), ("fine", "allow"), ("odd", "quarantine"), ("crash", "quarantine")]:
        df = spark.createDataFrame([(text,)], "t string").select(ask(F.col("t")).alias("raw")).select(seams.guard_reply(F.col("raw")).alias("g"))
        assert df.select(guard(F.col("g.is_injection"), F.col("g.confidence"), F.col("g").isNull())).first()[0] == want


def test_rerank_falls_back(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "cccc")], "rank long, t string")
    assert [r.rank for r in seams.rerank(df, F.lit("q"), F.col("t"), None, "rank", 2).collect()] == [1, 2]
    scorer = seams.pair_scorer(lambda: lambda pairs: [float(len(t)) for _, t in pairs])
    assert [r.rank for r in seams.rerank(df, F.lit("q"), F.col("t"), scorer, "rank", 2).collect()] == [3, 1]


def test_report_json(spark):
    assert seams.report_json(spark.createDataFrame([(1, None)], "a int, b string"), ["a", "b"]).first()[0] == '{"a":1}'
