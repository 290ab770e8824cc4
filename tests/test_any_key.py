"""Operators over one key that holds all rows, at limits of ranges, levels and batches, against loops."""

import json
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from rillflow.operators import folds, projections, rules
from rillflow.operators.quantiles import exact_medians
from rillflow.operators.ranges import ranked, running
from rillflow.operators.retrieval import grade_counts, graded, ranking_metrics
from rillflow.operators.selection import FrameSelector, SelectionParams
from rillflow.operators.series import density, robust_spikes, suppress_near
from rillflow.plans import parameters
from rillflow.sources.knowledge import article_segments
from rillflow.streaming import queries
from rillflow.streaming.registry import registered, stream_registry, with_rocksdb
from rillflow.streaming.sessions import event_stream, run_to_table, stream_windows
from tests.oracle import SMALL


@pytest.mark.parametrize("ranges", [1, 3, 17])
def test_running_values_against_a_loop(spark, ranges):
    """One large key, small ones and null ones, with ties, nulls in the order and both directions."""
    rng = random.Random(ranges)
    rows = [(rng.choice(["big"] * 8 + ["s", None]), rng.choice([None, *range(40)]), k, rng.choice([None, rng.randrange(100)])) for k in range(400)]
    df = spark.createDataFrame(rows, "k string, o int, id long, v long")
    for descending in (False, True):
        order = [F.col("o").desc_nulls_last() if descending else F.col("o").asc_nulls_first(), F.col("id").asc()]
        values = {"rank": (F.lit(1).cast("long"), F.sum), "total": (F.col("v"), F.sum), "most": (F.col("v"), F.max), "bits": (F.col("v"), F.bit_xor)}
        got = {r.id: (r["rank"], r.total, r.most, r.bits) for r in running(df, ["k"], order, values, ranges=ranges).collect()}
        before = {r.id: r.most for r in running(df, ["k"], order, {"most": (F.col("v"), F.max)}, own=False, ranges=ranges).collect()}
        want, ahead = {}, {}
        for key in ("big", "s", None):
            own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None if not descending else r[1] is None, (r[1] or 0) * (-1 if descending else 1), r[2]))
            seen, bits = [], None
            for n, r in enumerate(own, 1):
                ahead[r[2]] = max(seen, default=None)
                if r[3] is not None:
                    seen.append(r[3])
                    bits = (bits or 0) ^ r[3]
                want[r[2]] = (n, sum(seen) if seen else None, max(seen, default=None), bits)
        assert got == want
        assert before == ahead
    assert sorted(r["rank"] for r in ranked(df.withColumn("k", F.lit(1)), ["k"], [F.col("v").desc()]).collect()) == list(range(1, 401))
    assert ranked(df.limit(0), ["k"], [F.col("o").asc()]).count() == 0


def test_a_large_key_is_spread(spark):
    """No task gets the whole of a key that holds all rows."""
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id"))
    placed = ranked(df, ["k"], [F.col("id").asc()])
    assert placed.filter("rank != id + 1").count() == 0
    sizes = [r.n for r in placed.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 20_000


@pytest.mark.parametrize("seed", range(3))
def test_medians_of_one_key(spark, seed):
    """Many ties, even and odd numbers, negative values and nulls, and values far beyond what the sketch keeps."""
    rng = random.Random(seed)
    rows = [(1, rng.choice([0.0, 1.0, rng.gauss(0, 5)])) for _ in range(30_001 + seed)] + [(2, None), (3, 4.0), (3, 7.0), (4, -1.0), (5, 2.0), (5, None), (5, 9.5)]
    df = spark.createDataFrame(rows, "k long, v double")
    got = {r.k: (r.center, r.n_points) for r in exact_medians(df, ["k"], "v").collect()}
    want = {k: [v for key, v in rows if key == k and v is not None] for k in range(1, 6)}
    assert got == {k: (statistics.median(v), len(v)) for k, v in want.items() if v}


def test_spikes_of_one_key(spark):
    rng = random.Random(9)
    rows = [(k, "all", rng.gauss(10, 2) if k % 50 else 100.0 + k) for k in range(2000)] + [(5000, None, 1.0), (5001, "few", 1.0)]
    got = {r.id for r in robust_spikes(spark.createDataFrame(rows, "id long, k string, v double"), ["k"], "v", 6.0).collect()}
    values = [v for _, k, v in rows if k == "all"]
    center = statistics.median(values)
    limit = center + 6 * statistics.median(abs(v - center) for v in values)
    assert got == {i for i, k, v in rows if k == "all" and v > limit}


def suppression_truth(rows, gap, most):
    out = set()
    for key in {r[0] for r in rows}:
        kept = []
        for _, t, s, i in sorted((r for r in rows if r[0] == key), key=lambda r: (-r[2], r[1])):
            if len(kept) < most and all(abs(t - o) >= gap for o in kept):
                kept.append(t)
                out.add(i)
    return out


@pytest.mark.parametrize(("gap", "most"), [(3.0, 6), (0.5, 2), (1000.0, 6)])
def test_suppression_against_a_loop(spark, gap, most):
    rng = random.Random(most)
    rows = [(rng.choice([1, 1, 1, 2, None]), float(k) / 3, float(rng.randrange(40)), k) for k in range(300)]
    rng.shuffle(rows)
    got = [r.id for r in suppress_near(spark.createDataFrame(rows, "k long, t double, s double, id long"), "k", "t", "s", gap, most).collect()]
    assert len(got) == len(set(got))
    assert set(got) == suppression_truth(rows, gap, most)
    assert suppress_near(spark.createDataFrame([], "k long, t double, s double"), "k", "t", "s", gap).count() == 0


@pytest.mark.parametrize("ranges", ["2", "9"])
def test_batches_of_one_key(spark, ranges):
    """One key with all rows, zeros and nulls, rows of exactly the budget, other keys and a null one, over few and many ranges."""
    rng = random.Random(3)
    rows = [(1, k, rng.choice([0, 0, 1, 3, 10, None])) for k in range(700)] + [(2, 0, 10), (2, 1, 10), (2, 2, 0), (3, 5, 1)] + [(None, k, 6) for k in range(5)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = {(r.k, r.o): r.batch_no for r in folds.greedy_batches(spark.createDataFrame(rows, "k long, o long, n long"), "k", "o", "n", 10).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {}
    for key in (1, 2, 3, None):
        batch = used = 0
        for k, o, n in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            if used and used + (n or 0) > 10:
                batch, used = batch + 1, 0
            used += n or 0
            want[k, o] = batch
    assert got == want
    with pytest.raises(Exception, match="token budget"):
        folds.greedy_batches(spark.createDataFrame([(1, 1, 11)], "k long, o long, n long"), "k", "o", "n", 10).collect()


def test_band_links_of_long_intervals(spark):
    """One interval spans everything and some are points; equal starts, and every pair once each way."""
    rng = random.Random(8)
    rows = [("a", 0, -5.0, 10_000.0), ("a", 1, 300.0, 300.0), ("a", 2, 300.0, 300.0), ("b", 3, 0.0, 9_000.0), (None, 4, 0.0, 1.0), ("a", 5, None, 3.0)]
    rows += [("a", 10 + k, s := float(rng.randrange(9_000)), s + rng.choice([0, 3, 700])) for k in range(150)]
    df = spark.createDataFrame(rows, "v string, id long, s double, e double")
    good = [r for r in rows if r[0] is not None and r[2] is not None]
    for within in (0.0, 7.5, 400.0):
        got = [(r.id, r.other) for r in rules.band_links(df, ["v"], "id", "s", "e", within).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(a[1], b[1]) for a in good for b in good if a[0] == b[0] and a[1] != b[1] and max(b[2] - a[3], a[2] - b[3], 0) <= within}


def test_cells_grow_with_the_logarithm(spark):
    """The cells of an interval are disjoint, cover it, and are at most two of each level."""
    rng = random.Random(1)
    spans = [(k, lo, lo + rng.choice([1, 2, 3, 1000, 10**6, 10**9])) for k, lo in enumerate(rng.randrange(-(10**6), 10**6) for _ in range(60))]
    df = spark.createDataFrame(spans, "id long, lo long, hi long").select("id", "lo", "hi", rules.dyadic_cells(F.col("lo"), F.col("hi")).alias("cells"))
    for r in df.collect():
        covered = sorted((c.cell << c.level, (c.cell + 1) << c.level) for c in r.cells)
        assert covered[0][0] == r.lo and covered[-1][1] == r.hi
        assert all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False))
        assert len(covered) <= 2 * (r.hi - r.lo).bit_length()


def test_cooldown_ends_at_its_last_second(spark):
    """A row exactly one cooldown after a strong one is calm again, in the window form and in the selector."""
    rows = [(1, 0.0, 9.0), (1, 3.0, 0.0), (1, 4.0, 0.0), (1, 7.0, 5.0), (1, 10.0, 0.0), (1, 11.0, 0.0)]
    df = spark.createDataFrame(rows, "k long, t double, v double")
    got = [r.state for r in density(df, ["k"], ["t"], "t", F.col("v") >= 9, F.col("v") >= 5, 4.0).orderBy("t").collect()]
    assert got == ["strong", "strong", "calm", "early", "early", "calm"]
    machine = FrameSelector(SelectionParams(strong_cooldown_sec=4.0, early_cooldown_sec=6.0))
    machine.s.strong_until, machine.s.early_until = 4.0, 6.0
    assert [machine._density(t)[0] for t in (3.9, 4.0, 5.9, 6.0)] == [machine._density(0.0)[0], *[machine._density(5.0)[0]] * 2, machine._density(99.0)[0]]
    assert len({machine._density(t)[0] for t in (0.0, 5.0, 99.0)}) == 3


def test_segments_of_many_headings(spark):
    """100,000 headings in one text in seconds, and the pieces make up the text."""
    text = "start\n" + "".join(f"MADDE {k % 90_000} - body\n" for k in range(100_000))
    began = time.perf_counter()
    rows = article_segments(spark.createDataFrame([(1, text), (2, None), (3, "none")], "id long, t string"), "id", "t").orderBy("pos").collect()
    assert time.perf_counter() - began < 30
    assert len(rows) == 100_000 and {r.id for r in rows} == {1}
    assert text[: rows[0].start] + "".join(r.content for r in rows) == text
    assert [r.number for r in rows[89_999:90_002]] == ["89999", "0__dup1", "1__dup1"]


def test_ranking_metrics_by_listing(spark):
    """Ideal gains from numbers of grades equal those from listed rows; several grades, more relevant rows than ranks, none relevant."""
    import math

    rng = random.Random(4)
    grades = [(q, i, rng.choice([1, 1, 2, 3])) for q in range(6) for i in range(rng.choice([1, 4, 30]))] + [(9, 0, 0)]
    ranks = [(q, i, k) for q in range(7) for k, i in enumerate(rng.sample(range(40), 10), 1)]
    ranked_rows = graded(spark.createDataFrame(ranks, "query_id long, id long, rank long"), spark.createDataFrame(grades, "query_id long, id long, grade int"))
    got = {r.query_id: r for r in ranking_metrics(ranked_rows, grade_counts(spark.createDataFrame(grades, "query_id long, id long, grade int"))).collect()}
    assert set(got) == set(range(6))
    for q, row in got.items():
        grade = {i: g for x, i, g in grades if x == q}
        mine = [grade.get(i, 0) for x, i, _ in ranks if x == q]
        dcg = lambda gs, k: sum((2**g - 1) / math.log2(n + 1) for n, g in enumerate(gs[:k], 1))
        for k in (5, 10):
            assert row[f"ndcg_{k}"] == pytest.approx(dcg(mine, k) / dcg(sorted(grade.values(), reverse=True), k))
        assert row.recall_5 == pytest.approx(sum(g > 0 for g in mine[:5]) / len(grade))
        assert row.rr == pytest.approx(next((1 / n for n, g in enumerate(mine, 1) if g), 0.0))


@pytest.mark.parametrize(
    ("kind", "good", "bad"),
    [
        (parameters.Merging, {"min_iou": 0.0, "max_gap": 0.0, "min_similarity": 1.0}, [{"min_iou": -0.01}, {"min_iou": 1.01}, {"max_gap": -1.0}, {"min_similarity": 1.5}, {"min_iou": "0.3"}, {"max_gap": float("inf")}, {"min_iou": True}]),
        (parameters.Segmenting, {"window": 2, "overlap": 1.99}, [{"window": 0.0}, {"window": float("nan")}, {"overlap": -0.1}, {"window": 5.0, "overlap": 5.0}]),
        (parameters.Spiking, {"factor": 0.1, "least": 1}, [{"factor": 0.0}, {"least": 0}, {"least": 2.0}]),
        (parameters.Suppressing, {"gap": 0.0, "most": 1}, [{"gap": -1.0}, {"most": 0}]),
        (parameters.Voting, {"of": 3, "needs": 3}, [{"of": 0}, {"needs": 0}, {"of": 2, "needs": 3}]),
        (parameters.Accepting, {"k": 1, "least": 0.0}, [{"k": 0}, {"least": 1.1}, {"least": -0.1}]),
        (parameters.Batching, {"budget": 1}, [{"budget": 0}, {"budget": None}]),
    ],
)
def test_parameters_are_refused_out_of_range(kind, good, bad):
    assert kind() == kind(**kind().values())
    assert kind(**good).values() == {**kind().values(), **good}
    for values in bad:
        with pytest.raises(ValueError, match=kind.__name__):
            kind(**values)


def test_parameters_from_files(spark, tmp_path):
    for name, text in (("good", '{"factor": 3, "least": 9}'), ("part", '{"least": 9}'), ("unknown", '{"factor": 3.0, "colour": 1}'), ("low", '{"factor": -1.0}'), ("two", '[{"least": 1}, {"least": 2}]'), ("broken", '{"least": ')):
        (tmp_path / f"{name}.json").write_text(text)
    read = lambda name: parameters.Spiking.read(spark, f"{tmp_path}/{name}.json")
    assert read("good") == parameters.Spiking(3.0, 9)
    assert read("part") == parameters.Spiking(6.0, 9)
    for name in ("unknown", "low", "two", "broken"):
        with pytest.raises(Exception, match="Spiking|MALFORMED|Malformed|FAILFAST"):
            read(name)


def test_operators_take_their_parameters(spark):
    rows = spark.createDataFrame([(1, float(k), float(k % 7)) for k in range(40)], "k long, t double, s double")
    values = parameters.Suppressing(gap=5.0, most=3).values()
    assert suppress_near(rows, "k", "t", "s", **values).count() == 3
    assert robust_spikes(rows, ["k"], "s", **parameters.Spiking(factor=0.5, least=1).values()).count() > 0


def test_a_report_is_json_whatever_is_missing(spark):
    schema = "id long, summary string, natural_language_summary string, onset string, timeline array<struct<timestamp:double,description:string>>, risk_level string, risk_score int, risk_status string, deterministic_score int, deterministic_level string, proposed_score int, actions array<string>, recommended_action string"
    rows = [(1, "", "long", None, [(61.9, 'a "b"\n'), (3700.0, None)], "orta", 40, "known", 40, "orta", None, [], "go"), (2, None, None, "", [], None, None, "unknown", None, None, 7, None, None), (3, "s", None, "00:09", None, "dusuk", 1, "known", 1, "dusuk", 1, ["x"], "go")]
    found = {r.id: json.loads(r.report_json) for r in projections.contract_report(spark.createDataFrame(rows, schema), "id").collect()}
    assert found[1]["events"] == [{"time": "01:01", "event": 'a "b"\n'}, {"time": "61:40", "event": None}]
    assert (found[1]["summary"], found[1]["onset_timestamp"], found[1]["actions"], found[1]["risk_accuracy"]["method"]) == ("long", "01:01", ["go"], "deterministic_score")
    assert (found[2]["summary"], found[2]["onset_timestamp"], found[2]["actions"], found[2]["risk_score"]) == (None, "00:00", [], None)
    assert (found[3]["summary"], found[3]["onset_timestamp"], found[3]["actions"]) == ("s", "00:09", ["x"])


def test_a_safe_context_reads_no_image(spark, tmp_path):
    """Neither the context nor the scan has the bytes."""
    rows = [(1, "s", bytearray(b"image"), [("fall", "dusme_riski", b"x")], [(5.0, 0.123456)])]
    spark.createDataFrame(rows, "id long, summary string, image_bytes binary, events array<struct<event_name:string,event_type:string,crop:binary>>, evidence array<struct<timestamp:double,change_score:double>>").write.parquet(f"{tmp_path}/a")
    context = projections.safe_context(spark.read.parquet(f"{tmp_path}/a"), "id")
    row = context.first().context.asDict(recursive=True)
    assert row == {"summary": "s", "events": [{"event_name": "fall", "event_type": "dusme_riski"}], "evidence": [{"time": "00:05", "change_score": 0.1235}]}
    plan = context._jdf.queryExecution().executedPlan().toString()
    assert "image_bytes" not in plan and "crop" not in plan


# -- streams


def test_windows_do_not_depend_on_the_order_of_arrival(spark):
    """Means that lie on a tie of the last place are the same however rows are spread over tasks."""
    rng = random.Random(6)
    rows = [(k, "2024-01-01 00:00:%02d" % (k % 60), 1, "view", round(rng.uniform(0, 100), 4), "") for k in range(800)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    means = {stream_windows(df.repartition(n), "1 hour").first().mean_value for n in (1, 3, 7)}
    assert len(means) == 1
    assert means.pop() == pytest.approx(sum(r[4] for r in rows) / 800)


def test_registry_across_batches_and_a_restart(spark, tmp_path):
    """The oldest rows go first, before and after a restart; every row enters once and leaves at most once."""
    folder = queries.in_parts(spark, SMALL)
    parts = spark.read.parquet(folder).withColumn("part", F.expr("ntile(4) over (order by ts, event_id)")).cache()
    arrived = f"{tmp_path}/arrived"

    def arrive(low, high):
        for k in range(low, high):
            parts.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(arrived)

    def run(idle_sec):
        events = event_stream(spark, arrived).withColumn("at_sec", F.unix_micros("ts") / 1e6)
        with with_rocksdb(spark):
            run_to_table(stream_registry(events, "user_id", "event_id", "at_sec", most=5, idle_sec=idle_sec), f"{tmp_path}/rows", f"{tmp_path}/checkpoint")
        return spark.read.parquet(f"{tmp_path}/rows")

    def held(rows):
        return {(r.key, r.id) for r in registered(rows).collect()}

    def want(last):
        seen = parts.filter(F.col("part") <= last).selectExpr("user_id", "event_id", "row_number() over (partition by user_id order by ts desc, event_id desc) as back")
        return {(str(r.user_id), r.event_id) for r in seen.filter("back <= 5").collect()}

    arrive(1, 4)
    assert held(run(4e6)) == want(3)
    arrive(4, 5)
    rows = run(4e6)
    assert held(rows) == want(4)
    assert rows.groupBy("key", "id", "change").count().filter("count > 1").count() == 0
    assert rows.filter("change = 'entered'").count() == parts.count()


def test_registry_forgets_idle_keys(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1, "view", 1.0, ""), (2, "2024-01-01 00:00:01", 2, "view", 1.0, ""), (3, "2024-01-01 02:00:00", 1, "view", 1.0, ""), (4, "2024-01-01 05:00:00", 1, "view", 1.0, "")]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts").cast("timestamp_ntz"))
    for low, high in ((1, 2), (3, 3), (4, 4)):
        df.filter(F.col("event_id").between(low, high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = event_stream(spark, f"{tmp_path}/in").withColumn("at_sec", F.unix_micros("ts") / 1e6)
    with with_rocksdb(spark):
        run_to_table(stream_registry(events, "user_id", "event_id", "at_sec", idle_sec=10_800.0), f"{tmp_path}/rows", f"{tmp_path}/checkpoint")
    found = sorted((r.key, r.id, r.change) for r in spark.read.parquet(f"{tmp_path}/rows").collect())
    assert found == [("1", 1, "entered"), ("1", 3, "entered"), ("1", 4, "entered"), ("2", 2, "entered"), ("2", 2, "idle")]


@pytest.mark.parametrize("interval", [1.0, 3.0, 50.0])
def test_rising_change_against_the_machine(spark, interval):
    """One key with most rows, others, a null one, null signatures and equal times, against the baseline of the frame selector."""
    from rillflow.operators.chains import rising_change
    from rillflow.operators.selection import Baseline

    rng = random.Random(int(interval))
    rows = [(rng.choice(["a"] * 5 + ["b", None]), k, rng.choice([k / 4, k // 4 * 1.0]), rng.choice([None, rng.uniform(0, 1), rng.uniform(0, 1), 0.5])) for k in range(500)]
    got = {r.id: r.rising for r in rising_change(spark.createDataFrame(rows, "k string, id long, t double, s double"), "k", "t", "id", "s", interval, 0.1, keep=5).collect()}
    want = {}
    for key in ("a", "b", None):
        base = Baseline()
        for _, i, t, s in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            want[i] = base.rising(t, s, interval, 0.1, 5)
    assert got == want
    assert 20 < sum(want.values()) < 480 or interval == 50.0


def test_motion_box(spark):
    from rillflow.operators.series import motion_box

    rows = [("f", 2, 3), ("f", 5, 3), ("f", 4, 9), ("g", 0, 0)]
    got = {tuple(r) for r in motion_box(spark.createDataFrame(rows, "frame string, px int, py int"), ["frame"], "px", "py", 10, 10).collect()}
    assert got == {("f", 2, 3, 4, 7, 0.28), ("g", 0, 0, 1, 1, 0.01)}


def test_tools_refuse_what_they_do_not_know(spark):
    from rillflow.operators import tools

    events = spark.createDataFrame([(k, "ab"[k % 2], float(k), 1.0) for k in range(20)], "event_id long, event_type string, at_sec double, value double")
    stores = tools.Stores(events, spark.createDataFrame([(1, "safety helmet rules"), (2, None)], "doc_id long, text string"))
    assert [r.id for r in tools.call(stores, "recent", event_type="b", limit=2).collect()] == [19, 17]
    assert sorted(r.id for r in tools.call(stores, "stretch", start_ts=3, end_ts=5.0).collect()) == [3, 4, 5]
    assert [(r.id, r.note) for r in tools.call(stores, "lookup", question="Helmet safety?", top_k=1).collect()] == [(1, "score 1")]
    assert [tools.call(stores, "verify", claim=c, event_type=t).first().note for c, t in (("helmet", "a"), ("helmet", "z"), ("xyzw", "a"), ("xyzw", ""))] == ["supported", "partly supported", "partly supported", "unsupported"]
    for name, args in (("drop", {}), ("recent", {"limit": 0}), ("recent", {"limit": 51}), ("recent", {"limit": "5"}), ("lookup", {"question": " "}), ("stretch", {"start_ts": 5.0, "end_ts": 4.0}), ("stretch", {"start_ts": -1.0})):
        with pytest.raises(ValueError):
            tools.call(stores, name, **args)
    with pytest.raises(TypeError):
        tools.call(stores, "recent", colour=1)
    with pytest.raises(ValueError):
        tools.call(stores, "recent", enabled=("lookup",))
    with pytest.raises(ValueError):
        tools.record_actions(events, "event_id", "launch")


def test_composed_text_needs_no_function(spark):
    """Lower-casing equals normalisation for composed and decomposed letters, ligatures, full-width forms and Hangul parts."""
    from rillflow.functions.text import turkish_lower, turkish_lower_py

    texts = ["İI Iıi", "más niño ¿qué?", "ÅÉ", "é å", "ﬁne ①② Ａ", "Ωμέγα Привет", "日本語カナ", "한국어", "한", "ſ", "…", "a b", "x²", None, ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(turkish_lower(F.col("t"))).collect()]
    assert got == [turkish_lower_py(t) for t in texts]


def test_files_that_are_cut_say_so(spark):
    from rillflow.sources.knowledge import parse_files

    files = spark.createDataFrame([("a.txt", bytearray(b"x" * 11)), ("b.txt", bytearray(b"x" * 10)), ("c.txt", bytearray(b"")), ("d.pdf", bytearray(b"x")), ("e.docx", bytearray(b"no zip")), ("f.txt", None)], "path string, content binary")
    got = {r.filename: (r.status, len(r.text or "")) for r in parse_files(files, 10).collect()}
    assert got == {"a.txt": ("cut", 10), "b.txt": ("ready", 10), "c.txt": ("error", 0), "d.pdf": ("error", 0), "e.docx": ("error", 0), "f.txt": ("error", 0)}


def test_near_repeats_against_a_loop(spark):
    from rillflow.operators.chains import without_near_repeats

    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "b", None]), k, rng.choice([None, rng.uniform(0, 1), rng.uniform(0, 1)])) for k in range(400)]
    df = spark.createDataFrame(rows, "k string, id long, s double").repartition(5)
    got = {r.id for r in without_near_repeats(df, "k", ["id"], "s", 0.3).collect()}
    want = set()
    for key in ("a", "b", None):
        last = None
        for _, i, s in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            if s is None or last is None or abs(s - last) >= 0.3:
                want.add(i)
                last = s
    assert got == want
    assert without_near_repeats(df.limit(0), "k", ["id"], "s", 0.3).count() == 0
