"""Operators on small hand-made rows, with order-dependent ones against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.functions import text as T
from rillflow.operators import chains, detection, folds, retrieval, risk, rules, sessions, stores, structured
from rillflow.operators.along import carry_forward, over_history
from rillflow.operators.selection import FrameSelector, SelectionParams, SelectionState, select_rows
from rillflow.operators.series import suppress_near
from rillflow.sources import knowledge, tables
from tests.oracle import SMALL


def test_sessions_merge_at_the_gap_and_ignore_other_names(spark):
    rows = [("a", 0.0, 0.5), ("b", 3.0, 0.9), ("a", 10.0, 0.6), ("a", 20.1, 0.7), ("a", None, 0.1)]
    df = spark.createDataFrame(rows, "name string, t double, c double")
    got = sorted(tuple(r) for r in sessions.sessionize(df, ["name"], "t", "c", 10.0).select("name", "session_no", "occurrence_count", F.round("confidence", 3)).collect())
    assert got == [("a", 0, 3, 0.7), ("a", 1, 1, 0.7), ("b", 0, 1, 0.9)]


@pytest.mark.parametrize("bucket", [7.0, 25.0, 300.0])
def test_session_numbers_do_not_depend_on_buckets(spark, bucket):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *[rng.uniform(0, 500)] * 9]), k) for k in range(150)] + [("c", 10.0 * k, 1000 + k) for k in range(6)]
    got = {r.k: r.session_no for r in sessions.number_sessions(spark.createDataFrame(rows, "n string, t double, k long"), ["n"], "t", 10.0, "k", bucket_sec=bucket).collect()}
    want = {}
    for name in ("a", "b", None, "c"):
        number, before = 0, None
        for _, t, k in sorted((r for r in rows if r[0] == name), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            number += before is not None and t is not None and t - before > 10
            want[k], before = number, t
    assert got == want


def test_band_links_equal_all_pairs(spark):
    rng = random.Random(4)
    rows = [(k % 3, k, s := rng.uniform(0, 500), s + rng.choice([0, 1, 40, 200])) for k in range(120)]
    df = spark.createDataFrame(rows, "v long, id long, s double, e double")
    got = {(r.id, r.other) for r in rules.band_links(df, ["v"], "id", "s", "e", 30.0).collect()}
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and max(b[2] - a[3], a[2] - b[3], 0) <= 30}
    assert got == want
    links = rules.band_links(df, ["v"], "id", "s", "e", 30.0)
    assert links.count() == len(want)
    assert "NestedLoop" not in links._jdf.queryExecution().toString()


def test_combination_needs_all_types_and_counts_once(spark):
    events = spark.createDataFrame([("e1", "kkd_ihlali", 0.0), ("e2", "arac_yaya_yakinligi", 5.0), ("e3", None, 6.0)], "event_id string, event_type string, start_sec double")
    links = spark.createDataFrame([(a, b) for a in ("e1", "e2", "e3") for b in ("e1", "e2", "e3") if a != b], "event_id string, other string")
    got = rules.match_combinations(events, links, rules.combination_rules(spark)).collect()
    assert [(r.rule_id, r.source_id, r.participants) for r in got] == [("COMBO-01", "e1", ["e1", "e2"])]


def features(spark, **change):
    row = {"severity_rank": 3, "likelihood": 0.9, "max_duration": 12.0, "max_occurrences": 2, "protection": 0.0, "has_combo": False, "n_rules": 1, "relevance": None, "hazard": 0.25, "critical_type": True} | change
    schema = "severity_rank int, likelihood double, max_duration double, max_occurrences int, protection double, has_combo boolean, n_rules int, relevance double, hazard double, critical_type boolean"
    return risk.score_features(spark.createDataFrame([tuple(row.values())], schema)).first()


def test_risk_is_monotone_bounded_and_floored(spark):
    ladder = [features(spark, hazard=h).score for h in (0.0, 0.25, 0.5, 0.75, 1.0)]
    assert ladder == sorted(ladder) and len(set(ladder)) == 5
    assert features(spark, likelihood=None).score < features(spark, likelihood=0.6).score
    top = features(spark, likelihood=1.0, max_duration=99.0, max_occurrences=9, protection=1.0, has_combo=True, relevance=1.0, hazard=0.0)
    assert top.score == pytest.approx(100 / 1.2)
    low = features(spark, likelihood=0.1, max_duration=0.0, max_occurrences=1, hazard=1.0)
    assert low.floor_applied and low.score >= 80
    assert not features(spark, severity_rank=2, hazard=1.0).floor_applied


def test_escalation_tiers(spark):
    rows = [(80, True, True), (80, True, False), (30, True, True), (10, True, False), (None, True, True), (80, None, True)]
    df = spark.createDataFrame(rows, "s int, a boolean, b boolean")
    got = [r[0] for r in df.select(risk.escalate(F.col("s"), F.col("a"), F.col("b"))).collect()]
    assert got == ["alarm", "pending_review", "notify", "monitor", "pending_review", "pending_review"]


def test_detection_and_negation(spark):
    rows = [(1, "Sahada duman ve alev var."), (2, "Duman yok. Her sey normal"), (3, "hicbir sey"), (4, None), (5, "Forklift gecti; duman gorulmedi")]
    got = sorted((r.id, r.event_type, round(r.confidence, 2)) for r in detection.detect(spark.createDataFrame(rows, "id long, text string"), "text").collect())
    assert got == [(1, "yangin_duman", 0.6), (2, "genel_gozlem", 0.0), (3, "genel_gozlem", 0.0), (4, "genel_gozlem", 0.0), (5, "arac_yaya_yakinligi", 0.5)]


def test_parse_of_broken_output(spark):
    rows = [(1, 'x EVENTS_JSON: [{"event": " a ", "confidence": "2",}, {"type": ""}, 5]'), (2, "none"), (3, None), (4, '[{"event_label": "b", "risk_hint": 140.4, "event_type": "yangin_duman"}]')]
    got = sorted((r.id, r.event_name, r.event_type, r.confidence, r.risk_hint) for r in detection.parse_events(spark.createDataFrame(rows, "id long, raw string"), "raw").collect())
    assert got == [(1, "a", None, 1.0, None), (4, "b", "yangin_duman", 0.5, 100)]


def test_times(spark):
    rows = [(1.0, 2.0), (None, None), (None, 2.0), (3.0, None), (-1.0, 2.0), (-3.0, 2.0), (5.0, 4.0), (18.0, 21.5), (18.0, 23.0), (float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "s double, e double").withColumn("o", F.lit(100.0)).withColumn("d", F.lit(20.0))
    out = [(r.time_status, r.global_start, r.global_end) for r in detection.normalize_times(df, "s", "e", "o", "d").collect()]
    assert out == [("valid", 101.0, 102.0), ("missing", None, None), ("invalid", None, None), ("valid", 103.0, 103.0), ("valid", 100.0, 102.0), ("invalid", None, None), ("invalid", None, None), ("valid", 118.0, 120.0), ("invalid", None, None), ("invalid", None, None)]


def test_segments(spark):
    out = [(r["index"], r.start_sec, r.end_sec, r.overlap_left_sec, r.overlap_right_sec) for r in detection.segment_plan(spark.createDataFrame([(25.0,)], "d double"), "d", 10.0, 2.0).orderBy("index").collect()]
    assert out == [(0, 0.0, 10.0, 0.0, 2.0), (1, 8.0, 18.0, 2.0, 2.0), (2, 16.0, 25.0, 2.0, 0.0)]
    with pytest.raises(ValueError, match="overlap"):
        detection.segment_plan(spark.range(1), "id", 5.0, 5.0)


def test_text_functions(spark):
    row = spark.sql("SELECT 'İSTANBUL IŞIK ve forkliftler' AS s, 'a b c' AS x, 'b c d' AS y, 125.5D AS t")
    got = row.select(T.turkish_lower(F.col("s")), T.jaccard(F.col("x"), F.col("y")), T.clock(F.col("t")), T.estimated_tokens(F.col("x")), F.array_sort(T.content_tokens(T.turkish_lower(F.col("s"))))).first()
    assert tuple(got) == ("istanbul ışık ve forkliftler", 0.5, "02:06", 2, ["forkliftler", "istanbul", "ışık"])
    assert T.first_json_object('reply: ```json\n{"a": {"b": "}"}} tail') == '{"a": {"b": "}"}}'
    assert T.first_json_object("none") is None


def test_split_text_is_lossless_and_bounded():
    rng = random.Random(2)
    for _ in range(50):
        text = "".join(rng.choice(["word ", "x" * 40, "\n\n", ". ", ", ", "y"]) for _ in range(rng.randint(0, 60)))
        parts = folds.split_text(text, 12)
        assert "".join(parts) == text
        assert all(T.estimated_tokens_py(p) <= 12 for p in parts)


def test_interval_merge_first_fit(spark):
    schema = "v long, event_id string, event_name string, event_type string, start_sec double, end_sec double, confidence double, occurrence_count int, chunk_ids array<string>, observation_ids array<string>"
    row = lambda i, s, e, chunk, name="red fire", kind="f", v=1: (v, i, name, kind, s, e, 0.5, 1, [chunk], ["o" + i])
    rows = [row("a", 0.0, 10.0, "c1"), row("b", 12.0, 20.0, "c2"), row("c", 24.0, 30.0, "c3"), row("d", 1.0, 9.0, "c1"), row("e", 12.0, 20.0, "c9", v=2), row("f", 12.0, 20.0, "c8", kind="g")]
    got = sorted((r.v, r.start_sec, r.end_sec, r.event_type, len(r.chunk_ids)) for r in folds.merge_intervals(spark.createDataFrame(rows, schema), ["v"]).collect())
    assert got == [(1, 0.0, 30.0, "f", 3), (1, 1.0, 9.0, "f", 1), (1, 12.0, 20.0, "g", 1), (2, 12.0, 20.0, "f", 1)]


def test_greedy_batches_keep_order_and_budget(spark):
    rows = [(1, k, n) for k, n in enumerate([3, 4, 5, 1, 9, 2])]
    got = [r.batch_no for r in folds.greedy_batches(spark.createDataFrame(rows, "k long, o long, n long"), "k", "o", "n", 9).orderBy("o").collect()]
    assert got == [0, 0, 1, 1, 2, 3]


def test_suppression_keeps_distance(spark):
    rows = [(1, float(t), float(s)) for t, s in [(0, 5), (1, 9), (2, 8), (10, 1), (11, 2)]]
    got = [(r.t, r.s) for r in suppress_near(spark.createDataFrame(rows, "k long, t double, s double"), "k", "t", "s", 1.5).collect()]
    assert got == [(1.0, 9.0), (11.0, 2.0)]


def frames(n, seed):
    rng = random.Random(seed)
    at = 0.0
    for k in range(n):
        at += rng.choice([0.2, 0.5, 2.0])
        yield k, at, max(0.0, rng.gauss(0.0003, 0.0005)) * rng.choice([1, 1, 1, 4]), rng.choice([None, 0.1, 0.6]), rng.uniform(0, 0.01)


def test_selection_can_be_interrupted_anywhere():
    params = SelectionParams()
    for seed in range(20):
        rows = list(frames(120, seed))
        whole = select_rows(rows, params)
        state, out = SelectionState(), []
        for row in rows:
            machine = FrameSelector(params, SelectionState.load(state.dump()))
            out += machine.take(*row)
            state = machine.s
        out += FrameSelector(params, state).finish()
        assert sorted(out, key=lambda r: (r[1], r[0])) == whole


def test_selection_falls_back_and_fires_on_threshold():
    still = [(k, k * 0.5, 0.0, None, 0.0) for k in range(5)]
    assert select_rows(still, SelectionParams()) == [(0, 0.0, 0.0, "fallback", True)]
    jump = [*still, (5, 2.5, 0.02, None, 0.5)]
    assert (5, 2.5, 0.02, "threshold_exceeded", False) in select_rows(jump, SelectionParams())


def test_keyed_tables(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, s string, v int")
    new = spark.createDataFrame([(1, None, 2), (3, "c", 2)], "k long, s string, v int")
    assert sorted(tuple(r) for r in tables.apply_updates(stored, new, "k", "v").select("k", "s", "v").collect()) == [(1, "a", 2), (2, "b", 1), (3, "c", 2)]
    assert sorted(r.k for r in stores.insert_or_ignore(stored, new, "k").collect()) == [3]
    assert tables.content_hash(stored, "k", "s") == tables.content_hash(stored.orderBy(F.desc("k")), "k", "s")
    assert tables.content_hash(stored, "k", "s") != tables.content_hash(new, "k", "s")


def test_manifest_guards(spark):
    a = tables.manifest(spark, "m", 64, True, "cosine", "d1", 3)
    assert tables.valid_manifest(a, a).count() == 1
    assert tables.valid_manifest(a, tables.manifest(spark, "m", 64, True, "cosine", "d2", 3)).count() == 0


def test_knowledge_sources(spark, tmp_path):
    (tmp_path / "one.json").write_text('[{"chunk_id": "1", "text": "Madde"}, {"chunk_id": "2", "text": "  "}]')
    (tmp_path / "bad.json").write_text("{broken")
    chunks = knowledge.read_chunks(spark, str(tmp_path))
    assert [(r.document_id, r.chunk_id) for r in chunks.collect()] == [("one", "1")]
    meta = tmp_path / "sources.yaml"
    meta.write_text("sources:\n  - id: one\n    title: \"First\"\n    institution: X\n  - id: two\n    title: Second\n")
    got = knowledge.with_metadata(chunks, knowledge.read_metadata(spark, str(meta))).select("document_id", "title", "institution").collect()
    assert [tuple(r) for r in got] == [("one", "First", "X")]
    files = tmp_path / "files"
    files.mkdir()
    (files / "a.txt").write_bytes("café".encode("latin-1"))
    (files / "b.exe").write_bytes(b"x")
    (files / "c.docx").write_bytes(b"not a zip")
    docs = sorted((r.filename, r.status, r.text) for r in knowledge.read_documents(spark, str(files)).collect())
    assert docs == [("a.txt", "ready", "café"), ("b.exe", "error", None), ("c.docx", "error", None)]


def test_article_segments(spark):
    text = "intro\nMADDE 1 - first\nbody\nMADDE 2 - second\nMADDE 1 - again"
    got = [(r.number, r.content) for r in knowledge.article_segments(spark.createDataFrame([(1, text), (2, "none"), (3, None)], "id long, t string"), "id", "t").orderBy("pos").collect()]
    assert [n for n, _ in got] == ["1", "2", "1__dup1"]
    assert "intro\n" + "".join(c for _, c in got) == text


def _merge_truth(rows):
    """First fit over one video's events in order of start, looking at every merged event."""
    from rillflow.operators.folds import names_alike

    merged = []
    for r in sorted(rows, key=lambda r: (r["start_sec"], r["event_id"])):
        home = None
        for m in merged:
            overlap = min(r["end_sec"], m["end_sec"]) - max(r["start_sec"], m["start_sec"])
            near = overlap / (max(r["end_sec"], m["end_sec"]) - min(r["start_sec"], m["start_sec"])) >= 0.3 if overlap > 0 else -overlap <= 5.0
            if not set(r["chunk_ids"]) & set(m["chunk_ids"]) and r["event_type"] == m["event_type"] and near and names_alike(r["event_name"], m["event_name"]) >= 0.5:
                home = m
                break
        if home is None:
            merged.append({**r, "chunk_ids": list(r["chunk_ids"]), "observation_ids": list(r["observation_ids"])})
            continue
        home["chunk_ids"] += [c for c in r["chunk_ids"] if c not in home["chunk_ids"]]
        home["observation_ids"] += r["observation_ids"]
        home["start_sec"], home["end_sec"] = min(home["start_sec"], r["start_sec"]), max(home["end_sec"], r["end_sec"])
    return sorted((m["event_type"] or "", m["start_sec"], m["end_sec"], tuple(sorted(m["observation_ids"]))) for m in merged)


def test_interval_merge_equals_first_fit_over_all_events(spark):
    import random

    from rillflow.operators.folds import merge_intervals

    rng = random.Random(4)
    rows = []
    for k in range(400):
        start = rng.choice([rng.uniform(0, 400), rng.uniform(0, 4000)])
        rows.append({"video": "v", "event_id": f"e{k:03d}", "event_name": rng.choice(["red fire", "red smoke", "fire red wall"]), "event_type": rng.choice(["a", "b", None]), "start_sec": start, "end_sec": start + rng.choice([0.0, 3.0, 60.0]), "confidence": 0.5, "occurrence_count": 1, "chunk_ids": [f"c{rng.randrange(40)}"], "observation_ids": [f"o{k}"]})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "video string, event_id string, event_name string, event_type string, start_sec double, end_sec double, confidence double, occurrence_count int, chunk_ids array<string>, observation_ids array<string>")
    got = sorted((r.event_type or "", r.start_sec, r.end_sec, tuple(sorted(r.observation_ids))) for r in merge_intervals(df, ["video"]).collect())
    assert got == _merge_truth(rows)


def test_relevance_composes_both_sides(spark):
    """A decomposed text and a ligature count like their composed forms."""
    from rillflow.operators.retrieval import relevance

    texts = ["ac\u0327\u0131k alev g\u00f6ru\u0308ldu\u0308", "a\u00e7\u0131k alev g\u00f6r\u00fcld\u00fc", "con\ufb01ned space"]
    df = spark.createDataFrame([(k, t, 0.5, None, None) for k, t in enumerate(texts)], "id int, content string, semantic double, title string, article string")
    rows = {r.id: r for r in relevance(df, "a\u00e7\u0131k alev g\u00f6r\u00fcld\u00fc", "content", "semantic", "title", "article", ["confined"]).collect()}
    assert rows[0].lexical_score == rows[1].lexical_score == 1.0 and rows[0].phrase_score == 1.0
    assert (rows[2].keyword_score, rows[0].keyword_score) == (1.0, 0.0)


def _along_rows(spark):
    draw = random.Random(5)
    rows = [(k, draw.choice([None, "a", "b"]) if k % 9 == 0 else "a", draw.choice([None, draw.uniform(0, 400.0)]) if k % 31 == 0 else float(draw.randrange(400)), draw.choice([None, draw.randrange(50)])) for k in range(400)]
    return rows, spark.createDataFrame(rows, "n long, key string, at double, value long").repartition(3)


def _along_order(row):
    return (row[2] is not None, row[2] or 0.0, row[0])


@pytest.mark.parametrize("bucket_sec", [0.5, 40.0, 1e9])
def test_carry_forward_against_a_loop(spark, bucket_sec):
    rows, df = _along_rows(spark)
    want, last = {}, {}
    for row in sorted(rows, key=_along_order):
        last[row[1]] = last.get(row[1]) if row[3] is None else row[3]
        want[row[0]] = (*row, last[row[1]])
    got = carry_forward(df, ["key"], ["at", "n"], "at", {"row": F.col("value")}, bucket_sec)
    assert got.columns == ["n", "key", "at", "value", "row"]
    assert {r[0]: tuple(r) for r in got.collect()} == want and got.count() == len(rows)
    assert carry_forward(df.limit(0), ["key"], ["at", "n"], "at", {"row": F.col("value")}).count() == 0


@pytest.mark.parametrize(("history", "chunk_rows", "bucket_sec"), [(1, 1, 40.0), (5, 4, 0.5), (30, 31, 40.0), (30, 50_000, 1e9)])
def test_history_windows_against_a_loop(spark, history, chunk_rows, bucket_sec):
    rows, df = _along_rows(spark)
    want, seen = {}, {}
    for row in sorted(rows, key=_along_order):
        past = seen.setdefault(row[1], [])
        past.append(row[3])
        want[row[0]] = (*row, sum(v or 0 for v in past[-history:]), len(past[-history:]))
    values = {"total": lambda w: F.coalesce(F.sum("value").over(w), F.lit(0)), "chunk": lambda w: F.count("*").over(w)}
    got = over_history(df, ["key"], ["at", "n"], "at", history, values, bucket_sec, chunk_rows)
    assert {r[0]: tuple(r) for r in got.collect()} == want and got.count() == len(rows)
    assert over_history(df.limit(0), ["key"], ["at", "n"], "at", history, values).count() == 0


@pytest.mark.parametrize("part_sec", [3.0, 50.0, 1e9])
def test_fold_of_sessions_against_a_loop(spark, part_sec):
    draw = random.Random(11)
    some = lambda *x: draw.choice([None, *x])
    rows = [(some("a", "b"), draw.randrange(2), draw.choice([None, float(draw.randrange(200))]), k, draw.random(), some("x", "y"), some(300.0), some("d1", "d2"), some(["k1", "k2"], ["k2"], []), [f"e{draw.randrange(30)}"], some(1, 5)) for k in range(150)]
    schema = "name string, session_no long, at double, n long, confidence double, event_type string, end_sec double, description string, keywords array<string>, evidence_ids array<string>, risk_hint int"
    want = {}
    for row in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0.0, r[3])):
        want.setdefault(row[:2], []).append(row)
    for key, group in want.items():
        union = lambda c: list(dict.fromkeys(x for r in group for x in r[c] or []))  # noqa: B023, E731
        times = [r[2] for r in group if r[2] is not None]
        typed = [r[5] for r in group if r[5] is not None]
        end = group[-1][6] if group[-1][6] is not None else group[-1][2]
        want[key] = (min(times), end, len(group), min(1.0, max(r[4] for r in group) + 0.05 * (len(group) - 1)), group[-1][7], typed[-1], union(8), union(9), max(r[10] or 0 for r in group))
    got = structured.fold_sessions(spark.createDataFrame(rows, schema).repartition(3), ["name"], "at", "n", part_sec)
    columns = ("start_sec", "end_sec", "occurrence_count", "confidence", "description", "event_type", "keywords", "evidence_ids", "risk_hint")
    assert {(r["name"], r["session_no"]): tuple(r[c] for c in columns) for r in got.collect()} == want
    assert structured.fold_sessions(spark.createDataFrame([], schema), ["name"], "at", "n").count() == 0


def test_nearest_vectors_among_ties_beyond_a_slice(spark):
    """Copies of few vectors in descending order of id, more rows than are scored at a time: of equal scores the smallest ids come first."""
    rng = np.random.default_rng(3)
    few = rng.normal(size=(5, 4))
    rows = [(k, few[int(rng.integers(0, 5))].tolist()) for k in range(2999, -1, -1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = {}
    for r in retrieval.search_vectors(vectors, "vec_id", "embedding", vectors.filter("vec_id % 500 = 0"), 10).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    by_id = dict(rows)
    for q in range(0, 3000, 500):
        want = sorted((i for i in by_id if i != q), key=lambda i: (-round(float(np.dot(by_id[i], by_id[q])), 9), i))[:10]
        assert [got[q][k + 1] for k in range(10)] == want


def test_chains_are_joined_without_the_driver(spark):
    """The stops of a chain grow with the rows; even small ones are merged, not broadcast."""
    placed = spark.createDataFrame([("a", k, float(k)) for k in range(1, 40)], "key string, at long, t double")
    starts = chains.chain_starts(placed, "key", "at", F.col("t"), F.col("t") + 5, at_limit=True)
    assert sorted(r.row for r in starts.collect()) == list(range(1, 40, 5))
    assert "Broadcast" not in chains.with_starts(placed, starts, "key", "at", "no")._jdf.queryExecution().executedPlan().toString()


def test_document_files_take_texts_one_by_one(spark):
    """No stage turns a whole batch of texts to objects, and files of more characters than are held at a time keep all their rows."""
    from rillflow.sources import queries

    plan = queries.q_document_files(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "ArrowEvalPython" not in plan
    long = "x" * (knowledge.PARSED_CHARS // 2 + 1)
    files = spark.createDataFrame([(f"f/{k}.txt", (str(k) + long).encode() if k % 5 else b"") for k in range(11)], "path string, content binary").coalesce(1)
    got = {r.filename: (r.status, r.n, r.first) for r in knowledge.parse_files(files, None).select("filename", "status", F.length("text").alias("n"), F.substring("text", 1, 1).alias("first")).collect()}
    assert got == {f"{k}.txt": ("ready", len(str(k)) + len(long), str(k)[0]) if k % 5 else ("error", None, None) for k in range(11)}


def test_lexical_overlap_without_cutting_texts(spark):
    """Shares as from all content tokens of the text: stems, whole short tokens, neighbours of other alphabets, stop words that begin like a stem."""
    query = ["general", "genel", "12", "work", "olara", "şart"]
    stems = [q[:5] for q in query]
    pieces = ["general", "generic", "xgeneral", "genelde", "12", "112", "12a", "work", "works", "é12é", "olarak", "olaraklar", "şart", "şartı", "ab", "-", "WORK"]
    rng = random.Random(2)
    texts = ["", None, *[rng.choice([" ", "-", "\n", "é"]).join(rng.choices(pieces, k=rng.randrange(1, 5))) for _ in range(300)]]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").withColumn("low", T.turkish_lower(F.col("t")))
    share = df.select("k", retrieval.lexical_overlap(query, F.col("low")).alias("s"))
    got = {r.k: r.s for r in share.collect()}
    for k, t in enumerate(texts):
        found = {x[:5] for x in T.content_tokens_py(t)}
        assert got[k] == pytest.approx(sum(s in found for s in stems) / len(query)), t
    assert "regexp_extract_all" not in share._jdf.queryExecution().executedPlan().toString()
