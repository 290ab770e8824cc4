"""Links between events close in time, single and combination rules, and the evidence that belongs to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.functions.values import CARRIER_TYPES, COMBINATION_RULES, SINGLE_RULES
from rillflow.operators.sessions import SESSIONS_CTE, carrier_events, carrier_sessions, number_sessions
from rillflow.plans.lineage import materialize
from rillflow.session import table

LINK_SEC = 30.0
CARRIER_LINK_SEC = 3600.0


def canonical_type(name: Column) -> Column:
    """The event type that a carrier event's name stands for; null if there is none."""
    out = F.lit(None).cast("string")
    for key, value in reversed(CARRIER_TYPES):
        out = F.when(name == key, value).otherwise(out)
    return out


def gap_seconds(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Seconds between two intervals; 0 if they touch or overlap."""
    return F.greatest(b_start - a_end, a_start - b_end, F.lit(0.0))


def dyadic_cells(first: Column, after: Column) -> Column:
    """The fewest dyadic cells (level, cell) that make up the cells from ``first`` to before ``after``: at most two of each level, 2 to the power of the level wide."""
    lifted = lambda x, level: F.call_function("shiftright", x, level)

    def of(level: Column) -> Column:
        lo, hi = -lifted(-first, level), lifted(after, level)  # rounded up and down
        some, cell = lo < hi, lambda x: F.struct(level.alias("level"), x.alias("cell"))
        return F.array(F.when(some & (lo % 2 != 0), cell(lo)), F.when(some & (hi % 2 != 0), cell(hi - 1)))

    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(after - first, F.lit(1)).cast("double"))).cast("int") + 1)
    return F.filter(F.flatten(F.transform(levels, of)), lambda x: x.isNotNull())


def band_links(intervals: DataFrame, key: list[str], id_col: str, start: str, end: str, within: float) -> DataFrame:
    """(key, id, other): all ordered pairs of intervals of one key whose gap is at most ``within`` seconds.

    Of two such intervals the later one begins inside the earlier one or at most
    ``within`` after it.  So each interval, lengthened by the band, is cut to dyadic cells, whose
    number grows with the logarithm of its length, and each start is in one cell of every
    level that some interval uses; a pair meets in exactly one cell.  Rows with a null key, start or end have no links.
    """
    width = max(2 * within, 1.0)
    bucket = lambda c: F.floor(c / width).cast("long")
    row = intervals.select(*key, F.col(id_col).alias("id"), F.col(start).cast("double").alias("start"), F.col(end).cast("double").alias("end")).filter("start is not null and end is not null")
    spans = materialize(row.withColumn("c", F.explode(dyadic_cells(bucket(F.col("start")), bucket(F.greatest("start", F.col("end") + within)) + 1))).select(*key, F.col("id").alias("a"), F.col("start").alias("a_start"), F.col("end").alias("a_end"), "c.level", "c.cell"), "spans")
    levels = sorted(r.level for r in spans.select("level").distinct().collect())  # one for each power of two at most
    cells = F.array(*[F.struct(F.lit(x).alias("level"), F.shiftright(bucket(F.col("start")), x).alias("cell")) for x in levels]) if levels else F.array().cast("array<struct<level:int,cell:bigint>>")
    begins = row.withColumn("c", F.explode(cells)).select(*key, F.col("id").alias("b"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), "c.level", "c.cell")
    near = gap_seconds(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")) <= within
    later = (F.col("a_start") < F.col("b_start")) | ((F.col("a_start") == F.col("b_start")) & (F.col("a") < F.col("b")))
    pairs = spans.join(begins, [*key, "level", "cell"]).filter(later & near)
    both = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other"))))
    return pairs.select(*key, both.alias("pair")).select(*key, F.col("pair.id").alias(id_col), "pair.other")


def single_rules(spark: SparkSession) -> DataFrame:
    """(event_type, rule_id, severity, regulation): one rule for each of eight types."""
    return spark.createDataFrame(list(SINGLE_RULES), "event_type string, rule_id string, severity string, regulation string")


def combination_rules(spark: SparkSession, rules: tuple = COMBINATION_RULES) -> DataFrame:
    """(rule_id, required, severity); pass other rules to replace the built-in ones."""
    return spark.createDataFrame([(a, list(b), c) for a, b, c in rules], "rule_id string, required array<string>, severity string")


def match_combinations(events: DataFrame, links: DataFrame, rules: DataFrame, id_col: str = "event_id") -> DataFrame:
    """(rule_id, severity, source_id, participants): rules whose required types all occur in an event's neighbourhood.

    The neighbourhood is the event and its linked events; participants are its
    members of a required type.  Equal sets of participants count once, for the
    earliest anchor, whose id is the source if it takes part, else the first one.
    """
    typed = events.filter(F.col("event_type").isNotNull()).select(id_col, "event_type")
    anchors = events.select(F.col(id_col).alias("anchor"), "start_sec")
    around = links.select(F.col(id_col).alias("anchor"), F.col("other").alias("member")).unionByName(events.select(F.col(id_col).alias("anchor"), F.col(id_col).alias("member")))
    wanted = rules.select("rule_id", "severity", F.size("required").alias("n_required"), F.explode("required").alias("event_type"))
    found = (
        around.join(typed.withColumnRenamed(id_col, "member"), "member")
        .join(F.broadcast(wanted), "event_type")  # the rule set is a fixed short list
        .groupBy("anchor", "rule_id", "severity", "n_required")
        .agg(F.countDistinct("event_type").alias("n_types"), F.sort_array(F.collect_set("member")).alias("participants"))
        .filter("n_types = n_required")
        .join(anchors, "anchor")
    )
    first = Window.partitionBy("rule_id", "participants").orderBy("start_sec", "anchor")
    return (
        found.withColumn("n", F.row_number().over(first)).filter("n = 1")
        .select("rule_id", "severity", F.when(F.array_contains("participants", F.col("anchor")), F.col("anchor")).otherwise(F.element_at("participants", 1)).alias("source_id"), "participants")
    )


def best_evidence(members: DataFrame, event: list[str], score: str, place: str) -> DataFrame:
    """Each event's member with the highest score; of equal scores the first by ``place``.  Events without members have no row."""
    w = Window.partitionBy(*event).orderBy(F.col(score).desc_nulls_last(), place)
    return members.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def leftover(all_ids: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """Rows whose id is assigned to no event."""
    return all_ids.join(assigned.select(key).distinct(), key, "left_anti")


def select_current(events: DataFrame, analysis_id: str | None, call_ids: list[str], chunk_ids: list[str], evidence_ids: list[str]) -> DataFrame:
    """Rows of the current call: a different analysis id always excludes; then a shared call, chunk or evidence id selects."""
    gate = F.lit(True) if analysis_id is None else F.col("analysis_id").isNull() | (F.col("analysis_id") == analysis_id)
    lists = [(c, v) for c, v in (("call_ids", call_ids), ("chunk_ids", chunk_ids), ("evidence_ids", evidence_ids)) if v]
    chosen = F.lit(False)
    for column, values in lists:
        chosen = chosen | F.coalesce(F.arrays_overlap(column, F.array(*map(F.lit, values))), F.lit(False))
    return events.filter(gate & chosen)


def carrier_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carrier sessions as temporal events with an id and a type."""
    return carrier_sessions(spark, sf_dir).select(
        F.concat_ws("-", "event_name", F.lpad(F.col("session_no").cast("string"), 6, "0")).alias("event_id"), "event_name", canonical_type(F.col("event_name")).alias("event_type"), "start_sec", "end_sec", (F.col("end_sec") - F.col("start_sec")).alias("duration"), "occurrence_count", "confidence"
    ).withColumn("video_id", F.lit("all"))


def q_related_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return band_links(carrier_typed(spark, sf_dir), ["video_id"], "event_id", "start_sec", "end_sec", CARRIER_LINK_SEC).select("event_id", F.col("other").alias("related_id"))


def q_single_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carrier_typed(spark, sf_dir).join(F.broadcast(single_rules(spark)), "event_type").select("event_id", "event_type", "rule_id", "severity", "regulation")


def carrier_combinations(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Combination matches of the carrier; the events are read several times, so they are written once."""
    events = materialize(carrier_typed(spark, sf_dir), "events") if events is None else events
    links = band_links(events, ["video_id"], "event_id", "start_sec", "end_sec", CARRIER_LINK_SEC)
    return match_combinations(events, links, combination_rules(spark))


def q_combo_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carrier_combinations(spark, sf_dir).select("rule_id", "severity", "source_id", F.array_join("participants", ",").alias("participants"))


def q_best_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = number_sessions(carrier_events(spark, sf_dir), ["event_name"], "at", 1800.0, "event_id")
    return best_evidence(numbered, ["event_name", "session_no"], "value", "event_id").select("event_name", "session_no", "event_id", F.round("value", 4).alias("value"))


def q_leftover(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = carrier_events(spark, sf_dir)
    numbered = number_sessions(events, ["event_name"], "at", 1800.0, "event_id")
    long = numbered.groupBy("event_name", "session_no").agg(F.count("*").alias("n")).filter("n >= 3")
    return leftover(events.select("event_id", "event_name"), numbered.join(long, ["event_name", "session_no"]), "event_id")


def q_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_id",
        "event_type",
        F.when(F.col("user_id") % 3 == 0, "a0").when(F.col("user_id") % 3 == 1, "a1").alias("analysis_id"),
        F.array(F.concat(F.lit("c"), (F.col("event_id") % 7).cast("string"))).alias("call_ids"),
        F.array(F.concat(F.lit("k"), (F.col("event_id") % 11).cast("string")), F.lit("k99")).alias("chunk_ids"),
        F.array(F.concat(F.lit("ev"), F.col("event_id").cast("string"))).alias("evidence_ids"),
    )
    return select_current(events, "a0", ["c1", "c2"], ["k3"], ["ev5", "ev6"]).select("event_id", "event_type", "analysis_id")


def q_match_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules grouped by every event that takes part in them."""
    matches = carrier_combinations(spark, sf_dir)
    spread = matches.select("rule_id", F.explode(F.array_union("participants", F.array("source_id"))).alias("event_id"))
    return spread.groupBy("event_id").agg(F.count("*").alias("n_matches"), F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"))


TYPED_CTE = (
    SESSIONS_CTE
    + """,
typed AS (
  SELECT event_name || '-' || lpad(CAST(session_no AS VARCHAR), 6, '0') AS event_id, event_name, start_sec, end_sec, end_sec - start_sec AS duration, occurrence_count, confidence,
    CASE event_name WHEN 'error' THEN 'yangin_duman' WHEN 'purchase' THEN 'arac_yaya_yakinligi' WHEN 'click' THEN 'kkd_ihlali' WHEN 'signup' THEN 'dusme_riski' END AS event_type
  FROM sessions)
"""
)
SINGLE_CTE = "single_rules AS (SELECT * FROM (VALUES " + ", ".join(str(r) for r in SINGLE_RULES) + ") AS t(event_type, rule_id, severity, regulation))"
COMBO_CTE = """
links AS (SELECT a.event_id, b.event_id AS other FROM typed a JOIN typed b ON a.event_id <> b.event_id AND greatest(b.start_sec - a.end_sec, a.start_sec - b.end_sec, 0) <= 3600),
around AS (SELECT event_id AS anchor, other AS member FROM links UNION ALL SELECT event_id, event_id FROM typed),
wanted AS (SELECT * FROM (VALUES ('COMBO-01','kritik','kkd_ihlali'),('COMBO-01','kritik','arac_yaya_yakinligi'),('COMBO-02','kritik','dusme_riski'),('COMBO-02','kritik','kkd_ihlali'),
  ('COMBO-03','kritik','yangin_duman'),('COMBO-03','kritik','dar_alan_ihlali'),('COMBO-04','kritik','enerji_kesme_ihlali'),('COMBO-04','kritik','sicak_calisma_ihlali'),
  ('COMBO-05','yuksek','yetkisiz_erisim'),('COMBO-05','yuksek','agir_yuk_riski')) AS t(rule_id, severity, event_type)),
hits AS (
  SELECT anchor, rule_id, severity, list_sort(list(DISTINCT member)) AS participants
  FROM around JOIN typed t ON t.event_id = member JOIN wanted w USING (event_type) GROUP BY anchor, rule_id, severity HAVING count(DISTINCT w.event_type) = 2),
combos AS (
  SELECT rule_id, severity, CASE WHEN list_contains(participants, anchor) THEN anchor ELSE participants[1] END AS source_id, participants
  FROM (SELECT h.*, row_number() OVER (PARTITION BY rule_id, participants ORDER BY start_sec, anchor) AS n FROM hits h JOIN typed t ON t.event_id = h.anchor) WHERE n = 1)
"""
QUERIES = {f.__name__: f for f in (q_related_band, q_single_rules, q_combo_rules, q_best_evidence, q_leftover, q_selector, q_match_groups)}
ORACLE_SQL = {
    "q_related_band": f"WITH {TYPED_CTE} SELECT a.event_id, b.event_id AS related_id FROM typed a JOIN typed b ON a.event_id <> b.event_id AND greatest(b.start_sec - a.end_sec, a.start_sec - b.end_sec, 0) <= 3600",
    "q_single_rules": f"WITH {TYPED_CTE}, {SINGLE_CTE} SELECT event_id, event_type, rule_id, severity, regulation FROM typed JOIN single_rules USING (event_type)",
    "q_combo_rules": f"WITH {TYPED_CTE}, {COMBO_CTE} SELECT rule_id, severity, source_id, array_to_string(participants, ',') AS participants FROM combos",
    "q_best_evidence": f"WITH {SESSIONS_CTE} SELECT event_name, CAST(session_no AS BIGINT) AS session_no, event_id, round(value, 4) AS value FROM (SELECT n.*, e.value, row_number() OVER (PARTITION BY event_name, session_no ORDER BY e.value DESC, event_id) AS k FROM numbered n JOIN events e USING (event_id)) WHERE k = 1",
    "q_leftover": f"WITH {SESSIONS_CTE}, long AS (SELECT event_name, session_no FROM numbered GROUP BY ALL HAVING count(*) >= 3) SELECT n.event_id, n.event_name FROM numbered n ANTI JOIN long USING (event_name, session_no)",
    "q_selector": """
SELECT event_id, event_type, CASE user_id % 3 WHEN 0 THEN 'a0' WHEN 1 THEN 'a1' END AS analysis_id FROM events
WHERE user_id % 3 IN (0, 2) AND (event_id % 7 IN (1, 2) OR event_id % 11 = 3 OR event_id IN (5, 6))""",
    "q_match_groups": f"""
WITH {TYPED_CTE}, {COMBO_CTE}, spread AS (SELECT rule_id, unnest(list_distinct(list_append(participants, source_id))) AS event_id FROM combos)
SELECT event_id, count(*) AS n_matches, array_to_string(list_sort(list(DISTINCT rule_id)), ',') AS rules FROM spread GROUP BY event_id""",
}
