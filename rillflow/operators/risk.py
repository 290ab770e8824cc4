"""Deterministic risk: features of the contributing events, the score with its floor, blending, levels and escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.functions.values import (
    ALARM_FROM,
    CRITICAL_FLOOR,
    CRITICAL_TYPES,
    DURATION_FULL_SEC,
    HAZARD_TIERS,
    LEVEL_LIMITS,
    LIKELIHOOD_FLOOR,
    NOTIFY_FROM,
    RECURRENCE_FULL,
    SEVERITIES,
    W_DURATION,
    W_ESCALATION,
    W_EXPOSURE,
    W_PROTECTION,
    W_RECURRENCE,
    W_REGULATORY,
    W_RULES,
)
from rillflow.operators.rules import COMBO_CTE, SINGLE_CTE, TYPED_CTE, carrier_combinations, carrier_typed, single_rules
from rillflow.plans.lineage import materialize
from rillflow.session import table

MOST_BOOST = (1 + W_DURATION + W_RECURRENCE) * (1 + W_EXPOSURE) * (1 + W_PROTECTION) * (1 + W_RULES + W_REGULATORY)


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``x`` held within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def severity_rank(severity: Column) -> Column:
    """0 to 3; null for an unknown severity."""
    place = F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)
    return F.when(place > 0, place - 1).cast("int")


def level_of(score: Column, limits: tuple = LEVEL_LIMITS, inclusive: bool = False) -> Column:
    """The level of a score.  Limits belong to the level above; with ``inclusive`` to the level below."""
    out = F.lit(SEVERITIES[-1])
    for limit, name in reversed(limits):
        out = F.when((score <= limit) if inclusive else (score < limit), name).otherwise(out)
    return F.when(score.isNotNull(), out)


def hazard(words: Column) -> Column:
    """The highest tier of which a marker occurs in one of the words; 0 without words."""
    def tier(score: float, markers: tuple[str, ...]) -> Column:
        marked = F.exists(words, lambda w: F.exists(F.array(*map(F.lit, markers)), lambda marker: F.contains(w, marker)))
        return F.when(marked, F.lit(score)).otherwise(0.0)

    tiers = [tier(*x) for x in HAZARD_TIERS]
    return F.coalesce(F.greatest(*tiers), F.lit(0.0))


def score_features(rows: DataFrame) -> DataFrame:
    """Add base, boost and final score to rows of features.

    Reads severity_rank, likelihood, max_duration, max_occurrences, protection,
    has_combo, n_rules, relevance, hazard and critical_type.  A missing feature
    is neutral, not zero evidence: likelihood counts as 0.5, the others add
    nothing.  Exposure is never measured but stays in the normalisation.
    """
    severity = (F.col("severity_rank") + 1) / 4
    base = severity * (LIKELIHOOD_FLOOR + (1 - LIKELIHOOD_FLOOR) * F.coalesce("likelihood", F.lit(0.5)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    duration, recurrence = clip(F.col("max_duration") / DURATION_FULL_SEC), clip((F.col("max_occurrences") - 1) / (RECURRENCE_FULL - 1))
    support = F.when(F.col("has_combo"), 1.0).otherwise(clip(0.5 + 0.25 * (F.col("n_rules") - 1)))
    boost = (1 + W_DURATION * zero(duration) + W_RECURRENCE * zero(recurrence)) * (1 + W_PROTECTION * zero(F.col("protection"))) * (1 + W_RULES * zero(support) + W_REGULATORY * zero(clip(F.col("relevance"))))
    raw = clip(100 * F.col("base") * F.col("boost") / MOST_BOOST, 0.0, 100.0)
    floor = (F.col("severity_rank") == 3) & (F.col("hazard") >= 1.0) & F.col("critical_type")
    return (
        rows.withColumn("base", base).withColumn("boost", boost)
        .withColumn("floor_applied", F.coalesce(floor, F.lit(False)))
        .withColumn("unfloored", clip(raw * (1 + W_ESCALATION * F.coalesce("hazard", F.lit(0.0))), 0.0, 100.0))
        .withColumn("score", F.when(F.col("floor_applied"), F.greatest("unfloored", F.lit(CRITICAL_FLOOR))).otherwise(F.col("unfloored")))
        .withColumn("level", level_of(F.col("score")))
    )


def blend(scored: DataFrame, proposed: str) -> DataFrame:
    """Average the rounded score with a proposed one; the floor cannot be averaged away."""
    own = F.bround("score", 0)
    mean = F.when(F.col(proposed).isNotNull(), F.bround((own + F.col(proposed)) / 2, 0)).otherwise(own)
    held = F.when(F.col("floor_applied"), F.greatest(mean, F.lit(CRITICAL_FLOOR))).otherwise(mean)
    return scored.withColumn("deterministic_score", own.cast("int")).withColumn("blended_score", clip(held, 0, 100).cast("int")).withColumn("blended_level", level_of(F.col("blended_score").cast("double")))


def escalate(score: Column, assessed: Column, rule_backed: Column) -> Column:
    """The escalation tier; alarms and notices without a rule behind them go to review, and so does everything not assessed."""
    tier = F.when(score >= ALARM_FROM, "alarm").when(score >= NOTIFY_FROM, "notify").otherwise("monitor")
    return F.when(~F.coalesce(assessed, F.lit(False)) | score.isNull(), "pending_review").when(tier.isin("alarm", "notify") & ~F.coalesce(rule_backed, F.lit(False)), "pending_review").otherwise(tier)


def event_features(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Features of every event from the matches it takes part in.

    ``matches`` has rule_id, severity, types and participants.  Only matches of an
    event's highest severity contribute, and with them all their participants.
    """
    ranked = matches.withColumn("severity_rank", severity_rank(F.col("severity"))).filter("severity_rank is not null")
    own = ranked.select(F.explode("participants").alias("event_id"), "rule_id", "severity_rank", "types", "participants")
    top = Window.partitionBy("event_id")
    used = own.withColumn("top", F.max("severity_rank").over(top)).filter("severity_rank = top")
    rules = used.groupBy("event_id").agg(
        F.max("severity_rank").alias("severity_rank"),
        F.count("*").alias("n_rules"),
        F.max(F.startswith("rule_id", F.lit("COMBO-"))).alias("has_combo"),
        F.max(F.array_contains("types", "kkd_ihlali").cast("double")).alias("protection"),
        F.max(F.exists("types", lambda t: t.isin(*CRITICAL_TYPES))).alias("critical_type"),
    )
    members = used.select("event_id", F.explode("participants").alias("member")).distinct()
    facts = events.select(F.col("event_id").alias("member"), "confidence", "duration", "occurrence_count", hazard(F.col("keywords")).alias("hazard"))
    measured = members.join(facts, "member").groupBy("event_id").agg(
        F.max("confidence").alias("likelihood"), F.max("duration").alias("max_duration"), F.max("occurrence_count").alias("max_occurrences"), F.max("hazard").alias("hazard")
    )
    return rules.join(measured, "event_id", "left").withColumn("relevance", F.lit(None).cast("double"))


def carrier_keywords(name: Column, count: Column) -> Column:
    """Words that the carrier's events stand for."""
    fire = F.when(count >= 8, F.array(F.lit("kontrolsuz alev"))).when(count >= 3, F.array(F.lit("buyuyen duman"))).otherwise(F.array(F.lit("duman")))
    return F.when(name == "error", fire).otherwise(F.array().cast("array<string>"))


def carrier_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed_events = materialize(carrier_typed(spark, sf_dir), "events")  # read several times below
    events = typed_events.withColumn("keywords", carrier_keywords(F.col("event_name"), F.col("occurrence_count")))
    singles = events.join(F.broadcast(single_rules(spark)), "event_type").select("rule_id", "severity", F.array("event_type").alias("types"), F.array("event_id").alias("participants"))
    combos = carrier_combinations(spark, sf_dir, typed_events)
    typed = combos.select("rule_id", "severity", F.transform("participants", lambda p: F.when(p.startswith("error"), "yangin_duman").when(p.startswith("purchase"), "arac_yaya_yakinligi").when(p.startswith("click"), "kkd_ihlali").when(p.startswith("signup"), "dusme_riski")).alias("types"), "participants")
    return score_features(event_features(events, singles.unionByName(typed)))


def q_risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carrier_scored(spark, sf_dir).select("event_id", "severity_rank", "n_rules", "has_combo", F.round("hazard", 2).alias("hazard"), F.round("score", 4).alias("score"), "level", "floor_applied")


def carrier_blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = carrier_scored(spark, sf_dir)
    return blend(scored.withColumn("proposed", (F.col("max_occurrences") * 7 + F.col("n_rules")) % 101), "proposed")


def q_risk_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carrier_blended(spark, sf_dir).select("event_id", "deterministic_score", F.col("proposed").cast("int").alias("proposed"), "blended_score", "blended_level")


def q_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    blended = carrier_blended(spark, sf_dir).select("event_id", F.col("deterministic_score").alias("score"), (F.col("n_rules") > 1).alias("backed"))
    events = carrier_typed(spark, sf_dir).select("event_id").join(blended, "event_id", "left")
    return events.select("event_id", F.coalesce("score", F.lit(-1)).alias("score"), escalate(F.col("score"), F.col("score").isNotNull(), F.col("backed")).alias("tier"))


def q_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deterministic one-line explanation of every score."""
    names = F.array(*map(F.lit, SEVERITIES))
    return carrier_scored(spark, sf_dir).select("event_id", F.format_string("severity %s, %d rule(s)%s, score %d (%s)", F.element_at(names, F.col("severity_rank") + 1), F.col("n_rules"), F.when(F.col("floor_applied"), ", floor").otherwise(""), F.bround("score", 0).cast("int"), F.col("level")).alias("text"))


def q_level_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's score, a whole number that often lies on a limit, under both conventions for such scores."""
    scores = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("value") / 5).cast("double").alias("score"))
    return scores.select("event_id", "score", level_of(F.col("score")).alias("exclusive"), level_of(F.col("score"), inclusive=True).alias("inclusive"))


def q_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four follow-up questions per event, the first of each kind kept, in rule order."""
    raw = F.array(
        F.when(F.col("floor_applied"), "evacuate"), F.when(F.col("level") == "kritik", "why critical"), F.when(F.col("has_combo"), "which rules combine"),
        F.when(F.col("n_rules") > 1, "which rules combine"), F.when(F.col("hazard") > 0, "how far has it spread"), F.lit("what happened before"),
    )
    return carrier_scored(spark, sf_dir).select("event_id", F.array_join(F.slice(F.array_distinct(F.array_compact(raw)), 1, 4), "|").alias("suggestions"))


SCORED_CTE = f"""{TYPED_CTE}, {SINGLE_CTE}, {COMBO_CTE},
facts AS (SELECT *, CASE WHEN event_name <> 'error' THEN 0.0 WHEN occurrence_count >= 8 THEN 1.0 WHEN occurrence_count >= 3 THEN 0.75 ELSE 0.25 END AS hazard FROM typed),
matches AS (
  SELECT rule_id, severity, [event_type] AS types, [event_id] AS participants FROM typed JOIN single_rules USING (event_type)
  UNION ALL
  SELECT rule_id, severity, list_transform(participants, lambda p: CASE split_part(p, '-', 1) WHEN 'error' THEN 'yangin_duman' WHEN 'purchase' THEN 'arac_yaya_yakinligi' WHEN 'click' THEN 'kkd_ihlali' ELSE 'dusme_riski' END), participants FROM combos),
own AS (
  SELECT unnest(participants) AS event_id, rule_id, list_position(['dusuk', 'orta', 'yuksek', 'kritik'], severity) - 1 AS severity_rank, types, participants FROM matches),
used AS (SELECT * FROM (SELECT *, max(severity_rank) OVER (PARTITION BY event_id) AS top FROM own) WHERE severity_rank = top),
rule_part AS (
  SELECT event_id, CAST(max(severity_rank) AS INTEGER) AS severity_rank, count(*) AS n_rules, bool_or(starts_with(rule_id, 'COMBO-')) AS has_combo,
    CAST(max(CAST(list_contains(types, 'kkd_ihlali') AS INTEGER)) AS DOUBLE) AS protection, bool_or(list_has_any(types, ['yangin_duman', 'dusme_riski', 'enerji_kesme_ihlali'])) AS critical_type
  FROM used GROUP BY event_id),
event_part AS (
  SELECT m.event_id, max(confidence) AS likelihood, max(duration) AS max_duration, max(occurrence_count) AS max_occurrences, CAST(max(hazard) AS DOUBLE) AS hazard
  FROM (SELECT DISTINCT event_id, unnest(participants) AS member FROM used) m JOIN facts f ON f.event_id = m.member GROUP BY m.event_id),
parts AS (
  SELECT *, (severity_rank + 1) / 4 * (0.5 + 0.5 * likelihood) AS base,
    (1 + CAST(0.15 AS DOUBLE) * greatest(0, least(1, max_duration / 30)) + CAST(0.15 AS DOUBLE) * greatest(0, least(1, (max_occurrences - 1) / 4))) * (1 + CAST(0.2 AS DOUBLE) * protection)
    * (1 + CAST(0.15 AS DOUBLE) * CASE WHEN has_combo THEN 1.0 ELSE greatest(0, least(1, 0.5 + 0.25 * (n_rules - 1))) END) AS boost,
    severity_rank = 3 AND hazard >= 1.0 AND critical_type AS floor_applied
  FROM rule_part JOIN event_part USING (event_id)),
unfloored AS (SELECT *, greatest(0, least(100, greatest(0, least(100, 100 * base * boost / CAST(2.4336 AS DOUBLE))) * (1 + CAST(0.3 AS DOUBLE) * hazard))) AS before_floor FROM parts),
scored AS (
  SELECT *, CASE WHEN score < 25 THEN 'dusuk' WHEN score < 50 THEN 'orta' WHEN score < 75 THEN 'yuksek' ELSE 'kritik' END AS level
  FROM (SELECT *, CASE WHEN floor_applied THEN greatest(before_floor, 80.0) ELSE before_floor END AS score FROM unfloored))
"""
BLENDED_CTE = f"""{SCORED_CTE},
proposals AS (SELECT *, CAST(round_even(score, 0) AS INTEGER) AS deterministic_score, (max_occurrences * 7 + n_rules) % 101 AS proposed FROM scored),
blended AS (SELECT *, CAST(greatest(round_even((deterministic_score + proposed) / 2, 0), CASE WHEN floor_applied THEN 80 ELSE 0 END) AS INTEGER) AS blended_score FROM proposals)
"""
QUERIES = {f.__name__: f for f in (q_risk_score, q_risk_blend, q_escalation, q_explanation, q_level_variants, q_suggestions)}
ORACLE_SQL = {
    "q_risk_score": f"WITH {SCORED_CTE} SELECT event_id, severity_rank, n_rules, has_combo, round(hazard, 2) AS hazard, round(score, 4) AS score, level, floor_applied FROM scored",
    "q_risk_blend": f"""WITH {BLENDED_CTE} SELECT event_id, deterministic_score, CAST(proposed AS INTEGER) AS proposed, blended_score,
  CASE WHEN blended_score < 25 THEN 'dusuk' WHEN blended_score < 50 THEN 'orta' WHEN blended_score < 75 THEN 'yuksek' ELSE 'kritik' END AS blended_level FROM blended""",
    "q_escalation": f"""WITH {BLENDED_CTE} SELECT t.event_id, coalesce(b.deterministic_score, -1) AS score,
  CASE WHEN b.deterministic_score IS NULL THEN 'pending_review' WHEN b.deterministic_score >= 26 AND b.n_rules <= 1 THEN 'pending_review' WHEN b.deterministic_score >= 51 THEN 'alarm' WHEN b.deterministic_score >= 26 THEN 'notify' ELSE 'monitor' END AS tier
FROM typed t LEFT JOIN blended b USING (event_id)""",
    "q_explanation": f"""WITH {SCORED_CTE} SELECT event_id, format('severity {{}}, {{}} rule(s){{}}, score {{}} ({{}})', ['dusuk', 'orta', 'yuksek', 'kritik'][severity_rank + 1], n_rules, CASE WHEN floor_applied THEN ', floor' ELSE '' END, CAST(round_even(score, 0) AS INTEGER), level) AS text FROM scored""",
    "q_level_variants": """WITH s AS (SELECT event_id, floor(value / 5) AS score FROM events)
SELECT event_id, score, CASE WHEN score < 25 THEN 'dusuk' WHEN score < 50 THEN 'orta' WHEN score < 75 THEN 'yuksek' ELSE 'kritik' END AS exclusive,
  CASE WHEN score <= 25 THEN 'dusuk' WHEN score <= 50 THEN 'orta' WHEN score <= 75 THEN 'yuksek' ELSE 'kritik' END AS inclusive FROM s""",
    "q_suggestions": f"""WITH {SCORED_CTE} SELECT event_id, concat_ws('|', CASE WHEN floor_applied THEN 'evacuate' END, CASE WHEN level = 'kritik' THEN 'why critical' END, CASE WHEN has_combo OR n_rules > 1 THEN 'which rules combine' END,
  CASE WHEN hazard > 0 THEN 'how far has it spread' END, CASE WHEN CAST(floor_applied AS INTEGER) + CAST(level = 'kritik' AS INTEGER) + CAST(has_combo OR n_rules > 1 AS INTEGER) + CAST(hazard > 0 AS INTEGER) < 4 THEN 'what happened before' END) AS suggestions FROM scored""",
}
