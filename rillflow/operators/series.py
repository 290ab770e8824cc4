"""Time series: noise floors, votes, density states, robust spikes, suppression and as-of lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.operators.along import carry_forward, over_history
from rillflow.operators.chains import rising_change, without_near_repeats
from rillflow.operators.quantiles import exact_medians
from rillflow.operators.sessions import seconds
from rillflow.plans.lineage import materialize
from rillflow.session import table

HISTORY = 30
VOTE_OF, VOTE_NEEDS = 6, 3
COOLDOWN_SEC = 3600.0
MAD_FACTOR = 6.0
LEAST_POINTS = 6
MOST_SPIKES = 6


def noise_floor(rows: DataFrame, key: list[str], order: list[str], value: str, history: int = HISTORY) -> DataFrame:
    """Add ``floor``, the median of the last ``history`` values including the current one, and ``net``, what exceeds it."""
    floored = over_history(rows, key, order, order[0], history, {"floor": lambda w: F.percentile(value, F.lit(0.5)).over(w)})
    return floored.withColumn("net", F.greatest(F.lit(0.0), F.col(value) - F.col("floor")))


def vote(rows: DataFrame, key: list[str], order: list[str], suspicious: Column, of: int = VOTE_OF, needs: int = VOTE_NEEDS) -> DataFrame:
    """Add ``suspicious`` and ``passed``: suspicious now, and at least ``needs`` times among the last ``of`` rows."""
    marked = rows.withColumn("suspicious", F.coalesce(suspicious, F.lit(False)))
    return over_history(marked, key, order, order[0], of, {"passed": lambda w: F.col("suspicious") & (F.sum(F.col("suspicious").cast("int")).over(w) >= needs)})


def density(rows: DataFrame, key: list[str], order: list[str], at: str, strong: Column, early: Column, cooldown: float = COOLDOWN_SEC) -> DataFrame:
    """Add the state: strong or early while the last such row is less than ``cooldown`` seconds old, else calm; strong goes first."""
    seen = carry_forward(rows, key, order, at, {"__strong": F.when(strong, F.col(at)), "__early": F.when(early, F.col(at))})
    recent = lambda last: F.coalesce(F.col(at) - F.col(last) < cooldown, F.lit(False))
    return seen.withColumn("state", F.when(recent("__strong"), "strong").when(recent("__early"), "early").otherwise("calm")).drop("__strong", "__early")


def robust_spikes(rows: DataFrame, key: list[str], value: str, factor: float = MAD_FACTOR, least: int = LEAST_POINTS) -> DataFrame:
    """Rows above median + factor x MAD of their key; keys with fewer than ``least`` rows have none, a MAD of 0 counts as 1e-6."""
    away = rows.join(exact_medians(rows, key, value), key)
    spread = exact_medians(away.select(*key, F.abs(F.col(value) - F.col("center")).alias("away")), key, "away", "mad").drop("n_points")
    limit = F.col("center") + factor * F.when(F.col("mad") == 0, 1e-6).otherwise(F.col("mad"))
    return away.join(spread, key).withColumn("limit", limit).filter((F.col("n_points") >= least) & (F.col(value) > F.col("limit")))


def suppress_near(spikes: DataFrame, key: str, at: str, score: str, gap: float, most: int = MOST_SPIKES) -> DataFrame:
    """Per key, spikes in order of falling score that keep ``gap`` seconds from all kept ones, at most ``most``.

    Every round keeps each key's best spike that is left, a maximum with partial
    sums, and drops what is too near to it; after ``most`` rounds all are found.
    Of equal scores the earliest goes first, of equal times as well the one
    with the smallest hash of its columns.  Null keys are a key.
    """
    columns = spikes.columns
    left = spikes.withColumn("__tie", F.xxhash64(*columns))
    kept = []
    for _ in range(most):
        left = materialize(left, "spikes")
        best = left.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*columns), F.struct(F.col(score), -F.col(at), -F.col("__tie").cast("decimal(20,0)"))).alias("__best"))
        kept.append(best.select("__best.*"))
        left = left.join(best, F.col(key).eqNullSafe(F.col("__key"))).filter(F.abs(F.col(at) - F.col("__best")[at]) >= gap).select(*columns, "__tie")
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, kept)


def as_of(left: DataFrame, right: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """Add to every left row the ``value`` of the last right row of its key at or before its time; null if there is none.

    Both sides are put in one time-ordered stream per key and the value is
    carried forward, from time bucket to time bucket: no range join.
    """
    both = right.select(*key, at, F.col(value).alias("__right"), F.lit(0).alias("__side"), F.lit(None).cast(_row_type(left)).alias("__row")).unionByName(
        left.select(*key, at, F.lit(None).cast(right.schema[value].dataType).alias("__right"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"))
    )
    seen = carry_forward(both, key, [at, "__side"], at, {"__last": F.col("__right")})
    return seen.filter("__side = 1").select("__row.*", F.col("__last").alias(value))


def _row_type(df: DataFrame) -> str:
    return df.schema.simpleString()


def carrier_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", seconds(F.col("ts")).alias("at_sec"), "event_type", "value")


def motion_box(cells: DataFrame, frame: list[str], x: str, y: str, width: int, height: int) -> DataFrame:
    """(frame, x, y, box_width, box_height, area): the box around a frame's changed cells and its share of the picture; frames without one have no row."""
    box = cells.groupBy(*frame).agg(F.min(x).alias("x"), F.min(y).alias("y"), (F.max(x) - F.min(x) + 1).alias("box_width"), (F.max(y) - F.min(y) + 1).alias("box_height"))
    return box.withColumn("area", F.col("box_width") * F.col("box_height") / F.lit(width * height))


def q_motion_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user within an hour as the changed cells of a frame of 64 x 48 cells."""
    cells = carrier_series(spark, sf_dir).select("user_id", F.floor(F.col("at_sec") / 3600).alias("hour"), (F.col("event_id") % 64).alias("cx"), (F.floor(F.col("value")) % 48).alias("cy"))
    return motion_box(cells, ["user_id", "hour"], "cx", "cy", 64, 48).select("user_id", "hour", "x", "y", "box_width", "box_height", F.round("area", 6).alias("area"))


def q_rising_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's values against a reference that is renewed after six hours."""
    marks = carrier_series(spark, sf_dir).select("event_id", "user_id", "at_sec", F.when(F.col("event_id") % 11 != 0, F.col("value") / 10000).alias("signature"))
    found = rising_change(marks, "user_id", "at_sec", "event_id", "signature", 21600.0, 0.004)
    return found.select("event_id", F.round("change", 9).alias("change"), F.round("net", 9).alias("net"), "rising")


def q_near_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events in order of time, without those near the last one that stays; some have no value."""
    marks = carrier_series(spark, sf_dir).select("event_id", "user_id", "at_sec", F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("signature"))
    return without_near_repeats(marks, "user_id", ["at_sec", "event_id"], "signature", 60.0).select("event_id", "user_id")


def q_rolling_noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise_floor(carrier_series(spark, sf_dir), ["user_id"], ["at_sec"], "value").select("event_id", F.round("floor", 4).alias("floor"), F.round("net", 4).alias("net"))


def q_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    floored = noise_floor(carrier_series(spark, sf_dir), ["user_id"], ["at_sec"], "value")
    return vote(floored, ["user_id"], ["at_sec"], F.col("net") >= 20.0).select("event_id", "suspicious", "passed")


def q_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density(carrier_series(spark, sf_dir), ["user_id"], ["at_sec"], "at_sec", F.col("value") >= 400, F.col("value") >= 200, 86400.0).select("event_id", "state")


def q_mad_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_spikes(carrier_series(spark, sf_dir), ["user_id"], "value", 3.0).select("event_id", "user_id", F.round("limit", 4).alias("limit"), F.round("value", 4).alias("value"))


def q_spike_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    spikes = robust_spikes(carrier_series(spark, sf_dir), ["user_id"], "value", 1.0).select("user_id", "event_id", "at_sec", "value")
    return suppress_near(spikes, "user_id", "at_sec", "value", 86400.0)


def q_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = carrier_series(spark, sf_dir)
    starts = series.filter("event_type = 'error'").select("event_id", "user_id", "at_sec")
    frames = series.filter("event_type = 'view'").select("user_id", "at_sec", F.col("event_id").alias("frame_id"))
    return as_of(starts, frames, ["user_id"], "at_sec", "frame_id").select("event_id", F.coalesce("frame_id", F.lit(-1)).alias("frame_id"))


def q_sampler_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept and dropped rows of every user and the dropped percentage."""
    floored = noise_floor(carrier_series(spark, sf_dir), ["user_id"], ["at_sec"], "value")
    kept = F.count_if(F.col("net") > 0)
    return floored.groupBy("user_id").agg(F.count("*").alias("evaluated"), kept.alias("kept"), F.round(100 * (F.count("*") - kept) / F.count("*"), 2).alias("dropped_pct"))


def q_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density(carrier_series(spark, sf_dir), ["user_id"], ["at_sec"], "at_sec", F.col("value") >= 400, F.col("value") >= 200, 86400.0).groupBy("state").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


_SERIES = "s AS (SELECT event_id, user_id, epoch(ts) AS at_sec, event_type, value FROM events)"
_FLOOR = f"{_SERIES}, f AS (SELECT *, median(value) OVER (PARTITION BY user_id ORDER BY at_sec ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS floor FROM s), n AS (SELECT *, greatest(0.0, value - floor) AS net FROM f)"
_STATE = f"""{_SERIES}, l AS (
  SELECT event_id, user_id, at_sec, max(CASE WHEN value >= 400 THEN at_sec END) OVER w AS strong, max(CASE WHEN value >= 200 THEN at_sec END) OVER w AS early
  FROM s WINDOW w AS (PARTITION BY user_id ORDER BY at_sec ROWS UNBOUNDED PRECEDING)),
d AS (SELECT event_id, user_id, CASE WHEN at_sec - strong < 86400 THEN 'strong' WHEN at_sec - early < 86400 THEN 'early' ELSE 'calm' END AS state FROM l)"""
QUERIES = {f.__name__: f for f in (q_near_repeats, q_motion_area, q_rising_change, q_rolling_noise_floor, q_vote, q_density, q_mad_spikes, q_spike_nms, q_as_of, q_sampler_stats, q_reason_counts)}
ORACLE_SQL = {
    "q_near_repeats": f"""WITH RECURSIVE {_SERIES}, k AS (SELECT event_id, user_id, CASE WHEN event_id % 13 <> 0 THEN value END AS sig, row_number() OVER (PARTITION BY user_id ORDER BY at_sec, event_id) AS n FROM s),
f AS (
  SELECT user_id, event_id, n, sig AS last, true AS kept FROM k WHERE n = 1
  UNION ALL
  SELECT k.user_id, k.event_id, k.n, CASE WHEN coalesce(abs(k.sig - f.last) >= 60, true) THEN k.sig ELSE f.last END, coalesce(abs(k.sig - f.last) >= 60, true) FROM f JOIN k ON k.user_id = f.user_id AND k.n = f.n + 1)
SELECT event_id, user_id FROM f WHERE kept""",
    "q_motion_area": f"""WITH {_SERIES}, c AS (SELECT user_id, CAST(floor(at_sec / 3600) AS BIGINT) AS hour, event_id % 64 AS cx, CAST(floor(value) AS BIGINT) % 48 AS cy FROM s)
SELECT user_id, hour, min(cx) AS x, min(cy) AS y, max(cx) - min(cx) + 1 AS box_width, max(cy) - min(cy) + 1 AS box_height, round((max(cx) - min(cx) + 1) * (max(cy) - min(cy) + 1) / (64 * 48), 6) AS area FROM c GROUP BY user_id, hour""",
    "q_rising_change": f"""WITH RECURSIVE {_SERIES}, m AS (SELECT event_id, user_id, at_sec, CASE WHEN event_id % 11 <> 0 THEN value / 10000 END AS sig FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_sec, event_id) AS n FROM m WHERE sig IS NOT NULL),
f AS (
  SELECT user_id, n, event_id, at_sec AS ref_at, sig AS ref_sig, CAST([] AS DOUBLE[]) AS history, CAST(0 AS DOUBLE) AS previous, CAST(NULL AS DOUBLE) AS change, CAST(NULL AS DOUBLE) AS net, false AS rising FROM k WHERE n = 1
  UNION ALL
  SELECT user_id, n, event_id, CASE WHEN due THEN at_sec ELSE ref_at END, CASE WHEN due THEN sig ELSE ref_sig END, CASE WHEN due THEN list_append(history, change)[-30:] ELSE history END, CASE WHEN due THEN 0 ELSE net END, change, net, net >= 0.004 AND net > previous
  FROM (
    SELECT *, greatest(0, change - coalesce(list_aggregate(history, 'median'), 0)) AS net
    FROM (SELECT k.user_id, k.n, k.event_id, k.at_sec, k.sig, f.ref_at, f.ref_sig, f.history, f.previous, k.at_sec >= f.ref_at + 21600 AS due, abs(k.sig - f.ref_sig) AS change FROM f JOIN k ON k.user_id = f.user_id AND k.n = f.n + 1)))
SELECT m.event_id, round(f.change, 9) AS change, round(f.net, 9) AS net, coalesce(f.rising, false) AS rising FROM m LEFT JOIN f USING (event_id)""",
    "q_rolling_noise_floor": f"WITH {_FLOOR} SELECT event_id, round(floor, 4) AS floor, round(net, 4) AS net FROM n",
    "q_vote": f"WITH {_FLOOR} SELECT event_id, net >= 20 AS suspicious, net >= 20 AND sum(CAST(net >= 20 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY at_sec ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) >= 3 AS passed FROM n",
    "q_density": f"WITH {_STATE} SELECT event_id, state FROM d",
    "q_mad_spikes": f"""WITH {_SERIES}, c AS (SELECT user_id, median(value) AS center, count(*) AS n FROM s GROUP BY user_id),
m AS (SELECT user_id, any_value(n) AS n, any_value(center) AS center, median(abs(value - center)) AS mad FROM s JOIN c USING (user_id) GROUP BY user_id)
SELECT event_id, user_id, round(center + 3 * CASE WHEN mad = 0 THEN 1e-6 ELSE mad END, 4) AS "limit", round(value, 4) AS value FROM s JOIN m USING (user_id) WHERE n >= 6 AND value > center + 3 * CASE WHEN mad = 0 THEN 1e-6 ELSE mad END""",
    "q_as_of": f"""WITH {_SERIES}, a AS (SELECT * FROM s WHERE event_type = 'error'), b AS (SELECT user_id, at_sec, event_id AS frame_id FROM s WHERE event_type = 'view')
SELECT a.event_id, coalesce(b.frame_id, -1) AS frame_id FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.at_sec >= b.at_sec""",
    "q_sampler_stats": f"WITH {_FLOOR} SELECT user_id, count(*) AS evaluated, count(*) FILTER (net > 0) AS kept, round(100 * (count(*) - count(*) FILTER (net > 0)) / count(*), 2) AS dropped_pct FROM n GROUP BY user_id",
    "q_reason_counts": f"WITH {_STATE} SELECT state, count(*) AS n, count(DISTINCT user_id) AS n_users FROM d GROUP BY state",
}
