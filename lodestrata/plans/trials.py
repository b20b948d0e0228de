"""Queries over paired experiments; events stand for trials.

user_id is the instance; clicks are the baseline, views the treatment; value is
the metric, and a value of at least 20 a hit.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import evidence, splits
from lodestrata.operators import experiment as ex
from lodestrata.plans.base import query
from lodestrata.runtime import materialize, table

_TRIALS = """WITH trials AS (
    SELECT user_id AS instance_id, CASE event_type WHEN 'click' THEN 'baseline' ELSE 'treatment' END AS arm, event_id AS attempt, ts AS started_at,
           value, CASE WHEN value >= 20 THEN 1 ELSE 0 END AS hit
    FROM events WHERE event_type IN ('click', 'view') AND user_id IS NOT NULL
), latest AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance_id, arm ORDER BY started_at DESC NULLS LAST, attempt DESC) AS rn FROM trials) WHERE rn = 1
), pairs AS (
    SELECT instance_id, max(value) FILTER (arm = 'baseline') AS b_value, max(value) FILTER (arm = 'treatment') AS t_value,
           max(hit) FILTER (arm = 'baseline') AS b_hit, max(hit) FILTER (arm = 'treatment') AS t_hit,
           CASE WHEN count(DISTINCT arm) = 2 THEN NULL WHEN max(arm) = 'baseline' THEN 'missing_treatment' ELSE 'missing_baseline' END AS excluded
    FROM latest GROUP BY 1
)"""


def _trials(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").isin("click", "view") & F.col("user_id").isNotNull())
    return e.select(
        F.col("user_id").alias("instance_id"), F.when(F.col("event_type") == "click", ex.BASELINE).otherwise(ex.TREATMENT).alias("arm"), F.col("event_id").alias("attempt"),
        F.col("ts").alias("started_at"), "value", (F.col("value") >= 20).cast("int").alias("hit"), F.lit(True).alias("usable"), F.col("event_type").alias("terminal_state"),
    )


def _pairs(spark, d):
    return ex.pairs(ex.latest_attempts(_trials(spark, d)), ["value", "hit"])


@query(_TRIALS + " SELECT instance_id, arm, attempt, value FROM latest")
def latest_attempts(spark, d):
    return ex.latest_attempts(_trials(spark, d)).select("instance_id", "arm", "attempt", "value")


@query(_TRIALS + " SELECT instance_id, b_value, t_value, excluded FROM pairs")
def assemble_pairs(spark, d):
    return _pairs(spark, d).select("instance_id", "b_value", "t_value", "excluded")


@query(
    _TRIALS
    + """ SELECT count(*) FILTER (b_hit > 0 AND t_hit > 0) AS "both", count(*) FILTER (b_hit = 0 AND t_hit > 0) AS treatment_only,
        count(*) FILTER (b_hit > 0 AND t_hit = 0) AS baseline_only, count(*) FILTER (b_hit = 0 AND t_hit = 0) AS neither FROM pairs WHERE excluded IS NULL"""
)
def paired_outcomes(spark, d):
    return ex.paired_outcomes(_pairs(spark, d), "hit")


@query(_TRIALS + " SELECT arm, 'value' AS metric, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM trials GROUP BY 1")
def arm_summary(spark, d):
    return ex.arm_summary(_trials(spark, d), ["value"]).select("arm", "metric", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


@query(
    _TRIALS
    + """ SELECT round(median(t_value / b_value), 6) AS median_ratio, round(sum(t_value) / sum(b_value), 6) AS ratio_of_totals,
        round(avg(ln(t_value / b_value)), 6) AS mean_log_ratio, count(*) AS n FROM pairs WHERE excluded IS NULL AND b_value > 0 AND t_value > 0"""
)
def ratio_summary(spark, d):
    out = ex.ratio_summary(_pairs(spark, d), "value")
    return out.select(*[F.round(c, 6).alias(c) for c in ("median_ratio", "ratio_of_totals", "mean_log_ratio")], "n")


@query(_TRIALS + " SELECT arm, CASE arm WHEN 'baseline' THEN 'click' ELSE 'view' END AS terminal_state, count(*) AS n FROM latest GROUP BY 1, 2")
def latest_states(spark, d):
    return ex.latest_states(_trials(spark, d))


@query("SELECT event_type, round(regr_slope(value, epoch(ts)), 12) AS slope, count(*) AS n FROM events WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY 1")
def covariate_slope(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = table(spark, d, "events").where("value IS NOT NULL AND ts IS NOT NULL")
    return rows.groupBy("event_type").agg(F.round(F.regr_slope(F.col("value"), at), 12).alias("slope"), F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS seconds FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 2")
def wall_clock(spark, d):
    return ex.wall_clock(table(spark, d, "events").where("user_id IS NOT NULL"), "user_id", "ts").select("user_id", F.round("seconds", 6).alias("seconds"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_salvage(spark, d):
    body = ex.salvaged_json(F.concat(F.lit("answer: "), F.col("props"), F.lit(" end")))
    return table(spark, d, "events").select("event_id", F.get_json_object(body, "$.k").cast("int").alias("k"))


@query(
    """WITH x AS (SELECT user_id, list(DISTINCT event_type) AS a FROM events WHERE user_id IS NOT NULL GROUP BY 1)
    , s AS (SELECT user_id AS id, len(list_filter(a, lambda v: v IN ('click', 'view', 'refund'))) AS h, len(a) AS n FROM x)
    SELECT id, round(h / n, 6) AS precision, round(h / 3, 6) AS recall, CASE WHEN h > 0 THEN round(2.0 * (h / n) * (h / 3) / (h / n + h / 3), 6) ELSE 0.0 END AS f1, h > 0 AS any_hit FROM s"""
)
def precision_recall(spark, d):
    gold = F.array(F.lit("click"), F.lit("view"), F.lit("refund"))
    rows = table(spark, d, "events").where("user_id IS NOT NULL").groupBy(F.col("user_id").alias("id")).agg(F.collect_set("event_type").alias("answer")).withColumn("gold", gold)
    return ex.precision_recall(rows).select("id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "any_hit")


@query("SELECT event_type, list_sort(list(value))[least(count(*), CAST(floor(0.9 * count(*)) AS BIGINT) + 1)] AS p90 FROM events WHERE value IS NOT NULL GROUP BY 1")
def index_percentile(spark, d):
    """The value at place int(p n) of each type's sorted values.

    Values are counted first, so the window runs over different values with
    their counts and no array of a whole group is built.
    """
    from pyspark.sql.window import Window

    counts = table(spark, d, "events").where("value IS NOT NULL").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("event_type")
    placed = counts.withColumn("up_to", F.sum("n").over(w.orderBy("value"))).withColumn("total", F.sum("n").over(w))
    at = F.least(F.col("total") - 1, F.floor(F.lit(0.9) * F.col("total")))
    return placed.where(F.col("up_to") > at).groupBy("event_type").agg(F.min("value").alias("p90"))


@query()
def experiment_estimates(spark, d):
    paired = materialize(_pairs(spark, d).withColumn("even", F.col("instance_id") % 2 == 0), "pairs")
    return ex.group_estimates(paired, "even", "hit", "value")


# --- evidence: events stand for steps and trials -------------------------------

@query(
    """SELECT key, CASE WHEN kinds = 2 THEN round(cost, 6) END AS cost FROM (
        SELECT user_id AS key, sum(value * 1000 * CASE event_type WHEN 'click' THEN 13 WHEN 'view' THEN 7 END / 1e6) AS cost, count(DISTINCT event_type) FILTER (event_type IN ('click', 'view')) AS kinds
        FROM events WHERE user_id IS NOT NULL GROUP BY 1)"""
)
def priced_trials(spark, d):
    usage = table(spark, d, "events").where("user_id IS NOT NULL").select(F.col("user_id").alias("key"), F.col("event_type").alias("category"), (F.col("value") * 1000).alias("tokens"))
    prices = spark.createDataFrame([("click", 13.0), ("view", 7.0)], "category string, price double")
    return ex.priced(usage, prices, "key").select("key", F.round("cost", 6).alias("cost"))


_STATES = """WITH states AS (SELECT event_id AS trial_id, user_id AS instance_id, CASE WHEN event_type <> 'error' AND event_type <> 'refund' THEN 'completed'
        WHEN event_id % 5 = 0 OR floor(value) = 0 THEN 'infra-failure' ELSE 'agent-failure' END AS terminal_state FROM events)"""


def _states(spark, d):
    e = table(spark, d, "events")
    failed = F.when(F.col("event_type").isin("error", "refund"), F.col("event_type"))
    trials = e.select(F.col("event_id").alias("trial_id"), failed.alias("exception"), F.floor("value").alias("tokens"), F.when(F.col("event_id") % 5 == 0, True).alias("endpoint_error"))
    return evidence.terminal_states(trials).join(e.select(F.col("event_id").alias("trial_id"), F.col("user_id").alias("instance_id")), "trial_id")


@query(_STATES + " SELECT trial_id, terminal_state FROM states")
def terminal_states(spark, d):
    return _states(spark, d).select("trial_id", "terminal_state")


@query(_STATES + " SELECT instance_id, count(*) AS scored, bool_and(terminal_state = 'agent-failure') AS only_failures FROM states WHERE terminal_state <> 'infra-failure' GROUP BY 1")
def scored_attempts(spark, d):
    return evidence.usable_attempts(_states(spark, d))


@query(_STATES + ", s AS (SELECT instance_id, count(*) AS n FROM states WHERE terminal_state <> 'infra-failure' GROUP BY 1) SELECT DISTINCT e.user_id AS instance_id, 64 - coalesce(n, 0) AS missing FROM events e LEFT JOIN s ON s.instance_id = e.user_id WHERE e.user_id IS NOT NULL AND 64 - coalesce(n, 0) > 0")
def planned_deficits(spark, d):
    planned = table(spark, d, "events").where("user_id IS NOT NULL").select(F.col("user_id").alias("instance_id"), F.lit(64).alias("planned")).distinct()
    return ex.planned_deficit(planned, _states(spark, d).where("terminal_state <> 'infra-failure'"))


@query("SELECT event_type AS arm, round(median(CASE WHEN user_id <> 0 THEN value / user_id END), 6) AS median_share, count(*) FILTER (event_id % 10 >= 5 AND user_id <> 0 AND value / user_id <= 0.01) AS low, count(*) FILTER (user_id = 0 OR user_id IS NULL OR value IS NULL) AS absent FROM events GROUP BY 1")
def cache_engagement(spark, d):
    trials = table(spark, d, "events").select(F.col("event_type").alias("arm"), F.col("value").alias("cached_tokens"), F.col("user_id").cast("double").alias("input_tokens"), (F.col("event_id") % 10).alias("turns"))
    return evidence.cache_share(trials).select("arm", F.round("median_share", 6).alias("median_share"), "low", "absent")


@query("SELECT user_id AS trial_id, count(*) AS calls, CAST(sum(len(regexp_extract_all(props, '[13]'))) AS BIGINT) AS matches FROM events GROUP BY 1")
def tool_invocations(spark, d):
    steps = table(spark, d, "events").select(F.col("user_id").alias("trial_id"), F.array(F.struct(F.col("event_type").alias("name"), F.col("props").alias("arguments"))).alias("calls"))
    return evidence.invocation_counts(steps, "[13]")


@query("SELECT event_id AS id, CASE WHEN event_id % 4 = 3 THEN '' ELSE 'src/' || event_type || '.py lib/a.rs' END AS files, event_id % 4 <> 3 AS ok FROM events")
def parsed_answers(spark, d):
    body = F.concat(F.lit('so: {"files": ["/src//'), "event_type", F.lit('.py", "./lib/./a.rs", "lib/a.rs", " "]} done'))
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 4 == 3, "no object").otherwise(body).alias("text"))
    return evidence.parsed_answers(rows).select("id", F.array_join("files", " ").alias("files"), "ok")


@query(
    """WITH p AS (SELECT workspace_id AS task_id, document_path AS path, regexp_extract(document_path, '([^/]*)$', 1) AS base, length(document_path) % 3 AS r FROM (SELECT DISTINCT workspace_id, document_path FROM symbols WHERE document_path IS NOT NULL))
    , t AS (SELECT *, count(*) OVER (PARTITION BY task_id, base) AS n FROM p)
    SELECT task_id, count(*) AS paths, count(*) FILTER (r = 0 OR (r = 1 AND n = 1)) AS mentioned FROM t GROUP BY 1"""
)
def path_mentions(spark, d):
    """Tasks whose texts name a third of their files by path and a third by base name."""
    p = table(spark, d, "symbols").where("document_path IS NOT NULL").select(F.col("workspace_id").alias("task_id"), F.col("document_path").alias("path")).distinct()
    said = F.when(F.length("path") % 3 == 0, F.concat(F.lit("in `"), "path", F.lit("`"))).when(F.length("path") % 3 == 1, F.concat(F.lit("see "), F.substring_index("path", "/", -1), F.lit(",")))
    tasks = p.groupBy("task_id").agg(F.array_join(F.collect_list(said), "\n").alias("text"), F.collect_list("path").alias("paths"))
    return splits.path_mentions(tasks)


@query(
    """WITH old AS (SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'development' ELSE 'frozen' END AS subset, user_id AS id FROM events WHERE user_id IS NOT NULL)
    , new AS (SELECT DISTINCT CASE WHEN user_id % 6 = 0 THEN 'development' ELSE 'frozen' END AS subset, user_id AS id FROM events WHERE user_id IS NOT NULL)
    SELECT subset, id FROM old EXCEPT SELECT subset, id FROM new"""
)
def split_conflicts(spark, d):
    ids = table(spark, d, "events").where("user_id IS NOT NULL").select(F.col("user_id").alias("id")).distinct()
    part = lambda n: ids.select(F.when(F.col("id") % n == 0, "development").otherwise("frozen").alias("subset"), "id")
    return splits.split_conflicts(part(2), part(6))


@query("SELECT event_type AS arm, count(*) AS trials, count(*) FILTER (event_id % 3 > 0) AS using, round(avg(event_id % 3), 6) AS mean, round(stddev_samp(event_id % 3), 6) AS deviation FROM events GROUP BY 1")
def tool_uptake(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("arm"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3).alias("calls"))
    return ex.uptake(rows).select("arm", "trials", "using", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query("SELECT event_type AS \"group\", count(*) AS n, round(regr_slope(value, user_id), 8) AS slope, true AS inside FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL GROUP BY 1")
def slope_intervals(spark, d):
    """Slopes with bootstrap bounds around them."""
    found = ex.slope_estimates(table(spark, d, "events"), "event_type", "user_id", "value", draws=200)
    return found.select("group", "n", F.round("slope", 8).alias("slope"), ((F.col("low") <= F.col("slope")) & (F.col("slope") <= F.col("high"))).alias("inside"))
