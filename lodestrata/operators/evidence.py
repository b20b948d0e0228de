"""What trials leave behind: terminal states, calls of tools, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def terminal_states(trials: DataFrame) -> DataFrame:
    """(trial_id, terminal_state): completed, agent-failure or infra-failure.

    ``trials`` has exception (a type's name or null), tokens and endpoint_error.
    No exception is completed; an error of the endpoint or no token spent is the
    infrastructure's, anything else the agent's.
    """
    state = F.when(F.col("exception").isNull(), "completed").when(F.coalesce("endpoint_error", F.lit(False)) | (F.coalesce("tokens", F.lit(0)) == 0), "infra-failure").otherwise("agent-failure")
    return trials.select("trial_id", state.alias("terminal_state"))


def invocation_counts(steps: DataFrame, tools: str) -> DataFrame:
    """(trial_id, calls, matches): tool calls, and places in their commands that match ``tools``.

    ``steps`` has trial_id and calls: array<struct<name:string,arguments:string>>.
    """
    each = steps.select("trial_id", F.explode_outer("calls").alias("c"))
    return each.groupBy("trial_id").agg(F.count("c").alias("calls"), F.coalesce(F.sum(F.regexp_count("c.arguments", F.lit(tools))), F.lit(0)).alias("matches"))


def normal_answer_path(path):
    """Trimmed, without leading slashes and parts that say nothing; ``.`` becomes empty."""
    from lodestrata.operators.snapshots import normal_path

    return F.coalesce(normal_path(F.ltrim(F.trim(path), F.lit("/"))), F.lit(""))


def parsed_answers(answers: DataFrame) -> DataFrame:
    """(id, files, ok): the files an answer (id, text) names, once each in order; not ok where it is no object."""
    from lodestrata.operators.experiment import salvaged_json

    body = salvaged_json(F.col("text"))
    files = F.from_json(body, "struct<files:array<string>>")["files"]
    clean = F.array_distinct(F.filter(F.transform(files, normal_answer_path), lambda x: x != ""))
    return answers.select("id", F.coalesce(clean, F.array().cast("array<string>")).alias("files"), body.isNotNull().alias("ok"))


def usable_attempts(states: DataFrame) -> DataFrame:
    """(instance_id, scored, only_failures): attempts that count, and whether all of them are agent failures."""
    rows = states.where(F.col("terminal_state").isin("completed", "agent-failure"))
    return rows.groupBy("instance_id").agg(F.count(F.lit(1)).alias("scored"), F.bool_and(F.col("terminal_state") == "agent-failure").alias("only_failures"))


def cache_share(trials: DataFrame) -> DataFrame:
    """(arm, median_share, low, absent): cached shares of input tokens; long trials with at most 1 %; trials without the figure."""
    share = F.col("cached_tokens") / F.nullif(F.col("input_tokens"), F.lit(0))
    return trials.groupBy("arm").agg(F.median(share).alias("median_share"), F.count_if((F.col("turns") >= 5) & (share <= 0.01)).alias("low"), F.count_if(share.isNull()).alias("absent"))
