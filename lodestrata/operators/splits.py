"""Seeded, disjoint subsets of ids that grow without losing members."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def make_split(ids: list[str], seed: int, development: int, frozen: int, members: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Disjoint ``development`` and ``frozen`` subsets of a list of ids, which is a planned experiment's and small.

    Members of an earlier split stay where they are; the rest are drawn without
    replacement in one seeded order, so a larger split holds a smaller one.
    """
    distinct = sorted(set(ids))
    wanted = development + frozen
    # one draw of all that is wanted; where members are to be kept, of every id
    order = random.Random(seed).sample(distinct, len(distinct) if members else min(wanted, len(distinct)))
    held = {k: [x for x in (members or {}).get(k, []) if x in set(ids)] for k in ("development", "frozen")}
    taken = {x for v in held.values() for x in v}
    rest = iter(x for x in order if x not in taken)
    for name, size in (("development", development), ("frozen", frozen)):
        while len(held[name]) < size:
            x = next(rest, None)
            if x is None:
                raise ValueError(f"{len(distinct)} ids are too few for {development} and {frozen}")
            held[name].append(x)
    return held


def split_conflicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """(subset, id) of members of ``old`` that ``new`` does not keep in their subset."""
    return old.select("subset", "id").distinct().join(new.select("subset", "id").distinct(), ["subset", "id"], "left_anti")


def path_mentions(tasks: DataFrame) -> DataFrame:
    """(task_id, paths, mentioned): how many changed files a task's text names.

    ``tasks`` has task_id, text and paths: array<string>. A file is named by its
    path, or by a base name that no other of the paths has, between boundaries.
    """
    base = F.transform("paths", lambda p: F.element_at(F.split(p, "/"), -1))
    each = tasks.select("task_id", "text", base.alias("bases"), F.explode_outer("paths").alias("path"))
    name = F.element_at(F.split("path", "/"), -1)
    alone = F.size(F.filter("bases", lambda b: b == name)) == 1
    quoted = F.concat(F.lit(r"(?<![\w./-])\Q"), name, F.lit(r"\E(?![\w/-])"))
    hit = F.col("path").isNotNull() & (F.contains("text", "path") | (alone & F.rlike("text", quoted)))
    return each.groupBy("task_id").agg(F.count("path").alias("paths"), F.count_if(hit).alias("mentioned"))
