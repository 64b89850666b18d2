"""Dossiers: records of a topic rendered as value histories, items, events and stages."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.text import normalize


def at(turn, said):
    """``#turn, said date`` without the half that is missing."""
    return F.concat_ws(", ", F.concat(F.lit("#"), turn.cast("string")), F.concat(F.lit("said "), said))


def value_histories(records: DataFrame) -> DataFrame:
    """(scope, topic, name, current, earlier): the latest value per name, earlier distinct values newest first.

    Records are (scope, topic, name, value, turn); a run of equal values counts once.
    """
    w = Window.partitionBy("scope", "topic", "name").orderBy("turn")
    changed = F.coalesce(normalize(F.lag("value").over(w)) != normalize(F.col("value")), F.lit(True))
    r = records.withColumn("_new", changed).where("_new")
    values = F.transform(F.reverse(F.sort_array(F.collect_list(F.struct("turn", "value")))), lambda x: x["value"])
    h = r.groupBy("scope", "topic", "name").agg(values.alias("v"))
    rest = F.array_except(F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(1))), F.slice("v", 1, 1))
    return h.select("scope", "topic", "name", F.col("v")[0].alias("current"), F.array_join(rest, " ← ").alias("earlier"))


def first_items(records: DataFrame) -> DataFrame:
    """(scope, topic, kind, item, turn): first mention of each item, without case and extra blanks."""
    key = normalize(F.col("item"))
    first = F.min(F.struct("turn", "item")).alias("x")
    return records.groupBy("scope", "topic", "kind", key.alias("_k")).agg(first).select("scope", "topic", "kind", "x.item", "x.turn")


def rendered(records: DataFrame) -> DataFrame:
    """(scope, topic, text): one line per name, then one per kind of items; bounded by the distinct names and items of a topic."""
    h = value_histories(records.where("name is not null"))
    lines = h.select("scope", "topic", F.lit(0).alias("part"), F.col("name").alias("order"), F.concat(F.lit("- "), "name", F.lit(": "), "current", F.when(F.col("earlier") != "", F.concat(F.lit(" (earlier "), "earlier", F.lit(")"))).otherwise("")).alias("line"))
    items = first_items(records.where("item is not null")).groupBy("scope", "topic", "kind").agg(F.sort_array(F.collect_list(F.struct("turn", "item"))).alias("i"))
    items = items.select("scope", "topic", F.lit(1).alias("part"), F.col("kind").alias("order"), F.concat(F.lit("- "), "kind", F.lit(": "), F.array_join(F.transform("i", lambda x: x["item"]), ", ")).alias("line"))
    all_lines = F.transform(F.sort_array(F.collect_list(F.struct("part", "order", "line"))), lambda x: x["line"])
    return lines.unionByName(items).groupBy("scope", "topic").agg(F.array_join(all_lines, "\n").alias("text"))


def fit(lines: list[str], chars: int) -> list[str]:
    """Lines cut evenly so that together they have at most ``chars`` characters."""
    if sum(map(len, lines)) <= chars or not lines:
        return lines
    each, left = chars // len(lines), chars
    out = []
    for i, line in enumerate(sorted(range(len(lines)), key=lambda k: len(lines[k]))):
        each = left // (len(lines) - i)
        cut = lines[line][:each]
        left -= len(cut)
        out.append((line, cut))
    return [c for _, c in sorted(out)]


def fit_for(lines: list[str], chars: int, question: set[str]) -> list[str]:
    """Most relevant lines first (ln(n / df) + 0.1 per shared word) as long as they fit, in their own order."""
    words = [set(x.lower().split()) for x in lines]
    n = len(lines)
    df = {w: sum(w in s for s in words) for w in question}
    score = [sum(math.log(n / df[w]) + 0.1 for w in question & s) for s in words]
    kept, used = set(), 0
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        if used + len(lines[i]) <= chars:
            kept.add(i)
            used += len(lines[i])
    return [lines[i] for i in sorted(kept)]


def narrative_changes(have: DataFrame, want: DataFrame) -> DataFrame:
    """(scope, topic, action): narratives to add, rewrite or archive, from a full outer comparison of texts."""
    j = have.withColumnRenamed("text", "old").join(want.withColumnRenamed("text", "new"), ["scope", "topic"], "full")
    action = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "archive").when(~F.col("old").eqNullSafe(F.col("new")), "rewrite")
    return j.select("scope", "topic", action.alias("action")).where("action is not null")
