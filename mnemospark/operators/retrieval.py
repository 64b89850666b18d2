"""Retrieval: fusion of keyword and semantic candidates, side channels and post-ranking, for many questions in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.config import RecallConfig
from mnemospark.functions.vectors import dot


BLOCK = 4096


def semantic_scores(asked: DataFrame, stored: DataFrame, least: float) -> DataFrame:
    """(query_id, mem_id, semantic) of at least ``least`` within scope: asked (query_id, scope, qv), stored (mem_id, scope, v), unit vectors.

    Every question meets every memory of its scopes, in blocks: both sides of a scope are cut into blocks of about ``BLOCK``
    rows and each pair of blocks is one matrix product, so a hot scope is work for many tasks.
    """
    import numpy as np
    import pandas as pd

    def cut(df: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
        blocks = df.groupBy("scope").agg(F.ceil(F.count("*") / BLOCK).alias(name))
        return df.join(blocks, "scope").withColumn(name[0], F.pmod(F.xxhash64(key), F.col(name)).cast("int")), blocks

    q, q_blocks = cut(asked, "query_id", "qs")
    m, m_blocks = cut(stored, "mem_id", "ms")
    q = q.drop("qs").join(m_blocks, "scope").withColumn("m", F.explode(F.sequence(F.lit(0), (F.col("ms") - 1).cast("int")))).select("scope", "q", "m", "query_id", "qv")
    m = m.drop("ms").join(q_blocks, "scope").withColumn("q", F.explode(F.sequence(F.lit(0), (F.col("qs") - 1).cast("int")))).select("scope", "q", "m", "mem_id", "v")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "mem_id": [], "semantic": []}).astype({"semantic": "float64", "query_id": "object", "mem_id": "object"})
        s = np.stack(left["qv"].to_numpy()) @ np.stack(right["v"].to_numpy()).T
        x, y = np.nonzero(s >= least)
        return pd.DataFrame({"query_id": left["query_id"].to_numpy()[x], "mem_id": right["mem_id"].to_numpy()[y], "semantic": s[x, y]})

    q, m = q.toDF(*q.columns), m.toDF(*m.columns)  # both may come from one table
    keys = ["scope", "q", "m"]
    return q.groupBy(*keys).cogroup(m.groupBy(*keys)).applyInPandas(run, "query_id string, mem_id string, semantic double")


def nearest(left: DataFrame, right: DataFrame, key: str, item: str, k: int, least: float | None = None, different: bool = False) -> DataFrame:
    """(key, item, similarity, place): the ``k`` rows of ``right`` (item, scope, v) with the greatest dot product for each row of ``left`` (key, scope, v).

    Similarities are rounded to six digits, ties go to the smaller item; ``different``: a row is not its own neighbour. Both sides of a scope are cut into
    blocks of about ``BLOCK`` rows; each pair of blocks is one matrix product that leaves at most k items a row, so pairs never meet as rows.
    """
    import numpy as np
    import pandas as pd

    def cut(df: DataFrame, name: str, own: str, parts: str) -> tuple[DataFrame, DataFrame]:
        sizes = df.groupBy("scope").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(parts))
        return df.join(sizes, "scope").withColumn(own, F.pmod(F.xxhash64(name), F.col(parts)).cast("int")).drop(parts), sizes

    a, a_sizes = cut(left.select(key, "scope", "v"), key, "i", "parts")
    b, b_sizes = cut(right.select(item, "scope", "v"), item, "j", "parts")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(name)
    a = a.join(b_sizes, "scope").select("scope", "i", every("j"), key, "v")
    b = b.join(a_sizes, "scope").select("scope", every("i"), "j", item, "v")
    a, b = a.toDF(*a.columns), b.toDF(*b.columns)  # both may come from one table
    types = dict(left.dtypes)[key], dict(right.dtypes)[item]

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({key: x[key][:0], item: y[item][:0], "similarity": np.zeros(0)})
        y = y.sort_values(item, ignore_index=True)
        s = np.round(np.stack(x["v"].to_numpy()) @ np.stack(y["v"].to_numpy()).T, 6)
        if different:
            place = {v: n for n, v in enumerate(y[item])}
            own = [(n, place[v]) for n, v in enumerate(x[key]) if v in place]
            if own:
                s[tuple(zip(*own))] = -9
        m = s.shape[1]
        rank = np.rint(s * 1e6).astype(np.int64) * m - np.arange(m)  # equal similarities: the smaller item first
        top = np.argpartition(-rank, min(k, m) - 1, axis=1)[:, : min(k, m)]
        n, c = np.repeat(np.arange(len(x)), top.shape[1]), top.ravel()
        good = s[n, c] >= (-1.5 if least is None else least)
        n, c = n[good], c[good]
        return pd.DataFrame({key: x[key].to_numpy()[n], item: y[item].to_numpy()[c], "similarity": s[n, c]})

    keys = ["scope", "i", "j"]
    found = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(run, f"{key} {types[0]}, {item} {types[1]}, similarity double")
    order = Window.partitionBy(key).orderBy(F.desc("similarity"), item)
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def scored(pairs: DataFrame, cfg: RecallConfig = RecallConfig(), search: bool = True) -> DataFrame:
    """(query_id, mem_id, score, reason) of pairs with ``keyword`` and ``semantic`` (null where a side has none), behind the acceptance floors."""
    floor = cfg.search_min_similarity if search else cfg.min_similarity
    least = cfg.keyword_floor(inject=not search, vectors=True)
    k, s = F.coalesce("keyword", F.lit(0.0)), F.coalesce("semantic", F.lit(0.0))
    w = cfg.semantic_weight
    score = F.when(F.col("semantic").isNotNull(), w * s + (1 - w) * k).otherwise((1 - w) * k)
    reason = F.when((k > 0) & (s > 0), "both").when(k > 0, "keyword").otherwise("semantic")
    return pairs.where((s >= floor) | (k >= least)).select("query_id", "mem_id", score.alias("score"), reason.alias("reason"))


def fused(keyword: DataFrame, semantic: DataFrame, cfg: RecallConfig = RecallConfig(), search: bool = True) -> DataFrame:
    """Full outer fusion of keyword and semantic candidates."""
    return scored(keyword.join(semantic, ["query_id", "mem_id"], "full"), cfg, search)


def first_writer(channels: list[DataFrame], key: list[str]) -> DataFrame:
    """Union of channels; the first channel that has a key wins."""
    out = None
    for i, c in enumerate(channels):
        c = c.withColumn("_priority", F.lit(i))
        out = c if out is None else out.unionByName(c)
    order = Window.partitionBy(*key).orderBy("_priority", F.desc("score"))
    return out.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_priority")


def interleaved(rankings: DataFrame, group: str, item: str) -> DataFrame:
    """Round-robin over rankings (group, ranking, rank, item); the first occurrence of an item wins."""
    order = Window.partitionBy(group, item).orderBy("rank", "ranking")
    firsts = rankings.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return firsts.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy("rank", "ranking"))).drop("_n")


def prefix_budget(rows: DataFrame, group: str, order: list, cost, budget: int) -> DataFrame:
    """Keep rows in order until the first that overflows the budget."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)


def greedy_budget(rows: DataFrame, group: str, order: list[str], item: str, cost: str, budget: int) -> DataFrame:
    """Keep each row in order that still fits; a row that doesn't is skipped, later smaller ones count.

    The rows of a group are folded in sorted order, JVM-side. Groups are result lists of one question or one
    session, bounded by their limits upstream.
    """
    entry = F.struct(*order, F.col(item).alias("_item"), F.col(cost).cast("bigint").alias("_cost"))
    lists = rows.groupBy(group).agg(F.sort_array(F.collect_list(entry)).alias("l"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(f"array<{dict(rows.dtypes)[item]}>").alias("kept"))

    def step(acc, x):
        fits = acc["used"] + x["_cost"] <= budget
        return F.when(fits, F.struct((acc["used"] + x["_cost"]).alias("used"), F.concat(acc["kept"], F.array(x["_item"])).alias("kept"))).otherwise(acc)

    return lists.select(group, F.aggregate("l", start, step).alias("r")).select(group, F.posexplode("r.kept").alias("position", item), F.col("r.used").alias("used"))


def greedy_groups(vectors: list, least: float = 0.75) -> list[list[int]]:
    """Ranked vectors (None where absent) to topic groups: an item joins the first group whose first member is near enough."""
    groups: list[list[int]] = []
    for i, v in enumerate(vectors):
        home = None
        if v is not None:
            home = next((g for g in groups if vectors[g[0]] is not None and sum(a * b for a, b in zip(v, vectors[g[0]])) >= least), None)
        if home is None:
            groups.append([i])
        else:
            home.append(i)
    return groups


def topic_groups(hits: DataFrame, least: float = 0.75) -> DataFrame:
    """(query_id, rank, mem_id, v) to (query_id, mem_id, topic_group): greedy groups over each question's ranked hits.

    The fold depends on the order, so each question's hits (at most its limit) are grouped in one place.
    """
    import pandas as pd

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rank", ignore_index=True)
        out = [0] * len(f)
        for number, members in enumerate(greedy_groups([None if v is None else list(v) for v in f["v"]], least)):
            for m in members:
                out[m] = number
        return pd.DataFrame({"query_id": f["query_id"], "mem_id": f["mem_id"], "topic_group": out})

    return hits.select("query_id", "rank", "mem_id", "v").groupBy("query_id").applyInPandas(run, "query_id string, mem_id string, topic_group int")


def pack(hits: list[dict], budget: int, share: float = 0.35) -> list[dict]:
    """Hits of one question into a token budget: leading hits always, memories up to (1 - share), excerpts in what is left, then leftovers.

    A hit is {"id", "tokens", "kind"} with kind ``leading``, ``memory`` or ``excerpt``, best first.
    """
    out = [h for h in hits if h["kind"] == "leading"]
    used = sum(h["tokens"] for h in out)
    excerpts = any(h["kind"] == "excerpt" for h in hits)
    cap = budget - int(budget * share) if excerpts else budget
    late = []
    for h in (h for h in hits if h["kind"] == "memory"):
        if used + h["tokens"] <= cap:
            out.append(h)
            used += h["tokens"]
        else:
            late.append(h)
    for h in [*(h for h in hits if h["kind"] == "excerpt"), *late]:
        if used + h["tokens"] <= budget:
            out.append(h)
            used += h["tokens"]
    return out


def time_chains(hits: DataFrame, least: float, chains: int = 5) -> DataFrame:
    """(query_id, chain, step, mem_id) from ranked hits (query_id, rank, mem_id, u, numbers, said).

    Seeds in rank order take the later hits that are near and give other numbers; a member is used once, at most ``chains`` chains.
    Hits of one question are bounded by its limit, so each question is folded in one place.
    """
    import pandas as pd

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rank", ignore_index=True)
        used: set[int] = set()
        out: list[tuple] = []
        number = 0
        for i in range(len(f)):
            if i in used or not f["numbers"][i] or number == chains:
                continue
            near = [j for j in range(i + 1, len(f)) if j not in used and f["numbers"][j] and f["numbers"][j] != f["numbers"][i] and float(sum(a * b for a, b in zip(f["u"][i], f["u"][j]))) >= least]
            if near:
                number += 1
                used.update([i, *near])
                order = sorted([i, *near], key=lambda k: (f["said"][k] or "", f["mem_id"][k]))
                out += [(f["query_id"][0], number, s, f["mem_id"][k]) for s, k in enumerate(order, 1)]
        return pd.DataFrame(out, columns=["query_id", "chain", "step", "mem_id"])

    return hits.select("query_id", "rank", "mem_id", "u", "numbers", "said").groupBy("query_id").applyInPandas(run, "query_id string, chain int, step int, mem_id string")
