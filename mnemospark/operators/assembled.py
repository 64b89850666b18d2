"""The assembled search: channels, pools and limits of many questions in one plan, and what follows the ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.config import RecallConfig
from mnemospark.functions.lists import DERIVED_TYPES
from mnemospark.functions.text import has_cue
from mnemospark.functions.lists import NEGATION_CUES
from mnemospark.operators import blocking

POOL = 16
INSTRUCTIONS = 10
ENTITY_SCORE = 0.4
HOP, HOP_SEEDS, HOP_MOST = 0.7, 8, 12
SUPERSEDED = 0.9
DIGEST_BOOST = 0.15
RERANKED = 80
NOTES = 3


def first(rows: DataFrame, by: list[str], order: list, most: Column | int, name: str = "n") -> DataFrame:
    """The first ``most`` rows of each ``by`` in ``order``, with their place."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= most)


def usable(rows: DataFrame) -> DataFrame:
    """Rows (status, kind, past) a search may show: recallable, or superseded where the question is about the past; no summaries."""
    live = F.col("status").isin("active", "contested") | (F.col("past") & (F.col("status") == "superseded"))
    return rows.where(live & ~F.coalesce("kind", F.lit("")).isin("summary"))


def entity_hits(asked: DataFrame, entities: DataFrame, found: DataFrame, limit: int, most_found: int) -> DataFrame:
    """(query_id, mem_id): the newest usable memories with an entity the question names, beyond those found; limit / 4 of them, three at least.

    ``asked``: query_id, scope, text, past; ``entities``: mem_id, scope, entity, status, kind, created_at. An entity of very many
    memories gives each question no more than what can still be shown beyond ``most_found`` found ones.
    """
    few = max(limit // 4, 3)
    newest = [F.desc("created_at"), "mem_id"]
    live = F.col("status").isin("active", "contested")
    e = entities.where(live | (F.col("status") == "superseded")).withColumn("live", live)
    e = e.withColumn("place", F.row_number().over(Window.partitionBy("scope", "entity").orderBy(*newest)))
    e = e.withColumn("live_place", F.row_number().over(Window.partitionBy("scope", "entity", "live").orderBy(*newest)))
    e = e.where((F.col("place") <= few + most_found) | (F.col("live") & (F.col("live_place") <= few + most_found)))
    texts = asked.select(F.struct("query_id", "scope").alias("ask"), "scope", "text", "query_id", "past")
    named = blocking.naming(texts, "ask", "text", e.select("scope", "entity"), "entity", ("scope",)).select("ask.query_id", "ask.scope", "entity")
    hits = named.join(e, ["scope", "entity"]).join(asked.select("query_id", "past").distinct(), "query_id")
    hits = usable(hits).where(F.coalesce("kind", F.lit("")) != "rule").select("query_id", "mem_id", "created_at").distinct()
    return first(hits.join(found.select("query_id", "mem_id"), ["query_id", "mem_id"], "left_anti"), ["query_id"], newest, few).select("query_id", "mem_id")


def entity_hops(asked: DataFrame, seeds: DataFrame, entities: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """(query_id, mem_id, score): one step along the entities of the best hits.

    ``seeds``: query_id, mem_id, score. Entities of more than ``HOP_MOST`` memories in a question's scopes link everything and are left out, as are those
    the question names itself; a memory counts ``HOP`` of its best source.
    """
    e = entities.where(~F.coalesce("kind", F.lit("")).isin(DERIVED_TYPES) & F.col("status").isin("active", "contested"))
    e = e.select("mem_id", "scope", F.lower("entity").alias("entity")).distinct()
    via = first(seeds, ["query_id"], [F.desc("score"), "mem_id"], HOP_SEEDS).join(e.select("mem_id", "entity"), "mem_id")
    via = via.groupBy("query_id", "entity").agg(F.max("score").alias("score")).join(asked.select("query_id", "scope"), "query_id")
    via = via.join(e.groupBy("scope", "entity").agg(F.count("*").alias("n")), ["scope", "entity"])
    via = via.withColumn("n", F.sum("n").over(Window.partitionBy("query_id", "entity"))).where(F.col("n") <= HOP_MOST).drop("n")
    texts = asked.select("query_id", "text").distinct()
    said = blocking.naming(texts, "query_id", "text", e.select("entity"), "entity")
    via = via.join(said, ["query_id", "entity"], "left_anti")
    linked = via.join(e, ["scope", "entity"]).groupBy("query_id", "mem_id").agg(F.max("score").alias("score"))
    linked = linked.join(found.select("query_id", "mem_id"), ["query_id", "mem_id"], "left_anti")
    return first(linked, ["query_id"], [F.desc("score"), "mem_id"], max(limit // 4, 3)).select("query_id", "mem_id", (F.col("score") * HOP).alias("score"))


def ranked(scores: DataFrame, memories: DataFrame, entities: DataFrame, asked: DataFrame, limit: int = 10, cfg: RecallConfig = RecallConfig(), hops: bool = False) -> DataFrame:
    """(query_id, position, mem_id, channel, score): instructions first, then hits by score.

    ``scores``: query_id, mem_id, keyword, and kind and status where they are known there; ``memories``: mem_id, kind, status; ``asked``: query_id, scope, text, past, aggregate
    (a row for each scope). Pool: three times the greater of ``limit`` and ``POOL``, twice that for totals; result: ``limit``, half as much again
    for totals; at most ``INSTRUCTIONS`` instructions, most relevant first, whatever their score.
    """
    flags = asked.select("query_id", "past", "aggregate").distinct()
    known = scores if "kind" in scores.columns else scores.join(memories, "mem_id")
    all_ = usable(known.where(F.coalesce("kind", F.lit("")) != "rule").join(flags, "query_id"))
    best = [F.desc("keyword"), "mem_id"]
    # whether a row is one of the instructions is seen where the rows of its question are
    instruction = F.coalesce(F.col("kind") == "instruction", F.lit(False))
    all_ = all_.withColumn("n", F.row_number().over(Window.partitionBy("query_id", instruction).orderBy(*best))).withColumn("leading", instruction & (F.col("n") <= INSTRUCTIONS))
    pool = max(limit, POOL) * 3
    instructions = all_.where("leading").select("query_id", "mem_id", "n")
    search = first(all_.drop("n").where(F.col("keyword") >= cfg.min_keyword_fallback), ["query_id"], best, F.when(F.col("aggregate"), 2 * pool).otherwise(pool))
    search = search.withColumn("score", F.col("keyword") * F.when(F.col("status") == "superseded", SUPERSEDED).otherwise(1.0)).select("query_id", "mem_id", "score", F.lit("search").alias("channel"), "kind", "aggregate", "leading")
    named = entity_hits(asked, entities, search, limit, 2 * pool).select("query_id", "mem_id", F.lit(ENTITY_SCORE).alias("score"), F.lit("entity").alias("channel"))
    columns = ["query_id", "mem_id", "score", "channel"]
    if hops:
        found = search.select(columns).unionByName(named)
        seeds = found.join(memories.where(~F.coalesce("kind", F.lit("")).isin(DERIVED_TYPES)).select("mem_id"), "mem_id")
        named = named.unionByName(entity_hops(asked, seeds, entities, found, limit).withColumn("channel", F.lit("hop")))
    named = named.join(memories.select("mem_id", "kind"), "mem_id").join(flags.select("query_id", "aggregate"), "query_id")
    shown = named.where("kind = 'instruction'").join(instructions.select("query_id", "mem_id"), ["query_id", "mem_id"], "left_anti").unionByName(named.where("coalesce(kind, '') <> 'instruction'").select("query_id", "mem_id", "score", "channel", "kind", "aggregate"))
    found = search.where(~F.col("leading")).drop("leading").unionByName(shown)
    boost = F.when(F.col("aggregate") & F.col("kind").isin("digest", "dossier"), DIGEST_BOOST).otherwise(0.0)
    found = found.withColumn("score", F.round(F.col("score") + boost, 6))
    hits = first(found, ["query_id"], [F.desc("score"), "mem_id"], F.when(F.col("aggregate"), limit * 3 // 2).otherwise(limit))
    out = instructions.select("query_id", "mem_id", "n", F.lit(0).alias("part"), F.lit("instruction").alias("channel"), F.lit(1.0).alias("score")).unionByName(
        hits.select("query_id", "mem_id", "n", F.lit(1).alias("part"), "channel", "score")
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("part", "n"))
    return out.withColumn("position", place).select("query_id", "position", "mem_id", "channel", "score")


def reranked(hits: DataFrame, logits: DataFrame) -> DataFrame:
    """(query_id, position, mem_id, score): the first ``RERANKED`` hits by the sigmoid of their logit (``logits``: query_id, mem_id, logit); the rest keep their order after them.

    A hit without a logit keeps its score.
    """
    h = hits.join(logits, ["query_id", "mem_id"], "left")
    near = F.col("position") <= RERANKED
    score = F.when(near & F.col("logit").isNotNull(), 1 / (1 + F.exp(-F.col("logit")))).otherwise(F.col("score"))
    h = h.withColumn("score", F.round(score, 6)).withColumn("late", ~near)
    order = Window.partitionBy("query_id").orderBy("late", F.when(~F.col("late"), -F.col("score")), F.when(~F.col("late"), F.col("mem_id")), "position")
    return h.withColumn("position", F.row_number().over(order)).select("query_id", "position", "mem_id", "score")


def negative(text: Column) -> Column:
    return has_cue(F.replace(text, F.lit("’"), F.lit("'")), NEGATION_CUES)


def conflicts(memories: DataFrame) -> DataFrame:
    """(mem_id, other, said, content): what contradicts a memory (mem_id, conflicts_with, content, said), where either side denies something."""
    a = memories.select("mem_id", F.explode(F.array_distinct("conflicts_with")).alias("other"), negative(F.col("content")).alias("denies"))
    b = memories.select(F.col("mem_id").alias("other"), "said", "content", negative(F.col("content")).alias("denied"))
    return a.join(b, "other").where("denies or denied").select("mem_id", "other", "said", "content")


def conflict_notes(hits: DataFrame, memories: DataFrame) -> DataFrame:
    """(query_id, note, first_id, second_id, text): at most ``NOTES`` notes, each for two sides of an unresolved contradiction among the hits.

    ``hits``: query_id, position, mem_id of yes-or-no questions; ``memories``: mem_id, status, said, content, conflicts_with. A memory is in one note;
    the hits of a question are bounded, so its notes are folded in one place.
    """
    import pandas as pd

    m = memories.select("mem_id", "status", "said", "content", F.get("conflicts_with", F.lit(0)).alias("other"), negative(F.col("content")).alias("denies"))
    o = m.select(F.col("mem_id").alias("other"), F.col("said").alias("other_said"), F.col("content").alias("other_content"), F.col("denies").alias("denied"))
    pairs = hits.join(m.where("status = 'contested'"), "mem_id").join(o, "other").where("denies or denied")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        out = []
        for r in f.sort_values("position").itertuples(index=False):
            if len(out) == NOTES or r.mem_id in used:
                continue
            sides = sorted([(r.said or "", r.mem_id, r.content), (r.other_said or "", r.other, r.other_content)], key=lambda x: x[:2])
            used.update((r.mem_id, r.other))
            text = "Unresolved contradiction: " + "; ".join(f'on {s[0][:10] or "an unknown date"} "{s[2]}"' for s in sides)
            out.append((r.query_id, len(out) + 1, sides[0][1], sides[1][1], text))
        return pd.DataFrame(out, columns=["query_id", "note", "first_id", "second_id", "text"])

    return pairs.groupBy("query_id").applyInPandas(run, "query_id string, note int, first_id string, second_id string, text string")


def block(mem_id: Column, kind: Column, scope: Column, said: Column, event: Column, status: Column, content: Column) -> Column:
    """A memory as a reader gets it."""
    none = F.lit("")
    return F.concat(
        F.lit('<ctx-memory id="'), mem_id, F.lit('" type="'), F.coalesce(kind, none), F.lit('" scope="'), scope, F.lit('" date="'), F.coalesce(F.substring(said, 1, 10), none), F.lit('"'),
        F.when(event.isNotNull(), F.concat(F.lit(' event="'), event, F.lit('"'))).otherwise(none), F.when(status == "contested", F.lit(' status="contested"')).otherwise(none),
        F.lit(">\n"), content, F.lit("\n</ctx-memory>"),
    )


def brief_line(said: Column, content: Column, turn: Column | None = None) -> Column:
    """``[#turn, date] text`` with the missing half left out."""
    at = F.concat_ws(", ", *([F.concat(F.lit("#"), turn.cast("string"))] if turn is not None else []), F.substring(said, 1, 10))
    return F.concat(F.when(at != "", F.concat(F.lit("["), at, F.lit("] "))).otherwise(F.lit("")), content)


def block_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def packed_conversation(hits: list[dict], budget: int, trim) -> list[dict]:
    """Excerpts whole while they fit, else cut by ``trim``; then memories in what is left, leading ones always. Memories come out first.

    A hit is {"id", "kind", "text"}; its cost is a quarter of its characters and 12.
    """
    cost = lambda h: len(h["text"]) // 4 + 12
    spent, excerpts, memories = 0, [], []
    for h in (h for h in hits if h["kind"] == "excerpt"):
        h = h if spent + cost(h) <= budget else {**h, "text": trim(h["text"])}
        if spent + cost(h) <= budget:
            spent += cost(h)
            excerpts.append(h)
    for h in (h for h in hits if h["kind"] != "excerpt"):
        if h["kind"] == "leading" or spent + cost(h) <= budget:
            spent += cost(h)
            memories.append(h)
    return memories + excerpts


def finished(hits: DataFrame, blocks: DataFrame, budget: int) -> DataFrame:
    """(question_id, place, id, kind): ranked hits with later blocks (timeline, notes, message log) after the leading ones, packed into the budget.

    ``hits``: question_id, position, id, kind, text, conversation; ``blocks``: question_id, stage, id, text. Each question's hits are bounded by its limits.
    """
    import pandas as pd

    from mnemospark.operators.excerpts import trimmed
    from mnemospark.operators.retrieval import pack

    rows = hits.select("question_id", F.lit(0).alias("stage"), "position", "id", "kind", "text", "question", "conversation").unionByName(
        blocks.select("question_id", "stage", F.lit(0).alias("position"), "id", F.lit("leading").alias("kind"), "text", F.lit(None).cast("string").alias("question"), F.lit(None).cast("boolean").alias("conversation"))
    )

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["stage", "position"], kind="stable")
        ranked_ = [r._asdict() for r in f[f["stage"] == 0].itertuples(index=False)]
        leading = [h for h in ranked_ if h["kind"] == "leading"]
        later = [r._asdict() for r in f[f["stage"] > 0].sort_values("stage", ascending=False).itertuples(index=False)]  # a later stage goes before an earlier one
        all_ = leading + later + [h for h in ranked_ if h["kind"] != "leading"]
        question = next((h["question"] for h in ranked_ if h["question"]), "")
        if ranked_ and bool(ranked_[0]["conversation"]):
            out = packed_conversation(all_, budget, lambda t: trimmed(t, question, 400))
        else:
            out = pack([{**h, "tokens": len(h["text"]) // 4 + 12} for h in all_], budget)
        return pd.DataFrame([(f["question_id"].iloc[0], i, h["id"], h["kind"]) for i, h in enumerate(out, 1)], columns=["question_id", "place", "id", "kind"])

    return rows.groupBy("question_id").applyInPandas(run, "question_id string, place int, id string, kind string")
