"""Records of conversations for a question: the message log, the timeline, topic order; and model replies as tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.text import date_start, unfence
from mnemospark.operators import blocking
from mnemospark.plans.lineage import written

RELEVANT = 20
LINE, NOTE_LINE = 700, 500
LEAST_LINE, MOST_LINE = 140, 400
TOLD = 4096  # questions of a task that writes timelines, about


def message_line(number: Column, said: Column, text: Column, note: Column | None = None) -> Column:
    """``- #n [date] text → Assistant: note``, cut and on one line."""
    cut = F.when(F.length(text) > LINE, F.concat(F.substring(text, 1, LINE), F.lit("…"))).otherwise(text)
    tail = F.lit("") if note is None else F.coalesce(F.concat(F.lit(" → Assistant: "), F.substring(note, 1, NOTE_LINE)), F.lit(""))
    return F.concat(F.lit("- #"), number.cast("string"), F.lit(" ["), F.coalesce(said, F.lit("date unknown")), F.lit("] "), F.replace(F.concat(cut, tail), F.lit("\n"), F.lit(" ")))


def message_log(questions: DataFrame, ranked: DataFrame, turns: DataFrame, chars: int, texts: DataFrame | None = None) -> DataFrame:
    """(query_id, kept, total, text): the user's messages for a question, in conversation order, within ``chars``.

    ``questions``: query_id, scope, whole, notes; ``ranked``: query_id, ranking, place, turn_id (rankings of the question and of its sub-queries);
    ``turns``: turn_id, scope, number, said, text, note; or turn_id, scope, number, full (whether there is a text) beside ``texts``: turn_id, said, text, note.
    Rankings take turns, each message once; a whole record is followed by the messages that no ranking has, others keep the ``RELEVANT`` first.
    Messages go in while they fit, a longer one is skipped. A line has ``LEAST`` characters at least, so only the first ``chars`` / 10 messages of a
    question can matter: only these lines are made, and those of a scope move once for ``TOLD`` questions, not with each.
    """
    if texts is None:
        turns, texts = turns.select("turn_id", "scope", "number", F.coalesce(F.col("text") != "", F.lit(False)).alias("full")), turns.select("turn_id", "said", "text", "note")
    once = ranked.groupBy("query_id", "turn_id").agg(F.min(F.struct("place", "ranking")).alias("at"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("at"))
    first = once.withColumn("order", order).join(questions.select("query_id", "whole"), "query_id").where(F.col("whole") | (F.col("order") <= RELEVANT))
    first = written(first.select("query_id", "turn_id", "order"), "ranked")
    most = chars // 10 + 1
    counted = first.groupBy("query_id").agg(F.count("*").cast("int").alias("listed"))
    bound = questions.where("whole").join(counted, "query_id", "left").groupBy("scope").agg(F.max(F.coalesce("listed", F.lit(0))).alias("listed"))
    spare = turns.where("full").withColumn("seat", F.row_number().over(Window.partitionBy("scope").orderBy("number")))
    spare = written(spare.join(bound, "scope").where(F.col("seat") <= most + F.col("listed")).select("scope", "turn_id", "seat"), "spare")
    wanted = first.select("turn_id").unionByName(spare.select("turn_id")).distinct()
    bits = blocking.slots(wanted.select(F.xxhash64("turn_id").alias("term")))
    some = texts.where(blocking.in_slots(F.xxhash64("turn_id"), bits)).join(wanted, "turn_id").join(turns.select("turn_id", "number"), "turn_id")
    of = lambda note: message_line(F.col("number"), F.col("said"), F.col("text"), note)
    lines = written(some.select("turn_id", "number", of(None).alias("line"), of(F.col("note")).alias("noted")), "lines")
    own = first.join(lines, "turn_id").join(questions.select("query_id", "notes"), "query_id")
    own = own.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("order", "turn_id", "number", F.when(F.col("notes"), F.col("noted")).otherwise(F.col("line")).alias("line")))).alias("own"))
    totals = turns.where("full").groupBy("scope").agg(F.count("*").alias("total"))
    asks = questions.join(own, "query_id", "left").where(F.col("whole") | F.col("own").isNotNull()).join(totals, "scope")
    cuts = questions.groupBy("scope").agg(F.ceil(F.count("*") / TOLD).cast("int").alias("cuts"))
    asks = asks.join(cuts, "scope").select("scope", F.pmod(F.xxhash64("query_id"), F.col("cuts")).cast("int").alias("cut"), "query_id", "whole", "notes", "total", *[F.col(f"own.{c}").alias(c) for c in ("turn_id", "number", "line")])
    told = spare.join(lines, "turn_id").join(cuts, "scope").select("scope", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), "seat", "turn_id", "number", "line", "noted")
    asks, told = asks.toDF(*asks.columns), told.toDF(*told.columns)

    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("seat")
        spares = {notes: list(zip(t["turn_id"], t["number"], t["noted" if notes else "line"])) for notes in (False, True)}
        shortest = {notes: min((len(x[2]) for x in spares[notes]), default=0) for notes in spares}
        out = []
        for query, whole, notes, total, *listed in q[["query_id", "whole", "notes", "total", "turn_id", "number", "line"]].itertuples(index=False):
            listed = list(zip(*listed)) if listed[0] is not None else []
            if not listed and not spares[bool(notes)]:
                continue
            seen, spent, kept = {x[0] for x in listed}, 0, []
            for turn, number, line in listed:
                if spent + len(line) + 1 <= chars:
                    spent += len(line) + 1
                    kept.append((number, line))
            for turn, number, line in spares[bool(notes)][: most + len(listed)] if whole else ():
                if spent + shortest[bool(notes)] + 1 > chars:
                    break
                if turn not in seen and spent + len(line) + 1 <= chars:
                    spent += len(line) + 1
                    kept.append((number, line))
            kept.sort()
            out.append((query, len(kept), total, "\n".join(x for _, x in kept)))
        return pd.DataFrame(out, columns=["query_id", "kept", "total", "text"])

    return asks.groupBy("scope", "cut").cogroup(told.groupBy("scope", "cut")).applyInPandas(run, f"query_id {dict(questions.dtypes)['query_id']}, kept int, total bigint, text string")


def timelines(questions: DataFrame, summaries: DataFrame, relevance: DataFrame, chars: int) -> DataFrame:
    """(query_id, lines, text): one line a session summary in a question's scope, oldest first, within ``chars``.

    ``questions``: query_id, scope; ``summaries``: mem_id, scope, created_at, said, content; ``relevance``: query_id, mem_id, score. Lines share the space, at most ``MOST_LINE``
    characters each; where that leaves fewer than ``LEAST_LINE``, the most relevant ``chars / LEAST_LINE`` keep that many. Sessions keep their numbers.
    """
    import pandas as pd

    n = F.count("*").over(Window.partitionBy("scope"))
    s = summaries.withColumn("session", F.row_number().over(Window.partitionBy("scope").orderBy("created_at", "mem_id"))).withColumn("n", n)
    few = s.withColumn("each", F.least(F.floor(F.lit(chars) / F.col("n")), F.lit(MOST_LINE)).cast("int"))
    size = F.greatest("each", F.lit(LEAST_LINE))
    body = F.when(F.length("content") > size, F.concat(F.substring(F.col("content"), F.lit(1), size), F.lit("…"))).otherwise(F.col("content"))
    line = F.concat(F.lit("- Session "), F.col("session").cast("string"), F.lit(" ["), F.coalesce("said", F.lit("date unknown")), F.lit("] "), body)
    few = few.select("scope", "mem_id", "session", "each", line.alias("line"))  # cut before the lines meet the questions
    keep = max(chars // LEAST_LINE, 1)
    tight = few.where(F.col("each") < LEAST_LINE)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("session", "line"))), lambda x: x["line"]), "\n").alias("text")
    roomy = questions.join(few.where(F.col("each") >= LEAST_LINE).groupBy("scope").agg(F.count("*").cast("int").alias("lines"), text), "scope")  # one text a scope
    chosen = questions.join(relevance, "query_id").join(tight.select("scope", "mem_id", "session"), ["scope", "mem_id"])
    chosen = chosen.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "mem_id"))).where(F.col("r") <= keep)
    chosen = chosen.groupBy("query_id", "scope").agg(F.sort_array(F.collect_list("session")).alias("sessions"))
    # numbers of sessions meet the lines of their scope: the lines move once for ``TOLD`` questions, not with each
    cuts = questions.groupBy("scope").agg(F.ceil(F.count("*") / TOLD).cast("int").alias("cuts"))
    asks = chosen.join(cuts, "scope").select("scope", F.pmod(F.xxhash64("query_id"), F.col("cuts")).cast("int").alias("cut"), "query_id", "sessions")
    told = tight.join(cuts, "scope").select("scope", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), "session", "line")
    asks, told = asks.toDF(*asks.columns), told.toDF(*told.columns)

    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        line = dict(zip(t["session"], t["line"]))
        return pd.DataFrame({"query_id": q["query_id"].reset_index(drop=True), "lines": pd.Series([len(x) for x in q["sessions"]], dtype="int32"), "text": pd.Series(["\n".join(line[n] for n in x) for x in q["sessions"]], dtype="object")})

    texts = asks.groupBy("scope", "cut").cogroup(told.groupBy("scope", "cut")).applyInPandas(run, f"query_id {dict(questions.dtypes)['query_id']}, lines int, text string")
    return texts.unionByName(roomy.select("query_id", "lines", "text"))


def topic_order(hits: DataFrame) -> DataFrame:
    """(query_id, position, mem_id) of grouped hits (query_id, rank, mem_id, topic_group, date_key, turn): groups by their best hit, inside them by date, turn (missing first) and rank."""
    best = F.min("rank").over(Window.partitionBy("query_id", "topic_group"))
    order = Window.partitionBy("query_id").orderBy("best", F.asc_nulls_first("date_key"), F.asc_nulls_first("turn"), "rank")
    return hits.withColumn("best", best).withColumn("position", F.row_number().over(order)).select("query_id", "position", "mem_id")


def source_excerpts(hits: DataFrame, evidence: DataFrame, excerpts: DataFrame, found: DataFrame, limit: int, least: float = 0.55) -> DataFrame:
    """(query_id, excerpt_id, score): the excerpts that the best memories were distilled from, 0.95 of the memory's score.

    ``hits``: query_id, mem_id, score, v; ``evidence``: mem_id, session_id; ``excerpts``: excerpt_id, session_id, turn_key, v; ``found``: query_id, excerpt_id, turn_key already shown.
    Each memory meets the excerpts of its own sessions only; one excerpt of a turn.
    """
    from mnemospark.functions.vectors import dot

    m = hits.select("mem_id", "v").distinct().join(evidence, "mem_id")
    e = excerpts.select("excerpt_id", "session_id", "turn_key", F.col("v").alias("w"))
    near = m.join(e, "session_id").select("mem_id", "excerpt_id", "turn_key", F.round(dot(F.col("v"), F.col("w")), 6).alias("similarity")).where(F.col("similarity") >= least)
    best = near.withColumn("n", F.row_number().over(Window.partitionBy("mem_id").orderBy(F.desc("similarity"), "excerpt_id"))).where("n = 1")
    out = hits.select("query_id", "mem_id", "score").join(best, "mem_id")
    out = out.join(found.select("query_id", "excerpt_id"), ["query_id", "excerpt_id"], "left_anti").join(found.select("query_id", "turn_key"), ["query_id", "turn_key"], "left_anti")
    once = Window.partitionBy("query_id", "turn_key").orderBy(F.desc("score"), "mem_id")
    out = out.withColumn("k", F.row_number().over(once)).where("k = 1")
    top = out.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "mem_id"))).where(F.col("n") <= limit)
    return top.select("query_id", "excerpt_id", F.round(F.col("score") * 0.95, 6).alias("score"))


def positions(memories: DataFrame, excerpts: DataFrame) -> DataFrame:
    """(mem_id, turn): the turn of the most similar excerpt in the session a memory was first said in (first of its evidence); ties to the earlier turn.

    ``memories``: mem_id, evidence, v; ``excerpts``: session_id, turn, v.
    """
    from mnemospark.functions.vectors import dot

    m = memories.select("mem_id", F.get("evidence", F.lit(0)).alias("session_id"), "v")
    near = m.join(excerpts.select("session_id", "turn", F.col("v").alias("w")), "session_id").select("mem_id", "turn", F.round(dot(F.col("v"), F.col("w")), 6).alias("s"))
    return near.groupBy("mem_id").agg(F.max(F.struct("s", (-F.col("turn")).alias("t"))).alias("x")).select("mem_id", (-F.col("x.t")).alias("turn"))


def request_key(request: Column, tag: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", request, tag), 256)


def replied(requests: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered, open): requests (request, tag, ...) with the reply kept for them, and those a model still has to answer, each once.

    ``replies``: key, reply, at; of several replies to one request the last counts.
    """
    last = replies.groupBy("key").agg(F.max_by("reply", "at").alias("reply"))
    keyed = requests.withColumn("key", request_key(F.col("request"), F.col("tag")))
    return keyed.join(last, "key"), keyed.join(last, "key", "left_anti").dropDuplicates(["key"]).select("key", "request", "tag")


def parsed_plan(reply: Column) -> Column:
    """struct<queries, after, before> of a planner's reply: at most four queries of 300 characters, blank ones and unreadable dates dropped; null if it is no JSON."""
    p = F.from_json(unfence(reply), "struct<queries: array<string>, after: string, before: string>")
    queries = F.slice(F.filter(F.transform(p["queries"], lambda q: F.substring(F.trim(q), 1, 300)), lambda q: q != ""), 1, 4)
    date = lambda d: F.when(date_start(d).isNotNull(), d)
    good = F.try_parse_json(unfence(reply)).isNotNull()
    return F.when(good, F.struct(F.coalesce(queries, F.array().cast("array<string>")).alias("queries"), date(p["after"]).alias("after"), date(p["before"]).alias("before")))


def embedding_text(title: Column, content: Column, prefix: str = "") -> Column:
    """What a model embeds of a memory: title and the first 2 000 characters."""
    return F.concat(F.lit(prefix), F.concat_ws("\n", title, F.substring(content, 1, 2000)))


def query_text(text: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.substring(text, 1, 1500))


def embedded(texts: DataFrame, embed, batch: int = 256) -> DataFrame:
    """(key, vector) of (key, text) by ``embed(list of at most ``batch`` texts)``, in Arrow batches; without a model no rows (search is by keyword then)."""
    if embed is None:
        return texts.select("key", F.lit(None).cast("array<float>").alias("vector")).limit(0)

    def run(frames):
        for f in frames:
            out = [v for i in range(0, len(f), batch) for v in embed(f["text"].iloc[i : i + batch].tolist())]
            yield pd.DataFrame({"key": f["key"].to_numpy(), "vector": out})

    return texts.select("key", "text").mapInPandas(run, f"key {dict(texts.dtypes)['key']}, vector array<float>")
