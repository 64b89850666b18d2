"""Queries over composite operators: triggers, planned search, packing, chains, excerpts, proposals, sealed events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators import blocking, classifier, consolidation, dossiers, excerpts, index, planned, retrieval, triggers
from mnemospark.plans.registry import MEM, QRY, TRN, query
from mnemospark.plans.retrieval_queries import first_rows, fused, j8_semantic_recall, searched_with_vectors, unit_vectors, without_own
from mnemospark.plans.text_queries import memories, questions, turns
from mnemospark.sources.events import opened, sealed
from mnemospark.sources.tables import table


@query(
    f"WITH {MEM}, {TRN}, t AS (SELECT DISTINCT lower(mem_scope) AS scope, mem_id, unnest(topics) AS topic FROM mem WHERE mem_type IN ('rule', 'instruction', 'lesson')), "
    "s AS (SELECT turn_id, lower(text) AS x, unnest(CASE WHEN project IS NULL THEN ['global'] ELSE list_distinct(['global', lower(project)]) END) AS scope FROM trn) "
    "SELECT turn_id, mem_id, topic AS trigger_id FROM s JOIN t USING (scope) WHERE contains(x, topic)"
)
def j9_fired_triggers(spark, d):
    """Topics of rules, instructions and lessons as keyword triggers against all turns, scope by scope."""
    m = memories(spark, d, "mem_scope", "mem_type", "topics").where(F.col("mem_type").isin("rule", "instruction", "lesson"))
    make = lambda t: F.struct(t.alias("id"), F.lit("keyword").alias("kind"), t.alias("pattern"), F.lit(False).alias("disabled"), F.lit(False).alias("before_action"))
    m = m.select("mem_id", F.col("mem_scope").alias("scope"), F.transform(F.array_distinct("topics"), make).alias("triggers"))
    none = F.lit(None).cast("string")
    s = turns(spark, d, "project", "text").select(F.col("turn_id").alias("step_id"), "project", F.col("text").alias("user_text"), none.alias("args"), none.alias("error_sig"), none.alias("tool"), F.array().cast("array<string>").alias("files"))
    return triggers.fired(s, m).select(F.col("step_id").alias("turn_id"), "mem_id", "trigger_id")


@query(
    f"WITH {MEM}, {QRY}, t AS (SELECT DISTINCT unnest(topics) AS topic FROM mem) SELECT query_id, topic FROM qry JOIN t ON regexp_matches(lower(query), '(^|[^\\p{{L}}\\p{{N}}])' || lower(topic) || '($|[^\\p{{L}}\\p{{N}}])')"
)
def j10_named_entities(spark, d):
    t = memories(spark, d, "topics").select(F.explode("topics").alias("topic")).distinct()
    return blocking.naming(questions(spark, d, "query"), "query_id", "query", t, "topic")


@query(
    f"WITH {MEM}, p AS (SELECT lower(mem_scope) AS scope, supersedes[1] AS old, mem_id AS new, content FROM mem WHERE len(supersedes) > 0) "
    "SELECT mem_id, lower(mem_scope) AS scope, CASE WHEN mem_id IN (SELECT old FROM p WHERE p.scope = lower(mem.mem_scope)) THEN 'superseded' ELSE status END AS status FROM mem"
)
def c2_proposals(spark, d):
    """Each memory that replaces another as an ordered proposal against the store."""
    m = memories(spark, d, "mem_scope", "content", "status", "supersedes")
    store = m.select("mem_id", F.lower("mem_scope").alias("scope"), "content", "status", F.lit(0).cast("bigint").alias("mentions"))
    w = Window.partitionBy(F.lower("mem_scope")).orderBy("mem_id")
    p = m.where(F.size("supersedes") > 0).select(F.lower("mem_scope").alias("scope"), F.row_number().over(w).alias("seq"), F.lit("supersede").alias("action"), F.get("supersedes", F.lit(0)).alias("mem_id"), "content")
    return consolidation.apply_proposals(store, p).where(~F.col("mem_id").contains("+")).select("mem_id", "scope", "status")


@query(
    f"WITH RECURSIVE {TRN}, c AS (SELECT session_id, turn_id, length(text) AS size, row_number() OVER (PARTITION BY session_id ORDER BY turn_no, turn_id) AS n FROM trn), "
    "f AS (SELECT session_id, n, turn_id, 1 AS part, size AS used FROM c WHERE n = 1 UNION ALL "
    "SELECT c.session_id, c.n, c.turn_id, CASE WHEN f.used + c.size <= 2000 THEN f.part ELSE f.part + 1 END, CASE WHEN f.used + c.size <= 2000 THEN f.used + c.size ELSE c.size END FROM f JOIN c ON c.session_id = f.session_id AND c.n = f.n + 1) "
    "SELECT session_id, turn_id, part::INT AS part FROM f"
)
def e3_cut_sessions(spark, d):
    """Sessions cut at turns so that a part has at most 2 000 characters; a running sum that starts again, so a fold per session."""
    entry = F.struct("turn_no", "turn_id", F.length("text").alias("size"))
    lists = turns(spark, d, "session_id", "turn_no", "text").groupBy("session_id").agg(F.sort_array(F.collect_list(entry)).alias("l"))
    start = F.struct(F.lit(0).alias("used"), F.lit(1).alias("part"), F.array().cast("array<int>").alias("parts"))

    def step(acc, x):
        fits = (acc["used"] + x["size"] <= 2000) | (F.size(acc["parts"]) == 0)
        part = F.when(fits, acc["part"]).otherwise(acc["part"] + 1)
        return F.struct(F.when(fits, acc["used"] + x["size"]).otherwise(x["size"]).alias("used"), part.alias("part"), F.concat(acc["parts"], F.array(part)).alias("parts"))

    folded = lists.select("session_id", "l", F.aggregate("l", start, step).getField("parts").alias("parts"))
    return folded.select("session_id", F.explode(F.arrays_zip("l", "parts")).alias("x")).select("session_id", F.col("x.l.turn_id").alias("turn_id"), F.col("x.parts").alias("part"))


@query("SELECT event_id, true AS same, length(props)::INT AS chars FROM events")
def m7_sealed_payloads(spark, d):
    """Payloads sealed with AES-GCM under random nonces and opened again."""
    key = F.lit(bytearray(range(32)))
    e = table(spark, d, "events").select("event_id", "props", opened(sealed(F.col("props"), key), key).alias("back"))
    return e.select("event_id", (F.col("back") == F.col("props")).alias("same"), F.length("back").alias("chars"))


@query()
def x18_session_excerpts(spark, d):
    """Turns with their notes as replies, cut to excerpts per session."""
    t = turns(spark, d, "session_id", "turn_no", "text", "note")
    said = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("text"), (F.col("turn_no") * 2).alias("n")), F.struct(F.lit("assistant").alias("role"), F.col("note").alias("text"), (F.col("turn_no") * 2 + 1).alias("n")))
    e = t.select("session_id", F.explode(said).alias("x")).where("x.text is not null").select("session_id", F.col("x.n").alias("turn_no"), "x.role", "x.text")
    return excerpts.session_excerpts(e)


@query()
def x21_outlines(spark, d):
    @F.pandas_udf("string")
    def outlined(text: pd.Series) -> pd.Series:
        return text.map(excerpts.outline)

    return turns(spark, d, "text").select("turn_id", outlined("text").alias("outline"))


@query()
def r13_packed_results(spark, d):
    """Hybrid results with the questions' excerpts, packed into 300 tokens each."""
    kind = F.when(F.col("mem_type") == "rule", "leading").when(F.col("mem_type") == "summary", "excerpt").otherwise("memory")
    more = T.estimated_tokens(F.col("content")).cast("bigint").alias("tokens"), kind.alias("kind")  # known where the candidates are
    hits = searched_with_vectors(spark, d, fused_with_sizes, "mem_id string, score double, reason int, kind string, tokens bigint", *more)
    return planned.packed(first_rows(hits, 10, "score").select(F.col("query_id").alias("question_id"), "rank", F.col("mem_id").alias("id"), "kind", "tokens"), 300)


def fused_with_sizes(q, number, k, docs, place):
    got = fused(q, number, k, docs, place)
    return [*got, docs["kind"][got[0]], docs["tokens"][got[0]]]


@query()
def r15_planned_search(spark, d):
    """Two queries per question, keyword and semantic, with the month before the question as the plan's window."""
    hits = searched_with_vectors(spark, d, either_way, "mem_id string, query_no int, score double, date string", F.substring("created_at", 1, 10).alias("date"))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "mem_id"))
    hits = hits.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("query_no") == 0, 3).otherwise(5)).drop("rank").withColumnRenamed("query_id", "question_id")
    day = lambda n: F.date_format(F.date_sub(F.to_date("added_at"), n), "yyyy-MM-dd")
    plans = questions(spark, d, "added_at").select(F.col("query_id").alias("question_id"), day(30).alias("after"), day(0).alias("before"))
    return planned.planned(hits, plans, 4)


def either_way(q, number, k, docs, place):
    """The three best by keyword (query 0) and the five nearest (query 1)."""
    import numpy as np

    one = index.leading(number, k, place, 3)
    number, k, no = number[one], k[one], np.zeros(len(one), np.int32)
    if "semantic" in q:
        cosine = without_own(q, docs)
        good = cosine >= 0.25
        near, s = np.repeat(q["near"][good], q["times"][good]), np.repeat(np.floor(cosine[good] * 1e6 + 0.5) / 1e6, q["times"][good])
        five = index.leading(near, s, place, 5)
        number, k, no = np.r_[number, near[five]], np.r_[k, s[five]], np.r_[no, np.ones(len(five), np.int32)]
    return [number, no, k, docs["date"][number]]


@query()
def r9_time_chains(spark, d):
    """Chains of near statements with different numbers among each question's semantic hits, oldest first."""
    v = unit_vectors(spark, d, "memory").select(F.col("owner_id").alias("mem_id"), "u")
    m = memories(spark, d, "content", "created_at").select("mem_id", T.number_key(F.col("content")).alias("numbers"), T.date_key(F.col("created_at")).alias("said"))
    return retrieval.time_chains(j8_semantic_recall(spark, d).join(v, "mem_id").join(m, "mem_id"), 0.82)


@query()
def a10_value_histories(spark, d):
    """Order status per customer and priority as named values over time: the current one and what it was before."""
    o = table(spark, d, "orders")
    r = o.select(
        F.col("o_orderpriority").alias("scope"), F.lit("orders").alias("topic"), F.col("o_custkey").cast("string").alias("name"), F.col("o_orderstatus").alias("value"),
        F.struct("o_orderdate", "o_orderkey").alias("turn"),
    )
    return dossiers.value_histories(r)


@query()
def c18_gate_classifier(spark, d):
    """Hashed-feature classifier of turns that got a note, trained on the newest samples in time order."""
    t = turns(spark, d, "text", "note").orderBy(F.desc("turn_id")).limit(classifier.SAMPLES).select("turn_id", "text", F.col("note").isNotNull().alias("y")).orderBy("turn_id")
    model = classifier.trained([(classifier.slots({"text": r["text"]}), r["y"]) for r in t.toLocalIterator()])
    rows = list(enumerate(model["weights"])) if model else []
    return spark.createDataFrame([(i, float(w)) for i, w in rows], "slot int, weight double")
