"""Queries over extraction, contradictions, logs and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.functions.lists import DERIVED_TYPES, INTENT_CUES
from mnemospark.operators import extraction, logs, triggers
from mnemospark.plans.lineage import written
from mnemospark.plans.registry import EVL, MEM, QRY, SQL, TRN, query, quoted
from mnemospark.plans.retrieval_queries import ELIGIBLE, KEYWORD_SQL, _kinds, asked_with, best_of, j17_contradictions, j8_semantic_recall, o1_topic_groups, r7_turn_recall, searched
from mnemospark.plans.text_queries import memories, questions, turns
from mnemospark.sources.tables import latest, latest_texts, table


def evaluated(spark, d, *columns):
    return latest(table(spark, d, "eval_rows"), "row_id", "arrived_at", "row_id", *columns)


@query(f"WITH {MEM} SELECT mem_id, list_sort(list_distinct([t for t in coalesce(topics, []) if contains(lower(content), lower(trim(t))) AND trim(t) <> ''])) AS grounded FROM mem")
def f17_grounded_entities(spark, d):
    """Topics of a memory that its text names."""
    none = F.array().cast("array<string>")
    return memories(spark, d, "topics", "content").select("mem_id", F.array_sort(triggers.grounded_entities(F.coalesce("topics", none), F.col("content"))).alias("grounded"))


@query(
    f"WITH {MEM}, f AS (SELECT lower(mem_scope) AS scope, status IN ({quoted(ELIGIBLE[0])}) AS live, coalesce(mem_type, '') IN ({quoted(DERIVED_TYPES)}) AS derived, coalesce(mem_type, '') IN ('rule', 'episode', 'timeline') AS other FROM mem) "
    "SELECT scope, count(*) FILTER (live AND NOT derived)::BIGINT AS members, count(*) FILTER (live AND NOT derived AND NOT other)::BIGINT AS eligible FROM f GROUP BY 1"
)
def f26_eligible(spark, d):
    """Memories that reflections may use, and that contradictions may concern, per scope."""
    live, kind = F.col("status").isin(*ELIGIBLE[0]), F.coalesce("mem_type", F.lit(""))
    member = live & ~kind.isin(DERIVED_TYPES)
    return memories(spark, d, "mem_scope", "mem_type", "status").groupBy(F.lower("mem_scope").alias("scope")).agg(
        F.count_if(member).alias("members"), F.count_if(member & ~kind.isin("rule", "episode", "timeline")).alias("eligible")
    )


@query(f"WITH {QRY} SELECT query_id, least(coalesce(len(expected), 0), 40)::INT AS parsed FROM qry")
def f27_parsed_proposals(spark, d):
    """Replies with one good proposal for each expected memory, and a number, a text and a proposal without an action among them."""
    good = F.transform(F.coalesce("expected", F.array().cast("array<string>")), lambda m: F.concat(F.lit('{"action":"mention","id":"'), m, F.lit('"}')))
    reply = F.concat(F.lit("["), F.array_join(F.concat(F.array(F.lit("7"), F.lit('{"id":"x"}'), F.lit('"z"')), good), ","), F.lit("]"))
    return questions(spark, d, "expected").select("query_id", F.size(extraction.parsed_proposals(reply)).alias("parsed"))


@query(
    f"WITH {TRN}, {EVL}, j AS (SELECT turn_id, kept_tokens AS actual, ceil(length(text) / 4.0) AS t, ceil(length(coalesce(note, '')) / 4.0) AS n, ceil(length(coalesce(outline, '')) / 4.0) AS o FROM trn JOIN evl ON turn_id = row_id WHERE kept_tokens BETWEEN 0 AND 1000000) "
    "SELECT turn_id, round(actual * t / (t + n + o), 6)::DOUBLE AS text_tokens, round(actual * n / (t + n + o), 6)::DOUBLE AS note_tokens, round(t / (t + n + o), 6)::DOUBLE AS text_share FROM j WHERE t + n + o > 0"
)
def j4_usage_attribution(spark, d):
    """Events joined with their usage: the tokens counted for a step, split over its parts by estimated size."""
    size = lambda c: F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4)
    t = turns(spark, d, "text", "note", "outline").select("turn_id", size("text").alias("t"), size("note").alias("n"), size("outline").alias("o"))
    u = evaluated(spark, d, "kept_tokens").where("kept_tokens between 0 and 1000000").select(F.col("row_id").alias("turn_id"), "kept_tokens")
    all_ = F.col("t") + F.col("n") + F.col("o")
    j = t.join(u, "turn_id").where(all_ > 0)
    return j.select("turn_id", F.round(F.col("kept_tokens") * F.col("t") / all_, 6).alias("text_tokens"), F.round(F.col("kept_tokens") * F.col("n") / all_, 6).alias("note_tokens"), F.round(F.col("t") / all_, 6).alias("text_share"))


@query(f"WITH {MEM}, t AS (SELECT lower(mem_scope) AS scope, unnest(list_distinct(topics)) AS topic, substr(created_at, 1, 10) AS said FROM mem) SELECT scope, topic, max(said) AS observed_at, count(*)::BIGINT AS members FROM t GROUP BY ALL")
def a17_latest_observation(spark, d):
    t = memories(spark, d, "mem_scope", "topics", "created_at").select(F.lower("mem_scope").alias("scope"), F.explode(F.array_distinct("topics")).alias("topic"), F.substring("created_at", 1, 10).alias("said"))
    return t.groupBy("scope", "topic").agg(F.max("said").alias("observed_at"), F.count("*").alias("members"))


@query(
    f"WITH {EVL} SELECT coalesce(question_type, '-') AS kind, count(DISTINCT run_id)::BIGINT AS runs, count(*)::BIGINT AS cases, count(*) FILTER (score >= 1)::BIGINT AS applied, round(avg((coalesce(score, 0) >= 1)::INT), 6) AS apply_rate, "
    "count(*) FILTER (coalesce(error, '') <> '')::BIGINT AS failures FROM evl GROUP BY 1"
)
def a31_applied_by_kind(spark, d):
    e = evaluated(spark, d, "question_type", "run_id", "score", "error")
    return e.groupBy(F.coalesce("question_type", F.lit("-")).alias("kind")).agg(
        F.count_distinct("run_id").alias("runs"), F.count("*").alias("cases"), F.count_if(F.col("score") >= 1).alias("applied"),
        F.round(F.avg((F.coalesce("score", F.lit(0.0)) >= 1).cast("int")), 6).alias("apply_rate"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("failures"),
    )


@query(f"WITH {TRN} SELECT session_id, epoch_us(max(ingested_at))::BIGINT AS last_seen, count(*)::BIGINT AS messages FROM trn GROUP BY 1 ORDER BY last_seen DESC, session_id LIMIT 100")
def t9_latest_sessions(spark, d):
    s = turns(spark, d, "session_id", "ingested_at").groupBy("session_id").agg(F.max("ingested_at").alias("t"), F.count("*").alias("messages"))
    return s.orderBy(F.desc("t"), "session_id").limit(100).select("session_id", F.unix_micros(F.col("t").cast("timestamp")).alias("last_seen"), "messages")


@query(
    f"WITH {MEM}, s AS (SELECT mem_id, coalesce(topics, []) AS mine, supersedes[1] AS prev FROM mem WHERE len(supersedes) > 0) "
    "SELECT s.mem_id, list_sort(list_distinct(list_concat(mine, coalesce(m.topics, [])))) AS topics FROM s JOIN mem m ON s.prev = m.mem_id"
)
def u6_merged_topics(spark, d):
    """Topics of a memory and of the one it replaced, once each."""
    none = F.array().cast("array<string>")
    m = memories(spark, d, "topics", "supersedes")
    s = m.where(F.size("supersedes") > 0).select("mem_id", F.coalesce("topics", none).alias("mine"), F.get("supersedes", F.lit(0)).alias("prev"))
    o = m.select(F.col("mem_id").alias("prev"), F.coalesce("topics", none).alias("old"))
    return s.join(o, "prev").select("mem_id", F.array_sort(F.array_union("mine", "old")).alias("topics"))


@query(
    f"WITH {TRN}, n AS (SELECT session_id, arg_max(note, (turn_no, turn_id)) AS note FROM trn WHERE note IS NOT NULL GROUP BY 1) SELECT session_id, substr(note, 1, 700) AS summary, length(note) > 700 AS cut FROM n"
)
def c6_session_summaries(spark, d):
    """One summary a session, the latest note, at most 700 characters."""
    n = turns(spark, d, "session_id", "turn_no", "note").where("note is not null").groupBy("session_id").agg(F.max(F.struct("turn_no", "turn_id", "note")).alias("x"))
    return n.select("session_id", F.substring("x.note", 1, 700).alias("summary"), (F.length("x.note") > 700).alias("cut"))


@query(f"WITH {TRN} SELECT turn_id, 'tu_' || turn_id AS name, coalesce(note, outline) AS reply, md5(text) AS document FROM trn")
def x28_turn_helpers(spark, d):
    """A turn's name, its reply (note, else outline) and the indexed document: the user's message only."""
    return turns(spark, d, "text", "note", "outline").select("turn_id", F.concat(F.lit("tu_"), F.col("turn_id").cast("string")).alias("name"), F.coalesce("note", "outline").alias("reply"), F.md5("text").alias("document"))


@query(f"WITH {MEM} SELECT mem_id, md5('passage: ' || concat_ws(chr(10), title, substr(content, 1, 2000))) AS document FROM mem")
def s30_embedding_texts(spark, d):
    return memories(spark, d, "title", "content").select("mem_id", F.md5(logs.embedding_text(F.col("title"), F.col("content"), "passage: ")).alias("document"))


@query(
    f"WITH {TRN}, n AS (SELECT session_id, turn_id, text, ceil(length(text) / 4.0)::BIGINT AS tokens, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM trn WINDOW w AS (PARTITION BY session_id ORDER BY turn_no, turn_id)) "
    "SELECT session_id, turn_id, '[evicted ' || substr(sha256(text), 1, 16) || ', ' || tokens || ' tokens]' AS placeholder FROM n WHERE i + 8 < n AND tokens >= 100"
)
def c17_placeholders(spark, d):
    """What stands for evicted messages: keyed by their content, so a repeated one keeps its placeholder."""
    w = Window.partitionBy("session_id")
    t = turns(spark, d, "session_id", "turn_no", "text").withColumn("i", F.row_number().over(w.orderBy("turn_no", "turn_id")) - 1).withColumn("n", F.count("*").over(w)).withColumn("tokens", F.ceil(F.length("text") / 4))
    mark = F.concat(F.lit("[evicted "), F.substring(F.sha2("text", 256), 1, 16), F.lit(", "), F.col("tokens").cast("string"), F.lit(" tokens]"))
    return t.where((F.col("i") + 8 < F.col("n")) & (F.col("tokens") >= 100)).select("session_id", "turn_id", mark.alias("placeholder"))


@query(
    f"WITH j AS ({SQL['j17_contradictions']}), p AS (SELECT *, CASE WHEN similarity >= 0.3 THEN 'conflict' ELSE 'update' END AS verdict FROM j), {MEM}, v AS (SELECT first_id, second_id, verdict, negative, a.source AS fs, a.status AS fst, b.source AS ss, b.status AS sst FROM p JOIN mem a ON a.mem_id = first_id JOIN mem b ON b.mem_id = second_id), "
    "c AS (SELECT * FROM v WHERE verdict = 'conflict' AND negative), l AS (SELECT first_id AS mem_id, fs AS source, fst AS was, second_id AS other FROM c UNION ALL SELECT second_id, ss, sst, first_id FROM c), "
    "k AS (SELECT mem_id, max(CASE WHEN source = 'user' THEN was ELSE 'contested' END) AS status, array_to_string(list_sort(list_distinct(list(other))), ' ') AS conflicts, NULL::VARCHAR AS superseded_by FROM l GROUP BY 1), "
    "u AS (SELECT first_id AS mem_id, second_id FROM v WHERE NOT (verdict = 'conflict' AND negative) AND coalesce(fs, '') <> 'user' AND fst = 'active' AND sst = 'active' AND NOT negative AND first_id NOT IN (SELECT mem_id FROM k) AND second_id NOT IN (SELECT mem_id FROM k)) "
    "SELECT * FROM k UNION ALL SELECT mem_id, 'superseded', '', min(second_id) FROM u GROUP BY 1"
)
def c10_contradiction_outcomes(spark, d):
    """What judged pairs change; the verdict table is a rule here (similar ones conflict), as models are inputs."""
    p = j17_contradictions(spark, d)
    v = p.select("first_id", "second_id", F.when(F.col("similarity") >= 0.3, "conflict").otherwise("update").alias("verdict"))
    out = extraction.contradiction_outcome(p, v, memories(spark, d, "source", "status", "content"))
    return out.select("mem_id", "status", F.array_join("conflicts_with", " ").alias("conflicts"), "superseded_by")


TIMELINE_CHARS = 6000


@query(
    f"WITH {KEYWORD_SQL}, s AS (SELECT mem_id, lower(mem_scope) AS scope, substr(created_at, 1, 10) AS said, content, row_number() OVER (PARTITION BY lower(mem_scope) ORDER BY created_at, mem_id) AS session, count(*) OVER (PARTITION BY lower(mem_scope)) AS n "
    f"FROM mem WHERE mem_type IN ('fact', 'summary') AND status IN ('active', 'contested')), e AS (SELECT *, least(6000 // n, 400) AS each FROM s), q AS (SELECT query_id, coalesce(lower(project), 'global') AS scope FROM qry), "
    "r AS (SELECT query_id, session, said, content, each FROM q JOIN e USING (scope) WHERE each >= 140 UNION ALL SELECT query_id, session, said, content, 140 FROM (SELECT q.query_id, e.*, row_number() OVER (PARTITION BY q.query_id ORDER BY round(kw.keyword, 6) DESC, e.mem_id) AS k "
    "FROM q JOIN e USING (scope) JOIN kw ON kw.query_id = q.query_id AND kw.mem_id = e.mem_id WHERE each < 140) WHERE k <= 42), "
    "l AS (SELECT query_id, session, '- Session ' || session || ' [' || coalesce(said, 'date unknown') || '] ' || CASE WHEN length(content) > each THEN substr(content, 1, each::INT) || '…' ELSE content END AS line FROM r) "
    "SELECT query_id, count(*)::INT AS lines, md5(string_agg(line, chr(10) ORDER BY session)) AS text FROM l GROUP BY 1"
)
def w14_timelines(spark, d):
    """The timeline of every question's scope; facts serve as session summaries beside the few that there are."""
    q = questions(spark, d, "project").select("query_id", F.coalesce(F.lower("project"), F.lit("global")).alias("scope"))
    s = memories(spark, d, "mem_scope", "mem_type", "status", "created_at", "content").where("mem_type in ('fact', 'summary') and status in ('active', 'contested')")
    s = s.select("mem_id", F.lower("mem_scope").alias("scope"), "created_at", F.substring("created_at", 1, 10).alias("said"), "content")
    # only scopes with too many sessions for all of them choose by relevance
    tight = s.groupBy("scope").count().where(F.floor(F.lit(TIMELINE_CHARS) / F.col("count")) < logs.LEAST_LINE).select("scope")
    asked = asked_with(spark, d).withColumn("scope", F.coalesce(F.lower("project"), F.lit("global"))).join(tight, "scope", "left_semi").drop("scope")
    near = searched(spark, d, of_timeline, "mem_id string, keyword double", asked).withColumnRenamed("keyword", "score")
    return logs.timelines(q, s, near, TIMELINE_CHARS).select("query_id", "lines", F.md5("text").alias("text"))


def of_timeline(q, number, k, docs, place):
    """The best sessions of the question's own scope, as many as a tight timeline has lines."""
    import numpy as np

    m = _kinds(docs)
    if "session" not in m:
        m["session"] = m["live"] & np.isin(m["kind"].astype(str), ("fact", "summary"))
    good = m["session"][number] & (number >= q["own"].start) & (number < q["own"].stop)
    return best_of(max(TIMELINE_CHARS // logs.LEAST_LINE, 1))(q, number[good], k[good], docs, place)


@query()
def w15_message_logs(spark, d):
    """The user's messages for each question within 4 000 characters: the most relevant, or the whole record of questions about how things went."""
    q = latest_texts(table(spark, d, "queries"), "query_id", "added_at", "query_id", "project", "query").where("project is not null")
    cue = lambda n: T.has_cue(F.col("query"), INTENT_CUES[n])
    q = q.select(
        "query_id", F.lower("project").alias("scope"), (cue("overview") | cue("mention_order") | cue("aggregate")).alias("whole"),
        (cue("conversation") | (cue("overview") & ~cue("aggregate") & ~cue("mention_order"))).alias("notes"),
    )
    q = written(q, "questions")  # read again and again
    ranked = r7_turn_recall(spark, d).join(q.select("query_id"), "query_id", "left_semi").select("query_id", F.lit(0).alias("ranking"), F.col("rank").alias("place"), "turn_id")
    number = F.row_number().over(Window.partitionBy(F.lower("project")).orderBy("session_id", "turn_no", "turn_id"))
    raw = table(spark, d, "turns")
    # texts stay where they are: the number of a turn needs none
    t = latest_texts(raw, "turn_id", "ingested_at", "turn_id", "project", "session_id", "turn_no", "observed_at", "text", "note", "outline").where("project is not null")
    texts = t.select("turn_id", F.col("observed_at").alias("said"), "text", F.coalesce("note", "outline").alias("note"))
    t = t.select("turn_id", "project", "session_id", "turn_no", F.coalesce(F.col("text") != "", F.lit(False)).alias("full"))
    t = written(t.select("turn_id", F.lower("project").alias("scope"), number.alias("number"), "full"), "numbers")
    return logs.message_log(q, ranked, t, 4000, texts)


@query()
def w5_topic_order(spark, d):
    """Each question's nearest memories by topic group, chronological inside a group."""
    rank = j8_semantic_recall(spark, d).select("query_id", "mem_id", "rank")
    m = memories(spark, d, "created_at").select("mem_id", T.date_key(F.col("created_at")).alias("date_key"), F.lit(None).cast("int").alias("turn"))
    return logs.topic_order(o1_topic_groups(spark, d).join(rank, ["query_id", "mem_id"]).join(m, "mem_id"))


@query()
def c1_transcripts(spark, d):
    """Every session as one numbered transcript of at most 30 000 characters."""
    t = turns(spark, d, "session_id", "turn_no", "text", "outline")
    both = F.array(F.struct(F.lit(0).alias("half"), F.lit("user").alias("role"), F.col("text").alias("text")), F.struct(F.lit(1).alias("half"), F.lit("assistant").alias("role"), F.col("outline").alias("text")))
    m = t.select("session_id", "turn_no", "turn_id", F.explode(both).alias("x")).select("session_id", F.struct("turn_no", "turn_id", "x.half").alias("o"), "x.role", "x.text")
    m = m.withColumn("seq", F.row_number().over(Window.partitionBy("session_id").orderBy("o"))).withColumn("call", F.lit(None).cast("string"))
    return extraction.transcripts(m).select("session_id", F.length("transcript").alias("characters"), F.md5("transcript").alias("transcript"))


STAGE = (
    "CASE WHEN kept_items IS NULL OR kept_items = 0 OR (kept_items < 5 AND coalesce(kept_tokens, 0) < 500) THEN 'material' WHEN coalesce(kept_tokens, 0) < 500 THEN 'brief' WHEN coalesce(score, 0) < 1 THEN 'answer' ELSE 'judge' END"
)


@query(f"WITH {EVL} SELECT coalesce(question_type, '-') AS ability, {STAGE} AS stage, count(*)::BIGINT AS cases FROM evl GROUP BY ALL")
def e5_stages(spark, d):
    """Where a case was lost: material (none, or partial with a partial brief), brief, answer or judge; by ability. Sizes stand for the verdicts here."""
    e = evaluated(spark, d, "question_type", "kept_items", "kept_tokens", "score")
    return e.groupBy(F.coalesce("question_type", F.lit("-")).alias("ability"), F.expr(STAGE).alias("stage")).agg(F.count("*").alias("cases"))


@query(f"WITH {EVL} SELECT question_id, count(*)::BIGINT AS items, round(avg(CASE WHEN score >= 0.75 THEN 1 WHEN score >= 0.25 THEN 0.5 ELSE 0 END), 6)::DOUBLE AS rubric FROM evl WHERE question_id IS NOT NULL GROUP BY 1")
def e8_rubric_means(spark, d):
    """Mean of a question's rubric items, each 1, one half or 0."""
    level = F.when(F.col("score") >= 0.75, 1.0).when(F.col("score") >= 0.25, 0.5).otherwise(0.0)
    return evaluated(spark, d, "question_id", "score").where("question_id is not null").groupBy("question_id").agg(F.count("*").alias("items"), F.round(F.avg(level), 6).alias("rubric"))


@query(
    f"WITH {EVL}, p AS (SELECT coalesce(project, '-') AS project, count(*) AS n, count(*) FILTER (score >= 1) AS k FROM evl GROUP BY 1) SELECT project, k || '/' || n AS fraction, round(100.0 * k / n, 1)::DOUBLE AS percent FROM p"
)
def e12_report(spark, d):
    """A report's rows: successes as a fraction and in percent, per project."""
    p = evaluated(spark, d, "project", "score").groupBy(F.coalesce("project", F.lit("-")).alias("project")).agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 1).alias("k"))
    return p.select("project", F.concat_ws("/", F.col("k").cast("string"), F.col("n").cast("string")).alias("fraction"), F.round(100.0 * F.col("k") / F.col("n"), 1).alias("percent"))


@query(
    f"WITH {QRY}, q AS (SELECT query_id, category, md5(query_id || '-9') AS h, coalesce(len(expected), 0) = 0 AS abstain FROM qry), t AS (SELECT count(DISTINCT category) AS n FROM q WHERE NOT abstain), "
    "a AS (SELECT query_id FROM q WHERE abstain ORDER BY h, query_id LIMIT 30), r AS (SELECT query_id, category, h, row_number() OVER (PARTITION BY category ORDER BY h, query_id) AS k FROM q WHERE NOT abstain), "
    "e AS (SELECT query_id FROM r, t WHERE k <= (200 - 30) // t.n), f AS (SELECT query_id FROM r ANTI JOIN e USING (query_id) WHERE category IN (SELECT category FROM q WHERE category IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 2) "
    "ORDER BY h, query_id LIMIT (SELECT 200 - (SELECT count(*) FROM a) - (SELECT count(*) FROM e))) SELECT query_id, 'abstention' AS part FROM a UNION ALL SELECT query_id, 'type' FROM e UNION ALL SELECT query_id, 'fill' FROM f"
)
def e1_sample_of_200(spark, d):
    """A sample of 200 questions (a sampling operator): 15 % without an answer, the same number of each type, filled up from the two most frequent types."""
    q = questions(spark, d, "category", "expected").select("query_id", "category", F.md5(F.concat("query_id", F.lit("-9"))).alias("h"), (F.coalesce(F.size("expected"), F.lit(0)) <= 0).alias("abstain"))
    regular = q.where("not abstain")
    types = regular.where("category is not null").select("category").distinct().count()
    a = q.where("abstain").orderBy("h", "query_id").limit(30).select("query_id", F.lit("abstention").alias("part"))
    r = regular.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy("h", "query_id")))
    e = r.where(F.col("k") <= 170 // max(types, 1)).select("query_id", F.lit("type").alias("part"))
    frequent = q.where("category is not null").groupBy("category").count().orderBy(F.desc("count"), "category").limit(2).select("category")
    left = max(200 - a.count() - e.count(), 0)
    f = r.join(e.select("query_id"), "query_id", "left_anti").join(F.broadcast(frequent), "category", "left_semi").orderBy("h", "query_id").limit(left).select("query_id", F.lit("fill").alias("part"))
    return a.unionByName(e).unionByName(f)
