"""Queries over the assembled search and what follows it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.functions.lists import DERIVED_TYPES, INTENT_CUES, NEGATION_CUES, YES_NO_STARTS
from mnemospark.operators import assembled, blocking, index, retrieval
from mnemospark.plans.lineage import written
from mnemospark.plans.registry import MEM, QRY, TRN, query, quoted
from mnemospark.plans.retrieval_queries import KEYWORD_SQL, SCOPES, SEMANTIC_SQL, UNIT, VEC, _kinds, _scopes, asked_with, searched, semantic_sides, unit_vectors
from mnemospark.plans.text_queries import APOSTROPHE, _cue_sql, memories, questions, turns
from mnemospark.sources.tables import table

NAMED = "CASE WHEN contains(lower(query), lower(topic)) THEN regexp_matches(lower(query), '(^|[^\\p{L}\\p{N}])' || lower(topic) || '($|[^\\p{L}\\p{N}])') ELSE false END"
RANKED_SQL = f"""{KEYWORD_SQL}, i AS (SELECT query_id, query, {_cue_sql('query', INTENT_CUES['temporal'])} AS tmp, {_cue_sql('query', INTENT_CUES['aggregate'])} AS agg FROM qry),
f AS (SELECT query_id, mem_id, round(keyword, 6) AS k, mem_type, status, tmp, agg FROM kw JOIN i USING (query_id) JOIN mem USING (mem_id)
  WHERE coalesce(mem_type, '') NOT IN ('summary', 'rule') AND (status IN ('active', 'contested') OR tmp AND status = 'superseded')),
ins AS (SELECT query_id, mem_id, row_number() OVER (PARTITION BY query_id ORDER BY k DESC, mem_id) AS n FROM f WHERE mem_type = 'instruction' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k DESC, mem_id) <= 10),
pool AS (SELECT query_id, mem_id, k * CASE WHEN status = 'superseded' THEN 0.9 ELSE 1 END AS score, 'search' AS channel FROM f WHERE k >= 0.3
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k DESC, mem_id) <= CASE WHEN agg THEN 96 ELSE 48 END),
mt AS (SELECT mem_id, lower(mem_scope) AS scope, mem_type, status, created_at, unnest(list_distinct(topics)) AS topic FROM mem WHERE coalesce(mem_type, '') NOT IN ('summary', 'rule')),
ask2 AS (SELECT query_id, query, project, tmp FROM i JOIN qry USING (query_id, query)), qs2 AS (SELECT query_id, query, tmp, {SCOPES} FROM ask2),
en AS (SELECT DISTINCT query_id, mem_id, created_at FROM qs2 JOIN mt USING (scope) WHERE length(topic) >= 3 AND {NAMED} AND (status IN ('active', 'contested') OR tmp AND status = 'superseded')),
ent AS (SELECT query_id, mem_id, 0.4 AS score, 'entity' AS channel FROM en ANTI JOIN pool USING (query_id, mem_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, mem_id) <= 3),
al AS (SELECT query_id, mem_id, round(score + CASE WHEN agg AND mem_type IN ('digest', 'dossier') THEN 0.15 ELSE 0 END, 6) AS score, channel, agg
  FROM (SELECT * FROM pool UNION ALL SELECT * FROM ent) ANTI JOIN ins USING (query_id, mem_id) JOIN i USING (query_id) JOIN mem USING (mem_id)),
hit AS (SELECT query_id, mem_id, score, channel, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mem_id) AS n FROM al QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mem_id) <= CASE WHEN agg THEN 15 ELSE 10 END),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY part, n)::INT AS position, mem_id, channel, score::DOUBLE AS score FROM
  (SELECT query_id, mem_id, n, 0 AS part, 'instruction' AS channel, 1.0 AS score FROM ins UNION ALL SELECT query_id, mem_id, n, 1, channel, score FROM hit))"""


def asked(spark, d):
    q = questions(spark, d, "project", "query")
    cue = lambda name: T.has_cue(F.col("query"), INTENT_CUES[name])
    return q.select("query_id", _scopes(), F.col("query").alias("text"), cue("temporal").alias("past"), cue("aggregate").alias("aggregate"), cue("conversation").alias("conversation"))


def entities(spark, d):
    """Topics serve as the entities of memories, which these tables lack."""
    m = memories(spark, d, "mem_scope", "mem_type", "status", "created_at", "topics").where(~F.coalesce("mem_type", F.lit("")).isin("summary", "rule"))
    return m.select("mem_id", F.lower("mem_scope").alias("scope"), F.explode(F.array_distinct("topics")).alias("entity"), "status", F.col("mem_type").alias("kind"), "created_at")


def candidate_scores(spark, d):
    """Keyword scores that a search can use: of each question's usable memories the best instructions and the pool of accepted ones. ``wanted``: of an expected memory; ``used``: of those."""
    cue = lambda name: T.has_cue(F.col("query"), INTENT_CUES[name])
    a = asked_with(spark, d, "expected", cue("temporal").alias("past"), cue("aggregate").alias("aggregate"))
    return searched(spark, d, pooled, "mem_id string, keyword double, used int, wanted int, kind string, status string", a)


def pooled(q, number, k, docs, place):
    import numpy as np

    m = _kinds(docs)
    if "rule" not in m:
        m |= {"rule": m["kind"] == "rule", "instruction": m["kind"] == "instruction", "number": {x: n for n, x in enumerate(q["ids"].to_pylist())}}
    good = ~m["summary"][number] & ~m["rule"][number] & (m["live"][number] | (m["old"][number] & bool(q["past"])))
    number, k = number[good], k[good]
    used, wanted = np.zeros(len(k), np.int32), np.zeros(len(k), np.int32)
    for at, most in ((np.flatnonzero(m["instruction"][number]), assembled.INSTRUCTIONS), (np.flatnonzero(k >= 0.3), 96 if q["aggregate"] else 48)):
        used[at[index.leading(number[at], k[at], place, most)]] = 1
    if q["expected"]:
        wanted[np.isin(number, [m["number"][x] for x in q["expected"] if x in m["number"]])] = 1
    out = np.flatnonzero(used | wanted)
    return [number[out], k[out], used[out], wanted[out], m["kind"][number[out]], m["status"][number[out]]]


def ranked(spark, d, hops=False, scores=None):
    m = memories(spark, d, "mem_type", "status").select("mem_id", F.col("mem_type").alias("kind"), "status")
    scores = written(candidate_scores(spark, d), "accepted") if scores is None else scores
    return assembled.ranked(scores.where("used = 1").select("query_id", "mem_id", "keyword", "kind", "status"), m, entities(spark, d), asked(spark, d), hops=hops)


@query(f"WITH {RANKED_SQL} SELECT * FROM ranked")
def r3_ranked_recall(spark, d):
    """All channels of a search in one plan: instructions by relevance, pooled keyword hits, named entities; boosts, order and limits."""
    return ranked(spark, d)


@query(
    f"WITH {RANKED_SQL}, e8 AS (SELECT query_id, mem_id, score, channel FROM (SELECT * FROM pool UNION ALL SELECT * FROM ent)), "
    f"sd AS (SELECT query_id, mem_id, score FROM e8 JOIN mem USING (mem_id) WHERE coalesce(mem_type, '') NOT IN ({quoted(DERIVED_TYPES)}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mem_id) <= 8), "
    f"lt AS (SELECT DISTINCT mem_id, scope, lower(topic) AS topic FROM mt WHERE coalesce(mem_type, '') NOT IN ({quoted(DERIVED_TYPES)}) AND status IN ('active', 'contested')), "
    "el AS (SELECT * FROM lt), via AS (SELECT query_id, topic, max(score) AS score FROM sd JOIN el USING (mem_id) GROUP BY ALL), cn AS (SELECT scope, topic, count(*) AS n FROM el GROUP BY ALL), "
    "vn AS (SELECT via.query_id, via.topic FROM via JOIN qs2 USING (query_id) JOIN cn USING (scope, topic) GROUP BY ALL HAVING sum(n) <= 12), "
    f"vq AS (SELECT via.*, query FROM via SEMI JOIN vn USING (query_id, topic) JOIN i USING (query_id) WHERE length(topic) < 3 OR NOT {NAMED}), "
    "ln AS (SELECT qs2.query_id, el.mem_id, max(score) AS score FROM vq JOIN qs2 USING (query_id) JOIN el ON el.scope = qs2.scope AND el.topic = vq.topic GROUP BY ALL) "
    "SELECT query_id, mem_id, round(score * 0.7, 6)::DOUBLE AS score FROM ln ANTI JOIN e8 USING (query_id, mem_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mem_id) <= 3"
)
def j11_entity_hops(spark, d):
    """One step along the entities of each question's best hits: score, no entity of the question itself, none already found."""
    m = memories(spark, d, "mem_type", "status").select("mem_id", F.col("mem_type").alias("kind"), "status")
    scores, e, q = written(candidate_scores(spark, d).where("used = 1").drop("used", "wanted"), "accepted"), entities(spark, d), asked(spark, d)
    flags = q.select("query_id", "past", "aggregate").distinct()
    all_ = assembled.usable(scores.where("coalesce(kind, '') <> 'rule'").join(flags, "query_id")).where("keyword >= 0.3")
    found = assembled.first(all_, ["query_id"], [F.desc("keyword"), "mem_id"], F.when(F.col("aggregate"), 96).otherwise(48))
    found = found.select("query_id", "mem_id", (F.col("keyword") * F.when(F.col("status") == "superseded", 0.9).otherwise(1.0)).alias("score"))
    found = found.unionByName(assembled.entity_hits(q, e, found, 10, 96).withColumn("score", F.lit(0.4)))
    seeds = found.join(m.where(~F.coalesce("kind", F.lit("")).isin(DERIVED_TYPES)).select("mem_id"), "mem_id")
    return assembled.entity_hops(q, seeds, e, found, 10).select("query_id", "mem_id", F.round("score", 6).alias("score"))


LOGIT = "((length(content) % 41) - 20) / 5.0"


@query(
    f"WITH {RANKED_SQL}, l AS (SELECT query_id, position, mem_id, round(1 / (1 + exp(-({LOGIT}))), 6) AS score FROM ranked JOIN mem USING (mem_id)) "
    "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mem_id)::INT AS position, mem_id, score FROM l"
)
def t8_reranked(spark, d):
    """Hits re-scored by a table of model logits (here a function of the text's length); a search has fewer hits than are re-scored."""
    hits = ranked(spark, d)
    logits = hits.select("query_id", "mem_id").join(memories(spark, d, "content"), "mem_id").select("query_id", "mem_id", F.expr("((length(content) % 41) - 20) / 5.0D").alias("logit"))
    return assembled.reranked(hits, logits)


@query(
    f"WITH {RANKED_SQL}, x AS (SELECT query_id, list_distinct(expected) AS e FROM qry WHERE len(expected) > 0), h AS (SELECT query_id, list(mem_id) AS l FROM ranked WHERE position <= 5 GROUP BY 1), "
    "b AS (SELECT query_id, len(e) AS e, coalesce(len(l), 0) AS l, coalesce(len(list_intersect(e, l)), 0) AS nb FROM x LEFT JOIN h USING (query_id)) "
    "SELECT query_id, round(CASE WHEN l > 0 THEN nb / l ELSE 0 END, 6) AS precision, round(nb / e, 6) AS recall, round(CASE WHEN nb > 0 THEN 2.0 * nb / (l + e) ELSE 0 END, 6)::DOUBLE AS f1, (l = 0) AS abstained FROM b"
)
def u5_set_precision(spark, d):
    """Precision, recall and F1 of each question's first five hits against its expected memories."""
    x = questions(spark, d, "expected").where(F.size("expected") > 0).select("query_id", F.array_distinct("expected").alias("e"))
    h = ranked(spark, d).where("position <= 5").groupBy("query_id").agg(F.collect_list("mem_id").alias("l"))
    n = x.join(h, "query_id", "left").select("query_id", F.size("e").alias("e"), F.coalesce(F.size("l"), F.lit(0)).alias("l"), F.coalesce(F.size(F.array_intersect("e", "l")), F.lit(0)).alias("b"))
    n = n.withColumn("l", F.greatest("l", F.lit(0))).withColumn("b", F.greatest("b", F.lit(0)))
    r = lambda x: F.round(x, 6)
    return n.select(
        "query_id", r(F.when(F.col("l") > 0, F.col("b") / F.col("l")).otherwise(0.0)).alias("precision"), r(F.col("b") / F.col("e")).alias("recall"),
        r(F.when(F.col("b") > 0, 2.0 * F.col("b") / (F.col("l") + F.col("e"))).otherwise(0.0)).alias("f1"), (F.col("l") == 0).alias("abstained"),
    )


@query(
    f"WITH {RANKED_SQL}, x AS (SELECT query_id, list_distinct(expected) AS e FROM qry), h AS (SELECT query_id, list(mem_id) AS l FROM ranked WHERE position <= 5 GROUP BY 1), "
    "b AS (SELECT coalesce(len(e), 0) AS e, coalesce(len(l), 0) AS l, coalesce(len(list_intersect(e, l)), 0) AS nb FROM x LEFT JOIN h USING (query_id)) "
    "SELECT count(*)::BIGINT AS questions, round(avg((nb > 0)::INT) FILTER (e > 0), 6) AS hit_rate, round(sum(nb) / sum(e), 6) AS memory_recall, round(sum(nb) / sum(l), 6) AS precision, "
    "round(avg((l = 0)::INT), 6) AS abstain_rate, round(avg((l > 0)::INT) FILTER (e = 0), 6) AS false_positive_rate FROM b"
)
def a20_replay(spark, d):
    """Replay metrics of the first five hits: hit rate, memory recall, precision, abstaining, answers where nothing is expected."""
    x = questions(spark, d, "expected").select("query_id", F.array_distinct("expected").alias("e"))
    h = ranked(spark, d).where("position <= 5").groupBy("query_id").agg(F.collect_list("mem_id").alias("l"))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    n = x.join(h, "query_id", "left").select(size("e").alias("e"), size("l").alias("l"), size(F.array_intersect("e", "l")).alias("b"))
    mean = lambda test, where: F.round(F.avg(F.when(where, test.cast("int"))), 6)
    every = F.lit(True)
    return n.agg(
        F.count("*").alias("questions"), mean(F.col("b") > 0, F.col("e") > 0).alias("hit_rate"), F.round(F.sum("b") / F.sum("e"), 6).alias("memory_recall"), F.round(F.sum("b") / F.sum("l"), 6).alias("precision"),
        mean(F.col("l") == 0, every).alias("abstain_rate"), mean(F.col("l") > 0, F.col("e") == 0).alias("false_positive_rate"),
    )


@query(
    f"WITH {RANKED_SQL}, x AS (SELECT query_id, unnest(list_distinct(expected)) AS mem_id FROM qry) "
    "SELECT x.query_id, x.mem_id, f.k AS keyword FROM x JOIN f USING (query_id, mem_id) ANTI JOIN ranked USING (query_id, mem_id)"
)
def c14_missed_recalls(spark, d):
    """Expected memories that share words with a question but were not shown: what a trigger should bring back."""
    scores = written(candidate_scores(spark, d), "accepted")
    seen = scores.where("wanted = 1").select("query_id", "mem_id", "keyword")
    return seen.join(ranked(spark, d, scores=scores).select("query_id", "mem_id"), ["query_id", "mem_id"], "left_anti").select("query_id", "mem_id", "keyword")


BLOCK_SQL = (
    "'<ctx-memory id=\"' || mem_id || '\" type=\"' || coalesce(mem_type, '') || '\" scope=\"' || mem_scope || '\" date=\"' || coalesce(substr(created_at, 1, 10), '') || '\"' || "
    "CASE WHEN status = 'contested' THEN ' status=\"contested\"' ELSE '' END || '>' || chr(10) || content || chr(10) || '</ctx-memory>'"
)


def blocks(m):
    c = F.col
    return assembled.block(c("mem_id"), c("mem_type"), c("mem_scope"), c("created_at"), F.lit(None).cast("string"), F.coalesce("status", F.lit("")), c("content"))


@query(f"WITH {MEM} SELECT mem_id, md5({BLOCK_SQL}) AS block, ceil(length({BLOCK_SQL}) / 4.0)::BIGINT AS tokens, '[' || substr(created_at, 1, 10) || '] ' || title AS line FROM mem")
def x25_rendered(spark, d):
    """Every memory as a block, its tokens, and as a brief's line."""
    m = memories(spark, d, "mem_type", "mem_scope", "created_at", "status", "content", "title").withColumn("b", blocks(None))
    return m.select("mem_id", F.md5("b").alias("block"), assembled.block_tokens(F.col("b")).alias("tokens"), assembled.brief_line(F.col("created_at"), F.col("title")).alias("line"))


@query(
    f"WITH RECURSIVE {MEM}, r AS (SELECT mem_id, lower(mem_scope) AS scope, ceil(length({BLOCK_SQL}) / 4.0) AS cost FROM mem WHERE mem_type = 'rule' AND status IN ('active', 'contested')), "
    "p AS (SELECT lower(project) AS project FROM projects), a AS (SELECT project, mem_id, cost, row_number() OVER (PARTITION BY project ORDER BY mem_id) AS n FROM p JOIN r ON r.scope = p.project OR r.scope = 'global'), "
    "f AS (SELECT project, n, mem_id, cost <= 2000 AS kept, CASE WHEN cost <= 2000 THEN cost ELSE 0 END AS used FROM a WHERE n = 1 UNION ALL "
    "SELECT a.project, a.n, a.mem_id, f.used + a.cost <= 2000, CASE WHEN f.used + a.cost <= 2000 THEN f.used + a.cost ELSE f.used END FROM f JOIN a ON a.project = f.project AND a.n = f.n + 1) "
    "SELECT project, mem_id, (row_number() OVER (PARTITION BY project ORDER BY n) - 1)::INT AS position FROM f WHERE kept"
)
def c16_rules_block(spark, d):
    """The always-on block of each project: its rules and the global ones by id, as many as 2 000 tokens hold. A project's rules are few next to its memories."""
    m = memories(spark, d, "mem_type", "mem_scope", "created_at", "status", "content").where("mem_type = 'rule' and status in ('active', 'contested')")
    r = m.select("mem_id", F.lower("mem_scope").alias("scope"), assembled.block_tokens(blocks(None)).alias("cost"))
    p = table(spark, d, "projects").select(F.lower("project").alias("project"))
    a = p.withColumn("scope", F.explode(F.array_distinct(F.array(F.lit("global"), F.col("project"))))).join(r, "scope").select("project", "mem_id", "cost")
    return retrieval.greedy_budget(a, "project", ["mem_id"], "mem_id", "cost", 2000).select("project", "mem_id", "position")


@query(
    f"WITH {RANKED_SQL} SELECT query_id, count(*)::BIGINT AS hits, sum(length(content) // 4 + 12)::BIGINT AS tokens, count(*) FILTER (channel = 'instruction')::BIGINT AS instructions FROM ranked JOIN mem USING (mem_id) GROUP BY 1"
)
def t3_result_sizes(spark, d):
    """Hits, their tokens and instructions of each question after pools and limits."""
    h = ranked(spark, d).join(memories(spark, d, "content"), "mem_id")
    return h.groupBy("query_id").agg(F.count("*").alias("hits"), F.sum((F.floor(F.length("content") / 4) + 12)).alias("tokens"), F.count_if(F.col("channel") == "instruction").alias("instructions"))


NEG_SQL = _cue_sql(APOSTROPHE, NEGATION_CUES)


@query(
    f"WITH {MEM}, m AS (SELECT mem_id, content, created_at, {NEG_SQL} AS neg, unnest(list_distinct(supersedes)) AS other FROM mem), o AS (SELECT mem_id AS other, substr(created_at, 1, 10) AS said, {NEG_SQL} AS neg FROM mem) "
    "SELECT m.mem_id, other, said FROM m JOIN o USING (other) WHERE m.neg OR o.neg"
)
def j14_conflicts(spark, d):
    """Linked statements of which either side denies something (links: the memories a memory supersedes)."""
    m = memories(spark, d, "content", "created_at", "supersedes").select("mem_id", "content", F.substring("created_at", 1, 10).alias("said"), F.col("supersedes").alias("conflicts_with"))
    return assembled.conflicts(m).select("mem_id", "other", "said")


@query()
def r11_conflict_notes(spark, d):
    """Notes on contradictions among the hits of yes-or-no questions (all statements with links count as contested, as few here are)."""
    starts = F.lit(False)
    q = questions(spark, d, "query")
    for s in YES_NO_STARTS:
        starts = starts | F.startswith(F.lower("query"), F.lit(s))
    m = memories(spark, d, "content", "created_at", "supersedes").select("mem_id", F.lit("contested").alias("status"), F.col("created_at").alias("said"), "content", F.col("supersedes").alias("conflicts_with"))
    hits = ranked(spark, d).where("channel <> 'instruction'").join(q.where(starts).select("query_id"), "query_id")
    return assembled.conflict_notes(hits.select("query_id", "position", "mem_id"), m.where("size(conflicts_with) > 0").unionByName(m.where("coalesce(size(conflicts_with), 0) <= 0")))


@query()
def r21_finished(spark, d):
    """The whole search: ranked hits, the timeline of questions about how things went, packing into 600 tokens."""
    q = questions(spark, d, "project", "query")
    flags = q.select("query_id", "query", T.has_cue(F.col("query"), INTENT_CUES["conversation"]).alias("conversation"), T.has_cue(F.col("query"), INTENT_CUES["overview"]).alias("overview"), F.coalesce(F.lower("project"), F.lit("global")).alias("project"))
    m = memories(spark, d, "mem_type", "content").select(F.col("mem_id").alias("id"), F.col("content").alias("text"))
    hits = ranked(spark, d).withColumnRenamed("mem_id", "id").join(m, "id").join(flags, "query_id")
    hits = hits.select(F.col("query_id").alias("question_id"), "position", "id", F.when(F.col("channel") == "instruction", "leading").otherwise("memory").alias("kind"), "text", F.col("query").alias("question"), "conversation")
    s = turns(spark, d, "project", "session_id", "note", "turn_no").where("note is not null").select(F.lower("project").alias("project"), "session_id", "turn_no", "turn_id", "note")
    one = s.groupBy("project", "session_id").agg(F.max(F.struct("turn_no", "turn_id", "note")).alias("x"), F.min("turn_no").alias("a"), F.max("turn_no").alias("b"))
    newest = assembled.first(one, ["project"], [F.desc("session_id")], 40)  # lines of 140 characters in a share of the budget
    line = F.concat(F.lit("- Session "), "session_id", F.lit(", turns #"), F.col("a").cast("string"), F.lit("–#"), F.col("b").cast("string"), F.lit(" "), F.substring("x.note", 1, 140))
    lines = newest.groupBy("project").agg(F.array_join(F.slice(F.array_sort(F.collect_list(line)), 1, 6), "\n").alias("text"))
    blocks_ = flags.where("overview").join(lines, "project").select(F.col("query_id").alias("question_id"), F.lit(1).alias("stage"), F.lit("timeline").alias("id"), "text")
    return assembled.finished(hits, blocks_, 600)


@query(
    f"WITH {QRY} SELECT query_id, {_cue_sql('query', INTENT_CUES['conversation'])} OR ({_cue_sql('query', INTENT_CUES['overview'])} AND NOT {_cue_sql('query', INTENT_CUES['aggregate'])} AND NOT {_cue_sql('query', INTENT_CUES['mention_order'])}) AS summary FROM qry"
)
def f21_summary_questions(spark, d):
    cue = lambda n: T.has_cue(F.col("query"), INTENT_CUES[n])
    return questions(spark, d, "query").select("query_id", (cue("conversation") | (cue("overview") & ~cue("aggregate") & ~cue("mention_order"))).alias("summary"))


@query(
    f"WITH {MEM}, {QRY}, t AS (SELECT DISTINCT lower(topic) AS topic FROM (SELECT unnest(topics) AS topic FROM mem)), q AS (SELECT lower(query) AS q FROM qry ORDER BY added_at DESC, query_id DESC LIMIT 2000), n AS (SELECT count(*) AS n FROM q) "
    "SELECT topic, count(*)::BIGINT AS fired, any_value(n)::BIGINT AS steps, n >= 20 AND count(*) > 0.05 * n AS broad FROM t JOIN q ON contains(q, topic), n GROUP BY topic, n"
)
def a13_recent_breadth(spark, d):
    """Keyword triggers (topics) over the newest 2 000 steps, twenty at least: those that fire in more than 5 % are too broad. Steps meet triggers on four characters."""
    t = memories(spark, d, "topics").select(F.explode("topics").alias("topic")).select(F.lower("topic").alias("topic")).distinct()
    q = questions(spark, d, "query", "added_at").orderBy(F.desc("added_at"), F.desc("query_id")).limit(2000).select("query_id", F.lower("query").alias("q"))
    q = written(q, "steps")
    n = q.count()
    fired = blocking.containing(q, "query_id", "q", t.select("topic", F.col("topic").alias("pattern")), "topic", "pattern").groupBy("topic").agg(F.count("*").alias("fired"))
    return fired.select("topic", "fired", F.lit(n).cast("bigint").alias("steps"), (F.lit(n >= 20) & (F.col("fired") > 0.05 * n)).alias("broad"))


@query(
    f"WITH {QRY}, {TRN}, {VEC}, mv AS (SELECT owner_id AS mem_id, arg_min({UNIT}, vec_id) AS u FROM vec WHERE owner_kind = 'memory' GROUP BY 1), "
    f"tv AS (SELECT owner_id AS turn_id, arg_min({UNIT}, vec_id) AS u FROM vec WHERE owner_kind = 'turn' GROUP BY 1), qv AS (SELECT query_id, lower(project) AS project, u AS qu FROM qry JOIN mv ON expected[1] = mv.mem_id WHERE project IS NOT NULL), "
    "c AS (SELECT trn.turn_id, lower(project) AS project, u, least(length(text) + coalesce(length(outline) + 1, 0), 6000) AS size FROM trn JOIN tv ON tv.turn_id = trn.turn_id::VARCHAR WHERE project IS NOT NULL), "
    "s AS (SELECT query_id, turn_id, size, round(list_dot_product(qu, u), 6) AS similarity FROM qv JOIN c USING (project)) "
    "SELECT query_id, turn_id, similarity, size::BIGINT AS size, n::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, turn_id) AS n FROM s WHERE similarity >= 0.25) WHERE n <= 3"
)
def o2_naive_retrieval(spark, d):
    """The naive baseline: user message and reply as one chunk of at most 6 000 characters, the three nearest by cosine within the project."""
    v = unit_vectors(spark, d, "memory").select(F.col("owner_id").alias("own"), F.col("u").alias("qv"))
    q = questions(spark, d, "project", "expected").where("project is not null").select("query_id", F.lower("project").alias("scope"), F.get("expected", F.lit(0)).alias("own")).join(v, "own")
    t = turns(spark, d, "project", "text", "outline").where("project is not null").join(unit_vectors(spark, d, "turn"), F.col("turn_id").cast("string") == F.col("owner_id"))
    size = F.least(F.length("text") + F.coalesce(F.length("outline") + 1, F.lit(0)), F.lit(6000)).cast("bigint")
    t = t.select("turn_id", F.lower("project").alias("scope"), F.col("u").alias("v"), size.alias("size"))
    s = retrieval.semantic_scores(q.select("query_id", "scope", "qv"), t.select(F.col("turn_id").cast("string").alias("mem_id"), "scope", "v"), 0.2499)
    s = s.select("query_id", F.col("mem_id").cast("bigint").alias("turn_id"), F.round("semantic", 6).alias("similarity")).where("similarity >= 0.25")
    return index.top(s, "query_id", "similarity", "turn_id", 3).join(t.select("turn_id", "size"), "turn_id").select("query_id", "turn_id", "similarity", "size", "rank")
