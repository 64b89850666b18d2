"""Retrieval, channel and session queries."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemospark.functions.lists import DERIVED_TYPES, INTENT_CUES, NEGATION_CUES
from mnemospark.functions import text as T
from mnemospark.functions.vectors import normalized, usable
from mnemospark.operators import index, retrieval
from mnemospark.plans.lineage import discard, kept, written
from mnemospark.plans.registry import MEM, QRY, TRN, VEC, query, quoted, terms_sql
from mnemospark.plans.text_queries import APOSTROPHE, BODY, NUMBERS_SQL, _cue_sql, body, memories, questions, turns
from mnemospark.sources.tables import latest, latest_texts, table

SCOPES = "unnest(CASE WHEN project IS NULL OR project = 'global' THEN ['global'] ELSE ['global', lower(project)] END) AS scope"


def _scopes():
    return F.explode(F.when(F.col("project").isNull() | (F.col("project") == "global"), F.array(F.lit("global"))).otherwise(F.array(F.lit("global"), F.lower("project")))).alias("scope")


KEYWORD_SQL = f"""{MEM}, {QRY},
occ AS ({terms_sql('mem', 'mem_id', BODY, ', lower(mem_scope) AS scope')}),
post AS (SELECT mem_id, scope, w, count(*) AS tf FROM occ GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM post GROUP BY w), len AS (SELECT mem_id, sum(tf) AS len FROM post GROUP BY 1), st AS (SELECT avg(len) AS al FROM len),
n AS (SELECT count(*) AS n FROM mem),
ask AS (SELECT DISTINCT * FROM ({terms_sql('qry', 'query_id', 'query', ', project AS project')})),
aski AS (SELECT query_id, project, ask.w, ln(1 + (n.n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf FROM ask CROSS JOIN n LEFT JOIN df ON ask.w = df.w),
mass AS (SELECT query_id, sum(idf) AS mass FROM aski GROUP BY 1),
sc AS (SELECT query_id, w, idf, {SCOPES} FROM aski),
per AS (SELECT query_id, post.mem_id, sum(idf) AS matched, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len.len / st.al))) AS bm25
  FROM sc JOIN post USING (w, scope) JOIN len ON post.mem_id = len.mem_id CROSS JOIN st GROUP BY 1, 2),
kw AS (SELECT query_id, mem_id, round(matched / mass * (0.8 + 0.2 * bm25 / max(bm25) OVER (PARTITION BY query_id)), 6) AS keyword FROM per JOIN mass USING (query_id))"""


def keyword(spark, d):
    docs = memories(spark, d, "title", "content", "mem_scope").select("mem_id", F.lower("mem_scope").alias("scope"), body().alias("text"))
    asked = questions(spark, d, "project", "query").select("query_id", "project", F.col("query").alias("text"))
    built = kept("memories", [table(spark, d, "memories")], lambda: index.built(docs))
    scores, ids, names = index.keyword_scores(docs, asked, index=built)
    return scores.withColumn("keyword", F.round("keyword", 6)), ids, names


def stored(spark, d, kind="stored", docs=None, *more):
    """What gives the stored memories (or other documents) for the slots of the asked terms; once for the same files and slots."""
    if docs is None:
        m = latest_texts(table(spark, d, "memories"), "mem_id", "ingested_at", "mem_id", "title", "content", "mem_scope", "mem_type", "status")
        docs, more = m.select("mem_id", F.lower("mem_scope").alias("scope"), body().alias("text"), F.col("mem_type").alias("kind"), "status"), ("kind", "status")
    tables = {"stored turns": ["turns"]}.get(kind, ["memories"])
    return lambda bits: kept(f"{kind} {hashlib.sha256(bits).hexdigest()}", [table(spark, d, t) for t in tables], lambda: index.stored(docs, *more, bits=bits))


def searched(spark, d, each, schema, asked=None):
    """What ``each`` takes of the keyword candidates of every question (``index.searched``)."""
    return index.searched(stored(spark, d), asked_with(spark, d) if asked is None else asked, each, schema)


def asked_with(spark, d, *more):
    """Questions for a search, with more columns that ``each`` sees; expressions over project and query."""
    q = latest_texts(table(spark, d, "queries"), "query_id", "added_at", "query_id", "project", "query", "expected")  # scans read what is used
    return q.select("query_id", "project", F.col("query").alias("text"), *more)


def _kinds(docs):
    """What a search asks of the documents of a task, once for all questions: live, superseded, summaries."""
    import numpy as np

    if "live" not in docs:
        docs |= {"live": np.isin(docs["status"].astype(str), ("active", "contested")), "old": docs["status"] == "superseded", "summary": docs["kind"] == "summary"}
    return docs


def best_of(most):
    """Of each question's candidates the ``most`` best."""

    def each(q, number, k, docs, place):
        at = index.leading(number, k, place, most)
        return [number[at], k[at]]

    return each


def first_rows(rows, most, score="keyword", item="mem_id"):
    """The ``most`` best rows of each question with their rank, after those of each block of documents."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), item))).where(F.col("rank") <= most)


def ranked(scores):
    """Rank of each candidate of a question; numbers follow the ids, so they break ties."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("keyword"), "rid")))


@query(
    f"WITH {KEYWORD_SQL}, r AS (SELECT *, round(keyword, 6) AS k FROM kw) SELECT query_id, mem_id, k AS keyword, n::INT AS rank FROM "
    "(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k DESC, mem_id) AS n FROM r) WHERE n <= 3"
)
def r1_keyword_recall(spark, d):
    best = searched(spark, d, best_of(3), "mem_id string, keyword double")
    return first_rows(best, 3).select("query_id", "mem_id", "keyword", "rank")


METRICS_SQL = f"""WITH {KEYWORD_SQL}, r AS (SELECT query_id, mem_id, row_number() OVER (PARTITION BY query_id ORDER BY round(keyword, 6) DESC, mem_id) AS n FROM kw),
e AS (SELECT query_id, category, unnest(expected) AS mem_id FROM qry WHERE len(expected) > 0), q AS (SELECT DISTINCT query_id, category FROM e),
b AS (SELECT e.query_id, min(r.n) AS n FROM e JOIN r ON e.query_id = r.query_id AND e.mem_id = r.mem_id GROUP BY 1),
m AS (SELECT category, coalesce(n = 1, false)::INT AS h, coalesce(n <= 3, false)::INT AS r3, coalesce(1.0 / n, 0) AS rr FROM q LEFT JOIN b USING (query_id))
SELECT coalesce(category, 'all') AS category, count(*)::BIGINT AS questions, round(avg(h), 6) AS hit1, round(avg(r3), 6) AS recall3, round(avg(rr) + 1e-9, 6) AS mrr FROM m GROUP BY GROUPING SETS ((category), ())"""


@query(METRICS_SQL)
def a19_retrieval_metrics(spark, d):
    from mnemospark.operators.evaluation import retrieval_metrics

    gold = questions(spark, d, "category", "expected").where(F.size("expected") > 0)
    asked = asked_with(spark, d, "expected").where(F.size("expected") > 0)
    best = searched(spark, d, best_expected, "mem_id string, keyword double, above bigint", asked)
    if index.blocks(memories(spark, d, "mem_scope").select(F.lower("mem_scope").alias("scope"))) > 1:  # those above it are in all blocks
        best = written(first_rows(best, 1).select("query_id", "mem_id", "keyword"), "best")
        above = searched(spark, d, better, "above bigint", asked.join(best.withColumnRenamed("mem_id", "than"), "query_id"))
        best = best.join(above.groupBy("query_id").agg(F.sum("above").alias("above")), "query_id")
    return retrieval_metrics(best.select("query_id", "mem_id", (F.col("above") + 1).alias("rank")), gold)


def best_expected(q, number, k, docs, place):
    """The best of a question's expected memories among its candidates, and how many are before it."""
    import numpy as np

    if "number" not in docs:
        docs["number"] = {m: n for n, m in enumerate(q["ids"].to_pylist())}
    at = np.flatnonzero(np.isin(number, [docs["number"][m] for m in q["expected"] if m in docs["number"]]))
    if not len(at):
        return None
    one = at[index.leading(number[at], k[at], place, 1)]
    return [number[one], k[one], [np.count_nonzero((k > k[one]) | (k == k[one]) & (place[number] < place[number[one]]))]]


def better(q, number, k, docs, place):
    """How many candidates are before the memory ``than`` with the score ``keyword``."""
    import numpy as np

    return [[np.count_nonzero((k > q["keyword"]) | (k == q["keyword"]) & (place[number] < np.searchsorted(q["by_id"], q["than"])))]]


@query(
    f"WITH {MEM}, {QRY}, c AS (SELECT lower(mem_scope) AS scope, count(*) AS n FROM mem GROUP BY 1), s AS (SELECT query_id, {SCOPES} FROM qry) "
    "SELECT query_id, coalesce(sum(n), 0)::BIGINT AS in_scope FROM s LEFT JOIN c USING (scope) GROUP BY 1"
)
def f1_in_scope(spark, d):
    sizes = memories(spark, d, "mem_scope").groupBy(F.lower("mem_scope").alias("scope")).agg(F.count("*").alias("n"))
    return questions(spark, d, "project").select("query_id", _scopes()).join(sizes, "scope", "left").groupBy("query_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("in_scope"))


@query(
    f"WITH {QRY}, {TRN}, t AS (SELECT lower(project) AS p, count(*) AS n FROM trn GROUP BY 1) "
    "SELECT query_id, coalesce(n, 0)::BIGINT AS turns FROM qry LEFT JOIN t ON lower(project) IS NOT DISTINCT FROM p"
)
def f2_same_scope(spark, d):
    t = turns(spark, d, "project").groupBy(F.lower("project").alias("p")).agg(F.count("*").alias("n"))
    q = questions(spark, d, "project")
    return q.join(t, F.lower("project").eqNullSafe(F.col("p")), "left").select("query_id", F.coalesce("n", F.lit(0)).alias("turns"))


@query(
    f"WITH {MEM} SELECT mem_type, status, status IN ('active', 'contested') AS recallable, coalesce(mem_type = 'rule', false) AS always_on, coalesce(mem_type IN ({quoted(DERIVED_TYPES)}), false) AS derived, "
    "count(*)::BIGINT AS memories FROM mem GROUP BY ALL"
)
def f3_memory_states(spark, d):
    m = memories(spark, d, "mem_type", "status")
    return m.groupBy(
        "mem_type", "status", F.col("status").isin("active", "contested").alias("recallable"), F.coalesce(F.col("mem_type") == "rule", F.lit(False)).alias("always_on"),
        F.coalesce(F.col("mem_type").isin(DERIVED_TYPES), F.lit(False)).alias("derived"),
    ).agg(F.count("*").alias("memories"))


@query(
    f"WITH {MEM}, {QRY}, c AS (SELECT lower(mem_scope) AS scope, count(*) FILTER (status IN ('active', 'contested')) AS live, count(*) FILTER (status = 'superseded') AS old FROM mem "
    f"WHERE coalesce(mem_type, '') <> 'summary' GROUP BY 1), s AS (SELECT query_id, {_cue_sql('query', INTENT_CUES['temporal'])} AS t, {SCOPES} FROM qry) "
    "SELECT query_id, coalesce(sum(live), 0)::BIGINT AS recallable, coalesce(sum(live + CASE WHEN t THEN old ELSE 0 END), 0)::BIGINT AS usable FROM s LEFT JOIN c USING (scope) GROUP BY 1"
)
def f6_usable(spark, d):
    m = memories(spark, d, "mem_scope", "mem_type", "status").where(F.coalesce("mem_type", F.lit("")) != "summary")
    c = m.groupBy(F.lower("mem_scope").alias("scope")).agg(F.count_if(F.col("status").isin("active", "contested")).alias("live"), F.count_if(F.col("status") == "superseded").alias("old"))
    q = questions(spark, d, "project", "query").select("query_id", T.has_cue(F.col("query"), INTENT_CUES["temporal"]).alias("t"), _scopes())
    total = F.col("live") + F.when(F.col("t"), F.col("old")).otherwise(0)
    return q.join(c, "scope", "left").groupBy("query_id").agg(F.coalesce(F.sum("live"), F.lit(0)).alias("recallable"), F.coalesce(F.sum(total), F.lit(0)).alias("usable"))


# a question's vector is that of its first expected memory: questions carry none of their own
UNIT = "[x / sqrt(list_dot_product(v, v)) for x in v]"
SEMANTIC_SQL = f"""{VEC}, mv AS (SELECT owner_id AS mem_id, arg_min({UNIT}, vec_id) AS u FROM vec WHERE owner_kind = 'memory' GROUP BY 1),
sm AS (SELECT mem.mem_id, lower(mem_scope) AS scope, u FROM mem JOIN mv USING (mem_id)),
qv AS (SELECT query_id, project, u AS qu, expected[1] AS own FROM qry JOIN mv ON expected[1] = mv.mem_id),
qs AS (SELECT query_id, qu, own, {SCOPES} FROM qv),
sem AS (SELECT query_id, sm.mem_id, list_dot_product(qu, u) AS semantic FROM qs JOIN sm USING (scope) WHERE sm.mem_id <> own)"""


def unit_vectors(spark, d, kind):
    v = latest(table(spark, d, "index_vectors"), "vec_id", "embedded_at", "vec_id", "owner_id", "owner_kind", "vector").where((F.col("owner_kind") == kind) & usable(F.col("vector"), 64))
    one = v.groupBy("owner_id").agg(F.min(F.struct("vec_id", "vector")).alias("x"))
    return one.select("owner_id", normalized(F.col("x.vector")).alias("u"))


def raw_vectors(spark, d, kind):
    """(owner_id, v): the vectors of ``unit_vectors`` as stored; only those of owners with several move."""
    v = latest_texts(table(spark, d, "index_vectors"), "vec_id", "embedded_at", "vec_id", "owner_id", "owner_kind", "vector")
    v = v.where((F.col("owner_kind") == kind) & usable(F.col("vector"), 64)).select("owner_id", (-F.col("vec_id")).alias("first"), F.col("vector").alias("v"))
    return latest_texts(v, "owner_id", "first", "owner_id", "v")


def semantic_sides(spark, d):
    """(asked, stored, own): question vectors by scope, memory vectors by scope, the memory a question's vector is from."""
    v = unit_vectors(spark, d, "memory").withColumnRenamed("owner_id", "mem_id")
    stored = memories(spark, d, "mem_scope").join(v, "mem_id").select("mem_id", F.lower("mem_scope").alias("scope"), F.col("u").alias("v"))
    q = questions(spark, d, "project", "expected").select("query_id", "project", F.get("expected", F.lit(0)).alias("own"))
    asked = q.join(v.select(F.col("mem_id").alias("own"), F.col("u").alias("qv")), "own").select("query_id", "own", "qv", _scopes())
    return asked, stored, q.select("query_id", "own")


def semantic(spark, d, least=0.25):
    asked, stored, own = semantic_sides(spark, d)
    s = retrieval.semantic_scores(asked.select("query_id", "scope", "qv"), stored, least)
    return s.join(own, "query_id").where("mem_id <> own").select("query_id", "mem_id", "semantic")


@query(
    f"WITH {MEM}, {QRY}, {SEMANTIC_SQL}, r AS (SELECT *, round(semantic, 6) AS s FROM sem WHERE semantic >= 0.25) "
    "SELECT query_id, mem_id, s AS semantic, n::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, mem_id) AS n FROM r) WHERE n <= 5"
)
def j8_semantic_recall(spark, d):
    s = semantic(spark, d).withColumn("semantic", F.round("semantic", 6))
    return index.top(s, "query_id", "semantic", "mem_id", 5).select("query_id", "mem_id", "semantic", "rank")


@query(
    f"WITH {KEYWORD_SQL}, {SEMANTIC_SQL}, f AS (SELECT query_id, mem_id, keyword, semantic FROM kw FULL JOIN sem USING (query_id, mem_id)), "
    "a AS (SELECT query_id, mem_id, round(CASE WHEN semantic IS NOT NULL THEN 0.75 * semantic + 0.25 * coalesce(keyword, 0) ELSE 0.25 * keyword END, 6) AS score, "
    "CASE WHEN coalesce(keyword, 0) > 0 AND coalesce(semantic, 0) > 0 THEN 'both' WHEN coalesce(keyword, 0) > 0 THEN 'keyword' ELSE 'semantic' END AS reason "
    "FROM f WHERE coalesce(semantic, 0) >= 0.25 OR coalesce(keyword, 0) >= 0.3) "
    "SELECT query_id, mem_id, score, reason, n::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mem_id) AS n FROM a) WHERE n <= 10"
)
def r2_hybrid_recall(spark, d):
    best = first_rows(searched_with_vectors(spark, d, fused, "mem_id string, score double, reason int"), 10, "score")
    return best.select("query_id", "mem_id", "score", F.element_at(F.array(*map(F.lit, REASONS)), F.col("reason") + 1).alias("reason"), "rank")


REASONS = ("both", "keyword", "semantic")


def searched_with_vectors(spark, d, each, schema, *more):
    """As ``searched``, where questions and memories meet with their vectors, too; ``more``: columns of memories that ``each`` sees, expressions over those named here."""
    v = raw_vectors(spark, d, "memory")
    m = latest_texts(table(spark, d, "memories"), "mem_id", "ingested_at", "mem_id", "title", "content", "mem_scope", "mem_type", "created_at")
    docs = m.select("mem_id", F.lower("mem_scope").alias("scope"), body().alias("text"), *more)
    names = [c for c in docs.columns if c not in ("mem_id", "scope", "text")]
    q = asked_with(spark, d, F.get("expected", F.lit(0)).alias("source")).join(v.select(F.col("owner_id").alias("source"), F.col("v").alias("qv")), "source", "left")

    def rows(bits):
        own = v.withColumnRenamed("owner_id", "mem_id")
        bare = index.stored(docs, *names, bits=bits)
        both = written(bare.join(own, "mem_id", "left"), "vectors")
        discard(bare)
        return both

    return index.searched(rows, q, each, schema)


def without_own(q, docs):
    """The cosines of a question's documents; none with the memory its vector is from."""
    import numpy as np

    if "number" not in docs:
        docs["number"] = {m: n for n, m in enumerate(q["ids"].to_pylist())}
    return np.where(q["near"] == docs["number"].get(q["source"], -1), np.nan, q["semantic"])


def fused(q, number, k, docs, place):
    """The ten best of what the keywords or the vectors accept."""
    import numpy as np

    s = np.full(len(k), np.nan)
    times = np.ones(len(k), np.int64)
    if "semantic" in q:
        near, cosine = q["near"], without_own(q, docs)
        at = np.full(len(place), -1)
        at[near] = np.arange(len(near))
        s = cosine[at[number]]
        other = cosine >= 0.25
        other[at[number]] = False
        number, k, s = np.r_[number, near[other]], np.r_[k, np.zeros(other.sum())], np.r_[s, cosine[other]]
        times = np.where(np.isnan(s), 1, q["times"][at[number]])
    good = (s >= 0.25) | (k >= 0.3)
    number, k, s = (np.repeat(x[good], times[good]) for x in (number, k, s))
    score = np.floor(np.where(np.isnan(s), 0.25 * k, 0.75 * s + 0.25 * k) * 1e6 + 0.5) / 1e6
    at = index.leading(number, score, place, 10)
    return [number[at], score[at], np.where(k[at] > 0, np.where(s[at] > 0, 0, 1), 2).astype(np.int32)]


@query(
    f"WITH {KEYWORD_SQL}, r AS (SELECT query_id, mem_id, round(keyword, 6) AS k FROM kw), b AS (SELECT query_id, max(k) AS best FROM r GROUP BY 1) "
    "SELECT query_id, count(*) FILTER (k >= 0.8 * best)::BIGINT AS kept, count(*)::BIGINT AS candidates FROM r JOIN b USING (query_id) GROUP BY 1"
)
def f8_relative_cutoff(spark, d):
    near = searched(spark, d, near_best, "keyword double, n bigint, candidates bigint")
    best = F.max("keyword").over(Window.partitionBy("query_id"))
    near = near.withColumn("best", best).groupBy("query_id")
    return near.agg(F.coalesce(F.sum(F.when(F.col("keyword") >= 0.8 * F.col("best"), F.col("n"))), F.lit(0)).alias("kept"), F.sum("candidates").alias("candidates"))


def near_best(q, number, k, docs, place):
    """The best score, how many are from 0.8 of it on, the number of candidates; of one of several blocks each score from there on with its count, the number of candidates in the first row."""
    import numpy as np

    if q["whole"]:
        return [[k.max()], [np.count_nonzero(k >= 0.8 * k.max())], [len(k)]]
    score, n = np.unique(k[k >= 0.8 * k.max()], return_counts=True)
    return [score, n, [len(k)] + [0] * (len(score) - 1)]


@query(
    f"WITH {MEM}, t AS (SELECT mem_id, lower(mem_scope) AS scope, unnest(list_distinct(topics)) AS topic FROM mem), c AS (SELECT scope, topic, count(*) AS n FROM t GROUP BY ALL HAVING count(*) <= 12), "
    "s AS (SELECT t.* FROM t JOIN c USING (scope, topic)) SELECT a.mem_id, b.mem_id AS hop, count(*)::BIGINT AS shared FROM s a JOIN s b USING (scope, topic) WHERE a.mem_id <> b.mem_id GROUP BY ALL"
)
def j11_topic_hops(spark, d):
    t = memories(spark, d, "mem_scope", "topics").select("mem_id", F.lower("mem_scope").alias("scope"), F.explode(F.array_distinct("topics")).alias("topic"))
    rare = t.groupBy("scope", "topic").agg(F.count("*").alias("n")).where("n <= 12").select("scope", "topic")
    s = t.join(rare, ["scope", "topic"])
    return s.join(s.withColumnRenamed("mem_id", "hop"), ["scope", "topic"]).where("mem_id <> hop").groupBy("mem_id", "hop").agg(F.count("*").alias("shared"))


@query(
    f"WITH {MEM}, {TRN}, {VEC}, tv AS (SELECT turn_id, lower(project) AS scope, {UNIT} AS tu FROM trn JOIN vec ON owner_kind = 'turn' AND owner_id = turn_id::VARCHAR WHERE project IS NOT NULL "
    "QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY vec_id) = 1), "
    f"mv AS (SELECT mem_id, lower(mem_scope) AS scope, {UNIT} AS u FROM mem JOIN vec ON owner_kind = 'memory' AND owner_id = mem_id QUALIFY row_number() OVER (PARTITION BY mem_id ORDER BY vec_id) = 1), "
    "p AS (SELECT mem_id, turn_id, round(list_dot_product(u, tu), 6) AS similarity FROM mv JOIN tv USING (scope)) "
    "SELECT * FROM p WHERE similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY mem_id ORDER BY similarity DESC, turn_id) = 1"
)
def j12_provenance(spark, d):
    m = memories(spark, d, "mem_scope").join(unit_vectors(spark, d, "memory"), F.col("mem_id") == F.col("owner_id")).select("mem_id", F.lower("mem_scope").alias("scope"), F.col("u").alias("v"))
    t = turns(spark, d, "project").where("project is not null").join(unit_vectors(spark, d, "turn"), F.col("turn_id").cast("string") == F.col("owner_id"))
    t = t.select("turn_id", F.lower("project").alias("scope"), F.col("u").alias("v"))
    return retrieval.nearest(m, t, "mem_id", "turn_id", 1, 0.3).drop("place")


@query(
    f"WITH {MEM}, a AS (SELECT mem_id, supersedes[1] AS prev FROM mem WHERE len(supersedes) > 0) SELECT a.mem_id, a.prev AS v1, b.prev AS v2, c.prev AS v3, "
    "(1 + (b.prev IS NOT NULL)::INT + (c.prev IS NOT NULL)::INT) AS depth FROM a LEFT JOIN a b ON a.prev = b.mem_id LEFT JOIN a c ON b.prev = c.mem_id"
)
def j15_version_chains(spark, d):
    a = memories(spark, d, "supersedes").where(F.size("supersedes") > 0).select("mem_id", F.get("supersedes", F.lit(0)).alias("prev"))
    b, c = a.select(F.col("mem_id").alias("b_id"), F.col("prev").alias("v2")), a.select(F.col("mem_id").alias("c_id"), F.col("prev").alias("v3"))
    j = a.withColumnRenamed("prev", "v1").join(b, F.col("v1") == F.col("b_id"), "left").join(c, F.col("v2") == F.col("c_id"), "left")
    return j.select("mem_id", "v1", "v2", "v3", (F.lit(1) + F.col("v2").isNotNull().cast("int") + F.col("v3").isNotNull().cast("int")).alias("depth"))


@query(
    f"WITH {MEM}, {VEC}, o AS (SELECT mem_id, lower(mem_scope) AS scope, {NUMBERS_SQL.format('content')} AS numbers, md5(lower(trim(regexp_replace(content, '\\s+', ' ', 'g')))) AS h FROM mem WHERE coalesce(mem_type, '') NOT IN ({quoted(DERIVED_TYPES)})), "
    f"u AS (SELECT owner_id AS mem_id, arg_min({UNIT}, vec_id) AS u FROM vec WHERE owner_kind = 'memory' GROUP BY 1), m AS (SELECT * FROM o JOIN u USING (mem_id)), "
    "e AS (SELECT mem_id AS newer, min(mem_id) OVER (PARTITION BY scope, h) AS older FROM o), n AS (SELECT a.mem_id AS older, b.mem_id AS newer, round(list_dot_product(a.u, b.u), 6) AS similarity FROM m a JOIN m b USING (scope, numbers) WHERE a.mem_id < b.mem_id) "
    "SELECT older, newer, 1.0::DOUBLE AS similarity, 'text' AS reason FROM e WHERE older < newer UNION ALL SELECT older, newer, similarity, 'vector' FROM n WHERE similarity >= 0.6"
)
def j16_near_duplicates(spark, d):
    """Memories of one scope with equal text (linked to the smallest id) or with equal numbers and near vectors (0.6 here; no two of these tables reach the default of 0.88)."""
    v = unit_vectors(spark, d, "memory").select(F.col("owner_id").alias("mem_id"), F.col("u").alias("v"))
    m = memories(spark, d, "mem_scope", "mem_type", "content").where(~F.coalesce("mem_type", F.lit("")).isin(DERIVED_TYPES))
    m = m.select("mem_id", F.lower("mem_scope").alias("scope"), T.number_key(F.col("content")).alias("numbers"), F.md5(T.normalize(F.col("content"))).alias("h"))
    first = m.groupBy("scope", "h").agg(F.min("mem_id").alias("older"))
    equal = m.join(first, ["scope", "h"]).where("older < mem_id").select("older", F.col("mem_id").alias("newer"), F.lit(1.0).alias("similarity"), F.lit("text").alias("reason"))
    near = m.join(v, "mem_id").select("mem_id", F.concat("scope", F.lit("\u0001"), "numbers").alias("scope"), "v")
    s = retrieval.semantic_scores(near.select(F.col("mem_id").alias("query_id"), "scope", F.col("v").alias("qv")), near, 0.5999)
    s = s.where("query_id < mem_id").select(F.col("query_id").alias("older"), F.col("mem_id").alias("newer"), F.round("semantic", 6).alias("similarity"), F.lit("vector").alias("reason"))
    return equal.unionByName(s.where("similarity >= 0.6"))


@query(
    f"WITH {MEM}, {VEC}, m AS (SELECT mem_id, lower(mem_scope) AS scope, {NUMBERS_SQL.format('content')} AS numbers, len(supersedes) > 0 AS new, {UNIT} AS u FROM mem "
    "JOIN vec ON owner_kind = 'memory' AND owner_id = mem_id QUALIFY row_number() OVER (PARTITION BY mem_id ORDER BY vec_id) = 1), "
    "p AS (SELECT a.mem_id AS n, b.mem_id AS o, a.scope, a.numbers AS x, b.numbers AS y, round(list_dot_product(a.u, b.u), 6) AS similarity FROM m a JOIN m b USING (scope) WHERE a.new AND a.mem_id <> b.mem_id "
    "QUALIFY row_number() OVER (PARTITION BY a.mem_id ORDER BY round(list_dot_product(a.u, b.u), 6) DESC, b.mem_id) <= 6), "
    "u AS (SELECT DISTINCT least(n, o) AS first_id, greatest(n, o) AS second_id, scope, similarity FROM p WHERE similarity >= 0.6 AND x <> '' AND y <> '' AND x <> y) "
    "SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY scope ORDER BY similarity DESC, first_id, second_id) <= 20"
)
def j17_contradiction_candidates(spark, d):
    v = unit_vectors(spark, d, "memory").withColumnRenamed("owner_id", "mem_id")
    m = memories(spark, d, "mem_scope", "content", "supersedes").join(v, "mem_id").select(
        "mem_id", F.lower("mem_scope").alias("scope"), T.number_key(F.col("content")).alias("x"), F.col("u").alias("v"), (F.size("supersedes") > 0).alias("new")
    )
    p = retrieval.nearest(m.where("new"), m.withColumnRenamed("mem_id", "o"), "mem_id", "o", 6, different=True)
    p = p.join(m.select("mem_id", "scope", "x"), "mem_id").join(m.select(F.col("mem_id").alias("o"), F.col("x").alias("y")), "o")
    p = p.where("similarity >= 0.6 and x <> '' and y <> '' and x <> y").select(F.least("mem_id", "o").alias("first_id"), F.greatest("mem_id", "o").alias("second_id"), "scope", "similarity").distinct()
    return p.withColumn("n", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("similarity"), "first_id", "second_id"))).where("n <= 20").drop("n")


ELIGIBLE = ("active", "contested"), (*DERIVED_TYPES, "rule", "episode", "timeline")


@query(
    f"WITH {MEM}, {VEC}, m AS (SELECT mem_id, lower(mem_scope) AS scope, {NUMBERS_SQL.format('content')} AS numbers, {_cue_sql(APOSTROPHE, NEGATION_CUES)} AS negative, len(supersedes) > 0 AS new, {UNIT} AS u FROM mem "
    f"JOIN vec ON owner_kind = 'memory' AND owner_id = mem_id WHERE status IN ({quoted(ELIGIBLE[0])}) AND coalesce(mem_type, '') NOT IN ({quoted(ELIGIBLE[1])}) QUALIFY row_number() OVER (PARTITION BY mem_id ORDER BY vec_id) = 1), "
    "p AS (SELECT a.mem_id AS n, b.mem_id AS o, a.scope, a.numbers AS x, b.numbers AS y, a.negative OR b.negative AS negative, round(list_dot_product(a.u, b.u), 6) AS similarity FROM m a JOIN m b USING (scope) WHERE a.new AND a.mem_id <> b.mem_id "
    "QUALIFY row_number() OVER (PARTITION BY a.mem_id ORDER BY round(list_dot_product(a.u, b.u), 6) DESC, b.mem_id) <= 6), "
    "u AS (SELECT DISTINCT least(n, o) AS first_id, greatest(n, o) AS second_id, scope, similarity, negative FROM p WHERE negative OR (similarity >= 0.6 AND x <> '' AND y <> '' AND x <> y)) "
    "SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY scope ORDER BY similarity DESC, first_id, second_id) <= 20"
)
def j17_contradictions(spark, d):
    """The whole rule of J17: eligible neighbours, one side negative at any similarity or near ones whose numbers differ."""
    v = unit_vectors(spark, d, "memory").withColumnRenamed("owner_id", "mem_id")
    m = memories(spark, d, "mem_scope", "mem_type", "status", "content", "supersedes").join(v, "mem_id")
    m = m.where(F.col("status").isin(*ELIGIBLE[0]) & ~F.coalesce("mem_type", F.lit("")).isin(*ELIGIBLE[1])).select(
        "mem_id", F.lower("mem_scope").alias("scope"), T.number_key(F.col("content")).alias("x"), T.has_cue(F.replace("content", F.lit("’"), F.lit("'")), NEGATION_CUES).alias("neg"),
        F.col("u").alias("v"), (F.size("supersedes") > 0).alias("new"),
    )
    p = retrieval.nearest(m.where("new"), m.withColumnRenamed("mem_id", "o"), "mem_id", "o", 6, different=True)
    p = p.join(m.select("mem_id", "scope", "x", "neg"), "mem_id").join(m.select(F.col("mem_id").alias("o"), F.col("x").alias("y"), F.col("neg").alias("other_neg")), "o").withColumn("negative", F.expr("neg or other_neg"))
    p = p.where("negative or (similarity >= 0.6 and x <> '' and y <> '' and x <> y)")
    p = p.select(F.least("mem_id", "o").alias("first_id"), F.greatest("mem_id", "o").alias("second_id"), "scope", "similarity", "negative").distinct()
    return p.withColumn("n", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("similarity"), "first_id", "second_id"))).where("n <= 20").drop("n")


@query(
    f"WITH {KEYWORD_SQL}, x AS (SELECT DISTINCT query_id, unnest(expected) AS mem_id, 1 AS p FROM qry), "
    "g AS (SELECT query_id, mem_id, 2 AS p FROM kw JOIN mem USING (mem_id) WHERE mem_type = 'instruction' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(keyword, 6) DESC, mem_id) <= 10), "
    "a AS (SELECT query_id, mem_id, min(p) AS p FROM (SELECT * FROM x UNION ALL SELECT * FROM g) GROUP BY ALL) "
    "SELECT query_id, mem_id, CASE p WHEN 1 THEN 'search' ELSE 'instruction' END AS channel FROM a"
)
def u1_channel_union(spark, d):
    """Expected memories and the ten most relevant instructions of each question; the first channel that has a memory wins."""
    search = latest_texts(table(spark, d, "queries"), "query_id", "added_at", "query_id", "expected").select("query_id", F.explode(F.array_distinct("expected")).alias("mem_id"), F.lit("search").alias("channel"))
    best = first_rows(searched(spark, d, instructions, "mem_id string, keyword double, wanted int", asked_with(spark, d, "expected")), 10)
    # what is expected, too, is known where the candidates are: nothing is compared afterwards
    return search.unionByName(best.where("wanted = 0").select("query_id", "mem_id", F.lit("instruction").alias("channel")))


def instructions(q, number, k, docs, place):
    """The ten best instructions, and whether each is expected."""
    import numpy as np

    if "number" not in docs:
        docs |= {"instruction": docs["kind"] == "instruction", "number": {m: n for n, m in enumerate(q["ids"].to_pylist())}}
    own = docs["instruction"][number]
    best, score = best_of(10)(q, number[own], k[own], docs, place)
    return [best, score, np.isin(best, [docs["number"][m] for m in q["expected"] or () if m in docs["number"]]).astype(np.int32)]


@query(
    f"WITH {TRN} SELECT turn_id, row_number() OVER (PARTITION BY lower(project) ORDER BY session_id, turn_no, turn_id)::INT AS number FROM trn"
)
def w1_turn_numbers(spark, d):
    w = Window.partitionBy(F.lower("project")).orderBy("session_id", "turn_no", "turn_id")
    return turns(spark, d, "project", "session_id", "turn_no").select("turn_id", F.row_number().over(w).alias("number"))


@query(
    f"WITH {TRN}, s AS (SELECT *, (outline IS NULL)::INT AS start FROM trn), g AS (SELECT *, sum(start) OVER (PARTITION BY session_id ORDER BY turn_no, turn_id ROWS UNBOUNDED PRECEDING) AS seg FROM s) "
    "SELECT session_id, seg::BIGINT AS segment, count(*)::BIGINT AS turns, min(turn_no) AS first_turn, md5(string_agg(text, chr(10) ORDER BY turn_no, turn_id)) AS text_hash FROM g GROUP BY ALL"
)
def w2_segments(spark, d):
    w = Window.partitionBy("session_id").orderBy("turn_no", "turn_id").rowsBetween(Window.unboundedPreceding, 0)
    g = turns(spark, d, "session_id", "turn_no", "text", "outline").withColumn("segment", F.sum(F.col("outline").isNull().cast("bigint")).over(w))
    texts = F.sort_array(F.collect_list(F.struct("turn_no", "turn_id", "text")))
    return g.groupBy("session_id", "segment").agg(
        F.count("*").alias("turns"), F.min("turn_no").alias("first_turn"), F.md5(F.array_join(F.transform(texts, lambda x: x["text"]), "\n")).alias("text_hash")
    )


@query(
    f"WITH {TRN}, e AS (SELECT turn_id, session_id, unnest(excerpts) AS excerpt FROM trn), h AS (SELECT session_id, excerpt, min(turn_id) AS turn_id FROM e GROUP BY ALL) "
    "SELECT session_id, turn_id, excerpt, sha256(excerpt) AS hash, row_number() OVER (PARTITION BY session_id ORDER BY turn_id, excerpt)::INT AS seq FROM h"
)
def s12_excerpts(spark, d):
    e = turns(spark, d, "session_id", "excerpts").select("turn_id", "session_id", F.explode("excerpts").alias("excerpt"))
    h = e.groupBy("session_id", "excerpt").agg(F.min("turn_id").alias("turn_id"))
    return h.select("session_id", "turn_id", "excerpt", F.sha2("excerpt", 256).alias("hash"), F.row_number().over(Window.partitionBy("session_id").orderBy("turn_id", "excerpt")).alias("seq"))


@query(f"WITH {TRN} SELECT session_id, turn_id, n::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY length(text) DESC, turn_id) AS n FROM trn) WHERE n <= 3")
def w3_session_cap(spark, d):
    w = Window.partitionBy("session_id").orderBy(F.desc(F.length("text")), "turn_id")
    return turns(spark, d, "session_id", "text").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("session_id", "turn_id", "rank")


@query(
    f"WITH {MEM}, k AS (SELECT mem_id, lower(mem_scope) AS scope, substr(regexp_replace(created_at, '[^0-9]', '', 'g'), 1, 12) AS k FROM mem), "
    "p AS (SELECT *, dense_rank() OVER (PARTITION BY scope ORDER BY k) AS r FROM k), l AS (SELECT scope, max(r) AS n FROM p GROUP BY 1) "
    "SELECT mem_id, round(CASE WHEN n > 1 THEN 0.08 * (r - 1) / (n - 1) ELSE 0 END, 6)::DOUBLE AS lift FROM p JOIN l USING (scope)"
)
def w4_time_salience(spark, d):
    k = memories(spark, d, "mem_scope", "created_at").select("mem_id", F.lower("mem_scope").alias("scope"), T.date_key(F.col("created_at")).alias("k"))
    p = k.withColumn("r", F.dense_rank().over(Window.partitionBy("scope").orderBy("k")))
    n = F.max("r").over(Window.partitionBy("scope"))
    return p.withColumn("n", n).select("mem_id", F.round(F.when(F.col("n") > 1, 0.08 * (F.col("r") - 1) / (F.col("n") - 1)).otherwise(0.0), 6).alias("lift"))


@query(
    f"WITH {MEM}, b AS (SELECT mem_id, lower(mem_scope) AS scope, created_at, coalesce(confidence, 0) AS c FROM mem), "
    "r AS (SELECT scope, mem_id, 0 AS ranking, row_number() OVER (PARTITION BY scope ORDER BY c DESC, mem_id) AS rank FROM b UNION ALL "
    "SELECT scope, mem_id, 1, row_number() OVER (PARTITION BY scope ORDER BY created_at DESC, mem_id) FROM b), "
    "f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY scope, mem_id ORDER BY rank, ranking) = 1) "
    "SELECT scope, mem_id, row_number() OVER (PARTITION BY scope ORDER BY rank, ranking)::INT AS position FROM f"
)
def w6_interleaved(spark, d):
    b = memories(spark, d, "mem_scope", "created_at", "confidence").select("mem_id", F.lower("mem_scope").alias("scope"), "created_at", F.coalesce("confidence", F.lit(0.0)).alias("c"))
    by = lambda *o: F.row_number().over(Window.partitionBy("scope").orderBy(*o)).alias("rank")
    r = b.select("scope", "mem_id", F.lit(0).alias("ranking"), by(F.desc("c"), "mem_id")).unionByName(b.select("scope", "mem_id", F.lit(1).alias("ranking"), by(F.desc("created_at"), "mem_id")))
    return retrieval.interleaved(r, "scope", "mem_id").select("scope", "mem_id", "position")


@query(
    f"WITH {TRN}, c AS (SELECT session_id, turn_id, sum(length(text) // 4 + 1) OVER (PARTITION BY session_id ORDER BY turn_no, turn_id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM trn) SELECT * FROM c WHERE spent <= 500"
)
def w8_prefix_budget(spark, d):
    t = turns(spark, d, "session_id", "turn_no", "text")
    return retrieval.prefix_budget(t, "session_id", ["turn_no", "turn_id"], F.floor(F.length("text") / 4) + 1, 500).select("session_id", "turn_id", "spent")


@query(
    f"WITH RECURSIVE {TRN}, c AS (SELECT session_id, turn_id, length(text) // 4 + 12 AS cost, row_number() OVER (PARTITION BY session_id ORDER BY turn_no, turn_id) AS n FROM trn), "
    "f AS (SELECT session_id, n, turn_id, (cost <= 400) AS kept, CASE WHEN cost <= 400 THEN cost ELSE 0 END AS used FROM c WHERE n = 1 UNION ALL "
    "SELECT c.session_id, c.n, c.turn_id, f.used + c.cost <= 400, CASE WHEN f.used + c.cost <= 400 THEN f.used + c.cost ELSE f.used END FROM f JOIN c ON c.session_id = f.session_id AND c.n = f.n + 1) "
    "SELECT session_id, turn_id, (row_number() OVER (PARTITION BY session_id ORDER BY n) - 1)::INT AS position FROM f WHERE kept"
)
def w9_greedy_budget(spark, d):
    t = turns(spark, d, "session_id", "turn_no", "text").withColumn("cost", F.floor(F.length("text") / 4) + 12)
    return retrieval.greedy_budget(t, "session_id", ["turn_no", "turn_id"], "turn_id", "cost", 400).select("session_id", "turn_id", "position")


@query(
    f"WITH {TRN}, f AS (SELECT lower(project) AS scope, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS item, turn_id, session_id, turn_no FROM trn) "
    "SELECT scope, item, turn_id FROM f QUALIFY row_number() OVER (PARTITION BY scope, item ORDER BY session_id, turn_no, turn_id) = 1"
)
def w11_first_mentions(spark, d):
    f = turns(spark, d, "project", "session_id", "turn_no", "text").withColumn("item", F.md5(T.normalize(F.col("text")))).withColumn("scope", F.lower("project"))
    first = F.min(F.struct("session_id", "turn_no", "turn_id")).alias("x")
    return f.groupBy("scope", "item").agg(first).select("scope", "item", "x.turn_id")


@query(
    f"WITH {TRN} SELECT session_id, count(*)::BIGINT AS turns, min(turn_no) AS first_turn, max(turn_no) AS last_turn, "
    "md5(string_agg('#' || turn_no || ' ' || substr(text, 1, 140), chr(10) ORDER BY turn_no, turn_id)) AS line_hash FROM trn GROUP BY 1"
)
def w14_timeline(spark, d):
    line = F.concat(F.lit("#"), F.col("turn_no").cast("string"), F.lit(" "), F.substring("text", 1, 140))
    t = turns(spark, d, "session_id", "turn_no", "text").select("session_id", "turn_no", "turn_id", line.alias("line"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn_no", "turn_id", "line"))), lambda x: x["line"])
    return t.groupBy("session_id").agg(F.count("*").alias("turns"), F.min("turn_no").alias("first_turn"), F.max("turn_no").alias("last_turn"), F.md5(F.array_join(lines, "\n")).alias("line_hash"))


@query(
    f"WITH {TRN}, h AS (SELECT session_id, turn_no, turn_id, md5(text) AS h, lag(md5(text)) OVER (PARTITION BY session_id ORDER BY turn_no, turn_id) AS p FROM trn) "
    "SELECT session_id, count(*)::BIGINT AS seen, count(*) FILTER (p = h)::BIGINT AS repeated, arg_max(h, turn_no) AS last_hash FROM h GROUP BY 1"
)
def w18_history_delta(spark, d):
    w = Window.partitionBy("session_id").orderBy("turn_no", "turn_id")
    h = turns(spark, d, "session_id", "turn_no", "text").withColumn("h", F.md5("text")).withColumn("p", F.lag("h").over(w))
    return h.groupBy("session_id").agg(F.count("*").alias("seen"), F.count_if(F.col("p") == F.col("h")).alias("repeated"), F.max_by("h", "turn_no").alias("last_hash"))


@query(
    f"WITH {MEM} SELECT mem_id, row_number() OVER (PARTITION BY lower(mem_scope) ORDER BY created_at NULLS LAST, mem_id)::INT AS mention_position, "
    "row_number() OVER (PARTITION BY lower(mem_scope) ORDER BY updated_at NULLS FIRST, created_at, mem_id)::INT AS temporal_position FROM mem"
)
def t6_t7_orders(spark, d):
    m = memories(spark, d, "mem_scope", "created_at", "updated_at")
    s = Window.partitionBy(F.lower("mem_scope"))
    return m.select(
        "mem_id", F.row_number().over(s.orderBy(F.asc_nulls_last("created_at"), "mem_id")).alias("mention_position"),
        F.row_number().over(s.orderBy(F.asc_nulls_first("updated_at"), "created_at", "mem_id")).alias("temporal_position"),
    )


@query()
def o1_topic_groups(spark, d):
    """Greedy topic groups over each question's five nearest memories."""
    v = unit_vectors(spark, d, "memory").select(F.col("owner_id").alias("mem_id"), F.col("u").alias("v"))
    return retrieval.topic_groups(j8_semantic_recall(spark, d).join(v, "mem_id", "left"))


BOOST = "CASE WHEN agg AND mem_type IN ('digest', 'dossier') THEN 0.15 ELSE 0 END"


@query(
    f"WITH {KEYWORD_SQL}, i AS (SELECT query_id, {_cue_sql('query', INTENT_CUES['temporal'])} AS tmp, {_cue_sql('query', INTENT_CUES['aggregate'])} AS agg FROM qry), "
    f"s AS (SELECT query_id, mem_id, round(keyword * CASE WHEN status = 'superseded' THEN 0.9 ELSE 1 END + {BOOST}, 6) AS score FROM kw JOIN i USING (query_id) JOIN mem USING (mem_id) "
    "WHERE coalesce(mem_type, '') <> 'summary' AND (status IN ('active', 'contested') OR tmp AND status = 'superseded')) "
    "SELECT query_id, mem_id, score, n::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mem_id) AS n FROM s) WHERE n <= 3"
)
def r6_adjusted_recall(spark, d):
    """Keyword recall of usable memories: superseded ones count 0.9 and only for questions about time, digests gain 0.15 for questions about totals."""
    cue = lambda name: T.has_cue(F.col("query"), INTENT_CUES[name])
    best = searched(spark, d, adjusted, "mem_id string, score double", asked_with(spark, d, cue("temporal").alias("past"), cue("aggregate").alias("aggregate")))
    return first_rows(best, 3, "score").select("query_id", "mem_id", "score", "rank")


def adjusted(q, number, k, docs, place):
    """The three best usable candidates by their adjusted score."""
    import numpy as np

    m = _kinds(docs)
    if "digest" not in m:
        m["digest"] = np.isin(m["kind"].astype(str), ("digest", "dossier"))
    good = ~m["summary"][number] & (m["live"][number] | (m["old"][number] & bool(q["past"])))
    number, k = number[good], k[good]
    score = k * np.where(m["old"][number], 0.9, 1.0) + np.where(m["digest"][number] & bool(q["aggregate"]), 0.15, 0.0)
    return best_of(3)(q, number, np.floor(score * 1e6 + 0.5) / 1e6, docs, place)


TURN_SQL = KEYWORD_SQL.replace(terms_sql("mem", "mem_id", BODY, ", lower(mem_scope) AS scope"), terms_sql("(SELECT turn_id, text, coalesce(lower(project), '-') AS scope FROM trn)", "turn_id", "text", ", scope")).replace(MEM, TRN)
TURN_SQL = TURN_SQL.replace("mem_id", "turn_id").replace("FROM mem)", "FROM trn)").replace(SCOPES, "coalesce(lower(project), '-') AS scope")


@query(
    f"WITH {TURN_SQL}, b AS (SELECT query_id, turn_id, session_id, keyword FROM kw JOIN trn USING (turn_id) WHERE keyword >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id, session_id ORDER BY keyword DESC, turn_id) = 1) "
    "SELECT query_id, turn_id, keyword, n::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY keyword DESC, turn_id) AS n FROM b) WHERE n <= 5"
)
def r7_turn_recall(spark, d):
    """Conversation turns of the question's own project by keyword, at most one per session."""
    t = latest_texts(table(spark, d, "turns"), "turn_id", "ingested_at", "turn_id", "project", "session_id", "text")
    docs = t.select(F.col("turn_id").cast("string").alias("mem_id"), F.coalesce(F.lower("project"), F.lit(index.NOWHERE)).alias("scope"), "text", "session_id", "turn_id")
    rows = stored(spark, d, "stored turns", docs, "session_id", "turn_id")
    kind = dict(docs.dtypes)
    hits = index.searched(rows, asked_with(spark, d), per_session, f"turn_id {kind['turn_id']}, session_id {kind['session_id']}, keyword double", exact=True)
    first = F.row_number().over(Window.partitionBy("query_id", "session_id").orderBy(F.desc("keyword"), "turn_id"))
    return index.top(hits.withColumn("n", first).where("n = 1"), "query_id", "keyword", "turn_id", 5).select("query_id", "turn_id", "keyword", "rank")


def per_session(q, number, k, docs, place):
    """The five best turns with a score of 0.3 or more, one of a session; ties by turn_id."""
    import numpy as np

    good = np.flatnonzero(k >= 0.3)
    if not len(good):
        return None
    order = good[np.lexsort((docs["turn_id"][number[good]], -k[good]))]
    seen, out = set(), []
    for at in order:
        session = docs["session_id"][number[at]]
        if session not in seen:
            seen.add(session)
            out.append(at)
            if len(out) == 5:
                break
    return [docs["turn_id"][number[out]], docs["session_id"][number[out]], k[out]]
