"""Consolidation, accounting, evaluation and stream-shaped queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.functions.lists import DERIVED_TYPES, MEMORY_TYPES, TOPIC_THRESHOLDS
from mnemospark.operators import blocking, evaluation, retrieval
from mnemospark.plans.registry import EVL, MEM, QRY, TRN, VEC, query, quoted
from mnemospark.plans.text_queries import memories, questions, turns
from mnemospark.sources.tables import latest, table


TIE = 1e-9  # a mean of doubles on a rounding boundary falls on one side whatever the order of the sum


def runs(spark, d, *columns):
    return latest(table(spark, d, "eval_rows"), "row_id", "arrived_at", "row_id", *columns)


@query(
    f"WITH {MEM}, {TRN}, {EVL} SELECT (SELECT count(*) FROM mem)::BIGINT AS memories, (SELECT count(*) FROM trn)::BIGINT AS turns, (SELECT count(DISTINCT session_id) FROM trn)::BIGINT AS sessions, "
    "count(*)::BIGINT AS steps, coalesce(sum(kept_tokens) FILTER (kept_tokens < 1000000), 0)::BIGINT AS tokens, count(*) FILTER (coalesce(error, '') <> '')::BIGINT AS errors FROM evl"
)
def a3_global_stats(spark, d):
    m = memories(spark, d).agg(F.count("*").alias("memories"))
    t = turns(spark, d, "session_id").agg(F.count("*").alias("turns"), F.count_distinct("session_id").alias("sessions"))
    e = runs(spark, d, "kept_tokens", "error").agg(
        F.count("*").alias("steps"), F.coalesce(F.sum(F.when(F.col("kept_tokens") < 1000000, F.col("kept_tokens"))), F.lit(0)).alias("tokens"),
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"),
    )
    return m.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(e))


@query(f"WITH {EVL} SELECT run_day, count(*)::BIGINT AS calls, (count(*) > 200) AS over_budget FROM evl GROUP BY 1")
def k8_daily_calls(spark, d):
    return runs(spark, d, "run_day").groupBy("run_day").agg(F.count("*").alias("calls"), (F.count("*") > 200).alias("over_budget"))


@query(
    f"WITH {MEM}, t AS (SELECT unnest(topics) AS topic, content, mem_id FROM mem) SELECT topic, count(*)::BIGINT AS mentions, arg_min(mem_id, (length(content), mem_id)) AS shortest "
    "FROM t GROUP BY topic ORDER BY mentions DESC, topic LIMIT 20"
)
def a6_topic_frequency(spark, d):
    t = memories(spark, d, "topics", "content").select("mem_id", F.explode("topics").alias("topic"), F.length("content").alias("n"))
    return t.groupBy("topic").agg(F.count("*").alias("mentions"), F.min(F.struct("n", "mem_id")).alias("x")).select("topic", "mentions", F.col("x.mem_id").alias("shortest")).orderBy(F.desc("mentions"), "topic").limit(20)


@query(
    f"WITH {MEM}, t AS (SELECT DISTINCT lower(mem_scope) AS scope, unnest(topics) AS topic, mem_id, coalesce(title, '') AS title, created_at FROM mem WHERE coalesce(mem_type, '') NOT IN ({quoted(DERIVED_TYPES)})), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY scope, topic ORDER BY created_at DESC, mem_id DESC) AS n, count(*) OVER (PARTITION BY scope, topic) AS c FROM t) "
    "SELECT scope, topic, max(c)::BIGINT AS members, md5(string_agg('- ' || substr(title, 1, greatest(90, least(200, 3200 // c))::INT), chr(10) ORDER BY created_at, mem_id)) AS digest FROM r WHERE c >= 3 AND n <= 35 GROUP BY ALL"
)
def a7_topic_digests(spark, d):
    from mnemospark.operators.consolidation import topic_digests

    m = memories(spark, d, "mem_scope", "mem_type", "title", "topics", "created_at")
    return topic_digests(m).select("scope", "topic", "members", F.md5("digest").alias("digest"))


@query(
    f"WITH {MEM}, t AS (SELECT DISTINCT lower(mem_scope) AS scope, unnest(topics) AS topic, mem_id, ingested_at < TIMESTAMPTZ '2025-01-01' AS before FROM mem WHERE coalesce(mem_type, '') NOT IN ({quoted(DERIVED_TYPES)})), "
    "c AS (SELECT scope, topic, count(*) AS n, count(*) FILTER (before) AS last FROM t GROUP BY ALL) "
    f"SELECT scope, topic, last::BIGINT AS earlier, n::BIGINT AS members FROM c WHERE len([t for t in {TOPIC_THRESHOLDS} if last < t AND n >= t]) > 0"
)
def a8_due_topics(spark, d):
    t = memories(spark, d, "mem_scope", "mem_type", "topics", "ingested_at").where(~F.coalesce("mem_type", F.lit("")).isin(DERIVED_TYPES))
    t = t.select(F.lower("mem_scope").alias("scope"), F.explode(F.array_distinct("topics")).alias("topic"), (F.col("ingested_at") < F.lit("2025-01-01").cast("timestamp")).alias("before"))
    c = t.groupBy("scope", "topic").agg(F.count_if("before").alias("earlier"), F.count("*").alias("members"))
    steps = F.array(*[F.lit(x) for x in TOPIC_THRESHOLDS])
    return c.where(F.exists(steps, lambda s: (F.col("earlier") < s) & (F.col("members") >= s)))


@query(
    f"WITH {MEM}, n AS (SELECT mem_id, lower(mem_scope) AS scope, coalesce(mem_type, '') AS kind, md5(lower(trim(regexp_replace(content, '\\s+', ' ', 'g')))) AS h FROM mem) "
    "SELECT mem_id, first_id FROM (SELECT mem_id, min(mem_id) OVER (PARTITION BY scope, kind, h) AS first_id FROM n) WHERE mem_id <> first_id"
)
def a11_exact_duplicates(spark, d):
    from mnemospark.operators.consolidation import exact_duplicates

    return exact_duplicates(memories(spark, d, "mem_scope", "mem_type", "content"))


@query(
    f"WITH {MEM}, {QRY}, t AS (SELECT DISTINCT unnest(topics) AS topic FROM mem), q AS (SELECT lower(query) AS q FROM qry), n AS (SELECT count(*) AS n FROM q) "
    "SELECT topic, count(*)::BIGINT AS fired, max(n.n)::BIGINT AS steps, count(*) > 0.05 * max(n.n) AS broad FROM t JOIN q ON contains(q.q, t.topic) CROSS JOIN n GROUP BY 1"
)
def a13_trigger_breadth(spark, d):
    """Keyword triggers (topics) against all questions, which meet on four characters."""
    t = memories(spark, d, "topics").select(F.explode("topics").alias("topic")).distinct()
    q = questions(spark, d, "query").select("query_id", F.lower("query").alias("q"))
    n = q.agg(F.count("*").alias("n"))
    fired = blocking.containing(q, "query_id", "q", t.select("topic", F.col("topic").alias("pattern")), "topic", "pattern").groupBy("topic").agg(F.count("*").alias("fired"))
    return fired.crossJoin(F.broadcast(n)).select("topic", "fired", F.col("n").alias("steps"), (F.col("fired") > 0.05 * F.col("n")).alias("broad"))


@query(
    f"WITH {MEM} SELECT mem_id, rank() OVER (PARTITION BY lower(mem_scope) ORDER BY created_at)::INT AS mention_rank FROM mem WHERE coalesce(mem_type, '') NOT IN ({quoted(DERIVED_TYPES)})"
)
def a14_mention_rank(spark, d):
    m = memories(spark, d, "mem_scope", "mem_type", "created_at").where(~F.coalesce("mem_type", F.lit("")).isin(DERIVED_TYPES))
    return m.select("mem_id", F.rank().over(Window.partitionBy(F.lower("mem_scope")).orderBy("created_at")).alias("mention_rank"))


@query(f"WITH {TRN} SELECT session_id, min(turn_no) AS first_turn, max(turn_no) AS last_turn, max(turn_no) - min(turn_no) + 1 - count(DISTINCT turn_no) AS missing FROM trn GROUP BY 1")
def a15_session_spans(spark, d):
    t = turns(spark, d, "session_id", "turn_no")
    lo, hi = F.min("turn_no"), F.max("turn_no")
    return t.groupBy("session_id").agg(lo.alias("first_turn"), hi.alias("last_turn"), (hi - lo + 1 - F.count_distinct("turn_no")).alias("missing"))


@query(f"WITH {MEM} SELECT DISTINCT lower(mem_scope) AS scope, unnest(topics) AS topic FROM mem")
def a16_scope_topics(spark, d):
    return memories(spark, d, "mem_scope", "topics").select(F.lower("mem_scope").alias("scope"), F.explode("topics").alias("topic")).distinct()


@query(
    f"WITH {EVL} SELECT question_type, count(*)::BIGINT AS rows, round(avg((score >= 0.5)::INT), 6) AS hit_rate, round(avg((coalesce(kept_items, 0) = 0)::INT), 6) AS abstained, "
    "round(sum(score) / nullif(count(score), 0) + 1e-9, 6) AS mean_score FROM evl GROUP BY 1"
)
def a20_replay_metrics(spark, d):
    e = runs(spark, d, "question_type", "kept_items", "score")
    return e.groupBy("question_type").agg(
        F.count("*").alias("rows"), F.round(F.avg((F.col("score") >= 0.5).cast("int")), 6).alias("hit_rate"),
        F.round(F.avg((F.coalesce("kept_items", F.lit(0)) == 0).cast("int")), 6).alias("abstained"), F.round(F.avg("score") + TIE, 6).alias("mean_score"),
    )


@query(
    f"WITH {EVL}, r AS (SELECT run_id, score, row_number() OVER (PARTITION BY run_id ORDER BY score) AS r, count(*) OVER (PARTITION BY run_id) AS n FROM evl WHERE score IS NOT NULL) "
    "SELECT run_id, score AS percentile, n::BIGINT AS n FROM r WHERE r = floor((n - 1) * 0.95) + 1"
)
def a21_percentile_by_rank(spark, d):
    return evaluation.nth_percentile(runs(spark, d, "run_id", "score"), "run_id", "score", 0.95)


@query(f"WITH {EVL}, m AS (SELECT run_id, question_type, avg(score) AS s FROM evl GROUP BY ALL) SELECT run_id, round(avg(s) + 1e-9, 6) AS macro, count(s)::BIGINT AS abilities FROM m GROUP BY 1")
def a22_macro_average(spark, d):
    m = runs(spark, d, "run_id", "question_type", "score").groupBy("run_id", "question_type").agg(F.avg("score").alias("s"))
    return m.groupBy("run_id").agg(F.round(F.avg("s") + TIE, 6).alias("macro"), F.count("s").alias("abilities"))


WILSON = "((s / n + 1.9208 / n) {} 1.96 * sqrt(s / n * (1 - s / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)"


@query(
    f"WITH {EVL}, c AS (SELECT question_type, count(*)::DOUBLE AS n, count(*) FILTER (score >= 0.5)::DOUBLE AS s FROM evl GROUP BY 1) "
    f"SELECT question_type, n::BIGINT AS n, s::BIGINT AS successes, round({WILSON.format('-')}, 6) AS low, round({WILSON.format('+')}, 6) AS high FROM c"
)
def a23_wilson(spark, d):
    c = runs(spark, d, "question_type", "score").groupBy("question_type").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.5).alias("successes"))
    low, high = evaluation.wilson(F.col("successes").cast("double"), F.col("n").cast("double"))
    return c.select("question_type", "n", "successes", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(
    f"WITH {TRN}, p AS (SELECT a.session_id, sign(a.turn_no - b.turn_no) AS x, sign(length(a.text) - length(b.text)) AS y FROM trn a JOIN trn b ON a.session_id = b.session_id AND a.turn_id < b.turn_id) "
    "SELECT session_id, count(*)::BIGINT AS pairs, round(sum(x * y) / nullif(sqrt(sum(abs(x)) * sum(abs(y))), 0), 6) AS tau FROM p GROUP BY 1"
)
def a24_kendall(spark, d):
    t = turns(spark, d, "session_id", "turn_no", "text").select("session_id", "turn_id", F.col("turn_no").cast("double").alias("x"), F.length("text").cast("double").alias("y"))
    return evaluation.kendall_tau_b(t, "session_id", "turn_id", "x", "y")


ARM = "CASE WHEN right(run_id, 1) IN ('0', '2', '4', '6', '8') THEN 'a' ELSE 'b' END"


@query(
    f"WITH {EVL}, x AS (SELECT *, {ARM} AS arm FROM evl) SELECT question_type, arm, count(*)::BIGINT AS runs, count(*) FILTER (score >= 0.5)::BIGINT AS successes, "
    "coalesce(sum(kept_tokens) FILTER (kept_tokens < 1000000), 0)::BIGINT AS tokens, round(coalesce(sum(kept_tokens) FILTER (kept_tokens < 1000000), 0) / nullif(count(*) FILTER (score >= 0.5), 0), 6) AS tokens_per_success FROM x GROUP BY ALL"
)
def a25_arm_summary(spark, d):
    arm = F.when(F.right("run_id", F.lit(1)).isin("0", "2", "4", "6", "8"), "a").otherwise("b")
    tokens = F.coalesce(F.sum(F.when(F.col("kept_tokens") < 1000000, F.col("kept_tokens"))), F.lit(0))
    good = F.count_if(F.col("score") >= 0.5)
    return runs(spark, d, "run_id", "question_type", "kept_tokens", "score").groupBy("question_type", arm.alias("arm")).agg(
        F.count("*").alias("runs"), good.alias("successes"), tokens.alias("tokens"), F.round(tokens / F.nullif(good, F.lit(0)), 6).alias("tokens_per_success")
    )


@query(
    f"WITH {TRN}, t AS (SELECT project, sum(ceil(length(text) / 4.0)) AS text, sum(ceil(length(coalesce(note, '')) / 4.0)) AS note, sum(ceil(length(coalesce(outline, '')) / 4.0)) AS outline FROM trn GROUP BY 1) "
    "SELECT project, (text + note + outline)::BIGINT AS tokens, round(text / (text + note + outline), 6) AS text_share, round(note / (text + note + outline), 6) AS note_share FROM t"
)
def a26_token_attribution(spark, d):
    def tokens(c):
        return F.sum(F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4))

    t = turns(spark, d, "project", "text", "note", "outline").groupBy("project").agg(tokens("text").alias("text"), tokens("note").alias("note"), tokens("outline").alias("outline"))
    total = F.col("text") + F.col("note") + F.col("outline")
    return t.select("project", total.alias("tokens"), F.round(F.col("text") / total, 6).alias("text_share"), F.round(F.col("note") / total, 6).alias("note_share"))


RESULT = "CASE WHEN coalesce(error, '') <> '' THEN split_part(error, ':', 1) WHEN score >= 0.5 THEN 'success' ELSE 'miss' END"


def _result():
    return F.when(F.coalesce("error", F.lit("")) != "", F.substring_index("error", ":", 1)).when(F.col("score") >= 0.5, "success").otherwise("miss")


@query(f"WITH {EVL} SELECT {RESULT} AS result, count(*)::BIGINT AS rows, count(DISTINCT question_id)::BIGINT AS questions, sum(kept_items)::BIGINT AS items FROM evl GROUP BY 1")
def a27_results(spark, d):
    return runs(spark, d, "error", "score", "question_id", "kept_items").groupBy(_result().alias("result")).agg(
        F.count("*").alias("rows"), F.count_distinct("question_id").alias("questions"), F.sum("kept_items").alias("items")
    )


@query(
    f"WITH {EVL}, s AS (SELECT run_day, count(*) AS rows, count(DISTINCT project) AS participants, avg((score >= 0.5)::INT) AS good FROM evl GROUP BY 1) "
    "SELECT run_day, rows::BIGINT AS rows, participants::BIGINT AS participants, dayofweek(run_day) BETWEEN 1 AND 5 AS workday, CASE WHEN participants < 5 THEN 'unclear' WHEN good >= 0.5 THEN 'pass' ELSE 'fail' END AS verdict FROM s"
)
def a28_daily_snapshot(spark, d):
    s = runs(spark, d, "run_day", "project", "score").groupBy("run_day").agg(F.count("*").alias("rows"), F.count_distinct("project").alias("participants"), F.avg((F.col("score") >= 0.5).cast("int")).alias("good"))
    verdict = F.when(F.col("participants") < 5, "unclear").when(F.col("good") >= 0.5, "pass").otherwise("fail")
    return s.select("run_day", "rows", "participants", F.dayofweek("run_day").between(2, 6).alias("workday"), verdict.alias("verdict"))


@query(
    f"WITH {EVL} SELECT question_type, count(*) FILTER ({RESULT} = 'success')::BIGINT AS success, count(*) FILTER ({RESULT} = 'miss')::BIGINT AS miss, count(*) FILTER (coalesce(error, '') <> '')::BIGINT AS failed FROM evl GROUP BY 1"
)
def a29_contingency(spark, d):
    e = runs(spark, d, "question_type", "error", "score").withColumn("r", F.when(F.coalesce("error", F.lit("")) != "", "failed").otherwise(_result()))
    return e.groupBy("question_type").pivot("r", ["success", "miss", "failed"]).count().na.fill(0, ["success", "miss", "failed"])


@query(
    f"WITH {EVL}, {QRY}, u AS (SELECT question_id, count(*) AS used, count(score) AS labelled, count(*) FILTER (score > 0) AS helpful FROM evl GROUP BY 1) "
    "SELECT query_id, coalesce(used, 0)::BIGINT AS used, coalesce(labelled, 0)::BIGINT AS labelled, coalesce(helpful, 0)::BIGINT AS helpful, coalesce(used >= 10 AND labelled >= 5 AND helpful / labelled < 0.1, false) AS weak FROM qry LEFT JOIN u ON query_id = question_id"
)
def j1_usage_counts(spark, d):
    u = runs(spark, d, "question_id", "score").groupBy("question_id").agg(F.count("*").alias("used"), F.count("score").alias("labelled"), F.count_if(F.col("score") > 0).alias("helpful"))
    j = questions(spark, d).join(u, F.col("query_id") == F.col("question_id"), "left")
    weak = F.coalesce((F.col("used") >= 10) & (F.col("labelled") >= 5) & (F.col("helpful") / F.col("labelled") < 0.1), F.lit(False))
    return j.select("query_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("used", "labelled", "helpful")], weak.alias("weak"))


@query(
    f"WITH {EVL}, {QRY} SELECT question_id, max(score) AS utility, min(run_day) AS first_day, any_value(category) AS category FROM evl JOIN qry ON question_id = query_id JOIN projects p ON p.project = evl.project "
    "WHERE coalesce(error, '') = '' AND kept_items > 0 GROUP BY 1"
)
def j2_labelled_samples(spark, d):
    e = runs(spark, d, "question_id", "project", "error", "kept_items", "score", "run_day").where((F.coalesce("error", F.lit("")) == "") & (F.col("kept_items") > 0))
    p = table(spark, d, "projects").select("project")
    per = e.join(p, "project", "left_semi").groupBy("question_id").agg(F.max("score").alias("utility"), F.min("run_day").alias("first_day"))
    return per.join(questions(spark, d, "category"), F.col("question_id") == F.col("query_id")).select("question_id", "utility", "first_day", "category")


@query(
    "SELECT c_custkey, count(DISTINCT o_orderkey)::BIGINT AS steps, count(l_orderkey)::BIGINT AS usages, (count(DISTINCT o_orderkey) - count(DISTINCT l_orderkey))::BIGINT AS missing, coalesce(round(sum(l_quantity), 6), 0) AS tokens "
    "FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"
)
def j3_usage_chain(spark, d):
    """Left-outer chain actors - steps - usage; usage is summed per step before it meets the steps."""
    use = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    step = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(use, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    per = step.groupBy("o_custkey").agg(F.count("*").alias("steps"), F.sum("n").alias("usages"), F.count_if(F.col("n").isNull()).alias("missing"), F.sum("q").alias("tokens"))
    j = table(spark, d, "customer").select("c_custkey").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("steps", "usages", "missing")], F.coalesce(F.round("tokens", 6), F.lit(0.0)).alias("tokens"))


@query(
    f"WITH {TRN}, k AS (SELECT session_id, turn_id, substr(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 120) AS k, note FROM trn) "
    "SELECT a.turn_id, count(*)::BIGINT AS notes, min(b.note) AS note FROM k a JOIN k b ON a.session_id = b.session_id AND a.k = b.k AND b.note IS NOT NULL GROUP BY 1"
)
def j19_turn_notes(spark, d):
    k = turns(spark, d, "session_id", "text", "note").select("session_id", "turn_id", F.substring(T.normalize(F.col("text")), 1, 120).alias("k"), "note")
    notes = k.where("note is not null").groupBy("session_id", "k").agg(F.count("*").alias("notes"), F.min("note").alias("note"))
    return k.select("session_id", "turn_id", "k").join(notes, ["session_id", "k"]).select("turn_id", "notes", "note")


@query(f"WITH {MEM}, {VEC} SELECT mem_id FROM mem WHERE mem_id NOT IN (SELECT owner_id FROM vec WHERE owner_kind = 'memory' AND owner_id IS NOT NULL)")
def j20_missing_vectors(spark, d):
    from mnemospark.functions.vectors import usable

    v = latest(table(spark, d, "index_vectors"), "vec_id", "embedded_at", "vec_id", "owner_id", "owner_kind", "vector").where((F.col("owner_kind") == "memory") & usable(F.col("vector"), 64))
    return memories(spark, d).join(v.select(F.col("owner_id").alias("mem_id")), "mem_id", "left_anti").select("mem_id")


@query(f"WITH {EVL}, {QRY} SELECT query_id, category FROM qry WHERE query_id IN (SELECT question_id FROM evl WHERE score >= 0.5)")
def j21_accepted_feedback(spark, d):
    good = runs(spark, d, "question_id", "score").where("score >= 0.5").select(F.col("question_id").alias("query_id"))
    return questions(spark, d, "category").join(good, "query_id", "left_semi")


@query(
    f"WITH {MEM}, t AS (SELECT lower(mem_scope) AS scope, unnest(topics) AS topic, created_at, mem_id, confidence FROM mem) "
    "SELECT scope, topic, mem_id AS latest, confidence FROM t QUALIFY row_number() OVER (PARTITION BY scope, topic ORDER BY created_at DESC, mem_id DESC) = 1"
)
def j23_latest_values(spark, d):
    t = memories(spark, d, "mem_scope", "topics", "created_at", "confidence").select(F.lower("mem_scope").alias("scope"), F.explode("topics").alias("topic"), "created_at", "mem_id", "confidence")
    return t.groupBy("scope", "topic").agg(F.max(F.struct("created_at", "mem_id", "confidence")).alias("x")).select("scope", "topic", F.col("x.mem_id").alias("latest"), "x.confidence")


@query(
    f"WITH {MEM}, {QRY}, e AS (SELECT query_id, unnest(expected) AS mem_id, generate_subscripts(expected, 1) AS n FROM qry) "
    "SELECT query_id, count(*)::BIGINT AS evidence, md5(string_agg(content, chr(10) ORDER BY n)) AS context FROM e JOIN mem USING (mem_id) GROUP BY 1"
)
def j24_gold_evidence(spark, d):
    e = questions(spark, d, "expected").select("query_id", F.posexplode("expected").alias("n", "mem_id"))
    j = e.join(memories(spark, d, "content"), "mem_id")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("n", "content"))), lambda x: x["content"])
    return j.groupBy("query_id").agg(F.count("*").alias("evidence"), F.md5(F.array_join(texts, "\n")).alias("context"))


@query(
    f"WITH {MEM}, s AS (SELECT lower(mem_scope) AS scope, mem_type, status, source, length(content) AS n, strlen(content) AS b FROM mem) "
    f"SELECT scope, count(*)::BIGINT AS proposals, count(*) FILTER (mem_type IN ({quoted(MEMORY_TYPES)}) AND n >= 10 AND b <= 4000)::BIGINT AS valid, "
    "count(*) FILTER (source <> 'user' AND mem_type IN ('rule', 'intent'))::BIGINT AS for_review FROM s GROUP BY 1"
)
def f16_proposals(spark, d):
    m = memories(spark, d, "mem_scope", "mem_type", "source", "content")
    ok = F.col("mem_type").isin(MEMORY_TYPES) & (F.length("content") >= 10) & (F.octet_length("content") <= 4000)
    return m.groupBy(F.lower("mem_scope").alias("scope")).agg(
        F.count("*").alias("proposals"), F.count_if(ok).alias("valid"), F.count_if((F.col("source") != "user") & F.col("mem_type").isin("rule", "intent")).alias("for_review")
    )


@query(f"WITH {MEM} SELECT regexp_full_match(mem_id, 'mem_[0-9A-Za-z]{{26}}') AS valid, count(*)::BIGINT AS memories FROM mem GROUP BY 1")
def f22_valid_ids(spark, d):
    return memories(spark, d).groupBy(F.col("mem_id").rlike("^mem_[0-9A-Za-z]{26}$").alias("valid")).agg(F.count("*").alias("memories"))


GRAMS = "[list_reduce(w[i:i+3], lambda a, b: a || ' ' || b) for i in range(1, len(w) - 2)]"


@query(
    f"WITH {MEM}, {QRY}, e AS (SELECT query_id, query, unnest(expected) AS mem_id FROM qry), p AS (SELECT query_id, regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+') AS w, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS c "
    "FROM e JOIN mem USING (mem_id)), g AS (SELECT query_id, array_to_string(w[i::INT:(i+3)::INT], ' ') AS q, c FROM (SELECT query_id, w, c, unnest(range(1, len(w) - 2)) AS i FROM p)) "
    "SELECT query_id, bool_or(contains(' ' || array_to_string(c, ' ') || ' ', ' ' || q || ' ')) AS copies FROM g GROUP BY 1"
)
def f25_copied_questions(spark, d):
    """Questions that share four words in a row with a memory they expect."""
    e = questions(spark, d, "query", "expected").select("query_id", "query", F.explode("expected").alias("mem_id")).join(memories(spark, d, "content"), "mem_id")
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    p = e.select("query_id", words("query").alias("w"), F.concat(F.lit(" "), F.array_join(words("content"), " "), F.lit(" ")).alias("c")).where(F.size("w") >= 4)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda i: F.concat(F.lit(" "), F.array_join(F.slice("w", i, 4), " "), F.lit(" ")))
    return p.select("query_id", F.exists(grams, lambda g: F.contains(F.col("c"), g)).alias("copies")).groupBy("query_id").agg(F.bool_or("copies").alias("copies"))


@query(
    "WITH s AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), "
    "g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM s) SELECT user_id, n::BIGINT AS session, count(*)::BIGINT AS events, epoch_us(min(ts))::BIGINT AS opened, epoch_us(max(ts))::BIGINT AS last_seen FROM g GROUP BY ALL"
)
def k4_idle_sessions(spark, d):
    """A session closes when nothing came for ten minutes; equality closes it."""
    from mnemospark.streaming.sessions import idle_sessions

    s = idle_sessions(table(spark, d, "events").where("user_id is not null and ts is not null"), "user_id", "ts", "event_id", 600)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.unix_micros(F.min("ts").cast("timestamp")).alias("opened"), F.unix_micros(F.max("ts").cast("timestamp")).alias("last_seen"))


@query(
    "WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id) AS attempts FROM events) "
    "SELECT user_id, CASE WHEN event_type = 'error' AND attempts >= 3 THEN 'failed' WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'signup' THEN 'pending' ELSE 'open' END AS status, attempts::BIGINT AS attempts FROM e WHERE n = 1"
)
def k5_session_status(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x"), F.count_if(F.col("event_type") == "error").alias("attempts"))
    t = F.col("x.event_type")
    status = F.when((t == "error") & (F.col("attempts") >= 3), "failed").when(t == "purchase", "done").when(t == "signup", "pending").otherwise("open")
    return e.select("user_id", status.alias("status"), "attempts")


@query("SELECT event_id, user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000")
def s9_recent_features(spark, d):
    e = table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(2000)
    return e.select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query(
    f"WITH {QRY}, s AS (SELECT query_id, category, row_number() OVER (PARTITION BY category ORDER BY md5(query_id || '-7'), query_id) AS n FROM qry) SELECT query_id, category FROM s WHERE n <= 40"
)
def e1_stratified_sample(spark, d):
    """An equal number of questions per category, by seeded hash order (a sampling operator)."""
    order = Window.partitionBy("category").orderBy(F.md5(F.concat("query_id", F.lit("-7"))), "query_id")
    return questions(spark, d, "category").withColumn("n", F.row_number().over(order)).where("n <= 40").drop("n")


@query(
    f"WITH {QRY}, c AS (SELECT category, count(*) AS questions FROM qry GROUP BY 1), x AS (SELECT *, questions * 100.0::DOUBLE / sum(questions) OVER () AS e FROM c), f AS (SELECT *, floor(e) AS s FROM x) "
    "SELECT category, questions::BIGINT AS questions, (s + (row_number() OVER (ORDER BY round(e - s, 9) DESC, category) <= 100 - sum(s) OVER ())::INT)::BIGINT AS seats FROM f"
)
def e2_proportional_seats(spark, d):
    c = questions(spark, d, "category").groupBy("category").agg(F.count("*").alias("questions"))
    return evaluation.largest_remainder(c, "category", "questions", 100)


@query(
    f"WITH {MEM} SELECT source, status, CASE WHEN status = 'pending_review' THEN 'active' WHEN status = 'active' AND confidence < 0.3 THEN 'contested' ELSE status END AS next_status, "
    "round(sum(greatest(0.1, coalesce(confidence, 0.6) - CASE WHEN status = 'contested' THEN 0.2 ELSE 0 END)), 6) AS confidence, count(*)::BIGINT AS memories FROM mem GROUP BY ALL"
)
def c13_review(spark, d):
    m = memories(spark, d, "source", "status", "confidence")
    nxt = F.when(F.col("status") == "pending_review", "active").when((F.col("status") == "active") & (F.col("confidence") < 0.3), "contested").otherwise(F.col("status"))
    conf = F.greatest(F.lit(0.1), F.coalesce("confidence", F.lit(0.6)) - F.when(F.col("status") == "contested", 0.2).otherwise(0.0))
    return m.groupBy("source", "status", nxt.alias("next_status")).agg(F.round(F.sum(conf), 6).alias("confidence"), F.count("*").alias("memories"))


@query(
    f"WITH {MEM}, t AS (SELECT lower(mem_scope) AS scope, unnest(topics) AS topic, ingested_at < TIMESTAMPTZ '2025-01-01' AS old FROM mem), c AS (SELECT scope, topic, count(*) AS n, count(*) FILTER (old) AS was FROM t GROUP BY ALL) "
    "SELECT scope, topic, n::BIGINT AS records, was::BIGINT AS written_at, (was < 8 AND n >= 8) OR (was >= 8 AND (n >= 1.5 * was OR n >= was + 15)) AS stale FROM c"
)
def c9_stale_overviews(spark, d):
    t = memories(spark, d, "mem_scope", "topics", "ingested_at").select(F.lower("mem_scope").alias("scope"), F.explode("topics").alias("topic"), (F.col("ingested_at") < F.lit("2025-01-01").cast("timestamp")).alias("old"))
    c = t.groupBy("scope", "topic").agg(F.count("*").alias("records"), F.count_if("old").alias("written_at"))
    n, was = F.col("records"), F.col("written_at")
    return c.withColumn("stale", ((was < 8) & (n >= 8)) | ((was >= 8) & ((n >= 1.5 * was) | (n >= was + 15))))


@query(
    f"WITH {MEM}, {QRY}, e AS (SELECT query_id, unnest(expected) AS mem_id FROM qry), k AS (SELECT query_id, created_at, mem_id, split_part(category, '_', 1) AS c FROM e JOIN qry USING (query_id) JOIN mem USING (mem_id)) "
    "SELECT c AS family, count(*)::BIGINT AS answers, count(DISTINCT mem_id)::BIGINT AS memories, count(DISTINCT query_id)::BIGINT AS questions FROM k GROUP BY 1"
)
def u5_answer_sets(spark, d):
    e = questions(spark, d, "expected", "category").select("query_id", F.substring_index("category", "_", 1).alias("family"), F.explode("expected").alias("mem_id"))
    k = e.join(memories(spark, d), "mem_id")
    return k.groupBy("family").agg(F.count("*").alias("answers"), F.count_distinct("mem_id").alias("memories"), F.count_distinct("query_id").alias("questions"))
