"""Sampling, limits, pairing and JSON joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemospark.operators import blocking
from mnemospark.plans.lineage import written
from mnemospark.plans.record_queries import ARM, runs
from mnemospark.plans.registry import EVL, MEM, QRY, TRN, query
from mnemospark.plans.text_queries import memories, questions, turns
from mnemospark.sources.tables import latest_texts, table


@query(
    "WITH s AS (SELECT user_id, max(ts) AS last_seen, count(*) FILTER (event_type = 'error') AS attempts, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1), m AS (SELECT max(ts) AS now FROM events) "
    "SELECT user_id, epoch_us(last_seen)::BIGINT AS last_seen, attempts::BIGINT AS attempts FROM s, m WHERE (last = 'signup' OR last_seen <= now - INTERVAL 10 MINUTE) AND attempts < 60"
)
def f23_due_sessions(spark, d):
    e = table(spark, d, "events")
    s = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x"), F.count_if(F.col("event_type") == "error").alias("attempts"))
    now = e.agg(F.max("ts").alias("now"))
    due = (F.col("x.event_type") == "signup") | (F.col("x.ts") <= F.col("now") - F.expr("INTERVAL 10 MINUTES"))
    return s.crossJoin(F.broadcast(now)).where(due & (F.col("attempts") < 60)).select("user_id", F.unix_micros(F.col("x.ts").cast("timestamp")).alias("last_seen"), "attempts")


@query(
    f"WITH {TRN}, n AS (SELECT session_id, turn_id, ceil(length(text) / 4.0)::BIGINT AS tokens, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM trn WINDOW w AS (PARTITION BY session_id ORDER BY turn_no, turn_id)), "
    "e AS (SELECT session_id, turn_id, tokens, sum(tokens) OVER (PARTITION BY session_id ORDER BY i) AS freed, i FROM n WHERE i + 8 < n AND tokens >= 100) SELECT session_id, turn_id, tokens, freed::BIGINT AS freed, freed >= 1000 AS fires FROM e"
)
def f24_evictions(spark, d):
    """Old, long messages of a session and the tokens freed so far; a batch fires at its threshold."""
    w = Window.partitionBy("session_id")
    t = turns(spark, d, "session_id", "turn_no", "text").select("session_id", "turn_id", "turn_no", F.ceil(F.length("text") / 4).alias("tokens"))
    t = t.withColumn("i", F.row_number().over(w.orderBy("turn_no", "turn_id")) - 1).withColumn("n", F.count("*").over(w)).where("i + 8 < n and tokens >= 100")
    freed = F.sum("tokens").over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("freed", freed).select("session_id", "turn_id", "tokens", "freed", (F.col("freed") >= 1000).alias("fires"))


@query(
    f"WITH {EVL}, a AS (SELECT question_id, score, {ARM} AS arm FROM evl WHERE coalesce(error, '') = '' AND score IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY question_id, arm ORDER BY score DESC) AS n FROM a) "
    "SELECT x.question_id, x.n::INT AS repeat, x.score AS score_a, y.score AS score_b, round(x.score - y.score, 6) AS difference FROM r x JOIN r y ON x.question_id = y.question_id AND x.n = y.n AND x.arm = 'a' AND y.arm = 'b'"
)
def j22_paired_arms(spark, d):
    """Runs of the two arms paired by question and place; only runs that ended well."""
    e = runs(spark, d, "run_id", "question_id", "error", "score").where((F.coalesce("error", F.lit("")) == "") & F.col("score").isNotNull())
    e = e.withColumn("arm", F.when(F.right("run_id", F.lit(1)).isin("0", "2", "4", "6", "8"), "a").otherwise("b"))
    r = e.withColumn("repeat", F.row_number().over(Window.partitionBy("question_id", "arm").orderBy(F.desc("score")))).select("question_id", "arm", "repeat", "score")
    a, b = (r.where(F.col("arm") == x).select("question_id", "repeat", F.col("score").alias(f"score_{x}")) for x in "ab")
    return a.join(b, ["question_id", "repeat"]).withColumn("difference", F.round(F.col("score_a") - F.col("score_b"), 6))


@query(
    "SELECT c_custkey, count(*)::BIGINT AS steps, round(sum(value), 4) AS value FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, value FROM events) JOIN customer ON c_custkey = k GROUP BY 1"
)
def j5_json_key_join(spark, d):
    e = table(spark, d, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("k"), "value").where("k is not null")
    per = e.groupBy("k").agg(F.count("*").alias("steps"), F.round(F.sum("value"), 4).alias("value"))
    return table(spark, d, "customer").select("c_custkey").join(per, F.col("c_custkey") == F.col("k")).select("c_custkey", "steps", "value")


@query(
    f"WITH {QRY}, p AS (SELECT project, row_number() OVER (ORDER BY project) - 1 AS n, count(*) OVER () AS c FROM projects) "
    "SELECT query_id, q.project, o.project AS asked_in, CASE WHEN CAST(substr(query_id, 2) AS BIGINT) % 2 = 0 THEN 'dev' ELSE 'test' END AS half FROM qry q JOIN p ON p.project = q.project JOIN p o ON o.n = (p.n + 1) % p.c"
)
def e6_cross_project_negatives(spark, d):
    """Each question asked in another project, where it has no answer; halves by parity. The project list is a small dimension."""
    p = table(spark, d, "projects").select("project", (F.row_number().over(Window.orderBy("project")) - 1).alias("n"))
    c = p.agg(F.count("*").alias("c"))
    to = p.crossJoin(F.broadcast(c)).select("project", F.pmod(F.col("n") + 1, F.col("c")).alias("n"))
    to = to.join(p.select("n", F.col("project").alias("asked_in")), "n").select("project", "asked_in")
    half = F.when(F.pmod(F.substring("query_id", 2, 20).cast("bigint"), F.lit(2)) == 0, "dev").otherwise("test")
    return questions(spark, d, "project").join(to, "project").select("query_id", "project", "asked_in", half.alias("half"))


@query(
    f"WITH {QRY}, s AS (SELECT query_id, lower(trim(split)) AS split, row_number() OVER (PARTITION BY lower(trim(split)) ORDER BY md5(query_id || '-3'), query_id) AS n FROM qry) "
    "SELECT query_id, split FROM s WHERE n <= CASE split WHEN 'train' THEN 60 WHEN 'dev' THEN 30 WHEN 'test' THEN 30 ELSE 0 END"
)
def e10_quota_subset(spark, d):
    """A fixed quota per split in seeded hash order (a sampling operator)."""
    quota = spark.createDataFrame([("train", 60), ("dev", 30), ("test", 30)], "split string, quota int")
    order = Window.partitionBy("split").orderBy(F.md5(F.concat("query_id", F.lit("-3"))), "query_id")
    q = questions(spark, d, "split").withColumn("split", F.lower(F.trim("split"))).withColumn("n", F.row_number().over(order))
    return q.join(F.broadcast(quota), "split").where("n <= quota").select("query_id", "split")


@query(
    "SELECT i AS id, 'mem_' || md5(i::VARCHAR) AS mem_id, ['rule', 'fact', 'lesson', 'skill'][(i * 7 + 3) % 4 + 1] AS mem_type, 'project-' || (i * 31 % 10) AS scope FROM range(10000) t(i)"
)
def e11_synthetic_memories(spark, d):
    i = F.col("id")
    kinds = F.array(*[F.lit(x) for x in ("rule", "fact", "lesson", "skill")])
    return spark.range(10000).select(
        "id", F.concat(F.lit("mem_"), F.md5(i.cast("string"))).alias("mem_id"), F.element_at(kinds, ((i * 7 + 3) % 4 + 1).cast("int")).alias("mem_type"), F.concat(F.lit("project-"), (i * 31 % 10).cast("string")).alias("scope")
    )


@query(
    "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) <= 5 AS allowed FROM events WHERE event_type = 'error'"
)
def k9_recheck_limit(spark, d):
    """At most five rechecks per user and day."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return table(spark, d, "events").where("event_type = 'error'").select("user_id", "event_id", (F.row_number().over(w) <= 5).alias("allowed"))


@query(
    "SELECT doc_id, strftime(strptime(strftime(decided_on, '%B-%d-%Y'), '%B-%d-%Y'), '%Y/%m/%d') AS anchor FROM documents WHERE decided_on IS NOT NULL"
)
def d8_anchor_dates(spark, d):
    t = table(spark, d, "documents").where("decided_on is not null").select("doc_id", F.date_format("decided_on", "MMMM-dd-yyyy").alias("a"))
    return t.select("doc_id", F.date_format(F.try_to_timestamp("a", F.lit("MMMM-dd-yyyy")), "yyyy/MM/dd").alias("anchor"))


@query(
    f"WITH {MEM} SELECT mem_id, CASE WHEN confidence IS NULL THEN NULL WHEN confidence >= 0.8 THEN 1.0 WHEN status = 'contested' THEN 0.0 WHEN confidence >= 0.3 THEN 0.5 ELSE 0.0 END::DOUBLE AS utility FROM mem"
)
def m10_utilities(spark, d):
    c = F.col("confidence")
    u = F.when(c.isNull(), None).when(c >= 0.8, 1.0).when(F.col("status") == "contested", 0.0).when(c >= 0.3, 0.5).otherwise(0.0)
    return memories(spark, d, "confidence", "status").select("mem_id", u.cast("double").alias("utility"))


@query(
    f"WITH {MEM}, {QRY}, r AS (SELECT query_id, query || ' [' || array_to_string(coalesce(expected, []), '] [') || ']' AS text FROM qry), i AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(text, 'mem_[0-9A-Za-z]+')) AS mem_id FROM r), "
    "t AS (SELECT mem_id, lower(rtrim(title, '…')) AS t FROM mem WHERE length(title) >= 12) "
    "SELECT query_id, mem_id FROM i SEMI JOIN mem USING (mem_id) UNION SELECT query_id, mem_id FROM r JOIN t ON contains(lower(text), t)"
)
def c24_citations(spark, d):
    """Memories that a response cites by id or by a title of twelve characters or more (responses: questions with the ids of their answers)."""
    ids = F.coalesce("expected", F.array().cast("array<string>"))
    r = latest_texts(table(spark, d, "queries"), "query_id", "added_at", "query_id", "query", "expected")
    r = r.select("query_id", F.concat("query", F.lit(" ["), F.array_join(ids, "] ["), F.lit("]")).alias("text"))
    m = written(memories(spark, d, "title").select("mem_id", F.when(F.length("title") >= 12, F.lower(F.rtrim("title", F.lit("…")))).alias("t")), "titles")
    pieces = written(blocking.pieces(r.withColumn("text", F.lower("text")), "query_id", "text", m, "t"), "pieces")
    by_title = pieces.join(m, "t").select("query_id", "mem_id")
    by_id = r.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("mem_[0-9A-Za-z]+"), F.lit(0)))).alias("mem_id")).join(m, "mem_id")
    by_id = by_id.join(pieces, ["query_id", "t"], "left_anti")  # cited by its title, too
    return by_id.select("query_id", "mem_id").unionByName(by_title)
