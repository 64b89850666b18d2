"""Text, date and index queries over memories, questions and turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.functions.lists import INTENT_CUES, NEGATION_CUES, SECRET_PATTERNS, SIGNATURE_STEPS, YES_NO_STARTS
from mnemospark.functions.text import CJK
from mnemospark.operators import index
from mnemospark.plans.registry import MEM, QRY, TRN, query, quoted, terms_sql
from mnemospark.sources.tables import latest, table

BODY = "coalesce(title, '') || chr(10) || coalesce(content, '')"


def memories(spark, d, *columns):
    return latest(table(spark, d, "memories"), "mem_id", "ingested_at", "mem_id", *columns)


def questions(spark, d, *columns):
    return latest(table(spark, d, "queries"), "query_id", "added_at", "query_id", *columns)


def turns(spark, d, *columns):
    return latest(table(spark, d, "turns"), "turn_id", "ingested_at", "turn_id", *columns)


def body():
    return F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))


@query(f"WITH {MEM} SELECT mem_id, count(*)::BIGINT AS terms, count(DISTINCT w)::BIGINT AS distinct_terms, min(w) AS first_term, max(w) AS last_term FROM ({terms_sql('mem', 'mem_id', BODY)}) GROUP BY mem_id")
def x1_tokens(spark, d):
    docs = memories(spark, d, "title", "content").withColumn("text", body())
    return index.terms(docs, "mem_id", "text").groupBy("mem_id").agg(
        F.count("*").alias("terms"), F.count_distinct("term").alias("distinct_terms"), F.min("term").alias("first_term"), F.max("term").alias("last_term")
    )


@query(
    f"WITH {MEM}, t AS ({terms_sql('mem', 'mem_id', BODY)}), n AS (SELECT count(DISTINCT mem_id) AS n FROM t) SELECT w AS term, count(DISTINCT mem_id)::BIGINT AS df, "
    "round(ln(1 + (max(n.n) - count(DISTINCT mem_id) + 0.5) / (count(DISTINCT mem_id) + 0.5)), 6) AS idf FROM t, n GROUP BY w"
)
def x5_idf(spark, d):
    docs = memories(spark, d, "title", "content").withColumn("text", body())
    post = index.postings(docs, "mem_id", "text")
    df, length = index.statistics(post, "mem_id")
    n = length.agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


@query(
    f"WITH {MEM}, l AS (SELECT mem_id, count(*) AS n, count(DISTINCT w) AS u FROM ({terms_sql('mem', 'mem_id', BODY)}) GROUP BY 1) "
    "SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS terms, round(avg(n), 6) AS average_length, sum(u)::BIGINT AS postings FROM l"
)
def a1_corpus_stats(spark, d):
    docs = memories(spark, d, "title", "content").withColumn("text", body())
    length = index.postings(docs, "mem_id", "text").groupBy("mem_id").agg(F.sum("tf").alias("n"), F.count("*").alias("u"))
    return length.agg(F.count("*").alias("documents"), F.sum("n").alias("terms"), F.round(F.avg("n"), 6).alias("average_length"), F.sum("u").alias("postings"))


@query(f"WITH {TRN} SELECT turn_id, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS normalized FROM trn")
def x8_normalized(spark, d):
    return turns(spark, d, "text").select("turn_id", F.md5(T.normalize(F.col("text"))).alias("normalized"))


TITLE_SQL = "trim([x for x in string_split(content, chr(10)) if trim(x) <> ''][1])"


@query(
    f"WITH {MEM} SELECT mem_id, CASE WHEN length({TITLE_SQL}) > 60 THEN substr({TITLE_SQL}, 1, 60) || '…' ELSE {TITLE_SQL} END AS title, "
    "CASE WHEN lower(trim(mem_scope)) IN ('', 'global') THEN 'global' ELSE lower(trim(mem_scope)) END AS scope FROM mem"
)
def x9_titles_and_scopes(spark, d):
    scope = F.lower(F.trim("mem_scope"))
    return memories(spark, d, "content", "mem_scope").select(
        "mem_id", T.default_title(F.col("content")).alias("title"), F.when(scope.isin("", "global"), "global").otherwise(scope).alias("scope")
    )


NUMBERS_SQL = "array_to_string(list_sort(list_distinct([replace(n, ',', '') for n in regexp_extract_all(regexp_replace({}, '[0-9]{{4}}[-/][0-9]{{2}}([-/][0-9]{{2}})?', '', 'g'), '[0-9][0-9,]*')])), ' ')"


@query(f"WITH {MEM} SELECT mem_id, {NUMBERS_SQL.format('content')} AS numbers FROM mem")
def x11_numbers(spark, d):
    return memories(spark, d, "content").select("mem_id", T.number_key(F.col("content")).alias("numbers"))


def _redact_sql(e: str) -> str:
    for p in SECRET_PATTERNS:
        e = f"regexp_replace({e}, '{p.replace(chr(39), chr(39) * 2)}', '[REDACTED]', 'g')"
    return e


ENTROPY_SQL = "list_sum([-p * log2(p) for p in [len(list_filter(string_split(x, ''), lambda y: y = c)) / length(x)::DOUBLE for c in list_distinct(string_split(x, ''))]])"


@query(
    f"WITH {TRN}, s AS (SELECT turn_id, text || ' token-' || sha256(turn_id::VARCHAR) || ' end' AS text FROM trn), r AS (SELECT turn_id, text, {_redact_sql('text')} AS t FROM s), k AS (SELECT turn_id, unnest(regexp_extract_all(t, '\\b[A-Za-z0-9_-]{{32,}}\\b')) AS x FROM r), "
    f"h AS (SELECT turn_id, list(x) AS l FROM (SELECT DISTINCT turn_id, x FROM k WHERE {ENTROPY_SQL} >= 3.5) GROUP BY 1), "
    "d AS (SELECT turn_id, text, CASE WHEN l IS NULL THEN t ELSE list_reduce(list_prepend(t, l), lambda a, x: replace(a, x, '[REDACTED:high_entropy]')) END AS t FROM r LEFT JOIN h USING (turn_id)) "
    "SELECT turn_id, md5(t) AS redacted, t <> text AS changed FROM d"
)
def x13_redacted(spark, d):
    """Texts with a random token behind them, redacted by known forms and by entropy."""
    said = F.concat("text", F.lit(" token-"), F.sha2(F.col("turn_id").cast("string"), 256), F.lit(" end"))
    r = turns(spark, d, "text").select("turn_id", said.alias("text")).withColumn("t", T.redact(F.col("text")))
    return r.select("turn_id", F.md5("t").alias("redacted"), (F.col("t") != F.col("text")).alias("changed"))


def _signature_sql(e: str) -> str:
    for p, to in SIGNATURE_STEPS:
        e = f"regexp_replace({e}, '{p}', '{to}', 'g')"
    return f"substr(trim(regexp_replace({e}, '\\s+', ' ', 'g')), 1, 200)"


@query(
    f"WITH {TRN}, l AS (SELECT turn_id, [x for x in string_split(text, chr(10)) if regexp_matches(lower(x), 'error|failed|exception|panic|traceback')][1] AS x FROM trn) "
    f"SELECT {_signature_sql('x')} AS signature, count(*)::BIGINT AS turns, min(turn_id) AS first_turn FROM l WHERE x IS NOT NULL GROUP BY 1"
)
def x15_error_signatures(spark, d):
    s = turns(spark, d, "text").select("turn_id", T.error_signature(F.col("text")).alias("signature")).where("signature is not null")
    return s.groupBy("signature").agg(F.count("*").alias("turns"), F.min("turn_id").alias("first_turn"))


@query(f"WITH {TRN} SELECT turn_id, md5(CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, 266) || ' … ' || right(text, 133) END) AS clipped FROM trn")
def x17_clipped(spark, d):
    return turns(spark, d, "text").select("turn_id", F.md5(T.clip(F.col("text"), 400)).alias("clipped"))


@query(f"WITH {TRN} SELECT md5(substr(split_part(text, chr(10), 1), 1, 307)) AS turn_key, count(*)::BIGINT AS turns FROM trn GROUP BY 1")
def x20_turn_keys(spark, d):
    return turns(spark, d, "text").groupBy(F.md5(T.turn_key(F.col("text"))).alias("turn_key")).agg(F.count("*").alias("turns"))


@query(f"WITH {TRN} SELECT project, count(*)::BIGINT AS turns, sum(ceil(length(text) / 4.0))::BIGINT AS tokens, sum(length(text) // 4 + 12)::BIGINT AS hit_tokens FROM trn GROUP BY project")
def x22_token_estimates(spark, d):
    n = F.length("text")
    return turns(spark, d, "project", "text").groupBy("project").agg(
        F.count("*").alias("turns"), F.sum(T.estimated_tokens(F.col("text"))).alias("tokens"), F.sum(F.floor(n / 4) + 12).alias("hit_tokens")
    )


@query(
    f"WITH {TRN}, t AS (SELECT turn_id, unnest(regexp_extract_all(text || ' ' || md5(turn_id::VARCHAR), '[A-Za-z0-9_-]{{32,}}')) AS t FROM trn), k AS (SELECT DISTINCT t FROM t), "
    "c AS (SELECT t, unnest(string_split(t, '')) AS c FROM k), p AS (SELECT t, count(*) / length(t)::DOUBLE AS p FROM c WHERE c <> '' GROUP BY t, c) "
    "SELECT t AS token, round(-sum(p * log2(p)), 6) AS entropy, round(-sum(p * log2(p)), 6) >= 3.5 AS secret FROM p GROUP BY t"
)
def a18_entropy(spark, d):
    """Long tokens of texts that end in a digest of their id."""
    said = F.concat("text", F.lit(" "), F.md5(F.col("turn_id").cast("string")))
    t = turns(spark, d, "text").select(F.explode(F.regexp_extract_all(said, F.lit("[A-Za-z0-9_-]{32,}"), F.lit(0))).alias("token")).distinct()
    c = t.select("token", F.explode(F.split("token", "")).alias("c")).where("c <> ''").groupBy("token", "c").agg((F.count("*")).alias("n"))
    p = F.col("n") / F.length("token")
    return c.groupBy("token").agg(F.round(-F.sum(p * F.log2(p)), 6).alias("entropy")).withColumn("secret", F.col("entropy") >= 3.5)


def _cue_sql(e: str, cues: list[str]) -> str:
    import re

    latin = "|".join(c.replace("'", "''") for c in cues if not re.search(f"[{CJK}]", c))
    cjk = "|".join(c for c in cues if re.search(f"[{CJK}]", c))
    hit = rf"regexp_matches(lower({e}), '(^|[^\p{{L}}\p{{N}}])({latin})($|[^\p{{L}}\p{{N}}])')"
    return f"({hit} OR regexp_matches(lower({e}), '{cjk}'))" if cjk else hit


@query(
    f"WITH {QRY} SELECT query_id, {', '.join(f'{_cue_sql('query', c)} AS {k}' for k, c in INTENT_CUES.items())}, "
    f"({' OR '.join(f"starts_with(ltrim(lower(query)), {quoted([s])})" for s in YES_NO_STARTS)}) AS yes_no FROM qry"
)
def f11_intents(spark, d):
    q = questions(spark, d, "query")
    low = F.ltrim(F.lower("query"))
    starts = F.lit(False)
    for s in YES_NO_STARTS:
        starts = starts | low.startswith(s)
    return q.select("query_id", *[T.has_cue(F.col("query"), c).alias(k) for k, c in INTENT_CUES.items()], starts.alias("yes_no"))


APOSTROPHE = "replace(content, chr(8217), chr(39))"


@query(f"WITH {MEM} SELECT mem_type, count(*)::BIGINT AS memories, count(*) FILTER ({_cue_sql(APOSTROPHE, NEGATION_CUES)})::BIGINT AS negative FROM mem GROUP BY mem_type")
def f12_negative(spark, d):
    neg = T.has_cue(F.replace("content", F.lit("’"), F.lit("'")), NEGATION_CUES)
    return memories(spark, d, "mem_type", "content").groupBy("mem_type").agg(F.count("*").alias("memories"), F.count_if(neg).alias("negative"))


RANGE_SQL = (
    "CASE WHEN length({0}) = 4 THEN ({0} || '0101')::INT WHEN length({0}) = 6 THEN ({0} || '01')::INT WHEN length({0}) >= 8 THEN substr({0}, 1, 8)::INT END AS first_day, "
    "CASE WHEN length({0}) = 4 THEN ({0} || '1231')::INT WHEN length({0}) = 6 THEN ({0} || '31')::INT WHEN length({0}) >= 8 THEN substr({0}, 1, 8)::INT END AS last_day"
)
DIG = "regexp_replace({}, '[^0-9]', '', 'g')"


@query(f"WITH {MEM} SELECT mem_id, {RANGE_SQL.format(DIG.format('created_at'))}, substr({DIG.format('coalesce(updated_at, created_at)')}, 1, 12) AS date_key FROM mem")
def d1_date_ranges(spark, d):
    m = memories(spark, d, "created_at", "updated_at")
    c = F.col("created_at")
    return m.select("mem_id", T.date_start(c).alias("first_day"), T.date_end(c).alias("last_day"), T.date_key(F.col("updated_at"), c).alias("date_key"))


NORM_SQL = "CASE WHEN regexp_full_match(replace(trim({0}), '/', '-'), '[0-9]{{4}}(-[0-9]{{2}}(-[0-9]{{2}})?)?') THEN replace(trim({0}), '/', '-') END"


@query(f"WITH {MEM} SELECT mem_id, {NORM_SQL.format('substr(created_at, 1, 10)')} AS day, {NORM_SQL.format('substr(created_at, 1, 7)')} AS month FROM mem")
def d3_normalized_dates(spark, d):
    m = memories(spark, d, "created_at")
    return m.select("mem_id", T.normalize_date(F.substring("created_at", 1, 10)).alias("day"), T.normalize_date(F.substring("created_at", 1, 7)).alias("month"))


@query(
    f"WITH {MEM} SELECT mem_id, abs(date_diff('day', try_strptime(substr({DIG.format('updated_at')}, 1, 8), '%Y%m%d'), try_strptime(substr({DIG.format('created_at')}, 1, 8), '%Y%m%d')))::BIGINT AS days "
    "FROM mem"
)
def d4_day_gaps(spark, d):
    m = memories(spark, d, "created_at", "updated_at")
    return m.select("mem_id", T.day_gap(F.col("updated_at"), F.col("created_at")).cast("bigint").alias("days"))


@query(
    f"WITH {MEM} SELECT mem_id, coalesce(substr(updated_at, 1, 10), substr(created_at, 1, 10)) AS said, "
    "concat_ws(', ', '#' || coalesce(mem_key, '?'), 'said ' || substr(updated_at, 1, 10)) AS line FROM mem"
)
def x27_display_dates(spark, d):
    m = memories(spark, d, "mem_key", "created_at", "updated_at")
    said = F.substring("updated_at", 1, 10)
    return m.select(
        "mem_id", F.coalesce(said, F.substring("created_at", 1, 10)).alias("said"),
        F.concat_ws(", ", F.concat(F.lit("#"), F.coalesce("mem_key", F.lit("?"))), F.concat(F.lit("said "), said)).alias("line"),
    )


@query(
    f"WITH {MEM}, b AS (SELECT mem_id, {BODY} || coalesce(' ' || array_to_string(topics, ' '), '') AS t FROM mem) SELECT mem_id, md5(t) AS text_hash, length(t)::BIGINT AS chars FROM b"
)
def x10_search_text(spark, d):
    m = memories(spark, d, "title", "content", "topics")
    t = F.concat(body(), F.coalesce(F.concat(F.lit(" "), F.array_join("topics", " ")), F.lit("")))
    return m.select("mem_id", F.md5(t).alias("text_hash"), F.length(t).cast("bigint").alias("chars"))


@query(f"WITH {TRN} SELECT turn_id, substr(sha256(coalesce(project, '') || '|' || session_id || '|' || text), 1, 20) AS session_key FROM trn")
def s28_session_keys(spark, d):
    t = turns(spark, d, "project", "session_id", "text")
    return t.select("turn_id", F.substring(F.sha2(F.concat(F.coalesce("project", F.lit("")), F.lit("|"), "session_id", F.lit("|"), "text"), 256), 1, 20).alias("session_key"))


@query(
    f"WITH {MEM} SELECT mem_id, list_distinct([substr(lower(trim(t)), 1, 40) for t in topics if trim(t) <> '']) IS NULL AS none, "
    "len(list_distinct([substr(lower(trim(t)), 1, 40) for t in topics if trim(t) <> '']))::INT AS kept, len(topics)::INT AS given FROM mem"
)
def m9_topic_labels(spark, d):
    clean = F.array_distinct(F.transform(F.filter("topics", lambda t: F.trim(t) != ""), lambda t: F.substring(F.lower(F.trim(t)), 1, 40)))
    return memories(spark, d, "topics").select(
        "mem_id", clean.isNull().alias("none"), F.when(F.col("topics").isNotNull(), F.size(clean)).alias("kept"), F.when(F.col("topics").isNotNull(), F.size("topics")).alias("given")
    )
