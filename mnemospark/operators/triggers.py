"""Triggers: conditions that bring a memory to a step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.lists import GENERIC_COMMANDS
from mnemospark.operators import blocking


def glob_regex(pattern: Column) -> Column:
    """A glob as an anchored regular expression; ``**/`` spans directories, a relative glob also matches below any directory."""
    p = F.regexp_replace(pattern, r"([.+^$(){}|\[\]\\])", r"\\$1")
    p = F.regexp_replace(p, r"\*\*/", "\u0001")
    p = F.regexp_replace(p, r"\*\*", "\u0002")
    p = F.regexp_replace(F.regexp_replace(p, r"\*", "[^/]*"), r"\?", "[^/]")
    p = F.replace(F.replace(p, F.lit("\u0001"), F.lit("(?:.*/)?")), F.lit("\u0002"), F.lit(".*"))
    return F.when(pattern.startswith("/"), F.concat(F.lit("^"), p, F.lit("$"))).otherwise(F.concat(F.lit("^(?:.*/)?"), p, F.lit("$")))


def matches(kind: Column, pattern: Column, user_text: Column, args: Column, error_sig: Column, tool: Column, files: Column) -> Column:
    """keyword and error by substring, tool by equality, file by glob; without case except for globs."""
    low = F.lower(pattern)
    regex = glob_regex(pattern)
    hit = (
        F.when(kind == "keyword", F.contains(F.lower(F.coalesce(user_text, F.lit(""))), low) | F.contains(F.lower(F.coalesce(args, F.lit(""))), low))
        .when(kind == "error", F.contains(F.lower(error_sig), low))
        .when(kind == "tool", F.lower(tool) == low)
        .when(kind == "file", F.exists(files, lambda f: F.regexp_like(f, regex)))
    )
    return F.coalesce(hit, F.lit(False))


def fired(steps: DataFrame, memories: DataFrame, before_action: bool | None = None) -> DataFrame:
    """(step_id, mem_id, trigger_id): enabled triggers that match a step, within scope.

    Keyword and error triggers meet the texts of a step on four characters (``blocking``), tool triggers on the tool; globs are tested
    against the files of the steps of their scope.
    """
    t = memories.select("mem_id", F.lower("scope").alias("scope"), F.explode("triggers").alias("t")).where(~F.coalesce("t.disabled", F.lit(False)))
    if before_action is not None:
        t = t.where(F.coalesce("t.before_action", F.lit(False)) == before_action)
    t = t.select("mem_id", "scope", F.col("t.id").alias("trigger_id"), F.col("t.kind").alias("kind"), F.col("t.pattern").alias("pattern"), F.lower("t.pattern").alias("low"))
    t = t.distinct().withColumn("name", F.struct("mem_id", "trigger_id"))
    t = t.withColumn("once", F.count("*").over(Window.partitionBy("mem_id", "trigger_id")) == 1)
    scopes = F.when(F.col("project").isNull(), F.array(F.lit("global"))).otherwise(F.array_distinct(F.array(F.lit("global"), F.lower("project"))))
    s = steps.withColumn("scope", F.explode(scopes))
    texts = s.select("step_id", "scope", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(k).alias("kind"), F.lower(F.col(c)).alias("text")) for n, (c, k) in enumerate((("user_text", "keyword"), ("args", "keyword"), ("error_sig", "error")))])).alias("x"))
    texts = texts.select(F.struct("step_id", "scope", "x.n").alias("key"), "scope", F.col("x.kind").alias("kind"), F.col("x.text").alias("text")).where("text is not null")
    patterns = t.where(F.col("kind").isin("keyword", "error")).select("scope", "kind", "low").distinct()
    met = blocking.containing(texts, "key", "text", patterns.withColumn("pattern", F.col("low")), "low", "pattern", ("scope", "kind"), kept=True)
    met = met.select("key.step_id", "scope", "kind", "low").distinct()  # what a text holds; its triggers come last, as hits can be many
    words = met.join(t, ["scope", "kind", "low"]).select("step_id", "name", "once")
    tools = s.select("step_id", "scope", F.lower("tool").alias("low")).join(t.where("kind = 'tool'"), ["scope", "low"]).select("step_id", "name", "once")
    globs = s.where(F.size("files") > 0).select("step_id", "scope", "files").join(t.where("kind = 'file'").withColumn("regex", glob_regex(F.col("pattern"))), "scope")
    files = globs.where(F.exists("files", lambda f: F.regexp_like(f, F.col("regex")))).select("step_id", "name", "once")
    hits = words.unionByName(tools).unionByName(files)
    hits = hits.where("once").unionByName(hits.where("not once").distinct())
    return hits.select("step_id", "name.mem_id", "name.trigger_id")


def mentions(text: Column, entity: Column) -> Column:
    """Whole-word mention without case; CJK names by substring; Latin names under three letters never."""
    escaped = F.regexp_replace(F.lower(entity), r"([.+*?^$(){}|\[\]\\])", r"\\$1")
    word = F.regexp_like(F.lower(text), F.concat(F.lit(r"(?<![\p{L}\p{N}])"), escaped, F.lit(r"(?![\p{L}\p{N}])")))
    return F.when(entity.rlike("[⺀-鿿가-힯]"), F.contains(text, entity)).when(F.length(entity) < 3, F.lit(False)).otherwise(word)


def grounded(proposed: Column, transcript: Column) -> Column:
    """Proposed triggers (kind, pattern) that the transcript bears out, distinct, at most three.

    file: the longest literal of the glob, three characters or more beside slashes; error: the whole text, six or more; command,
    tool and keyword: the whole text, four or more and no common command, as keyword triggers. Patterns have at most 200 characters.
    """
    said = F.lower(transcript)

    def read(t: Column) -> Column:
        pattern = F.trim(t["pattern"])
        kind = F.when(t["kind"].isin("command", "tool", "keyword"), F.lit("keyword")).otherwise(t["kind"])
        return F.struct(kind.alias("kind"), pattern.alias("pattern"))

    def ok(t: Column) -> Column:
        low = F.lower(t["pattern"])
        literal = F.reduce(F.split(low, r"[*?\[{]"), F.lit(""), lambda best, x: F.when(F.length(x) >= F.length(best), x).otherwise(best))
        hit = (
            F.when(t["kind"] == "file", (F.length(F.regexp_replace(literal, "^/+|/+$", "")) >= 3) & F.contains(said, literal))
            .when(t["kind"] == "error", (F.length(low) >= 6) & F.contains(said, low))
            .when(t["kind"] == "keyword", (F.length(low) >= 4) & ~low.isin(GENERIC_COMMANDS) & F.contains(said, low))
        )
        return F.coalesce(hit & (F.length(t["pattern"]) <= 200), F.lit(False))

    return F.slice(F.array_distinct(F.filter(F.transform(proposed, read), ok)), 1, 3)


def grounded_entities(entities: Column, transcript: Column) -> Column:
    """Entities that the transcript names."""
    said = F.lower(transcript)
    return F.array_distinct(F.filter(F.transform(entities, lambda e: F.trim(e)), lambda e: (e != "") & F.contains(said, F.lower(e))))


def health(fired_labelled: DataFrame) -> DataFrame:
    """(trigger_id, fired, labelled, used, weak) from (trigger_id, utility): weak ones are switched off."""
    h = fired_labelled.groupBy("trigger_id").agg(F.count("*").alias("fired"), F.count("utility").alias("labelled"), F.count_if(F.col("utility") > 0).alias("used"))
    return h.withColumn("weak", (F.col("fired") >= 10) & (F.col("labelled") >= 5) & (F.col("used") / F.col("labelled") < 0.1))
