"""Extraction: transcripts of sessions, proposals of a model, and the store they change."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.text import default_title, normalize, normalize_date, redact
from mnemospark.operators.assembled import negative
from mnemospark.operators.triggers import grounded, grounded_entities

PROPOSALS = 40
ACTIONS = ("create", "update", "supersede", "contradict", "mention")
TYPES = ("fact", "preference", "instruction", "lesson", "skill", "rule")
KEPT = ("rule", "digest", "reflection", "summary")  # never replaced or denied
PROPOSAL = (
    "action string, id string, type string, title string, content string, scope string, evidence string, event_date string, "
    "topics array<string>, entities array<string>, triggers array<struct<kind: string, pattern: string>>"
)


def ingested(messages: DataFrame, sessions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, sessions) of conversations (key, agent, project, observed_at, messages array<struct<role, text>>).

    Each conversation is one event with its compact messages; its session is opened, or reopened if ``sessions`` (key, agent, project, observed_at, status)
    has it. Blank messages and roles other than user and assistant are left out.
    """
    kept = F.filter("messages", lambda m: m["role"].isin("user", "assistant") & (F.trim(m["text"]) != ""))
    compact = F.transform(kept, lambda m: F.struct(m["role"].alias("role"), F.trim(m["text"]).alias("text")))
    rows = messages.where(F.col("key").isNotNull()).withColumn("messages", compact).where(F.size("messages") > 0)
    events = rows.select(F.sha2(F.concat_ws("\u0001", "key", F.to_json("messages")), 256).alias("id"), "key", "agent", "project", "observed_at", F.to_json("messages").alias("payload")).dropDuplicates(["id"])
    fresh = rows.groupBy("key").agg(F.max_by(F.struct("agent", "project", "observed_at"), F.coalesce("observed_at", F.lit(""))).alias("x")).select("key", "x.agent", "x.project", "x.observed_at", F.lit("open").alias("status"))
    if sessions is not None:
        fresh = fresh.unionByName(sessions.select("key", "agent", "project", "observed_at", "status").join(fresh.select("key"), "key", "left_anti"))
    return events, fresh


def transcripts(messages: DataFrame, most: int = 30_000) -> DataFrame:
    """(session_id, transcript, user_text): user and assistant messages (session_id, seq, role, text, call) in order, user messages numbered, calls after their message.

    Over ``most`` characters, replies go, nearest the middle first (``excerpts.middle_out``). A session is one reader's input, so it is
    put together in one place.
    """
    from mnemospark.operators.excerpts import middle_out

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f[~f["role"].isin(["system", "developer"])].sort_values("seq", kind="stable")
        lines, said, n = [], [], 0
        for r in f.itertuples(index=False):
            text = (r.text or "").strip()
            if r.role == "user" and text:
                n += 1
                said.append(text)
                lines.append(("user", f"[user #{n}] {text}"))
            elif text:
                lines.append((r.role, f"[{r.role}] {text}"))
            if r.call:
                lines.append(("call", f"[call] {r.call}"))
        if not lines:
            return pd.DataFrame({"session_id": [], "transcript": [], "user_text": []})
        return pd.DataFrame({"session_id": [f["session_id"].iloc[0]], "transcript": [middle_out(lines, most)], "user_text": ["\n".join(said)]})

    return messages.select("session_id", "seq", "role", "text", "call").groupBy("session_id").applyInPandas(run, "session_id string, transcript string, user_text string")


def parsed_proposals(reply: Column) -> Column:
    """Proposals of a reply (a JSON array): a malformed one is dropped, the rest stay, at most ``PROPOSALS``."""
    each = F.transform(F.from_json(reply, "array<string>"), lambda x: F.from_json(x, PROPOSAL))
    return F.slice(F.filter(each, lambda p: p.isNotNull() & p["action"].isin(*ACTIONS)), 1, PROPOSALS)


def checked(proposals: DataFrame, transcripts_: DataFrame) -> DataFrame:
    """Proposals (session_id, seq, p) made ready: text redacted, kinds and rules verified, names and triggers grounded. ``refused`` tells why one is skipped."""
    j = proposals.join(transcripts_, "session_id")
    p = F.col("p")
    content = redact(F.trim(p["content"]))
    quote = normalize(F.coalesce(p["evidence"], F.lit("")))
    quoted = (F.length(quote) >= 4) & F.contains(normalize(F.col("user_text")), quote)
    invalid = ~F.coalesce(p["type"].isin(*TYPES), F.lit(False)) | ~F.coalesce(F.length(content).between(10, 4000), F.lit(False))
    refused = F.when(p["action"] == "mention", None).when(invalid, "invalid").when((p["type"] == "rule") & ~quoted, "unverified rule")
    title = F.when(F.trim(F.coalesce(p["title"], F.lit(""))) == "", default_title(content)).otherwise(F.substring(redact(F.trim(p["title"])), 1, 80))
    none = F.array().cast("array<string>")
    return j.select(
        "session_id", "seq", p["action"].alias("action"), p["id"].alias("mem_id"), F.when(p["type"] == "rule", "fact").otherwise(p["type"]).alias("kind"), title.alias("title"), content.alias("content"),
        p["scope"].alias("wanted_scope"), normalize_date(p["event_date"]).alias("event_at"), F.coalesce(p["topics"], none).alias("topics"),
        grounded_entities(F.coalesce(p["entities"], none), F.col("transcript")).alias("entities"), grounded(p["triggers"], F.col("transcript")).alias("triggers"),
        (p["type"] == "rule").alias("by_user"), negative(content).alias("denies"), normalize(content).alias("plain"), refused.alias("refused"),
    )


STORE = "mem_id string, scope string, kind string, title string, content string, source string, status string, topics array<string>, entities array<string>, evidence array<string>, conflicts_with array<string>, supersedes array<string>, superseded_by string"


def applied(store: DataFrame, proposals: DataFrame, similar=None) -> DataFrame:
    """The store after checked proposals in order: rows of ``STORE`` with a column ``change`` (created, updated, or null).

    ``proposals``: scope and the columns of ``checked``. update rewrites what an agent wrote; supersede replaces, but a denial of what was stated is a contradiction
    whatever it is called; contradict keeps both sides, contested and linked; a create whose text a memory of the scope has (or that ``similar(content, [contents])``
    finds, an index or None) is a mention of it; a mention counts once a session. Scopes are independent: a scope's proposals and the memories they name or repeat
    are folded in one place, all other memories pass by.
    """
    columns = [c.split()[0] for c in STORE.split(", ")]
    plain = normalize(F.col("content"))
    named = proposals.select("scope", "mem_id").where("mem_id is not null").distinct()
    store = store.select(*columns).withColumn("plain", plain)
    if similar is None:  # only what proposals name or repeat can change
        hit = store.join(named.withColumn("named", F.lit(True)), ["scope", "mem_id"], "left").join(proposals.select("scope", "plain").where("refused is null").distinct().withColumn("same", F.lit(True)), ["scope", "plain"], "left")
    else:
        hit = store.withColumn("named", F.lit(True)).withColumn("same", F.lit(True)).join(proposals.select("scope").distinct(), "scope", "left_semi")
    touched = hit.where("named or same").select(*columns, negative(F.col("content")).alias("denies"), "plain")
    rest = store.join(touched.select("mem_id", "scope"), ["scope", "mem_id"], "left_anti").select(*columns).withColumn("change", F.lit(None).cast("string"))

    def run(key, rows: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
        memory = {r.mem_id: r._asdict() | {"change": None} for r in rows.itertuples(index=False)}
        for m in memory.values():
            for c in ("topics", "entities", "evidence", "conflicts_with", "supersedes"):
                m[c] = [] if m[c] is None else list(m[c])
        live = lambda m: m["status"] in ("active", "contested")

        def mention(m, session):
            if live(m) and session not in m["evidence"]:
                m["evidence"].append(session)
                m["change"] = m["change"] or "updated"

        for p in steps.sort_values(["session_id", "seq"]).itertuples(index=False):
            old = memory.get(p.mem_id)
            if p.action == "mention":
                if old:
                    mention(old, p.session_id)
                continue
            if p.refused is not None:
                continue
            if p.action == "update" and old:
                if old["source"] == "user" or not live(old) or old["kind"] == "rule" or old["plain"] == p.plain:
                    continue
                old |= {"content": p.content, "title": p.title, "plain": p.plain, "denies": p.denies, "change": "updated"}
                for c, new in (("topics", p.topics), ("entities", p.entities), ("evidence", [p.session_id])):
                    old[c] += [x for x in new if x not in old[c]]
                continue
            open_ = old is not None and live(old) and old["kind"] not in KEPT
            against = open_ and (p.action == "contradict" or p.action == "supersede" and p.denies and not old["denies"])
            replaces = open_ and not against and p.action == "supersede" and old["source"] != "user"
            if not against and not replaces:
                others = [m for m in memory.values() if live(m)]
                at = next((i for i, m in enumerate(others) if m["plain"] == p.plain), None)
                if at is None and similar is not None:
                    at = similar(p.content, [m["content"] for m in others])
                if at is not None:
                    mention(others[at], p.session_id)
                    continue
            name = f"{p.session_id}+{p.seq:04d}"
            new = {
                "mem_id": name, "scope": key[0], "kind": p.kind, "title": p.title, "content": p.content, "source": "user" if p.by_user else "agent", "status": "active", "topics": list(p.topics), "entities": list(p.entities),
                "evidence": [p.session_id], "conflicts_with": [], "supersedes": [], "superseded_by": None, "plain": p.plain, "denies": p.denies, "change": "created",
            }
            if against:
                new |= {"status": "contested", "conflicts_with": [p.mem_id]}
                old["status"] = old["status"] if old["source"] == "user" else "contested"
                old["conflicts_with"] += [name] if name not in old["conflicts_with"] else []
                old["change"] = "updated"
            elif replaces:
                new |= {"supersedes": [p.mem_id], "topics": new["topics"] or old["topics"]}
                old |= {"status": "superseded", "superseded_by": name, "change": "updated"}
            memory[name] = new
        return pd.DataFrame([[m[c] for c in (*columns, "change")] for m in memory.values()], columns=[*columns, "change"])

    steps = proposals.select("scope", "session_id", "seq", "action", "mem_id", "kind", "title", "content", "topics", "entities", "by_user", "denies", "plain", "refused")
    folded = touched.toDF(*touched.columns).groupBy("scope").cogroup(steps.toDF(*steps.columns).groupBy("scope")).applyInPandas(run, STORE + ", change string")
    return rest.unionByName(folded)


def contradiction_outcome(pairs: DataFrame, verdicts: DataFrame, memories: DataFrame) -> DataFrame:
    """(mem_id, status, conflicts_with, superseded_by): what judged pairs change.

    ``pairs``: first_id (said earlier), second_id; ``verdicts``: first_id, second_id, verdict (conflict or update); ``memories``: mem_id, source, status, content.
    A conflict without a denial on either side counts as an update. A conflict links both and contests what the user did not write. An update replaces the
    earlier statement if neither side is the user's earlier one, contested, denied or replaced already.
    """
    m = memories.select("mem_id", "source", "status", negative(F.col("content")).alias("neg"))
    side = lambda s: m.select(F.col("mem_id").alias(f"{s}_id"), F.col("source").alias(f"{s}_source"), F.col("status").alias(f"{s}_status"), F.col("neg").alias(f"{s}_neg"))
    j = pairs.select("first_id", "second_id").distinct().join(verdicts, ["first_id", "second_id"]).join(side("first"), "first_id").join(side("second"), "second_id")
    conflict = (F.col("verdict") == "conflict") & (F.col("first_neg") | F.col("second_neg"))
    c = j.where(conflict)
    linked = c.select(F.col("first_id").alias("mem_id"), F.col("first_source").alias("source"), F.col("first_status").alias("was"), F.col("second_id").alias("other")).unionByName(
        c.select(F.col("second_id").alias("mem_id"), F.col("second_source").alias("source"), F.col("second_status").alias("was"), F.col("first_id").alias("other"))
    )
    contested = linked.groupBy("mem_id").agg(F.array_sort(F.collect_set("other")).alias("conflicts_with"), F.max(F.when(F.col("source") == "user", F.col("was")).otherwise(F.lit("contested"))).alias("status"))
    u = j.where(~conflict & (F.coalesce("first_source", F.lit("")) != "user") & (F.col("first_status") == "active") & (F.col("second_status") == "active") & ~F.col("first_neg") & ~F.col("second_neg"))
    taken = contested.select("mem_id")
    u = u.join(taken, F.col("first_id") == F.col("mem_id"), "left_anti").join(taken, F.col("second_id") == F.col("mem_id"), "left_anti")
    replaced = u.groupBy(F.col("first_id").alias("mem_id")).agg(F.min("second_id").alias("superseded_by"))
    return contested.select("mem_id", "status", "conflicts_with", F.lit(None).cast("string").alias("superseded_by")).unionByName(
        replaced.select("mem_id", F.lit("superseded").alias("status"), F.array().cast("array<string>").alias("conflicts_with"), "superseded_by")
    )


def upserted(have: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` and those of ``have`` whose keys it lacks: one summary a session, one set of dossier records a scope and session."""
    return new.unionByName(have.join(new.select(*keys).distinct(), keys, "left_anti"))


DOSSIER = "struct<values: array<string>, items: array<string>, events: array<string>, stages: array<string>>"
ENTRY = "topic string, name string, value string, effective string, kind string, item string, event string, date string, summary string, n int"


def dossier_records(replies: DataFrame, most: int = 120) -> DataFrame:
    """(scope, session_id, place, topic, kind, label, text, date, n) of model replies (scope, session_id, reply); malformed and incomplete records are dropped, at most ``most`` a session."""
    r = F.from_json("reply", DOSSIER)

    def section(name: str) -> Column:
        return F.transform(F.coalesce(r[name], F.array().cast("array<string>")), lambda x: F.struct(F.lit(name[:-1]).alias("kind"), F.from_json(x, ENTRY).alias("e")))

    entries = F.concat(*map(section, ("values", "items", "events", "stages")))
    rows = replies.select("scope", "session_id", F.posexplode(entries).alias("place", "x")).select("scope", "session_id", "place", F.col("x.kind").alias("what"), F.col("x.e").alias("e"))
    text = F.trim(F.when(F.col("what") == "value", F.col("e.value")).when(F.col("what") == "item", F.col("e.item")).when(F.col("what") == "event", F.col("e.event")).otherwise(F.col("e.summary")))
    label = F.trim(F.when(F.col("what") == "value", F.col("e.name")).when(F.col("what") == "item", F.col("e.kind")))
    date = F.trim(F.when(F.col("what") == "value", F.col("e.effective")).when(F.col("what") == "event", F.col("e.date")))
    topic = F.substring(normalize(F.col("e.topic")), 1, 60)
    rows = rows.select("scope", "session_id", "place", topic.alias("topic"), F.col("what").alias("kind"), label.alias("label"), text.alias("text"), F.when(F.length(date) >= 4, date).alias("date"), F.col("e.n").alias("n"))
    rows = rows.where((F.col("topic") != "") & (F.col("text") != "") & (~F.col("kind").isin("value", "item") | (F.coalesce("label", F.lit("")) != "")))
    order = Window.partitionBy("scope", "session_id").orderBy("place")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
