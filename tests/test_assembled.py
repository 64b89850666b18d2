import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from mnemospark import config
from mnemospark.operators import assembled, blocking, evaluation, extraction, logs, retrieval, triggers
from mnemospark.plans import lineage
from mnemospark.streaming import agents


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_blocked_joins_equal_tests_of_all_pairs(spark):
    texts = [(1, "a", "the old Kal-3 client writes"), (2, "a", "数据库 kal"), (3, "b", "old"), (4, "b", None), (5, "a", "kalmar; c++")]
    names = [("a", "kal"), ("a", "Kal-3"), ("a", "old"), ("b", "old"), ("a", "数据"), ("b", "the"), ("a", "c"), ("a", "")]
    t = spark.createDataFrame(texts, "k int, s string, x string")
    n = spark.createDataFrame(names, "s string, name string")
    got = rows(blocking.containing(t, "k", "x", n.withColumn("p", F.col("name")), "name", "p", ("s",)))
    assert got == sorted((k, p) for k, s, x in texts for s2, p in names if s == s2 and x and p and p in x)
    named = rows(blocking.naming(t, "k", "x", n, "name", ("s",)))
    every = t.join(n, "s").where(triggers.mentions(F.col("x"), F.col("name")))
    assert named == [r for r in rows(every, "k", "name")] and (5, "kal") not in named and (2, "数据") in named
    assert blocking.containing(t, "k", "x", n.where("false").withColumn("p", F.col("name")), "name", "p").count() == 0


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    import numpy as np

    rng = np.random.default_rng(2)
    v = np.round(rng.standard_normal((40, 4)), 1)
    v[10:14] = v[9]
    df = spark.createDataFrame([(i, "s" if i % 3 else "t", [float(x) for x in r]) for i, r in enumerate(v)], "a int, scope string, v array<double>")
    got = {(r["a"], r["b"]): r["place"] for r in retrieval.nearest(df, df.withColumnRenamed("a", "b"), "a", "b", 3, different=True).collect()}
    for i in range(40):
        others = [j for j in range(40) if j != i and (j % 3 == 0) == (i % 3 == 0)]
        best = sorted(others, key=lambda j: (-round(float(v[i] @ v[j]), 6), j))[:3]
        assert [j for j in best if got.get((i, j)) == best.index(j) + 1] == best


def test_ranked_channels(spark):
    m = [("m1", "fact", "active"), ("m2", "fact", "superseded"), ("m3", "instruction", "active"), ("m4", "digest", "active"), ("m5", "rule", "active"), ("m6", "fact", "active"), ("m7", "summary", "active"), (None, "fact", "active")]
    memories = spark.createDataFrame(m, "mem_id string, kind string, status string")
    scores = spark.createDataFrame([("q", "m1", 0.9), ("q", "m2", 0.95), ("q", "m3", 0.1), ("q", "m4", 0.85), ("q", "m5", 1.0), ("q", "m7", 1.0), ("p", "m2", 0.9), ("p", "m1", 0.2)], "query_id string, mem_id string, keyword double")
    e = spark.createDataFrame([("m6", "global", "Zed", "active", "fact", "2024"), ("m1", "global", "Zed", "active", "fact", "2023")], "mem_id string, scope string, entity string, status string, kind string, created_at string")
    asked = spark.createDataFrame([("q", "global", "how many did zed see", True, True), ("p", "global", "zebra", False, False)], "query_id string, scope string, text string, past boolean, aggregate boolean")
    got = [(r["query_id"], r["position"], r["mem_id"], r["channel"], r["score"]) for r in assembled.ranked(scores, memories, e, asked).orderBy("query_id", "position").collect()]
    assert got == [("q", 1, "m3", "instruction", 1.0), ("q", 2, "m4", "search", 1.0), ("q", 3, "m1", "search", 0.9), ("q", 4, "m2", "search", 0.855), ("q", 5, "m6", "entity", 0.4)]
    hop = assembled.entity_hops(asked, spark.createDataFrame([("p", "m1", 0.9)], "query_id string, mem_id string, score double"), e, spark.createDataFrame([("p", "m1")], "query_id string, mem_id string"), 10)
    assert [(r["mem_id"], round(r["score"], 6)) for r in hop.collect()] == [("m6", 0.63)]
    logits = spark.createDataFrame([("q", "m2", 4.0), ("q", "m3", -4.0)], "query_id string, mem_id string, logit double")
    again = assembled.reranked(assembled.ranked(scores, memories, e, asked), logits).where("query_id = 'q'").orderBy("position").collect()
    assert [r["mem_id"] for r in again] == ["m4", "m2", "m1", "m6", "m3"]
    assert assembled.ranked(scores.limit(0), memories, e.limit(0), asked).count() == 0


def test_conflict_notes(spark):
    m = [("a", "contested", "2024-02", "I never went there", ["b"]), ("b", "contested", "2024-01", "I went there", ["a"]), ("c", "contested", "2024", "x is 3", ["d"]), ("d", "contested", "2023", "x is 4", ["c"])]
    memories = spark.createDataFrame(m, "mem_id string, status string, said string, content string, conflicts_with array<string>")
    hits = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("q", 3, "c")], "query_id string, position int, mem_id string")
    notes = assembled.conflict_notes(hits, memories).collect()
    assert [(n["note"], n["first_id"], n["second_id"]) for n in notes] == [(1, "b", "a")] and "I went there" in notes[0]["text"]
    assert rows(assembled.conflicts(memories), "mem_id", "other") == [("a", "b"), ("b", "a")]


def test_packing_of_conversations_and_finish(spark):
    hits = [{"id": "r", "kind": "leading", "text": "x" * 400}, {"id": "m", "kind": "memory", "text": "x" * 40}, {"id": "e", "kind": "excerpt", "text": "y" * 4000}, {"id": "f", "kind": "excerpt", "text": "z" * 40}]
    out = assembled.packed_conversation(hits, 100, lambda t: t[:200])
    assert [h["id"] for h in out] == ["r", "e", "f"] and len(out[1]["text"]) == 200
    h = spark.createDataFrame([("q", 1, "r", "leading", "rule", "what", False), ("q", 2, "m", "memory", "fact", "what", False)], "question_id string, position int, id string, kind string, text string, question string, conversation boolean")
    b = spark.createDataFrame([("q", 1, "timeline", "t"), ("q", 2, "log", "l")], "question_id string, stage int, id string, text string")
    assert [r["id"] for r in assembled.finished(h, b, 500).orderBy("place").collect()] == ["r", "log", "timeline", "m"]


REPLY = json.dumps(
    [
        {"action": "create", "type": "fact", "title": "", "content": "The service listens on port 8080 now.", "topics": ["net"], "entities": ["Kal", "Zed"], "triggers": [{"kind": "command", "pattern": "deployctl"}]},
        {"action": 7, "type": {}}, 5, "x",
        {"action": "create", "type": "rule", "content": "Always deploy on Friday evenings.", "evidence": "never said"},
        {"action": "create", "type": "rule", "content": "Always run deployctl with care.", "evidence": "use DEPLOYCTL with  care"},
        {"action": "supersede", "id": "old", "type": "fact", "content": "I have never used Vim at work."},
        {"action": "supersede", "id": "port", "type": "fact", "content": "The port is 9090 as of today."},
        {"action": "update", "id": "user", "type": "fact", "content": "Something the user wrote before."},
        {"action": "mention", "id": "said"}, {"action": "mention", "id": "said"},
        {"action": "create", "type": "fact", "content": "short"},
        {"action": "create", "type": "fact", "content": "  The Cache lives in  memory only. "},
    ]
)


def test_extraction(spark):
    messages = spark.createDataFrame(
        [("s1", 1, "system", "no", None), ("s1", 2, "user", "Please use deployctl with care for Kal", None), ("s1", 3, "assistant", "done", "bash deployctl"), ("s1", 4, "user", " ", None)], "session_id string, seq int, role string, text string, call string"
    )
    t = extraction.transcripts(messages)
    assert t.first()["transcript"] == "[user #1] Please use deployctl with care for Kal\n[assistant] done\n[call] bash deployctl"
    reply = spark.createDataFrame([("s1", REPLY)], "session_id string, reply string")
    p = reply.select("session_id", F.posexplode(extraction.parsed_proposals(F.col("reply"))).alias("seq", "p"))
    assert p.count() == 10
    c = extraction.checked(p, t)
    got = {r["seq"]: r for r in c.collect()}
    assert got[0]["entities"] == ["Kal"] and got[0]["triggers"][0]["kind"] == "keyword" and got[0]["title"].startswith("The service")
    assert got[1]["refused"] == "unverified rule" and got[2]["refused"] is None and got[2]["kind"] == "fact" and got[8]["refused"] == "invalid"
    base = ("t", [], [], [], [], [], None)
    store = spark.createDataFrame(
        [("old", "p", "fact", "t", "I used Vim at work.", "agent", "active", *base[1:]), ("port", "p", "fact", "t", "The port is 80.", "agent", "active", ["net"], *base[2:]), ("user", "p", "fact", "t", "Mine.", "user", "active", *base[1:]),
         ("said", "p", "fact", "t", "said before", "agent", "active", *base[1:]), ("cache", "p", "fact", "t", "the cache lives in memory only.", "agent", "active", *base[1:]), ("else", "q", "fact", "t", "x", "agent", "active", *base[1:])],
        extraction.STORE,
    )
    out = {r["mem_id"]: r for r in extraction.applied(store, c.withColumn("scope", F.lit("p"))).collect()}
    assert len(out) == 6 + 4 and out["else"]["change"] is None and out["user"]["content"] == "Mine."
    denial = next(r for r in out.values() if r["content"] == "I have never used Vim at work.")
    assert out["old"]["status"] == denial["status"] == "contested" and denial["conflicts_with"] == ["old"]
    new = next(r for r in out.values() if r["content"].startswith("The port is 9090"))
    assert out["port"]["status"] == "superseded" and out["port"]["superseded_by"] == new["mem_id"] and new["topics"] == ["net"]
    assert out["said"]["evidence"] == ["s1"] and out["cache"]["evidence"] == ["s1"]
    assert next(r for r in out.values() if r["content"].startswith("Always run"))["source"] == "user"


def test_contradiction_outcomes(spark):
    pairs = spark.createDataFrame([("a", "b", "conflict"), ("c", "d", "conflict"), ("e", "f", "update"), ("g", "h", "update")], "first_id string, second_id string, verdict string")
    m = [("a", "agent", "active", "I did it"), ("b", "user", "active", "I never did it"), ("c", "agent", "active", "x is 1"), ("d", "agent", "active", "x is 2"), ("e", "user", "active", "y"), ("f", "agent", "active", "z"), ("g", "agent", "active", "never"), ("h", "agent", "active", "z")]
    out = extraction.contradiction_outcome(pairs, pairs, spark.createDataFrame(m, "mem_id string, source string, status string, content string"))
    assert rows(out, "mem_id", "status", "superseded_by") == [("a", "contested", None), ("b", "active", None), ("c", "superseded", "d")]


def test_ingest_and_upsert(spark):
    schema = "key string, agent string, project string, observed_at string, messages array<struct<role: string, text: string>>"
    c = spark.createDataFrame([("k", "a", "p", "2024", [("user", " hi "), ("system", "x"), ("assistant", "")]), (None, "a", "p", "2024", [("user", "hi")]), ("e", "a", "p", "2024", [])], schema)
    old = spark.createDataFrame([("k", "a", "p", "2023", "done"), ("z", "a", "p", "2023", "done")], "key string, agent string, project string, observed_at string, status string")
    events, sessions = extraction.ingested(c, old)
    assert json.loads(events.first()["payload"]) == [{"role": "user", "text": "hi"}] and rows(sessions, "key", "status") == [("k", "open"), ("z", "done")]
    have = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("t", 1, "c")], "s string, n int, v string")
    assert rows(extraction.upserted(have, have.where("n = 2 and s = 's'").withColumn("v", F.lit("new")), ["s"])) == [("s", 2, "new"), ("t", 1, "c")]


def test_dossier_records(spark):
    reply = json.dumps({"values": [{"topic": " Net ", "name": "port", "value": "80", "effective": "2024"}, {"topic": "net", "value": "1"}], "items": ["bad", {"topic": "net", "kind": "tool", "item": "vim"}], "events": [{"topic": "net", "event": "launch", "date": "x"}], "stages": [{"topic": "", "summary": "s"}]})
    got = extraction.dossier_records(spark.createDataFrame([("p", "s", reply), ("p", "t", "no json")], "scope string, session_id string, reply string")).orderBy("place").collect()
    assert [(r["place"], r["topic"], r["kind"], r["label"], r["text"], r["date"]) for r in got] == [(1, "net", "value", "port", "80", "2024"), (2, "net", "item", "tool", "vim", None), (3, "net", "event", None, "launch", None)]


def test_message_log_equals_plain_fold(spark):
    turns = [(i, "p" if i < 40 else "x", i, None if i % 2 else "2024-01-01", f"turn {i} " + "w" * (i * 37 % 900), "note" if i % 3 else None) for i in range(1, 60)]
    t = spark.createDataFrame(turns, "turn_id int, scope string, number int, said string, text string, note string")
    ranked = [("q", 0, 1, 7), ("q", 0, 2, 3), ("q", 1, 1, 3), ("q", 1, 2, 9), ("r", 0, 1, 5)]
    r = spark.createDataFrame(ranked, "query_id string, ranking int, place int, turn_id int")
    q = spark.createDataFrame([("q", "p", True, False), ("r", "p", False, True)], "query_id string, scope string, whole boolean, notes boolean")
    got = {x["query_id"]: x for x in logs.message_log(q, r, t, 3000).collect()}

    def line(x, notes):
        body = x[4] if len(x[4]) <= 700 else x[4][:700] + "…"
        return f"- #{x[2]} [{x[3] or 'date unknown'}] {body}" + (f" → Assistant: {x[5]}" if notes and x[5] else "")

    order, spent, kept = [7, 3, 9] + [x[0] for x in turns if x[1] == "p" and x[0] not in (7, 3, 9)], 0, []
    for i in order:
        s = line(turns[i - 1], False)
        if spent + len(s) + 1 <= 3000:
            spent += len(s) + 1
            kept.append((i, s))
    assert got["q"]["text"] == "\n".join(s for _, s in sorted(kept)) and got["q"]["total"] == 39 and got["r"]["text"] == line(turns[4], True)


def test_timelines_and_orders(spark):
    s = spark.createDataFrame([(f"m{i}", "p", f"2024-{i:02d}", f"2024-{i:02d}", "z" * 500) for i in range(1, 11)], "mem_id string, scope string, created_at string, said string, content string")
    q = spark.createDataFrame([("q", "p")], "query_id string, scope string")
    near = spark.createDataFrame([("q", "m7", 0.9), ("q", "m2", 0.8), ("q", "m9", 0.1)], "query_id string, mem_id string, score double")
    tight, roomy = logs.timelines(q, s, near, 300).first(), logs.timelines(q, s, near, 4000).first()
    assert [x.split(" [")[0] for x in tight["text"].split("\n")] == ["- Session 2", "- Session 7"] and roomy["lines"] == 10 and len(roomy["text"].split("\n")[0]) == len("- Session 1 [2024-01] ") + 401
    h = spark.createDataFrame([("q", 1, "a", 0, "2024", 2), ("q", 2, "b", 1, "2023", None), ("q", 3, "c", 0, "2022", 1)], "query_id string, rank int, mem_id string, topic_group int, date_key string, turn int")
    assert [r["mem_id"] for r in logs.topic_order(h).orderBy("position").collect()] == ["c", "a", "b"]


def test_sources_and_positions(spark):
    hits = spark.createDataFrame([("q", "m", 0.8, [1.0, 0.0])], "query_id string, mem_id string, score double, v array<double>")
    ev = spark.createDataFrame([("m", "s1")], "mem_id string, session_id string")
    ex = spark.createDataFrame([("e1", "s1", "k1", [0.9, 0.0]), ("e2", "s1", "k2", [0.6, 0.0]), ("e3", "s2", "k3", [1.0, 0.0])], "excerpt_id string, session_id string, turn_key string, v array<double>")
    none = spark.createDataFrame([], "query_id string, excerpt_id string, turn_key string")
    assert rows(logs.source_excerpts(hits, ev, ex, none, 5)) == [("q", "e1", 0.76)]
    assert logs.source_excerpts(hits, ev, ex, spark.createDataFrame([("q", "e1", "k1")], none.schema), 5).count() == 0
    m = spark.createDataFrame([("m", ["s1", "s2"], [1.0, 0.0])], "mem_id string, evidence array<string>, v array<double>")
    t = spark.createDataFrame([("s1", 4, [0.5, 0.0]), ("s1", 2, [0.5, 0.0]), ("s2", 9, [1.0, 0.0])], "session_id string, turn int, v array<double>")
    assert rows(logs.positions(m, t)) == [("m", 2)]


def test_replies_plans_and_embeddings(spark):
    req = spark.createDataFrame([("ask", "t"), ("ask", "t"), ("new", "t")], "request string, tag string")
    key = req.select(logs.request_key(F.lit("ask"), F.lit("t"))).first()[0]
    done, open_ = logs.replied(req, spark.createDataFrame([(key, "old", 1), (key, "yes", 2)], "key string, reply string, at int"))
    assert rows(done, "request", "reply") == [("ask", "yes")] * 2 and rows(open_, "request") == [("new",)]
    plans = [('```json\n{"queries": [" a ", "", "b", "c", "d", "e"], "after": "2024-05", "before": "soon"}\n```',), ("nothing",)]
    got = [r[0] for r in spark.createDataFrame(plans, "r string").select(logs.parsed_plan(F.col("r"))).collect()]
    assert (got[0]["queries"], got[0]["after"], got[0]["before"]) == (["a", "b", "c", "d"], "2024-05", None) and got[1] is None
    texts = spark.createDataFrame([(1, "ab"), (2, "c")], "key int, text string")
    assert rows(logs.embedded(texts, lambda xs: [[float(len(x))] for x in xs])) == [(1, [2.0]), (2, [1.0])] and logs.embedded(texts, None).count() == 0


def test_alignment_and_ordering():
    same = lambda event, line: event in line
    assert evaluation.aligned(["a", "b"], ["xb", "", "ab", "zb"], same) == ["b", "", "a", "zb"]
    assert evaluation.ordering(["a", "b", "c"], ["a", "b", "c"]) == {"precision": 1, "recall": 1, "f1": 1, "tau": 1, "normalised": 1}
    assert evaluation.ordering(["a", "b"], ["b", "a"])["normalised"] == 0


def test_config():
    c = config.read("recall:\n  max_injected: 5\n  unknown: 1\nextraction:\n  dossiers: false\ngate_enabled: true\nexperimental:\n  gate_mode: sync\n")
    assert c.recall.max_injected == 5 and not c.extraction.dossiers and c.experimental.gate_enabled and c.experimental.gate_mode == "sync" and config.read("") == config.Config()
    with pytest.raises(ValueError):
        config.read("recall:\n  max_injected: many\n")


class Step:
    def __init__(self, at, hashes, hits=(), decision=None):
        self.at, self.hashes, self.hits, self.decision = at, hashes, list(hits), decision


def test_injection_state():
    s = {"seen": 0, "last": None, "anchors": [], "injected": [], "slot": None}
    assert agents.inject(s, Step(0, ["a"], ["m1"], "search x")) == (1, False, ["m1"], 1, None)
    assert agents.inject(s, Step(1000, ["a", "b"], ["m1", "m2"])) == (1, False, ["m1", "m2"], 2, "search x")
    assert agents.inject(s, Step(2000, ["a", "b", "c"], [], "late")) == (1, False, ["m1", "m2"], 2, None)
    assert agents.inject(s, Step(2000 + 700_000, ["z"], ["m1"])) == (1, True, ["m1"], 1, None)
    assert agents.transition("done", 1, "step") == ("open", 1) and agents.transition("open", 1, "request") == ("pending", 1) and agents.transition("pending", 1, "failed") == ("failed", 2) and agents.transition("pending", 2, "done") == ("done", 0)
    assert agents.maintenance_due(None, 5) and not agents.maintenance_due(0, agents.DAY_MS - 1)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).json(path)


def test_agent_streams(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    steps = [{"session_id": "s", "step": k, "at": k, "hashes": ["h"] * k, "hits": ["m"], "decision": "d" if k == 1 else None} for k in (2, 1, 3)]
    (src / "a.json").write_text("\n".join(map(json.dumps, steps)))
    q = agents.injections(stream(spark, str(src), "session_id string, step long, at long, hashes array<string>, hits array<string>, decision string")).writeStream.format("memory").queryName("inj").outputMode("append").option("checkpointLocation", str(out / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["step"], r["new_messages"], r["attached"], r["decision"]) for r in spark.table("inj").orderBy("step").collect()] == [(1, 1, ["m"], None), (2, 1, ["m"], "d"), (3, 1, ["m"], None)]


def test_watched_files_are_indexed(spark, tmp_path):
    files, store = tmp_path / "mem", str(tmp_path / "store")
    files.mkdir()
    (files / "a.md").write_text("---\nid: m1\ntype: fact\n---\nfirst\n")
    (files / "b.md").write_text("no head")
    seen = []
    for body in (None, "second"):
        if body:
            (files / "c.md").write_text(f"---\nid: m1\ntype: fact\nupdated_at: '2025'\n---\n{body}\n")
        q = agents.indexed(agents.watched(spark, str(files)), store, str(tmp_path / "check"), lambda new: seen.append(new.count())).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [r["memory"]["body"] for r in agents.current(spark, store).collect()] == ["second"] and seen == [1, 1]


def test_written_tables_are_released(spark):
    import os

    t = lineage.written(spark.range(3), "x")
    path = t._written_path.replace("file://", "")
    assert os.path.isdir(path)
    lineage.release()
    assert not os.path.isdir(path)


def test_timelines_of_a_tight_scope_are_written_where_its_lines_are(spark, monkeypatch):
    """Questions bring numbers of sessions and meet each line of their scope once a task; before, every question moved the text of its sessions."""
    from mnemospark.operators import logs

    monkeypatch.setattr(logs, "TOLD", 2)
    s = spark.createDataFrame([(f"m{i}", "p", f"2025-01-{i + 1:02d}", f"2025-01-{i + 1:02d}", "x" * 200 + str(i)) for i in range(9)], "mem_id string, scope string, created_at string, said string, content string")
    q = spark.createDataFrame([(f"q{i}", "p") for i in range(7)], "query_id string, scope string")
    near = spark.createDataFrame([(f"q{i}", f"m{(i + j) % 9}", 1.0 - j / 10) for i in range(7) for j in range(4)], "query_id string, mem_id string, score double")
    got = {r["query_id"]: (r["lines"], r["text"]) for r in logs.timelines(q, s, near, 300).collect()}
    for i in range(7):
        sessions = sorted([(i + j) % 9 for j in range(2)])
        assert got[f"q{i}"] == (2, "\n".join(f"- Session {n + 1} [2025-01-{n + 1:02d}] {'x' * 140}…" for n in sessions))
