import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.functions.lists import INTENT_CUES, NEGATION_CUES
from mnemospark.operators import briefs, classifier, consolidation, dossiers, evaluation, excerpts, planned, retrieval, triggers
from mnemospark.sources import events, journal, memory_files, messages


def one(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(expr).first()[0]


def test_tokens_and_stems(spark):
    df = spark.createDataFrame([("The retry_handler failed, studies using 数据库 running! class bus",)], "t string")
    got = [r[0] for r in df.select(F.explode(T.raw_words(F.col("t"))).alias("w")).select(T.term(F.col("w")).alias("x")).where("x is not null").collect()]
    assert sorted(got) == sorted(["retry_handler", "retry", "handler", "fail", "study", "runn", "class", "bus", "数据", "据库"])


def test_text_functions(spark):
    c = F.col("t")
    assert one(spark, T.number_key(c), t="3 cats on 2024-01-02, 1,200 dogs, 3 more") == "1200 3"
    assert one(spark, T.default_title(c), t="\n  \n" + "x" * 70) == "x" * 60 + "…"
    assert one(spark, T.unfence(c), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, T.clip(c, 30), t="a" * 100) == "a" * 20 + " … " + "a" * 10
    assert one(spark, T.redact_patterns(c), t="password: hunter2, ok") == "[REDACTED], ok"
    a, b = (one(spark, T.error_signature(c), t=f"ok\nError at /tmp/x{i} line {i}0: code {i}234") for i in (1, 2))
    assert a == b and "<temp>" in a
    assert one(spark, T.error_signature(c), t="fine") is None
    assert [one(spark, T.normalize_date(c), t=x) for x in ("2024", "2024/05", "2024-05-06", "May 2024")] == ["2024", "2024-05", "2024-05-06", None]
    assert one(spark, T.day_gap(c, F.lit("2024-01-01")), t="2024-02") == 31
    assert one(spark, T.has_cue(c, INTENT_CUES["aggregate"]), t="How many? ") and not one(spark, T.has_cue(c, INTENT_CUES["aggregate"]), t="accountable")
    assert one(spark, T.has_cue(c, NEGATION_CUES), t="I have never been there") and one(spark, T.has_cue(c, NEGATION_CUES), t="我从来没去过")


def test_date_ranges_and_windows(spark):
    assert one(spark, planned.in_window(F.col("d"), F.lit("2024-03-01"), F.lit("2024-03-31")), d="2024-03")
    assert not one(spark, planned.in_window(F.col("d"), F.lit("2024-03-01"), F.lit("2024-03-31")), d="2024-02-28")
    hits = spark.createDataFrame([("q", 0, "rock", 0.5, "2024-03-10"), ("q", 1, "jazz", 0.6, "2024-02-10"), ("q", 1, "rock", 0.4, "2024-03-10"), ("q", 0, "pop", 0.1, None)], "question_id string, query_no int, mem_id string, score double, date string")
    plans = spark.createDataFrame([("q", "2024-03-01", "2024-03-31")], "question_id string, after string, before string")
    got = planned.planned(hits, plans, 2).orderBy("position").collect()
    assert [r["mem_id"] for r in got] == ["rock", "jazz"] and got[0]["score"] == pytest.approx(0.65)


def test_greedy_groups():
    v = [np.array([np.cos(a), np.sin(a)]) if a is not None else None for a in (0, 1.2, 0.3, None, 1.3)]
    assert retrieval.greedy_groups(v) == [[0, 2], [1, 4], [3]]


def test_budgets(spark):
    rows = spark.createDataFrame([("s", i, c) for i, c in enumerate([40, 70, 30, 50, 20])], "s string, n int, c int")
    assert sorted(r["n"] for r in retrieval.greedy_budget(rows.withColumn("id", F.col("n")), "s", ["n"], "id", "c", 100).select(F.col("id").alias("n")).collect()) == [0, 2, 4]
    assert [r["n"] for r in retrieval.prefix_budget(rows, "s", ["n"], F.col("c"), 100).orderBy("n").collect()] == [0]


def test_pack():
    hits = [{"id": "mem_a", "tokens": 20, "kind": "memory"}, {"id": "huge", "tokens": 500, "kind": "memory"}, {"id": "mem_b", "tokens": 30, "kind": "memory"}, {"id": "ep_1", "tokens": 25, "kind": "excerpt"}]
    assert [h["id"] for h in retrieval.pack(hits, 100)] == ["mem_a", "mem_b", "ep_1"]


def test_triggers(spark):
    mem = spark.createDataFrame(
        [("m1", "global", [("t1", "keyword", "deploy", False, False)]), ("m2", "web", [("t2", "file", "src/**/*.py", False, False), ("t3", "tool", "bash", True, False)]), ("m3", "api", [("t4", "error", "timeout", False, True)])],
        "mem_id string, scope string, triggers array<struct<id:string,kind:string,pattern:string,disabled:boolean,before_action:boolean>>",
    )
    steps = spark.createDataFrame([("s1", "Web", "please Deploy it", None, None, "bash", ["app/src/a/b.py"]), ("s2", "api", None, "{}", "Timeout after <id>", None, None), ("s3", None, "nothing", None, None, None, [])], "step_id string, project string, user_text string, args string, error_sig string, tool string, files array<string>")
    assert {tuple(r) for r in triggers.fired(steps, mem).collect()} == {("s1", "m1", "t1"), ("s1", "m2", "t2"), ("s2", "m3", "t4")}
    assert {r["mem_id"] for r in triggers.fired(steps, mem, before_action=True).collect()} == {"m3"}
    assert one(spark, triggers.mentions(F.col("t"), F.lit("Ann")), t="ask ann.") and not one(spark, triggers.mentions(F.col("t"), F.lit("Ann")), t="annual")


def test_excerpts(spark):
    assert [len(x) for x in excerpts.windows("字" * 2500, 1000)] == [1000, 1000, 500]
    c = excerpts.chunks([("system", "no"), ("user", "what about " + "q" * 50), ("assistant", "word " * 900), ("user", "next")])
    assert len(c) > 3 and all(len(x) <= 1520 for x in c) and all("what about" in x for x in c[:-1]) and c[-1] == "[user] next"
    assert excerpts.outline("Do this first. Then that.\n# Plan\n- **Step one:** x\n1. **Plan**") == "Do this first. | Plan; Step one"
    assert excerpts.outline("# Top\nrest") == "# Top | Top" and excerpts.outline(" ") is None
    t = spark.createDataFrame([("s", 1, "user", "a"), ("s", 2, "assistant", "b"), ("s", 3, "user", "a"), ("s", 4, "assistant", "b")], "session_id string, turn_no int, role string, text string")
    assert [r["excerpt"] for r in excerpts.session_excerpts(t).orderBy("seq").collect()] == ["[user] a\n[assistant] b"]
    assert "cat" in excerpts.trimmed("One. " * 50 + "The cat sat. " + "Two. " * 50, "where sat the cat", 40)
    d = excerpts.middle_out([("user", "u" * 10), *[("tool", "t" * 10)] * 20, ("assistant", "end")], 60)
    assert d.startswith("u") and d.endswith("end") and "steps omitted" in d


def test_dossiers(spark):
    schema = "scope string, topic string, kind string, name string, value string, item string, turn int"
    r = spark.createDataFrame([("s", "t", None, "port", "80", None, 1), ("s", "t", None, "port", "80 ", None, 2), ("s", "t", None, "port", "443", None, 5), ("s", "t", "tool", None, None, "Vim", 3), ("s", "t", "tool", None, None, "vim", 4)], schema)
    assert dossiers.rendered(r).first()["text"] == "- port: 443 (earlier 80)\n- tool: Vim"
    assert sum(map(len, dossiers.fit(["a" * 50, "b" * 10], 40))) == 40
    assert dossiers.fit_for(["alpha beta", "gamma delta", "beta gamma"], 12, {"delta"}) == ["gamma delta"]
    have = spark.createDataFrame([("s", "a", "x"), ("s", "b", "y"), ("s", "c", "z")], "scope string, topic string, text string")
    want = spark.createDataFrame([("s", "a", "x"), ("s", "b", "Y"), ("s", "d", "z")], "scope string, topic string, text string")
    assert {(r["topic"], r["action"]) for r in dossiers.narrative_changes(have, want).collect()} == {("b", "rewrite"), ("c", "archive"), ("d", "add")}


def test_briefs():
    assert briefs.check_days("Answer: 67 days, from March 3 to May 6, 2024") == "Answer: 64 days, from March 3 to May 6, 2024"
    assert briefs.check_days("Answer: 3 days or 5 days from March 3 to May 6") == "Answer: 3 days or 5 days from March 3 to May 6"
    assert briefs.check_days("Answer: 5 days from December 30, 2023 to January 2") == "Answer: 3 days from December 30, 2023 to January 2"
    for stays in ("Answer: 1 days from December 30 to January 2", "Answer: 16 days, from April 5 to April 21, 2024, noted May 1.", "5 days from March 3 to May 6, 2024"):
        assert briefs.check_days(stays) == stays
    assert briefs.check_days("x\nAnswer: 4 days, Jan. 3, 2024 to Jan 4, noted May 1\ny") == "x\nAnswer: 1 day, Jan. 3, 2024 to Jan 4, noted May 1\ny"
    assert briefs.dates("on Sept 3rd, 2021, then 2022/1/05") == [(2021, 9, 3), (2022, 1, 5)]
    assert briefs.days_between("2024-01-01", "January 17") == "16 days from 2024-01-01 to 2024-01-17 (2 weeks and 2 days)"
    assert briefs.days_between("soon", "2024-01-01").startswith("error")
    assert briefs.calls("LOOKUP search: cats\nx\n- lookup read_turns: #3, #4") == [("search", "cats"), ("read_turns", "#3, #4")] and briefs.calls("DONE\nLOOKUP search: x") == []


def test_lookups(spark):
    t = spark.createDataFrame([(1, "2024-01-01", "about cats", "meow"), (2, None, "dogs", None)], "number int, observed_at string, text string, reply string")
    assert briefs.run(("user_messages", "cats"), t, None, ranked=lambda q: [1]) == "- #1 [2024-01-01] about cats"
    assert briefs.run(("user_messages", "#1-#2"), t, None) == "- #1 [2024-01-01] about cats\n- #2 [date unknown] dogs"
    assert briefs.run(("read_turns", "#1"), t, None) == "### Turn #1 [2024-01-01]\nUser: about cats\nAssistant: meow"
    assert briefs.run(("timeline", ""), t, None) == "No timeline." and briefs.run(("read_turns", "9"), t, None) == "No such turns."
    assert briefs.run(("days_between", "2024-01-01 | 2024-01-03"), t, None).startswith("2 days") and briefs.run(("fly", ""), t, None).startswith("error")


def test_redaction_of_values(spark):
    key = "Ab3dE6gH1jK4mN7pQ0rS2tU5vW8xY9zC"
    f = lambda x: spark.createDataFrame([(x,)], "x string").select(T.redact_json(F.col("x")), T.redact(F.col("x"))).first()
    got = f(json.dumps({"token": "abc", "text": "password: hunter2 ok", "n": [1, "sk-" + "a1" * 12, {"k": key}], "q": 'say "x"'}))[0]
    assert json.loads(got) == {"token": "abc", "text": "[REDACTED] ok", "n": [1, "[REDACTED]", {"k": "[REDACTED:high_entropy]"}], "q": 'say "x"'}
    assert f(f"key -{key}- end")[1] == "key -[REDACTED:high_entropy]- end" and f("a" * 40)[1] == "a" * 40 and f("token=abc")[0] == "[REDACTED]"


def test_grounding(spark):
    said = "ran cargo test in src/kal/melvor.rs; error[E0308] mismatched types; deployctl rollout"
    rows = [("command", "cargo test"), ("command", "deployctl"), ("file", "src/**/melvor.rs"), ("file", "*.rs"), ("error", "error[E0308]"), ("error", "E03"), ("tool", "deployctl"), ("command", "nothing"), ("command", None)]
    df = spark.createDataFrame([(rows, said)], "p array<struct<kind: string, pattern: string>>, t string")
    got = df.select(triggers.grounded(F.col("p"), F.col("t"))).first()[0]
    assert [tuple(x) for x in got] == [("keyword", "deployctl"), ("file", "src/**/melvor.rs"), ("file", "*.rs")]
    ents = spark.createDataFrame([(["Kal", "kal", "Zed", " "], said)], "e array<string>, t string").select(triggers.grounded_entities(F.col("e"), F.col("t"))).first()[0]
    assert ents == ["Kal", "kal"]


def test_classifier(spark):
    rng = np.random.default_rng(0)
    s = [(classifier.slots({"text": ("deploy now" if y else "hello there") + f" w{rng.integers(5)}"}), bool(y)) for y in rng.integers(0, 2, 2500)]
    m = classifier.trained(s)
    assert m["precision"] > 0.98 and classifier.trained(s[:100]) is None
    df = spark.createDataFrame([("a", s[0][0])], "sample_id string, slots array<int>")
    w = spark.createDataFrame(list(enumerate(m["weights"])), "slot int, weight double")
    assert classifier.scored(df, w).first()["probability"] == pytest.approx(classifier.probability(np.array(m["weights"]), s[0][0]))


def test_gate_decisions(spark):
    steps = spark.createDataFrame([("a", "user", None, "hi"), ("b", "tool", "E", None), ("c", "tool", None, None)], "step_id string, role string, error_sig string, user_text string")
    v = spark.createDataFrame([("a", False, "q", ["1", "2", "3", "4"])], "step_id string, search boolean, query string, ids array<string>")
    got = {r["step_id"]: r for r in classifier.decided(steps, v).collect()}
    assert not got["a"]["search"] and len(got["a"]["ids"]) == 3 and got["b"]["search"] and got["b"]["fallback"] and not got["c"]["search"]


def test_memory_files(spark, tmp_path):
    good = '---\nid: mem_1\ntype: fact\nscope: Web\nsource: user\ncreated_at: 2024-05-01\ntriggers:\n  - id: t1\n    kind: keyword\n    pattern: deploy it\ntopics: ["a", "b"]\n---\nThe body\nline two\n'
    old = (
        "---\nid: mem_2\ntype: state\ncard: The card\ntier: pinned\nsource: tool_output\nvalid_to: 2031-01-01\nevidence_events:\n- ev_1\ntriggers:\n- id: t9\n  on: step\n  when: pre_action\n  priority: high\n"
        "  match:\n    tool: {equals: bash}\n    text: {glob: '*deploy*'}\n- on: step\n  match:\n    args.path: {regex: x.*y}\n---\nold body"
    )
    for n, t in {"a.md": good, "b.md": old, "c.md": "no head", "d.md": "---\nid: x\n---\n"}.items():
        (tmp_path / n).write_text(t)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in memory_files.read_memory_files(spark, str(tmp_path)).collect()}
    assert rows["a.md"]["memory"]["topics"] == ["a", "b"] and rows["a.md"]["memory"]["scope"] == "web" and rows["a.md"]["memory"]["confidence"] == 0.85
    m = rows["a.md"]["memory"]
    assert (m["type"], m["title"], m["created_at"], m["triggers"][0]["pattern"], rows["a.md"]["version"]) == ("fact", "The body", "2024-05-01", "deploy it", "2")
    m = rows["b.md"]["memory"]
    assert rows["b.md"]["version"] == "1" and (m["type"], m["title"], m["pinned"], m["source"], m["expires"], m["evidence"]) == ("fact", "The card", True, "observed", "2031-01-01", ["ev_1"])
    assert [(t["kind"], t["pattern"], t["disabled"], t["before_action"]) for t in m["triggers"]] == [("keyword", "deploy", False, True), ("keyword", "x.*y", True, False)]
    assert rows["c.md"]["error"] == "no head" and rows["d.md"]["error"] == "empty body"
    out = tmp_path / "out"
    memory_files.write_memory_files(memory_files.read_memory_files(spark, str(tmp_path / "a.md")).where("error is null"), str(out))
    back = memory_files.read_memory_files(spark, str(out / "mem_id=mem_1")).first()
    assert back["memory"] == rows["a.md"]["memory"]


def test_protocols(spark):
    chat = json.dumps({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": [{"type": "text", "text": "hi"}]}, {"role": "assistant", "tool_calls": [{"id": "c1", "function": {"name": "bash", "arguments": "{}"}}]}, {"role": "tool", "tool_call_id": "c1", "content": "exit code: 2\nsee src/a.py"}]})
    df = spark.createDataFrame([(chat,)], "b string").select(messages.normalized_messages(F.col("b")).alias("m"))
    m = df.first()["m"]
    assert [x["role"] for x in m] == ["system", "user", "assistant", "tool"] and m[1]["text"] == "hi"
    r = df.select(messages.tool_result(F.col("m")).alias("r"), messages.anchor(F.col("m")).alias("a")).first()
    assert r["r"]["tool"] == "bash" and r["a"]["role"] == "tool"
    o = spark.createDataFrame([(r["r"]["output"],)], "o string").select(messages.exit_code(F.col("o")), messages.files_of(F.col("o"))).first()
    assert o[0] == 2 and o[1] == ["src/a.py"]
    assert one(spark, messages.protocol_of(F.col("p")), p="/v1/responses") == "responses"


def test_event_stream(spark):
    sse = 'data: {"model":"m","choices":[{"delta":{"content":"Hel"}}]}\n\ndata: {"choices":[{"delta":{"content":"lo"}}]}\ndata: {"usage":{"prompt_tokens":5,"completion_tokens":2}}\ndata: [DONE]\n'
    whole = '{"model":"n","content":[{"text":"Hi"}],"usage":{"input_tokens":7,"output_tokens":1}}'
    got = {r["id"]: r for r in messages.event_stream(spark.createDataFrame([("a", sse), ("b", whole)], "id string, body string"), "id", "body").collect()}
    assert (got["a"]["text"], got["a"]["input"], got["a"]["output"], got["a"]["model"]) == ("Hello", 5, 2, "m")
    assert (got["b"]["text"], got["b"]["input"]) == ("Hi", 7)


def test_sealed_events_and_vectors(spark, tmp_path):
    key = bytes(range(32))
    e = spark.createDataFrame([("1", "2024", "a", "p", "s", "k", "token=abc", '{"x":1}')], "id string, ts string, agent string, project string, session_id string, kind string, features string, payload string")
    r = events.appended(e, key).select("features", events.opened(F.col("payload"), F.lit(bytearray(key))).alias("p"), events.opened(F.col("payload"), F.lit(bytearray(32))).alias("w")).first()
    assert r["p"] == '{"x":1}' and r["w"] is None and r["features"] == "[REDACTED]"
    v = [0.0, 1.0, -2.5, 0.1, 3.4e38, 1e-30]
    b = spark.createDataFrame([(v,)], "v array<float>").select(events.vector_bytes(F.col("v"))).first()[0]
    assert np.array_equal(np.frombuffer(bytes(b), "<f4"), np.array(v, np.float32))
    (tmp_path / "t.jsonl").write_text('{"query": "a", "expected_memory_ids": ["m"]}\n\n{"query": "b"}\n')
    assert [r["query"] for r in events.read_traces(spark, str(tmp_path / "t.jsonl")).collect()] == ["a", "b"]


def test_journal(spark):
    v = spark.createDataFrame([("a", 1, "b0", "x", False)], journal.VERSIONS)
    u = spark.createDataFrame([("a", "y", 1), ("n", "new", 0), ("z", "lost", 3)], "mem_id string, body string, expected_version bigint")
    v1 = v.unionByName(journal.applied(v, u, "b1"))
    assert {(r["mem_id"], r["body"]) for r in journal.current(v1).collect()} == {("a", "y"), ("n", "new")}
    v2 = v1.unionByName(journal.rolled_back(v1, "b1"))
    assert {(r["mem_id"], r["body"]) for r in journal.current(v2).collect()} == {("a", "x")}
    v3 = v1.unionByName(journal.applied(v1, spark.createDataFrame([("a", "later", 2)], u.schema), "b2"))
    with pytest.raises(ValueError):
        journal.rolled_back(v3, "b1")


def test_proposals(spark):
    m = spark.createDataFrame([("a", "s", "old", "active", 0), ("b", "s", "keep", "active", 0), ("c", "t", "c", "active", 0)], "mem_id string, scope string, content string, status string, mentions bigint")
    p = spark.createDataFrame([("s", 1, "create", "n", "new"), ("s", 2, "supersede", "a", "newer"), ("s", 3, "mention", "n", None), ("s", 4, "update", "nope", "x"), ("t", 1, "contradict", "c", None)], "scope string, seq int, action string, mem_id string, content string")
    got = {r["mem_id"]: (r["content"], r["status"], r["mentions"]) for r in consolidation.apply_proposals(m, p).collect()}
    assert got == {"a": ("old", "superseded", 0), "a+2": ("newer", "active", 0), "b": ("keep", "active", 0), "n": ("new", "active", 1), "c": ("c", "contested", 0)}
    e = spark.createDataFrame([("a", "2020-01-01", "active"), ("b", "soon", "active"), ("c", None, "active")], "mem_id string, expires string, status string")
    assert {r["mem_id"]: r["status"] for r in consolidation.expired(e, dt.datetime(2024, 1, 1)).collect()} == {"a": "archived", "b": "active", "c": "active"}


def test_digests(spark):
    rows = [(f"m{i}", "S", "fact", f"title {i}", ["t"], f"2022-{11 + i % 2}") for i in range(25)] + [("x", "s", "digest", "no", ["t"], "2020")]
    d = consolidation.topic_digests(spark.createDataFrame(rows, "mem_id string, mem_scope string, mem_type string, title string, topics array<string>, created_at string")).first()
    assert d["members"] == 25 and len(d["digest"].split("\n")) == 25 and d["digest"].startswith("- title 0\n")


def test_metrics(spark):
    lo, hi = spark.range(1).select(*evaluation.wilson(F.lit(93.0), F.lit(100.0))).first()
    assert 0.86 < lo < 0.87 and 0.96 < hi < 0.97
    r = spark.createDataFrame([("g", i, float(x), float(y)) for i, (x, y) in enumerate([(1, 1), (2, 2), (3, 4), (4, 3)])], "g string, i int, x double, y double")
    assert evaluation.kendall_tau_b(r, "g", "i", "x", "y").first()["tau"] == pytest.approx(0.666667)
    s = evaluation.largest_remainder(spark.createDataFrame([("a", 50), ("b", 30), ("c", 20)], "k string, n int"), "k", "n", 7)
    assert {x["k"]: x["seats"] for x in s.collect()} == {"a": 4, "b": 2, "c": 1}


def test_idle_boundary(spark):
    from mnemospark.streaming.sessions import idle_sessions

    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0, 1), (1, t0 + dt.timedelta(seconds=599), 2), (1, t0 + dt.timedelta(seconds=1199), 3), (1, t0 + dt.timedelta(seconds=1200), 4)]
    got = [r["session"] for r in idle_sessions(spark.createDataFrame(rows, "u int, ts timestamp, e int"), "u", "ts", "e", 600).orderBy("e").collect()]
    assert got == [1, 1, 2, 2]


def test_session_stream(spark, tmp_path):
    from mnemospark.streaming.sessions import session_deltas

    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    rows = [("s", 1, ["a", "b"]), ("s", 2, ["a", "b", "c"]), ("s", 3, ["a", "x"]), ("t", 1, ["q"])]
    (src / "1.json").write_text("\n".join(json.dumps({"session_id": a, "step": b, "hashes": c}) for a, b, c in rows))
    steps = spark.readStream.schema("session_id string, step int, hashes array<string>").json(str(src))
    q = session_deltas(steps).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = sorted((r["session_id"], r["seen"], r["new_messages"], r["rewritten"]) for r in spark.read.parquet(str(out)).collect())
    assert got == [("s", 2, 2, False), ("s", 2, 2, True), ("s", 3, 1, False), ("t", 1, 1, False)]


def test_core_stands_alone():
    from pathlib import Path

    for p in Path(T.__file__).parents[1].rglob("*.py"):
        if "llm" not in p.parts:
            assert "mnemospark.llm" not in p.read_text()
