"""Memory files: a YAML head between ``---`` lines and a Markdown body, one record per file."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType

from mnemospark.functions.text import redact

TRIGGER = StructType([StructField(n, StringType()) for n in ("id", "kind", "pattern", "origin")] + [StructField("disabled", BooleanType()), StructField("before_action", BooleanType())])
MEMORY = StructType(
    [StructField(n, StringType()) for n in ("id", "type", "title", "scope", "status", "source")]
    + [StructField("pinned", BooleanType()), StructField("confidence", DoubleType()), StructField("triggers", ArrayType(TRIGGER))]
    + [StructField(n, StringType()) for n in ("expires", "superseded_by", "created_at", "updated_at", "observed_at", "event_at")]
    + [StructField(n, ArrayType(StringType())) for n in ("supersedes", "conflicts_with", "evidence", "mentioned_at", "topics", "entities")]
    + [StructField("body", StringType())]
)
READ = StructType([StructField("path", StringType()), StructField("memory", MEMORY), StructField("version", StringType()), StructField("error", StringType())])
LISTS = {f.name for f in MEMORY if isinstance(f.dataType, ArrayType)}
# fixed values: fields only the old format has, its words for types and sources, and the order of its conditions, most specific first
OLD_FIELDS = ("card", "tier", "created_by", "valid_to", "evidence_events")
OLD_TYPES = {"state": "fact", "episode": "fact", None: "fact"}
OLD_SOURCES = {"user_statement": "user", None: "user", "env_observation": "observed", "tool_output": "observed"}
OLD_CONDITIONS = ("error_sig", "text", "tool", "files", "file")
OLD_KINDS = {"error_sig": "error", "tool": "tool", "files": "file", "file": "file"}

try:
    import yaml

    class _Loader(yaml.SafeLoader):
        """Dates and times stay text."""

    _Loader.yaml_implicit_resolvers = {c: [(tag, r) for tag, r in rs if not tag.endswith(":timestamp")] for c, rs in yaml.SafeLoader.yaml_implicit_resolvers.items()}
except ImportError:  # files then come out with an error each
    yaml = None


def parse(text: str) -> tuple[dict, str]:
    """(head, body); ValueError if the head is missing, open or no mapping, or the body empty."""
    if not text.startswith("---\n"):
        raise ValueError("no head")
    head, mark, body = text[4:].partition("\n---\n")
    if not mark:
        raise ValueError("head without end")
    if yaml is None:
        raise ValueError("no YAML reader")
    try:
        head = yaml.load(head, _Loader)
    except yaml.YAMLError as e:
        raise ValueError(f"bad head: {e}") from None
    if not isinstance(head, dict) or head.get("id") is None:
        raise ValueError("head without id")
    if not body.strip():
        raise ValueError("empty body")
    return head, body.strip()


def condition(match: dict) -> tuple[str, str, str] | None:
    """(path, operator, value) of the most specific of an old trigger's conditions."""
    ranked = sorted(match, key=lambda k: (OLD_CONDITIONS.index(k) if k in OLD_CONDITIONS else len(OLD_CONDITIONS) + (not k.startswith("args.")), k))
    test = match[ranked[0]] if ranked else None
    if not isinstance(test, dict) or not test:
        return None
    operator, value = next(iter(test.items()))
    if isinstance(value, list):
        value = value[0] if value and isinstance(value[0], str) else None
    return None if value is None else (ranked[0], operator, value if isinstance(value, str) else json.dumps(value))


def upgraded_trigger(old: dict) -> dict | None:
    found = condition(old["match"]) if isinstance(old.get("match"), dict) else None
    if found is None:
        return None
    path, operator, pattern = found
    kind = OLD_KINDS.get(path, "keyword")
    if (kind, operator) == ("keyword", "glob"):
        pattern = pattern.replace("*", "").strip()
    off = bool(old.get("disabled")) or operator == "regex" or len(pattern) < 3
    urgent = old.get("when") == "pre_action" and old.get("priority") == "high"
    return {"id": old.get("id"), "kind": kind, "pattern": pattern, "origin": "migrated", "disabled": off, "before_action": urgent}


def converted(head: dict) -> tuple[dict, str]:
    """A head in today's fields, and the version it was written in."""
    triggers = [t for t in head.get("triggers") or [] if isinstance(t, dict)]
    if not any(head.get(k) is not None for k in OLD_FIELDS) and not any("on" in t or True in t for t in triggers):
        return head, "2"
    kind = head.get("type")
    kind = OLD_TYPES.get(kind, kind)
    title = head.get("title")
    return {
        "id": head["id"], "type": kind, "title": title if title and str(title).strip() else head.get("card"), "scope": head.get("scope"), "status": head.get("status"),
        "source": OLD_SOURCES.get(head.get("source"), "agent"), "pinned": head.get("tier") == "pinned" and kind != "rule", "confidence": head.get("confidence", 0.85),
        "triggers": [t for t in map(upgraded_trigger, triggers) if t], "expires": head.get("valid_to"), "supersedes": head.get("supersedes"), "superseded_by": head.get("superseded_by"),
        "evidence": head.get("evidence_events"), "created_at": head.get("created_at"), "updated_at": head.get("updated_at"),
    }, "1"


def record(head: dict, body: str) -> dict:
    out = {f.name: None for f in MEMORY}
    for name in out:
        v = head.get(name)
        if name in LISTS:
            out[name] = v if isinstance(v, list) else [] if v is None else [v]
            if name != "triggers":
                out[name] = [str(x) for x in out[name] if x is not None]
        elif v is not None:
            out[name] = v
    for name in ("expires", "created_at", "updated_at", "observed_at", "event_at", "title", "id", "superseded_by"):
        out[name] = None if out[name] is None else str(out[name])
    out["scope"] = str(out["scope"] or "global").strip().lower() or "global"
    out["status"] = out["status"] or "active"
    out["pinned"] = bool(out["pinned"])
    out["confidence"] = float(out["confidence"]) if isinstance(out["confidence"], (int, float)) else 0.85 if out["source"] == "user" else 0.6
    out["triggers"] = [{f.name: t.get(f.name) for f in TRIGGER} for t in out["triggers"] if isinstance(t, dict)]
    if not (out["title"] or "").strip():
        line = next(x.strip() for x in body.split("\n") if x.strip())
        out["title"] = line if len(line) <= 60 else line[:60] + "…"
    out["body"] = body
    return out


def _parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for path, text in zip(f["path"], f["value"]):
            try:
                head, body = parse(text)
                head, version = converted(head)
                rows.append((path, record(head, body), version, None))
            except ValueError as e:
                rows.append((path, None, None, str(e)))
        yield pd.DataFrame(rows, columns=["path", "memory", "version", "error"])


def read_memory_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (path, memory, version, error); a bad file is a row with an error, not a failure."""
    return parsed(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value"))


def parsed(files: DataFrame) -> DataFrame:
    """(path, value) to (path, memory, version, error); trigger patterns are redacted, as they are when an old file is converted."""
    rows = files.mapInPandas(_parsed, READ)
    clean = F.transform("memory.triggers", lambda t: t.withField("pattern", redact(t["pattern"])))
    return rows.withColumn("memory", F.when(F.col("memory").isNotNull(), F.col("memory").withField("triggers", clean)))


def rendered(memory: str = "memory") -> Column:
    """A memory struct as file text; absent fields are left out."""
    fields = []
    for f in MEMORY:
        if f.name == "body":
            continue
        c = F.col(f"{memory}.{f.name}")
        text = F.to_json(c) if f.name in LISTS else c.cast("string")
        present = F.size(c) > 0 if f.name in LISTS else c.isNotNull()
        quoted = F.to_json(F.array(c)) if isinstance(f.dataType, StringType) else None
        text = F.substring(quoted, F.lit(2), F.length(quoted) - 2) if quoted is not None else text
        fields.append(F.when(present, F.concat(F.lit(f"{f.name}: "), text)))
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *fields), F.lit("\n---\n"), F.col(f"{memory}.body"))


def write_memory_files(memories: DataFrame, path: str) -> None:
    """Write (memory) rows as one text per id under ``path/mem_id=.../``; the committer makes it atomic."""
    memories.select(F.col("memory.id").alias("mem_id"), rendered().alias("value")).repartition("mem_id").write.mode("overwrite").partitionBy("mem_id").option("lineSep", "\n").text(path)
