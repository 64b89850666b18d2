"""The engine as Python functions over DataFrames: what a client of the service calls, without transport.

``Engine`` wraps a store of written tables (memories, turns, vectors) in one folder. Reads return DataFrames or
rows of bounded size; writes append versions through the journal.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.config import RecallConfig
from mnemospark.functions import text as T
from mnemospark.functions.lists import MEMORY_TYPES
from mnemospark.operators import index
from mnemospark.sources import journal

BODY = "mem_id string, mem_type string, title string, scope string, status string, source string, confidence double, content string, created_at string"
LIMIT, CONTENT = 50, 20_000
REVIEWED = ("rule", "intent")


class Engine:
    def __init__(self, spark: SparkSession, path: str, cfg: RecallConfig = RecallConfig()) -> None:
        self.spark, self.path, self.cfg = spark, path, cfg

    # -- store ---------------------------------------------------------------------------------

    def versions(self) -> DataFrame:
        try:
            return self.spark.read.schema(journal.VERSIONS).parquet(f"{self.path}/versions")
        except Exception as e:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], journal.VERSIONS)

    def memories(self) -> DataFrame:
        """Current memories, one typed row each."""
        rows = journal.current(self.versions()).withColumn("m", F.from_json("body", BODY))
        return rows.select("version", "m.*")

    def _append(self, updates: list[tuple], batch: str) -> int:
        frame = self.spark.createDataFrame(updates, "mem_id string, body string, expected_version bigint")
        rows = journal.applied(self.versions(), frame, batch)
        done = [tuple(r) for r in rows.collect()]  # one row per given update
        self.spark.createDataFrame(done, journal.VERSIONS).write.mode("append").parquet(f"{self.path}/versions")
        return len(done)

    # -- writes --------------------------------------------------------------------------------

    def remember(self, content: str, mem_type: str = "fact", scope: str = "global", source: str = "user", title: str | None = None, now: str | None = None) -> str:
        """Validate and store a memory; rules and intents of agents wait for review. Returns its id."""
        if mem_type not in MEMORY_TYPES:
            raise ValueError(f"unknown type {mem_type}")
        if not content.strip() or len(content.encode()) > CONTENT:
            raise ValueError("content must have 1 to 20000 bytes")
        now = now or dt.datetime.now(dt.UTC).isoformat()
        number = self.versions().select("mem_id").distinct().count()
        mem_id = "mem_" + f"{number:026d}"
        first = next(x.strip() for x in content.split("\n") if x.strip())
        row = {
            "mem_id": mem_id, "mem_type": mem_type, "title": title or (first if len(first) <= 60 else first[:60] + "…"), "scope": scope.strip().lower() or "global",
            "status": "pending_review" if source != "user" and mem_type in REVIEWED else "active", "source": source, "confidence": 0.85 if source == "user" else 0.6, "content": content, "created_at": now,
        }
        self._append([(mem_id, json.dumps(row, ensure_ascii=False), 0)], f"remember:{mem_id}")
        return mem_id

    def _change(self, mem_id: str, change, batch: str) -> bool:
        row = self.memories().where(F.col("mem_id") == mem_id).first()
        if row is None:
            return False
        d = row.asDict()
        version = d.pop("version")
        new = change(d)
        return bool(new) and self._append([(mem_id, json.dumps(new, ensure_ascii=False), version)], f"{batch}:{mem_id}:{version}") == 1

    def review(self, mem_id: str, approve: bool) -> bool:
        return self._change(mem_id, lambda d: d | {"status": "active" if approve else "archived"} if d["status"] == "pending_review" else None, "review")

    def flag(self, mem_id: str) -> bool:
        """A memory someone doubts: contested, confidence lower by 0.2 but not under 0.1."""
        return self._change(mem_id, lambda d: d | {"status": "contested", "confidence": max(0.1, round(d["confidence"] - 0.2, 6))}, "flag")

    def edit(self, mem_id: str, content: str) -> bool:
        return self._change(mem_id, lambda d: d | {"content": content}, "edit")

    def forget(self, mem_id: str) -> bool:
        return self._change(mem_id, lambda d: d | {"status": "archived"}, "forget")

    def rollback(self, batch: str) -> None:
        rows = journal.rolled_back(self.versions(), batch).collect()
        self.spark.createDataFrame([tuple(r) for r in rows], journal.VERSIONS).write.mode("append").parquet(f"{self.path}/versions")

    # -- reads ---------------------------------------------------------------------------------

    def expand(self, mem_id: str) -> dict | None:
        row = self.memories().where(F.col("mem_id") == mem_id).first()
        return row.asDict() if row else None

    def recall_many(self, questions: DataFrame, limit: int = 10) -> DataFrame:
        """(query_id, mem_id, keyword, rank) for questions (query_id, project, text): one plan for all of them."""
        live = self.memories().where(F.col("status").isin("active", "contested") & (F.col("mem_type") != "summary"))
        docs = live.select("mem_id", "scope", F.concat_ws("\n", "title", "content").alias("text"))
        scores, ids, names = index.keyword_scores(docs, questions, self.cfg)
        named = index.named(scores.where(F.col("keyword") >= self.cfg.min_keyword_fallback), ids, names).withColumn("keyword", F.round("keyword", 6))
        return index.top(named, "query_id", "keyword", "mem_id", min(limit, LIMIT)).select("query_id", "mem_id", "keyword", "rank")

    def recall(self, text: str, project: str | None = None, limit: int = 10) -> list[dict]:
        asked = self.spark.createDataFrame([("q", project, text[:4000])], "query_id string, project string, text string")
        hits = self.recall_many(asked, limit).join(self.memories().select("mem_id", "title", "content", "created_at"), "mem_id")
        return [r.asDict() for r in hits.orderBy("rank").drop("query_id").collect()]

    def stats(self) -> dict:
        return self.memories().agg(F.count("*").alias("memories"), F.count_if(F.col("status") == "active").alias("active"), F.coalesce(F.sum(T.estimated_tokens(F.col("content"))), F.lit(0)).alias("tokens")).first().asDict()


def main(argv: list[str] | None = None) -> None:
    """``python -m mnemospark.api STORE recall|remember|forget|flag|stats|query ...``"""
    import argparse

    p = argparse.ArgumentParser(prog="mnemospark")
    p.add_argument("store")
    p.add_argument("command", choices=["recall", "remember", "forget", "flag", "expand", "stats", "query"])
    p.add_argument("text", nargs="?")
    p.add_argument("--project")
    p.add_argument("--type", default="fact")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("mnemospark").getOrCreate()
    e = Engine(spark, a.store)
    if a.command == "query":  # a registered query over the tables in STORE
        from mnemospark.catalog import QUERIES

        QUERIES[a.text](spark, a.store).show(50, False)
        return
    out = {
        "recall": lambda: e.recall(a.text, a.project), "remember": lambda: e.remember(a.text, a.type, a.project or "global"), "forget": lambda: e.forget(a.text), "flag": lambda: e.flag(a.text),
        "expand": lambda: e.expand(a.text), "stats": e.stats,
    }[a.command]()
    print(json.dumps(out, ensure_ascii=False, default=str))


if __name__ == "__main__":
    main()
