"""Agent traffic: request protocols, tool results, event streams and usage, as JVM-side expressions over JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.lists import EXIT_CODE, FILE_PATH

# protocol: where its messages are
MESSAGE_PATHS = {"chat": "messages", "messages": "messages", "responses": "input"}
PART = "array<struct<type:string,text:string,name:string,id:string,tool_use_id:string,input:string,content:string>>"
CALLS = "array<struct<id:string,function:struct<name:string,arguments:string>>>"
MESSAGE = f"array<struct<role:string,type:string,content:string,name:string,call_id:string,tool_call_id:string,arguments:string,output:string,tool_calls:{CALLS}>>"


def protocol_of(path: Column) -> Column:
    return F.when(path.endswith("/chat/completions"), "chat").when(path.endswith("/responses"), "responses").when(path.endswith("/messages"), "messages")


def content_text(content: Column) -> Column:
    """Text of a message's content: a plain string, or the text parts of a list, one per line."""
    parts = F.from_json(content, PART)
    texts = F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull())
    return F.when(content.startswith("["), F.array_join(texts, "\n")).otherwise(content)


def normalized_messages(body: Column) -> Column:
    """array<struct<role, text, tool, call>> of a request of any protocol; system and developer messages are kept with their role."""
    raw = F.coalesce(F.get_json_object(body, "$.messages"), F.get_json_object(body, "$.input"))
    plain = F.when(~raw.startswith("["), F.to_json(F.array(F.struct(F.lit("user").alias("role"), raw.alias("content"))))).otherwise(raw)
    role = lambda m: (
        F.when(m["type"].isin("function_call_output") | (m["role"] == "tool"), "tool").when(m["type"] == "function_call", "assistant").when(m["content"].contains('"tool_result"'), "tool").otherwise(m["role"])
    )
    return F.transform(
        F.from_json(plain, MESSAGE),
        lambda m: F.struct(
            role(m).alias("role"),
            F.coalesce(content_text(m["content"]), m["output"]).alias("text"),
            F.coalesce(m["name"], F.get(m["tool_calls"], F.lit(0))["function"]["name"]).alias("tool"),
            F.coalesce(m["call_id"], m["tool_call_id"], F.get(m["tool_calls"], F.lit(0))["id"]).alias("call"),
            F.coalesce(m["arguments"], F.get(m["tool_calls"], F.lit(0))["function"]["arguments"]).alias("arguments"),
        ),
    )


def anchor(messages: Column) -> Column:
    """The latest user or tool message."""
    return F.element_at(F.filter(messages, lambda m: m["role"].isin("user", "tool")), -1)


def tool_result(messages: Column) -> Column:
    """struct<tool, arguments, output> of the last message if it is a tool result; the call is matched by id, latest first."""
    last = F.element_at(messages, -1)
    calls = F.filter(messages, lambda m: (m["role"] == "assistant") & (m["call"] == last["call"]))
    call = F.when(F.size(calls) > 0, F.element_at(calls, -1))
    return F.when(last["role"] == "tool", F.struct(F.coalesce(call["tool"], last["tool"]).alias("tool"), call["arguments"].alias("arguments"), last["text"].alias("output")))


def files_of(output: Column, most: int = 8) -> Column:
    return F.slice(F.regexp_extract_all(output, F.lit(FILE_PATH), F.lit(0)), 1, most)


def exit_code(output: Column) -> Column:
    return F.nullif(F.regexp_extract(output, EXIT_CODE, 1), F.lit("")).cast("bigint")


def usage(body: Column) -> Column:
    """struct<input, output, cached, total, model> with the fall-back names of the protocols."""
    def first(*paths: str) -> Column:
        return F.coalesce(*[F.get_json_object(body, p).cast("bigint") for p in paths])

    return F.struct(
        first("$.usage.input_tokens", "$.usage.prompt_tokens", "$.response.usage.input_tokens", "$.message.usage.input_tokens").alias("input"),
        first("$.usage.output_tokens", "$.usage.completion_tokens", "$.response.usage.output_tokens").alias("output"),
        first("$.usage.cache_read_input_tokens", "$.usage.prompt_tokens_details.cached_tokens", "$.usage.input_tokens_details.cached_tokens").alias("cached"),
        first("$.usage.total_tokens").alias("total"),
        F.coalesce(F.get_json_object(body, "$.model"), F.get_json_object(body, "$.response.model"), F.get_json_object(body, "$.message.model")).alias("model"),
    )


def event_stream(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, text, input, output, model) of whole-JSON or ``data:`` line responses.

    Lines are read in order; of each usage field the last non-null value counts, text deltas are joined.
    """
    whole = F.trim(F.col(body)).startswith("{")
    lines = F.when(whole, F.array(F.col(body))).otherwise(F.transform(F.filter(F.split(F.col(body), "\n"), lambda x: x.startswith("data:")), lambda x: F.trim(F.substring(x, 6, 1 << 30))))
    rows = bodies.select(key, F.posexplode(lines).alias("n", "line")).where("line <> '[DONE]'")
    delta = F.coalesce(
        F.get_json_object("line", "$.choices[0].delta.content"), F.get_json_object("line", "$.choices[0].message.content"), F.get_json_object("line", "$.delta.text"),
        F.when(F.get_json_object("line", "$.delta").startswith("{"), None).otherwise(F.get_json_object("line", "$.delta")), F.get_json_object("line", "$.content[0].text"),
    )
    u = usage(F.col("line"))
    rows = rows.select(key, "n", delta.alias("delta"), u.alias("u"))
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("n")))
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("delta").isNotNull(), F.struct("n", "delta")))), lambda x: x["delta"])
    return rows.groupBy(key).agg(F.array_join(parts, "").alias("text"), last("u.input").alias("input"), last("u.output").alias("output"), last("u.model").alias("model"))
