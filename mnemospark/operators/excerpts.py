"""Excerpts of conversations: cutting, outlines, windows. Sequential per session, so grouped-map where state is needed."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXCERPT = 1200
PER_SESSION = 400
PREFIX = 300


def windows(text: str, size: int) -> list[str]:
    """Pieces of at most ``size`` characters, cut at white space in the last fifth where there is any."""
    out = []
    while len(text) > size:
        cut = size
        for i in range(size, size - size // 5, -1):
            if text[i - 1].isspace():
                cut = i
                break
        out.append(text[:cut].strip())
        text = text[cut:]
    out.append(text.strip())
    return [x for x in out if x]


def chunks(entries: list[tuple[str, str]], size: int = EXCERPT) -> list[str]:
    """(role, text) entries of a session to excerpts of user and assistant messages.

    A user message opens an excerpt, replies join it while there is room; an excerpt that opens with a reply repeats the head of
    its question. Pieces of a long message after the first carry an ellipsis.
    """
    out: list[list[str]] = []  # lines of each excerpt
    length, head, fresh = 0, "", True
    for role, text in entries:
        text = (text or "").strip()
        if role not in ("user", "assistant") or not text:
            continue
        if role == "user":
            head, fresh = text[:PREFIX], True
        for i, piece in enumerate(windows(text, size)):
            line = f"[{role}] {'…' if i else ''}{piece}"
            if fresh or length + len(line) > size:
                out.append([f"[user] {head}\n"] if role == "assistant" and head else [])
                fresh = False
            out[-1].append(line)
            length = len("\n".join(out[-1]))
    return ["\n".join(x) for x in out][:PER_SESSION]


HEAD = re.compile(r"#{1,6}\s+(.+)")
LEAD = re.compile(r"(?:[-*•]\s+|\d+[.)]\s+)?\*\*(.+?)\*\*")


def outline(reply: str | None) -> str | None:
    """First sentence or line (160 characters), then headings and bold lead-ins, distinct, at most 500 characters; None for a blank reply."""
    reply = (reply or "").strip()
    if not reply:
        return None
    first = re.match(r"[^.!?\n]*[.!?\n]?", reply).group().strip()[:160]
    marked = [HEAD.fullmatch(x) or LEAD.match(x) for x in map(str.strip, reply.split("\n"))]
    items = dict.fromkeys(x for x in (m[1].strip().rstrip(":").strip() for m in marked if m) if x)
    return " | ".join([first, "; ".join(items)] if items else [first])[:500]


def session_excerpts(turns: DataFrame) -> DataFrame:
    """(session_id, turn_no, role, text) to (session_id, seq, excerpt, hash), repeated excerpts of a session once."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("turn_no")
        c = list(dict.fromkeys(chunks(list(zip(f["role"], f["text"])))))
        return pd.DataFrame({"session_id": [f["session_id"].iloc[0]] * len(c), "seq": range(1, len(c) + 1), "excerpt": c})

    e = turns.groupBy("session_id").applyInPandas(run, "session_id string, seq int, excerpt string")
    return e.withColumn("hash", F.sha2("excerpt", 256))


def trimmed(text: str, question: str, window: int) -> str:
    """The stretch around the sentence that shares most words with the question, grown right, then left, to ``window`` characters."""
    sentences = [s for s in re.split(r"(?<=[.!?。！？\n])\s*", text) if s]
    if len(text) <= window or not sentences:
        return text
    asked = set(re.findall(r"\w+", question.lower()))
    best = max(range(len(sentences)), key=lambda i: (len(asked & set(re.findall(r"\w+", sentences[i].lower()))), -i))
    lo = hi = best
    size = len(sentences[best])
    while size < window and hi + 1 < len(sentences):
        hi += 1
        size += len(sentences[hi]) + 1
    while size < window and lo > 0:
        lo -= 1
        size += len(sentences[lo]) + 1
    return ("… " if lo else "") + " ".join(s.strip() for s in sentences[lo : hi + 1]) + (" …" if hi + 1 < len(sentences) else "")


def middle_out(lines: list[tuple[str, str]], most: int = 30_000) -> str:
    """(role, line) digest: lines that aren't the user's go, nearest the middle first, until it fits; never the last line."""
    keep = [True] * len(lines)
    size = sum(len(x) + 1 for _, x in lines)
    mid = len(lines) / 2
    for i in sorted((i for i, (r, _) in enumerate(lines[:-1]) if r != "user"), key=lambda i: (abs(i - mid), i)):
        if size <= most:
            break
        keep[i] = False
        size -= len(lines[i][1]) + 1
    out, gap = [], 0
    for k, (_, line) in zip(keep, lines):
        if k:
            if gap:
                out.append(f"[{gap} steps omitted]")
            out.append(line)
            gap = 0
        else:
            gap += 1
    return "\n".join(out)
