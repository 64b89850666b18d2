"""Briefs: dates in text, repaired day counts, the lookup mini-language."""

from __future__ import annotations

import datetime as dt
import re

from mnemospark.functions.lists import DAY_COUNT, NAMED_DATE, NUMERIC_DATE

MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
NAMED, NUMERIC, DAYS = re.compile(NAMED_DATE), re.compile(NUMERIC_DATE), re.compile(DAY_COUNT)


def dates(text: str) -> list[tuple[int | None, int, int]]:
    """(year, month, day) of named and numeric dates in order of appearance."""
    named = ((m.start(), m[3] and int(m[3]), MONTHS[m[1].lower()], int(m[2])) for m in NAMED.finditer(text))
    numeric = ((m.start(), int(m[1]), int(m[2]), int(m[3])) for m in NUMERIC.finditer(text))
    return [d[1:] for d in sorted((*named, *numeric), key=lambda d: d[0])]


def _span(a, b, wrap: bool) -> tuple[dt.date, dt.date] | None:
    """Two named dates as days, each without a year in the other's; with ``wrap``, a second one without a year never lies before the first."""
    years = a[0] or b[0], b[0] or a[0]
    if None in years:
        return None
    try:
        first, second = dt.date(years[0], *a[1:]), dt.date(years[1], *b[1:])
        if wrap and second < first and b[0] is None:
            second = second.replace(year=second.year + 1)
    except ValueError:
        return None
    return first, second


def days_between(a: str, b: str) -> str:
    """Calendar days between the first dates of two texts, with weeks and remainder."""
    found = [dates(x)[:1] for x in (a, b)]
    span = _span(found[0][0], found[1][0], False) if all(found) else None
    if not span:
        return "error: could not read the dates (use YYYY-MM-DD)"
    n = (span[1] - span[0]).days
    weeks, rest = divmod(abs(n), 7)
    return f"{n} days from {span[0]} to {span[1]} ({weeks} weeks and {rest} days)"


def check_days(brief: str) -> str:
    """The line from ``Answer:`` on: its only day count becomes the difference of its first two dates; anything less certain stays."""
    at = brief.find("Answer:")
    if at < 0:
        return brief
    line, rest = (brief[at:].split("\n", 1) + [None])[:2]
    counts, named = list(DAYS.finditer(line)), dates(line)
    span = _span(named[0], named[1], True) if len(counts) == 1 and len(named) >= 2 else None
    if not span:
        return brief
    n = abs((span[1] - span[0]).days)
    if n != int(counts[0][1]):
        line = f"{line[: counts[0].start()]}{n} {'day' if n == 1 else 'days'}{line[counts[0].end() :]}"
    return brief[:at] + line + ("" if rest is None else "\n" + rest)


CALL = re.compile(r"\W*lookup\s+([a-z_]+)\s*:?\s*(.*)", re.I)
SPAN = re.compile(r"#?(\d+)\s*(?:-|–|to)\s*#?(\d+)")
CALLS, ROUNDS, RESULT, WHOLE, WHOLE_CHARS, RELEVANT, RANGE, MESSAGE = 4, 4, 12_000, 4, 4_000, 25, 60, 700


def calls(reply: str) -> list[tuple[str, str]]:
    """Lookups of a reply that starts with one, at most four: (kind, argument)."""
    lines = [x.strip() for x in reply.split("\n") if x.strip() and not x.strip().startswith("```")]
    found = [CALL.fullmatch(x) for x in lines]
    return [(m[1].lower(), m[2].strip().strip('"`').strip()) for m in found if m][:CALLS] if found and found[0] else []


def _short(text: str, most: int) -> str:
    return text if len(text) <= most else text[:most] + "…"


def run(call: tuple[str, str], turns, search, ranked=None, timeline=None) -> str:
    """One lookup over a turns DataFrame (number, observed_at, text, reply) of one project.

    ``search`` answers a text query; ``ranked`` gives the turn numbers of a query, best first; ``timeline`` a text.
    """
    from pyspark.sql import functions as F

    kind, arg = call
    said = lambda r: r["observed_at"] or "date unknown"
    if kind == "days_between":
        a, b = (re.split(r"\s*\|\s*| to | and ", arg, maxsplit=1) + [""])[:2]
        return days_between(a, b)
    if kind == "search":
        return (search(arg) or "Nothing found.")[:RESULT]
    if kind == "timeline":
        return ((timeline() if timeline else None) or "No timeline.")[:RESULT]
    if kind == "read_turns":
        wanted = [int(x) for x in re.findall(r"\d+", arg)][:WHOLE]
        rows = turns.where(F.col("number").isin(wanted)).orderBy("number").select("number", "observed_at", "text", "reply").limit(WHOLE).collect()
        whole = [_short(f"### Turn #{r['number']} [{said(r)}]\nUser: {r['text']}\nAssistant: {r['reply'] or ''}", WHOLE_CHARS) for r in rows]
        return "\n\n".join(whole)[:RESULT] or "No such turns."
    if kind != "user_messages":
        return f"error: unknown lookup {kind}"
    if m := SPAN.fullmatch(arg):
        rows = turns.where(F.col("number").between(int(m[1]), int(m[2])) & (F.col("text") != "")).orderBy("number").limit(RANGE)
    else:
        best = [int(n) for n in (ranked(arg) if ranked else [])][:RELEVANT]
        rows = turns.where(F.col("number").isin(best)).orderBy("number").limit(RELEVANT)
    lines = [f"- #{r['number']} [{said(r)}] {_short(r['text'], MESSAGE)}".replace("\n", " ") for r in rows.select("number", "observed_at", "text").collect()]
    return "\n".join(lines)[:RESULT] or "No messages."
