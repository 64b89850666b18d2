"""Text functions as JVM-side Column expressions; none calls Python per row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark.functions.lists import CJK_STOP, EN_STOP, HIGH_ENTROPY, HIGH_ENTROPY_MARK, SECRET_PATTERNS, SIGNATURE_STEPS

CJK = r"぀-ヿ㐀-䶿一-鿿豈-﫿가-힯"


def stem(w: Column) -> Column:
    """One suffix rule, ASCII words only."""
    n = F.length(w)

    def cut(k: int) -> Column:
        return F.substring(w, F.lit(1), n - k)

    return (
        F.when(~w.rlike(r"^[\x00-\x7F]*$"), w)
        .when((n > 4) & w.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 5) & w.endswith("ing"), cut(3))
        .when((n > 4) & w.endswith("ed"), cut(2))
        .when((n > 3) & w.endswith("s") & ~w.endswith("ss") & ~w.endswith("us"), cut(1))
        .otherwise(w)
    )


def raw_words(text: Column) -> Column:
    """Words of a text before stop words and stemming: alphanumeric runs, compound parts after them, CJK runs as character pairs."""
    low = F.lower(text)
    plain = F.regexp_extract_all(F.regexp_replace(low, f"[{CJK}]", " "), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    parts = F.flatten(F.transform(F.filter(plain, lambda w: F.instr(w, "_") > 0), lambda w: F.filter(F.split(w, "_"), lambda p: F.length(p) >= 2)))
    runs = F.regexp_extract_all(low, F.lit(f"[{CJK}]+"), F.lit(0))
    pairs = F.flatten(
        F.transform(
            runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))
        )
    )
    return (
        F.when(low.rlike(f"[{CJK}]"), F.concat(plain, parts, pairs)).when(F.instr(low, "_") > 0, F.concat(plain, parts)).otherwise(plain)
    )


def term(word: Column) -> Column:
    """The index term of a word, or null for stop words and single letters."""
    cjk = word.rlike(f"^[{CJK}]")
    return F.when(cjk & ~word.isin(CJK_STOP), word).when(~cjk & (F.length(word) >= 2) & ~word.isin(EN_STOP), stem(word))


def normalize(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def strip_dates(text: Column) -> Column:
    return F.regexp_replace(text, r"[0-9]{4}[-/][0-9]{2}([-/][0-9]{2})?", "")


def numbers(text: Column) -> Column:
    """Digits and commas, commas removed."""
    found = F.regexp_extract_all(text, F.lit(r"[0-9][0-9,]*"), F.lit(0))
    return F.transform(found, lambda n: F.regexp_replace(n, ",", ""))


def number_key(text: Column) -> Column:
    """Sorted distinct numbers of a text without its dates."""
    return F.array_join(F.array_sort(F.array_distinct(numbers(strip_dates(text)))), " ")


def has_cue(text: Column, cues: list[str]) -> Column:
    """Whole-phrase match of Latin cues (no letter or digit beside), substring match of CJK cues."""
    latin = "|".join(re.escape(c).replace(r"\ ", " ") for c in cues if not re.search(f"[{CJK}]", c))
    cjk = "|".join(c for c in cues if re.search(f"[{CJK}]", c))
    hit = F.lower(text).rlike(rf"(^|[^\p{{L}}\p{{N}}])({latin})($|[^\p{{L}}\p{{N}}])")
    return hit | F.lower(text).rlike(cjk) if cjk else hit


def redact_patterns(text: Column) -> Column:
    """Secrets of known form become ``[REDACTED]``."""
    for p in SECRET_PATTERNS:
        text = F.regexp_replace(text, p, r"[REDACTED]")
    return text


def entropy(token: Column) -> Column:
    """Shannon entropy of a token's characters in bits."""
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    n = F.size(chars)

    def part(total, c):
        p = F.size(F.filter(chars, lambda x: x == c)) / n
        return total - p * F.log2(p)

    return F.aggregate(F.array_distinct(chars), F.lit(0.0), part)


def redact(text: Column) -> Column:
    """Secrets of known form, then tokens of 32 characters or more that look random, become marks."""
    run = r"[A-Za-z0-9_-]"
    pieces = F.split(redact_patterns(text), f"(?<!{run})(?={run}{{32}})|(?<={run}{{32}})(?!{run})")

    def hidden(p: Column) -> Column:
        core = F.regexp_replace(p, "^-+|-+$", "")
        random = p.rlike(f"^{run}+$") & (F.length(core) >= 32) & (entropy(core) >= HIGH_ENTROPY)
        return F.when(random, F.concat(F.regexp_extract(p, "^-*", 0), F.lit(HIGH_ENTROPY_MARK), F.regexp_extract(p, "-*$", 0))).otherwise(p)

    return F.when(text.rlike(f"{run}{{32}}"), F.array_join(F.transform(pieces, hidden), "")).otherwise(redact_patterns(text))


def redact_json(text: Column) -> Column:
    """Redaction of the string values of a JSON document: each value is redacted by itself, keys and structure stay.

    A text that is no JSON document is redacted as a whole. The document is cut at its string literals; a literal is a key if a colon follows it.
    """
    literal = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    pieces = F.regexp_extract_all(text, F.lit(f'{literal}|[^"]+'), F.lit(0))

    def value(x: Column, i: Column) -> Column:
        key = F.coalesce(F.get(pieces, i + 1), F.lit("")).rlike(r"^\s*:")
        inner = F.get(F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>"), F.lit(0))
        shown = F.to_json(F.array(redact(inner)))
        return F.when(x.rlike(f"^{literal}$") & ~key, F.substring(shown, F.lit(2), F.length(shown) - 2)).otherwise(x)

    return F.when(F.try_parse_json(text).isNotNull(), F.array_join(F.transform(pieces, value), "")).otherwise(redact(text))


def error_signature(text: Column) -> Column:
    """First line that tells of an error, with its variable parts replaced; null if there is none."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.lower(x).rlike("error|failed|exception|panic|traceback"))
    sig = F.get(lines, F.lit(0))
    for pattern, to in SIGNATURE_STEPS:
        sig = F.regexp_replace(sig, pattern, to)
    return F.substring(F.trim(F.regexp_replace(sig, r"\s+", " ")), 1, 200)


def clip(text: Column, most: int) -> Column:
    """Head of two thirds, a mark, tail of one third."""
    head, tail = most * 2 // 3, most // 3
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(" … "), F.right(text, F.lit(tail))))


def turn_key(text: Column) -> Column:
    return F.substring(F.substring_index(text, "\n", 1), 1, 307)


def default_title(text: Column) -> Column:
    """First line with content, at most 60 characters and an ellipsis."""
    line = F.trim(F.get(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.lit(0)))
    return F.when(F.length(line) > 60, F.concat(F.substring(line, 1, 60), F.lit("…"))).otherwise(line)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def date_key(*candidates: Column) -> Column:
    return F.substring(digits(F.coalesce(*candidates)), 1, 12)


def date_start(text: Column) -> Column:
    d = digits(text)
    n = F.length(d)
    return F.when(n == 4, F.concat(d, F.lit("0101"))).when(n == 6, F.concat(d, F.lit("01"))).when(n >= 8, F.substring(d, 1, 8)).cast("int")


def date_end(text: Column) -> Column:
    d = digits(text)
    n = F.length(d)
    return F.when(n == 4, F.concat(d, F.lit("1231"))).when(n == 6, F.concat(d, F.lit("31"))).when(n >= 8, F.substring(d, 1, 8)).cast("int")


def normalize_date(text: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD with dashes; anything else is null."""
    d = F.regexp_replace(F.trim(text), "/", "-")
    return F.when(d.rlike(r"^[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?$"), d)


def day_gap(a: Column, b: Column) -> Column:
    def day(x: Column) -> Column:
        return F.try_to_timestamp(date_start(x).cast("string"), F.lit("yyyyMMdd")).cast("date")

    return F.abs(F.datediff(day(a), day(b)))


def unfence(text: Column) -> Column:
    """The content of one Markdown fence around the whole text, else the text."""
    inner = F.regexp_extract(F.trim(text), r"(?s)^```[A-Za-z]*\n(.*?)\n?```$", 1)
    return F.when(inner != "", F.trim(inner)).otherwise(F.trim(text))


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)
