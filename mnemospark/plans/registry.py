"""Registration of queries with their SQL, and SQL fragments shared by them."""

from __future__ import annotations

from mnemospark.functions.lists import CJK_STOP, EN_STOP
from mnemospark.functions.text import CJK

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def quoted(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


MEM = "mem AS (SELECT * FROM memories WHERE mem_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mem_id ORDER BY ingested_at DESC) = 1)"
QRY = "qry AS (SELECT * FROM queries WHERE query_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY added_at DESC) = 1)"
TRN = "trn AS (SELECT * FROM turns WHERE turn_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY ingested_at DESC) = 1)"
EVL = "evl AS (SELECT * FROM eval_rows WHERE row_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY arrived_at DESC) = 1)"
VEC = (
    "vec AS (SELECT vec_id, owner_id, owner_kind, vector::DOUBLE[] AS v FROM (SELECT * FROM index_vectors WHERE vec_id IS NOT NULL "
    "QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY embedded_at DESC) = 1) WHERE vector IS NOT NULL AND len(vector) = 64 "
    "AND len([x for x in vector if x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x for x in vector if x <> 0]) > 0)"
)


def stem_sql(w: str) -> str:
    return (
        f"CASE WHEN NOT regexp_full_match({w}, '[\\x00-\\x7F]*') THEN {w} WHEN length({w}) > 4 AND {w} LIKE '%ies' THEN substr({w}, 1, length({w}) - 3) || 'y' "
        f"WHEN length({w}) > 5 AND {w} LIKE '%ing' THEN substr({w}, 1, length({w}) - 3) WHEN length({w}) > 4 AND {w} LIKE '%ed' THEN substr({w}, 1, length({w}) - 2) "
        f"WHEN length({w}) > 3 AND {w} LIKE '%s' AND {w} NOT LIKE '%ss' AND {w} NOT LIKE '%us' THEN substr({w}, 1, length({w}) - 1) ELSE {w} END"
    )


def terms_sql(source: str, key: str, text: str, also: str = "") -> str:
    """A SELECT of (key, also, w): one row per index term of each text."""
    low = f"lower({text})"
    plain = rf"regexp_extract_all(regexp_replace({low}, '[{CJK}]', ' ', 'g'), '[\p{{L}}\p{{N}}_]+')"
    parts = f"flatten([[p for p in string_split(w, '_') if length(p) >= 2] for w in {plain} if contains(w, '_')])"
    pairs = f"flatten([CASE WHEN length(r) = 1 THEN [r] ELSE [substr(r, i::INT, 2) for i in range(1, length(r))] END for r in regexp_extract_all({low}, '[{CJK}]+')])"
    raw = f"SELECT {key}{also}, unnest(list_concat(list_concat({plain}, {parts}), {pairs})) AS r FROM {source}"
    cjk = f"regexp_matches(r, '^[{CJK}]')"
    term = f"CASE WHEN {cjk} THEN CASE WHEN r NOT IN ({quoted(CJK_STOP)}) THEN r END WHEN length(r) >= 2 AND r NOT IN ({quoted(EN_STOP)}) THEN {stem_sql('r')} END"
    bare = also.replace(" AS ", " ").split(",")[1:]
    names = "".join(", " + b.strip().split(" ")[-1].split(".")[-1] for b in bare)
    return f"SELECT * FROM (SELECT {key.split('.')[-1]}{names}, {term} AS w FROM ({raw})) WHERE w IS NOT NULL"
