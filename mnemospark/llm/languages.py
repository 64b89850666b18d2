"""Problem 1: the language of records and of each stretch of mixed records, by hyperdimensional profiles.

Each letter has a random vector of ``D`` signs drawn from a hash of the letter (Han
and Cyrillic letters share part of theirs). The n-gram abc is bound as
``rot(rot(a)) * rot(b) * c``; a word is the bundle (sum) of its n-grams with its edges,
a sentence the bundle of its words, a language the bundle of its training
sentences, corrected by a few passes that move misread sentences from the wrong
prototype to the right one. A sentence gets the language of greatest cosine, and
the confidence is the share of that language under a softmax of the cosines.

Bundling is linear, so a word's dot products with all prototypes are computed once and
a sentence's are their sums. Its norm is taken as that of quasi-orthogonal words,
which scales all languages alike.

Training: at most ``SAMPLE`` labelled rows of each table in hash order; labels may be
wrong, so rows that the first prototypes contradict are dropped before the second fit.

Identifiers, paths, code, numbers and addresses are no words: a run without white
space that holds digits or signs inside (other than an apostrophe) has no vote.
Sentences end at . ! ? or their full-width forms. A sentence of any length is whole if it has such
an end, a cosine ``MARGIN`` above that of the record's greatest language (``CLEAR`` with fewer than ``LEAST`` words; Han
characters count one) and the shape of prose: at least half of its words without a
capital, no more silent runs than words, no small start after a capitalised word with a full stop
(an abbreviation, as in Avda. de las Salinas). Neighbouring sentences of one
language form a segment; shorter ones than ``SHORT`` words that are not whole join their
neighbour. A language is present in a record if it is the record's greatest, if a sentence of it is whole, or if a
segment has ``WHOLE`` words (Han characters count half) at confidence ``SURE``, or ``LONG`` words at
``FAIR``: short lists of foreign names and places do not make a record mixed.

Defined results: null key: left out; null, blank or wordless text: no language, no
segment; repeated rows of a key: latest; null, blank or unlisted label: missing; no
usable training labels: no result; empty table: empty result; extra columns are
ignored.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.sources.tables import table

D = 2048
SAMPLE = 4000
SHORT = 4
LEAST = 3
MARGIN = 0.16
CLEAR = 0.3
WHOLE = 6
SURE = 0.995
LONG = 11
FAIR = 0.95
TEMPERATURE = 0.02
PASSES = 5
LABELS = 10_000
CACHE = 200_000
LANGUAGES = ("de", "en", "es", "fr", "nl", "pt", "ru", "zh")
TABLES = (("queries", "query_id", "query", "added_at"), ("memories", "mem_id", "content", "ingested_at"), ("turns", "turn_id", "text", "ingested_at"))

HAN = re.compile(r"[一-鿿]")
PART = re.compile(r"`[^`]*`|[一-鿿]|[A-Za-z0-9_./:@#$%&*+=<>{}\[\]()|\\~^\"'’\-À-ɏЀ-ӿ!?;,“”„«»¿¡…]+|[。！？]")
WORD = re.compile(r"^[\W_]*([^\W\d_]+(?:['’][^\W\d_]+)*)[\W_]*$")
END = re.compile(r"[.!?…]+[\"'’”»)\]]*$")


def _composed(chunk: str) -> tuple[str, list[int]]:
    """NFKC form of a run, and for each of its characters the place in the run it comes from (the start, if letters joined)."""
    parts = [unicodedata.normalize("NFKC", c) for c in chunk]
    plain = unicodedata.normalize("NFKC", chunk)
    if "".join(parts) != plain:
        return plain, [0] * len(plain)
    return plain, [i for i, x in enumerate(parts) for _ in x]


def _signs(name: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(name)
    return np.random.default_rng(seed).integers(0, 2, D, dtype=np.int8) * 2 - 1


class Space:
    """Vectors of letters, n-grams and words, made when first asked for."""

    def __init__(self) -> None:
        self.letters: dict[str, np.ndarray] = {}
        self.grams: dict[str, np.ndarray] = {}

    def letter(self, c: str) -> np.ndarray:
        v = self.letters.get(c)
        if v is None:
            v = _signs("letter " + c)
            script = "han" if "一" <= c <= "鿿" else "cyrillic" if "Ѐ" <= c <= "ӿ" else None
            if script:
                own = _signs("mask " + c) > 0
                v = np.where(own, v, _signs("script " + script)).astype(np.int8)
            self.letters[c] = v
        return v

    def gram(self, g: str) -> np.ndarray:
        v = self.grams.get(g)
        if v is None:
            v = np.ones(D, np.int8)
            for i, c in enumerate(g):
                v = v * np.roll(self.letter(c), len(g) - 1 - i)
            if len(self.grams) > CACHE:
                self.grams.clear()
            self.grams[g] = v
        return v

    def word(self, w: str) -> np.ndarray:
        """Bundle of the word's trigrams with its edges; a Han character is its own unigram."""
        if len(w) == 1 and HAN.match(w):
            return self.gram(w).astype(np.float32)
        w = f" {w} "
        return np.sum([self.gram(w[i : i + 3]) for i in range(len(w) - 2)], axis=0, dtype=np.float32)


class Reader:
    """Texts to flat word numbers with sentence ends (-1) and silent runs (-2)."""

    def __init__(self, space: Space, prototypes: np.ndarray | None = None) -> None:
        self.space, self.prototypes = space, prototypes
        self.reset()

    def reset(self) -> None:
        self.words: dict[str, int] = {}
        self.vectors: list[np.ndarray] = []
        self.dots: list[np.ndarray] = []
        self.norm2: list[float] = []
        self.size: list[float] = []
        self.codes: dict[str, int] = {}
        self.flat: list[int] = []
        self.capital: list[bool] = []
        self.inside: list[int] = []
        self.start: list[int] = []
        self.length: list[int] = []

    def word(self, w: str) -> int:
        k = self.words.get(w)
        if k is None:
            k = self.words[w] = len(self.norm2)
            v = self.space.word(w)
            self.norm2.append(float(v @ v))
            self.size.append(0.5 if HAN.match(w) else 1.0)
            if self.prototypes is None:
                self.vectors.append(v)
            else:
                self.dots.append(self.prototypes @ v)
        return k

    def code(self, chunk: str) -> int:
        code = self.codes[chunk] = len(self.start)
        ids: list[int] = []
        capital: list[bool] = []
        inside: list[int] = []
        plain, back = chunk, None
        if not plain.isascii() and not unicodedata.is_normalized("NFKC", plain):
            plain, back = _composed(chunk)
        for at, p in [(0, plain)] if plain.isascii() and "`" not in plain else [(m.start(), m.group()) for m in PART.finditer(plain)]:
            if HAN.match(p):
                ids.append(self.word(p))
            elif p in ("。", "！", "？"):
                ids.append(-1)
            else:
                m = WORD.match(p) if p[0] != "`" and "@" not in p and "/" not in p and "::" not in p else None
                ids.append(self.word(m.group(1).lower().replace("’", "'")) if m and (len(m.group(1)) == 1 or not m.group(1).isupper() or len(m.group(1)) > 1) else -2)
                capital += [False] * (len(ids) - 1 - len(capital)) + [bool(m) and m.group(1)[0].isupper() and not m.group(1).isupper()]
                if END.search(p):
                    ids.append(-1)
            inside += [back[at] if back else at] * (len(ids) - len(inside))
        self.inside += inside
        self.start.append(len(self.flat))
        self.length.append(len(ids))
        self.flat += ids
        self.capital += capital + [False] * (len(ids) - len(capital))
        return code

    def batch(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, text of each id, white-space run of each id within its text); a sentence end after each text.

        ``capitals`` holds, for each id, whether the word has a capital first letter, ``places`` where it starts in its run."""
        if len(self.codes) > CACHE or len(self.norm2) > CACHE:
            self.reset()
        codes, code = self.codes, self.code
        if "。" not in codes:
            code("。")
        stop = codes["。"]
        joined: list[int] = []
        n = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            e = [codes[c] if c in codes else code(c) for c in t.split()] if t else []
            e.append(stop)
            joined += e
            n[i] = len(e)
        c = np.array(joined, np.int64)
        length = np.array(self.length, np.int64)[c]
        first = np.concatenate([[0], np.cumsum(length)[:-1]])
        at = np.repeat(np.array(self.start, np.int64)[c] - first, length) + np.arange(length.sum())
        run = np.arange(len(c)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        self.capitals = np.array(self.capital, bool)[at]
        self.places = np.array(self.inside, np.int64)[at]
        return np.array(self.flat, np.int32)[at], np.repeat(np.repeat(np.arange(len(texts)), n), length), np.repeat(run, length)


def sentences(ids: np.ndarray, owner: np.ndarray, run: np.ndarray):
    """Per sentence with words: number of each word's sentence, owners, first and last run."""
    sent = np.cumsum(ids == -1) - (ids == -1)
    word = ids >= 0
    return sent[word], ids[word], owner[word], run[word]


def _prose(ids: np.ndarray, owner: np.ndarray, capitals: np.ndarray) -> np.ndarray:
    """Per sentence number: whether it is ended by a sign of its own and has the shape of prose."""
    sent = np.cumsum(ids == -1) - (ids == -1)
    n = int(sent[-1]) + 1 if len(sent) else 0
    own_end = (ids == -1) & np.append(owner[1:] == owner[:-1], False)[: len(ids)]
    ended = np.bincount(sent[own_end], minlength=n) > 0
    words = np.bincount(sent[ids >= 0], minlength=n)
    return ended & (np.bincount(sent[ids == -2], minlength=n) <= words) & (2 * np.bincount(sent[capitals], minlength=n) <= words)


def softmax(cos: np.ndarray) -> np.ndarray:
    z = (cos - cos.max(1, keepdims=True)) / TEMPERATURE
    e = np.exp(z)
    return e / e.sum(1, keepdims=True)


def segments(reader: Reader, texts) -> pd.DataFrame:
    """Segments of texts: text, first, last (runs), inside (where in the first run it starts), lang, confidence, words, whole (holds a whole sentence).

    Neighbours of one language are merged."""
    ids, owner, run = reader.batch(texts)
    prose = _prose(ids, owner, reader.capitals)
    shown = reader.capitals[ids >= 0]
    places = reader.places[ids >= 0]
    sent, w, own, run = sentences(ids, owner, run)
    columns = ["text", "first", "last", "inside", "lang", "confidence", "words", "whole"]
    if not len(w):
        return pd.DataFrame({c: [] for c in columns})
    dots, norm2, size = np.array(reader.dots), np.array(reader.norm2), np.array(reader.size)

    def summed(key):
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return start, np.add.reduceat(dots[w], start, axis=0), np.add.reduceat(norm2[w], start), np.add.reduceat(size[w], start)

    start, dot, n2, words = summed(sent)
    lang = np.argmax(dot, 1)
    text = own[start]
    total = np.zeros((len(texts), len(LANGUAGES)))
    np.add.at(total, (text, lang), words)
    cos = dot / np.sqrt(n2)[:, None]
    each = np.arange(len(start))
    han = np.array(reader.size)[w[start]] < 1
    goes_on = ~shown[start] & ~han & np.append(False, shown[start[1:] - 1] & (text[1:] == text[:-1]))
    lead = np.where(np.diff(np.append(start, len(w))) >= LEAST, MARGIN, CLEAR)
    whole = prose[sent[start]] & ~goes_on & (cos[each, lang] - cos[each, total.argmax(1)[text]] >= lead)
    # short sentences take the language of the longer one before them in the text, else of the next
    firm = (words >= SHORT) | whole
    index = np.arange(len(start))
    before = np.maximum.accumulate(np.where(firm, index, -1))
    after = np.minimum.accumulate(np.where(firm, index, len(start))[::-1])[::-1]
    ok_before = (before >= 0) & (text[np.maximum(before, 0)] == text)
    ok_after = (after < len(start)) & (text[np.minimum(after, len(start) - 1)] == text)
    lang = np.where(firm, lang, np.where(ok_before, lang[np.maximum(before, 0)], np.where(ok_after, lang[np.minimum(after, len(start) - 1)], lang)))
    change = np.concatenate([[True], (lang[1:] != lang[:-1]) | (text[1:] != text[:-1])])
    key = np.repeat(np.cumsum(change), np.diff(np.append(start, len(w))))
    start, dot, n2, words = summed(key)
    share = softmax(dot / np.sqrt(n2)[:, None])
    best = lang[change]
    end = np.append(start[1:], len(w)) - 1
    out = pd.DataFrame(
        {"text": own[start], "first": run[start], "last": run[end], "inside": places[start], "lang": best, "confidence": np.round(share[np.arange(len(best)), best], 6), "words": words,
         "whole": np.logical_or.reduceat(whole, np.flatnonzero(change))}
    )
    return out


def prototypes(space: Space, texts: list[str], labels: list[str]) -> np.ndarray | None:
    """(languages, D) unit prototypes from labelled texts, or None without labels."""
    reader = Reader(space)
    ids, owner, run = reader.batch(texts)
    sent, w, own, _ = sentences(ids, owner, run)
    if not len(w):
        return None
    vectors = np.array(reader.vectors)
    start = np.flatnonzero(np.concatenate([[True], sent[1:] != sent[:-1]]))
    ends = np.append(start[1:], len(w))
    size = np.array(reader.size)
    words = np.add.reduceat(size[w], start)
    y = np.array([LANGUAGES.index(x) if x in LANGUAGES else -1 for x in labels])[own[start]]
    use = np.flatnonzero((words >= SHORT) & (y >= 0))
    if not len(use):
        return None
    x = np.empty((len(use), D), np.float32)
    for i, k in enumerate(use):
        v = vectors[w[start[k] : ends[k]]].sum(0)
        x[i] = v / max(float(np.linalg.norm(v)), 1e-9)
    y = y[use]

    def unit(p):
        return p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)

    p = np.stack([x[y == k].sum(0) for k in range(len(LANGUAGES))])
    good = (x @ unit(p).T).argmax(1) == y
    x, y = x[good], y[good]
    p = np.stack([x[y == k].sum(0) for k in range(len(LANGUAGES))])
    seen = np.array([(y == k).any() for k in range(len(LANGUAGES))])
    for _ in range(PASSES):
        cos = x @ unit(p).T
        cos[:, ~seen] = -2
        rival = cos.copy()
        rival[np.arange(len(y)), y] = -2
        near = rival.argmax(1)
        weak = cos[np.arange(len(y)), y] - rival[np.arange(len(y)), near] < 0.1
        if not weak.any():
            break
        rate = 0.2
        for k in range(len(LANGUAGES)):
            p[k] += rate * (x[weak & (y == k)].sum(0) - x[weak & (near == k)].sum(0))
    p = unit(p)
    p[~seen] = 0
    return p.astype(np.float32)


def codes(lang_codes: DataFrame) -> dict[str, str]:
    rows = lang_codes.where("spelling is not null and code is not null").select("spelling", "code").limit(LABELS + 1).collect()
    if len(rows) > LABELS:
        raise ValueError(f"more than {LABELS} spellings of labels")
    return {r[0]: r[1] for r in rows}


def fitted(frames: list[tuple[DataFrame, str, str]], spelling: dict[str, str]) -> np.ndarray | None:
    """Prototypes from a bounded sample of the labelled rows of (table, key, text)."""
    texts, labels = [], []
    for df, key, text in frames:
        n = df.count()
        h = F.pmod(F.xxhash64(key), F.lit(1 << 40))
        few = df.where((h < int((1 << 40) * min(1.0, 2 * SAMPLE / max(n, 1)))) & F.col("lang").isin(*spelling) & F.col(text).isNotNull())
        for r in few.orderBy(h, key).limit(SAMPLE).select("lang", text).collect():
            labels.append(spelling[r[0]])
            texts.append(r[1])
    return prototypes(Space(), texts, labels)


RUN = re.compile(r"\S+")
SEGMENT = "struct<first_char: int, end_char: int, lang: string, confidence: double, words: double>"


def _placed(texts, s: pd.DataFrame) -> list[list[dict]]:
    """Segments of each text with their characters: the first one starts at 0, each ends where the next starts, the last with the text."""
    out: list[list[dict]] = [[] for _ in texts]
    for i, g in s.groupby("text") if len(s) else ():
        t = texts[int(i)]
        runs = [m.start() for m in RUN.finditer(t)]
        begin = [runs[r] + o for r, o in zip(g["first"].astype(int), g["inside"].astype(int))]
        begin[0] = 0
        for a, b, lang, sure, words in zip(begin, [*begin[1:], len(t)], g["lang"], g["confidence"], g["words"]):
            out[int(i)].append({"first_char": a, "end_char": b, "lang": lang, "confidence": float(sure), "words": float(words)})
    return out


def reliability(protos, texts: list[str], labels: list[str], bins=(0.0, 0.5, 0.8, 0.95, 0.99, 1.0)) -> list[tuple[float, float, int]]:
    """(mean confidence, share of right ones, number) of the segments of texts of one known language, by confidence."""
    s = segments(Reader(Space(), protos), texts)
    right = np.array([LANGUAGES[int(k)] == labels[int(t)] for k, t in zip(s["lang"], s["text"])], bool)
    sure = s["confidence"].to_numpy(float)
    at = np.clip(np.digitize(sure, bins) - 1, 0, len(bins) - 2)
    return [(float(sure[at == b].mean()), float(right[at == b].mean()), int((at == b).sum())) for b in range(len(bins) - 1) if (at == b).any()]


def _read(protos, spelling, detail: bool):
    def run(frames):
        reader = Reader(Space(), protos)
        for f in frames:
            s = segments(reader, f["text"].tolist())
            s["lang"] = np.array(LANGUAGES, object)[s["lang"].astype(int)] if len(s) else s["lang"]
            if detail:
                yield pd.DataFrame({"key": f["key"], "version": f["version"], "segments": _placed(f["text"].tolist(), s)})
                continue
            found: list[list[str]] = [[] for _ in range(len(f))]
            if len(s):
                total = s.groupby(["text", "lang"], sort=False)["words"].sum().reset_index().sort_values(["text", "words", "lang"], ascending=[True, False, True])
                main = total.drop_duplicates("text")
                for i, g in zip(main["text"].astype(int), main["lang"]):
                    found[i].append(g)
                whole = s[s["whole"] | (s["words"] >= WHOLE) & (s["confidence"] >= SURE) | (s["words"] >= LONG) & (s["confidence"] >= FAIR)]
                for i, g in zip(whole["text"].astype(int), whole["lang"]):
                    if g not in found[i]:
                        found[i].append(g)
            yield pd.DataFrame({"key": f["key"], "version": f["version"], "label": [spelling.get(x) for x in f["lang"]], "langs": found})

    return run


def rows(df: DataFrame, key: str, text: str, version: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(version).alias("version"), F.col("lang"), F.col(text).alias("text"))


def languages(df: DataFrame, key: str, text: str, version: str, protos, spelling) -> DataFrame:
    """(key, label, langs): languages present, greatest first, one row per record."""
    r = rows(df, key, text, version)
    kind = dict(r.dtypes)["version"]
    out = r.mapInPandas(_read(protos, spelling, False), f"key string, version {kind}, label string, langs array<string>")
    return out.groupBy("key").agg(F.max(F.struct("version", "label", "langs")).alias("x")).select("key", "x.label", "x.langs")


def record_segments(df: DataFrame, key: str, text: str, version: str, protos, spelling) -> DataFrame:
    """(record_id, segment, first_char, end_char, lang, confidence, words) of each record's latest row; texts don't move."""
    r = rows(df, key, text, version)
    kind = dict(r.dtypes)["version"]
    out = r.mapInPandas(_read(protos, spelling, True), f"key string, version {kind}, segments array<{SEGMENT}>")
    out = out.groupBy("key").agg(F.max(F.struct("version", "segments")).alias("x"))
    out = out.select(F.col("key").alias("record_id"), F.posexplode("x.segments").alias("segment", "s"))
    return out.select("record_id", (F.col("segment") + 1).alias("segment"), "s.*")


def _over(spark, sf_dir, each):
    frames = [(table(spark, sf_dir, name), key, text) for name, key, text, _ in TABLES]
    spelling = codes(table(spark, sf_dir, "lang_codes"))
    protos = fitted(frames, spelling) if spelling else None
    out = None
    for (name, key, text, version), (df, _, _) in zip(TABLES, frames):
        part = (each(df, key, text, version, protos, spelling) if protos is not None else None)
        if part is not None:
            part = part.withColumn("table_name", F.lit(name))
            out = part if out is None else out.unionByName(part)
    return out


def found(spark, sf_dir) -> DataFrame:
    """Records whose label is missing, wrong or too simple: one row per language present."""
    all_ = _over(spark, sf_dir, languages)
    if all_ is None:
        return spark.createDataFrame([], "table_name string, record_id string, lang string")
    right = (F.size("langs") == 1) & (F.coalesce(F.col("label"), F.lit("")) == F.col("langs")[0])
    return all_.where((F.size("langs") > 0) & ~right).select("table_name", F.col("key").alias("record_id"), F.explode("langs").alias("lang"))


def segment_languages(spark, sf_dir) -> DataFrame:
    out = _over(spark, sf_dir, record_segments)
    if out is None:
        return spark.createDataFrame([], "table_name string, record_id string, segment int, first_char int, end_char int, lang string, confidence double, words double")
    return out.select("table_name", "record_id", "segment", "first_char", "end_char", "lang", "confidence", "words")
