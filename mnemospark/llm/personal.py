"""Problem 4: personal data in free text, by a skip-chain conditional random field.

A text is read in runs without white space. Stretches that can hold personal data
(addresses with @, numbers, neighbouring names, street words) become windows of
tokens; everything else is certainly outside. A window is a chain with labels
B/I for each kind and O; windows of more than ``MOST`` tokens are cut into chains that overlap by ``LAP`` on
either side. Tokens that recur in a record (the same name word, address, or number by its last digits) are joined by skip
edges, each occurrence with the next. A skip edge has a trained potential over the two
tokens' kinds, one table for numbers and addresses, one for words. Loopy message passing: chains are solved
exactly given the messages that arrive at their tokens, a token sends along an edge its belief divided by what
came through that edge, until messages are steady or ``ROUNDS`` times. The final labels are those of greatest score along
each chain given the messages.

Nothing is labelled by hand. A lexicon of given and family names (a name is a run of words that an
address beside it spells, or that fills a field of a card, header or list) is counted over
all rows in one pre-aggregated pass, with thresholds on common words as shares of the rows; every name so found is used.
A bounded sample (``SAMPLE`` rows of each table in hash order, of at most ``LONGEST`` characters) is labelled by
seeds, which also give a number's kind to its other occurrences in the record. The chain weights are fitted to these by maximum
likelihood; then the skip potentials, by the same likelihood under loopy beliefs, with the context of every
other linked token hidden, so that they learn how much one occurrence tells about another.
Han names of two to four characters are found by place too (after a contact cue, before a title
or a call number): the field also sees each such place without the lexicon.

Kinds: email, phone, id_number, street_address, person_name. ``occurrence`` numbers
the pieces of a kind in reading order. ``redacted`` puts ``[KIND]`` in their place and
leaves everything else as it is.

Defined results: null key: left out; null, empty or blank text: nothing found and
the text unchanged; repeated rows of a key: latest; empty table: empty result;
extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.sources.tables import table

SAMPLE = 12_000
LONGEST = 8_000
MOST = 192
LAP = 24
SLICE = 20_000
ROUNDS = 4
STEPS = 40
EPOCHS = 10
CACHE = 300_000
COMMON = 25
TALLY = 200_000
KINDS = ("email", "phone", "id_number", "street_address", "person_name")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
TAG = {t: i for i, t in enumerate(TAGS)}
TABLES = (("turns", "turn_id", "text", "ingested_at"), ("memories", "mem_id", "content", "ingested_at"))

EMAIL = r"[A-Za-z0-9][A-Za-z0-9_.+\-]*\s?(?:@|\(at\)|\[at\])\s?[A-Za-z0-9][A-Za-z0-9\-]*(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)[A-Za-z][A-Za-z0-9\-]*)+"
NUMBER = r"(?:\+|\(\+?)?(?:[A-Za-z]{0,3}\d[\dA-Za-z]*|[A-Z]-\d+)(?:\)?[ .\-/–]{0,2}\(?(?:\d[\dA-Z]*|[A-Z](?![A-Za-z]))\)?)*"
WORD = r"[^\W\d_]+(?:['’\-][^\W\d_]+)*\.?"
TOKEN = re.compile(f"(?P<email>{EMAIL})|(?P<number>(?-i:{NUMBER}))|(?P<han>[一-鿿])|(?P<word>{WORD})|(?P<sign>[^\\s])", re.I)
HAN = re.compile(r"[一-鿿]")
IGNORED = re.compile(
    r"[`=_\\]|::|^[\[(\"'>]*\d{4}-\d\d-\d\d\b|^\(?10(?:\.\d{1,3}){3}(?::\d+)?\)?[.,;]?$|^\(?\d{1,3}(?:\.\d{1,3}){3}:\d+|\d\d:\d\d:\d\d|^\d{1,2}\.\d{1,3}\.\d{1,2}[.,;)]?$|^\[?\d+\]|//|^[a-z]+/[a-z]"
)
# fixed values: street words of the languages, titles, particles of family names
STREET = frozenset(
    "lane road street avenue row blvd boulevard drive court square terrace flat apt rue allée avenue quai impasse chemin place calle avda plaza paseo camino rua travessa "
    "av largo praça estrada ул пер пр просп д кв г наб steeg speicher".split()
)
STREET_END = re.compile(r"(?:weg|gasse|straße|strasse|str|allee|platz|ufer|steig|turfweg|steeg|kade|gracht|laan|straat|plein|dijk|road|lane|street)\.?$", re.I)
LOWER_STREET = frozenset("rue allée avenue boulevard quai impasse chemin ул пер пр просп д кв г наб".split())  # also written small
PARTICLES = frozenset("de la las los del da do dos das di von van ter ten der den zu d le".split())
LINKS = PARTICLES | frozenset("des du bis rue boulevard allée n.º nº de dr prof mr mrs ms attn à".split())
HAN_PLACE = re.compile(r"[路街巷弄道]\d+号|\d{8,}|[一-鿿]{2}(?:先生|女士)")


def is_street(token: str, low: str) -> bool:
    """Whether a word names a kind of street; most kinds only with a capital."""
    return low in STREET and (token[0].isupper() or low in LOWER_STREET) or (token[0].isupper() and bool(STREET_END.search(low)))


def bare(word: str) -> str:
    """Lower case letters without accents: what an address makes of a name."""
    word = word.lower().replace("ß", "ss").replace("ö", "oe").replace("ü", "ue").replace("ä", "ae").replace("ø", "o")
    return re.sub(r"[^a-z]", "", unicodedata.normalize("NFD", word))


class Lexicon:
    """Given and family name words, and capitalised words too common to be names."""

    def __init__(self, given: set[str], family: set[str], common: set[str], han: set[str]) -> None:
        self.given, self.family, self.common, self.han = given, family, common, han
        self.names = given | family
        self.han_first = {h[:2] for h in han if len(h) == 4}
        self.han_last = {h[2:] for h in han if len(h) == 4}
        self.han_three = {h for h in han if len(h) == 3}
        parts = self.han_first | self.han_three
        self.han_re = re.compile("|".join(sorted(map(re.escape, parts)))) if parts else None

    def han_name(self, four: str) -> int:
        """Length of the known name that these characters begin with, or 0."""
        return 4 if four[:2] in self.han_first and four[2:] in self.han_last else 3 if four[:3] in self.han_three else 0


FIELD = (
    re.compile(r"From: ([^<>\n]{4,40}) <"),
    re.compile(r"\"contact\":\"([^\"]{3,40})\""),
    re.compile(r"(?:^|[\s;])([^\W\d_][^;<>\n\d@]{3,38});[^;\s]+(?:@|\s?[\[(]at)"),
    re.compile(r"FN:([^\n]{3,40})"),
    re.compile(r"owner: ([^#\n]{3,40}) #"),
    re.compile(r"(?:^|[;:] )([^\W\d_][^;:<>\n\d@]{3,38}) <[^>\s]+(?:@|\s?[\[(]at)"),
)
MARKS = ("From: ", '"contact":"', "", "FN:", "owner: ", "")  # what a text with such a field holds; "": an address
# fixed values: contact cues, the most frequent family names of one character and those of two
HAN_CUE = "(?:联系人|联络人|姓名|收件人|寄件人|经办人)(?:是|为)?[：:]?"
HAN_FAMILY = "(?:[王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文]|欧阳|司马|上官|诸葛|东方|皇甫|尉迟|公孙|慕容|令狐|夏侯|宇文|司徒|长孙)"
HAN_SLOT = re.compile(
    f"{HAN_CUE}\\s?(?P<a>[一-鿿]{{2,4}}?)(?=[，,。；;、（(<\\s\\d+]|电话|手机|邮箱|先生|女士|$)|(?P<b>{HAN_FAMILY}[一-鿿]{{1,2}})(?=先生|女士)|"
    f"(?:(?<![一-鿿])|(?<=联系)|(?<=找))(?P<c>{HAN_FAMILY}[一-鿿]{{1,2}})(?=[，,：:]?\\s?(?:(?:的)?(?:电话|手机|邮箱)|\\+?\\d{{3}}[\\d -]{{4,}}|[A-Za-z0-9_.+\\-]+@))"
)
HAN_OPEN = re.compile(f"{HAN_SLOT.pattern}|{HAN_CUE}$")


def slots(text: str) -> dict[int, int]:
    """Start and length of the places of Han names in a text."""
    return {m.start(m.lastgroup): len(m.group(m.lastgroup)) for m in HAN_SLOT.finditer(text)} if HAN.search(text) else {}


ADDRESS = re.compile(EMAIL, re.I)
WORDS = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")


TALLIES = ("given", "family", "first", "last", "caps", "lower", "han")


def tally(texts, into: dict[str, Counter] | None = None) -> dict[str, Counter]:
    """Counts of names by kind and of words with and without a capital; sums of tallies are tallies."""
    into = into or {k: Counter() for k in TALLIES}
    given, family, first, last, caps, lower, han = (into[k] for k in TALLIES)
    runs: Counter = Counter()
    for t in texts:
        if not t:
            continue
        runs.update(t.split())
        for a, n in slots(t).items():
            han[t[a : a + n]] += 1
        names: list[str] = []
        low = t.lower()
        mail = "@" in t or "(at" in low or "[at" in low
        for mark, p in zip(MARKS, FIELD):
            for m in p.finditer(t) if (mark in t if mark else mail) else ():
                name = m.group(1).strip(" ,")
                if HAN.search(name):
                    if re.fullmatch(r"[一-鿿]{2,4}", name):
                        han[name] += 1
                    continue
                names.append(name)
        # fields: "Given Family" or "Family, Given"
        for name in names:
            parts = [p for p in re.split(r"\s+", name.replace(",", " , ")) if p]
            ws = [p for p in parts if p != "," and p.lower() not in PARTICLES and len(p) > 2 and p.rstrip(".").lower() not in ("dr", "prof")]
            if len(ws) == 2 and all(WORDS.fullmatch(w) for w in ws):
                a, b = (ws[1], ws[0]) if "," in parts else (ws[0], ws[1])
                first[a.lower()] += 1
                last[b.lower()] += 1
        for m in ADDRESS.finditer(t) if mail else ():
            local = bare(re.split(r"@|\(|\[", m.group().split("+")[0])[0])
            ws = WORDS.findall(t[max(0, m.start() - 60) : m.start()])
            for i in range(len(ws)):
                for n in (2, 3, 4):
                    g = ws[i : i + n]
                    if len(g) == n and len(local) > 6:
                        if local == bare("".join(g)):
                            given[g[0].lower()] += 1
                            family.update(x.lower() for x in g[1:] if x.lower() not in PARTICLES)
                        elif local == bare(g[-1] + "".join(g[:-1])):
                            given[g[-1].lower()] += 1
                            family.update(x.lower() for x in g[:-1] if x.lower() not in PARTICLES)
    for c, n in runs.items():
        w = c.strip(".,;:!?()[]\"'“”„«»<>")
        if w.isalpha():
            (caps if w[0].isupper() else lower)[w.lower()] += n
    return into


def lexicon(counts: dict[str, Counter], scale: float = 1.0) -> Lexicon:
    """The lexicon of a tally; ``scale``: how many times as many rows as two samples were counted."""
    given, family, first, last, caps, lower, han = (counts[k] for k in TALLIES)
    given, family = given.copy(), family.copy()
    # a field's name twice at least, so that no stray field makes a name
    for c, into in ((first, given), (last, family)):
        for w, n in c.items():
            if n >= 2:
                into[w] += n
    both = {w for w in given if w in family}
    for w in both:
        (family if given[w] >= family[w] else given).pop(w)
    names = set(given) | set(family)
    common = {w for w, n in caps.items() if w not in names and n + lower[w] >= COMMON * scale} | {w for w, n in lower.items() if n >= 3 * scale and w not in names}
    names_ok = lambda c: {w for w in c if len(w) > 2 and lower[w] <= 3 * c[w] + 20 * scale}
    return Lexicon(names_ok(given), names_ok(family), common, {h for h, n in han.items() if n >= 2 and len(h) > 2})


def learned(texts: list[str]) -> Lexicon:
    """The lexicon of some texts."""
    return lexicon(tally(texts))


def _tallied(frames):
    """(kind, word, n) of a partition, added up before it is sent."""
    def flat(counts):
        rows = [(k, w, n) for k, c in counts.items() for w, n in c.items()]
        return pd.DataFrame(rows, columns=["kind", "word", "n"])

    counts = None
    for f in frames:
        counts = tally(f["text"], counts)
        if sum(map(len, counts.values())) > TALLY:
            yield flat(counts)
            counts = None
    if counts:
        yield flat(counts)


def counted(frames: list[tuple[DataFrame, str, str]], rows: int) -> Lexicon:
    """The lexicon of all rows, as ``lexicon`` makes it of their tally; only its words are collected: all names, and the common words, which are bounded by their share of the rows."""
    scale = max(1.0, rows / (2 * SAMPLE))
    all_ = None
    for df, key, text in frames:
        one = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInPandas(_tallied, "kind string, word string, n bigint")
        all_ = one if all_ is None else all_.unionByName(one)
    of = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), F.col("n")).otherwise(0))
    per = all_.groupBy("word").agg(*[of(k).alias(k) for k in TALLIES])
    twice = lambda c: F.when(F.col(c) >= 2, F.col(c)).otherwise(0)
    c = per.select("word", "caps", "lower", "han", (F.col("given") + twice("first")).alias("g"), (F.col("family") + twice("last")).alias("f"))
    given, family = (F.col("g") > 0) & (F.col("g") >= F.col("f")), F.col("f") > F.col("g")
    common = ~given & ~family & (((F.col("caps") > 0) & (F.col("caps") + F.col("lower") >= COMMON * scale)) | (F.col("lower") >= 3 * scale))
    name = (F.length("word") > 2) & (F.col("lower") <= 3 * F.greatest("g", "f") + 20 * scale)
    kinds = {"given": given & name, "family": family & name, "common": common, "han": (F.col("han") >= 2) & (F.length("word") > 2)}
    got = c.select("word", *(x.alias(k) for k, x in kinds.items())).where("given or family or common or han").toArrow()
    return Lexicon(*(set(got.filter(got[k])["word"].to_pylist()) for k in kinds))


# classes of runs without white space
NONE, NAME, RARE, NUM, AT, PLACE, LINK, HANS, FEW = range(9)


class Reader:
    """Finds the windows of a text."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lex = lexicon
        self.kinds: dict[str, int] = {}

    def kind(self, run: str) -> int:
        lex = self.lex
        low = run.lower()
        if "@" in run or "[at]" in low or "(at)" in low:
            k = NONE if run[0] == "@" and len(run) > 1 or "`" in run else AT
        elif "[dot]" in low or "(dot)" in low:
            k = AT
        elif not run.isascii() and HAN.search(run):
            k = HANS if HAN_PLACE.search(run) or HAN_OPEN.search(run) or (lex.han_re and lex.han_re.search(run)) else NONE
        elif any(c.isdigit() for c in run):
            core = run.strip("()[]{}<>\"',;:.!?")
            tail = core.split(":")[-1] if ":" in core else core
            k = NONE if IGNORED.search(run) or not tail or sum(c.islower() for c in tail) > 2 or ("-" in tail and re.match(r"[A-Z]{5,}-\d+$|[a-z]+-", tail)) else NUM
            if k == NUM and len(tail) < 7 and ":" not in core:
                k = FEW  # a short number is no piece by itself
        else:
            core = run.strip("()[]{}<>\"',;:.!?“”„«»#*|")
            low = core.lower()
            if ":" in core:
                core = core.split(":")[-1]
                low = core.lower()
            if not core or not WORDS.fullmatch(core):
                k = PLACE if core and is_street(core, low.rstrip(".")) else NONE
            elif low in lex.names:
                k = NAME
            elif is_street(core, low):
                k = PLACE
            elif low in LINKS:
                k = LINK
            else:
                k = RARE if core[0].isupper() and len(core) > 2 and low not in lex.common else NONE
        if len(self.kinds) > CACHE:
            self.kinds.clear()
        self.kinds[run] = k
        return k

    def windows(self, runs: list[str]) -> list[tuple[int, int]]:
        """(first, end) of the stretches to tokenise, with context."""
        known, kind = self.kinds, self.kind
        ks = [known[r] if r in known else kind(r) for r in runs]
        if not any(ks):
            return []
        out: list[tuple[int, int]] = []
        i, n = 0, len(ks)
        while i < n:
            if not ks[i] or ks[i] == LINK:
                i += 1
                continue
            j, strong, names, few, places = i, False, 0, 0, 0
            gap = 0
            while j < n and (ks[j] or gap < 1):
                if ks[j]:
                    strong |= ks[j] in (NUM, AT, HANS)
                    names += ks[j] in (NAME, RARE)
                    few += ks[j] == FEW
                    places += ks[j] == PLACE
                    gap = 0
                else:
                    gap += 1
                j += 1
            if strong or names >= 2 or few >= 2 or few and (names or places):
                a, b = max(0, i - 4), min(n, j + 2)
                if out and a <= out[-1][1]:
                    out[-1] = (out[-1][0], b)
                else:
                    out.append((a, b))
            i = j
        return out


def tokens(text: str) -> list[tuple[str, int, int, str]]:
    """(token, start, end, type) of a window."""
    return [(m.group(), m.start(), m.end(), m.lastgroup) for m in TOKEN.finditer(text)]


def shape(number: str) -> str:
    s = re.sub(r"\d", "9", number)
    return re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", s))


# fixed values: cue words before identity numbers and calls, by language
ID_CUES = re.compile(
    r"(?:passport no\.?|passport|ssn|social security number|national insurance number|tax id|driving licence|reisepass-nr\.?|reisepass|steuer-id|sozialversicherungsnummer|"
    r"passeport n°|sécurité sociale|numéro de sécurité sociale|numéro fiscal|permis|pasaporte|dni|nie|nif|cpf|passaporte|bsn|paspoortnummer|rijbewijs|паспорт|снилс|инн|"
    r"护照号|身份证号|驾驶证号|社保号)\s*$",
    re.I,
)
NOISE_CUES = re.compile(r"(?:sku|order|build|commit|import|limit|trace=|epoch=|p95=|epoch)\s*$", re.I)
PHONE = re.compile(
    r"(?:\+|00)\d{1,3}[\s.\-/()]*\d[\d\s.\-/()]{5,15}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{4}|1[ \-]\d{3}[ \-]\d{3}[ \-]\d{4}|\d{3}\.\d{3}\.\d{4}|\(?0\d{2}\)?[ /]\d[\d \-]{5,10}|0\d{3} \d{6}|"
    r"0\d(?:[ .]\d\d){4}|900[ \-]?\d{3}[ \-]?\d{3}|1[0-9]{10}|1\d\d-\d{4}-\d{4}|8[ (]+\d{3}[) ]+\d{3}[ \-]\d\d[ \-]\d\d|8\d{10}|0\d{2,3} \d{4} \d{4}"
)


def seeds(text: str, toks, lex: Lexicon) -> list[int]:
    """Labels of a training window from patterns, cues and the lexicon."""
    y = [0] * len(toks)
    n = len(toks)

    def mark(i, j, kind):
        for k in range(i, j):
            y[k] = TAG[f"{'B' if k == i else 'I'}-{kind}"]

    lows = [t[0].lower().rstrip(".") for t in toks]
    places = slots(text)
    i = 0
    while i < n:
        tok, a, b, kind = toks[i]
        low = lows[i]
        before = text[max(0, a - 40) : a].rstrip(" :=\t")
        if kind == "email":
            mark(i, i + 1, "email")
        elif kind == "number":
            full = tok.strip(" .-/")
            if ID_CUES.search(before):
                mark(i, i + 1, "id_number")
            elif not NOISE_CUES.search(before) and not NOISE_CUES.search(before.rstrip("[(")) and PHONE.fullmatch(full):
                j = i + 1
                if j < n and lows[j] == "ext":
                    j = min(n, j + 2)
                mark(i, j, "phone")
                i = j
                continue
            elif HAN.search(text[b : b + 1]) and text[b] == "号":
                pass
        elif kind == "word" and (lows[i] in lex.names or low in PARTICLES):
            j, g, f, comma = i, 0, 0, 0
            while j < n and j - i < 7:
                w = lows[j]
                if w in lex.given and not g:
                    g = 1
                elif w in lex.family and f < 2 and not (f and g and toks[j - 1][0] == ","):
                    f += 1
                elif w in PARTICLES and not (g and f):
                    pass
                elif toks[j][3] == "word" and len(w) == 1 and g:
                    pass
                elif toks[j][0] == "," and f and not g and not comma and toks[j][1] == toks[j - 1][2]:
                    comma = 1
                else:
                    break
                j += 1
                if g and f and (j >= n or lows[j] not in lex.family):
                    break
            if g and f:
                while toks[j - 1][0] == ",":
                    j -= 1
                mark(i, j, "person_name")
                i = j
                continue
        elif kind == "han" and (known := lex.han_name(text[a : a + 4]) or places.get(a, 0)):
            j = i
            while j < n and toks[j][1] < a + known:
                j += 1
            mark(i, j, "person_name")
            i = j
            continue
        i += 1
    # street addresses: a street word and a house number within a few tokens
    i = 0
    while i < n:
        w, k = lows[i], toks[i][3]
        if y[i] == 0 and k == "word" and is_street(toks[i][0], w) and w not in ("d", "г", "кв", "flat", "apt"):
            lo, hi = i, i + 1
            number = False
            while lo > 0 and i - lo < 6 and y[lo - 1] == 0:
                p = toks[lo - 1]
                if p[3] == "number" and len(p[0]) <= 5:
                    lo, number = lo - 1, True
                    while lo > 1 and (lows[lo - 1] in ("flat", "apt", ",") or toks[lo - 1][3] == "number" and len(toks[lo - 1][0]) < 3) and y[lo - 1] == 0 and (
                        lows[lo - 1] != "," or lows[lo - 3 if lo > 2 else 0] in ("flat", "apt")
                    ):
                        lo -= 1
                    break
                if p[3] == "word" and (p[0][0].isupper() or lows[lo - 1] in PARTICLES | {"bis", "upper"}) and lows[lo - 1] not in ("ship-to", "adr"):
                    lo -= 1
                elif p[0] in ",'’" and lo > 1 and toks[lo - 2][3] in ("number", "word"):
                    lo -= 1
                elif lows[lo - 1] == "bis":
                    lo -= 1
                else:
                    break
            after = 0
            while hi < n and y[hi] == 0 and hi - i < 16:
                p, w2 = toks[hi], lows[hi]
                if p[3] == "number" and len(p[0]) <= 9:
                    number = True
                elif p[3] == "word" and (p[0][0].isupper() or w2 in PARTICLES | {"des", "n", "д", "кв", "г", "dto", "à", "de", "на", "bis", "du", "des"}) and w2 not in ("tel", "attn") and not (
                    w2 in lex.given
                ):
                    pass
                elif p[0] in ",.º-:'’" and hi + 1 < n and p[0] != ":":
                    nxt = toks[hi + 1]
                    if p[0] == "." and (nxt[3] not in ("number", "word") or nxt[1] > p[2] + 1 or number):
                        break
                    if p[0] == "," and not (nxt[3] == "number" and len(nxt[0]) <= 9 or nxt[3] == "word" and (nxt[0][0].isupper() or lows[hi + 1] in ("д", "кв", "г")) and lows[hi + 1] not in lex.names):
                        break
                    after += p[0] == ","
                    if after > 4:
                        break
                else:
                    break
                hi += 1
            while hi > i + 1 and toks[hi - 1][3] == "sign":
                hi -= 1
            if number:
                mark(lo, hi, "street_address")
                i = hi
                continue
        elif y[i] == 0 and k == "han" and toks[i][0] in "路街巷弄道" and re.match(r".\d+号", text[toks[i][1] : toks[i][1] + 8]):
            lo, hi = i, i + 1
            while lo > 0 and toks[lo - 1][3] == "han" and y[lo - 1] == 0 and i - lo < 10 and toks[lo - 1][0] not in "到是在寄址住":
                lo -= 1
            while hi < n and y[hi] == 0 and (toks[hi][3] == "number" or toks[hi][0] in "号单元室楼栋层弄"):
                hi += 1
            mark(lo, hi, "street_address")
            i = hi
            continue
        i += 1
    return y


def features(text: str, toks, lex: Lexicon, known: bool = True) -> list[list[str]]:
    """Feature names of each token of a window; without ``known``, as if no Han name and none of its characters had been seen."""
    lows = [t[0].lower().rstrip(".") for t in toks]
    kinds = []
    for t, low in zip(toks, lows):
        if t[3] == "word":
            k = "G" if low in lex.given else "F" if low in lex.family else "p" if low in PARTICLES else "S" if is_street(t[0], low) else (
                "C" if t[0][0].isupper() and low not in lex.common else "c" if t[0][0].isupper() else "w"
            )
            if len(low) == 1:
                k += "1"
        elif t[3] == "han":
            k = "h"
        elif t[3] == "sign":
            k = t[0]
        else:
            k = t[3]
        kinds.append(k)
    for i, t in enumerate(toks):
        if t[3] == "han":
            for j in range(lex.han_name(text[t[1] : t[1] + 4]) if known else 0):
                if i + j < len(toks):
                    kinds[i + j] = "H" + "1234"[j]
    slot = {a + j: j > 0 for a, m in slots(text).items() for j in range(m)}
    out = []
    n = len(toks)
    for i, t in enumerate(toks):
        low = lows[i]
        p1, p2 = (kinds[i - 1] if i else "<"), (kinds[i - 2] if i > 1 else "<")
        n1, n2 = (kinds[i + 1] if i + 1 < n else ">"), (kinds[i + 2] if i + 2 < n else ">")
        w1 = lows[i - 1] if i else "<"
        w2 = lows[i - 2] if i > 1 else "<"
        f = ["b", f"k={kinds[i]}", f"k-1={p1}|{kinds[i]}", f"k+1={kinds[i]}|{n1}", f"k-2={p2}|{p1}|{kinds[i]}", f"k+2={kinds[i]}|{n1}|{n2}", f"k3={p1}|{kinds[i]}|{n1}"]
        glued = i > 0 and toks[i - 1][2] == t[1]
        f.append(f"g={glued}|{kinds[i]}")
        if t[3] == "number":
            s = shape(t[0])
            f += [f"s={s}", f"s={s}|{w1}", f"w-1={w1}", f"w-2={w2}|{w1}", f"l={min(len(s), 20)}", f"l={min(len(s), 20)}|{w1}", f"sw2={s}|{w2}", f"s2={s[:2]}", f"d={sum(c == '9' for c in s)}|{s[:1]}"]
            if w1 in ("[", "(", "#", ":") or kinds[i - 1 if i else 0] == "h":
                f.append(f"w3={w2}|{lows[i - 3] if i > 2 else '<'}|{w1}")
            if not glued:
                f.append(f"head={t[0][:3]}")
        elif not known and t[1] in slot:
            pass  # the name's own characters tell nothing of another name
        elif t[3] in ("word", "han", "sign"):
            f += [f"w={low}", f"w-1={w1}|{kinds[i]}", f"w+1={lows[i + 1] if i + 1 < n else '>'}|{kinds[i]}", f"c={t[0][:1].isupper()}{t[0].isupper()}|{kinds[i]}"]
        if t[3] == "han":
            f += [f"slot={slot.get(t[1])}", f"after={t[1] - 1 in slot and t[1] not in slot}"]
        # a number near in the window: what makes a street word an address
        near = [d for d in range(-6, 7) if 0 <= i + d < n and toks[i + d][3] == "number" and len(toks[i + d][0]) <= 5]
        f.append(f"near={min((abs(d), d) for d in near)[1] if near else None}|{kinds[i]}")
        street = [d for d in range(-8, 9) if 0 <= i + d < n and kinds[i + d] == "S"]
        f.append(f"st={min((abs(d), d) for d in street)[1] if street else None}|{kinds[i]}")
        out.append(f)
    return out


class Field:
    """Chain weights (unknown features count nothing) and skip potentials: (2, kinds, kinds), for numbers and for words."""

    def __init__(self, ids: dict[str, int], w: np.ndarray, trans: np.ndarray, skip: np.ndarray | None = None) -> None:
        self.ids, self.w, self.trans = ids, w, trans
        self.skip = np.zeros((2, len(KINDS) + 1, len(KINDS) + 1)) if skip is None else skip

    def emissions(self, feats: list[list[str]]) -> np.ndarray:
        get = self.ids.get
        flat = [get(f, 0) for fs in feats for f in fs]
        n = np.fromiter((len(fs) for fs in feats), np.int64, len(feats))
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        return np.add.reduceat(self.w[np.array(flat, np.int64)], starts, axis=0)


def allowed() -> np.ndarray:
    """Transition mask: I only after B or I of its kind."""
    t = np.zeros((len(TAGS), len(TAGS)))
    for j, b in enumerate(TAGS):
        if b[0] == "I":
            for i, a in enumerate(TAGS):
                if a[2:] != b[2:] or a == "O":
                    t[i, j] = -1e4
    return t


def chains(em: np.ndarray, lengths: np.ndarray, trans: np.ndarray):
    """Exact forward-backward of many chains at once: (marginals, pairwise sums, log partition sums)."""
    n, T, L = len(lengths), int(lengths.max()), em.shape[1]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    pos = np.minimum(starts[:, None] + np.arange(T), len(em) - 1)
    E = em[pos]
    live = np.arange(T)[None, :] < lengths[:, None]
    first = np.array([-1e4 if t[0] == "I" else 0.0 for t in TAGS])
    X = np.exp(np.maximum(trans, -60))
    alpha = np.empty((n, T, L))
    scale = np.zeros((n, T))
    e = np.exp(E - E.max(2, keepdims=True))
    top = E.max(2)
    a = e[:, 0] * np.exp(first)
    s = a.sum(1)
    alpha[:, 0] = a / s[:, None]
    scale[:, 0] = np.log(s) + top[:, 0]
    for t in range(1, T):
        a = (alpha[:, t - 1] @ X) * e[:, t]
        s = np.maximum(a.sum(1), 1e-300)
        alpha[:, t] = np.where(live[:, t, None], a / s[:, None], alpha[:, t - 1])
        scale[:, t] = np.where(live[:, t], np.log(s) + top[:, t], 0)
    beta = np.ones((n, T, L))
    for t in range(T - 2, -1, -1):
        b = (beta[:, t + 1] * e[:, t + 1]) @ X.T
        b /= np.maximum(b.sum(1, keepdims=True), 1e-300)
        beta[:, t] = np.where(live[:, t + 1, None], b, 1.0)
    m = alpha * beta
    m /= np.maximum(m.sum(2, keepdims=True), 1e-300)
    return m[live], alpha, beta, e, X, live, scale


def viterbi(em: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    n, T, L = len(lengths), int(lengths.max()), em.shape[1]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    E = em[np.minimum(starts[:, None] + np.arange(T), len(em) - 1)]
    first = np.array([-1e4 if t[0] == "I" else 0.0 for t in TAGS])
    score = E[:, 0] + first
    back = np.zeros((n, T, L), np.int8)
    last = np.zeros((n, L))
    last[lengths == 1] = score[lengths == 1]
    for t in range(1, T):
        step = score[:, :, None] + trans[None]
        back[:, t] = step.argmax(1)
        score = step.max(1) + E[:, t]
        last[lengths == t + 1] = score[lengths == t + 1]
    y = np.zeros((n, T), np.int64)
    y[np.arange(n), lengths - 1] = last.argmax(1)
    for t in range(T - 1, 0, -1):
        inside = t < lengths
        y[inside, t - 1] = back[inside, t, y[inside, t]]
    return y[np.arange(T)[None, :] < lengths[:, None]]


def trained(windows: list[tuple[list[list[str]], list[int]]], seed: int = 5) -> Field:
    """Maximum likelihood by mini-batches with per-weight step sizes."""
    count = Counter(f for feats, _ in windows for fs in feats for f in fs)
    ids = {f: i + 1 for i, f in enumerate(sorted(f for f, c in count.items() if c >= 2))}
    L = len(TAGS)
    w, gw = np.zeros((len(ids) + 1, L)), np.full((len(ids) + 1, L), 1e-8)
    mask = allowed()
    tr, gt = np.zeros((L, L)), np.full((L, L), 1e-8)
    rng = np.random.default_rng(seed)
    data = [([np.array([ids[f] for f in fs if f in ids], np.int64) for fs in feats], np.array(y)) for feats, y in windows if feats]
    for _ in range(EPOCHS):
        order = sorted(rng.permutation(len(data)), key=lambda i: (len(data[i][1]) // 8, i))
        batches = [order[k : k + 128] for k in range(0, len(order), 128)]
        for k in rng.permutation(len(batches)):
            b = [data[i] for i in batches[k]]
            flat = [f for feats, _ in b for f in feats]
            n = np.array([len(f) for f in flat])
            col = np.concatenate(flat)
            row = np.repeat(np.arange(len(flat)), n)
            em = np.add.reduceat(w[col], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0)
            lengths = np.array([len(y) for _, y in b])
            y = np.concatenate([y for _, y in b])
            m, alpha, beta, e, X, live, _ = chains(em, lengths, tr + mask)
            d = m.copy()
            d[np.arange(len(y)), y] -= 1
            grad = np.zeros_like(w)
            np.add.at(grad, col, d[row])
            touched = np.unique(col)
            g = grad[touched] + 1e-4 * w[touched]
            gw[touched] += g * g
            w[touched] -= 0.2 * g / np.sqrt(gw[touched])
            right = beta[:, 1:] * e[:, 1:]
            z = np.einsum("nti,ij,ntj->nt", alpha[:, :-1], X, right)
            inner = live[:, 1:]
            pair = np.einsum("nti,ntj->ij", (alpha[:, :-1] / np.maximum(z, 1e-300)[:, :, None]) * inner[:, :, None], right) * X
            pair /= max(pair.sum(), 1e-12) / max(inner.sum(), 1)
            ends = np.cumsum(lengths)
            both = np.ones(len(y) - 1, bool)
            both[ends[:-1] - 1] = False
            np.add.at(pair, (y[:-1][both], y[1:][both]), -1)
            g = pair + 1e-4 * tr
            gt += g * g
            tr -= 0.2 * g / np.sqrt(gt)
    return Field(ids, w, tr + mask)


def marginals(field: Field, em: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    m = np.empty_like(em)
    start = np.concatenate([[0], np.cumsum(lengths)])
    for rows in _by_length(lengths):
        at = np.concatenate([np.arange(start[r], start[r + 1]) for r in rows])
        m[at] = chains(em[at], lengths[rows], field.trans)[0]
    return m


def links(owner, names: list[str]) -> np.ndarray:
    """(edges, 3): each occurrence with the next of the same record and name, and 1 for words, 0 for numbers and addresses."""
    last: dict[tuple, int] = {}
    out = []
    for i, (o, k) in enumerate(zip(owner, names)):
        if k:
            j = last.get((o, k))
            if j is not None:
                out.append((j, i, int(k[0] == "w")))
            last[(o, k)] = i
    return np.array(out, np.int64).reshape(-1, 3)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def messages(field: Field, em: np.ndarray, lengths: np.ndarray, edges: np.ndarray):
    """Loopy message passing: (what arrives at each token, as scores of its tags; log beliefs of both ends without each other's message)."""
    i, j, psi = edges[:, 0], edges[:, 1], field.skip[edges[:, 2]]
    to_i, to_j = (np.zeros((len(edges), len(KINDS) + 1)) for _ in range(2))
    touched = np.unique(np.repeat(np.arange(len(lengths)), lengths)[np.concatenate([i, j])])  # only chains with edges are solved again
    start = np.concatenate([[0], np.cumsum(lengths)])
    at = np.concatenate([np.arange(start[r], start[r + 1]) for r in touched])
    place = np.zeros(len(em), np.int64)
    place[at] = np.arange(len(at))

    def arriving():
        add = np.zeros((len(em), len(KINDS) + 1))
        np.add.at(add, i, to_i)
        np.add.at(add, j, to_j)
        return add

    for _ in range(ROUNDS):
        belief = np.log(np.maximum(_kinds(marginals(field, (em + _tags(arriving()))[at], lengths[touched])), 1e-12))
        ci, cj = belief[place[i]] - to_i, belief[place[j]] - to_j
        new_j, new_i = _log_sum(ci[:, :, None] + psi, 1), _log_sum(cj[:, None, :] + psi, 2)
        new_j -= _log_sum(new_j, 1)[:, None]
        new_i -= _log_sum(new_i, 1)[:, None]
        moved = max(np.abs(np.exp(new_i) - np.exp(to_i)).max(), np.abs(np.exp(new_j) - np.exp(to_j)).max())
        to_i, to_j = new_i, new_j
        if moved < 1e-3:
            break
    return _tags(arriving()), ci, cj


def decoded(field: Field, em: np.ndarray, lengths: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Labels of all chains' tokens."""
    if not len(em):
        return np.zeros(0, np.int64)
    if len(edges):
        em = em + messages(field, em, lengths, edges)[0]
    y = np.empty(len(em), np.int64)
    start = np.concatenate([[0], np.cumsum(lengths)])
    for rows in _by_length(lengths):
        at = np.concatenate([np.arange(start[r], start[r + 1]) for r in rows])
        y[at] = viterbi(em[at], lengths[rows], field.trans)
    return y


def skips(field: Field, em: np.ndarray, bare: np.ndarray, lengths: np.ndarray, edges: np.ndarray, y: np.ndarray, seed: int = 9) -> np.ndarray:
    """Skip potentials of greatest likelihood under loopy beliefs, the chain weights being fixed.

    ``bare``: scores of tokens without their context, which every other linked token has here.
    """
    if not len(edges):
        return field.skip
    rng = np.random.default_rng(seed)
    kind = np.where(y == 0, 0, (y + 1) // 2)
    em = em.copy()
    hidden = np.unique(edges[:, :2])
    hidden = hidden[rng.random(len(hidden)) < 0.5]
    em[hidden] = bare[hidden]
    size = len(KINDS) + 1
    seen = np.zeros((2, size, size))
    np.add.at(seen, (edges[:, 2], kind[edges[:, 0]], kind[edges[:, 1]]), 1)
    psi, step = np.zeros((2, size, size)), np.full((2, size, size), 1e-8)
    n = np.maximum(np.bincount(edges[:, 2], minlength=2), 1)[:, None, None]
    for _ in range(STEPS):
        _, ci, cj = messages(Field(field.ids, field.w, field.trans, psi), em, lengths, edges)
        pair = ci[:, :, None] + cj[:, None, :] + psi[edges[:, 2]]
        pair = np.exp(pair - pair.max((1, 2), keepdims=True))
        pair /= pair.sum((1, 2), keepdims=True)
        expected = np.zeros((2, size, size))
        np.add.at(expected, edges[:, 2], pair)
        g = (seen - expected) / n - 1e-3 * psi
        g = (g + g.transpose(0, 2, 1)) / 2  # an edge has no direction
        step += g * g
        psi += 0.3 * g / np.sqrt(step)
    return psi


def _by_length(lengths: np.ndarray):
    order = np.argsort(lengths, kind="stable")
    for k in range(0, len(order), 512):
        yield order[k : k + 512]


def _kinds(m: np.ndarray) -> np.ndarray:
    return np.concatenate([m[:, :1], m[:, 1::2] + m[:, 2::2]], 1)


def _tags(kind: np.ndarray) -> np.ndarray:
    out = np.empty((len(kind), len(TAGS)))
    out[:, 0] = kind[:, 0]
    out[:, 1::2] = kind[:, 1:]
    out[:, 2::2] = kind[:, 1:]
    return out


def fitted(frames: list[tuple[DataFrame, str, str]]) -> tuple[Lexicon, Field] | None:
    """Lexicon of all rows and field of bounded samples of (table, key, text)."""
    texts: list[list[str]] = []
    rows = 0
    for df, key, text in frames:
        n = df.count()
        rows += n
        h = F.pmod(F.xxhash64(key), F.lit(1 << 40))
        few = df.where((h < int((1 << 40) * min(1.0, 1.5 * SAMPLE / max(n, 1)))) & (F.length(text) <= LONGEST))
        texts.append([r[0] for r in few.orderBy(h, key).limit(SAMPLE).select(text).collect()])
    return from_texts([t for part in texts for t in part], counted(frames, rows))


def cut(n: int) -> list[tuple[int, int, int, int]]:
    """(first, end, kept from, kept to) of the chains of a window of n tokens; the kept parts cover it once."""
    if n <= MOST:
        return [(0, n, 0, n)]
    step = MOST - 2 * LAP
    return [(max(0, k - LAP), min(n, k + step + LAP), k, min(n, k + step)) for k in range(0, n, step)]


def skip_name(tok: str, kind: str, lex: Lexicon) -> str:
    """What joins a token with its other occurrences ('': nothing): a number's last digits, an address, a name word."""
    low = tok.lower()
    if kind == "number" and len(tok) > 6:
        digits = re.sub(r"\D", "", tok)
        return "n" + (digits[-9:] if len(digits) > 6 else low)
    return "e" + low if kind == "email" else "w" + low.rstrip(".") if kind == "word" and low.rstrip(".") in lex.names else ""


class Chains:
    """The chains of many texts: scores, owners, skip names; features live only for ``SLICE`` tokens at a time."""

    def __init__(self, lex: Lexicon, field: Field) -> None:
        self.lex, self.field = lex, field
        self.em: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.owner: list[int] = []
        self.names: list[str] = []
        self.waiting: list[list[str]] = []

    def add(self, owner: int, w: str, toks) -> None:
        for a, b, _, _ in cut(len(toks)):
            part = toks[a:b]
            self.waiting += features(w, part, self.lex)
            self.lengths.append(b - a)
            self.owner += [owner] * (b - a)
            self.names += [skip_name(t[0], t[3], self.lex) for t in part]
            if len(self.waiting) >= SLICE:
                self.flush()

    def flush(self) -> None:
        if self.waiting:
            self.em.append(self.field.emissions(self.waiting))
            self.waiting = []

    def scores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.flush()
        em = np.concatenate(self.em) if self.em else np.zeros((0, len(TAGS)))
        return em, np.array(self.lengths, np.int64), links(self.owner, self.names)


def spread(toks, y: list[int], names: list[str], kinds: dict[str, int]) -> list[int]:
    """Seed labels with the kind of a number or address given to its other occurrences in the record."""
    return [TAG["B-" + KINDS[kinds[k]]] if t == 0 and k and k[0] != "w" and k in kinds else t for t, k in zip(y, names)]


def from_texts(texts: list[str], lex: Lexicon | None = None) -> tuple[Lexicon, Field] | None:
    lex = lex or learned(texts)
    reader = Reader(lex)
    windows, linked = [], []
    for t in texts:
        runs = t.split()
        found = [(w, toks) for w in (" ".join(runs[a:b]) for a, b in reader.windows(runs)) if (toks := tokens(w))]
        parts = [(w, toks[a:b]) for w, toks in found for a, b, _, _ in cut(len(toks))]
        labels = [seeds(w, toks, lex) for w, toks in parts]
        names = [[skip_name(k[0], k[3], lex) for k in toks] for _, toks in parts]
        kinds = {k: (v - 1) // 2 for y, ks in zip(labels, names) for v, k in zip(y, ks) if k and k[0] != "w" and v and TAGS[v][0] == "B"}
        for (w, toks), y, ks in zip(parts, labels, names):
            y[:] = spread(toks, y, ks, kinds)
            windows.append((features(w, toks, lex), y))
            if places := slots(w):
                windows.append((features(w, toks, lex, False), y))
                # the same with a name of two characters
                short = "".join(c for j, c in enumerate(w) if not any(k + 2 <= j < k + m for k, m in places.items()))
                shorter = tokens(short)[:MOST]
                windows.append((features(short, shorter, lex, False), seeds(short, shorter, lex)))
        if len(links([0] * sum(map(len, names)), [k for ks in names for k in ks])):
            linked.append((parts, labels))
    if not windows:
        return None
    field = trained(windows)
    if linked:
        c = Chains(lex, field)
        y: list[int] = []
        bare: list[np.ndarray] = []
        for i, (parts, labels) in enumerate(linked):
            for (w, toks), got in zip(parts, labels):
                c.add(i, w, toks)
                y += got
                bare.append(field.emissions([features(t[0], [(t[0], 0, len(t[0]), t[3])], lex)[0] for t in toks]))
        em, lengths, edges = c.scores()
        field.skip = skips(field, em, np.concatenate(bare), lengths, edges, np.array(y))
    return lex, field


def pieces(lex: Lexicon, field: Field, texts) -> list[tuple[int, str, int, int, int, int]]:
    """(text, kind, first run, offset in it, last run, end in it) of all pieces in reading order."""
    reader = Reader(lex)
    c = Chains(lex, field)
    where = []
    for i, t in enumerate(texts):
        runs = t.split() if t else []
        for a, b in reader.windows(runs) if runs else []:
            w = " ".join(runs[a:b])
            toks = tokens(w)
            if toks:
                c.add(i, w, toks)
                where.append((i, a, w, toks))
    if not where:
        return []
    em, lengths, edges = c.scores()
    y = decoded(field, em, lengths, edges)
    out = []
    at = 0
    for i, a, w, toks in where:
        n = len(toks)
        tags = np.empty(n, np.int64)
        for lo, hi, k0, k1 in cut(n):
            tags[k0:k1] = y[at + k0 - lo : at + k1 - lo]
            at += hi - lo
        bounds = [0]
        for run in w.split(" "):
            bounds.append(bounds[-1] + len(run) + 1)
        j = 0
        while j < n:
            t = TAGS[tags[j]]
            if t == "O":
                j += 1
                continue
            e = j + 1
            while e < n and TAGS[tags[e]] == "I-" + t[2:]:
                e += 1
            s0, e0 = toks[j][1], toks[e - 1][2]
            if toks[e - 1][3] == "word" and w[e0 - 1] == "." and e0 - toks[e - 1][1] > 3:
                e0 -= 1  # the full stop of the sentence stays
            r0 = int(np.searchsorted(bounds, s0, side="right")) - 1
            r1 = int(np.searchsorted(bounds, e0 - 1, side="right")) - 1
            out.append((i, t[2:], a + r0, s0 - bounds[r0], a + r1, e0 - bounds[r1]))
            j = e
    return out


RUN = re.compile(r"\S+")


def replaced(text: str | None, found: list[tuple]) -> str | None:
    """The text with each piece replaced by its placeholder."""
    if not found:
        return text
    spans = [m.span() for m in RUN.finditer(text)]
    out, last = [], 0
    for _, kind, r0, o0, r1, o1 in found:
        a, b = spans[r0][0] + o0, spans[r1][0] + o1
        if a < last:
            continue
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join(out) + text[last:]


def _rows(df: DataFrame, key: str, text: str, version: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(version).alias("version"), F.col(text).alias("text"))


def _counted(model):
    def run(frames):
        for f in frames:
            n = np.zeros((len(f), len(KINDS)), np.int64)
            for p in pieces(*model, f["text"].tolist()) if model else []:
                n[p[0], KINDS.index(p[1])] += 1
            yield pd.DataFrame({"key": f["key"], "version": f["version"], "counts": list(n)})

    return run


def _redacted(model):
    def run(frames):
        for f in frames:
            texts = f["text"].tolist()
            by: dict[int, list] = {}
            for p in pieces(*model, texts) if model else []:
                by.setdefault(p[0], []).append(p)
            yield pd.DataFrame(
                {"key": f["key"], "version": f["version"], "redacted": [replaced(t, by.get(i, [])) for i, t in enumerate(texts)], "pieces": [len(by.get(i, [])) for i in range(len(f))]}
            )

    return run


def _each(spark, sf_dir, make, schema, columns):
    frames = [(table(spark, sf_dir, n), k, t) for n, k, t, _ in TABLES]
    model = fitted(frames)
    out = None
    for (name, key, text, version), (df, _, _) in zip(TABLES, frames):
        r = _rows(df, key, text, version)
        got = r.mapInPandas(make(model), schema.format(dict(r.dtypes)["version"]))
        one = got.groupBy("key").agg(F.max(F.struct("version", *columns)).alias("x")).select(F.lit(name).alias("table_name"), F.col("key").alias("record_id"), *[f"x.{c}" for c in columns])
        out = one if out is None else out.unionByName(one)
    return out


def found(spark, sf_dir) -> DataFrame:
    """(table_name, record_id, pii_kind, occurrence)."""
    rows = _each(spark, sf_dir, _counted, "key string, version {}, counts array<bigint>", ["counts"])
    kinds = F.explode(F.arrays_zip(F.array(*[F.lit(k) for k in KINDS]).alias("kind"), F.col("counts").alias("n")))
    rows = rows.select("table_name", "record_id", kinds.alias("x")).where("x.n > 0")
    return rows.select("table_name", "record_id", F.col("x.kind").alias("pii_kind"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("x.n"))).alias("occurrence"))


def redacted(spark, sf_dir) -> DataFrame:
    """(table_name, record_id, redacted, pieces): every record's text with placeholders."""
    return _each(spark, sf_dir, _redacted, "key string, version {}, redacted string, pieces bigint", ["redacted", "pieces"])
