"""Problem 9: abusive, hateful or sexual content by the nearest labelled examples.

A text is cut into segments (sentences, list items, quotations); a segment and a
labelled example are vectors of TF-IDF weighted words. The score of a segment is
the vote of its ``K`` nearest examples by exact cosine, weighted by squared
similarity and shrunk towards 0 by ``PRIOR``; the score of a document is that of its
highest segment, and that segment with its nearest example is the evidence.

Search is exact over a block-max inverted index: each word has a posting list of
(example, weight), cut into blocks of examples of like label, with the greatest weight of each
block, so memory is in proportion to the words of the examples. A segment whose bound
over all unwanted examples is below ``LEAST`` has no unwanted neighbour and scores
0. For the others, blocks are visited in the order of their bounds until no
bound reaches the k-th best similarity. Segments of fewer than ``WORDS`` words
of two letters or more need neighbours of ``NEAR`` or more, as one common word makes them alike.

Document frequencies are counted over the segments of all documents, for the words
of the examples; the examples are few (at most ``EXAMPLES``, checked) and go to every
task. Disguised spelling is undone word by word: broken lines, digits and signs
for letters, stretched or spaced letters, and words masked with asterisks, which
are matched with the examples' words by first letter, length and last letter.

Defined results: null or blank text: score 0, no evidence; null key: left out;
repeated rows of a key: latest; null label or snippet: not an example; no
examples of either kind: score 0; empty table: empty result.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.sources.tables import table

K = 5
LEAST = 0.14
PRIOR = 0.02
WORDS = 3
NEAR = 0.9
CHUNK = 20_000
THRESHOLD = 0.5
EXAMPLES = 20_000
BLOCK = 16
CACHE = 300_000

END = r"[.!?\n:;>\[\]()\"“”„«»]"
PIECE = re.compile(r"[^\W_][\w*@$'’]*|[*@$][\w*@$]+|" + END)
BROKEN = re.compile(r"-[ \t]*\n[ \t]*(?=\w|,)")
SPACED = re.compile(r"(?<!\w)\w(?: \w){2,}(?!\w)")
STRETCHED = re.compile(r"(\w)\1{2,}")
# fixed values: signs written for letters
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"})
SIGNS_L = str.maketrans({"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"})
SEPARATORS = frozenset('.!?\n:;>[]()"“”„«»')


def plain(text: str) -> str:
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    return BROKEN.sub("", text) if "-\n" in text or "- " in text else text


def respaced(text: str) -> str:
    """Runs of three or more single letters become words."""
    return SPACED.sub(lambda m: m.group().replace(" ", ""), text)


def variants(word: str):
    """Readings of a word, as written first."""
    yield word
    base = word.replace("’", "'")
    if "'" in base:
        yield base.split("'")[-1] or base
    if any(c in "0134578@$" for c in word) and not word.isdigit():
        for signs in (SIGNS, SIGNS_L):
            yield word.translate(signs)
            yield STRETCHED.sub(r"\1", word.translate(signs))
    if STRETCHED.search(word):
        yield STRETCHED.sub(r"\1", word)
        yield STRETCHED.sub(r"\1\1", word)


class Lexicon:
    """Words of the examples; reads disguised words as one of them. -1: unknown, -2: segment end, -3: single letter."""

    def __init__(self, words: list[str], weight: dict[str, float] | None = None) -> None:
        self.id = {w: i for i, w in enumerate(words)}
        self.masks: dict[tuple, list[str]] = {}
        for w in words:
            if len(w) > 2:
                self.masks.setdefault((w[0], len(w)), []).append(w)
        self.weight = weight or {}
        self.seen: dict[str, int] = {}
        self.letter = np.array([len(w) == 1 for w in words] or [False], bool)
        self._reset()

    def read(self, piece: str) -> int:
        known = self.seen.get(piece)
        if known is None:
            if len(self.seen) > CACHE:
                self.seen.clear()
            known = self.seen[piece] = self._read(piece)
        return known

    def _read(self, piece: str) -> int:
        if piece in SEPARATORS:
            return -2
        for v in variants(piece):
            if v in self.id:
                return self.id[v]
        if "*" in piece and len(piece) > 2 and piece[0].isalpha():
            fits = [w for w in self.masks.get((piece[0], len(piece)), []) if all(c == "*" or c == d for c, d in zip(piece, w))]
            if fits:
                return self.id[max(fits, key=lambda w: (self.weight.get(w, 0.0), w))]
        return -3 if len(piece) == 1 else -1

    def code(self, chunk: str) -> int:
        """Number of the id sequence of a run without white space."""
        code = self.codes[chunk] = len(self.start)
        ids = [self.read(p) for p in PIECE.findall(chunk)]
        self.start.append(len(self.flat))
        self.length.append(len(ids))
        self.flat += ids
        return code

    def batch(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts end to end, a segment end after each text, and the text each id is from."""
        if len(self.codes) > CACHE:
            self._reset()
        codes, code = self.codes, self.code
        each = [[codes[c] if c in codes else code(c) for c in plain(t).replace("\n", " \x02 ").split()] if t else [] for t in texts]
        ids, owner = self._expand(each)
        single = (ids == -3) | ((ids >= 0) & self.letter[np.maximum(ids, 0)])
        run = single[2:] & single[1:-1] & single[:-2]
        spaced = np.unique(owner[2:][run]).tolist()
        if spaced:  # letters written apart
            for i in spaced:
                each[i] = [codes[c] if c in codes else code(c) for c in respaced(plain(texts[i])).replace("\n", " \x02 ").split()]
            ids, owner = self._expand(each)
        return ids, owner

    def _reset(self) -> None:
        self.codes: dict[str, int] = {"\x02": 0}
        self.flat, self.start, self.length = [-2], [0], [1]

    def _expand(self, each) -> tuple[np.ndarray, np.ndarray]:
        n = np.fromiter((len(e) + 1 for e in each), np.int64, len(each))
        joined: list[int] = []
        for e in each:
            joined += e
            joined.append(0)
        codes = np.array(joined, np.int64)
        length = np.array(self.length)[codes]
        at = np.repeat(np.array(self.start)[codes] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        return np.array(self.flat, np.int32)[at], np.repeat(np.repeat(np.arange(len(each)), n), length)


def segments(text: str) -> list[list[str]]:
    """Segments as lists of words, disguise undone where no lexicon is needed."""
    out, now = [], []
    for p in PIECE.findall(respaced(plain(text))):
        if p in SEPARATORS:
            out.append(now)
            now = []
        else:
            now.append(p)
    out.append(now)
    return [s for s in out if s]


@dataclass
class Index:
    words: list[str]
    idf: np.ndarray
    unknown: float
    label: np.ndarray
    text: list[str]
    lists: np.ndarray  # words + 1: first block entry of each word
    block: np.ndarray  # block of each block entry
    block_max: np.ndarray  # its greatest weight
    postings: np.ndarray  # block entries + 1: first posting of each block entry
    example: np.ndarray  # example of each posting
    weight: np.ndarray  # its weight (examples are unit vectors)
    wanted_max: np.ndarray  # words: greatest weight in an unwanted example
    masks: dict[str, float]
    letter: np.ndarray  # words of a single letter


def examples(rows) -> tuple[list[list[str]], np.ndarray, list[str], list[str]]:
    """Segments of the labelled snippets: words, labels, texts, vocabulary."""
    seen: dict[tuple, int] = {}
    for snippet, label in rows:
        for s in segments(snippet):
            clean = []
            for w in s:
                if "*" in w:
                    continue
                best = w
                if any(c.isdigit() for c in w) and any(c.isalpha() for c in w):
                    best = w.translate(SIGNS)
                clean.append(STRETCHED.sub(r"\1", best.replace("’", "'").split("'")[-1] if "'" in best.replace("’", "'") else best) or best)
            clean = [w for w in clean if not w.isdigit()]
            if len(clean) >= 2 or (clean and len(s) == 1):
                key = tuple(clean)
                seen[key] = max(seen.get(key, 0), int(label))
    words = sorted({w for s in seen for w in s})
    return [list(s) for s in seen], np.array(list(seen.values()), np.int64), [" ".join(s) for s in seen], words


def build(segs, label, text, words, df: np.ndarray, total: int) -> Index:
    idf = np.log((1 + total) / (1 + df)) + 1.0
    at = {w: i for i, w in enumerate(words)}
    word, example, weight = [], [], []
    heaviest = np.zeros(len(segs), np.int64)
    for j, s in enumerate(segs):
        ids, count = np.unique([at[w] for w in s], return_counts=True)
        v = (1 + np.log(count)) * idf[ids]
        word.append(ids)
        example.append(np.full(len(ids), j))
        weight.append(v / np.linalg.norm(v))
        heaviest[j] = ids[v.argmax()]
    word, example, weight = (np.concatenate(x) if segs else np.zeros(0, np.int64) for x in (word, example, weight))
    # blocks: examples of one label, neighbours in the order of their heaviest word
    order = np.lexsort((heaviest, label)) if len(segs) else np.zeros(0, int)
    block = np.empty(len(segs), np.int64)
    number, size = -1, 0
    for k, j in enumerate(order):
        if number < 0 or label[j] != label[order[k - 1]] or size == BLOCK:
            number, size = number + 1, 0
        block[j] = number
        size += 1
    order = np.lexsort((example, block[example], word)) if len(word) else np.zeros(0, int)
    word, example, weight = word[order], example[order], weight[order]
    of = block[example]
    first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (of[1:] != of[:-1])]))[: len(word)]
    wanted = np.zeros(len(words))
    bad = label[example] == 1
    np.maximum.at(wanted, word[bad], weight[bad])
    ranks = {w: float(wanted[i]) for i, w in enumerate(words)}
    return Index(
        words, idf, float(np.log(1 + total)) + 1.0, label, text,
        np.searchsorted(word[first], np.arange(len(words) + 1)), of[first], np.maximum.reduceat(weight, first) if len(first) else weight,
        np.append(first, len(word)), example, weight, wanted, ranks, np.array([len(w) == 1 for w in words], bool),
    )


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] numbers), start[1], ..."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))


def _added(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, sums of their values, the order of the records by key and where each key's records start."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[: len(key)]
    return key[first], np.add.reduceat(value[order], first) if len(first) else value[:0], order, first


def searched(ix: Index, seg: np.ndarray, word: np.ndarray, weight: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segments, K) greatest similarities and their examples (-1: none at or above the floor).

    ``seg``: sorted segment numbers 0, 1, ... of the (word, weight) entries; weights are divided by the segment's norm.
    """
    n, blocks = len(floor), int(ix.block.max()) + 1 if len(ix.block) else 0
    sims, near = np.zeros((n, K)), np.full((n, K), -1, np.int64)
    count = ix.lists[word + 1] - ix.lists[word]
    entry, pair = np.repeat(np.arange(len(word)), count), _ranges(ix.lists[word], count)
    key, bound, order, first = _added(seg[entry] * blocks + ix.block[pair], weight[entry] * ix.block_max[pair])
    entry, pair = entry[order], pair[order]
    ends = np.append(first[1:], len(entry))
    owner = key // max(blocks, 1)
    best = np.lexsort((-bound, owner))
    head = np.flatnonzero(np.concatenate([[True], owner[best][1:] != owner[best][:-1]]))[: len(best)]
    rank = np.empty(len(best), np.int64)
    rank[best] = np.arange(len(best)) - np.repeat(head, np.diff(np.append(head, len(best))))
    lo, size = 0, 1
    while lo <= (rank.max() if len(rank) else -1):
        go = np.flatnonzero((rank >= lo) & (rank < lo + size) & (bound >= np.maximum(sims[owner, -1], floor[owner]) - 1e-12))
        lo, size = lo + size, size * 2
        if not len(go):
            if not ((rank >= lo) & (bound >= np.maximum(sims[owner, -1], floor[owner]) - 1e-12)).any():
                break
            continue
        r = _ranges(first[go], ends[go] - first[go])
        length = ix.postings[pair[r] + 1] - ix.postings[pair[r]]
        post = _ranges(ix.postings[pair[r]], length)
        e = np.repeat(entry[r], length)
        found, s, _, _ = _added(seg[e] * len(ix.label) + ix.example[post], weight[e] * ix.weight[post])
        who, what = found // len(ix.label), found % len(ix.label)
        keep = s >= floor[who]
        who, what, s = who[keep], what[keep], s[keep]
        rows = np.unique(who)
        if not len(rows):
            continue
        who = np.concatenate([who, np.repeat(rows, K)])
        what = np.concatenate([what, near[rows].ravel()])
        s = np.concatenate([s, sims[rows].ravel()])
        order2 = np.lexsort((what, -s, who))
        who, what, s = who[order2], what[order2], s[order2]
        start = np.searchsorted(who, rows)
        at = start[:, None] + np.arange(K)  # every row has K entries at least
        sims[rows], near[rows] = s[at], np.where(s[at] > 0, what[at], -1)
    return sims, near


def votes(ix: Index, sims: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Scores of rows of the greatest similarities and their examples (-1: none)."""
    w = np.where(near >= 0, sims, 0.0) ** 2
    return (w * (ix.label[near] == 1) * (near >= 0)).sum(1) / (w.sum(1) + PRIOR)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[: len(keys)]
    return keys[first], np.diff(np.append(first, len(keys)))


def scored(ix: Index, ids: np.ndarray):
    """(segment number, score, nearest example) of the segments that can have an unwanted neighbour."""
    seg = np.cumsum(ids == -2)
    word = ids >= 0
    n = int(seg[-1]) + 1 if len(seg) else 0
    if not word.any():
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    w_ids, w_seg = ids[word], seg[word]
    # term frequencies: equal words of one segment become one entry
    key, count = _distinct(w_seg.astype(np.int64) * len(ix.words) + w_ids)
    w_seg, w_ids = key // len(ix.words), key % len(ix.words)
    weight = (1 + np.log(count)) * ix.idf[w_ids]
    norm2 = np.bincount(w_seg, weights=weight**2, minlength=n) + np.bincount(seg[(ids == -1) | (ids == -3)], minlength=n) * ix.unknown**2
    norm = np.sqrt(np.maximum(norm2, 1e-12))
    bound = np.bincount(w_seg, weights=weight * ix.wanted_max[w_ids], minlength=n) / norm
    few = np.bincount(seg[(ids == -1) | (word & ~ix.letter[np.maximum(ids, 0)])], minlength=n) < WORDS
    floor = np.where(few, NEAR, LEAST)
    keep = (bound >= floor - 1e-12)[w_seg]
    w_seg, w_ids, weight = w_seg[keep], w_ids[keep], weight[keep]
    which, local = np.unique(w_seg, return_inverse=True)
    weight = weight / norm[w_seg]
    score, nearest = np.zeros(len(which)), np.zeros(len(which), np.int64)
    for a in range(0, len(which), CHUNK):
        i, j = np.searchsorted(local, (a, a + CHUNK))
        part = slice(a, min(a + CHUNK, len(which)))
        sims, near = searched(ix, local[i:j] - a, w_ids[i:j], weight[i:j], floor[which[part]])
        score[part], nearest[part] = votes(ix, sims, near), near[:, 0]
    return which, score, nearest


def calibration(rows, df=None, total: int = 0, bins: int = 5) -> list[tuple[float, float, int]]:
    """(mean score, share of unwanted, number) of labelled snippets by score, each scored without itself and its copies.

    ``df`` and ``total``: frequencies of words (a dict) and number of segments of a corpus; without them the snippets' own.
    """
    kept = sorted({(s, int(y)) for s, y in rows if s is not None and y is not None})
    key = [" ".join(" ".join(g) for g in segments(s)) for s, _ in kept]
    if df is None:
        df, total = {}, 0
        for s, _ in kept:
            for g in segments(s):
                total += 1
                for w in set(g):
                    df[w] = df.get(w, 0) + 1
    out = []
    for i, (snippet, y) in enumerate(kept):
        segs, label, text, words = examples([r for j, r in enumerate(kept) if key[j] != key[i]])
        if not segs:
            continue
        ix = build(segs, label, text, words, np.array([df.get(w, 0) for w in words], float), total)
        ids, _ = Lexicon(ix.words, ix.masks).batch([snippet])
        s = scored(ix, ids)[1]
        out.append((float(s.max()) if len(s) else 0.0, y))
    out = np.array(out).reshape(-1, 2)
    at = np.minimum((out[:, 0] * bins).astype(int), bins - 1)
    return [(float(out[at == b, 0].mean()), float(out[at == b, 1].mean()), int((at == b).sum())) for b in range(bins) if (at == b).any()]


def _counts(words: list[str], masks: dict[str, float]):
    def run(frames):
        lexicon = Lexicon(words, masks)
        df, total = np.zeros(len(words), np.int64), 0
        for f in frames:
            ids, _ = lexicon.batch(f["text"].tolist())
            seg = np.cumsum(ids == -2)
            word = ids >= 0
            key, _ = _distinct(seg[word].astype(np.int64) * len(words) + ids[word])
            df += np.bincount(key % len(words), minlength=len(words))
            total += int(np.count_nonzero(np.bincount(seg[ids != -2])))
        yield pd.DataFrame({"word": np.arange(-1, len(words)), "df": np.concatenate([[total], df])})

    return run


def fitted(documents: DataFrame, labels: DataFrame) -> Index | None:
    """The index of the labelled examples, with frequencies over all documents; None without examples."""
    rows = labels.where("snippet is not null and unwanted is not null").select("snippet", "unwanted").distinct().limit(EXAMPLES + 1).collect()
    if len(rows) > EXAMPLES:
        raise ValueError(f"more than {EXAMPLES} labelled examples; fit on a bounded sample")
    segs, label, text, words = examples([(r[0], r[1]) for r in rows])
    if not segs:
        return None
    masks = dict.fromkeys(words, 0.0)
    for s, y in zip(segs, label):
        for w in s:
            masks[w] = max(masks[w], float(y))
    counted = documents.select("text").mapInPandas(_counts(words, masks), "word int, df bigint").groupBy("word").agg(F.sum("df").alias("df"))
    df = np.zeros(len(words) + 1)
    for r in counted.collect():  # one row a word of the examples
        df[r["word"] + 1] = r["df"]
    return build(segs, label, text, words, df[1:], int(df[0]))


def _documents(ix: Index | None):
    def run(frames):
        lexicon = Lexicon(ix.words, ix.masks) if ix else None
        for f in frames:
            score = np.zeros(len(f))
            evidence: list[str | None] = [None] * len(f)
            if ix:
                ids, owner = lexicon.batch(f["text"].tolist())
                seg, s, near = scored(ix, ids)
                # the id that closes a segment tells its text
                doc = owner[ids == -2][seg] if len(seg) else seg
                for k in np.lexsort((near, s)):
                    score[doc[k]] = s[k]
                    evidence[doc[k]] = ix.text[near[k]] if s[k] > 0 and near[k] >= 0 else None
            out = f.drop(columns="text")
            out["score"], out["evidence"] = np.round(score, 6), evidence
            yield out

    return run


def scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score, evidence), one row per document."""
    kinds = dict(documents.dtypes)
    rows = documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.lower(F.trim("source")).alias("source"), "published_at", "text")
    schema = f"doc_id {kinds['doc_id']}, source string, published_at {kinds['published_at']}, score double, evidence string"
    out = rows.mapInPandas(_documents(fitted(documents, labels)), schema)
    return out.groupBy("doc_id").agg(F.max(F.struct("published_at", "score", "source", "evidence")).alias("x")).select("doc_id", "x.source", "x.score", "x.evidence")


def document_scores(spark, sf_dir) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"))


def found(scored_documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored_documents.where(F.col("score") >= threshold).select("doc_id")


def rates(scored_documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    hit = F.sum((F.col("score") >= threshold).cast("bigint"))
    return scored_documents.groupBy("source").agg(
        F.count("*").alias("documents"), hit.alias("unwanted"), F.round(hit / F.count("*"), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score")
    )
