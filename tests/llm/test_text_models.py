import numpy as np
import pandas as pd
import pytest

from mnemospark.llm import languages as L
from mnemospark.llm import personal as P
from mnemospark.llm import unwanted as U

SENTENCES = {
    "en": ["The old client still writes to the shared queue before the weekly freeze.", "Nobody reads the old logs and the totals drift apart otherwise.", "Every release of this service expects a fresh copy of the settings."],
    "de": ["Der alte Rechner schreibt noch immer in die gemeinsame Warteschlange vor dem Stopp.", "Niemand liest die alten Protokolle und sonst laufen die Summen auseinander.", "Jede Version dieses Dienstes erwartet eine frische Kopie der Einstellungen."],
    "fr": ["L'ancien client écrit toujours dans la file partagée avant le gel hebdomadaire.", "Personne ne lit les vieux journaux et les totaux divergent sinon.", "Chaque version de ce service attend une copie neuve des réglages."],
    "zh": ["旧客户端仍在写入共享队列，要在封版之前完成。", "没有人会看旧日志，否则总数对不上。", "每次发布这个服务都需要新的配置副本。"],
    "ru": ["Старый клиент всё ещё пишет в общую очередь перед остановкой.", "Никто не читает старые журналы, иначе суммы разойдутся.", "Каждый выпуск этой службы ждёт свежую копию настроек."],
}


@pytest.fixture(scope="module")
def protos():
    texts, labels = [], []
    for lang, s in SENTENCES.items():
        for k in range(30):
            texts.append(" ".join(s[(k + j) % 3] for j in range(2)))
            labels.append(lang if k else "en")  # one wrong label each
    return L.prototypes(L.Space(), texts, labels)


def read(protos, texts):
    f = pd.DataFrame({"key": [str(i) for i in range(len(texts))], "version": 0, "lang": "x", "text": texts})
    return [list(x) for x in next(L._read(protos, {"x": "en"}, False)([f]))["langs"]]


def test_word_bundles_are_linear():
    s = L.Space()
    grams = [s.gram(g).astype(float) for g in (" ab", "abc", "bc ")]
    assert (s.word("abc") == sum(grams)).all()
    a, b = s.gram("abc").astype(int), s.gram("abd").astype(int)
    assert abs(a @ b) < 250 and a @ a == L.D


def test_languages_and_mixtures(protos):
    assert read(protos, [SENTENCES[x][1] for x in SENTENCES]) == [[x] for x in SENTENCES]
    mixed = SENTENCES["en"][0] + " " + SENTENCES["en"][1] + "\n> " + SENTENCES["de"][0] + " " + SENTENCES["zh"][0]
    assert set(read(protos, [mixed])[0]) == {"en", "de", "zh"}
    noise = SENTENCES["en"][0] + " ```kalir/melvor.py:12 select_x_99``` mail@host.example 2024-01-02 `der die das`"
    assert read(protos, [noise]) == [["en"]]
    assert read(protos, [None, "", "  ", "kal_12/x.py 99"]) == [[], [], [], []]
    assert read(protos, [(SENTENCES["fr"][0] + " ") * 3000]) == [["fr"]]


def test_short_whole_sentences_make_a_record_mixed(protos):
    long = " ".join(SENTENCES["en"])
    assert set(read(protos, [long + " 没有人会看旧日志。"])[0]) == {"en", "zh"}
    assert set(read(protos, [long + " Никто не читает журналы."])[0]) == {"en", "ru"}
    assert set(read(protos, [" ".join(SENTENCES["zh"]) + " Niemand liest die Protokolle. " + SENTENCES["zh"][0]])[0]) == {"zh", "de"}
    s = L.segments(L.Reader(L.Space(), protos), [long + " 没有人看日志。 " + long])
    assert [L.LANGUAGES[k] for k in s["lang"]] == ["en", "zh", "en"]
    # lists of names and code lines are no sentences
    main = " ".join(SENTENCES["zh"])
    assert read(protos, [main + " Wouter Drechtsloot, Ilse Pfahlrode.", main + " a_1 b_2 c_3 d_4 die alten liest e_5."]) == [["zh"], ["zh"]]


def test_segments_cover_the_text_in_order(protos):
    text = SENTENCES["en"][0] + " " + SENTENCES["de"][0]
    s = L.segments(L.Reader(L.Space(), protos), [text, "", text])
    assert s["text"].tolist() == [0, 0, 2, 2] and s["first"].tolist()[:2] == [0, 13]
    assert (s["confidence"] > 0.9).all()


def test_segments_have_characters(protos):
    parts = [("旧客户端仍在写入共享队列，要在封版之前完成。", "zh"), ("Nobody reads the old logs and the totals drift apart otherwise.", "en"), ("没有人会看旧日志，否则总数对不上。", "zh")]
    text = "".join(p for p, _ in parts)
    f = pd.DataFrame({"key": ["a", "b"], "version": 0, "lang": "x", "text": [text, "\u3000 Ｎｏｂｏｄｙ reads the old logs. " + SENTENCES["de"][0]]})
    got = next(L._read(protos, {}, True)([f]))["segments"].tolist()
    assert [(text[s["first_char"] : s["end_char"]], s["lang"]) for s in got[0]] == parts
    assert [f["text"][1][s["first_char"] :][:3] for s in got[1]] == ["\u3000 Ｎ", "Der"]


def test_confidence_is_reliable(protos):
    texts = [s[k] for s in SENTENCES.values() for k in range(3)]
    labels = [x for x in SENTENCES for _ in range(3)]
    table = L.reliability(protos, texts, labels)
    assert sum(n for _, _, n in table) >= 15 and sum(abs(c - r) * n for c, r, n in table) / sum(n for _, _, n in table) < 0.1


def test_language_rows(spark, protos):
    schema = "k string, lang string, body string, v timestamp, text string"
    rows = [("a", "en", SENTENCES["de"][0], None, "x"), ("a", "en", SENTENCES["de"][0], None, "x"), (None, "en", "x", None, "x"), ("b", None, None, None, "x")]
    df = spark.createDataFrame(rows, schema)
    got = {r["key"]: (r["label"], r["langs"]) for r in L.languages(df, "k", "body", "v", protos, {"en": "en"}).collect()}
    assert got == {"a": ("en", ["de"]), "b": (None, [])}
    assert L.record_segments(df, "k", "body", "v", protos, {"en": "en"}).count() == 1
    assert L.languages(spark.createDataFrame([], schema), "k", "body", "v", protos, {}).count() == 0


BAD = ["You stinking rat, crawl back into your hole", "Shut your dirty mouth, you worthless maggot", "Every foreigner is a thief and belongs in a cage", "I will break every bone you have"]
GOOD = ["The rat infestation in the cellar reduced the rent", "The claim is allowed in part and the appeal dismissed", "The insults are not repeated here", "Thank you for posting this summary"]


@pytest.fixture(scope="module")
def index():
    segs, label, text, words = U.examples([(t, 1) for t in BAD] + [(t, 0) for t in GOOD])
    return U.build(segs, label, text, words, np.full(len(words), 3.0), 1000)


def score(ix, texts):
    f = pd.DataFrame({"doc_id": range(len(texts)), "source": "s", "published_at": None, "text": texts})
    return next(U._documents(ix)([f]))["score"].tolist()


def test_unwanted_scores(index):
    s = score(index, ["The court sat. " + BAD[0] + ". Costs follow.", BAD[1].upper(), GOOD[0], GOOD[2] + ". " + GOOD[1], None, "", " \n "])
    assert s[0] > 0.5 and s[1] > 0.5 and max(s[2:4]) < 0.5 and s[4:] == [0, 0, 0]


def test_disguised_spelling(index):
    texts = ["Y0u 5t1nk1ng r4t, cr4wl b4ck 1nt0 y0ur h0l3", "Shuuut your diiirty mouth, you wooorthless maggot", "Shut your d i r t y mouth, you w o r t h l e s s maggot", "You stinking rat, cra-\nwl back into your hole", "You st****ng rat, c***l back into your hole"]
    assert min(score(index, texts)) > 0.5


def dense(ix):
    m = np.zeros((len(ix.words), len(ix.label)))
    for w in range(len(ix.words)):
        a, b = ix.postings[ix.lists[w]], ix.postings[ix.lists[w + 1]]
        m[w, ix.example[a:b]] = ix.weight[a:b]
    return m


def test_block_search_is_exact():
    rng = np.random.default_rng(0)
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(90)]
    rows = [(" ".join(rng.choice(vocabulary, rng.integers(3, 9))), int(rng.random() < 0.4)) for _ in range(150)]
    segs, label, text, words = U.examples(rows)
    ix = U.build(segs, label, text, words, rng.integers(1, 400, len(words)).astype(float), 1000)
    full = dense(ix)
    assert np.allclose(np.linalg.norm(full, axis=0), 1) and np.allclose(full[:, label == 1].max(1), ix.wanted_max)
    lexicon = U.Lexicon(ix.words, ix.masks)
    seen = 0
    for _ in range(40):
        body = ". ".join(" ".join(rng.choice([*words, "zzunknown"], rng.integers(1, 9))) for _ in range(4))
        ids, _ = lexicon.batch([body])
        which, score, near = U.scored(ix, ids)
        seg = np.cumsum(ids == -2)
        got = dict(zip(which.tolist(), zip(score, near)))
        for k in range(int(seg[-1]) + 1):
            w, c = np.unique(ids[(seg == k) & (ids >= 0)], return_counts=True)
            x = np.zeros(len(ix.words))
            x[w] = (1 + np.log(c)) * ix.idf[w]
            other = ((seg == k) & ((ids == -1) | (ids == -3))).sum()
            sims = x @ full / max(np.sqrt((x**2).sum() + other * ix.unknown**2), 1e-12)
            floor = U.NEAR if c.sum() + other < U.WORDS else U.LEAST
            top = np.sort(sims)[::-1][: U.K]
            if not (sims[label == 1] >= floor).any():
                assert got.get(k, (0, 0))[0] == 0
                continue
            best = np.lexsort((np.arange(len(sims)), -sims))[: U.K]
            v = np.where(sims[best] >= floor, sims[best], 0) ** 2
            assert top[0] >= floor and got[k][0] == pytest.approx((v * label[best]).sum() / (v.sum() + U.PRIOR), abs=1e-6)
            assert sims[got[k][1]] == pytest.approx(top[0])
            seen += 1
    assert seen > 50


def test_short_insults_are_found_and_short_words_are_not():
    segs, label, text, words = U.examples([("You bastard", 1), ("Shut up idiot", 1)] + [(t, 1) for t in BAD] + [(t, 0) for t in GOOD])
    ix = U.build(segs, label, text, words, np.full(len(words), 3.0), 1000)
    s = score(ix, ["You bastard.", "The court sat. You bastard! Costs follow.", "You", "Your mouth.", "Shut", "The rat."])
    assert min(s[:2]) > 0.5 and max(s[2:]) == 0


def test_scores_are_calibrated_on_the_labels_left_out():
    rows = [(f"{b} {x}", 1) for b in BAD for x in ("now", "today", "again")] + [(f"{g} {x}", 0) for g in GOOD for x in ("now", "today", "again")]
    table = U.calibration(rows)
    n = sum(k for _, _, k in table)
    assert n == 24 and sum(abs(m - share) * k for m, share, k in table) / n < 0.15


def test_unwanted_rows(spark):
    schema = "doc_id bigint, text string, source string, published_at timestamp, score int"
    labels = spark.createDataFrame([(t, 1) for t in BAD] + [(t, 0) for t in GOOD] + [(None, 1), ("x", None)], "snippet string, unwanted bigint")
    rows = [(1, BAD[0], " S", None, 9), (1, BAD[0], " S", None, 9), (2, None, None, None, 9), (None, BAD[0], "s", None, 9), (3, GOOD[0] * 500, "s", None, 9)]
    df = spark.createDataFrame(rows, schema)
    s = U.scores(df, labels)
    assert {r["doc_id"] for r in U.found(s).collect()} == {1}
    assert {r["source"]: r["documents"] for r in U.rates(s).collect()} == {"s": 2, None: 1}
    assert U.scores(df, labels.where("unwanted = 7")).where("score > 0").count() == 0
    assert U.scores(spark.createDataFrame([], schema), labels).count() == 0


NAMES = [("Imogen", "Harrowsbee"), ("Silas", "Quillmark"), ("Petra", "Maridew"), ("Rufus", "Oxenmoor"), ("Maud", "Stellock"), ("Edmund", "Wexlaw")]


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(3)
    texts = []
    for k in range(900):
        g, f = NAMES[rng.integers(6)][0], NAMES[rng.integers(6)][1]
        mail = f"{g}.{f}@host.example".lower()
        phone = f"555-01{rng.integers(10, 99)}"
        form = [
            f"You can reach {g} {f} at {mail} or {phone}.", f"From: {g} {f} <{mail}>", f"owner: {f}, {g} # {phone}", f"My SSN 900-{rng.integers(10, 99)}-{rng.integers(1000, 9999)} was rejected twice.",
            f"{g} {f} moved to {rng.integers(1, 99)} Quarry Lane; mail goes to {mail}.", f"The build is slow, sku {rng.integers(100, 999)}-{rng.integers(10, 99)}-{rng.integers(10**5, 10**6)} [{f} gateway]",
            "The old client reads twice from the table before the freeze.",
        ][k % 7]
        texts.append(form)
    return P.from_texts(texts)


def kinds(model, text):
    return [p[1] for p in P.pieces(*model, [text])]


def test_pieces(model):
    assert kinds(model, "You can reach Silas Wexlaw at silas.wexlaw@host.example or 555-0177.") == ["person_name", "email", "phone"]
    assert kinds(model, "owner: Maridew, Rufus # 555-0142") == ["person_name", "phone"]
    assert kinds(model, "My SSN 900-12-3456 was rejected twice.") == ["id_number"]
    assert kinds(model, "Maud Oxenmoor moved to 12 Quarry Lane; mail goes to a.b@c.example.") == ["person_name", "street_address", "email"]
    assert kinds(model, "The build is slow, sku 123-45-678901 [Quillmark gateway]") == []
    assert P.pieces(*model, [None, "", "  "]) == []


def test_redaction_keeps_the_rest(model):
    text = "Note:\n  You can reach  Silas Wexlaw at silas.wexlaw@host.example or 555-0177.\tBye."
    assert P.replaced(text, P.pieces(*model, [text])) == "Note:\n  You can reach  [PERSON_NAME] at [EMAIL] or [PHONE].\tBye."
    long = "The old client reads twice. " * 5000 + "From: Silas Wexlaw <silas.wexlaw@host.example>"
    assert P.replaced(long, P.pieces(*model, [long])).endswith("From: [PERSON_NAME] <[EMAIL]>")


def test_messages_are_exact_on_a_tree():
    # two chains of two tokens joined by one edge are a tree: beliefs and labels must equal enumeration
    import itertools

    rng = np.random.default_rng(3)
    n = len(P.KINDS) + 1
    psi = rng.standard_normal((2, n, n))
    psi = (psi + psi.transpose(0, 2, 1)) / 2
    field = P.Field({}, np.zeros((1, len(P.TAGS))), P.allowed() + rng.standard_normal((len(P.TAGS),) * 2), psi)
    em = rng.standard_normal((4, len(P.TAGS)))
    edges = P.links([0, 0, 0, 0], ["", "n1", "n1", ""])
    assert edges.tolist() == [[1, 2, 0]]
    add, _, _ = P.messages(field, em, np.array([2, 2]), edges)
    m = P.marginals(field, em + add, np.array([2, 2]))
    kind = lambda t: 0 if t == 0 else (t + 1) // 2
    want = np.zeros_like(m)
    for y in itertools.product(range(len(P.TAGS)), repeat=4):
        if "I" in (P.TAGS[y[0]][0], P.TAGS[y[2]][0]):
            continue
        w = np.exp(sum(em[i, y[i]] for i in range(4)) + field.trans[y[0], y[1]] + field.trans[y[2], y[3]] + psi[0, kind(y[1]), kind(y[2])])
        for i in range(4):
            want[i, y[i]] += w
    assert np.allclose(m, want / want.sum(1, keepdims=True), atol=1e-6)


def test_skip_edges_decide_repeated_numbers():
    """Ablation: a number whose second mention has no context is found through its skip edge only."""
    rng = np.random.default_rng(8)
    number = lambda: f"123-{rng.integers(10, 99)}-{rng.integers(1000, 9999)}"
    texts = []
    for k in range(400):
        x = number()
        texts.append(f"My SSN {x} was rejected twice. The clerk wrote {x} again." if k % 2 else f"The build {x} is slow. The clerk wrote {x} again.")
    lex, field = P.from_texts(texts)
    assert (np.diag(field.skip[0])[[0, 3]] > 0.3).all()
    without = P.Field(field.ids, field.w, field.trans)
    x, z = number(), number()
    mentions = [f"The clerk wrote {x} again. My SSN {x} was rejected twice.", f"The clerk wrote {z} again. The build {z} is slow."]
    count = lambda f: [sum(p[1] == "id_number" for p in P.pieces(lex, f, [t])) for t in mentions]
    assert count(field) == [2, 0] and count(without) != [2, 0]


def test_long_windows_are_cut_into_overlapping_chains(model):
    for n in (1, P.MOST, P.MOST + 1, 1000):
        kept = [k for a, b, lo, hi in P.cut(n) for k in range(lo, hi) if a <= lo and hi <= b and b - a <= P.MOST]
        assert kept == list(range(n))
    text = "Silas Wexlaw 555-0177 " * 3000
    assert kinds(model, text) == ["person_name", "phone"] * 3000


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    em, tr = rng.standard_normal((3, len(P.TAGS))), P.allowed() + rng.standard_normal((len(P.TAGS),) * 2)
    m = P.chains(em, np.array([3]), tr)[0]
    import itertools

    total, marginal = 0.0, np.zeros_like(m)
    for y in itertools.product(range(len(P.TAGS)), repeat=3):
        if P.TAGS[y[0]][0] == "I":
            continue
        s = np.exp(sum(em[i, y[i]] for i in range(3)) + tr[y[0], y[1]] + tr[y[1], y[2]])
        total += s
        for i in range(3):
            marginal[i, y[i]] += s
    assert np.allclose(m, marginal / total, atol=1e-8)


def test_personal_rows(spark, model, monkeypatch):
    monkeypatch.setattr(P, "fitted", lambda frames: model)
    import os
    import tempfile

    d = tempfile.mkdtemp()
    rows = [(1, "From: Silas Wexlaw <silas.wexlaw@host.example>", None), (1, "From: Silas Wexlaw <silas.wexlaw@host.example>", None), (2, None, None), (None, "555-0177", None)]
    spark.createDataFrame(rows, "turn_id bigint, text string, ingested_at timestamp").write.parquet(os.path.join(d, "turns.parquet"))
    spark.createDataFrame([], "mem_id string, content string, ingested_at timestamp, key int").write.parquet(os.path.join(d, "memories.parquet"))
    assert sorted(tuple(r) for r in P.found(spark, d).collect()) == [("turns", "1", "email", 1), ("turns", "1", "person_name", 1)]
    got = {r["record_id"]: r["redacted"] for r in P.redacted(spark, d).collect()}
    assert got == {"1": "From: [PERSON_NAME] <[EMAIL]>", "2": None}


def test_han_names_of_two_to_four_characters():
    family, own = ["闻人", "公冶", "端木", "轩辕"], ["雁回", "云舟", "青岚", "晚棠"]
    texts = [f"服务仍在写入队列。联系人{family[k % 4]}{own[k // 4 % 4]}，电话10011700{k:03d}。没有人会看旧日志，负责人这样要求。" for k in range(900)]
    model = P.from_texts(texts)
    for name in ("李四", "王小明", "欧阳修", "澹台松砚"):
        text = f"服务仍在写入队列。联系人{name}，电话10011700999。"
        found = P.pieces(*model, [text])
        assert [p[1] for p in found] == ["person_name", "phone"]
        assert P.replaced(text, found) == "服务仍在写入队列。联系人[PERSON_NAME]，电话[PHONE]。"
    assert kinds(model, "没有人会看旧日志，负责人这样要求。") == []


def test_lexicon_counts_all_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "SAMPLE", 5)
    rows = [(k, "the old client reads twice") for k in range(200)] + [(900 + k, "From: Silas Wexlaw <s@host.example>") for k in range(2)] + [(990, "mail Petra Maridew petra.maridew@host.example"), (991, None), (None, "x")]
    df = spark.createDataFrame(rows, "k bigint, body string")
    lex = P.counted([(df, "k", "body")], 205)
    assert {"silas", "petra"} <= lex.given and {"wexlaw", "maridew"} <= lex.family and "client" in lex.common
    halves = P.tally([r[1] for r in rows[150:]], P.tally([r[1] for r in rows[:150]]))
    assert P.lexicon(halves).names == P.learned([r[1] for r in rows if r[1]]).names


def test_every_name_of_all_rows_is_in_the_lexicon(spark, monkeypatch):
    """No cut by frequency: names of many rows are those that one tally of all texts gives; before, only the ``NAMED`` most frequent entries were kept."""
    from mnemospark.llm import personal

    monkeypatch.setattr(personal, "NAMED", 5, raising=False)
    letters = "abcdefghij"
    texts = [f"From: Qu{letters[i]}ro Zo{letters[i]}ski <x@y.org> met the the the the team" for i in range(10) for _ in range(2)]
    texts += ["Write to Anna Bergmann annabergmann@mail.org or Bergmann Anna", "联系人：王小明，电话 13800000000", "联系人：王小明，电话 13800000001", "no name", ""]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "From: Left Out <x@y.org>")], "id long, text string")
    got, want = personal.counted([(df, "id", "text")], len(texts)), personal.learned(texts)
    for part in ("given", "family", "common", "han"):
        assert getattr(got, part) == getattr(want, part)
    assert len(got.given) == 11 and len(got.family) == 11
