import itertools
import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lathe.llm import langid

EN = "the of and to in that is was for with this they have from which would there their what when".split()
FR = "le la les des une dans pour que qui est sont avec nous vous être cette mais elle leurs très".split()


def model():
    rng = random.Random(0)
    make = lambda words: [" ".join(rng.choice(words) for _ in range(200)) for _ in range(5)]
    return langid.fit({"en": make(EN), "fr": make(FR)})


def brute(scores, switch):
    best = None
    for path in itertools.product(range(scores.shape[1]), repeat=len(scores)):
        total = sum(scores[i, s] for i, s in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))
        if best is None or total > best + 1e-4:
            best = total
    return best


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(0)
    lengths = [0, 1, 5, 7, 3, 0, 6]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    scores = rng.normal(size=(offsets[-1], 3)).astype(np.float32) * 2
    path = langid.viterbi(scores, offsets, 1.5)
    for a, b in zip(offsets, offsets[1:]):
        if a == b:
            continue
        own = path[a:b]
        total = sum(scores[a + i, s] for i, s in enumerate(own)) - 1.5 * int((own[1:] != own[:-1]).sum())
        assert abs(total - brute(scores[a:b], 1.5)) < 1e-3


def test_scripts():
    points = np.array([ord(c) for c in "aÉяα中ひ한ש3 .×"])
    assert [langid.SCRIPTS[s] for s in langid.scripts_of(points)] == ["Latin", "Latin", "Cyrillic", "Greek", "Han", "Kana", "Hangul", "Hebrew", "none", "none", "none", "none"]


def test_mixed_text_spans():
    text = " ".join(EN[:10]) + ". 12 " + " ".join(FR[:10]) + " Привет мир"
    out = {k: v.to_pylist()[0] for k, v in langid.label_texts(pa.array([text]), model()).items()}
    assert [(s["lang"], s["first_word"]) for s in out["spans"]][0] == ("en", 0)
    assert [s["lang"] for s in out["spans"]] == ["en", "fr", "ru"]
    assert sum(s["n_words"] for s in out["spans"]) == out["n_words"] == 23
    assert out["keep"]


def test_rejections_and_empties():
    out = langid.label_texts(pa.array([None, "", "12 ##", "xqzkj qqxvz zzkqx", "the of and"]), model())
    assert out["lang"].to_pylist() == ["und", "und", "und", "und", "en"]
    assert out["keep"].to_pylist() == [False, False, False, False, True]
    assert [len(s) for s in out["spans"].to_pylist()] == [0, 0, 0, 1, 1]
    untrained = langid.label_texts(pa.array(["the of", "12"]), langid.fit({}))
    assert untrained["keep"].to_pylist() == [True, False]


def test_slices_change_nothing(spark):
    rng = random.Random(4)
    m = model()
    texts = [" ".join(rng.choice(EN if rng.random() < 0.5 else FR) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    whole = langid.label_texts(pa.array(texts), m)["spans"].to_pylist()
    assert whole == [langid.label_texts(pa.array([t]), m)["spans"].to_pylist()[0] for t in texts]


def test_frames(spark):
    rows = [(1, "the of and to in", "en", 1), (2, None, "fr", 2), (3, "le la les des une", "fr", 3), (3, "le la les des une", "fr", 3), (None, "the of", None, 4), (4, "zq " * 70_000, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, keep int")
    fitted = langid.fitted(docs)
    assert fitted.languages == ("en", "fr")
    got = {r["doc_id"]: r for r in langid.identify(docs, fitted).collect()}
    assert got[1]["lang"] == "en" and got[3]["lang"] == "fr" and not got[2]["keep"] and not got[4]["keep"]
    kept = langid.keep_identified(docs, fitted)
    assert kept.columns == docs.columns
    assert sorted(r["keep"] for r in kept.collect()) == [1, 3, 3, 4]
    assert langid.identify(docs.limit(0), langid.fitted(docs.limit(0))).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = langid.fitted(docs, bound=40)
    out = langid.identify(docs, m).select("doc_id", "lang", "keep").join(docs.select("doc_id", docs.lang.alias("real")), "doc_id").collect()
    assert sum(r["lang"] == r["real"] for r in out) > 0.99 * len(out)
    assert sum(r["keep"] for r in out) > 0.995 * len(out)


def test_segments_change_no_path():
    rng = np.random.default_rng(3)
    lengths = [0, 1, 40, 700, 5, 333, 64]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    for labels in (1, 2, 4):
        # halves: sums are exact, so ties are ties however they are added up
        scores = (rng.integers(-6, 6, size=(offsets[-1], labels)) / 2).astype(np.float32)
        whole = langid.viterbi(scores, offsets, 2.5, 10_000)
        for segment in (1, 2, 7, 64):
            assert (langid.viterbi(scores, offsets, 2.5, segment) == whole).all()


def plain_viterbi(scores, switch):
    """One text, step by step: staying before changing, the lower label before the higher."""
    state, steps = list(scores[0]), []
    for row in scores[1:]:
        best = max(range(len(state)), key=lambda j: (state[j], -j))
        came = [j if state[j] >= state[best] - switch else best for j in range(len(state))]
        state = [max(state[j], state[best] - switch) + row[j] for j in range(len(state))]
        steps.append(came)
    path = [max(range(len(state)), key=lambda j: (state[j], -j))]
    for came in reversed(steps):
        path.append(came[path[-1]])
    return path[::-1]


def grams(word):
    """Buckets of a word's letter trigrams."""
    kept = "\x00" + "".join(c for c in word if langid.scripts_of(np.array([ord(c)]))[0]) + "\x00"
    m, out = [int(x) for x in langid.textops.MULTIPLIERS[:3]], []
    for i in range(len(kept) - 2):
        h = sum(a * ord(c) for a, c in zip(m, kept[i : i + 3])) % 2**64
        h ^= h >> 32
        h = h * langid.textops.MIX % 2**64
        out.append((h ^ (h >> 29)) >> 48)
    return out


def brute_model(samples):
    counts = {k: Counter(g for t in v for w, n in Counter(t.lower().split()).items() for g in grams(w) * n) for k, v in sorted(samples.items())}
    return counts, {k: sum(c.values()) for k, c in counts.items()}, len({g for c in counts.values() for g in c})


def brute_verdict(text, made, switch=langid.SWITCH, max_und=langid.MAX_UND):
    """Language, share, spans and verdict of one Latin text straight from the definition, without numpy."""
    counts, total, seen = made
    labels = [*counts, "und"]
    words = (text or "").lower().split()
    own = {w: grams(w) for w in words}
    rows = [[sum(math.log((c[g] + 0.5) / (total[k] + 0.5 * (seen + 1))) for g in own[w]) for k, c in counts.items()] + [-math.log(seen) * len(own[w])] for w in words]
    path = plain_viterbi(rows, switch) if rows else []
    told = [labels[p] for p, w in zip(path, words) if own[w]]
    if not told:
        return "und", 0.0, [], False
    lang = max(labels, key=lambda x: (told.count(x), -labels.index(x)))
    spans = [(labels[k], len(list(g))) for k, g in itertools.groupby(path)]
    return lang, told.count(lang) / len(told), spans, told.count("und") / len(told) <= max_und


def test_verdicts_equal_a_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    samples = {}
    for r in rows[:30]:
        samples.setdefault(r["lang"], []).append(r["text"])
    fitted, made = langid.fit(samples), brute_model(samples)
    rng = random.Random(8)
    texts = [r["text"] for r in rows if len(r["text"]) < 2_000][30:70]
    texts += [" ".join(rng.choice(texts).split()[:12] + rng.choice(texts).split()[:12]) for _ in range(30)]
    texts += ["xq zzkq qqx jjkx wvxq kkqz", "12 34 ##", "", None, "a", "the 12 le"]
    out = langid.label_texts(pa.array(texts), fitted)
    got = list(zip(*(out[c].to_pylist() for c in ("lang", "share", "spans", "keep"))))
    for text, (lang, share, spans, keep) in zip(texts, got):
        want = brute_verdict(text, made)
        assert (lang, [(s["lang"], s["n_words"]) for s in spans], keep) == (want[0], want[2], want[3]), text
        assert abs(share - want[1]) < 1e-9


def test_languages_of_one_script_are_told_apart():
    said = {
        "ru": "Это было очень давно, и мы уже ничего об этом не помним. Её дети выросли и уехали в большой город.",
        "uk": "Це було дуже давно, і ми вже нічого про це не пам'ятаємо. Її діти виросли й поїхали до великого міста.",
        "sr": "То је било веома давно и ми се тога више не сећамо. Њена деца су порасла и отишла у велики град, њихова кућа још стоји.",
        "ar": "كان ذلك منذ زمن بعيد ونحن لا نتذكر شيئا عن تلك الأيام الجميلة",
        "fa": "این خیلی وقت پیش بود و ما دیگر چیزی از آن به یاد نمی‌آوریم، چگونه گذشت",
        "ur": "یہ بہت پہلے کی بات ہے اور ہمیں اب اس کے بارے میں کچھ یاد نہیں ہے، بڑے گھر",
        "zh": "那是很久以前的事了,我们什么都不记得了。",
        "ja": "それはとても昔のことで、私たちはもう何も覚えていません。",
        "ko": "그것은 아주 오래전 일이라 우리는 아무것도 기억하지 못한다", "th": "มันนานมาแล้วและเราจำอะไรไม่ได้เลย", "el": "Αυτό έγινε πολύ παλιά", "hi": "यह बहुत पहले की बात है", "he": "זה היה לפני זמן רב", "ka": "ეს დიდი ხნის წინ იყო",
    }
    out = langid.label_texts(pa.array(list(said.values())), model())
    assert out["lang"].to_pylist() == list(said)
    assert all(out["keep"].to_pylist())
    # one text of all of them, with Latin between: every language has its span
    mixed = langid.label_texts(pa.array([" ".join(v + " " + " ".join(EN[:9]) for v in said.values())]), model())["spans"].to_pylist()[0]
    assert [s["lang"] for s in mixed] == [x for lang in said for x in (lang, "en")]
    # without spaces too
    joined = langid.label_texts(pa.array([said["zh"] * 3 + said["ja"] * 3 + said["th"]]), model())["spans"].to_pylist()[0]
    assert [s["lang"] for s in joined] == ["zh", "ja", "th"]


def test_languages_come_from_the_labels(spark):
    uk = "це було дуже давно і ми вже нічого про це не памятаємо".split()
    ru = "это было очень давно и мы уже ничего об этом не помним".split()
    pt = "não são muito então você também isso quando estão sobre mesmo".split()
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(w) for _ in range(60)), lang) for i, (lang, w) in enumerate([("uk", uk), ("ru", ru), ("pt", pt), ("en", EN)] * 10)]
    docs = spark.createDataFrame([*rows, (100, " ".join(pt), None)], "doc_id long, text string, lang string")
    fitted = langid.fitted(docs)
    assert fitted.languages == ("en", "pt", "ru", "uk") and fitted.written == {"Latin": ("en", "pt"), "Cyrillic": ("ru", "uk")}
    got = {r["doc_id"]: r for r in langid.identify(docs, fitted).collect()}
    assert all(got[i]["lang"] == lang and got[i]["keep"] for i, _, lang in rows) and got[100]["lang"] == "pt"
    assert langid.fitted(docs, languages=2).languages == ("en", "pt")
    # without labels, texts of any language with letters stay
    for unlabelled in (docs.drop("lang"), docs.withColumn("lang", F.lit(None).cast("string"))):
        none = langid.fitted(unlabelled)
        assert none.languages == () and langid.keep_identified(unlabelled, none).count() == 41


def test_repeated_rows_do_not_crowd_a_language_out(spark):
    few = [(i, " ".join(EN[i : i + 8]), "en") for i in range(20)]
    docs = spark.createDataFrame([r for r in few for _ in range(300)] + [(1000 + i, " ".join(FR[i % 15 : i % 15 + 8]), "fr") for i in range(400)] + [(0, "another text", "en")], "doc_id long, text string, lang string")
    found = langid.sample(docs, bound=50)
    assert sorted(found) == ["en", "fr"] and len(found["en"]) == 20 and len(found["fr"]) == 50
    assert sorted(found["en"]) == sorted([t for i, t, _ in few[1:]] + [min(few[0][1], "another text")])


def test_a_million_words_in_seconds():
    rng = random.Random(2)
    text = " ".join(" ".join(rng.choices(w, k=1_000)) for w in [EN, FR] * 500)
    began = time.perf_counter()
    out = langid.label_texts(pa.array([text]), model())
    assert time.perf_counter() - began < 20
    assert [s["lang"] for s in out["spans"].to_pylist()[0]] == ["en", "fr"] * 500


def test_ties_go_to_the_earlier_code():
    out = langid.label_texts(pa.array(["the of the of"]), langid.fit({"b": ["the of"] * 50, "a": ["the of"] * 50, "c": [" ".join(FR)]}))
    assert out["lang"].to_pylist() == ["a"]
