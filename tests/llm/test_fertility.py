import math
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from lathe.llm import fertility, tokens


def brute(text):
    bpe, sp = tokens.byte_bpe(fertility.BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=fertility.PIECES)
    ids = sp.encode(text)
    counts = Counter(ids)
    bits = -sum(n / len(ids) * math.log2(n / len(ids)) for n in counts.values())
    assert isinstance(bpe, tiktoken.Encoding)
    return {
        "n_chars": len(text), "n_tokens": len(bpe.encode_ordinary(text)), "n_pieces": len(ids), "chars_per_token": len(text) / len(bpe.encode_ordinary(text)), "chars_per_piece": len(text) / len(ids),
        "fallback_share": sum(n for i, n in counts.items() if sp.is_byte(i)) / len(ids), "entropy": bits, "evenness": bits / math.log2(len(counts)) if len(counts) > 1 else 0.0,
    }


TEXTS = ["plain words here", "a", "née über 中文 🙂", "  two  spaces\n\nand lines ", "x" * 3_000, "12 34, it's a 'test'!\t\ttabs", "▁mark", " lead", "trail \n", "a b  　c", "ﬁne ①② Ⅳ"]


def test_measures_equal_the_libraries():
    got = fertility.measure_texts(TEXTS, fertility.BYTE_LEVEL, fertility.PIECES)
    for i, t in enumerate(TEXTS):
        for k, v in brute(t).items():
            assert got[k][i] == pytest.approx(v), (t, k)


def test_main_script():
    assert [fertility.main_script(t) for t in ("abc", "12", "где and", "слово", "日本 x", "é")] == ["Latin", "none", "Latin", "Cyrillic", "Han", "Latin"]


def test_bands_and_edges(spark):
    rng = random.Random(4)
    words = "the quick brown fox jumps over lazy dog and river stone green light".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(150)), "en", 0) for i in range(60)]
    noise = "".join(chr(rng.randint(0x1000, 0x109F)) for _ in range(300))
    rows += [(100, noise, "en", 0), (101, None, "en", 0), (102, "", None, 0), (103, "short", None, 0), (103, "short", None, 0), (None, "short", "xx", 0), (104, rows[0][1], "en", 0), (105, "word " * 100_000, "xx", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int")
    got = {}
    for r in fertility.judge(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert all(got[i][0]["keep"] for i in range(60)) and not got[100][0]["keep"] and "fallback" in got[100][0]["broken"]
    assert got[101][0]["broken"] == ["empty"] and got[102][0]["broken"] == ["empty"] and got[101][0]["chars_per_token"] is None
    assert got[103][0] == got[103][1] and got[103][0]["grp"] == "script:Latin" and got[None][0]["keep"]
    same = lambda r: {k: v for k, v in r.asDict().items() if k != "doc_id"}
    # a language of two texts is judged by its script
    assert same(got[104][0]) == same(got[0][0]) and got[105][0]["broken"] == ["entropy"]
    assert fertility.judge(docs.limit(0)).count() == 0
    assert fertility.judge(docs.drop("lang")).count() == len(rows)


def test_repeated_words_break_the_entropy_rule(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    said = {r["doc_id"]: r["text"].split() for r in docs.collect() if r["text"]}
    repeated = {d for d, w in said.items() if len(w) >= 60 and len(set(w)) < 0.2 * len(w)}
    varied = {d for d, w in said.items() if len(w) >= 60 and len(set(w)) > 0.4 * len(w)}
    broken = {r["doc_id"]: r["broken"] for r in fertility.judge(docs).collect()}
    assert len(repeated) > 20 and all("entropy" in broken[d] for d in repeated)
    assert len(varied) > 100 and sum("entropy" in broken[d] for d in varied) < 0.01 * len(varied)


def test_short_texts_are_judged_by_wider_bands(spark):
    rng = random.Random(8)
    words = "the quick brown fox jumps over lazy dog and river stone green light".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(150)), "en") for i in range(60)]
    rows += [(100 + n, " ".join(rng.choice(words) for _ in range(n)), "en") for n in range(1, 60)]
    rows += [(200, "= " * 25 + "+ " * 25, "en"), (201, "word " * 50, "en")]
    got = {r["doc_id"]: r for r in fertility.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["keep"] for i in got if i < 200)
    assert all(got[i]["n_tokens"] < 64 for i in (200, 201))
    assert "chars_per_token" in got[200]["broken"] and "entropy" in got[201]["broken"]


def test_verdicts_equal_a_brute_force(spark):
    """The verdict of every text, from its measures, without Spark: exact quantiles stand for the approximate ones."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("lang")).alias("lang"))
    docs = docs.union(spark.createDataFrame([(9001, "слово " * 40, "ru"), (9002, "= + " * 60, "ru"), (9003, "word " * 400, "xx"), (9004, "", "en"), (9005, None, None)], docs.schema))
    rows = docs.collect()
    m = fertility.measure_texts([r["text"] for r in rows], fertility.BYTE_LEVEL, fertility.PIECES)
    texts = [{k: m[k][i] for k in m} | {"id": r["doc_id"], "script": m["script"][i] or "none"} for i, r in enumerate(rows)]
    for t, r in zip(texts, rows):
        t["grp"] = r["lang"] or "script:" + t["script"]
    spoken = [t for t in texts if t["n_tokens"]]
    say = lambda t: t["n_tokens"] / (t["n_tokens"] + fertility.SHORT)

    def quantile(values, q):  # the least value that a share q does not exceed
        values = sorted(values)
        return values[max(0, math.ceil(q * len(values)) - 1)]

    def shrink(figure, grp, script):
        def level(some, above):
            w = sum(map(say, some))
            return (figure(some) * w + fertility.FEW * above) / (w + fertility.FEW)

        return level([t for t in spoken if t["grp"] == grp], level([t for t in spoken if t["script"] == script], figure(spoken)))

    def line(part):
        def figure(some):
            w, x, y = np.array([say(t) for t in some]), np.array([t["n_pieces"] ** -0.5 for t in some]), np.array([t["entropy"] for t in some])
            spread = w.sum() * (w * x * x).sum() - (w * x).sum() ** 2
            slope = min((w.sum() * (w * x * y).sum() - (w * x).sum() * (w * y).sum()) / spread, 0) if spread > 1e-9 * w.sum() * (w * x * x).sum() else 0
            return slope if part else ((w * y).sum() - slope * (w * x).sum()) / w.sum()

        return figure

    for key in {(t["grp"], t["script"]) for t in spoken}:
        for name in fertility.BANDED:
            if name == "entropy":
                level, slope = shrink(line(0), *key), shrink(line(1), *key)
                centre = lambda t, a=level, b=slope: min(max(a + b * t["n_pieces"] ** -0.5, 0), math.log2(t["n_pieces"]))
            else:
                middle = shrink(lambda some, k=name: quantile([t[k] for t in some], 0.5), *key)
                centre = lambda t, c=middle: c
            for t in spoken:
                if (t["grp"], t["script"]) == key:
                    t["far_" + name] = (t[name] - centre(t)) * say(t) ** 0.5
    got = {r["doc_id"]: r for r in fertility.judge(docs).collect()}
    assert len(got) == len(rows)
    limits = {}
    for t in texts:
        want, sure = [], True
        if not t["n_tokens"]:
            want = ["empty"]
        else:
            want += ["fallback"] * (t["fallback_share"] > fertility.MOST_FALLBACK)
            for name in fertility.BANDED:
                key = (t["grp"], t["script"], name)
                if key not in limits:
                    low, high = (shrink(lambda some, k="far_" + name, q=q: quantile([x[k] for x in some], q), *key[:2]) for q in (0.25, 0.75))
                    reach = max((high - low) * fertility.SPREAD, fertility.LEAST_WIDTH[name])
                    limits[key] = low - reach, high + reach
                far, (low, high) = t["far_" + name], limits[key]
                sure &= min(abs(far - low), abs(far - high)) > 1e-6
                want += [name] * bool(far < low or far > high)
        assert not sure or got[t["id"]]["broken"] == sorted(want), t
    assert {"empty", "entropy", "chars_per_token"} <= {b for r in got.values() for b in r["broken"]}


def test_encoding_by_piece_gives_the_same_ids():
    bpe = tokens.byte_bpe(fertility.BYTE_LEVEL)
    for t in TEXTS + ["a\x1cb\x1f c\x85d", "\u2003wide  \n x", "I'll 'VE it's", " " * 50 + "x"]:
        assert tokens.encode_by_piece(bpe, t) == bpe.encode_ordinary(t)
    long = " " * 1_200_000 + "end"
    ids = tokens.encode(bpe, long)
    assert bpe.decode(ids) == long
