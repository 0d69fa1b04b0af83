import random

import pyarrow as pa
import pytest

from lathe.llm import nbest

V = nbest.vocabulary(nbest.MODEL)


def brute(text):
    """All segmentations of the whole marked text: [(score, ids)], best first."""
    s = nbest.SPACE + text.replace(" ", nbest.SPACE)
    out = []

    def go(i, score, ids):
        if i == len(s):
            out.append((score, ids))
            return
        for k in range(1, min(V.longest, len(s) - i) + 1):
            piece = V.text.get(s[i : i + k])
            if piece is not None:
                go(i + k, score + V.score[piece], [*ids, piece])
            elif k == 1:
                go(i + 1, score + V.unknown, [*ids, *V.byte[list(s[i].encode())].tolist()])

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


TEXTS = ["a", "the cat", "an einst", "a  b", " x", "x ", "a\nb c", "née 🙂!", "aaaa bb", "   ", "中文 x", "is it on"]


@pytest.mark.parametrize("n", [1, 2, 4, 7])
def test_n_best_equals_all_segmentations(n):
    out = {k: c.to_pylist() for k, c in nbest.segment(pa.array(TEXTS), nbest.MODEL, n).items()}
    for i, t in enumerate(TEXTS):
        want = brute(t)
        scores = {tuple(ids): s for s, ids in want}
        got = [(out["score"][i], out["ids"][i])] + [(a["score"], nbest.alternative(out["ids"][i], [(e["at"], e["removed"], e["ids"]) for e in a["edits"]])) for a in out["alternatives"][i]]
        assert len(got) == min(n, len(want)) and len({tuple(x) for _, x in got}) == len(got)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:n]])
        for s, ids in got:
            assert scores[tuple(ids)] == pytest.approx(s)
            assert nbest.decode(ids) == t
        assert out["round_trip"][i]


def test_random_words():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abentiohé.,") for _ in range(rng.randint(1, 5))) for _ in range(3)) for _ in range(25)]
    out = nbest.segment(pa.array(texts))
    for i, t in enumerate(texts):
        want = brute(t)[:4]
        got = [out["score"][i].as_py()] + [a["score"] for a in out["alternatives"][i].as_py()]
        assert got == pytest.approx([s for s, _ in want])


def test_frames_and_edges(spark):
    long = "x" * 40_000 + " tail"
    rows = [(1, None, 1), (2, "", 2), (3, "plain text", 3), (3, "plain text", 3), (None, "a b", 4), (4, long, 5), (5, "mark ▁ here", 6), (6, "tab\tline\n\n", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = nbest.encode(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(got) == 8 and by[1][0]["ids"] == [] and by[2][0]["score"] == 0 and by[1][0]["alternatives"] == []
    assert by[3][0] == by[3][1] and by[4][0]["round_trip"] and nbest.decode(by[4][0]["ids"]) == long
    assert not by[5][0]["round_trip"] and by[6][0]["round_trip"]
    assert nbest.encode(docs.limit(0)).count() == 0


def test_round_trip_of_the_corpus(spark):
    out = nbest.encode(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert out.filter("NOT round_trip").count() == 0 and out.filter("size(alternatives) < 3 AND n_pieces > 20").count() == 0
