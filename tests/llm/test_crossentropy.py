import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from lathe.llm import crossentropy as ce

def brute(rows, target):
    """[(doc_id, n, target loss, background loss)] with each row scored by models counted without it."""
    texts = [(t or "").lower().split() for _, t in rows]
    vocabulary = len({w for t in texts for w in t})

    def model(members):
        u, b = Counter(), Counter()
        for i in members:
            if texts[i]:
                u[""] += 1
            for v, w in zip(["", *texts[i]], texts[i]):
                u[w] += 1
                b[v, w] += 1
        return u, b

    out = []
    for i, (doc, _) in enumerate(rows):
        both = []
        for members in ([k for k, (d, _) in enumerate(rows) if d in target and k != i], [k for k in range(len(rows)) if k != i]):
            u, b = model(members)
            n = sum(c for w, c in u.items() if w)
            total = 0.0
            for v, w in zip(["", *texts[i]], texts[i]):
                p = (u[w] + 0.5) / (n + 0.5 * vocabulary)
                total -= math.log((b[v, w] + ce.MU * p) / (u[v] + ce.MU))
            both.append(total / len(texts[i]) if texts[i] else None)
        out.append((doc, len(texts[i]), *both))
    return out


@pytest.mark.parametrize("per_part,most", [(1 << 21, 100), (50, 100), (1 << 21, 0), (1, 0)])
def test_scores_equal_brute_force(spark, per_part, most):
    rng = random.Random(1)
    words = "a b c d e f Der die über x1".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 40])))) for i in range(25)]
    rows += [(25, None), (26, " \n"), (3, rows[3][1]), (None, "a b c"), (27, "x " * 2_000)]
    labels = [(i, int(i % 3 == 0)) for i in range(20)] + [(6, 0), (None, 1), (9, None), (500, 1)]
    target = {i for i in range(20) if i % 3 == 0} - {6}
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS target", "2 AS n_tokens").repartition(3)
    out = ce.difference(docs, spark.createDataFrame(labels, "doc_id long, quality int"), most=most, tokens_per_part=per_part).collect()
    key = lambda r: (str(r[0]), r[1])
    got, want = sorted((tuple(r) for r in out), key=key), sorted(brute(rows, target), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2]
        assert g[2:4] == pytest.approx(w[2:], abs=2e-6) if w[1] else g[2:] == (None, None, None)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert ce.difference(docs.limit(0), none).count() == 0
    rows = ce.difference(docs, none).collect()
    assert rows[0]["loss_target"] == pytest.approx(math.log(3), abs=1e-5)


def test_same_as_sql_and_tells_target_documents(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    columns = ["doc_id", "n_tokens", "loss_target", "loss_background", "difference"]
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({ce.ORACLE})").fetchall())
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = sorted(tuple(r) for r in ce.difference(docs, labels).select(*columns).collect())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == pytest.approx(w, abs=1.5e-6)


def test_packing_of_numbers():
    for values in ([], [0], [1, 255, 256], [2**63, 2**64 - 1], list(range(1000))):
        array = np.array(values, dtype=np.uint64)
        assert (ce.unpack(ce.pack(array)) == array).all()
        assert (ce.unpack_keys(ce.pack_keys(np.sort(array))) == np.sort(array)).all()


def test_a_copy_outside_the_target_is_known_by_its_twin(spark):
    """What is counted grows with the corpus: a text of words that only its twin has is told among many others."""
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(50_000)}" for _ in range(200))) for i in range(400)]
    rows += [(1000 + k, " ".join(f"rare{k % 20}x{j}" for j in range(60))) for k in range(40)]
    labels = [(i, 1) for i in range(100)] + [(1000 + k, 1) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = {r["doc_id"]: r for r in ce.difference(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    for k in range(20, 40):
        assert out[1000 + k]["difference"] < -0.02 and out[1000 + k]["loss_target"] < 3
    assert min(out[i]["loss_target"] for i in range(400)) > 5
