import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lathe.llm import licenses

SMALL = {"x": "alpha beta gamma delta", "y": "alpha beta", "z": "one two three four five six seven eight nine ten"}


def brute(text, templates, threshold):
    lines = (text or "").split("\n")
    sets = [set(licenses.tokens_of(x)) for x in lines]
    blocks = [("line", i, 1, s) for i, s in enumerate(sets) if s]
    i = 0
    while i < len(lines):
        j = i
        while j < len(lines) and sets[j]:
            j += 1
        if j - i > 1:
            blocks.append(("paragraph", i, j - i, set().union(*sets[i:j])))
        i = max(j, i + 1)
    out = []
    for kind, first, n, s in blocks:
        for name, t in templates.items():
            ts = set(licenses.tokens_of(t))
            if len(ts & s) >= threshold * len(ts) - 1e-9:
                out.append((kind, first, n, name, len(ts & s)))
    return sorted(out)


def random_text(rng):
    words = "alpha beta gamma delta one two three four five six seven eight nine ten the of x".split()
    return "\n".join(" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 8, 25]))) for _ in range(rng.randint(0, 6)))


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_join_equals_brute_force(threshold):
    rng = random.Random(5)
    texts = [random_text(rng) for _ in range(150)] + ["", None, "ALPHA, Beta!\n\nbeta_alpha"]
    index = licenses.Index(SMALL, {w: rng.randint(0, 9) for w in "alpha beta one seven ten".split()}, threshold)
    m = licenses.scan_texts(pa.array(texts), index)
    got = {}
    for i in range(len(m["row"])):
        got.setdefault(int(m["row"][i]), []).append((m["kind"][i], int(m["first_line"][i]), int(m["n_lines"][i]), index.names[m["template"][i]], int(m["overlap"][i])))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == brute(t, SMALL, threshold), t


def test_frequencies_cover_all_rows(spark):
    docs = spark.createDataFrame([(1, "a b\na"), (2, "a c"), (3, None), (4, "")], "doc_id long, text string").repartition(3)
    assert licenses.frequencies(docs, ["a", "b", "zz"]) == {"a": 3, "b": 1}


def test_rows_and_edges(spark):
    line = "Released under the MIT License."
    rows = [(1, line, "x"), (1, line, "x"), (None, "intro\n" + line, "y"), (2, None, "z"), (3, "", "z"), (4, "word " * 90_000 + "\n\n" + line.upper(), "z"), (5, "released under a mat lie", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = [(r["doc_id"], r["kind"], r["first_line"], r["n_lines"], r["license"]) for r in licenses.scan(docs).collect()]
    key = lambda r: tuple(map(str, r))
    want = [(1, "line", 0, 1, "mit-line")] * 2 + [(None, "line", 1, 1, "mit-line"), (None, "paragraph", 0, 2, "mit-line"), (4, "line", 2, 1, "mit-line")]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert licenses.scan(docs.limit(0)).count() == 0 and licenses.scan(docs, {}).count() == 0


def test_same_as_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    columns = ["doc_id", "kind", "first_line", "n_lines", "license", "overlap", "containment"]
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({licenses.ORACLE})").fetchall())
    got = sorted(tuple(r) for r in licenses.scan(spark.read.parquet(path)).select(*columns).collect())
    assert got == want and len(got) > 3 and np.isfinite(got[0][-1])
