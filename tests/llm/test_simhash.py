import random
from collections import Counter

import duckdb
import hashlib
import pytest
import pyarrow as pa

from lathe.llm import simhash, textops

M = (1 << 64) - 1


def brute(text):
    w = [x for x in (text or "").lower().split() if x]
    if not w:
        return None
    votes = [0] * 64
    for t, c in Counter(w).items():
        h, n = int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "big"), c.bit_length()
        h ^= h >> 32
        h = h * textops.MIX & M
        h ^= h >> 29
        for b in range(64):
            votes[b] += n if h >> b & 1 else -n
    fp = sum(1 << b for b in range(64) if votes[b] > 0)
    return fp - (1 << 64) if fp >> 63 else fp


def test_fingerprints_equal_brute_force():
    rng = random.Random(1)
    texts = [None, "", "  ", "one", "One", "two words"] + [" ".join(rng.choice("ab cd ef gh ij the of é".split()) for _ in range(rng.choice([3, 40, 256, 257, 1200]))) for _ in range(30)]
    values, some = simhash.fingerprints_of(pa.array(texts))
    assert [int(v) if s else None for v, s in zip(values, some)] == [brute(t) for t in texts]


@pytest.mark.parametrize("radius,blocks", [(0, 1), (0, 2), (1, 4), (3, 6), (6, 7), (6, 9), (6, 10)])
def test_search_is_exact(spark, radius, blocks):
    rng = random.Random(radius)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(6):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 8)):
                x ^= 1 << b
            fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = sorted((a, b, ((a ^ b) & M).bit_count()) for a in signed for b in signed if a < b and ((a ^ b) & M).bit_count() <= radius)
    got = sorted(tuple(r) for r in simhash.neighbours(spark.createDataFrame([(f,) for f in signed], "fp long"), radius, blocks).collect())
    assert got == want


def test_search_sends_no_table_to_the_driver(spark):
    """The tables of the search are many times the fingerprints, which Spark's estimate for a broadcast does not see."""
    found = simhash.neighbours(spark.range(500).selectExpr("xxhash64(id) AS fp"))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_blocks_follow_the_number_of_fingerprints():
    found = [simhash.blocks_for(n) for n in (0, 1, 1_000, 235_000, 10**7, 10**9, 10**10)]
    assert found == sorted(found) and found[0] == 7 and found[3] == 9
    assert all((b - simhash.RADIUS) * 64 // b >= n.bit_length() - 1 for b, n in zip(found[1:], (1, 1_000, 235_000, 10**7, 10**9, 10**10)))


def test_rows_and_edges(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(1, text, 0), (2, text, 0), (2, text, 0), (3, text + " more", 0), (4, None, 0), (5, "", 0), (None, text, 0), (6, "alone here", 0), (7, "x " * 60_000, 0), (2, "another text of document two", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r["doc_id"], r["class_id"], r["copies"], r["links"]) for r in simhash.near_fingerprints(docs).collect())
    assert got == [(1, 1, 2, 1), (2, 1, 2, 1), (3, 1, 1, 1)]
    assert simhash.near_fingerprints(docs.limit(0)).count() == 0


def test_columns_of_other_types(spark):
    docs = spark.createDataFrame([("1", "a b c"), ("2", "a b c"), ("x", "a b c")], "doc_id string, text string").selectExpr("try_cast(doc_id AS int) AS doc_id", "text")
    assert sorted((r["doc_id"], r["class_id"], r["copies"]) for r in simhash.near_fingerprints(docs).collect()) == [(1, 1, 2), (2, 1, 2)]


def test_edited_copies_are_found():
    """Copies with words replaced: most are within the radius while unlike texts are not."""
    rng = random.Random(5)
    common, rare = [f"c{i}" for i in range(60)], [f"r{i}" for i in range(20_000)]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else rng.choice(rare)
    texts, copies = [], []
    for _ in range(200):
        w = [word() for _ in range(250)]
        texts.append(" ".join(w))
        for i in rng.sample(range(250), 8):
            w[i] = word()
        copies.append(" ".join(w))
    values = simhash.fingerprints_of(pa.array(texts + copies))[0]
    far = lambda a, b: ((int(values[a]) ^ int(values[b])) & M).bit_count()
    assert sum(far(i, 200 + i) <= simhash.RADIUS for i in range(200)) >= 140
    assert not any(far(i, j) <= simhash.RADIUS for i in range(200) for j in range(i))


def test_recall_of_near_copies_of_the_test_table(spark):
    """Of the pairs of sf0.01 that share 0.65 of their word pairs, most are within the radius."""
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    sets = {}
    for d, t in rows.items():
        w = t.lower().split()
        if len(w) >= 20:
            sets[d] = set(zip(w, w[1:]))
    values = dict(zip(rows, simhash.fingerprints_of(pa.array(list(rows.values())))[0].tolist()))
    names = sorted(sets)
    near = [(a, b) for i, a in enumerate(names) for b in names[:i] if rows[a] != rows[b] and 0.65 * len(sets[a]) <= len(sets[b]) <= len(sets[a]) / 0.65 and len(sets[a] & sets[b]) >= 0.65 * len(sets[a] | sets[b])]
    found = sum(((values[a] ^ values[b]) & M).bit_count() <= simhash.RADIUS for a, b in near)
    assert len(near) >= 10 and found >= 0.6 * len(near)


def test_same_as_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    columns = "doc_id, fp, class_id, copies, links"
    want = sorted(con.execute(f"SELECT {columns} FROM ({simhash.ORACLE})").fetchall())
    got = sorted(tuple(r) for r in simhash.near_fingerprints(spark.read.parquet(f"{d}/documents.parquet")).select(*columns.split(", ")).collect())
    assert got == want
