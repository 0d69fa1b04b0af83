import random
from collections import Counter

import pytest

from lathe.llm import packing


def naive_best_fit(lengths, capacity):
    rooms = []
    for w in sorted(lengths, reverse=True):
        fitting = [(r, i) for i, r in enumerate(rooms) if r >= w]
        if fitting:
            rooms[min(fitting)[1]] -= w
        else:
            rooms.append(capacity - w)
    return sorted(rooms)


def optimum(lengths, capacity):
    """Fewest bins, by search."""
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        seen = set()
        for k, r in enumerate(rooms):
            if r >= items[i] and r not in seen:
                seen.add(r)
                rooms[k] -= items[i]
                go(i + 1, rooms)
                rooms[k] += items[i]
        rooms.append(capacity - items[i])
        go(i + 1, rooms)
        rooms.pop()

    items = sorted(lengths, reverse=True)
    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_bulk_best_fit_equals_one_by_one(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 37, 100])
    items = [rng.randint(1, cap) for _ in range(rng.randint(0, 120))]
    plan = packing.Plan(cap)
    packing.best_fit(Counter(items), cap, plan)
    rooms = sorted(r for n, content, _ in plan.groups for r in [cap - sum(w * k for w, k in content)] * n)
    assert rooms == naive_best_fit(items, cap)


@pytest.mark.parametrize("seed", range(150))
def test_reduction_keeps_the_optimum(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 20, 31])
    items = [rng.randint(max(1, cap // rng.choice([3, 4, 10])), cap) for _ in range(rng.randint(1, 10))]
    plan = packing.Plan(cap)
    left = packing.reduce_instance(Counter(items), cap, plan)
    rest = [w for w, c in left.items() for _ in range(c)]
    assert plan.bins + optimum(rest, cap) == optimum(items, cap)
    used = Counter(rest)
    for n, content, _ in plan.groups:
        assert sum(w * k for w, k in content) <= cap
        for w, k in content:
            used[w] += n * k
    assert used == Counter(items)


def test_reduction_fixes_each_kind():
    plan = packing.Plan(100)
    packing.reduce_instance({95: 3, 60: 2, 40: 2, 9: 1}, 100, plan)
    assert {r for _, _, r in plan.groups} >= {"alone", "pair"}


def check_packed(rows, lengths, cap):
    by_bin = {}
    for r in rows:
        by_bin.setdefault(r["bin_id"], []).append((r["bin_offset"], r["n_tokens"]))
    for spans in by_bin.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= cap
    total = Counter()
    for r in rows:
        total[r["doc_id"]] += r["n_tokens"]
    want = Counter()
    for d, n in lengths:
        want[d] += n
    assert +total == +want
    return len(by_bin)


def test_pack_lengths_places_everything_once(spark):
    rng = random.Random(5)
    lengths = [(i, rng.choice([0, 1, 7, 30, 64, 65, 200, rng.randint(1, 300)])) for i in range(700)] + [(3, 17), (3, 17), (None, 9)]
    rows = packing.pack_lengths(spark.createDataFrame(lengths, "doc_id long, n_tokens long"), 64).collect()
    bins = check_packed(rows, lengths, 64)
    assert bins * 64 < 1.02 * sum(n for _, n in lengths) + 64
    assert {r["bin_id"] for r in rows} == set(range(bins))


def test_full_chunks_and_equal_lengths_over_many_tasks(spark):
    """A third of all rows is one document, another third fills whole sequences."""
    lengths = [(1, 40)] * 200 + [(i, 128) for i in range(200)] + [(i, 64 * (i % 3) + i % 7) for i in range(200)]
    for slices in (1, 5):
        rows = packing.pack_lengths(spark.createDataFrame(lengths, "doc_id long, n_tokens long").repartition(slices), 64).collect()
        bins = check_packed(rows, lengths, 64)
        assert {r["bin_id"] for r in rows} == set(range(bins))
        assert sum(r["n_tokens"] == 64 for r in rows) == 400 + sum(i % 3 for i in range(200)) and all(r["rule"] == "alone" for r in rows if r["n_tokens"] == 64)


def test_columns_of_other_types(spark):
    docs = spark.sql("SELECT CAST('7' AS string) AS doc_id, 'a b c' AS text, 1L AS rank, 2 AS task")
    assert [r["doc_id"] for r in packing.pack(docs).collect()] == [7]


def test_edge_rows(spark):
    long = "word " * 30_000
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, long, None), (4, "a b", "y"), (4, "a b", "y"), (None, "c", "y")], "doc_id long, text string, bin_id string")
    rows = packing.pack(docs).collect()
    assert {r["doc_id"] for r in rows} == {3, 4, None}
    check_packed(rows, [(r["doc_id"], r["n_tokens"]) for r in packing.token_counts(docs).collect()], packing.CAPACITY)
    assert packing.pack(docs.limit(0)).count() == 0
