import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lathe.llm import ordering, tokens

ENCODING = tokens.byte_bpe(ordering.VOCABULARY)
END = tokens.END_OF_TEXT


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \n\tab1'.é　 \u0085s▁中", max_size=30)), max_size=5))
def test_pieces_give_the_same_ids(texts):
    ids, bounds = tokens.encode_column(ENCODING, pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == (ENCODING.encode_ordinary(t) if t else [])


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    for key in (0, 7, 1 << 63):
        f = ordering.Feistel(n, key)
        slots = f.slot(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n)) and f.number(slots).tolist() == list(range(n))
    if n > 100:
        assert (ordering.Feistel(n, 1).slot(np.arange(n)) != ordering.Feistel(n, 2).slot(np.arange(n))).mean() > 0.9
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.2


def test_cutter_equals_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        length = rng.choice([1, 4, 7])
        docs = [(i, [rng.randint(0, 99) for _ in range(rng.choice([0, 1, 3, 4, 15]))]) for i in range(rng.randint(0, 12))]
        cutter, data, spans = ordering.Cutter(length, 999), [], []
        at = 0
        while at < len(docs):
            part = docs[at : at + rng.randint(1, 4)]
            at += len(part)
            a, b = cutter.add([d for d, _ in part], np.array([x for _, t in part for x in t], dtype=np.int32), np.cumsum([0, *(len(t) for _, t in part)]))
            data, spans = data + a, spans + b
        a, b, _ = cutter.last()
        data, spans = data + a, spans + b
        stream = [(d, k, x) for d, t in docs if t for k, x in enumerate([*t, 999])]
        want_data, want_spans = [], []
        for i in range(0, len(stream), length):
            part = stream[i : i + length]
            want_data.append([x for _, _, x in part] + [999] * (length - len(part)))
            want_spans.append([(d, j, k) for j, (d, k, _) in enumerate(part) if j == 0 or part[j - 1][0] != d])
        assert [np.frombuffer(x, "<u2").tolist() for x in data] == want_data
        assert spans == want_spans


def test_every_sequence_has_its_slot(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["some", "words", "häuser", "x"]) for _ in range(rng.randint(0, 60))), 1) for i in range(80)]
    rows += [(80, None, 1), (81, "", 1), (None, "no name", 1), (5, rows[5][1], 1), (82, "long " * 30_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(5)
    options = {"length": 64, "per_shard": 32, "key": 9}
    found = ordering.shards(docs, **options)
    manifest = ordering.write_shards(found, tmp_path.as_uri()).collect()
    kept = sorted(found.collect(), key=lambda r: r["shard"])
    total = sum(r["n_sequences"] for r in kept)
    assert [r["first_slot"] for r in kept] == [32 * i for i in range(len(kept))] and all(r["n_sequences"] == 32 for r in kept[:-1])
    assert all(zlib.crc32(r["payload"]) == r["crc32"] and len(r["payload"]) == r["n_sequences"] * 128 and r["stride"] == 128 and len(r["spans"]) == r["n_sequences"] for r in kept)
    assert sorted((m["shard"], m["crc32"]) for m in manifest) == [(r["shard"], r["crc32"]) for r in kept]
    # the documents can be put together again
    texts: dict = {}
    for r in kept:
        block = np.frombuffer(r["payload"], "<u2").reshape(-1, 64)
        for ids, own in zip(block, r["spans"]):
            for k, s in enumerate(own):
                end = own[k + 1]["at"] if k + 1 < len(own) else 64
                texts.setdefault(s["doc_id"], []).append((s["first"], ids[s["at"] : end].tolist()))
    want: dict = {}
    for d, t, _ in rows:
        if t:
            want.setdefault(d, []).append([*ENCODING.encode_ordinary(t), END])
    assert set(texts) == set(want)
    for d, parts in texts.items():
        if len(want[d]) == 1:
            ids = [x for _, p in sorted(parts) for x in p]
            n = len(want[d][0])
            assert ids[:n] == want[d][0] and set(ids[n:]) <= {END}
    # reading from any slot
    whole = np.concatenate([np.frombuffer(r["payload"], "<u2").reshape(-1, 64) for r in kept])
    for slot in (0, 31, 32, 50, total - 1, total):
        got = list(ordering.read_from(tmp_path.as_uri(), slot, 64, 32))
        assert len(got) == total - slot and all((a == b).all() for a, b in zip(got, whole[slot:]))
    # slots are the permutation of (task, place)
    seq = sorted((r["task"], r["place"], bytes(r["data"])) for r in ordering.sequences(docs, 64).collect())
    slots = ordering.Feistel(total, 9).slot(np.arange(total))
    assert all(whole[s].tobytes() == x for s, (_, _, x) in zip(slots, seq))


def test_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert ordering.shards(docs).count() == 0 and ordering.shards(docs.limit(0)).count() == 0


def test_ids_beyond_two_bytes(spark, tmp_path):
    """An end of text above 65,535 gives four bytes an id, and the same sequences."""
    docs = spark.createDataFrame([(i, f"some words of document {i}") for i in range(30)], "doc_id long, text string").coalesce(2)
    assert ordering.id_type(ordering.VOCABULARY, END) == "<u2" and ordering.id_type(ordering.VOCABULARY, 70_000) == "<u4"
    read = {}
    for end, kind in ((END, "<u2"), (70_000, "<u4")):
        rows = ordering.shards(docs, length=16, per_shard=4, end=end)
        assert {r["stride"] for r in rows.collect()} == {16 * int(kind[-1])}
        ordering.write_shards(rows, f"{tmp_path}/{end}").collect()
        read[end] = [s.tolist() for s in ordering.read_from(f"{tmp_path}/{end}", 3, 16, 4, kind)]
    assert read[70_000] == [[70_000 if x == END else x for x in s] for s in read[END]] and len(read[END]) > 4


def test_columns_of_other_types(spark):
    docs = spark.sql("SELECT CAST('7' AS string) AS doc_id, 'a b c' AS text, 1L AS slot, 2 AS part, 'x' AS data")
    row = ordering.shards(docs, length=8).collect()[0]
    assert row["n_sequences"] == 1 and row["spans"][0][0]["doc_id"] == 7
