from collections import Counter

import corpus_pipeline
import pyarrow as pa
from lathe.llm import langid, minhash, packing, tokens, toxicity

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").lower().split()
    n = minhash.SHINGLE
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)} - {()}


def brute(docs, labels):
    """The pipeline document by document: the fitted models applied row by row, all pairs compared, all tokens counted."""
    model = toxicity.fitted(docs, labels)
    rows = docs.collect()
    rows = [r for r in rows if not (toxicity.scores_of(pa.array([r["text"]], pa.string()), model)[0][0] >= model.threshold and (r["text"] or "").split())]
    spark = docs.sparkSession
    kept = spark.createDataFrame(rows, docs.schema)
    model = langid.fitted(kept)
    rows = [r for r in rows if langid.label_texts(pa.array([r["text"]], pa.string()), model)["keep"][0].as_py()]
    root = {r["doc_id"]: r["doc_id"] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(r["doc_id"], shingles(r["text"])) for r in rows]
    sure, maybe = set(), set()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and min(len(x), len(y)) >= minhash.THRESHOLD * max(len(x), len(y)):
                s = len(x & y) / len(x | y)
                if s >= minhash.THRESHOLD:
                    (sure if s >= 0.85 else maybe).add((a, b))
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    firsts = {d for d in root if find(d) == d}
    return rows, firsts, sure, maybe


def test_equals_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows, firsts, sure, maybe = brute(docs, labels)
    out = corpus_pipeline.run(spark, SF).collect()
    got = {r["doc_id"] for r in out}
    count = {r["doc_id"]: len(tokens.encode(tokens.byte_bpe(packing.VOCABULARY), r["text"])) for r in rows if r["text"]}
    # near the threshold a pair may stay apart; far above it none does
    assert firsts <= got and not any(a in got and b in got for a, b in sure)
    assert len(got - firsts) <= max(1, len(maybe) // 10)
    assert sum(r["n_tokens"] for r in out) == sum(count[d] for d in got)
    load = Counter()
    places: dict = {}
    for r in out:
        load[r["bin_id"]] += r["n_tokens"]
        places.setdefault(r["bin_id"], []).append((r["bin_offset"], r["n_tokens"]))
    assert max(load.values()) <= packing.CAPACITY
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "minhash_dedup", "best_fit_packing"]


def test_edges(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, keep int, id string"
    rows = [(1, None, None, None, None, 0, "a"), (2, "", "en", "s", 0, 0, "a"), (3, "some words are here", "en", "s", 1, 0, "a"), (3, "some words are here", "en", "s", 1, 0, "a"), (None, "words here are some", "en", "s", 1, 0, "b"), (4, "here words some are " * 10_000, "xx", "s", 1, 0, "b")]
    for name, part in (("all", rows), ("none", [])):
        (tmp_path / name).mkdir()
        spark.createDataFrame(part, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert Counter(r["doc_id"] for r in out if r["chunk"] == 0) == (Counter([3, None, 4]) if part else Counter())
