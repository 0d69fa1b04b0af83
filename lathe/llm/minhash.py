"""Operator 7, MinHash near-duplicate groups with tensored banding.

A text is the set of its two-word shingles (lower case, white-space words; of
scripts without spaces every letter is a word).  Two collections of ``M`` bands
with ``B`` minhashes each are computed; table (i, j) is keyed by band i of the
first and band j of the second collection, so 2*M*B minhashes feed M*M tables
that plain banding would need 2*B*M*M for.  A pair of similarity s meets in
some table with probability (1 - (1 - s^B)^M)^2: 0.92 at 0.65, 0.97 at 0.7,
0.99 at 0.75 for the defaults.  Pairs of words are told apart well enough in
running text (unrelated texts stay below 0.3), and a text of which a tenth of
the words were replaced still reaches the threshold.

All candidates are verified by the exact Jaccard similarity of their shingle
sets, and groups are the connected components of verified pairs:

* texts that are equal word for word are one node, named by the 64-bit hash of
  the text (two of ten billion different texts share one with a chance of 0.9);
* within a slice of texts, which one task holds, only the least member of a
  bucket is sent on for the others, so a bucket that holds a third of all rows
  arrives as one row per slice;
* round 1 verifies each member of a bucket against the least one of its slice
  and that one against the least of all: one pair per member however large the
  bucket;
* round 2 verifies the pairs of a bucket whose members are not connected yet;
  pairs within the bucket's largest part are not even formed.  A pair left out
  is connected already, so the groups are those of verifying all candidate
  pairs; nothing is capped.

Defined results: a null or blank text and a null doc_id are in no group; texts
below two words are one shingle; equal doc_ids with the same text are one
document, with different texts two nodes of that name; the member kept is the
least doc_id of its group; empty tables give empty results; other columns are
ignored by ``groups`` and passed through by ``deduplicate``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.llm import bloom, graph, textops
from lathe.storage import discard, materialise

SHINGLE = 2
M = 10
B = 3
THRESHOLD = 0.65


def hash_parameters(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda: rng.integers(0, 2**64, size=n, dtype=np.uint64)
    return draw() | np.uint64(1), draw()


def minhashes(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Array (runs, n) of minima under n multiply-add hashes; runs must not be empty."""
    a, b = hash_parameters(n)
    out = np.empty((len(starts) - 1, n), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out[:, i] = np.minimum.reduceat(hashes * a[i] + b[i], starts[:-1])
    return out


def table_keys(mins: np.ndarray, m: int = M, b: int = B) -> np.ndarray:
    """Array (texts, m*m) of table keys; the table's number is part of the key."""
    with np.errstate(over="ignore"):
        bands = np.zeros((len(mins), 2 * m), dtype=np.uint64)
        for k in range(b):
            bands = textops.mix(bands * np.uint64(textops.MULTIPLIERS[0]) + mins[:, k * 2 * m : (k + 1) * 2 * m])
        left, right = bands[:, :m, None] * np.uint64(textops.MULTIPLIERS[1]), bands[:, None, m:] * np.uint64(textops.MULTIPLIERS[2])
        table = np.arange(m * m, dtype=np.uint64).reshape(1, m, m) * np.uint64(textops.MULTIPLIERS[3])
        return textops.mix(left + right + table).reshape(len(mins), m * m)


FEATURES = "id long, keys array<long>, local array<struct<key: long, head: long>>, shingles binary"


def features(texts: DataFrame, m: int = M, b: int = B, shingle: int = SHINGLE) -> DataFrame:
    """What is known of every text (id, text), once for each slice that has it.

    ``shingles`` are the sorted distinct 32-bit shingle hashes as bytes; ``keys``
    the table keys of which this text has the least id in its slice, ``local``
    its other keys with that least id.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        once = np.unique(batch.column("id").to_numpy(), return_index=True)[1]
        if len(once) < batch.num_rows:
            batch = batch.take(pa.array(np.sort(once)))
        ids, offsets, uniq = textops.units(*textops.words(batch.column("text")))
        keep = np.diff(offsets) > 0
        hashes, starts = textops.shingle_hashes(ids, offsets, textops.word_hashes(uniq), shingle) if len(ids) else (np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
        starts = np.concatenate([starts[:-1][keep], starts[-1:]])
        n = int(keep.sum())
        names = batch.column("id").to_numpy()[keep]
        keys = table_keys(minhashes(hashes, starts, 2 * m * b), m, b).reshape(-1) if n else np.zeros(0, np.uint64)
        owner = np.repeat(names, m * m)
        order = np.lexsort((owner, keys))
        first = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])[: len(order)]
        head, sent = np.empty_like(owner), np.empty(len(owner), bool)
        head[order] = owner[order][np.flatnonzero(first)][np.cumsum(first) - 1] if n else owner
        sent[order] = first
        signed = keys.view(np.int64)
        bounds = lambda chosen: np.concatenate([[0], np.cumsum(chosen.reshape(n, m * m).sum(axis=1))]).astype(np.int32)
        fields = [pa.field("key", pa.int64()), pa.field("head", pa.int64())]
        local = pa.ListArray.from_arrays(pa.array(bounds(~sent)), pa.StructArray.from_arrays([pa.array(signed[~sent]), pa.array(head[~sent])], fields=fields))
        # sort within runs: the run number in the upper half
        if len(hashes):
            order = np.sort((np.repeat(np.arange(n, dtype=np.uint64), np.diff(starts)) << np.uint64(32)) | (hashes >> np.uint64(32)))
            order = order[np.concatenate([[True], order[1:] != order[:-1]])]
            cut = np.searchsorted(order, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
            raw = (order & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()
        else:
            cut, raw = np.zeros(1, np.int64), b""
        binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((cut * 4).astype(np.int32)), pa.py_buffer(raw)])
        return pa.RecordBatch.from_arrays([pa.array(names), textops.ragged(signed[sent], bounds(sent), pa.int64()), local, binary], ["id", "keys", "local", "shingles"])

    return texts.select("id", "text").mapInArrow(textops.map_slices(run), FEATURES)


def jaccard(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Exact Jaccard similarities of pairs of sorted distinct 32-bit hash sets."""
    out = np.empty(len(left))
    for i, (x, y) in enumerate(zip(left, right)):
        a, b = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
        if len(a) > len(b):
            a, b = b, a
        at = np.searchsorted(b, a)
        common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
        out[i] = common / (len(a) + len(b) - common)
    return out


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are similar to at least ``threshold``."""

    def run(batches):
        for batch in textops.slices(batches, "_x"):
            good = jaccard(batch.column("_x").to_pylist(), batch.column("_y").to_pylist()) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("a", "b")], ["a", "b"])

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("_x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("_y")), "b")
    # sets of too different sizes cannot reach the threshold
    x, y = F.octet_length("_x"), F.octet_length("_y")
    return both.filter((x >= y * threshold) & (y >= x * threshold)).select("a", "b", "_x", "_y").mapInArrow(run, "a long, b long")


def similar_parts(texts: DataFrame, threshold: float = THRESHOLD, m: int = M, b: int = B, shingle: int = SHINGLE) -> DataFrame:
    """(node, component) of the texts (id, text) that are similar to another text; rows of one id have one text."""
    known = materialise(features(texts, m, b, shingle), "shingles")
    per_key = Window.partitionBy("key")
    sent = known.select("id", F.explode("keys").alias("key")).withColumn("head", F.min("id").over(per_key)).withColumn("_last", F.max("id").over(per_key))
    met = sent.filter("head <> _last").select("key", "id", "head")
    buckets = materialise(met.unionByName(known.select("id", F.inline("local"))), "buckets")
    stars = materialise(buckets.filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    wanted = stars.select(F.col("a").alias("id")).union(stars.select("b")).distinct()
    sets = materialise(bloom.semi_join(known.select("id", "shingles"), wanted, "id").dropDuplicates(["id"]), "candidates")
    discard(known)
    first = materialise(verified(stars, sets, threshold), "similar")
    parts = graph.components(first)
    members = buckets.select("key", "id").union(buckets.select("key", F.col("head").alias("id"))).distinct()
    named = members.join(parts.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("part"))
    sizes = named.groupBy("key", "part").agg(F.count("*").alias("n"))
    spread = sizes.groupBy("key").agg(F.min("part").alias("_lo"), F.max("part").alias("_hi"), F.max_by("part", F.struct("n", "part")).alias("main")).filter("_lo <> _hi")
    loose = named.join(spread.select("key", "main"), "key")
    left = loose.filter("part <> main").select("key", F.col("id").alias("x"), F.col("part").alias("_px"))
    right = loose.select("key", F.col("id").alias("y"), F.col("part").alias("_py"), "main")
    rest = left.join(right, "key").filter("_px <> _py AND (_py = main OR x < y)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    second = materialise(verified(rest, sets, threshold), "similar")
    found = parts if second.isEmpty() else graph.components(first.union(second))
    for done in (buckets, stars, sets, first, second, *([] if found is parts else [parts])):
        discard(done)
    return found


def not_blank() -> Column:
    return F.col("text").rlike(r"[^ \t\n\x0B\f\r]")


def member_parts(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(text_key, doc_id, part) of all members of groups, and (id, doc_id, rows) of all texts.

    A part is named by a text key (64-bit hash of a text).
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = slim.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & not_blank()).select(F.xxhash64("text").alias("id"), "doc_id", "text")
    pairs = materialise(texts.groupBy("id", "doc_id").agg(F.count("*").alias("rows")), "copies")
    parts = similar_parts(texts, threshold)
    copied = pairs.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit(True).alias("_copied"))
    joined = pairs.join(parts.withColumnRenamed("node", "id"), "id", "left").join(copied, "id", "left")
    return joined.filter("component IS NOT NULL OR _copied").select(F.col("id").alias("text_key"), "doc_id", F.coalesce("component", "id").alias("part")), pairs


def groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Members of near-duplicate groups, one row each: group_id (the least doc_id of the group, the one to keep), doc_id,
    size (members of the group).  Only groups of two or more; a doc_id that has several texts is in every group that
    one of them is in."""
    members = materialise(member_parts(docs, threshold)[0].select("part", "doc_id").distinct(), "members")
    sizes = members.groupBy("part").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("size")).filter("size > 1")
    return members.join(sizes, "part").select("group_id", "doc_id", "size")


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without all but one document of each group.

    Rows outside any group stay, among them those with null doc_id or blank
    text.  Of rows with the same doc_id and text one stays.

    Texts are not shuffled for it but those of rows that a Bloom filter of
    (doc_id, text) takes for removed or repeated; an exact join decides these.
    """
    members, texts = member_parts(docs, threshold)
    # the least doc_id of a part, and of its texts the least key; by aggregation, for a part may hold a third of all rows
    least = members.groupBy("part").agg(F.min(F.struct("doc_id", "text_key")).alias("_kept"))
    gone = members.join(least, "part").filter(F.struct("doc_id", "text_key") != F.col("_kept")).select(F.col("doc_id").alias("_lathe_doc"), F.col("text_key").alias("_lathe_text"))
    gone = materialise(gone, "duplicates")
    repeated = texts.filter("rows > 1").select(F.col("doc_id").alias("_lathe_doc"), F.col("id").alias("_lathe_text"))
    both = F.xxhash64("_lathe_doc", "_lathe_text")
    shared = bloom.build(gone.union(repeated).select(both.alias("key")))
    named = docs.withColumns({"_lathe_doc": F.col("doc_id").cast("long"), "_lathe_text": F.xxhash64(F.col("text").cast("string"))})
    doubtful = F.coalesce(bloom.may_hold(shared, both) & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & not_blank(), F.lit(False))
    decided = named.filter(doubtful).dropDuplicates(["_lathe_doc", "_lathe_text"]).join(gone, ["_lathe_doc", "_lathe_text"], "left_anti")
    return named.filter(~doubtful).unionByName(decided).select(*[f"`{c}`" for c in docs.columns])
