"""Operator 6, SimHash document fingerprints and search by permuted block tables.

Terms are lower-cased words; a word that occurs c times weighs the number of
binary digits of c, so that frequent words do not decide alone.  A term's
64-bit hash votes +weight or -weight on each bit, and a bit is set when its
votes are above zero.  Fingerprints are 64-bit two's complement longs.

Terms and radius are chosen by the distances of near copies (texts that share
0.65 or more of their word pairs): with these terms 0.7 of them differ in at
most ``RADIUS`` = 6 bits; with word pairs as terms the median is 10 bits and a
radius of 3 finds little but equal texts.

Search: the 64 bits are cut into blocks.  Two fingerprints within ``radius``
bits agree on at least ``blocks - radius`` blocks, so one table per choice of
that many blocks, keyed by their bits (the permutation that brings them to the
front), meets every such pair; a pair is reported by the first table that holds
it, which makes the search exact and free of a final distinct.  The number of
blocks follows the number of fingerprints (``blocks_for``), so that the keys
have enough bits to part unlike fingerprints; it changes no result.

Equal fingerprints are searched once however many documents have them.  The
result is one row per document: the class it is in (documents connected by
fingerprints within the radius) and the number of its links.

Defined results: a null or empty text has no fingerprint (null) and takes no
part in the search; rows with equal doc_id count as one document if their
fingerprints agree and as two if not; null doc_ids are left out; empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm import graph, textops
from lathe.storage import materialise

RADIUS = 6
LANES = np.uint64(0x0101010101010101)


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many of each run's hashes have bit b set: an array (runs, 64), bit 0 the lowest.

    Eight byte lanes are summed at once; runs are cut at 255 hashes so that no lane overflows.
    """
    counts = np.diff(starts)
    parts = -(-counts // 255)
    first = np.concatenate([[0], np.cumsum(parts)])
    within = np.arange(first[-1]) - np.repeat(first[:-1], parts)
    cuts = np.repeat(starts[:-1], parts) + 255 * within
    out = np.zeros((len(counts), 64), dtype=np.int64)
    some = np.flatnonzero(parts)
    if not len(some):
        return out
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & LANES, cuts)
        by_byte = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        out[np.ix_(some, np.arange(8) * 8 + shift)] = np.add.reduceat(by_byte, first[some], axis=0)
    return out


def fingerprints_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints as int64, whether the text has any term)."""
    ids, offsets, uniq = textops.words(texts)
    n = len(offsets) - 1
    if not len(ids):
        return np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    terms, counts = np.unique(owner * len(uniq) + ids, return_counts=True)
    weights = np.frexp(counts.astype(np.float64))[1].astype(np.int64)  # binary digits
    hashes = textops.mix(textops.word_hashes(uniq))[terms % len(uniq)]
    total = np.bincount(terms // len(uniq), weights=weights, minlength=n).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(total)])
    votes = 2 * bit_counts(np.repeat(hashes, weights), starts) - total[:, None]
    packed = np.packbits(votes > 0, axis=1, bitorder="little")
    return packed.view("<u8").reshape(-1).astype(np.uint64).view(np.int64), total > 0


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, some = fingerprints_of(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.int64(), mask=~some)], ["doc_id", "fp"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(textops.map_slices(run), "doc_id long, fp long")


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def block_masks(blocks: int) -> list[int]:
    """The bits of each block, the lowest first."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """The least number of blocks whose keys have about as many bits as ``n`` fingerprints need: tables are as few as
    keep the chance meetings of a table at a few for each fingerprint."""
    blocks = radius + 1
    while blocks < 64 and (blocks - radius) * 64 // blocks < n.bit_length() - 1:
        blocks += 1
    return blocks


def neighbours(fps: DataFrame, radius: int = RADIUS, blocks: int = 9) -> DataFrame:
    """All pairs fp_a < fp_b of a table of *distinct* fingerprints (fp) within ``radius`` bits, with ``distance``."""
    if not 0 <= radius < blocks:
        raise ValueError("radius must be below the number of blocks")
    parts = block_masks(blocks)
    chosen = list(combinations(range(blocks), blocks - radius))
    masks = F.array(*[F.lit(signed(sum(parts[i] for i in c))) for c in chosen])
    # rows are (fingerprint, table): the key is computed on either side of the shuffle and not sent
    # Spark takes their size for about that of ``fps``, not for as many times as there are tables: no side may be broadcast
    keyed = fps.select("fp", F.explode(F.array(*[F.lit(t).cast("short") for t in range(len(chosen))])).alias("_t"))
    a, b = (keyed.select(F.col("fp").alias(f"fp_{n}"), F.col("_t").alias(f"_t{n}")) for n in "ab")
    key = lambda n: F.col(f"fp_{n}").bitwiseAND(masks[F.col(f"_t{n}").cast("int")])
    differs = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    # the first table of a pair is that of its lowest agreeing blocks: no agreeing block lies among and outside them
    agree = sum((F.when(differs.bitwiseAND(F.lit(signed(m))) == 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, m in enumerate(parts)), F.lit(0).cast("long"))
    below = F.array(*[F.lit((2 << c[-1]) - 1).cast("long") for c in chosen])[F.col("_ta").cast("int")]
    own = F.array(*[F.lit(sum(1 << i for i in c)).cast("long") for c in chosen])[F.col("_ta").cast("int")]
    return (
        a.join(b.hint("merge"), (F.col("_ta") == F.col("_tb")) & (key("a") == key("b")) & (F.col("fp_a") < F.col("fp_b")) & (F.bit_count(differs) <= radius))
        .filter(agree.bitwiseAND(below) == own)
        .select("fp_a", "fp_b", F.bit_count(differs).alias("distance"))
    )


def near_fingerprints(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents whose fingerprint is equal to or near another's.

    Result: doc_id, fp, class_id (the least doc_id of all documents that are
    connected with this one), copies (documents with this fingerprint, itself
    included) and links (other fingerprints within ``radius``).
    """
    prints = materialise(fingerprint(docs).filter("fp IS NOT NULL AND doc_id IS NOT NULL").distinct(), "fingerprints")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "classes")
    pairs = materialise(neighbours(classes.select("fp"), radius, blocks_for(classes.count(), radius)), "neighbours")
    links = pairs.select(F.col("fp_a").alias("fp")).union(pairs.select("fp_b")).groupBy("fp").agg(F.count("*").alias("links"))
    parts = graph.components(pairs.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))).select(F.col("node").alias("fp"), "component")
    known = classes.join(parts, "fp", "left").join(links, "fp", "left").filter("component IS NOT NULL OR copies > 1")
    known = known.select("fp", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "fp").alias("part"))
    named = known.join(known.groupBy("part").agg(F.min("least").alias("class_id")), "part").select("fp", "class_id", "copies", "links")
    return prints.join(named, "fp").select("doc_id", "fp", "class_id", "copies", "links")


#: The same result in SQL: word hashes from MD5, all pairs compared.
ORACLE = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
terms AS (SELECT doc_id, r, w, length(bin(count(*))) AS weight FROM (SELECT doc_id, r, unnest(w) AS w FROM words) GROUP BY ALL),
hashed AS (SELECT doc_id, r, weight, ('0x' || left(md5(w), 16))::UBIGINT AS h FROM terms),
mixed1 AS (SELECT doc_id, r, weight, ((xor(h, h >> 32))::UHUGEINT * {textops.MIX}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT AS h FROM hashed),
mixed AS (SELECT doc_id, r, weight, xor(h, h >> 29) AS h FROM mixed1),
votes AS (
  SELECT doc_id, r, i, sum(weight * (2 * ((h >> i) & 1::UBIGINT)::BIGINT - 1)) AS v FROM mixed, (SELECT unnest(range(64))::UBIGINT AS i) GROUP BY ALL),
prints AS (
  SELECT DISTINCT doc_id, fp FROM (
    SELECT doc_id, r, sum(CASE WHEN v > 0 THEN CASE WHEN i = 63 THEN -9223372036854775808::HUGEINT ELSE (1::UBIGINT << i)::HUGEINT END ELSE 0 END)::BIGINT AS fp FROM votes GROUP BY doc_id, r)),
classes AS (SELECT fp, min(doc_id) AS least, count(*) AS copies FROM prints GROUP BY fp),
near AS (SELECT a.fp, b.fp AS other FROM classes a JOIN classes b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= {RADIUS}),
reached AS (SELECT fp, fp AS other FROM classes UNION SELECT r.fp, n.other FROM reached r JOIN near n ON n.fp = r.other),
named AS (SELECT r.fp, min(c.least) AS class_id FROM reached r JOIN classes c ON c.fp = r.other GROUP BY r.fp),
linked AS (SELECT fp, count(*) AS links FROM near GROUP BY fp)
SELECT p.doc_id, fp, n.class_id, c.copies, coalesce(l.links, 0) AS links
FROM prints p JOIN classes c USING (fp) JOIN named n USING (fp) LEFT JOIN linked l USING (fp) WHERE c.copies > 1 OR l.links > 0
"""
