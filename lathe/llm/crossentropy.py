"""Operator 9, cross-entropy difference of two n-gram language models.

Target model: documents labelled quality 1.  Background model: all documents.
Both are interpolated bigram models of the same order, smoothing and
vocabulary (matched), with exact counts over every document of the corpus:

* a word (lower case, white-space separated) is named by the first 64 bits of
  its MD5, a bigram by a 64-bit mix of the names of its words; the vocabulary
  that both models share is all ``V`` distinct words of the corpus;
* p(w) = (c(w) + 1/2) / (N + V/2), p(w | v) = (c(v w) + MU p(w)) / (c(v) + MU).

A document is scored without itself (its own counts are taken off the models
that hold it), else a model would recognise its members by their rare bigrams.
The score is the mean over its tokens of target loss minus background loss, in
nats; the lower, the more the document is like the target.

How the counts meet the documents, with nothing collected or broadcast that
grows with the corpus but the checked list of target ids:

1. texts are coded once, in slices of ``SLICE`` bytes: the slice's distinct
   words and the rank of every token among them, written to the shared folder;
2. a slice adds up its own bigrams and words and sends them as sorted keys with
   two counts, one block for each of ``2**bits`` ranges of the key; the number
   of ranges follows the number of tokens (``TOKENS_PER_PART``);
3. a range adds up the blocks of all slices, a key at most once a slice however
   frequent, and answers every block with the totals of its keys, in its order;
4. slices and answers meet by slice, where each document is scored.

Keys are sent as differences and counts in byte planes, so a key costs about
six bytes and a total about one.

Defined results: a null or blank text has n_tokens 0 and null losses; equal rows
count as often as they occur and get equal results; labels that are null,
missing or contradictory for a doc_id do not make a target document; a null
doc_id is background and scored; without any target document the target model
is uniform; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm import textops
from lathe.storage import materialise

MU = 4.0
#: Up to so many target ids (32 MB) are sent to the executors; more are joined.
MOST_IDS = 4_000_000
SLICE = 8_000_000
#: Tokens of the corpus for each range of keys: the size of a task, not of the result.
TOKENS_PER_PART = 1 << 21
DIGITS = 6
#: The name of what stands before a first word; no word's MD5 begins with 64 zero bits.
BEFORE = np.uint64(0)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers in the least number of byte planes, that number first."""
    v = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, -(-int(v.max(initial=0)).bit_length() // 8))
    return bytes([width]) + v.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def targets(docs: DataFrame, labels: DataFrame, most: int = MOST_IDS):
    """(doc_id, text) with a column ``target`` if there are too many target ids to send; else those ids, sorted, too."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    good = (
        labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("_least")).filter("_least = 1").select("doc_id")
    )
    # the least of a contradictory doc_id is 0
    if good.count() <= most:
        ids = np.sort(good.toArrow().column("doc_id").to_numpy())
        return slim, docs.sparkSession.sparkContext.broadcast(ids)
    return slim.join(good.withColumn("target", F.lit(True)), "doc_id", "left"), None


def is_target(batch: pa.RecordBatch, shared) -> np.ndarray:
    if shared is None:
        return batch.column("target").fill_null(False).to_numpy(zero_copy_only=False)
    ids = shared.value
    own = batch.column("doc_id")
    values = own.fill_null(0).to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(ids, values), max(len(ids) - 1, 0))
    return (ids[at] == values) & own.is_valid().to_numpy(zero_copy_only=False) if len(ids) else np.zeros(len(values), bool)


CODED = "slice long, docs array<long>, target binary, lengths binary, words binary, tokens binary, n_tokens long, n_target long"


def code(docs: DataFrame, shared) -> DataFrame:
    """One row per slice of texts: what is known of its documents, its words' names in order, and each token's rank."""

    def run(batches):
        first = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(textops.slices(batches, limit=SLICE)):
            ids, offsets, uniq = textops.words(batch.column("text"))
            # the splitter's empty word is in no text
            names, rank = np.unique(textops.word_hashes(uniq), return_inverse=True)
            present = np.bincount(rank[ids], minlength=len(names)) > 0
            names, rank = names[present], (np.cumsum(present) - 1)[rank]
            lengths, wanted = np.diff(offsets), is_target(batch, shared)
            row = [first + k, batch.column("doc_id").to_pylist(), pack(wanted), pack(lengths), pack_keys(names), pack(rank[ids]), len(ids), int(lengths[wanted].sum())]
            kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], ["slice", "docs", "target", "lengths", "words", "tokens", "n_tokens", "n_target"])
        textops.release()

    return docs.mapInArrow(run, CODED)


class Slice:
    """The tokens of a slice as places among its words (0 is ``BEFORE``) and among its bigrams, both in the order of their keys."""

    def __init__(self, target: bytes, lengths: bytes, words: bytes, tokens: bytes):
        self.target, self.lengths = unpack(target).astype(bool), unpack(lengths).astype(np.int64)
        self.words = np.concatenate([[BEFORE], unpack_keys(words)])
        self.now = unpack(tokens).astype(np.int64) + 1
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.before = np.empty_like(self.now)
        self.before[1:] = self.now[:-1]
        self.before[self.offsets[:-1][self.lengths > 0]] = 0
        with np.errstate(over="ignore"):
            m = [np.uint64(x) for x in textops.MULTIPLIERS]
            keys = textops.mix((self.words * m[0] + m[2])[self.before] + (self.words * m[1])[self.now])
        self.bigrams, self.pair = np.unique(keys, return_inverse=True)

    def counts(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(keys, target count, count) of words and of bigrams."""
        token = np.repeat(self.target, self.lengths)
        out = []
        for keys, at in ((self.words, self.now), (self.bigrams, self.pair)):
            out.append((keys, np.bincount(at[token], minlength=len(keys)), np.bincount(at, minlength=len(keys))))
        some = self.lengths > 0
        out[0][1][0], out[0][2][0] = int((some & self.target).sum()), int(some.sum())
        return out


_KINDS = ("words", "bigrams")
BLOCKS = "part int, slice long, " + ", ".join(f"{k} binary, {k}_target binary, {k}_all binary" for k in _KINDS)
ANSWERS = "part int, slice long, distinct long, " + ", ".join(f"{k}_target binary, {k}_all binary" for k in _KINDS)


def answers(coded: DataFrame, bits: int) -> DataFrame:
    """The totals of all keys of all slices, by (slice, part); and of every part, with slice -1, its distinct words."""
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    edges = np.array([p << (64 - bits) for p in range(1, 1 << bits)], dtype=np.uint64)

    def send(batches):
        for batch in batches:
            for number, *data in zip(*(batch.column(c).to_pylist() for c in ("slice", "target", "lengths", "words", "tokens"))):
                both = Slice(*data).counts()
                cuts = [np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]) for keys, _, _ in both]
                rows = []
                for p in np.flatnonzero((np.diff(cuts[0]) > 0) | (np.diff(cuts[1]) > 0)).tolist():
                    row = [p, number]
                    for (keys, target, every), cut in zip(both, cuts):
                        own = slice(cut[p], cut[p + 1])
                        row += [pack_keys(keys[own]), pack(target[own]), pack(every[own])]
                    rows.append(row)
                kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
                for a in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 256]), kinds)], names)
        textops.release()

    def add(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_pylist() for c in table.column_names}
        n = table.num_rows
        out: dict[str, list] = {"part": [*columns["part"], columns["part"][0]], "slice": [*columns["slice"], -1]}
        distinct = 0
        for kind in _KINDS:
            blocks = [unpack_keys(b) for b in columns[kind]]
            ends = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])
            keys, at = np.unique(np.concatenate(blocks), return_inverse=True)
            if kind == "words":
                distinct = int((keys != BEFORE).sum())
            for which in ("target", "all"):
                own = np.concatenate([unpack(b) for b in columns[f"{kind}_{which}"]]).astype(np.int64)
                total = np.zeros(len(keys), np.int64)
                np.add.at(total, at, own)
                out[f"{kind}_{which}"] = [pack(total[at[a:b]]) for a, b in zip(ends, ends[1:])] + [None]
        out["distinct"] = [None] * n + [distinct]
        names = [c.split()[0] for c in ANSWERS.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
        return pa.Table.from_arrays([pa.array(out[c], t) for c, t in zip(names, kinds)], names)

    return coded.select("slice", "target", "lengths", "words", "tokens").mapInArrow(send, BLOCKS).groupBy("part").applyInArrow(add, ANSWERS)


def losses(own: Slice, totals: dict[str, np.ndarray], tokens: tuple[int, int], vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: mean target loss and mean background loss, each without the text's own counts."""
    lengths, now, before, pair = own.lengths, own.now, own.before, own.pair
    if not len(now):
        return np.zeros(len(lengths)), np.zeros(len(lengths))
    owner = np.repeat(np.arange(len(lengths)), lengths)
    mine = []
    for at, size in ((now, len(own.words)), (pair, len(own.bigrams))):
        _, which, counts = np.unique(owner * size + at, return_inverse=True, return_counts=True)
        mine.append(counts[which])
    mine_before = np.empty_like(mine[0])
    mine_before[1:] = mine[0][:-1]
    mine_before[own.offsets[:-1][lengths > 0]] = 1
    means = []
    for which, n in zip(("target", "all"), tokens):
        held = own.target[owner].astype(np.int64) if which == "target" else 1
        words, bigrams = totals[f"words_{which}"], totals[f"bigrams_{which}"]
        p = (words[now] - held * mine[0] + 0.5) / (n - held * lengths[owner] + 0.5 * vocabulary)
        p = (bigrams[pair] - held * mine[1] + MU * p) / (words[before] - held * mine_before + MU)
        means.append(textops.per_owner(np.add, -np.log(p), own.offsets, 0.0) / np.maximum(lengths, 1))
    return means[0], means[1]


RESULT = "doc_id long, n_tokens long, loss_target double, loss_background double, difference double"


def difference(docs: DataFrame, labels: DataFrame, most: int = MOST_IDS, tokens_per_part: int = TOKENS_PER_PART) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, difference of every row; losses rounded to ``DIGITS`` places."""
    known, shared = targets(docs, labels, most)
    coded = materialise(code(known, shared), "coded")
    size = coded.agg(F.sum("n_target"), F.sum("n_tokens")).first()
    tokens = (size[0] or 0, size[1] or 0)
    bits = max(0, -(-tokens[1] // tokens_per_part) - 1).bit_length()
    answered = materialise(answers(coded, bits), "answers")
    vocabulary = answered.agg(F.sum("distinct")).first()[0] or 0

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("part")
        totals = {c: np.concatenate([unpack(b) for b in right.column(c).to_pylist()]).astype(np.int64) for c in right.column_names if c.endswith(("_target", "_all"))}
        own = Slice(*(left.column(c)[0].as_py() for c in ("target", "lengths", "words", "tokens")))
        target, background = losses(own, totals, tokens, vocabulary)
        blank = own.lengths == 0
        values = [pa.array(np.round(x, DIGITS), pa.float64(), mask=blank) for x in (target, background, target - background)]
        return pa.Table.from_arrays([left.column("docs").combine_chunks().flatten(), pa.array(own.lengths), *values], ["doc_id", "n_tokens", "loss_target", "loss_background", "difference"])

    slim = coded.drop("n_tokens", "n_target").groupBy("slice")
    return slim.cogroup(answered.filter("slice >= 0").drop("distinct").groupBy("slice")).applyInArrow(score, RESULT)


def _oracle() -> str:
    """The same result in SQL, over the words themselves."""

    def loss(t: str, held: str) -> str:
        context = f"(coalesce(x{t}.n, 0) - {held} * o.before_own)"
        p = f"((coalesce(u{t}.n, 0) - {held} * o.own + 0.5::DOUBLE) / (n{t}.n - {held} * o.size + vocabulary.n / 2::DOUBLE))"
        return f"-ln((coalesce(b{t}.n, 0) - {held} * o.bigram_own + {MU}::DOUBLE * {p}) / ({context} + {MU}::DOUBLE))"

    def tables(t: str, where: str) -> str:
        return f"""u{t} AS (SELECT w, count(*) AS n FROM tokens {where} GROUP BY w UNION ALL SELECT '', count(DISTINCT r) FROM tokens {where}),
n{t} AS (SELECT count(*) AS n FROM tokens {where}),
b{t} AS (SELECT v, w, count(*) AS n FROM tokens {where} GROUP BY v, w)"""

    return f"""
WITH good AS (SELECT doc_id FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
texts AS (
  SELECT row_number() OVER () AS r, doc_id, doc_id IS NOT NULL AND doc_id IN (SELECT doc_id FROM good) AS target,
    list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
spread AS (SELECT r, target, len(w) AS size, i, w[i] AS w FROM (SELECT r, target, w, unnest(range(1, len(w) + 1)) AS i FROM texts)),
tokens AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY r ORDER BY i), '') AS v FROM spread),
vocabulary AS (SELECT count(DISTINCT w) AS n FROM tokens),
{tables('t', 'WHERE target')},
{tables('g', '')},
counted AS (SELECT *, count(*) OVER (PARTITION BY r, w) AS own, count(*) OVER (PARTITION BY r, v, w) AS bigram_own FROM tokens),
o AS (SELECT *, coalesce(lag(own) OVER (PARTITION BY r ORDER BY i), 1) AS before_own FROM counted),
lost AS (
  SELECT o.r, {loss('t', 'o.target::BIGINT')} AS t, {loss('g', '1')} AS g
  FROM o CROSS JOIN nt CROSS JOIN ng CROSS JOIN vocabulary LEFT JOIN ut ON ut.w = o.w LEFT JOIN ug ON ug.w = o.w LEFT JOIN ut xt ON xt.w = o.v LEFT JOIN ug xg ON xg.w = o.v
    LEFT JOIN bt ON bt.v = o.v AND bt.w = o.w LEFT JOIN bg ON bg.v = o.v AND bg.w = o.w),
means AS (SELECT r, avg(t) AS t, avg(g) AS g FROM lost GROUP BY r)
SELECT x.doc_id, len(x.w)::BIGINT AS n_tokens, round(m.t, {DIGITS}) AS loss_target, round(m.g, {DIGITS}) AS loss_background, round(m.t - m.g, {DIGITS}) AS difference
FROM texts x LEFT JOIN means m USING (r)
"""


ORACLE = _oracle()
