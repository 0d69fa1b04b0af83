"""Operator 5, best-fit packing of documents into training sequences.

Lengths are token counts under a public vocabulary.  Packing works on the
*histogram* of lengths, which has at most ``capacity`` rows whatever the size
of the corpus:

1. a document longer than ``capacity`` is cut into full sequences, which have a
   bin each, and a rest;
2. Martello-Toth dominance reduction fixes sets of up to three lengths that
   provably dominate every other set holding the same longest member;
3. what is left is packed best-fit, longest first;
4. the plan (length, rank interval -> bins) is joined back to the documents.  A
   task ranks its documents within their length as it reads them, and a table
   of counts by (task, length) gives the ranks before it, so documents are
   neither sorted nor gathered by length.

Steps 2 and 3 treat equal lengths in bulk, so the driver's work depends on
``capacity`` and not on the number of documents.

Defined results: a null or empty text has no tokens and takes no place; equal
lengths are served in the order in which they are read, so which of them shares
a bin with what depends on the partitioning of the input; rows with the same
doc_id are packed each for itself; a null doc_id is packed like any other; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lathe.llm import textops, tokens
from lathe.storage import materialise

CAPACITY = 2048
VOCABULARY = f"{tokens.TOKENIZERS}/byte_bpe_multi_50k.tiktoken"


def _counted(batch: pa.RecordBatch, vocabulary: str) -> np.ndarray:
    return np.diff(tokens.encode_column(tokens.byte_bpe(vocabulary), batch.column("text"))[1])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_counted(batch, vocabulary), pa.int64())], ["doc_id", "n_tokens"])

    return _texts(docs).mapInArrow(textops.map_slices(count), "doc_id long, n_tokens long")


class Plan:
    """Bins in bulk: every entry is a number of alike bins and the lengths each holds."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.groups: list[tuple[int, list[tuple[int, int]], str]] = []

    def add(self, bins: int, content: list[tuple[int, int]], rule: str) -> None:
        if bins:
            self.groups.append((bins, content, rule))

    @property
    def bins(self) -> int:
        return sum(n for n, _, _ in self.groups)


def reduce_instance(histogram: dict[int, int], capacity: int, plan: Plan) -> dict[int, int]:
    """Martello-Toth reduction (MTRP) over a histogram; returns what is left."""
    left = {w: c for w, c in histogram.items() if c > 0}
    order = sorted(left)  # ascending, only shrinks

    def take(w: int, n: int) -> None:
        left[w] -= n
        if left[w] == 0:
            del left[w]
            order.pop(bisect_left(order, w))

    def smallest(n: int, without: int) -> list[int]:
        """The n smallest remaining lengths, with repeats, not counting one piece of ``without``."""
        out: list[int] = []
        for w in order:
            out += [w] * min(left[w] - (w == without), n - len(out))
            if len(out) >= n:
                break
        return out

    def largest_up_to(most: int, without: int) -> int | None:
        i = bisect_left(order, most + 1) - 1
        while i >= 0:
            if left[order[i]] - (order[i] == without) > 0:
                return order[i]
            i -= 1
        return None

    for j in sorted(left, reverse=True):
        while left.get(j, 0) > 0:
            room = capacity - j
            small = smallest(3, j)
            fit = 0
            total = 0
            for w in small:
                total += w
                if total > room:
                    break
                fit += 1
            if fit == 0:
                n = left[j]
                plan.add(n, [(j, 1)], "alone")
                take(j, n)
                continue
            best = largest_up_to(room, j)
            if best is None:
                break
            if fit == 1 or best == room:
                n = left[j] // 2 if best == j else min(left[j], left[best])
                if best == j:
                    plan.add(n, [(j, 2)], "pair")
                    take(j, 2 * n)
                else:
                    plan.add(n, [(j, 1), (best, 1)], "pair")
                    take(j, n)
                    take(best, n)
                continue
            if fit > 2:
                break
            pair = _largest_pair(order, left, room, j)
            if pair is None:
                break
            a, b = pair
            if best >= a + b:
                n = left[j] // 2 if best == j else min(left[j], left[best])
                content = [(j, 2)] if best == j else [(j, 1), (best, 1)]
                if n == 0:
                    break
                plan.add(n, content, "pair over triples")
                for w, k in content:
                    take(w, k * n)
                continue
            above = _two_above(order, left, b, j)
            if best == a and (above is None or above > room):
                need: dict[int, int] = defaultdict(int)
                for w in (j, a, b):
                    need[w] += 1
                n = min(left[w] // k for w, k in need.items())
                if n == 0:
                    break
                plan.add(n, sorted(need.items(), reverse=True), "triple")
                for w, k in need.items():
                    take(w, k * n)
                continue
            break
    return left


def _largest_pair(order: list[int], left: dict[int, int], room: int, without: int) -> tuple[int, int] | None:
    """Lengths (a >= b) with the largest sum that fits ``room``, the longer a preferred on ties."""
    best: tuple[int, int] | None = None
    top = 0
    lo, hi = 0, bisect_left(order, room + 1) - 1
    free = lambda w: left[w] - (w == without)
    while hi >= lo and hi >= 0:
        if free(order[hi]) == 0:
            hi -= 1
            continue
        while lo < hi and order[lo] + order[hi] <= room:
            lo += 1
        # the partner is the longest one up to lo that fits
        k = min(lo, hi)
        while k >= 0 and (order[k] + order[hi] > room or free(order[k]) - (k == hi) <= 0):
            k -= 1
        if k >= 0 and order[k] + order[hi] > top:
            top, best = order[k] + order[hi], (order[hi], order[k])
            if top == room:
                return best
        hi -= 1
        lo = min(lo, hi)
        while lo > 0 and hi >= 0 and order[lo] + order[hi] > room:
            lo -= 1
        if hi < 0 or 2 * order[hi] <= top:
            break
    return best


def _two_above(order: list[int], left: dict[int, int], b: int, without: int) -> int | None:
    """Sum of the two shortest remaining lengths that are longer than ``b``."""
    got: list[int] = []
    for w in order[bisect_left(order, b + 1) :]:
        got += [w] * min(left[w] - (w == without), 2 - len(got))
        if len(got) == 2:
            return got[0] + got[1]
    return None


def best_fit(histogram: dict[int, int], capacity: int, plan: Plan) -> None:
    """Best-fit decreasing over a histogram, alike bins together."""
    rooms: list[int] = []
    open_bins: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)

    def put(n: int, content: list[tuple[int, int]], room: int) -> None:
        if n:
            if not open_bins[room]:
                insort(rooms, room)
            open_bins[room].append((n, content))

    for w in sorted(histogram, reverse=True):
        count = histogram[w]
        while count > 0:
            i = bisect_left(rooms, w)
            if i == len(rooms):
                room, n, content = capacity, -(-count // (capacity // w)), []
            else:
                room = rooms[i]
                n, content = open_bins[room].pop()
                if not open_bins[room]:
                    rooms.pop(i)
            each = room // w
            full = min(n, count // each)
            put(full, [*content, (w, each)], room - each * w)
            count -= full * each
            if full < n and count < each:
                if count:
                    put(1, [*content, (w, count)], room - count * w)
                    full, count = full + 1, 0
                if content:
                    put(n - full, content, room)
    for room in rooms:
        for n, content in open_bins[room]:
            plan.add(n, content, "best fit")


def slots(plan: Plan, first_bin: int = 0) -> list[tuple[int, int, int, int, int, int, str]]:
    """Rows (length, rank_from, rank_to, bin_from, per_bin, offset, rule); rank intervals of a length are disjoint."""
    served: dict[int, int] = defaultdict(int)
    rows = []
    base = first_bin
    for n, content, rule in plan.groups:
        offset = 0
        for w, k in content:
            rows.append((w, served[w], served[w] + n * k, base, k, offset, rule))
            served[w] += n * k
            offset += w * k
        base += n
    return rows


def make_plan(histogram: dict[int, int], capacity: int) -> Plan:
    plan = Plan(capacity)
    best_fit(reduce_instance(histogram, capacity, plan), capacity, plan)
    return plan


RANKED = "doc_id long, task int, full long, full_before long, rest long, rank long"


def _ranks(pairs, capacity: int):
    """``RANKED`` batches of a task's (doc_ids, token counts) as they come."""
    task = TaskContext.get().partitionId()
    seen, whole = np.zeros(capacity, np.int64), 0
    for doc_ids, n in pairs:
        some = n > 0
        if not some.all():
            doc_ids, n = doc_ids.filter(pa.array(some)), n[some]
        full, rest = n // capacity, n % capacity
        order = np.argsort(rest, kind="stable")
        r = rest[order]
        runs = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))[: len(r)]
        rank = np.empty(len(n), np.int64)
        rank[order] = np.arange(len(r)) - np.repeat(runs, np.diff(np.concatenate([runs, [len(r)]]))) + seen[r]
        seen += np.bincount(rest, minlength=capacity)
        before = whole + np.cumsum(full) - full
        whole += int(full.sum())
        columns = [pa.array(np.full(len(n), task), pa.int32()), *(pa.array(x, pa.int64()) for x in (full, before, rest, rank))]
        yield pa.RecordBatch.from_arrays([doc_ids, *columns], ["doc_id", "task", "full", "full_before", "rest", "rank"])
    textops.release()


def ranked(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Of every (doc_id, n_tokens): its full sequences, those before it in its task, its rest and the rest's rank among
    the equal ones of its task."""

    def run(batches):
        return _ranks(((b.column("doc_id"), b.column("n_tokens").to_numpy()) for b in batches), capacity)

    return lengths.filter("n_tokens > 0").select("doc_id", "n_tokens").mapInArrow(run, RANKED)


def ranked_texts(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """``ranked(token_counts(docs))`` in one pass: a task keeps one Python worker busy instead of two."""

    def run(batches):
        return _ranks(((b.column("doc_id"), _counted(b, vocabulary)) for b in textops.slices(batches)), capacity)

    return _texts(docs).mapInArrow(run, RANKED)


def pack_lengths(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack (doc_id, n_tokens) rows; see the module for the result's rules.

    Result: doc_id, chunk, chunk_from (first token), n_tokens, bin_id, bin_offset, rule.
    A full chunk of a long document has a bin of its own (rule 'alone').
    """
    return pack_ranked(ranked(lengths, capacity), capacity)


def pack_ranked(ranks: DataFrame, capacity: int) -> DataFrame:
    """Pack what ``ranked`` or ``ranked_texts`` gives."""
    spark = ranks.sparkSession
    known = materialise(ranks, "lengths")
    # by (task, length), length 0 standing for the full chunks: at most capacity rows a task
    counts = known.filter("rest > 0").groupBy("task", F.col("rest").alias("length")).agg(F.count("*").alias("n"))
    counts = materialise(counts.unionByName(known.groupBy("task").agg(F.lit(0).cast("long").alias("length"), F.sum("full").alias("n"))), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    histogram.pop(0, None)
    plan = make_plan(histogram, capacity)
    rows = slots(plan)
    schema = "rest long, _from long, _to long, _bin long, _each long, _offset long, rule string"
    table = spark.createDataFrame(rows, schema)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("task", F.col("length").alias("rest"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    placed = (
        known.filter("rest > 0").join(before, ["task", "rest"]).withColumn("_rank", F.col("rank") + F.col("_before")).join(_small(table, len(rows)), "rest").filter("_rank >= _from AND _rank < _to")
    )
    rests = placed.select(
        "doc_id",
        F.col("full").alias("chunk"),
        (F.col("full") * capacity).alias("chunk_from"),
        F.col("rest").alias("n_tokens"),
        F.expr("_bin + (_rank - _from) div _each").alias("bin_id"),
        F.expr("_offset + ((_rank - _from) % _each) * rest").alias("bin_offset"),
        "rule",
    )
    full = known.filter("full > 0").join(before.filter("rest = 0").select("task", "_before"), "task").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("chunk"), (F.col("_before") + F.col("full_before")).alias("_first"))
    alone = full.select(
        "doc_id",
        "chunk",
        (F.col("chunk") * capacity).alias("chunk_from"),
        F.lit(capacity).cast("long").alias("n_tokens"),
        (F.lit(plan.bins) + F.col("_first") + F.col("chunk")).alias("bin_id"),
        F.lit(0).cast("long").alias("bin_offset"),
        F.lit("alone").alias("rule"),
    )
    return rests.unionByName(alone)


def _small(table: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """Broadcast a plan of up to ``most`` rows (about 60 bytes each); a larger one is joined by shuffle."""
    return F.broadcast(table) if rows <= most else table


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Place every document's tokens in sequences of ``capacity`` tokens."""
    return pack_ranked(ranked_texts(docs, capacity, vocabulary), capacity)
