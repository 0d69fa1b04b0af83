"""Operator 10, materialisation of token ids in training order.

1. Every task encodes its documents, ends each with the end-of-text id and cuts
   the stream into sequences of ``LENGTH`` ids; the last one of a task is filled
   up with end-of-text ids.  The sequences are written once to the shared
   folder, so everything that follows refers to fixed rows.
2. Sequences are numbered by (task, place); a table of counts per task, one row
   for each, gives the first number of a task and the total N.
3. A keyed Feistel permutation over the least even power of two that holds N,
   with cycle-walking (values of N and above are mapped again), gives every
   number its slot in 0..N-1: a bijection that needs no shuffle and no state.
4. Sequences go to the partition of their slot range (ranges are exact, no
   sampling), are sorted by slot and joined to shards of ``PER_SHARD`` slots.
   A shard is ``PER_SHARD`` times a fixed stride, the last one shorter, so slot s
   lies in shard s // PER_SHARD at byte (s % PER_SHARD) * stride and reading can
   resume at any slot.  Ids are little-endian, of two bytes if the vocabulary's
   ids fit, else of four (``id_type``): the stride is ``LENGTH`` times that.

Result: shard, first_slot, n_sequences, stride, crc32, payload, and spans: for
every sequence of the shard the documents in it, as doc_id, ``at`` (place in the
sequence) and ``first`` (the first token of the document that is there).
``write_shards`` puts the payloads in files and ``read_from`` reads them.

Defined results: a null or empty text has no tokens and no place; equal rows
are written as often as they occur; a null doc_id stays null in the spans; an
empty table gives no shards; other columns are ignored; the order depends on
key, rows and the partitioning of the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm import textops, tokens
from lathe.storage import materialise

VOCABULARY = f"{tokens.TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
LENGTH = 2048
PER_SHARD = 2048
KEY = 0x5EED
ROUNDS = 6
#: Shards per partition of the last shuffle (8 MB each).
SHARDS_TOGETHER = 4
#: Bytes that a task holds back while it writes a table of sequences.
ROW_GROUP = 16 << 20
SPANS = "array<struct<doc_id: long, at: int, first: long>>"
_SPAN = pa.struct([("doc_id", pa.int64()), ("at", pa.int32()), ("first", pa.int64())])


class Feistel:
    """A keyed permutation of 0..n-1."""

    def __init__(self, n: int, key: int = KEY, rounds: int = ROUNDS):
        self.n = n
        self.half = max(1, -(-max(n - 1, 1).bit_length() // 2))
        seeds = textops.mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(textops.MULTIPLIERS[0]) + np.uint64(key & 0xFFFFFFFFFFFFFFFF))
        self.keys = textops.mix(seeds + np.uint64(textops.MULTIPLIERS[1]))

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return textops.mix(x * np.uint64(textops.MULTIPLIERS[2]) + key) >> np.uint64(64 - self.half)

    def _once(self, x: np.ndarray, keys, forward: bool) -> np.ndarray:
        mask = np.uint64((1 << self.half) - 1)
        left, right = x >> np.uint64(self.half), x & mask
        for key in keys:
            if forward:
                left, right = right, left ^ self._round(right, key)
            else:
                left, right = right ^ self._round(left, key), left
        return (left << np.uint64(self.half)) | right

    def _walk(self, x: np.ndarray, forward: bool) -> np.ndarray:
        if len(x) and (x.min() < 0 or x.max() >= self.n):
            raise ValueError("not among the numbers that are permuted")
        keys = self.keys if forward else self.keys[::-1]
        out = self._once(x.astype(np.uint64), keys, forward)
        while (outside := np.flatnonzero(out >= self.n)).size:
            out[outside] = self._once(out[outside], keys, forward)
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(np.asarray(number), True)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(np.asarray(slot), False)


def id_type(vocabulary: str, end: int) -> str:
    """The least type of numpy that holds every id of the vocabulary and ``end``."""
    return "<u2" if max(tokens.byte_bpe(vocabulary).n_vocab - 1, end) < 1 << 16 else "<u4"


class Cutter:
    """Cuts a stream of documents into sequences of fixed length with their spans."""

    def __init__(self, length: int, end: int, kind: str = "<u2"):
        self.length, self.end, self.kind = length, end, kind
        self.rest = np.zeros(0, kind)
        self.open: list[tuple[int | None, int, int]] = []  # (doc_id, at, first) within the rest

    def add(self, doc_ids: list[int | None], ids: np.ndarray, bounds: np.ndarray) -> tuple[list[bytes], list[list[tuple]]]:
        sizes = np.diff(bounds)
        some = np.flatnonzero(sizes)
        # one end-of-text id behind every document that has tokens
        sizes = sizes[some] + 1
        starts = np.concatenate([[0], np.cumsum(sizes)])
        stream = np.full(int(starts[-1]), self.end, dtype=self.kind)
        inside = np.ones(len(stream), dtype=bool)
        inside[starts[1:] - 1] = False
        stream[inside] = ids
        base = len(self.rest)
        spans = self.open + [(doc_ids[i], base + int(s), 0) for i, s in zip(some.tolist(), starts[:-1].tolist())]
        stream = np.concatenate([self.rest, stream])
        full = len(stream) // self.length
        out, lists = [], []
        k = 0
        running: tuple | None = None
        for b in range(full):
            low, high = b * self.length, (b + 1) * self.length
            own = []
            if running is not None:
                own.append((running[0], 0, running[2] + low - running[1]))
            while k < len(spans) and spans[k][1] < high:
                if spans[k][1] == low and own:
                    own.pop()
                own.append((spans[k][0], spans[k][1] - low, spans[k][2]))
                running = spans[k]
                k += 1
            out.append(stream[low:high].tobytes())
            lists.append(own)
        cut = full * self.length
        left = [(d, at - cut, first) for d, at, first in spans[k:]]
        if running is not None and cut < len(stream) and (not left or left[0][1] > 0):
            left.insert(0, (running[0], 0, running[2] + cut - running[1]))
        self.rest, self.open = stream[cut:], left
        return out, lists

    def last(self) -> tuple[list[bytes], list[list[tuple]], int]:
        """What is left, filled up; and how many ids of it are not filling."""
        n = len(self.rest)
        if not n:
            return [], [], 0
        filled = np.full(self.length, self.end, dtype=self.kind)
        filled[:n] = self.rest
        return [filled.tobytes()], [self.open], n


def sequences(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, end: int = tokens.END_OF_TEXT) -> DataFrame:
    """(task, place, data, spans): the corpus as sequences of ``length`` ids."""
    kind = id_type(vocabulary, end)

    def run(batches):
        encoding = tokens.byte_bpe(vocabulary)
        cutter, task, place = Cutter(length, end, kind), TaskContext.get().partitionId(), 0

        def batch_of(data: list[bytes], spans: list[list[tuple]], first: int) -> pa.RecordBatch:
            flat = [s for own in spans for s in own]
            bounds = np.concatenate([[0], np.cumsum([len(own) for own in spans])]).astype(np.int32)
            fields = [pa.array([s[i] for s in flat], _SPAN.field(i).type) for i in range(3)]
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(fields, fields=list(_SPAN)))
            n = len(data)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, task), pa.int32()), pa.array(np.arange(first, first + n), pa.int64()), pa.array(data, pa.binary()), lists], ["task", "place", "data", "spans"])

        for batch in textops.slices(batches):
            data, spans = cutter.add(batch.column("doc_id").to_pylist(), *tokens.encode_column(encoding, batch.column("text")))
            if data:
                yield batch_of(data, spans, place)
                place += len(data)
        data, spans, _ = cutter.last()
        if data:
            yield batch_of(data, spans, place)
        textops.release()

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, f"task int, place long, data binary, spans {SPANS}")


SCHEMA = f"shard long, first_slot long, n_sequences long, stride int, crc32 long, payload binary, spans array<{SPANS}>"


def shards(docs: DataFrame, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, vocabulary: str = VOCABULARY, end: int = tokens.END_OF_TEXT) -> DataFrame:
    """One row per shard, in the form that the module describes."""
    written = materialise(sequences(docs, length, vocabulary, end), "sequences", **{"parquet.block.size": ROW_GROUP})
    stride = length * np.dtype(id_type(vocabulary, end)).itemsize
    counts = sorted((r["task"], r["n"]) for r in written.groupBy("task").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in counts)
    before = np.concatenate([[0], np.cumsum([n for _, n in counts])]).astype(np.int64)
    tasks = np.array([t for t, _ in counts], dtype=np.int64)
    order = Feistel(max(total, 1), key)
    n_shards = -(-total // per_shard)
    parts = max(1, -(-n_shards // SHARDS_TOGETHER), min(n_shards, docs.sparkSession.sparkContext.defaultParallelism))
    kind = written.schema["spans"].dataType.simpleString()

    def place(batches):
        for batch in batches:
            at = np.searchsorted(tasks, batch.column("task").to_numpy())
            slot = order.slot(before[at] + batch.column("place").to_numpy())
            part = slot // per_shard * parts // max(n_shards, 1)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(slot, pa.int64()), batch.column("data"), batch.column("spans")], ["part", "slot", "data", "spans"])

    def join(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shard = batch.column("slot").to_numpy() // per_shard
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if held and held[0].column("slot")[0].as_py() // per_shard != shard[a]:
                    yield shard_row(held, per_shard, stride)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield shard_row(held, per_shard, stride)
        textops.release()

    placed = written.mapInArrow(place, f"part int, slot long, data binary, spans {kind}")
    sorted_ = placed.repartitionById(parts, F.col("part")).sortWithinPartitions("slot")
    return sorted_.select("slot", "data", "spans").mapInArrow(join, SCHEMA)


def shard_row(rows: list[pa.RecordBatch], per_shard: int, stride: int) -> pa.RecordBatch:
    """The row of one shard from its sequences, which are in the order of their slots."""
    whole = pa.Table.from_batches(rows).combine_chunks()
    slots = whole.column("slot").to_numpy()
    first = int(slots[0])
    if first % per_shard or (np.diff(slots) != 1).any():
        raise RuntimeError(f"shard {first // per_shard} has gaps")
    payload = b"".join(whole.column("data").to_pylist())
    spans = pa.concat_arrays(whole.column("spans").chunks)
    lists = pa.ListArray.from_arrays(pa.array([0, len(spans)], pa.int32()), spans)
    values = [(first // per_shard, pa.int64()), (first, pa.int64()), (len(slots), pa.int64()), (stride, pa.int32()), (zlib.crc32(payload), pa.int64()), (payload, pa.binary())]
    return pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in values), lists], ["shard", "first_slot", "n_sequences", "stride", "crc32", "payload", "spans"])


def _files(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def write_shards(found: DataFrame, uri: str) -> DataFrame:
    """Write the payloads to ``uri``/shard-<number>.bin; returns (shard, first_slot, n_sequences, stride, crc32, file).

    A file appears by a rename when it is complete, so a task that runs again
    or twice leaves the same files.
    """

    def run(batches):
        fs, root = _files(uri)
        fs.create_dir(root)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            names = []
            for shard, payload in zip(batch.column("shard").to_pylist(), batch.column("payload").to_pylist()):
                names.append(f"shard-{shard:010d}.bin")
                with fs.open_output_stream(f"{root}/.{names[-1]}.{attempt}") as out:
                    out.write(payload)
                fs.move(f"{root}/.{names[-1]}.{attempt}", f"{root}/{names[-1]}")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("shard", "first_slot", "n_sequences", "stride", "crc32")), pa.array(names, pa.string())], ["shard", "first_slot", "n_sequences", "stride", "crc32", "file"])

    return found.mapInArrow(run, "shard long, first_slot long, n_sequences long, stride int, crc32 long, file string")


def read_from(uri: str, slot: int = 0, length: int = LENGTH, per_shard: int = PER_SHARD, kind: str = "<u2") -> Iterator[np.ndarray]:
    """The sequences from ``slot`` on, in training order; ``kind`` is what ``id_type`` gives for the vocabulary."""
    fs, root = _files(uri)
    shard, inside = divmod(slot, per_shard)
    while True:
        name = f"{root}/shard-{shard:010d}.bin"
        if fs.get_file_info(name).type == pyarrow.fs.FileType.NotFound:
            return
        with fs.open_input_file(name) as file:
            stride = length * np.dtype(kind).itemsize
            file.seek(inside * stride)
            while data := file.read(stride):
                yield np.frombuffer(data, kind)
        shard, inside = shard + 1, 0
