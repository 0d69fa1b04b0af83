"""Operator 3, SentencePiece encoding (N-best) and decoding.

The piece lattice of a text has an edge for every vocabulary piece that occurs
in it and, for a character that is no piece, an edge that stands for its UTF-8
bytes.  A segmentation's score is the sum of its pieces' scores (for a BPE
model the merge order serves as score).

Forward Viterbi gives the best score up to every position.  These scores are
exact heuristics for A-star search from the end of the lattice: hypotheses
leave the queue in the order of their true totals, so the first N that reach
the start are the N best.

No piece holds a space mark inside, so no edge crosses the start of a word and
the lattice falls into one part per word.  Forward and backward Viterbi run
over all distinct words of a batch at once and also give each word's gap
between its best and second-best segmentation.  The N best segmentations of a
whole text differ from the best only in its N-1 words of least gap, so A-star
is run for those words and their results are combined; this is exact.  Texts
with runs of spaces are cut only where a run begins.

Result per text: ids of the best segmentation and its score, ``alternatives``
(2nd to Nth best) as edits of it - replace ``removed`` ids from position
``at`` by ``ids`` - and whether decoding the best gives the text back.

Defined results: a null or empty text has no ids, score 0 and no alternatives;
a text with fewer than N segmentations has fewer alternatives; equal scores
keep a fixed, otherwise arbitrary order; equal rows get equal results; a
literal U+2581 decodes to a space, as in SentencePiece itself (round_trip is
then false); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm import textops, tokens

MODEL = f"{tokens.TOKENIZERS}/piece_bpe_32k.model"
N = 4
SPACE = "▁"
SLICE = 4_000_000
NONE = -1e18
#: Positions of distinct words whose lattices are held side by side; bounds memory only.
POSITIONS = 200_000


class Pieces:
    """Vocabulary of a model: a hash table over all pieces and their prefixes, and each id's bytes."""

    def __init__(self, path: str):
        sp = tokens.pieces(path)
        size = sp.vocab_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = np.array([sp.get_score(i) for i in range(size)])
        self.text = {sp.id_to_piece(i): i for i in plain}
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        self.longest = max(map(len, self.text))
        if any(SPACE in p.lstrip(SPACE) for p in self.text):
            raise ValueError("a piece crosses the start of a word")
        self.unknown = float(min(self.score[i] for i in plain if self.score[i] > -1e8)) - 10.0
        raw: list[bytes] = [b""] * size
        for p, i in self.text.items():
            raw[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte):
            raw[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        entries: dict[int, int] = {}
        for p, i in self.text.items():
            h = 0
            for k, c in enumerate(p):
                h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                value = i if k == len(p) - 1 else -1
                if entries.get(h, -1) >= 0 and value >= 0:
                    raise ValueError("two pieces share a hash")
                entries[h] = max(entries.get(h, -1), value)
        self.keys = np.array(list(entries), dtype=np.uint64)
        self.values = np.array(list(entries.values()), dtype=np.int32)
        # open tables with different multipliers; what collides moves to the next
        self.tables = []
        rest = np.arange(len(self.keys))
        while len(rest):
            factor = textops.MULTIPLIERS[len(self.tables) % 5] + 2 * len(self.tables)
            table = np.full(1 << 20, -1, dtype=np.int32)
            slot = self._slot(self.keys[rest], factor)
            table[slot[::-1]] = rest[::-1]
            self.tables.append((factor, table))
            rest = rest[table[slot] != rest]

    @staticmethod
    def _slot(h: np.ndarray, factor: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h * np.uint64(factor)) >> np.uint64(44)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 if it is neither a piece nor a prefix of one."""
        out = np.full(len(h), -1, dtype=np.int32)
        for factor, table in self.tables:
            at = table[self._slot(h, factor)]
            good = (at >= 0) & (self.keys[at] == h)
            out[good] = at[good]
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Pieces:
    return Pieces(path)


class Lattice:
    """Lattices of a list of words (strings over the marked text) and their Viterbi results."""

    def __init__(self, words: list[str], v: Pieces):
        self.v = v
        self.words = words
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        end = np.repeat(self.starts[1:], lengths)
        self.points, width = points, v.longest
        total = len(points)
        # edge[i, l - 1]: id of the piece that begins at i and has l characters; -1 none, -2 an unknown character
        self.edge = np.full((total, width), -1, dtype=np.int32)
        h = np.zeros(total, dtype=np.uint64)
        live, used = np.arange(total), 0
        with np.errstate(over="ignore"):
            for length in range(1, width + 1):
                live = live[live + length <= end[live]]
                if not len(live):
                    break
                h[live] = h[live] * np.uint64(0x9E3779B97F4A7C15) + points[live + length - 1].astype(np.uint64) + np.uint64(1)
                entry = v.find(h[live])
                live, entry = live[entry >= 0], entry[entry >= 0]
                found = v.values[entry]
                self.edge[live, length - 1] = found
                if (found >= 0).any():
                    used = length
        # columns beyond the longest piece that occurs hold nothing
        self.edge = np.ascontiguousarray(self.edge[:, : max(1, used)])
        self.edge[self.edge[:, 0] == -1, 0] = -2
        self.weight = np.where(self.edge >= 0, v.score[np.maximum(self.edge, 0)], NONE)
        self.weight[self.edge == -2] = v.unknown
        self._viterbi(lengths)

    def _viterbi(self, lengths: np.ndarray) -> None:
        width, n = self.weight.shape[1], len(lengths)
        order = np.argsort(-lengths, kind="stable")
        begin, size = self.starts[:-1][order], lengths[order]
        longest = int(size[0]) if n else 0
        active = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
        # one position more than characters per word: word k's positions begin at starts[k] + k
        self.at0 = self.starts[:-1] + np.arange(n)
        forward = np.full(self.starts[-1] + n, NONE)
        self.back = np.zeros(self.starts[-1] + n, dtype=np.int64)  # length of the last piece on the best way here
        origin = self.at0[order]
        forward[origin] = 0
        for t in range(1, longest + 1):
            k = active[t - 1]
            reach = min(t, width)
            ls = np.arange(1, reach + 1)
            ways = forward[(origin[:k] + t)[:, None] - ls] + self.weight[(begin[:k] + t)[:, None] - ls, ls - 1]
            best = ways.argmax(axis=1)
            forward[origin[:k] + t] = ways[np.arange(k), best]
            self.back[origin[:k] + t] = best + 1
        backward = np.full_like(forward, NONE)
        last = origin + size
        backward[last] = 0
        for t in range(1, longest + 1):  # t characters from the end
            k = active[t - 1]
            reach = min(t, width)
            ls = np.arange(1, reach + 1)
            ways = backward[(last[:k] - t)[:, None] + ls] + self.weight[(begin[:k] + size[:k] - t)[:, None], ls - 1]
            backward[last[:k] - t] = ways.max(axis=1)
        self.forward = forward
        self.total = forward[self.at0 + lengths]
        marked = np.zeros(self.weight.shape, dtype=bool)  # edges of the best way
        at, word = last.copy(), order.copy()
        taken_pos, taken_len = [], []
        while len(at):
            more = at > self.at0[word]
            at, word = at[more], word[more]
            step = self.back[at]
            at = at - step
            position = at - word  # positions have one extra per earlier word
            marked[position, step - 1] = True
            taken_pos.append(position)
            taken_len.append(step)
        pos = np.concatenate(taken_pos) if taken_pos else np.zeros(0, np.int64)
        by = np.argsort(pos, kind="stable")
        self.best_pos, self.best_len = pos[by], (np.concatenate(taken_len) if taken_len else pos)[by]
        # the second best way uses an edge off the best one: the best way through each such edge
        pos, step = np.nonzero((self.edge != -1) & ~marked)
        owner = np.repeat(np.arange(n), lengths)[pos]
        through = forward[pos + owner] + self.weight[pos, step] + backward[pos + owner + step + 1]
        second = np.full(n, NONE)
        if len(pos):
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            second[owner[heads]] = np.maximum.reduceat(through, heads)
        self.gap = np.where(second > NONE / 2, self.total - second, np.inf)

    def best_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds per word) of the best segmentation of every word."""
        ids = self.edge[self.best_pos, self.best_len - 1]
        owner = np.searchsorted(self.starts, self.best_pos, side="right") - 1
        unknown = np.flatnonzero(ids == -2)
        if len(unknown):
            spelled = [self._bytes(int(self.points[p])) for p in self.best_pos[unknown]]
            counts = np.ones(len(ids), dtype=np.int64)
            counts[unknown] = [len(s) for s in spelled]
            where = np.concatenate([[0], np.cumsum(counts)])
            out = np.empty(where[-1], dtype=np.int32)
            plain = ids != -2
            out[where[:-1][plain]] = ids[plain]
            for u, s in zip(unknown, spelled):
                out[where[u] : where[u + 1]] = s
            ids, owner = out, np.repeat(owner, counts)
        return ids, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(self.words)))])

    def _bytes(self, point: int) -> list[int]:
        return self.v.byte[list(chr(point).encode("utf-8", "surrogatepass"))].tolist()

    def search(self, k: int, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of word k, best first: A-star from its end, guided by the forward scores."""
        a, first = int(self.starts[k]), int(self.at0[k])
        length = int(self.starts[k + 1]) - a
        width = self.weight.shape[1]
        edge, weight = self.edge[a : a + length].tolist(), self.weight[a : a + length].tolist()
        known = self.forward[first : first + length + 1].tolist()
        # among equal estimates the hypothesis nearest the start goes on, so ties are followed in depth
        queue = [(-known[length], length, 0, 0.0, None)]
        count, out = 0, []
        while queue and len(out) < n:
            estimate, at, _, done, path = heapq.heappop(queue)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    start, i, path = path
                    ids += self._bytes(int(self.points[a + start])) if i == -2 else [i]
                out.append((-estimate, ids))
                continue
            for back in range(1, min(at, width) + 1):
                i = edge[at - back][back - 1]
                if i == -1:
                    continue
                count += 1
                total = done + weight[at - back][back - 1]
                heapq.heappush(queue, (-(total + known[at - back]), at - back, count, total, (at - back, i, path)))
        return out


_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*")


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(word index per occurrence, offsets per text, distinct words) of the marked texts.

    Each word carries the marks before it; together the words of a text spell
    the mark, the text with spaces as marks.
    """
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    runs = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.or_(pc.ends_with(texts, " "), pc.match_substring(texts, SPACE)))
    lists = pc.split_pattern(pc.if_else(runs, "", texts), " ")
    coded = lists.flatten().dictionary_encode()
    uniq = [SPACE + w for w in coded.dictionary.to_pylist()]
    ids = np.asarray(coded.indices, dtype=np.int64)
    lengths = np.diff(np.asarray(lists.offsets, dtype=np.int64))
    slow = runs.to_numpy(zero_copy_only=False)
    blank = np.asarray(pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=bool)
    if not (slow | blank).any():
        return ids, np.concatenate([[0], np.cumsum(lengths)]), uniq
    place = {w: i for i, w in enumerate(uniq)}
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    parts, counts = [], []
    for i in range(len(texts)):
        if blank[i]:
            part = ids[:0]
        elif slow[i]:
            part = np.array([place.setdefault(w, len(place)) for w in _RUNS.findall(SPACE + texts[i].as_py().replace(" ", SPACE))], dtype=np.int64)
        else:
            part = ids[bounds[i] : bounds[i + 1]]
        parts.append(part)
        counts.append(len(part))
    return np.concatenate(parts) if parts else ids, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), list(place)


def gather(values: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the runs ``rows`` of a ragged array: (values, bounds per run)."""
    counts = starts[1:][rows] - starts[:-1][rows]
    bounds = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(bounds[-1]) + np.repeat(starts[:-1][rows] - bounds[:-1], counts)
    return values[at], bounds


def decode_flat(ids: np.ndarray, bounds: np.ndarray, v: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of id runs, the leading space of each dropped: (bytes, bounds)."""
    raw, ends = gather(v.raw, v.raw_starts, ids)
    cuts = ends[bounds]
    drop = cuts[:-1][np.diff(cuts) > 0]
    drop = drop[raw[drop] == 32]
    keep = np.ones(len(raw), dtype=bool)
    keep[drop] = False
    return raw[keep], np.concatenate([[0], np.cumsum(keep)])[cuts]


def decode(ids: list[int], path: str = MODEL) -> str:
    """The text of one id list."""
    raw, _ = decode_flat(np.asarray(ids, dtype=np.int64), np.array([0, len(ids)]), vocabulary(path))
    return raw.tobytes().decode("utf-8", "replace")


def combine(losses: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n least sums that take one entry of each list: (sum, choice per list), least first."""
    sums: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for own in losses:
        sums = heapq.nsmallest(n, [(s + x, (*c, i)) for s, c in sums for i, x in enumerate(own)])
    return sums


def segment(texts: pa.Array, path: str = MODEL, n: int = N) -> dict[str, pa.Array]:
    """Arrow columns score, n_pieces, ids, alternatives, round_trip."""
    v = vocabulary(path)
    word, offsets, uniq = split(texts)
    rows = len(offsets) - 1
    lattices, first_of = [], []
    sizes = np.cumsum([len(w) for w in uniq]) // POSITIONS if uniq else np.zeros(0, int)
    for part in np.unique(sizes):
        some = np.flatnonzero(sizes == part)
        first_of.append(int(some[0]))
        lattices.append(Lattice(uniq[some[0] : some[-1] + 1], v))
    totals = np.concatenate([x.total for x in lattices]) if lattices else np.zeros(0)
    gaps = np.concatenate([x.gap for x in lattices]) if lattices else np.zeros(0)
    ids, counts = [], [np.zeros(1, np.int64)]
    for x in lattices:
        own, bounds = x.best_ids()
        ids.append(own)
        counts.append(np.diff(bounds))
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    starts = np.cumsum(np.concatenate(counts))
    out, ends = gather(flat, starts, word)
    doc_bounds = ends[offsets]
    score = textops.per_owner(np.add, totals[word], offsets, 0.0)

    # the n - 1 words of least gap of every text, the earlier of equals first
    open_gaps = gaps[word].copy()
    picks = []
    texts_of = np.arange(rows)
    for _ in range(n - 1):
        least = textops.per_owner(np.minimum, open_gaps, offsets, np.inf)
        hit = np.flatnonzero(open_gaps == np.repeat(least, np.diff(offsets)))
        hit = hit[np.isfinite(open_gaps[hit])]
        owner = np.searchsorted(offsets, hit, side="right") - 1
        _, firsts = np.unique(owner, return_index=True)
        hit = hit[firsts]
        picks.append(hit)
        open_gaps[hit] = np.inf
    chosen = np.sort(np.concatenate(picks)) if picks else np.zeros(0, np.int64)
    chosen_bounds = np.searchsorted(chosen, offsets)
    cache: dict[int, list[tuple[float, list[int]]]] = {}

    def ways(w: int) -> list[tuple[float, list[int]]]:
        if w not in cache:
            part = np.searchsorted(first_of, w, side="right") - 1
            found = lattices[part].search(w - first_of[part], n)
            best = flat[starts[w] : starts[w + 1]].tolist()  # Viterbi's choice leads among equals
            cache[w] = [(found[0][0], best), *(f for f in found if f[1] != best)][:n]
        return cache[w]

    alt_counts, alt_scores, edit_counts, edit_at, edit_removed, edit_ids, edit_id_counts = [], [], [], [], [], [], []
    chosen_list, word_of = chosen.tolist(), word[chosen].tolist() if len(chosen) else []
    for i in texts_of.tolist():
        a, b = int(chosen_bounds[i]), int(chosen_bounds[i + 1])
        if a == b:
            alt_counts.append(0)
            continue
        options = [ways(w) for w in word_of[a:b]]
        found = combine([[o[0][0] - s for s, _ in o] for o in options], n)[1:]
        alt_counts.append(len(found))
        for loss, choice in found:
            alt_scores.append(float(score[i]) - loss)
            edits = 0
            for k, c in enumerate(choice):
                if c:
                    at = chosen_list[a + k]
                    edits += 1
                    edit_at.append(int(ends[at] - doc_bounds[i]))
                    edit_removed.append(int(ends[at + 1] - ends[at]))
                    edit_ids += options[k][c][1]
                    edit_id_counts.append(len(options[k][c][1]))
            edit_counts.append(edits)
    bounds = lambda c: pa.array(np.concatenate([[0], np.cumsum(c)]).astype(np.int32))
    edits = pa.StructArray.from_arrays(
        [pa.array(edit_at, pa.int32()), pa.array(edit_removed, pa.int32()), pa.ListArray.from_arrays(bounds(edit_id_counts), pa.array(edit_ids, pa.int32()))], names=["at", "removed", "ids"]
    )
    alternatives = pa.StructArray.from_arrays([pa.array(alt_scores, pa.float64()), pa.ListArray.from_arrays(bounds(edit_counts), edits)], names=["score", "edits"])
    raw, cuts = decode_flat(out, doc_bounds, v)
    return {
        "score": pa.array(score, pa.float64()),
        "n_pieces": pa.array(np.diff(doc_bounds), pa.int64()),
        "ids": textops.ragged(out, doc_bounds, pa.int32()),
        "alternatives": pa.ListArray.from_arrays(bounds(alt_counts), alternatives),
        "round_trip": same_bytes(texts, raw, cuts),
    }


def same_bytes(texts: pa.Array, raw: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Whether each text's UTF-8 equals its run of ``raw``."""
    decoded = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
    return pc.equal(decoded, pc.fill_null(texts, "").cast(pa.binary()))


def alternative(ids: list[int], edits: list[tuple[int, int, list[int]]]) -> list[int]:
    """The id list that ``edits`` make of the best one."""
    out = list(ids)
    for at, removed, new in sorted(edits, key=lambda e: -e[0]):
        out[at : at + removed] = new
    return out


SCHEMA = "doc_id long, score double, n_pieces long, ids array<int>, alternatives array<struct<score: double, edits: array<struct<at: int, removed: int, ids: array<int>>>>>, round_trip boolean"


def encode(docs: DataFrame, path: str = MODEL, n: int = N) -> DataFrame:
    """N-best segmentations of every row's text."""

    def run(batches):
        for batch in textops.slices(batches, limit=SLICE):
            columns = segment(batch.column("text"), path, n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns.values()], ["doc_id", *columns])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, SCHEMA)
