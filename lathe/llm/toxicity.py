"""Operator 8, toxicity scoring by a small recurrent network in numpy.

Every word has two inputs: an embedding of the word itself (words of the
training vocabulary; others share one) and the mean embedding of its letter
trigrams, which also covers unseen and disguised spellings.  A bidirectional
gated recurrent layer runs over windows of ``WINDOW`` words, attention pools
its states, and a logistic unit scores the window.  Windows overlap by half
and cover the whole text; a document's score is that of its worst window, and
it is toxic when that reaches the threshold.

All labelled documents take part.  ``HELD`` of them, by the hash of doc_id, are
kept for the threshold; the others teach.  Words enter the vocabulary by exact
counts over all that teach.  Teaching starts on the documents with the least
hashes (``train``, at most ``SAMPLE`` of either label); from these weights every
shard of about ``SHARD`` documents goes on by itself, each of its documents
teaching at least once, and the weights of the shards are averaged by their
documents.  The threshold is set by the scores of all held-out documents,
counted in cells of ``GRAIN``.

In the start, a batch has as many windows of toxic as of clean documents; toxic documents count
alike however long they are, clean ones by their windows, any of which may raise
a false alarm.  Labels hold for documents and not for windows, so every
``REFRESH`` steps all windows are scored, and from then on a toxic document teaches
by the highest third of its windows and a clean one by the harder half.  The
number of steps is the same for every start.

Defined results: a null or blank text has score 0 and is not toxic; a text
shorter than a window is one window; equal rows get equal results; with fewer
than two labelled documents of either kind that have words nothing is toxic; empty tables give
empty results; labels of rows that are missing, null or contradictory (both
values for one doc_id) are not used; of several texts of a labelled doc_id the
least one teaches; other columns are ignored by ``score``
and passed through by ``keep_clean``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm import bloom, langid, textops
from lathe.storage import discard, materialise

WINDOW = 32
STRIDE = 16
#: Labelled documents, toxic and clean, that teaching starts on (bounds, not shares).
SAMPLE = (500, 1500)
#: Labelled documents of ten that are held out.
HELD = 2
#: Documents of a shard, the step size there, and the parts in which weights are averaged.
SHARD = 4096
SHARD_RATE = 0.002
BLOCKS = 64
#: Width of the cells in which logits of held-out documents are counted.
GRAIN = 0.001
#: Gradient steps, windows in each, and steps between two scorings of all windows.
STEPS = 400
BATCH = 128
REFRESH = 60
HIDDEN = 8
WORD_SIZE = 12
CHAR_SIZE = 8
CHAR_BUCKETS = 1 << 12
#: A word is in the vocabulary if this share of the fitted documents has it.
COMMON = 0.006
TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "…«»“”‘’–—"
#: Windows that are scored side by side; bounds memory only.
SIDE_BY_SIDE = 4096


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: dict[str, np.ndarray]
    threshold: float
    window: int = WINDOW
    stride: int = STRIDE


def word_index(uniq: list[str], vocabulary: dict[str, int]) -> np.ndarray:
    get = vocabulary.get
    return np.fromiter((get(w.strip(TRIM), 0) for w in uniq), dtype=np.int32, count=len(uniq))


def char_rows(uniq: list[str]) -> tuple[np.ndarray, np.ndarray]:
    buckets, starts, _ = langid.letters(uniq)
    return buckets % CHAR_BUCKETS, starts


def char_means(table: np.ndarray, buckets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    n = np.diff(starts)
    out = np.zeros((len(n), table.shape[1]), dtype=table.dtype)
    some = n > 0
    if some.any():
        out[some] = np.add.reduceat(table[buckets], starts[:-1][some], axis=0) / n[some, None]
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def initial(words: int, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d, h = WORD_SIZE + CHAR_SIZE, HIDDEN
    draw = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
    return {
        "word": draw(words, WORD_SIZE, scale=0.3),
        "char": draw(CHAR_BUCKETS, CHAR_SIZE, scale=0.3),
        "in": draw(2, d, 3 * h, scale=d**-0.5),
        "in_b": np.zeros((2, 1, 3 * h), np.float32),
        "rec": draw(2, h, 3 * h, scale=h**-0.5),
        "rec_b": np.zeros((2, 1, h), np.float32),
        "att": draw(2 * h, h, scale=(2 * h) ** -0.5),
        "att_b": np.zeros(h, np.float32),
        "att_v": draw(h, scale=0.5),
        "out": draw(2 * h, scale=(2 * h) ** -0.5),
        "out_b": np.zeros(1, np.float32),
    }


def add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """``out[at] += rows`` where ``at`` names some rows several times."""
    if not len(at):
        return
    order = np.argsort(at, kind="stable")
    named = at[order]
    starts = np.flatnonzero(np.concatenate([[True], named[1:] != named[:-1]]))
    out[named[starts]] += np.add.reduceat(rows[order], starts, axis=0)


def gates_of_words(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Input part of the gates per distinct word and direction: (2, words, 3 * hidden)."""
    return np.matmul(x[None], w["in"]) + w["in_b"]


def forward(w: dict[str, np.ndarray], gates: np.ndarray, ids: np.ndarray, mask: np.ndarray | None, keep: bool = False):
    """Logits of windows. ids: (windows, steps) into ``gates``; mask: (windows, steps), False beyond a short text."""
    n, steps = ids.shape
    h = w["rec"].shape[1]
    both = np.stack([ids, ids[:, ::-1]])
    masks = None if mask is None else np.stack([mask, mask[:, ::-1]])
    state = np.zeros((2, n, h), gates.dtype)
    states = np.empty((steps, 2, n, h), gates.dtype)
    tape = []
    for t in range(steps):
        x = np.stack([gates[0].take(both[0, :, t], axis=0), gates[1].take(both[1, :, t], axis=0)])
        u = np.matmul(state, w["rec"])
        rz = sigmoid(x[..., : 2 * h] + u[..., : 2 * h])
        r, z = rz[..., :h], rz[..., h:]
        un = u[..., 2 * h :] + w["rec_b"]
        c = np.tanh(x[..., 2 * h :] + r * un)
        new = c + z * (state - c)
        if masks is not None:
            new = np.where(masks[:, :, t, None], new, state)
        if keep:
            tape.append((state, r, z, un, c))
        state = new
        states[t] = new
    joined = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1)  # (steps, n, 2h)
    hidden = np.tanh(joined @ w["att"] + w["att_b"])
    energy = hidden @ w["att_v"]
    if mask is not None:
        energy = np.where(mask.T, energy, np.float32(-1e9))
    energy = np.exp(energy - energy.max(axis=0))
    share = energy / energy.sum(axis=0)
    pooled = (share[..., None] * joined).sum(axis=0)
    logits = pooled @ w["out"] + w["out_b"]
    return (logits, (both, masks, tape, joined, hidden, share, pooled)) if keep else logits


def backward(w: dict[str, np.ndarray], gates: np.ndarray, saved, d_logits: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the weights above the word inputs, and of ``gates``."""
    both, masks, tape, joined, hidden, share, pooled = saved
    h = w["rec"].shape[1]
    g = {k: np.zeros_like(w[k]) for k in ("rec", "rec_b", "att", "att_b", "att_v", "out", "out_b")}
    g["out"], g["out_b"][0] = pooled.T @ d_logits, d_logits.sum()
    d_pooled = d_logits[:, None] * w["out"]
    d_joined = share[..., None] * d_pooled
    d_share = (joined * d_pooled).sum(axis=-1)
    d_energy = share * (d_share - (share * d_share).sum(axis=0))
    g["att_v"] = np.einsum("tn,tnh->h", d_energy, hidden)
    d_pre = d_energy[..., None] * w["att_v"] * (1 - hidden**2)
    g["att"], g["att_b"] = np.einsum("tnk,tnh->kh", joined, d_pre), d_pre.sum(axis=(0, 1))
    d_joined = d_joined + d_pre @ w["att"].T
    d_states = np.stack([d_joined[..., :h], d_joined[::-1, :, h:]], axis=1)  # (steps, 2, n, h)
    d_gates = np.zeros_like(gates)
    d_state = np.zeros_like(d_states[0])
    d_inputs = np.empty((len(tape), *d_state.shape[:2], 3 * h), gates.dtype)
    for t in range(len(tape) - 1, -1, -1):
        state, r, z, un, c = tape[t]
        d_new = d_state + d_states[t]
        passed = 0.0
        if masks is not None:
            m = masks[:, :, t, None]
            passed, d_new = np.where(m, 0, d_new), np.where(m, d_new, 0)
        d_z = d_new * (state - c) * z * (1 - z)
        d_c = d_new * (1 - z) * (1 - c**2)
        d_r = d_c * un * r * (1 - r)
        d_un = d_c * r
        d_u = np.concatenate([d_r, d_z, d_un], axis=-1)
        d_x = np.concatenate([d_r, d_z, d_c], axis=-1)
        d_inputs[t] = d_x
        g["rec"] += np.matmul(state.transpose(0, 2, 1), d_u)
        g["rec_b"] += d_un.sum(axis=1, keepdims=True)
        d_state = passed + d_new * z + np.matmul(d_u, w["rec"].transpose(0, 2, 1))
    for k in range(2):
        add_rows(d_gates[k], both[k].T.ravel(), d_inputs[:, k].reshape(-1, 3 * h))
    return g, d_gates


def window_starts(lengths: np.ndarray, window: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of the windows that cover every word of texts of these lengths; the last ends with the text."""
    counts = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - window) // stride)), 0)
    text = np.repeat(np.arange(len(lengths)), counts)
    k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return text, np.minimum(k * stride, np.maximum(lengths[text] - window, 0))


def window_ids(ids: np.ndarray, offsets: np.ndarray, text: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.diff(offsets)
    at = (offsets[:-1][text] + first)[:, None] + np.arange(window)
    mask = first[:, None] + np.arange(window) < lengths[text][:, None]
    return ids[np.minimum(at, len(ids) - 1)], mask


def scores_of(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: the worst window's logit (-inf without words), its first word, and the number of windows."""
    ids, offsets, uniq = textops.words(texts)
    n = len(offsets) - 1
    worst, where = np.full(n, -np.inf, np.float32), np.zeros(n, np.int64)
    text, first = window_starts(np.diff(offsets), model.window, model.stride)
    if len(text):
        w = model.weights
        x = np.concatenate([w["word"][word_index(uniq, model.vocabulary)], char_means(w["char"], *char_rows(uniq))], axis=1)
        gates = gates_of_words(w, x)
        short = np.diff(offsets)[text] < model.window
        logits = np.empty(len(text), np.float32)
        for part in (np.flatnonzero(~short), np.flatnonzero(short)):
            for a in range(0, len(part), SIDE_BY_SIDE):
                some = part[a : a + SIDE_BY_SIDE]
                own, mask = window_ids(ids, offsets, text[some], first[some], model.window)
                logits[some] = forward(w, gates, own, mask if short[some[0]] else None)
        np.maximum.at(worst, text, logits)
        hit = np.flatnonzero(logits == worst[text])[::-1]
        where[text[hit]] = first[hit]  # the first of equals stays
    return worst, where, np.bincount(text, minlength=n)


def rank(w: dict[str, np.ndarray], index: np.ndarray, buckets: np.ndarray, bounds: np.ndarray, ids: np.ndarray, offsets: np.ndarray, text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The windows text by text, the highest score first."""
    x = np.concatenate([w["word"][index], char_means(w["char"], buckets, bounds)], axis=1)
    gates = gates_of_words(w, x)
    z = np.concatenate([forward(w, gates, *window_ids(ids, offsets, text[a : a + SIDE_BY_SIDE], first[a : a + SIDE_BY_SIDE], WINDOW)) for a in range(0, len(text), SIDE_BY_SIDE)])
    return np.lexsort((-z, text))


def teach(w: dict[str, np.ndarray], moments: dict, own: np.ndarray, mask: np.ndarray, y: np.ndarray, index: np.ndarray, buckets: np.ndarray, bounds: np.ndarray, rng: np.random.Generator, step: int, rate: float = 0.01) -> None:
    """One gradient step on the windows ``own`` with labels ``y``."""
    used, local = np.unique(own, return_inverse=True)
    local = local.reshape(own.shape)
    vid = np.where(rng.random(len(used)) < 0.3, 0, index[used])  # word dropout: the letters must tell as well
    n = np.diff(bounds)[used]
    rows = np.concatenate([buckets[bounds[u] : bounds[u + 1]] for u in used])
    starts = np.concatenate([[0], np.cumsum(n)])
    x = np.concatenate([w["word"][vid], char_means(w["char"], rows, starts)], axis=1)
    gates = gates_of_words(w, x)
    logits, saved = forward(w, gates, local, mask, keep=True)
    d = (sigmoid(logits) - y) / BATCH
    g, d_gates = backward(w, gates, saved, d.astype(np.float32))
    g["in"] = np.matmul(x.T[None], d_gates)
    g["in_b"] = d_gates.sum(axis=1, keepdims=True)
    d_x = np.matmul(d_gates, w["in"].transpose(0, 2, 1)).sum(axis=0)
    g["word"], g["char"] = np.zeros_like(w["word"]), np.zeros_like(w["char"])
    add_rows(g["word"], vid, d_x[:, :WORD_SIZE])
    add_rows(g["char"], rows, np.repeat(d_x[:, WORD_SIZE:] / np.maximum(n, 1)[:, None], n, axis=0))
    adam(w, g, moments, step, rate)


def train(texts: list[str], toxic: list[int], seed: int = 3, steps: int = STEPS, vocabulary: dict[str, int] | None = None) -> Model | None:
    """Fit on labelled texts; None if either label has fewer than two.

    With a vocabulary, all texts teach, one of either label is enough, and no threshold is set.
    """
    y_all = np.asarray(toxic)
    whole = vocabulary is not None
    if min((y_all == 1).sum(), (y_all == 0).sum()) < 2 - whole:
        return None
    rng = np.random.default_rng(seed)
    ids, offsets, uniq = textops.words(pa.array(texts, pa.string()))
    cores = [u.strip(TRIM) for u in uniq]
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    held = rng.random(len(texts)) < 0.3
    for label in (0, 1):  # either label on both sides
        own = np.flatnonzero(y_all == label)
        held[own[0]], held[own[-1 if whole else 1]] = False, True
    held &= not whole
    core_names = {c: i for i, c in enumerate(dict.fromkeys(cores))}
    core_of = np.array([core_names[c] for c in cores], dtype=np.int64)
    fit_words = ~held[owner]
    pairs = np.unique(owner[fit_words] * len(core_names) + core_of[ids[fit_words]])
    spread = np.bincount(pairs % len(core_names), minlength=len(core_names))
    least = COMMON * (~held).sum()
    if not whole:
        vocabulary = {c: k + 1 for k, c in enumerate(c for c, i in core_names.items() if c and spread[i] >= least)}
    index = word_index(uniq, vocabulary)
    buckets, bounds = char_rows(uniq)
    w = initial(len(vocabulary) + 1, seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    model = Model(vocabulary, w, np.inf)
    text, first = window_starts(np.diff(offsets), WINDOW, STRIDE)
    count = np.bincount(text, minlength=len(texts))
    begins = np.cumsum(count) - count
    ranked, teaches = np.arange(len(text)), count
    sides = [np.flatnonzero(~held & (y_all == label) & (count > 0)) for label in (0, 1)]
    if not all(map(len, sides)):
        return None
    y = np.repeat(np.array([0, 1], np.float32), BATCH // 2)
    for step in range(steps):
        if step and step % REFRESH == 0:
            ranked = rank(w, index, buckets, bounds, ids, offsets, text, first)
            teaches = np.maximum(1, count // np.where(y_all == 1, 3, 2))
        share = np.cumsum(teaches[sides[0]])
        clean = sides[0][np.searchsorted(share, rng.integers(0, share[-1], BATCH // 2), side="right")]
        chosen = np.concatenate([clean, rng.choice(sides[1], BATCH // 2)])
        some = ranked[begins[chosen] + (rng.random(BATCH) * teaches[chosen]).astype(np.int64)]
        own, mask = window_ids(ids, offsets, text[some], first[some], WINDOW)
        teach(w, moments, own, mask, y, index, buckets, bounds, rng, step + 1)
    if whole:
        return model
    logits = scores_of(pa.array(texts, pa.string()), model)[0]
    model.threshold = choose_threshold(logits[held & (y_all == 0)], logits[held & (y_all == 1)], logits[~held & (y_all == 0)])
    return model


def adam(w: dict, g: dict, moments: dict, step: int, rate: float = 0.01) -> None:
    for k, d in g.items():
        m, v = moments[k]
        m += 0.1 * (d - m)
        v += 0.01 * (d * d - v)
        w[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)


def choose_threshold(clean: np.ndarray, toxic: np.ndarray, clean_fitted: np.ndarray) -> float:
    """The logit that parts the held-out documents best, false alarms counting threefold; then the middle of the gap."""
    clean, toxic = np.where(np.isfinite(clean), clean, -30), np.where(np.isfinite(toxic), toxic, -30)
    cuts = np.unique(np.concatenate([clean, toxic]))
    cost = [3 * (clean >= c).mean() + (toxic < c).mean() for c in cuts]
    best = cuts[int(np.argmin(cost))]
    below = max([*clean[clean < best], -30.0])
    return float(max((best + below) / 2, 0.0))


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labels that are used."""
    return labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").alias("_most")).filter("toxic = _most").select("doc_id", "toxic")


def sample(docs: DataFrame, labels: DataFrame, bounds: tuple[int, int] = SAMPLE) -> tuple[list[str], list[int]]:
    """At most ``bounds`` labelled documents, toxic and clean, those with the least hash of doc_id."""
    return first_of(labelled(docs, known_labels(labels)), bounds)


def labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, toxic, text) of all labelled documents; only rows that may be labelled are shuffled."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    return texts.filter(bloom.may_hold(bloom.build(known.select("doc_id")), F.col("doc_id"))).join(known, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def first_of(rows: DataFrame, bounds: tuple[int, int]) -> tuple[list[str], list[int]]:
    """At most ``bounds`` rows of ``labelled``, toxic and clean, those with the least hash of doc_id."""
    found = []
    for label, bound in ((1, bounds[0]), (0, bounds[1])):
        ids = rows.filter(F.col("toxic") == label).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        found += [tuple(r) for r in rows.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "toxic", "text").collect()]
    found.sort()
    return [t for _, _, t in found], [y for _, y, _ in found]


def count_words(rows: DataFrame, total: int) -> dict[str, int]:
    """The vocabulary: words that the share ``COMMON`` of all ``total`` rows has, numbered from 1."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, offsets, uniq = textops.words(batch.column("text"))
        names: dict[str, int] = {}
        core_of = np.array([names.setdefault(u.strip(TRIM), len(names)) for u in uniq], dtype=np.int64)
        pairs = np.unique(np.repeat(np.arange(batch.num_rows), np.diff(offsets)) * max(1, len(names)) + core_of[ids])
        counts = np.bincount(pairs % max(1, len(names)), minlength=len(names))
        return pa.RecordBatch.from_arrays([pa.array(list(names), pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

    counts = rows.select("text").mapInArrow(textops.map_slices(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    common = counts.filter((F.col("word") != "") & (F.col("n") >= COMMON * total)).select("word").collect()
    return {w: k + 1 for k, w in enumerate(sorted(r["word"] for r in common))}


def go_on(texts: pa.Array, y: np.ndarray, model: Model, moments: dict, rng: np.random.Generator, step: int) -> int:
    """Teach ``model`` by every text that has words, at least once each; the number of steps so far."""
    w = model.weights
    ids, offsets, uniq = textops.words(texts)
    text, first = window_starts(np.diff(offsets), WINDOW, STRIDE)
    if not len(text):
        return step
    index = word_index(uniq, model.vocabulary)
    buckets, bounds = char_rows(uniq)
    ranked = rank(w, index, buckets, bounds, ids, offsets, text, first)
    count = np.bincount(text, minlength=len(texts))
    begins = np.cumsum(count) - count
    teaches = np.maximum(1, count // np.where(y == 1, 3, 2))
    half = BATCH // 2
    sides = [rng.permutation(side) for label in (0, 1) if len(side := np.flatnonzero((y == label) & (count > 0)))]
    for k in range(max(-(-len(side) // half) for side in sides)):
        chosen = np.concatenate([side[(k * half + np.arange(half)) % len(side)] for side in sides])
        some = ranked[begins[chosen] + (rng.random(len(chosen)) * teaches[chosen]).astype(np.int64)]
        own, mask = window_ids(ids, offsets, text[some], first[some], WINDOW)
        step += 1
        teach(w, moments, own, mask, y[chosen].astype(np.float32), index, buckets, bounds, rng, step, SHARD_RATE)
    return step


def teach_shards(rows: DataFrame, total: int, model: Model) -> Model:
    """The mean of the models that the shards of ``rows`` make of ``model``, weighed by their documents."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    table = "block int, shard int, n long, part binary"

    def run(batches):
        start = shared.value
        own = Model(start.vocabulary, {k: v.copy() for k, v in start.weights.items()}, np.inf)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in own.weights.items()}
        shard, n, step = TaskContext.get().partitionId(), 0, 0
        rng = np.random.default_rng(shard)
        for batch in textops.slices(batches):
            step = go_on(batch.column("text"), batch.column("toxic").to_numpy(), own, moments, rng, step)
            n += batch.num_rows
        if n:
            parts = np.array_split(np.concatenate([v.ravel() for v in own.weights.values()]), BLOCKS)
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([shard] * BLOCKS, pa.int32()), pa.array([n] * BLOCKS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "shard", "n", "part"])
        textops.release()

    def mean(parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("shard")
        n = parts.column("n").to_numpy()
        whole = sum(k * np.frombuffer(p, np.float32).astype(np.float64) for k, p in zip(n.tolist(), parts.column("part").to_pylist())) / n.sum()
        return pa.table({"block": pa.array([parts.column("block")[0].as_py()], pa.int32()), "part": pa.array([whole.astype(np.float32).tobytes()], pa.binary())})

    place = F.xxhash64("doc_id")
    shards = rows.select("doc_id", "toxic", "text").repartition(-(-total // SHARD), "doc_id").sortWithinPartitions(place, "doc_id")
    found = shards.mapInArrow(run, table).groupBy("block").applyInArrow(mean, "block int, part binary").collect()
    flat = np.concatenate([np.frombuffer(r["part"], np.float32) for r in sorted(found, key=lambda r: r["block"])])
    ends = np.cumsum([v.size for v in model.weights.values()])
    weights = {k: p.reshape(v.shape) for (k, v), p in zip(model.weights.items(), np.split(flat, ends[:-1]))}
    return Model(model.vocabulary, weights, np.inf)


def count_logits(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """How many of all rows, clean and toxic, have their worst window in each cell of ``GRAIN``: (cells, counts by label)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        logit = scores_of(batch.column("text"), shared.value)[0].astype(np.float64)
        cell = np.rint(np.clip(logit, -30, 30) / GRAIN).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(cell), batch.column("toxic")], ["cell", "toxic"])

    found = rows.select("text", "toxic").mapInArrow(textops.map_slices(run), "cell int, toxic int").groupBy("cell", "toxic").count().collect()
    cells = np.unique([r["cell"] for r in found])
    counts = np.zeros((len(cells), 2), np.int64)
    for r in found:
        counts[np.searchsorted(cells, r["cell"]), r["toxic"]] = r["count"]
    return cells, counts


def threshold_of(cells: np.ndarray, counts: np.ndarray) -> float:
    """``choose_threshold`` for counted logits."""
    before = np.cumsum(counts, axis=0) - counts
    total = counts.sum(axis=0)
    best = int(np.argmin(3 * (total[0] - before[:, 0]) / total[0] + before[:, 1] / total[1]))
    below = max([*(cells[:best][counts[:best, 0] > 0] * GRAIN), -30.0])
    return float(max((cells[best] * GRAIN + below) / 2, 0.0))


def fitted(docs: DataFrame, labels: DataFrame, bounds: tuple[int, int] = SAMPLE) -> Model | None:
    known = materialise(known_labels(labels), "labels")
    rows = materialise(labelled(docs, known).filter(F.col("text").rlike(r"[^ \t\n\x0B\f\r]")), "labelled")
    try:
        ends = [[r["doc_id"] for r in rows.filter(F.col("toxic") == label).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2).collect()] for label in (0, 1)]
        if min(map(len, ends)) < 2:
            return None
        # either label on both sides
        held = F.when(F.col("doc_id").isin([e[0] for e in ends]), False).when(F.col("doc_id").isin([e[1] for e in ends]), True).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(10)) < HELD)
        fit = rows.filter(~held)
        total = fit.count()
        model = train(*first_of(fit, bounds), vocabulary=count_words(fit, total))
        if model is None:
            return None
        model = teach_shards(fit, total, model)
        model.threshold = threshold_of(*count_logits(rows.filter(held), model))
        return model
    finally:
        discard(rows)
        discard(known)


def _columns(batch: pa.RecordBatch, model: Model | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if model is None:
        n = batch.num_rows
        return np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    logit, where, windows = scores_of(batch.column("text"), model)
    some = windows > 0
    value = np.where(some, sigmoid(np.where(some, logit, 0).astype(np.float64)), 0.0)
    return value, where, windows, some & (logit >= model.threshold)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score (probability of the worst window), worst_word (its first word's position), n_windows, toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        value, where, windows, bad = _columns(batch, shared.value)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value), pa.array(where), pa.array(windows, pa.int64()), pa.array(bad)], ["doc_id", "score", "worst_word", "n_windows", "toxic"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(textops.map_slices(run), "doc_id long, score double, worst_word long, n_windows long, toxic boolean")


def keep_clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(~_columns(batch, shared.value)[3]))

    return docs.mapInArrow(textops.map_slices(run), docs.schema)
