"""Operator 4, language identification of mixed-language text.

Units are white-space words, cut around every letter of a script that puts no
spaces between words (Han, kana, Thai and others), so mixed text is parted
there as well.

1. The script of a unit's letters, by Unicode range, narrows the candidates: to
   the fitted languages that are written in it, else to the languages that
   ``ALPHABETS`` lists for it.  Letters of no listed script leave only ``und``.
2. Each unit gets a score per candidate.  Of fitted languages it is the
   log-likelihood of its letter trigrams (ends included) under the language's
   smoothed counts; ``und`` scores every trigram as uniform over those that
   training saw.  Of others it counts the letters that the language's alphabet
   lacks, and prefers the languages listed first by a little.
3. Viterbi over the units of the whole text, with a fixed penalty for every
   change of language, labels the units; runs of one label are the spans.

The languages are those of the ``lang`` column, the ``LANGUAGES`` most frequent if
there are more; the counts are fitted on a bounded sample: of each language the
``SAMPLE`` documents with the least hash of doc_id, each once, with its least
text if it has several.

Defined results: units without letters carry no evidence and follow their
neighbours; a text that is null, blank or free of letters has lang ``und`` and
no spans and is rejected; ties go to the earlier language in the order of the
codes, ``und`` last; equal rows get equal results; without a ``lang`` column or
any labelled row nothing is rejected for being ``und``; empty tables give empty
results; other columns are ignored by ``identify`` and passed through by
``keep_identified``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lathe.llm import textops

#: Languages that a model is fitted for (a bound on the model, the most frequent of the labels).
LANGUAGES = 64
#: Labelled documents per language that the model is fitted on (a bound, not a share).
SAMPLE = 200
SWITCH = 12.0
#: A document is rejected when more than this share of its lettered words is ``und``.
MAX_UND = 0.5
BUCKETS = 1 << 16
#: Units that Viterbi goes through in a row; longer texts are cut and their parts run side by side, to the same path.
SEGMENT = 512
#: A fitted language is a candidate of the scripts that hold this share of its sample's letters.
WRITTEN = 0.1
#: What a letter outside the alphabet costs a language without a model, and how much a unit prefers the one listed before.
LACKING = 4.0
RANK = 0.1

#: (first, last, script), ascending.
RANGES = [
    (0x41, 0x5A, "Latin"), (0x61, 0x7A, "Latin"), (0xAA, 0xAA, "Latin"), (0xBA, 0xBA, "Latin"), (0xC0, 0xD6, "Latin"), (0xD8, 0xF6, "Latin"), (0xF8, 0x24F, "Latin"),
    (0x250, 0x2AF, "Latin"), (0x370, 0x3FF, "Greek"), (0x400, 0x52F, "Cyrillic"), (0x531, 0x58F, "Armenian"), (0x5D0, 0x5F2, "Hebrew"), (0x620, 0x64A, "Arabic"),
    (0x66E, 0x6D3, "Arabic"), (0x6FA, 0x77F, "Arabic"), (0x900, 0x963, "Devanagari"), (0x980, 0x9E3, "Bengali"), (0xB80, 0xBE5, "Tamil"), (0xE01, 0xE4E, "Thai"),
    (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"), (0x3041, 0x30FF, "Kana"), (0x3400, 0x4DBF, "Han"),
    (0x4E00, 0x9FFF, "Han"), (0xAC00, 0xD7A3, "Hangul"), (0xFF66, 0xFF9D, "Kana"), (0x20000, 0x323AF, "Han"),
]
#: Of every script without a fitted language: its languages, the most common first, and the letters that each lacks.
ALPHABETS: dict[str, tuple[tuple[str, str], ...]] = {
    "Latin": (),
    "Greek": (("el", ""),),
    "Cyrillic": (
        ("ru", "іїєґўђћљњџјѓќѕә"), ("uk", "ыэёъўђћљњџјѓќѕә"), ("bg", "ыэёіїєґўђћљњџјѓќѕә"), ("sr", "ыэёъьщюяйіїєґўѓќѕә"), ("be", "їєґиъщђћљњџјѓќѕә"), ("mk", "ыэёъьщюяйіїєґўђћә"), ("kk", "їєґўђћљњџјѓќѕ"),
    ),
    "Armenian": (("hy", ""),),
    "Hebrew": (("he", ""),),
    "Arabic": (("ar", "پچژگٹڈڑںےھہکیۀۆێڕڵ"), ("fa", "ٹڈڑںےھہةيكىۆێڕڵ"), ("ur", "ةيكىۆێڕڵ"), ("ckb", "ٹڈڑںےةيكى")),
    "Devanagari": (("hi", "ळ"), ("mr", "")),
    "Bengali": (("bn", "ৰৱ"), ("as", "র")),
    "Tamil": (("ta", ""),),
    "Thai": (("th", ""),),
    "Georgian": (("ka", ""),),
    "Hangul": (("ko", ""),),
    "Kana": (("ja", ""),),
    "Han": (("zh", ""), ("ja", "")),
}
SCRIPTS = ["none", *ALPHABETS]
_FIRST = np.array([a for a, _, _ in RANGES])
_LAST = np.array([b for _, b, _ in RANGES])
_SCRIPT = np.array([SCRIPTS.index(s) for _, _, s in RANGES])
#: A score that no path takes if there is another.
NEVER = np.float32(-1e4)


def scripts_of(points: np.ndarray) -> np.ndarray:
    """Index in SCRIPTS per code point; 0 for what is no letter of a listed script."""
    at = np.maximum(np.searchsorted(_FIRST, points, side="right") - 1, 0)
    inside = (points >= _FIRST[at]) & (points <= _LAST[at])
    return np.where(inside, _SCRIPT[at], 0)


def letters(uniq: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct words: the trigram buckets, their bounds per word, and each word's script (that of its most letters; the first listed on ties)."""
    joined = "\x00" + "\x00".join(uniq) + "\x00"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    script = scripts_of(points)
    mark = points == 0
    word = np.cumsum(mark) - 1  # of a mark: the word after it
    keep = mark | (script > 0)
    n = len(uniq)
    votes = np.bincount(word[script > 0] * len(SCRIPTS) + script[script > 0], minlength=n * len(SCRIPTS))[: n * len(SCRIPTS)].reshape(n, len(SCRIPTS)) if n else np.zeros((0, len(SCRIPTS)), int)
    points, word, mark = points[keep], word[keep], mark[keep]
    # trigram around every letter: before, letter, after
    at = np.flatnonzero(~mark)
    with np.errstate(over="ignore"):
        h = points[at - 1].astype(np.uint64) * np.uint64(textops.MULTIPLIERS[0]) + points[at].astype(np.uint64) * np.uint64(textops.MULTIPLIERS[1]) + points[at + 1].astype(np.uint64) * np.uint64(textops.MULTIPLIERS[2])
    buckets = (textops.mix(h) >> np.uint64(48)).astype(np.int64)
    counts = np.bincount(word[at], minlength=n)[:n]
    return buckets, np.concatenate([[0], np.cumsum(counts)]), np.where(votes.any(axis=1), votes.argmax(axis=1), 0)


@dataclass
class Model:
    languages: tuple[str, ...]
    #: log-probabilities, (BUCKETS, languages)
    table: np.ndarray
    #: log-probability of any trigram under ``und``
    und: float
    #: the fitted languages of each script
    written: dict[str, tuple[str, ...]]
    switch: float = SWITCH
    max_und: float = MAX_UND


def fit(samples: dict[str, list[str]], switch: float = SWITCH, max_und: float = MAX_UND) -> Model:
    """Trigram counts with add-half smoothing; languages without letters in their sample are left out."""
    langs, rows = [], []
    written: dict[str, tuple[str, ...]] = {}
    for lang in sorted(samples):
        ids, _, uniq = textops.units(*textops.words(pa.array(samples[lang], pa.string())))
        if not len(ids):
            continue
        buckets, starts, script = letters(uniq)
        times, n = np.bincount(ids, minlength=len(uniq)), np.diff(starts)
        counts = np.bincount(buckets, weights=np.repeat(times, n), minlength=BUCKETS)
        if counts.sum():
            langs.append(lang)
            rows.append(counts)
            by_script = np.bincount(script, weights=times * n, minlength=len(SCRIPTS))
            for k in np.flatnonzero(by_script >= WRITTEN * by_script.sum()).tolist():
                if k:
                    written[SCRIPTS[k]] = (*written.get(SCRIPTS[k], ()), lang)
    seen = int((np.sum(rows, axis=0) > 0).sum()) if rows else 1
    logs = [np.log((c + 0.5) / (c.sum() + 0.5 * (seen + 1))) for c in rows]
    table = np.stack(logs, axis=1).astype(np.float32) if rows else np.zeros((BUCKETS, 0), np.float32)
    return Model(tuple(langs), table, -float(np.log(seen)), written, switch, max_und)


def lacking(uniq: list[str], letters_: str) -> np.ndarray:
    """How many of each unit's letters are among ``letters_``."""
    joined = "\x00" + "\x00".join(uniq)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.bincount((np.cumsum(points == 0) - 1)[np.isin(points, [ord(c) for c in letters_])], minlength=len(uniq))


def word_scores(uniq: list[str], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(labels, scores (units, labels), whether the unit has letters)."""
    buckets, starts, script = letters(uniq)
    present = [SCRIPTS[s] for s in np.unique(script) if s]
    listed = {lang for name in present if name not in model.written for lang, _ in ALPHABETS[name]}
    labels = sorted({*model.languages, *listed}) + ["und"]
    n = np.diff(starts)
    scores = np.full((len(uniq), len(labels)), NEVER, dtype=np.float32)
    sums = np.zeros((len(uniq), len(model.languages)), np.float32)
    some = n > 0
    if model.languages and some.any():
        sums[some] = np.add.reduceat(model.table[buckets], starts[:-1][some], axis=0)
    for name in present:
        of = np.flatnonzero(script == SCRIPTS.index(name))
        fitted_, scale = model.written.get(name, ()), np.float32(model.und)
        for lang in fitted_:
            scores[of, labels.index(lang)] = sums[of, model.languages.index(lang)]
        if not fitted_:
            chosen = [uniq[i] for i in of.tolist()]
            # letters of one word in the script of another language are the rule where scripts have no spaces
            rank = 5 * RANK if name == "Han" else RANK
            for k, (lang, lacks) in enumerate(ALPHABETS[name]):
                scores[of, labels.index(lang)] = -LACKING * lacking(chosen, lacks) - rank * k
        scores[of, -1] = n[of] * scale if fitted_ or not ALPHABETS[name] else NEVER / 2
    scores[script == 0] = 0
    return labels, scores, script > 0


def viterbi(scores: np.ndarray, offsets: np.ndarray, switch: float, segment: int = SEGMENT) -> np.ndarray:
    """Best label per unit of each text under the switching penalty.

    Texts are cut into segments that advance together, so a step is a few numpy
    calls over all of them.  The state at the start of each segment comes from
    the segments' transfer matrices (best score from every label before to every
    label at the end), so the path is that of one pass over the whole text.
    Staying is preferred to an equally good change, and the lower label to an
    equally good higher one.
    """
    lengths = np.diff(offsets)
    labels = scores.shape[1]
    pieces = -(-lengths // segment)
    text = np.repeat(np.arange(len(lengths)), pieces)
    first = np.cumsum(pieces) - pieces
    k = np.arange(len(text)) - first[text]
    starts = offsets[:-1][text] + k * segment
    sizes = np.minimum(lengths[text] - k * segment, segment)
    last = k == pieces[text] - 1
    entry = np.zeros((len(text), labels), np.float64)  # equal for all labels: a beginning
    inner = np.flatnonzero(~last)
    if len(inner):
        every = np.where(np.eye(labels, dtype=bool), 0.0, -1e9)
        transfer = np.empty((len(text), labels, labels))
        ends = _forward(scores, np.repeat(starts[inner], labels), np.repeat(sizes[inner], labels), np.tile(every, (len(inner), 1)), switch)[0]
        transfer[inner] = ends.reshape(len(inner), labels, labels)
        for step in range(1, int(pieces.max())):
            now = first[pieces > step] + step
            came = (entry[now - 1][:, :, None] + transfer[now - 1]).max(axis=1)
            entry[now] = came - came.max(axis=1, keepdims=True)
    final, changed, source = _forward(scores, starts, sizes, entry, switch, keep=True)
    label = final.argmax(axis=1)
    if len(inner):
        # the label before a segment for every label at its end, then from the last segment of a text to its first
        before = np.empty((len(text), labels), np.int64)
        later = np.flatnonzero(k > 0)
        before[later] = _back(np.repeat(starts[later], labels), np.repeat(sizes[later], labels), np.tile(np.arange(labels), len(later)), changed, source).reshape(-1, labels)
        for step in range(int(pieces.max()) - 1, 0, -1):
            now = first[pieces > step] + step
            label[now - 1] = before[now, label[now]]
    path = np.zeros(len(scores), np.uint8)
    _back(starts, sizes, label, changed, source, path)
    return path


def _lanes(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes by falling size, and how many of them have a step t."""
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max(initial=0))
    return order, np.searchsorted(-sizes[order], -np.arange(1, longest + 1), side="right")


def _forward(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, entry: np.ndarray, switch: float, keep: bool = False):
    """The states at the ends of lanes; with ``keep`` also, for every unit, which labels were changed to and from which."""
    order, active = _lanes(sizes)
    starts, state = starts[order], entry[order].copy()
    changed = np.zeros(scores.shape, dtype=bool) if keep else None
    source = np.zeros(len(scores), dtype=np.uint8) if keep else None
    for t, n in enumerate(active.tolist()):
        at, now = starts[:n] + t, state[:n]
        top = now.max(axis=1, keepdims=True) - switch
        if keep:
            changed[at] = top > now
            source[at] = now.argmax(axis=1)
        state[:n] = np.maximum(now, top) + scores[at]
    out = np.empty_like(state)
    out[order] = state
    return out, changed, source


def _back(starts: np.ndarray, sizes: np.ndarray, label: np.ndarray, changed: np.ndarray, source: np.ndarray, path: np.ndarray | None = None) -> np.ndarray:
    """The labels before lanes that end with ``label``; fills ``path`` if it is given."""
    order, active = _lanes(sizes)
    starts, label = starts[order], label[order].astype(np.int64)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at, now = starts[:n] + t, label[:n]
        if path is not None:
            path[at] = now
        label[:n] = np.where(changed[at, now], source[at], now)
    out = np.empty_like(label)
    out[order] = label
    return out


def label_texts(texts: pa.Array, model: Model) -> dict[str, pa.Array]:
    """Arrow columns lang, share, n_words, spans, keep for an array of texts."""
    ids, offsets, uniq = textops.units(*textops.words(texts))
    labels, scores, lettered = word_scores(uniq, model)
    n = len(offsets) - 1
    path = viterbi(scores[ids], offsets, model.switch).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    real = lettered[ids] if len(ids) else np.zeros(0, bool)
    tally = np.bincount(owner[real] * len(labels) + path[real], minlength=n * len(labels)).reshape(n, len(labels))
    words = tally.sum(axis=1)
    main = np.where(words > 0, tally.argmax(axis=1), len(labels) - 1)
    share = np.where(words > 0, tally[np.arange(n), main] / np.maximum(words, 1), 0.0)
    und = np.where(words > 0, tally[:, -1] / np.maximum(words, 1), 1.0)
    keep = und <= model.max_und if model.languages else words > 0
    # a span begins where the text or the label changes; texts without letters have none
    shown = np.repeat(words > 0, np.diff(offsets))
    begins = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (path[1:] != path[:-1])]) & shown) if len(ids) else np.zeros(0, np.int64)
    ends = np.concatenate([begins[1:], [len(ids)]]) if len(begins) else begins
    ends = np.minimum(ends, offsets[1:][owner[begins]]) if len(begins) else ends
    names = pa.array(labels)
    spans = pa.StructArray.from_arrays(
        [names.take(pa.array(path[begins])), pa.array((begins - offsets[owner[begins]]).astype(np.int32)), pa.array((ends - begins).astype(np.int32))],
        fields=[pa.field("lang", pa.string()), pa.field("first_word", pa.int32()), pa.field("n_words", pa.int32())],
    )
    per_text = np.concatenate([[0], np.cumsum(np.bincount(owner[begins], minlength=n))]).astype(np.int32)
    return {
        "lang": names.take(pa.array(main)),
        "share": pa.array(share),
        "n_words": pa.array(np.diff(offsets), pa.int64()),
        "spans": pa.ListArray.from_arrays(pa.array(per_text), spans),
        "keep": pa.array(keep),
    }


def sample(docs: DataFrame, languages: int = LANGUAGES, bound: int = SAMPLE) -> dict[str, list[str]]:
    """Texts of at most ``bound`` labelled documents of each language: those with the least hash of doc_id, each once."""
    if "lang" not in docs.columns:
        return {}
    lang = F.col("lang").cast("string")
    labelled = docs.filter(lang.isNotNull() & (lang != "und") & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(lang.alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = labelled.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.05).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not found:
        return {}
    # uniform hash in [0, 2^31): of about twice as many documents as wanted the ids are looked at, then cut exactly
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    share = F.lit(False)
    for r in found:
        share = share | ((F.col("lang") == r["lang"]) & (place <= int(min(1.0, (2 * bound + 100) / max(r["n"], 1)) * (1 << 31))))
    ranked = labelled.filter(share).select("lang", place.alias("_place"), "doc_id").distinct()
    first = Window.partitionBy("lang").orderBy("_place", "doc_id")
    chosen = ranked.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= bound).select("lang", "doc_id", "_n").collect()
    wanted = docs.sparkSession.createDataFrame(chosen, "lang string, doc_id long, _n int")
    texts = labelled.join(F.broadcast(wanted), ["lang", "doc_id"]).groupBy("lang", "_n").agg(F.min("text").alias("text")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(texts, key=lambda r: (r["lang"], r["_n"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang (of most lettered units), share, n_words (units), spans, keep."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = label_texts(batch.column("text"), shared.value)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns.values()], ["doc_id", *columns])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(textops.map_slices(run), "doc_id long, lang string, share double, n_words long, spans array<struct<lang: string, first_word: int, n_words: int>>, keep boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(label_texts(batch.column("text"), shared.value)["keep"])

    return docs.mapInArrow(textops.map_slices(run), docs.schema)


def fitted(docs: DataFrame, languages: int = LANGUAGES, bound: int = SAMPLE) -> Model:
    return fit(sample(docs, languages, bound))
