"""Operator 2, tokenizer fertility as a quality rule.

Public vocabularies measure each whole text: characters per token of a
byte-level vocabulary and of a piece vocabulary, the share of byte-fallback
tokens of the latter, and the entropy of its tokens in bits.  Documents are
grouped by language (the ``lang`` column; where it is null, the script of most
letters).  A document is judged by how far its measures lie from the centre of
its group, and a band of such distances is drawn from all documents: lower and
upper quartile widened by ``SPREAD`` times their distance.  A document outside
a band is rejected, with the names of the rules it broke.

One rule holds for every length and every size of group:

* measures of a short text are noisy by the root of its tokens, so a distance
  is multiplied by ``sqrt(n / (n + SHORT))`` before it is banded or judged, and a
  text counts ``n / (n + SHORT)`` towards the weight of its group;
* centres and quartiles of a group of weight w are averaged, ``w : FEW``, with
  those of its script, and these in the same way with those of all documents,
  so a rare language is judged by its script until it has a say of its own;
* entropy depends on length, so its centre is a line, fitted over the group in
  ``1 / sqrt(n_pieces)``, in which the entropy of running text rises to its limit
  almost straight, never above ``log2(n_pieces)``.  Few words repeated over a
  long text lie bits below it.  Evenness, ``entropy / log2(distinct)``, is high
  for such texts and is reported but not banded.

Defined results: a null or empty text has no tokens, null measures and is
rejected with rule 'empty'; equal rows get equal results; a null doc_id is
judged like any other; empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.llm import langid, textops, tokens
from lathe.storage import materialise

BYTE_LEVEL = f"{tokens.TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
PIECES = f"{tokens.TOKENIZERS}/piece_bpe_32k.model"
#: Tokens at which a text has half the weight of a very long one.
SHORT = 64
#: Weight of a group, in long texts, at which it is judged half by itself and half by its script.
FEW = 50
SPREAD = 4.0
MOST_FALLBACK = 0.5
BANDED = ("chars_per_token", "chars_per_piece", "fallback_share", "entropy")
#: Narrower bands are widened to this, so that a uniform group rejects nothing for a trifle.
LEAST_WIDTH = {"chars_per_token": 0.5, "chars_per_piece": 0.5, "fallback_share": 0.05, "entropy": 1.0}


def entropy(ids: np.ndarray) -> tuple[float, int]:
    """(bits per token, distinct tokens) of a non-empty array."""
    counts = np.unique(ids, return_counts=True)[1]
    p = counts / len(ids)
    return float(-(p * np.log2(p)).sum()), len(counts)


def measure_texts(texts: list[str | None], byte_level: str, pieces: str) -> dict[str, list]:
    bpe, sp = tokens.byte_bpe(byte_level), tokens.pieces(pieces)
    out: dict[str, list] = {k: [] for k in ("n_chars", "n_tokens", "n_pieces", "chars_per_token", "chars_per_piece", "fallback_share", "entropy", "evenness", "script")}
    encoded = sp.encode([t or "" for t in texts], num_threads=1)
    lengths = np.diff(tokens.encode_column(bpe, pa.array(texts, pa.string()))[1]).tolist()
    low, high = sp.piece_to_id("<0x00>"), sp.piece_to_id("<0xFF>")
    for text, ids, n in zip(texts, encoded, lengths):
        if not text or not ids:
            for k in out:
                out[k].append(0 if k.startswith("n_") else None)
            continue
        array = np.asarray(ids, dtype=np.int32)
        bits, distinct = entropy(array)
        out["n_chars"].append(len(text))
        out["n_tokens"].append(n)
        out["n_pieces"].append(len(ids))
        out["chars_per_token"].append(len(text) / max(n, 1))
        out["chars_per_piece"].append(len(text) / len(ids))
        out["fallback_share"].append(float(((array >= low) & (array <= high)).mean()))
        out["entropy"].append(bits)
        out["evenness"].append(bits / np.log2(distinct) if distinct > 1 else 0.0)
        out["script"].append(main_script(text))
    return out


def main_script(text: str) -> str:
    """Script of most letters of the text, the first listed on ties; 'none' without letters."""
    if text.isascii():
        return "Latin" if any(map(str.isalpha, text)) else "none"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    counts = np.bincount(langid.scripts_of(points), minlength=len(langid.SCRIPTS))
    counts[0] = 0
    return langid.SCRIPTS[int(counts.argmax())] if counts.any() else "none"


SCHEMA = "doc_id long, lang string, n_chars long, n_tokens long, n_pieces long, chars_per_token double, chars_per_piece double, fallback_share double, entropy double, evenness double, script string"


def measure(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """The measures of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = measure_texts(batch.column("text").to_pylist(), byte_level, pieces)
        kinds = {"script": pa.string()} | {k: pa.int64() for k in m if k.startswith("n_")}
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *(pa.array(v, kinds.get(k, pa.float64())) for k, v in m.items())], ["doc_id", "lang", *m])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    return kept.mapInArrow(textops.map_slices(run), SCHEMA)


#: Quartiles of distances, and the centres they are taken from.
CENTRES = tuple(m for m in BANDED if m != "entropy") + ("level", "slope")
QUARTILES = tuple(f"{m}_{side}" for m in BANDED for side in ("q1", "q3"))


def say(n: Column) -> Column:
    """The weight of a text of ``n`` tokens."""
    return n / (n + F.lit(SHORT))


def distance(m: str) -> Column:
    """How far a measure lies from its centre (the columns ``CENTRES`` with a leading _), less for a short text."""
    centre = F.col(f"_{m}") if m != "entropy" else F.least(F.greatest(F.col("_level") + F.col("_slope") / F.sqrt("n_pieces"), F.lit(0.0)), F.log2("n_pieces"))
    return (F.col(m) - centre) * F.sqrt(say(F.col("n_tokens")))


def pooled(spoken: DataFrame, figures: tuple[str, ...], of: list[Column]) -> DataFrame:
    """(grp, script, _figure, ...): figures of each group and script that occurs, averaged with those of the script and of all.

    ``of`` are the aggregates that give the figures, without names, over the texts that have tokens.
    """
    weight = F.sum(say(F.col("n_tokens"))).alias("w")
    own = [a.alias(f) for a, f in zip(of, figures)]
    levels = {"g": spoken.groupBy("grp").agg(weight, *own), "s": spoken.groupBy("script").agg(weight, *own), "a": spoken.agg(weight, *own)}
    renamed = {k: t.select(*[c for c in ("grp", "script") if c in t.columns], *[F.col(c).alias(f"{k}_{c}") for c in ("w", *figures)]) for k, t in levels.items()}
    pairs = spoken.select("grp", "script").distinct()
    # a row per group and script: broadcast if Spark finds them small, as they are
    joined = pairs.join(renamed["g"], "grp").join(renamed["s"], "script").join(F.broadcast(renamed["a"]))

    def mean(low: Column, w: str, high: Column) -> Column:
        return (F.coalesce(low, high) * F.col(w) + F.lit(FEW) * high) / (F.col(w) + F.lit(FEW))

    return joined.select("grp", "script", *[mean(F.col(f"g_{f}"), "g_w", mean(F.col(f"s_{f}"), "s_w", F.col(f"a_{f}"))).alias(f"_{f}") for f in figures])


def line() -> list[Column]:
    """Level and slope of entropy over ``1 / sqrt(n_pieces)``, each text by its weight; the slope is not above 0."""
    x, y, w = 1 / F.sqrt("n_pieces"), F.col("entropy"), say(F.col("n_tokens"))
    n, sx, sy, sxx, sxy = (F.sum(w * v) for v in (F.lit(1.0), x, y, x * x, x * y))
    spread = n * sxx - sx * sx
    slope = F.when(spread > 1e-9 * n * sxx, F.least((n * sxy - sx * sy) / spread, F.lit(0.0))).otherwise(0.0)
    return [(sy - slope * sx) / n, slope]


def bands(spoken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The centres and the quartiles of distances, by (grp, script)."""
    centres = materialise(pooled(spoken, CENTRES, [*(F.percentile_approx(m, 0.5, 10_000) for m in BANDED if m != "entropy"), *line()]), "centres")
    far = spoken.join(centres, ["grp", "script"])
    return centres, materialise(pooled(far, QUARTILES, [F.percentile_approx(distance(m), q, 10_000) for m in BANDED for q in (0.25, 0.75)]), "quartiles")


def judge(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, spread: float = SPREAD) -> DataFrame:
    """Measures of every row with grp, broken (sorted names of broken rules) and keep."""
    named = measure(docs, byte_level, pieces).withColumn("script", F.coalesce("script", F.lit("none")))
    measured = materialise(named.withColumn("grp", F.coalesce("lang", F.concat(F.lit("script:"), F.col("script")))), "fertility")
    centres, quartiles = bands(measured.filter("n_tokens > 0 AND n_pieces > 0"))
    joined = measured.join(centres.join(quartiles, ["grp", "script"]), ["grp", "script"], "left")

    def rule(name: str, when: Column) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.lit(name))

    def outside(m: str) -> Column:
        low, high = F.col(f"_{m}_q1"), F.col(f"_{m}_q3")
        reach = F.greatest((high - low) * spread, F.lit(LEAST_WIDTH[m]))
        return (distance(m) < low - reach) | (distance(m) > high + reach)

    rules = [rule(m, outside(m)) for m in BANDED]
    broken = F.array_compact(F.array(rule("empty", F.col("n_tokens") == 0), rule("fallback", F.col("fallback_share") > MOST_FALLBACK), *rules))
    return joined.withColumn("broken", F.array_sort(broken)).select(
        "doc_id", "grp", "n_chars", "n_tokens", "n_pieces", "chars_per_token", "chars_per_piece", "fallback_share", "entropy", "evenness", "broken", (F.size("broken") == 0).alias("keep")
    )
