"""Loading of public tokenizer vocabularies; their folder is a parameter and nothing is copied or trained."""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZERS = "/opt/tokenizers"
#: The pre-token pattern that goes with the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_TEXT = 50_256


@lru_cache(maxsize=8)
def byte_bpe(path: str):
    """A tiktoken encoding of a ``.tiktoken`` rank file, one per worker process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("lathe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def pieces(path: str):
    """A SentencePiece processor, one per worker process."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


#: The pattern for the regex module, with the white space that Rust's engine knows.
_PIECES = PATTERN.replace(r"[^\s\p{L}", r"[^\p{White_Space}\p{L}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def encode(encoding, text: str) -> list[int]:
    """Ids of ``text``, whatever its length.  Where the encoder's regex engine gives up, on runs of a million blanks, the
    pieces are found by another engine and encoded one by one, to the same ids."""
    try:
        return encoding.encode_ordinary(text)
    except BaseException as problem:
        if type(problem).__name__ != "PanicException":  # what a fault of the encoder's Rust code arrives as
            raise
        return encode_by_piece(encoding, text)


def encode_by_piece(encoding, text: str) -> list[int]:
    import regex

    one = encoding._encode_single_piece
    return [i for m in regex.finditer(_PIECES, text) for i in one(m.group())]


#: A space with white space on both sides: there, and only there, a cut before the space could change the tokens.
_INNER_SPACE = r"[\s\pZ\x0b\x1c-\x1f\x{85}] [\s\pZ\x0b\x1c-\x1f\x{85}]"


def encode_column(encoding, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds per text) of all texts, the same ids as ``encode`` gives.

    Texts are cut before their spaces and every distinct piece is encoded once.
    """
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    whole = np.flatnonzero(pc.match_substring_regex(texts, _INNER_SPACE).to_numpy(zero_copy_only=False))
    lists = pc.split_pattern(pc.if_else(pc.match_substring_regex(texts, _INNER_SPACE), "", texts) if len(whole) else texts, " ")
    coded = lists.flatten().dictionary_encode()
    piece = np.asarray(coded.indices, dtype=np.int64)
    offsets = np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()
    uniq = coded.dictionary.to_pylist()
    first = offsets[:-1]  # splitting leaves one piece at least; the first has no space before it
    heads: dict[str, int] = {}
    slots = np.array([heads.setdefault(uniq[p], len(uniq) + len(heads)) for p in piece[first].tolist()], dtype=np.int64)
    slots[whole] = len(uniq) + len(heads) + np.arange(len(whole))
    piece = piece.copy()
    piece[first] = slots
    plain = encoding.encode_ordinary
    late = np.zeros(len(uniq), dtype=bool)
    late[piece[piece < len(uniq)]] = True
    found = [(encode(encoding, " " + u) if len(u) > 2_000 else plain(" " + u)) if used else [] for u, used in zip(uniq, late.tolist())]
    found += [encode(encoding, h) for h in heads]
    found += [encode(encoding, texts[i].as_py()) for i in whole.tolist()]
    counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    flat = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(counts.sum()))
    starts = np.concatenate([[0], np.cumsum(counts)])
    n = counts[piece]
    ends = np.concatenate([[0], np.cumsum(n)])
    ids = flat[np.arange(ends[-1]) + np.repeat(starts[piece] - ends[:-1], n)]
    return ids, ends[offsets]
