"""Operator 1, license scan by an exact set-similarity join.

Text blocks are the lines of a document and its paragraphs of several lines
(runs of lines that are not blank).  Block and template are token sets (lower
case runs of letters and digits); a block matches a template when it contains
at least ``THRESHOLD`` of the template's tokens.

1. The block frequency of every template token is counted over all lines of
   all documents; tokens are ordered rarest first (ties by the token).  Tokens
   of no template cannot add to an overlap and are left out of the blocks.
2. With ``need`` the least overlap of a template, only blocks of ``need``
   tokens or more qualify (length filter); the first ``size - need + 1`` tokens
   of block and template must share one (prefix filter), at positions that
   leave room for ``need`` common tokens (positional filter).
3. What is left is verified by counting the overlap.  All three filters are
   exact, so every matching block is found.

The templates and their token counts are the only things sent to the
executors; they are as large as the list of templates, whatever the corpus.

Result: doc_id, kind ('line' or 'paragraph'), first_line, n_lines, license,
overlap, containment.  Lines count from 0, blank ones included.

Defined results: a null or empty text has no blocks; a blank line is no block
and ends a paragraph; a paragraph of one line is that line and not listed
twice; equal rows are each scanned for themselves, so their matches are
repeated; a null doc_id stays null; a block that meets several templates gives
a row for each; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm import textops

THRESHOLD = 0.9
SLICE = 8_000_000

#: Notices and opening clauses of public licenses.
TEMPLATES: dict[str, str] = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd-3-clause-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

_TOKEN = re.compile(r"[^\W_]+")


def tokens_of(text: str) -> list[str]:
    """Distinct tokens of a template, sorted."""
    return sorted(set(_TOKEN.findall(text.lower())))


def lines_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(token index per occurrence, offsets per line, text of each line, distinct tokens)."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    rows = pc.split_pattern(texts, "\n")
    owner = np.repeat(np.arange(len(texts)), np.diff(np.asarray(rows.offsets, dtype=np.int64)))
    clean = pc.replace_substring_regex(pc.utf8_lower(rows.flatten()), r"[^\p{L}\p{N}]+", " ")
    ids, offsets, uniq = textops.words(clean, lower=False)
    return ids, offsets, owner, uniq


class Index:
    """Templates as rank lists (rarest first) with their inverted lists."""

    def __init__(self, templates: dict[str, str], counts: dict[str, int], threshold: float = THRESHOLD):
        self.names = sorted(templates)
        sets = [tokens_of(templates[n]) for n in self.names]
        order = sorted({t for s in sets for t in s}, key=lambda t: (counts.get(t, 0), t))
        self.rank = {t: i for i, t in enumerate(order)}
        self.lists = [np.array(sorted(self.rank[t] for t in s), dtype=np.int64) for s in sets]
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        self.need = np.array([max(1, math.ceil(threshold * len(s) - 1e-9)) for s in sets], dtype=np.int64)
        entries = [(r, t, i) for t, ranks in enumerate(self.lists) for i, r in enumerate(ranks.tolist()[: self.size[t] - self.need[t] + 1])]
        entries.sort()
        self.entry_template = np.array([t for _, t, _ in entries], dtype=np.int64)
        self.entry_place = np.array([i for _, _, i in entries], dtype=np.int64)
        self.entry_starts = np.searchsorted([r for r, _, _ in entries], np.arange(len(order) + 1))
        self.member = np.zeros((len(self.names), len(order)), dtype=bool)
        for t, ranks in enumerate(self.lists):
            self.member[t, ranks] = True

    def matches(self, block: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, template, overlap) of all matches among blocks given as distinct (block, rank) pairs, sorted."""
        nothing = np.zeros(0, np.int64)
        if not len(block) or not len(self.names):
            return nothing, nothing, nothing
        heads = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        sizes = np.diff(np.concatenate([heads, [len(block)]]))
        place = np.arange(len(block)) - np.repeat(heads, sizes)
        size = np.repeat(sizes, sizes)
        # length and prefix: a block below the least need of all, or a place beyond every prefix, has no part in it
        alive = np.flatnonzero(place <= size - self.need.min())
        n = np.diff(self.entry_starts)[rank[alive]]
        at = np.repeat(alive, n)
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.entry_starts[rank[alive]], n)
        template, there = self.entry_template[entry], self.entry_place[entry]
        need = self.need[template]
        good = (size[at] >= need) & (place[at] <= size[at] - need) & (np.minimum(self.size[template] - there, size[at] - place[at]) >= need)
        which = np.repeat(np.arange(len(heads)), sizes)
        pairs = np.unique(which[at[good]] * len(self.names) + template[good])
        which, template = pairs // len(self.names), pairs % len(self.names)
        n = sizes[which]
        bounds = np.concatenate([[0], np.cumsum(n)])
        inside = np.arange(bounds[-1]) - np.repeat(bounds[:-1], n) + np.repeat(heads[which], n)
        overlap = textops.per_owner(np.add, self.member[np.repeat(template, n), rank[inside]].astype(np.int64), bounds, 0)
        full = overlap >= self.need[template]
        return block[heads[which[full]]], template[full], overlap[full]


def distinct_pairs(block: np.ndarray, rank: np.ndarray, ranks: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(block * max(ranks, 1) + rank)
    return both // max(ranks, 1), both % max(ranks, 1)


def known_tokens(texts: pa.Array, vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (line, token number) pairs of vocabulary tokens; the text of each line; whether it has any token."""
    ids, offsets, owner, uniq = lines_of(texts)
    number = np.fromiter((vocabulary.get(u, -1) for u in uniq), dtype=np.int64, count=len(uniq))
    mapped = number[ids] if len(ids) else np.zeros(0, np.int64)
    line = np.repeat(np.arange(len(owner)), np.diff(offsets))
    hit = mapped >= 0
    block, token = distinct_pairs(line[hit], mapped[hit], len(vocabulary))
    return block, token, owner, np.diff(offsets) > 0


def frequencies(docs: DataFrame, vocabulary: Iterable[str]) -> dict[str, int]:
    """In how many lines of the whole corpus each token occurs."""
    names = sorted(set(vocabulary))
    numbers = {t: i for i, t in enumerate(names)}

    def run(batches):
        total = np.zeros(len(names), dtype=np.int64)
        for batch in textops.slices(batches, limit=SLICE):
            total += np.bincount(known_tokens(batch.column("text"), numbers)[1], minlength=len(names))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["token", "n"])

    partial = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "token long, n long")
    return {names[r["token"]]: r["n"] for r in partial.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def scan_texts(texts: pa.Array, index: Index) -> dict[str, np.ndarray]:
    """Matches of a batch of texts, as columns; ``row`` is the text's place in the batch."""
    block, rank, owner, filled = known_tokens(texts, index.rank)
    found = [(*index.matches(block, rank), np.arange(len(owner)), np.ones(len(owner), np.int64), "line")]
    # paragraphs: runs of filled lines of one text
    starts = filled & np.concatenate([[True], ~filled[:-1] | (owner[1:] != owner[:-1])])[: len(filled)]
    paragraph = np.cumsum(starts) - 1
    heads = np.flatnonzero(starts)
    lengths = np.bincount(paragraph[filled], minlength=len(heads))
    several = lengths[paragraph[block]] > 1 if len(block) else np.zeros(0, bool)
    found.append((*index.matches(*distinct_pairs(paragraph[block[several]], rank[several], len(index.rank))), heads, lengths, "paragraph"))
    first_of_text = np.searchsorted(owner, np.arange(len(texts)))
    out: dict[str, list] = {k: [] for k in ("row", "kind", "first_line", "n_lines", "template", "overlap")}
    for b, t, overlap, first, n, kind in found:
        row = owner[first[b]]
        out["row"].append(row)
        out["kind"].append(np.full(len(b), kind, dtype=object))
        out["first_line"].append(first[b] - first_of_text[row])
        out["n_lines"].append(n[b])
        out["template"].append(t)
        out["overlap"].append(overlap)
    return {k: np.concatenate(v) for k, v in out.items()}


SCHEMA = "doc_id long, kind string, first_line long, n_lines long, license string, overlap long, containment double"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """All matches of text blocks and templates."""
    known = {n: t for n, t in (TEMPLATES if templates is None else templates).items() if tokens_of(t)}
    index = Index(known, frequencies(docs, (w for t in known.values() for w in tokens_of(t))), threshold)
    names = pa.array(index.names, pa.string())

    def run(batches):
        for batch in textops.slices(batches, limit=SLICE):
            m = scan_texts(batch.column("text"), index)
            columns = [
                batch.column("doc_id").take(pa.array(m["row"], pa.int64())), pa.array(m["kind"], pa.string()), pa.array(m["first_line"], pa.int64()), pa.array(m["n_lines"], pa.int64()),
                names.take(pa.array(m["template"], pa.int64())), pa.array(m["overlap"], pa.int64()), pa.array(m["overlap"] / index.size[m["template"]] if len(m["row"]) else [], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, SCHEMA)


def oracle(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """The same result in SQL: every block against every template."""
    known = TEMPLATES if templates is None else templates
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(n)}, [{', '.join(map(quote, tokens_of(t)))}], {max(1, math.ceil(threshold * len(tokens_of(t)) - 1e-9))})" for n, t in sorted(known.items()) if tokens_of(t))
    return f"""
WITH templates(license, words, need) AS (VALUES {values}),
texts AS (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
lines AS (SELECT r, doc_id, i - 1 AS line, list_filter(string_split(regexp_replace(lower(lines[i]), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM texts)),
filled AS (SELECT *, line - row_number() OVER (PARTITION BY r ORDER BY line) AS run FROM lines WHERE len(w) > 0),
blocks AS (
  SELECT doc_id, 'line' AS kind, line AS first_line, 1 AS n_lines, w FROM filled
  UNION ALL SELECT any_value(doc_id), 'paragraph', min(line), count(*), flatten(list(w)) FROM filled GROUP BY r, run HAVING count(*) > 1),
met AS (SELECT b.doc_id, b.kind, b.first_line, b.n_lines, t.license, len(list_intersect(t.words, b.w)) AS overlap, len(t.words) AS size, t.need FROM blocks b, templates t)
SELECT doc_id, kind, first_line::BIGINT AS first_line, n_lines::BIGINT AS n_lines, license, overlap::BIGINT AS overlap, overlap::DOUBLE / size AS containment FROM met WHERE overlap >= need
"""


ORACLE = oracle()
