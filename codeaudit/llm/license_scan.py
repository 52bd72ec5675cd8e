"""License scan by a positional rare-token index (operator 12).

Texts are lower-cased (A-Z) and read as words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`.
A template is a licence's passage with key phrases.  It stands at a place of a
file where at least `least` percent of its words stand at their positions from
there on (words beyond the file's ends are missing) and each key phrase stands
whole within its length.  A phrase to be found to the letter has 100 percent.

Method: the document frequency of every licence word is counted over all
documents.  The index holds, per template, its rarest words with their
positions: one more than the template may miss, so wherever it stands one of
them does (ties of frequency go to the first).  Each file's such words are
looked up; a word at p that a template has at j proposes the start p - j, and
proposals that agree on template and start are one candidate.  A candidate is
compared word by word and its key phrases are verified.  Frequencies save work
and decide nothing, so nothing is missed at any size.

What is broadcast are the templates' words and their frequencies, whose size is
that of the templates.  Words are compared by 64-bit hashes.

Defined results: null and empty texts have no words and no places; repeated
rows and null ids are scanned like others; texts are read whole, a very long
one in memory in proportion to it; overlapping places are all kept; equal
places are in the order of the templates; empty tables give no rows; only the
id and text columns are read, ids of any type.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeaudit.llm.words import ALNUM, words


class Template(NamedTuple):
    label: str
    text: str
    phrases: tuple[str, ...] = ()
    least: int = 80


# Phrases that name a licence.
BASE = (Template("mit", "mit license", (), 100), Template("apache", "apache license", (), 100),
        Template("gpl", "general public license", (), 100))

# Notices and passages of well-known licences with what tells
# each from its relatives.
TEMPLATES = (
    Template("MIT", "Released under the MIT License", ("mit license",)),
    Template("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
             "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
             ("permission is hereby granted", "free of charge", "sublicense")),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
             "granted, provided that the above copyright notice and this permission notice appear in all copies",
             ("with or without fee",)),
    Template("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
             "the following conditions are met", ("source and binary forms",)),
    Template("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
             "promote products derived from this software without specific prior written permission", ("endorse or promote",)),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    Template("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
             "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
             ("warranties or conditions of any kind",)),
    Template("GPL-2.0", "licensed under the GNU General Public License, version 2", ("general public license", "version 2")),
    Template("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
             "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
             "later version", ("gnu general public license", "version 2")),
    Template("GPL-3.0", "licensed under the GNU General Public License, version 3", ("general public license", "version 3")),
    Template("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
             "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
             "later version", ("gnu general public license", "version 3")),
    Template("LGPL", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
             "by the Free Software Foundation", ("gnu lesser general public license",)),
    Template("AGPL", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
             "by the Free Software Foundation", ("gnu affero general public license",)),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
             ("mozilla public license", "v 2 0")),
    Template("Unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software",)),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("all-rights-reserved", "All rights reserved", ("all rights reserved",)),
)

_BLOCK = 1 << 22
#: Words compared at once.
_COMPARED = 1 << 22
_PLACES = "array<struct<template:int,start:long,matched:int>>"


def split(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))


def needed(t: Template) -> int:
    """Words of a template that must stand at their positions."""
    return -(-t.least * len(split(t.text)) // 100)


class _Vocabulary:
    """The templates as numbers of their words, in the order of the words'
    hashes."""

    def __init__(self, templates: tuple[Template, ...]):
        all_words = sorted({w for t in templates for x in (t.text, *t.phrases) for w in split(x)})
        h = np.concatenate([words(w.encode(), ALNUM)[2] for w in all_words]) if all_words else np.zeros(0, np.uint64)
        order = np.argsort(h)
        self.hash = h[order]
        number = {all_words[i]: n for n, i in enumerate(order.tolist())}
        ids = lambda x: np.array([number[w] for w in split(x)], np.int64)
        self.text = [ids(t.text) for t in templates]
        self.phrases = [[ids(p) for p in t.phrases] for t in templates]
        self.need = [needed(t) for t in templates]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The word's number, or -1."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[at] == hashes, at, -1)


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, word hashes, row of each word) of about 4 MB of texts."""
    texts = [t or b"" for t in column.to_pylist()]
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= _BLOCK):
            size += len(texts[to])
            to += 1
        start, _, h = words(b"\n".join(texts[at:to]), ALNUM)
        first = np.cumsum([0] + [len(t) + 1 for t in texts[at:to - 1]])
        yield at, to - at, h, np.searchsorted(first, start, "right") - 1
        at = to


def word_frequencies(docs: DataFrame, text: str, templates: tuple[Template, ...]) -> np.ndarray:
    """Documents that hold each word of the vocabulary."""
    vocabulary = _Vocabulary(templates)

    def run(batches):
        total = np.zeros(len(vocabulary.hash), np.int64)
        for b in batches:
            for _, n, h, row in _blocks(b.column(0)):
                v = vocabulary.numbers(h)
                has = np.unique(v[v >= 0] * n + row[v >= 0]) // n
                total += np.bincount(has, minlength=len(total)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["word", "n"])

    out = np.zeros(len(vocabulary.hash), np.int64)
    counts = docs.select(F.col(text).cast("binary")).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    for r in counts.collect():  # a row a word of the templates
        out[r["word"]] = r["n"]
    return out


def rare_index(vocabulary: _Vocabulary, frequency: np.ndarray) -> list[list[tuple[int, int]]]:
    """Per template the (word, position) of its rarest words: as many as it may
    miss, and one."""
    out = []
    for ids, need in zip(vocabulary.text, vocabulary.need, strict=True):
        order = sorted(range(len(ids)), key=lambda j: (frequency[ids[j]], j))
        out.append([(int(ids[j]), j) for j in order[:len(ids) - need + 1]])
    return out


def _stands(ids: np.ndarray, phrase: np.ndarray) -> bool:
    return any(np.array_equal(ids[i:i + len(phrase)], phrase) for i in np.flatnonzero(ids[:len(ids) - len(phrase) + 1] == phrase[0]))


def _found(v: np.ndarray, row: np.ndarray, n: int, vocabulary: _Vocabulary, index: list) -> tuple[np.ndarray, ...]:
    """(row, template, start in the block, matching words) of every place."""
    indexed = np.zeros(len(vocabulary.hash), bool)
    for rare in index:
        indexed[[w for w, _ in rare]] = True
    at = np.flatnonzero((v >= 0) & indexed[v]) if len(indexed) else np.zeros(0, np.int64)
    at = at[np.argsort(v[at], kind="stable")]
    edge = np.searchsorted(v[at], np.arange(len(indexed) + 1))
    out = []
    for t, rare in enumerate(index):
        ids = vocabulary.text[t]
        size = len(ids)
        places = [at[edge[w]:edge[w + 1]] for w, _ in rare]
        proposed = np.unique(np.concatenate([(p - j + size) * n + row[p] for p, (_, j) in zip(places, rare, strict=True)]))
        start, of = proposed // n - size, proposed % n
        for lo in range(0, len(start), max(1, _COMPARED // size)):
            s, r = start[lo:lo + max(1, _COMPARED // size)], of[lo:lo + max(1, _COMPARED // size)]
            p = s[:, None] + np.arange(size)
            inside = (p >= 0) & (p < len(v))
            p = np.where(inside, p, 0)
            same = inside & (row[p] == r[:, None]) & (v[p] == ids)
            m = same.sum(axis=1)
            ok = np.flatnonzero(m >= vocabulary.need[t])
            if vocabulary.phrases[t]:
                there = inside & (row[p] == r[:, None])
                ok = np.array([i for i in ok if all(_stands(np.where(there[i], v[p[i]], -1), x) for x in vocabulary.phrases[t])], np.int64)
            out.append((r[ok], np.full(len(ok), t), s[ok], m[ok]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _scan(vocabulary: _Vocabulary, index: list, schema: pa.Schema):
    kind = schema.field("places").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, n, h, row in _blocks(b.column(1)):
                r, t, s, m = _found(vocabulary.numbers(h), row, n, vocabulary, index)
                s = s - np.searchsorted(row, r)
                order = np.lexsort((t, s, r))
                r, t, s, m = r[order], t[order], s[order], m[order]
                items = pa.StructArray.from_arrays([pa.array(t, pa.int32()), pa.array(s, pa.int64()), pa.array(m, pa.int32())],
                                                   fields=list(kind.value_type))
                places = pa.ListArray.from_arrays(pa.array(np.searchsorted(r, np.arange(n + 1)), pa.int32()), items, type=kind)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), pa.array(np.bincount(row, minlength=n), pa.int64()), places],
                                                 schema=schema)
    return run


def scan_licenses(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", base: tuple[Template, ...] = BASE,
                  templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Per document: the id, n_words, and places: structs of label, base
    (whether of a base phrase), start (in words from 0; below 0 where a place
    begins before the text), matched and words (of the template), by start."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    known = (*base, *templates)
    vocabulary = _Vocabulary(known)
    index = rare_index(vocabulary, word_frequencies(docs, text, known))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("t"))
    ddl = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, places {_PLACES}"
    found = rows.mapInArrow(_scan(vocabulary, index, to_arrow_schema(StructType.fromDDL(ddl))), ddl)
    labels = F.array(*[F.lit(t.label) for t in known])
    sizes = F.array(*[F.lit(len(x)) for x in vocabulary.text])
    return found.select(F.col("id").alias(doc_id), "n_words", F.transform("places", lambda x: F.struct(
        labels[x["template"]].alias("label"), (x["template"] < len(base)).alias("base"), x["start"].alias("start"),
        x["matched"].alias("matched"), sizes[x["template"]].alias("words"))).alias("places"))
