"""License scan by an exact set-similarity join of text blocks with license templates.

A block is a window of ``2 * step`` consecutive words, one beginning at every ``step``-th word, so that each passage of up to
``step`` words lies whole in a block. Templates are token sets; one of more than ``step`` words is cut into clauses of equal size,
each a template of its own. A block meets a template when it holds at least ``percent`` % of its tokens. The join is
exact and finds all such pairs by three filters before anything is counted:

* tokens of every set are put in one global order, rarest in the corpus first (counted over all documents); a pair that meets
  the threshold shares a token among the template's first |T| - need + 1, which are all that the inverted index holds (prefix);
* a block with fewer than ``need`` template tokens cannot meet it (length);
* a match at places i and j of the two sorted sets leaves at most min(|T| - i, |B| - j) common tokens (position).

Tokens of no template cannot add to an overlap and are left out of the blocks' sets. Phrases are templates as well: a
block that holds all tokens of a phrase is a candidate, and word by word comparison of the block finds the places where they stand
consecutively.

Templates and phrases are parameters and go to every task; their counted order is as large as they are. Documents are read
where they lie, once to count and once to join, without a shuffle; a text is worked on in arrays as long as it has words.
Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z, compared by 64-bit hashes. Null and empty texts have
no words and no blocks; repeated documents get equal rows; columns named like the new ones are replaced by them, others stay.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from waybill.llm.common import pieces, word_hashes

#: With 80, templates that differ in one word of seven would name each other.
PERCENT = 90
STEP = 32

#: Phrases whose places are reported, with their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Notices that public licenses ask for or are known by, with labels.
TEMPLATES = [
    ("released under the MIT license", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files,"
     " to deal in the Software without restriction", "mit"),
    ("Licensed under the Apache License, Version 2.0", "apache-2"),
    ("you may not use this file except in compliance with the License; you may obtain a copy of the License at apache org licenses", "apache-2"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl-3"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions"
     " are met", "bsd"),
    ("licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("licensed under a Creative Commons Attribution-NonCommercial International License", "cc-by-nc"),
    ("licensed under CC BY-SA 4.0", "cc-by-sa"),
    ("licensed under a Creative Commons Attribution-ShareAlike International License", "cc-by-sa"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
]

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
# Bytes of words before they are lower-cased.
_ALPHABET = np.zeros(256, bool)
_ALPHABET[np.r_[48:58, 65:91, 97:123, 128:256]] = True

BLOCKS = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()),
    T.StructField("shared", T.LongType()), T.StructField("size", T.LongType())]))
PLACES = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType())]))


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


def clauses(templates: Sequence[tuple[str, str]], step: int) -> list[tuple[list[bytes], str]]:
    """(words, label) of the templates, those of more than ``step`` words in clauses of equal size."""
    out = []
    for text, label in templates:
        words = words_of(text)
        parts = max(1, math.ceil(len(words) / step))
        size = math.ceil(len(words) / parts)
        out += [(words[i : i + size], label) for i in range(0, len(words), size) if words]
    return out


class Join:
    """The templates' side: tokens, and with their counts the global order and the index of prefixes."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]], percent: int, step: int) -> None:
        self.step = step
        sought = [(words_of(text), label) for text, label in phrases]
        if any(len(words) > step or not words for words, _ in sought):
            raise ValueError("a phrase has between one word and step words")
        every = [(words, label, percent) for words, label in clauses(templates, step)] + [(words, label, 100) for words, label in sought]
        self.labels = [label for _, label, _ in every]
        self.words = [self._hashes(words) for words, _, _ in every]
        self.sets = [np.unique(w) for w in self.words]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.need = np.array([max(1, -(-p * len(s) // 100)) for (_, _, p), s in zip(every, self.sets)], np.int64)
        self.n_templates = len(every) - len(sought)
        self.tokens = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.sets]))
        # Nearly all words of a text are of no template: 16 bits of their hashes tell.
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.tokens & np.uint64(0xFFFF)).astype(np.int64)] = True

    @staticmethod
    def _hashes(words: list[bytes]) -> np.ndarray:
        return word_hashes(pa.array([b" ".join(words)], pa.large_binary()), alphabet=_ALPHABET)[0]

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are tokens, and which they are."""
        at = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        token = np.searchsorted(self.tokens, hashes[at])
        token[token == len(self.tokens)] = 0
        sure = self.tokens[token] == hashes[at] if len(self.tokens) else np.zeros(len(at), bool)
        return at[sure], token[sure]

    def order(self, counts: dict[int, int]) -> None:
        """The global order, rarest token first, and the index of the templates' prefixes in it."""
        number = np.array([counts.get(i, 0) for i in range(len(self.tokens))], np.int64)
        self.rank = np.empty(len(number), np.int64)
        self.rank[np.lexsort((self.tokens, number))] = np.arange(len(number))
        self.member = np.zeros((len(self.sets), len(number)), bool)
        postings: list[list[tuple[int, int]]] = [[] for _ in number]
        for t, tokens in enumerate(self.sets):
            ranks = np.sort(self.rank[np.searchsorted(self.tokens, tokens)])
            self.member[t, ranks] = True
            for i, r in enumerate(ranks[: len(ranks) - self.need[t] + 1]):
                postings[r].append((t, i))
        self.ends = np.cumsum([0, *map(len, postings)])
        flat = np.array([x for p in postings for x in p], np.int64).reshape(-1, 2)
        self.post_template, self.post_place = flat[:, 0], flat[:, 1]

    def blocks(self, at: np.ndarray, token: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(block, template, shared) of all pairs that meet their threshold, and where each text's blocks begin."""
        begin = np.concatenate([[0], np.cumsum(-(-np.diff(first) // self.step))])
        doc = np.searchsorted(first, at, side="right") - 1
        cell = (at - first[doc]) // self.step
        here = begin[doc] + cell
        again = cell > 0
        width = max(len(self.tokens), 1)
        rank = self.rank[token]
        keys = np.unique(np.concatenate([here * width + rank, (here[again] - 1) * width + rank[again]]))
        block, rank = keys // width, keys % width
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.append(starts, len(keys)))
        group = np.repeat(np.arange(len(starts)), size)
        left = np.repeat(starts + size, size) - np.arange(len(keys))
        # Every shared prefix token gives the templates in whose index it is.
        n = self.ends[rank + 1] - self.ends[rank]
        entry = np.repeat(self.ends[rank] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        template, place = self.post_template[entry], self.post_place[entry]
        group, left = np.repeat(group, n), np.repeat(left, n)
        need = self.need[template]
        may = (size[group] >= need) & (np.minimum(self.sizes[template] - place, left) >= need)
        pair = np.unique(group[may] * len(self.sets) + template[may])
        group, template = pair // max(len(self.sets), 1), pair % max(len(self.sets), 1)
        # What the filters leave is counted.
        n = size[group]
        edge = np.cumsum(n) - n
        entry = np.repeat(starts[group] - edge, n) + np.arange(n.sum())
        inside = self.member[np.repeat(template, n), rank[entry]].astype(np.int64)
        shared = np.add.reduceat(inside, edge) if len(edge) else np.zeros(0, np.int64)
        met = shared >= self.need[template]
        return block[starts[group[met]]], template[met], shared[met], begin

    def places(self, hashes: np.ndarray, first: np.ndarray, begin: np.ndarray, block: np.ndarray, template: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, template) of the phrases' places, sorted. A place is looked for in the block that it begins in the first half of."""
        starts, which = [], []
        doc = np.searchsorted(begin, block, side="right") - 1
        for t in range(self.n_templates, len(self.sets)):
            mine, words = doc[template == t], self.words[t]
            low = first[mine] + (block[template == t] - begin[mine]) * self.step
            at = (low[:, None] + np.arange(self.step)[None, :]).ravel()
            at = at[at + len(words) <= np.repeat(first[mine + 1], self.step)]
            for j, w in enumerate(words):
                at = at[hashes[at + j] == w]
            starts.append(at)
            which.append(np.full(len(at), t))
        start, which = np.concatenate([np.zeros(0, np.int64), *starts]), np.concatenate([np.zeros(0, np.int64), *which])
        turn = np.lexsort((which, start))
        return start[turn], which[turn]


def token_counts(documents: DataFrame, join: Join, text: str = "text") -> dict[int, int]:
    """How often each token of the templates occurs in all documents: as many numbers as there are tokens at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(join.tokens), np.int64)
        for batch in pieces(batches, text):
            hashes, _ = word_hashes(batch.column(text), lower=True, alphabet=_ALPHABET)
            total += np.bincount(join.found(hashes)[1], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["token", "n"])

    counted = documents.select(text).filter(F.col(text).isNotNull()).mapInArrow(run, "token long, n long")
    return dict(counted.groupBy("token").agg(F.sum("n")).collect())


def scan(documents: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES,
         percent: int = PERCENT, step: int = STEP, text: str = "text") -> DataFrame:
    """``documents`` with ``n_words``, ``blocks`` (label, first word, end, shared tokens and size of the template; by place) and
    ``places`` (label and first word of the phrases; by place)."""
    join = Join(templates, phrases, percent, step)
    join.order(token_counts(documents, join, text))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("blocks", BLOCKS), T.StructField("places", PLACES)]
    kept = [f for f in documents.schema.fields if f.name not in {x.name for x in fields}]
    schema = T.StructType(kept + fields)
    if text not in documents.columns or text in {x.name for x in fields}:
        raise ValueError(f"no column {text!r} beside the new ones")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array(join.labels, object)
        for batch in pieces(batches, text):
            hashes, first = word_hashes(pc.fill_null(batch.column(text), ""), lower=True, alphabet=_ALPHABET)
            block, template, shared, begin = join.blocks(*join.found(hashes), first)
            start, which = join.places(hashes, first, begin, block, template)
            mine = template < join.n_templates
            block, template, shared = block[mine], template[mine], shared[mine]
            doc = np.searchsorted(begin, block, side="right") - 1
            low = (block - begin[doc]) * step
            high = np.minimum(low + 2 * step, np.diff(first)[doc])
            rows = pa.StructArray.from_arrays(
                [pa.array(labels[template], pa.string()), *map(pa.array, (low, high, shared, join.sizes[template]))],
                names=["label", "start", "stop", "shared", "size"])
            place = np.searchsorted(first, start, side="right") - 1
            spots = pa.StructArray.from_arrays([pa.array(labels[which], pa.string()), pa.array(start - first[place])], names=["label", "start"])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(np.diff(first)), _lists(doc, rows, batch.num_rows), _lists(place, spots, batch.num_rows)],
                names=schema.fieldNames())

    return documents.mapInArrow(run, schema)


def _lists(row: np.ndarray, values: pa.StructArray, n: int) -> pa.ListArray:
    """One list for each of ``n`` rows; ``row`` is sorted and tells whose each value is."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), values)


def report(documents: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    ``labels`` are those of the phrases found and of the templates that a block meets; ``score`` is the largest share of a template's
    tokens in a block among them, 1 for a phrase, 0 without any.
    """
    found = scan(documents.select("doc_id", "text"), **options)
    starts = F.transform("places", lambda x: x["start"])
    base = F.transform("places", lambda x: x["label"])
    every = F.concat(base, F.transform("blocks", lambda x: x["label"]))
    shares = F.transform("blocks", lambda x: x["shared"].cast("double") / x["size"])
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(every)), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(shares), F.lit(0.0))).alias("score"))
