"""Licence scans by a positional index of rare words.

One pass turns each text into the places of the words that occur in some licence
template (all other words only count). From these postings come the document
frequencies of the template words, hence their IDF. Then, per file and template
whose key phrases it has, the template's highest-IDF words are looked up in the file:
as many as weigh more than 1 - ``SHARE`` of the template, so that no alignment can be
accepted without one of them, whatever else the file holds. Each (file place -
template place) is a candidate alignment. Alignments are weighed by the IDF of all
template words that stand at their relative place; one is accepted when the weight is
at least ``SHARE`` of the template's and the template's key phrases stand there word
for word.

Base phrases are found at every place where their words stand consecutively.
``score`` is the largest share of any accepted alignment, 1 where a base phrase
stands, else 0. Places are relative, so a word more or less within a paragraph shifts what
follows; texts of several paragraphs are several templates, each aligned by itself.

Defined cases: null and empty texts have no words, null first and last word, no
labels and score 0; very long texts are scanned whole; null ids are kept as they are;
repeated rows are scanned each by itself; of equally rare words the one of the smaller
number goes first, which changes no result; an empty table gives an empty result. Columns beside
doc_id and text aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shelve, small_batches
from tessera.llm.rawtext import ALNUM, LOWER, span_hashes, text_bytes, word_spans

#: The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label, words of the notice, key phrases that must stand there.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted", "obtaining a copy")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("general public license version 2",)),
    ("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    ("reserved", "copyright all rights reserved", ("all rights reserved",)),
    # Paragraphs as the licences and their usual headers have them. Names to fill in stand between paragraphs, so places within one are fixed.
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ("to deal in the software without restriction",)),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("this permission notice shall be included",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "the following conditions are met")),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions in binary form must reproduce",)),
    ("bsd-3-clause", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("to endorse or promote products derived from this software",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("distribute this software for any purpose with or without fee",)),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ("to alter it and redistribute it freely",)),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software", ("person or organization obtaining a copy",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses license 2 0",)),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "version 3 of the license")),
    ("gpl-2.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "version 2 of the license")),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    ("agpl-3.0", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("affero general public license", "version 3 of the license")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license v 2 0",)),
    ("epl-2.0", "made available under the terms of the eclipse public license v 2 0", ("eclipse public license v 2 0",)),
)
SHARE = 0.75
SHIFT = 16


def vocabulary(templates=TEMPLATES, base=BASE) -> list[str]:
    return sorted({w for _, text, _ in templates for w in text.split()} | {w for p, _ in base for w in p.split()})


def _word_hash(words: list[str]) -> np.ndarray:
    col = pa.array(words)
    buf, off = text_bytes(col)
    return span_hashes(buf, off[:-1], off[1:])


def _posting_batches(batches):
    vocab = _word_hash(vocabulary())
    order = np.argsort(vocab)
    ordered = vocab[order]
    for b in batches:
        buf, off = text_bytes(b.column(1))
        starts, ends, first = word_spans(buf, off, ALNUM)
        h = span_hashes(buf, starts, ends, LOWER)
        at = np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)
        hit = np.flatnonzero(ordered[at] == h) if len(h) else np.zeros(0, np.int64)
        text = np.searchsorted(first, hit, side="right") - 1
        packed = ((hit - first[text]) << SHIFT) | order[at[hit]]
        cut = np.searchsorted(hit, first)
        lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(packed, pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(first), pa.int64()), lists], ["doc_id", "n_words", "hits"])


def postings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, and hits: (place << 16 | template word) in order of place."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_posting_batches, "doc_id long, n_words long, hits array<long>")


def idf(posted: DataFrame) -> dict[int, float]:
    """IDF of each template word that occurs. The collected rows are bounded by the templates' words."""
    ids = F.array_distinct(F.transform("hits", lambda x: x.bitwiseAND(F.lit((1 << SHIFT) - 1).cast("long"))))
    df = posted.select(F.explode(ids).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    n = posted.count()
    return {r["word"]: math.log((n + 1) / (r["df"] + 0.5)) for r in df.collect()}


class Index:
    """Templates as word ids with places, for the files of a task."""

    def __init__(self, weights: dict[int, float], templates=TEMPLATES, base=BASE):
        ids = {w: i for i, w in enumerate(vocabulary(templates, base))}
        top = max(weights.values(), default=1.0)
        self.weight = np.array([max(weights.get(i, top), 1e-3) for i in range(len(ids))])
        as_ids = lambda text: [ids[w] for w in text.split()]
        self.base = [(as_ids(p), label) for p, label in base]
        self.templates = [(label, as_ids(text), [as_ids(k) for k in keys]) for label, text, keys in templates]
        self.seeds = [self.rarest(words) for _, words, _ in self.templates]
        self.key_words = [np.unique(np.concatenate(keys)) for _, _, keys in self.templates]

    def rarest(self, template: list[int]) -> list[tuple[int, int]]:
        """Word and place of the template's rarest words: an alignment without any of them weighs less than SHARE."""
        out, rest = [], self.weight[template].sum()
        enough = (SHARE - 1e-9) * rest
        for w in sorted(set(template), key=lambda w: (-self.weight[w], w)):
            if rest < enough:
                break
            places = [(w, i) for i, x in enumerate(template) if x == w]
            out += places
            rest -= self.weight[w] * len(places)
        return out

    @staticmethod
    def phrase(places: np.ndarray, words: np.ndarray, phrase: list[int]) -> np.ndarray:
        """Places where the phrase's words stand consecutively."""
        n = len(phrase)
        if len(places) < n:
            return places[:0]
        ok = words[: len(words) - n + 1] == phrase[0]
        for i in range(1, n):
            # Places ascend and each holds one word, so a run of hits is a run of words.
            ok &= (words[i : len(words) - n + 1 + i] == phrase[i]) & (places[i : len(places) - n + 1 + i] == places[: len(places) - n + 1] + i)
        return places[: len(places) - n + 1][ok]

    def scan(self, hits: np.ndarray):
        """n_base, first, last, base labels, labels, score."""
        places, words = hits >> SHIFT, hits & ((1 << SHIFT) - 1)
        n, first, last, base_labels, score = 0, None, None, set(), 0.0
        for phrase, label in self.base:
            found = self.phrase(places, words, phrase)
            if len(found):
                n += len(found)
                base_labels.add(label)
                first = int(found[0]) if first is None else min(first, int(found[0]))
                last = int(found[-1]) if last is None else max(last, int(found[-1]))
                score = 1.0
        labels = set(base_labels)
        present = np.zeros(len(self.weight), bool)
        present[words] = True
        for t, (label, template, keys) in enumerate(self.templates):
            if not present[self.key_words[t]].all():
                continue
            # A key phrase must stand in the text at all, before alignments are weighed.
            found = [self.phrase(places, words, k) for k in keys]
            if not all(map(len, found)):
                continue
            starts = np.unique(np.concatenate([places[words == w] - i for w, i in self.seeds[t]]))
            if not len(starts):
                continue
            got = np.zeros(len(starts))
            for i, w in enumerate(template):
                at = np.searchsorted(places, starts + i)
                at[at == len(places)] = 0
                got += self.weight[w] * ((places[at] == starts + i) & (words[at] == w))
            whole = self.weight[template].sum()
            for f in found:  # each key phrase within the alignment
                inside = np.searchsorted(f, starts) < np.searchsorted(f, starts + len(template))
                got[~inside] = 0
            best = float(got.max() / whole)
            if best >= SHARE:
                labels.add(label)
                score = max(score, min(1.0, best))
        return n, first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score


def scan(docs: DataFrame) -> DataFrame:
    posted = shelve(postings(docs))
    weights = idf(posted)

    def run(batches):
        index = Index(weights)
        for b in batches:
            col = b.column(2)
            if isinstance(col, pa.ChunkedArray):
                col = col.combine_chunks()
            off = col.offsets.to_numpy()
            flat = col.values.to_numpy(zero_copy_only=False)
            rows = [index.scan(flat[i:j]) for i, j in zip(off[:-1], off[1:])]
            cols = [list(c) for c in zip(*rows)] or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return posted.mapInArrow(run, schema)
