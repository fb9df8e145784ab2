"""License detection: TF-IDF cosine against license texts, then inheritance along folders.

The whole file is compared with whole license texts. Each line, each pair of neighbouring
lines and each run of as many words as a statement has, over any number of lines, is
compared with the usual statements of licenses. A file that is the text of a license is a
license file and holds for its folder, and so is one with the name of a license file most of
whose text is one statement. Files without a statement of their own take the license of the
nearest folder above them that has one.
"""

from __future__ import annotations

import pathlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import map_arrow, materialise, texts_of

# Usual statements of licenses, by SPDX identifier.
STATEMENTS = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE file in the project root."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
]
#: Whole license texts, by SPDX identifier; lines of copyright are left out.
TEXTS = [(f.stem, "\n".join(x for x in f.read_text("utf-8").split("\n") if not x.lower().lstrip().startswith("copyright (c)")))
         for f in sorted((pathlib.Path(__file__).parent / "license_texts").glob("*.txt"))]
#: Least cosine of a file and a license text, on one plus the logarithm of counts.
FILE_COSINE = 0.85
# Names of license files, with anything before or after a dash, dot or underscore.
FILE_NAME = r"(?i)^(.*[-._])?(licen[cs]e|copying|copyright|notice|unlicen[cs]e)([-._].*)?$"
_APART = bytes(c if chr(c).isalnum() or c in b".\n" or c > 127 else 32 for c in range(256))


def words_of(line: str) -> list[bytes]:
    return [w for w in (w.strip(b".") for w in line.lower().encode("utf-8", "surrogatepass").translate(_APART).split()) if w]


class Templates:
    def __init__(self, statements: list[tuple[str, str]]):
        self.names = [n for n, _ in statements]
        split = [words_of(t) for _, t in statements]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for ws in split for w in ws}))}
        self.counts = np.zeros((len(self.vocabulary), len(statements)))
        for k, ws in enumerate(split):
            for w in ws:
                self.counts[self.vocabulary[w], k] += 1

    def weights(self, df: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, float]:
        """idf of each word, unit vectors of the statements, and the idf of a word that no statement has."""
        idf = np.log((n + 1) / (df + 1)) + 1
        t = self.counts * idf[:, None]
        return idf, t / np.linalg.norm(t, axis=0), float(np.log(n + 1) + 1)

    def damped(self, idf: np.ndarray) -> np.ndarray:
        """Unit vectors of the texts with one plus the logarithm of counts."""
        t = np.where(self.counts > 0, 1 + np.log(np.maximum(self.counts, 1)), 0) * idf[:, None]
        return t / np.linalg.norm(t, axis=0)

    def pick(self, words: dict[bytes, int], df: np.ndarray) -> np.ndarray:
        """Frequencies of this vocabulary, from those of a larger one."""
        return df[[words[w] for w in self.vocabulary]]


def document_frequencies(docs: DataFrame, templates: Templates, text: str) -> tuple[np.ndarray, int]:
    """In how many of all documents each word of the statements occurs, and the number of documents."""
    vocabulary = templates.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            for t in texts_of(batch.column(0)):
                total[[vocabulary[w] for w in vocabulary.keys() & set(words_of(t))]] += 1
                total[-1] += 1
        yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int64)), pa.array(total)], ["word", "n"])

    rows = map_arrow(docs.select(text), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(len(vocabulary) + 1, np.int64)  # one row per word of the statements
    for r in rows:
        found[r.word] = r.n
    return found[:-1], int(found[-1])


def scan_licenses(docs: DataFrame, path: Column, key: str = "doc_id", text: str = "text", threshold: float = 0.75,
                  file_share: float = 0.6, statements: list[tuple[str, str]] = STATEMENTS,
                  whole: list[tuple[str, str]] = TEXTS, file_cosine: float = FILE_COSINE) -> DataFrame:
    """One row per file: key, path, license, score, origin (header, license_file, inherited, none) and license_dir.

    A file whose cosine with a whole license text reaches file_cosine is a license file of
    that license, whatever its name. A statement that makes file_share of a file's words makes it a
    license file only under such a name (FILE_NAME); elsewhere it is a header. A word that no template has counts as the rarest word, once each time. Of several
    statements the best wins, then the first in the text. A folder with several license
    files takes the one with the best score (six digits), then the smallest license name. Null texts
    are empty; files with a null path inherit nothing; repeated rows give a row each, and no rows none.
    """
    templates = Templates(statements)
    full, every = Templates(whole), Templates(statements + whole)
    df, n = document_frequencies(docs, every, text)
    idf, vectors, unknown = templates.weights(templates.pick(every.vocabulary, df), n)
    full_idf = full.weights(full.pick(every.vocabulary, df), n)[0]
    full_vectors, full_names, full_get = full.damped(full_idf).astype(np.float32), full.names, full.vocabulary.get
    names, get, lengths = templates.names, templates.vocabulary.get, templates.counts.sum(axis=0).astype(int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                found = [None] * part.num_rows
                words, line_of, file_of, n_words = [], [], [], np.zeros(part.num_rows)
                for f, t in enumerate(texts_of(part.column(2))):
                    for line in t.split("\n"):
                        ws = words_of(line)
                        n_words[f] += len(ws)
                        if ws:
                            line_of += [len(file_of)] * len(ws)
                            words += ws
                            file_of.append(f)
                if words:
                    ids = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                    line_of, file_of = np.array(line_of), np.array(file_of)
                    found = _best(ids, line_of, file_of, idf, vectors, unknown, n_words, threshold)
                    _runs(found, ids, file_of[line_of], idf, vectors, unknown, lengths, n_words, threshold)
                    found = [(names[x[0]], *x[1:], False) if x else None for x in found]
                    ids = np.fromiter(map(full_get, words, repeat(-1)), np.int64, len(words))
                    best, cosine = _whole(ids, file_of[line_of], full_idf, full_vectors, unknown, part.num_rows)
                    for f in np.flatnonzero(cosine >= file_cosine):
                        found[f] = (full_names[best[f]], float(cosine[f]), 1.0, True)
                cols = list(zip(*(x or (None, None, None, False) for x in found), strict=True))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(cols[0], pa.string()), pa.array(
                    cols[1], pa.float64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_())],
                    ["key", "path", "license", "score", "share", "whole"])

    own = map_arrow(docs.select(F.col(key).cast("long").alias("key"), path.cast("string").alias("path"), text), run,
                    "key long, path string, license string, score double, share double, whole boolean")
    named = F.coalesce(F.regexp_replace("path", "^.*/", "").rlike(FILE_NAME), F.lit(False))
    own = own.withColumn("holds", F.col("whole") | (named & F.coalesce(F.col("share") >= file_share, F.lit(False))))
    own = materialise(own.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")), "licenses-own")
    folders = own.where("holds and dir is not null").groupBy("dir").agg(F.min_by(
        F.struct("license", "score"), F.struct(-F.round("score", 6), "license")).alias("f"))
    folders = materialise(folders.select(F.col("dir").alias("license_dir"), "f.*"), "licenses-folders")
    # every folder of the files, with each folder above it: one row per folder and level, joined by path
    levels = own.select("dir").where("dir is not null").distinct().withColumn("parts", F.split("dir", "/"))
    levels = levels.select("dir", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("depth"), "parts")
    levels = levels.select("dir", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("license_dir"))
    nearest = levels.join(folders, "license_dir").groupBy("dir").agg(
        F.max_by(F.struct("license_dir", "license", "score"), "depth").alias("up"))
    nearest = materialise(nearest, "licenses-nearest")
    rows = own.join(nearest, "dir", "left")
    mine, up = F.col("license").isNotNull(), F.col("up").isNotNull()
    return rows.select(
        F.col("key").alias(key), "path", F.coalesce("license", "up.license").alias("license"),
        F.round(F.coalesce("score", "up.score"), 6).alias("score"),
        F.when(F.col("holds"), "license_file").when(mine, "header").when(up, "inherited").otherwise(
            "none").alias("origin"), F.when(~mine, F.col("up.license_dir")).alias("license_dir"))


def _best(ids, line_of, file_of, idf, vectors, unknown, n_words, threshold):
    """For each file the best statement (number, cosine, share of the file's words) over single lines and pairs of lines."""
    lines, n_files = len(file_of), len(n_words)
    found = [None] * n_files
    known = ids >= 0
    v = len(idf)
    pairs, counts = np.unique(line_of[known] * v + ids[known], return_counts=True)
    at, word = pairs // v, pairs % v
    miss = np.bincount(line_of[~known], minlength=lines).astype(float)
    size = np.bincount(line_of, minlength=lines)
    hit = np.unique(at)
    if not len(hit):
        return found
    weight = np.zeros((len(hit), v))
    weight[np.searchsorted(hit, at), word] = counts * idf[word]
    row_of = np.full(lines + 1, -1)
    row_of[hit] = np.arange(len(hit))
    after = row_of[hit + 1]
    joined = (after >= 0) & (np.append(file_of, -1)[hit + 1] == file_of[hit])
    two = weight[joined] + weight[after[joined]]
    for rows, first, wide in ((weight, hit, 0), (two, hit[joined], 1)):
        if not len(first):
            continue
        lost = miss[first] + (miss[first + 1] if wide else 0)
        cosine = rows @ vectors / np.sqrt((rows ** 2).sum(axis=1) + lost * unknown ** 2)[:, None]
        best = cosine.argmax(axis=1)
        for i in np.flatnonzero(cosine.max(axis=1) >= threshold):
            f, c = int(file_of[first[i]]), float(cosine[i, best[i]])
            words = size[first[i]] + (size[first[i] + 1] if wide else 0)
            if found[f] is None or c > found[f][1] + 1e-12:
                found[f] = (int(best[i]), c, float(words / n_words[f]))
    return found


def _whole(ids, file_of, idf, vectors, unknown, n_files):
    """For each file the whole license text of the largest cosine, and that cosine."""
    known, v = ids >= 0, len(idf)
    pairs, counts = np.unique(file_of[known] * v + ids[known], return_counts=True)
    at, word = pairs // v, pairs % v
    weight = (1 + np.log(counts)) * idf[word]
    norm = np.sqrt(np.bincount(at, weight ** 2, n_files) + np.bincount(file_of[~known], minlength=n_files) * unknown ** 2)
    dot = np.zeros((n_files, vectors.shape[1]))
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    for k in range(vectors.shape[1] if len(at) else 0):
        dot[at[starts], k] = np.add.reduceat(weight * vectors[word, k], starts)
    cosine = dot / np.maximum(norm, 1e-300)[:, None]
    return cosine.argmax(axis=1), cosine.max(axis=1)


def _runs(found, ids, file_of, idf, vectors, unknown, lengths, n_words, threshold):
    """Runs of as many words as a statement has, wherever they begin and however many lines they take.

    With the sum of squares over words in place of words counted together, the cosine of a
    run is never too small; runs that pass by it are scored exactly.
    """
    known = ids >= 0
    square = np.cumsum(np.concatenate([[0.0], np.where(known, idf[ids], unknown) ** 2]))
    for k, length in enumerate(lengths.tolist()):
        last = len(ids) - length
        if last < 0:
            continue
        gain = np.cumsum(np.concatenate([[0.0], np.where(known, idf[ids] * vectors[ids, k], 0.0)]))
        dot = gain[length:] - gain[:-length]
        near = dot >= threshold * np.sqrt(square[length:] - square[:-length]) - 1e-6
        for i in np.flatnonzero(near & (file_of[:last + 1] == file_of[length - 1:])):
            word, count = np.unique(ids[i:i + length][known[i:i + length]], return_counts=True)
            missing = length - int(count.sum())
            weight = count * idf[word]
            cosine = float(weight @ vectors[word, k]) / float(np.sqrt(weight @ weight + missing * unknown ** 2))
            f = int(file_of[i])
            if cosine >= threshold and (found[f] is None or cosine > found[f][1] + 1e-9):
                found[f] = (k, cosine, length / n_words[f])
