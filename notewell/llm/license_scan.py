"""License scans: headers and licence files by sparse TF-IDF cosine, then inheritance from the nearest directory.

Each line of a file, the file as a whole, and each run of as many tokens as a template has, across line ends, is a
sparse vector of token counts weighted by the templates' inverse document frequencies; a token that no template has weighs as much as the rarest.  The licence of a file is that of
the template with the largest cosine of at least LEAST.  Most units are settled by a bound that is computed for the
whole batch at once: the cosine can't exceed the share of a unit's squared weights that is on template tokens, nor
the root of the share of a template's squared weights that is on the unit's tokens.

A licence file speaks for its directory.  Directories that have files look up their ancestors by joins on the path,
one row for each of their ancestors; files then join their own directory, so no file is copied and a directory that
holds a large part of all files is only ever on the side of a join that adaptive execution can split.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import like
from .support import written
from .textcodes import U, piece_hashes, slices, utf8_column

#: Statements of public licences.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "The GNU General Public License is a free, copyleft license for software and other kinds of works."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "\"Covered Software\" means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the Executable Form of such Source Code Form, and Modifications of such Source Code Form"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under the Creative Commons Attribution 4.0 International License.", "You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.", "You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "CC0-1.0": ["To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain worldwide."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software"],
    "LGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "This license, the Lesser General Public License, applies to some specially designated software packages"],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
LEAST = 0.7


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and starts and ends of the runs of letters, digits and non-ASCII bytes, within the units."""
    data = data + (((data >= 65) & (data <= 90)) * np.uint8(32))
    inside = ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    return data, starts, ends, piece_hashes(data, starts, ends)


class Templates:
    """The templates as sparse unit vectors over the hashes of their tokens."""

    def __init__(self, texts: dict[str, list[str]]):
        self.names = [name for name, statements in texts.items() for _ in statements]
        rows = [self._hashes(t) for statements in texts.values() for t in statements]
        df = Counter(h for row in rows for h in set(row))
        idf = {h: np.log((1 + len(rows)) / (1 + n)) + 1 for h, n in df.items()}
        self.rarest = float(np.log(1 + len(rows)) + 1)
        self.vocabulary = np.array(sorted(idf), U)
        self.idf = np.array([idf[h] for h in self.vocabulary.tolist()])
        self.matrix = np.zeros((len(rows), len(idf)))
        for i, row in enumerate(rows):
            for h, n in Counter(row).items():
                self.matrix[i, np.searchsorted(self.vocabulary, U(h))] = n * idf[h]
        self.matrix /= np.linalg.norm(self.matrix, axis=1)[:, None]
        self.lengths = [len(row) for row in rows]

    @staticmethod
    def _hashes(text: str) -> list[int]:
        data = np.frombuffer(text.encode(), np.uint8)
        return tokens(data, np.array([0, len(data)]))[3].tolist()

    def best(self, hashes: np.ndarray) -> tuple[float, int]:
        """The largest cosine of one unit, and its template (the first, where several are as near)."""
        one, count = np.unique(hashes, return_counts=True)
        at = np.minimum(np.searchsorted(self.vocabulary, one), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == one
        weight = count * np.where(known, self.idf[at], self.rarest)
        cosines = self.matrix[:, at[known]] @ weight[known] / np.sqrt((weight**2).sum())
        best = int(np.argmax(cosines > cosines.max() - 1e-12))
        return float(cosines[best]), best


def _windows(offsets: np.ndarray, starts: np.ndarray, hashes: np.ndarray, at: np.ndarray, known: np.ndarray, templates: Templates) -> Iterator[tuple[int, int, int]]:
    """(text, first, last) of the runs of a template's length, within a text, that may be LEAST near that template."""
    text = np.searchsorted(offsets, starts, "right") - 1
    stop = np.searchsorted(starts, offsets[1:])[text]
    place = np.flatnonzero(known)
    token = at[place]
    order = np.argsort(token, kind="stable")
    before = np.full(len(place), -1)
    again = token[order[1:]] == token[order[:-1]]
    before[order[1:][again]] = place[order[:-1][again]]
    for squares, length in zip(templates.matrix**2, templates.lengths, strict=True):
        # A token counts in the windows that begin after its place before, so once in each: its share of the template.
        mine = np.flatnonzero(squares[token] > 0)
        begin, weight = np.maximum(before[mine] + 1, place[mine] - length + 1), squares[token[mine]]
        share = np.cumsum(np.bincount(np.maximum(begin, 0), weight, len(starts) + 1) - np.bincount(place[mine] + 1, weight, len(starts) + 1))
        may = np.flatnonzero(share[: len(starts)] >= LEAST**2 - 1e-6)
        for first in may[may + length <= stop[may]].tolist():
            yield int(text[first]), first, first + length


def _scan_batch(column: pa.Array, templates: Templates, windows: bool = False) -> tuple[list[str | None], list[float]]:
    data, offsets = utf8_column(column)
    n = len(offsets) - 1
    names, scores = [None] * n, [0.0] * n
    breaks = np.union1d(np.flatnonzero(data == 0x0A), offsets)
    lowered, starts, ends, hashes = tokens(data, offsets)
    if not len(starts):
        return names, scores
    at = np.minimum(np.searchsorted(templates.vocabulary, hashes), len(templates.vocabulary) - 1)
    known = templates.vocabulary[at] == hashes
    # Weights of single tokens: repeated ones weigh more than their sum, on either side, so both sides are bounded.
    inside = np.concatenate([[0], np.cumsum(np.where(known, templates.idf[at], 0.0))])
    outside = np.concatenate([[0], np.cumsum(~known)])
    for units in (breaks, offsets):
        edge = np.searchsorted(starts, units)
        first, last = edge[:-1], edge[1:]
        # Template weights are largest if they fall on one token, others smallest if all tokens differ.
        largest, least = (inside[last] - inside[first]) ** 2, (outside[last] - outside[first]) * templates.rarest**2
        may = np.flatnonzero((largest > 0) & (largest >= LEAST**2 * (largest + least)))
        for u in may.tolist():
            score, best = templates.best(hashes[first[u] : last[u]])
            doc = int(np.searchsorted(offsets, starts[first[u]], "right")) - 1
            if score >= LEAST and score > scores[doc]:
                names[doc], scores[doc] = templates.names[best], score
    for doc, first, last in _windows(offsets, starts, hashes, at, known, templates) if windows else ():
        score, best = templates.best(hashes[first:last])
        if score >= LEAST and score > scores[doc]:
            names[doc], scores[doc] = templates.names[best], score
    return names, scores


def scan(files: DataFrame, key: str, text: str, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, own_license, own_score) of each row: the best match among the lines, the windows and the whole of its text."""
    shared = files.sparkSession.sparkContext.broadcast(Templates(templates or TEMPLATES))
    schema = T.StructType([like(files, key), T.StructField("own_license", T.StringType()), T.StructField("own_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                names, scores = _scan_batch(batch.column(1).slice(a, b - a), shared.value, windows=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema.names)

    return files.select(key, text).mapInArrow(run, schema)


def inherit(scanned: DataFrame, path: str = "path", is_license_file: str = "is_license_file") -> DataFrame:
    """Adds ``license`` and ``inherited_from`` to rows with path, own_license, own_score and the flag of licence files.

    A file's own licence counts first, then that of the nearest directory above it with a licence file (of several
    in a directory the one with the best score, then the smallest path).  inherited_from is that directory.
    """
    folder = F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))
    rows = scanned.withColumn("_folder", folder)
    speaking = rows.where(F.col(is_license_file) & F.col("own_license").isNotNull())
    order = F.struct((-F.col("own_score")).alias("s"), F.col(path).alias("p"), F.col("own_license").alias("license"))
    # "/" ends the name of each directory here, so that the root is "/" and not an empty text.
    said = speaking.groupBy(F.concat("_folder", F.lit("/")).alias("_above")).agg(F.min(order)["license"].alias("_said"))
    folders = rows.select("_folder").distinct()
    steps = F.split("_folder", "/")
    above = F.when(F.col("_folder") == "", F.array(F.lit("/"))).otherwise(F.concat(F.array(F.lit("/")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.concat(F.array_join(F.slice(steps, 1, n), "/"), F.lit("/")))))
    ancestors = folders.select("_folder", F.posexplode(above).alias("_depth", "_above"))
    nearest = ancestors.join(said, "_above").groupBy("_folder").agg(F.max(F.struct("_depth", "_said", "_above")).alias("_near"))
    out = rows.join(nearest, "_folder", "left")
    inherited = F.when(F.col("own_license").isNull(), F.col("_near._above"))
    return out.select(*[F.col(c) for c in scanned.columns], F.coalesce("own_license", "_near._said").alias("license"), inherited.alias("inherited_from"))


def document_path(key: Column, source: Column, lang: Column) -> tuple[Column, Column]:
    """Paths for a table of documents, which has none: source, language and a folder of 500 ids; every 25th is LICENSE."""
    special = F.pmod(key, F.lit(25)) == 0
    name = F.when(special, F.concat(F.lit("LICENSE-"), key.cast("string"))).otherwise(key.cast("string"))
    return F.concat_ws("/", F.coalesce(source, F.lit("unknown")), F.coalesce(lang, F.lit("unknown")), F.coalesce(F.floor(key / 500).cast("string"), F.lit("none")), F.coalesce(name, F.lit("none"))), F.coalesce(special, F.lit(False))


def query(docs: DataFrame) -> DataFrame:
    """(doc_id, path, own_license, own_score, license, inherited_from) of each row of documents.

    Null and empty texts have no licence of their own; repeated rows give a row each; null keys, sources and
    languages have folders of their own; other columns are left out; an empty table gives an empty result.
    """
    path, special = document_path(F.col("doc_id"), F.col("source"), F.col("lang"))
    named = docs.select(F.struct("doc_id", path.alias("path"), special.alias("is_license_file")).alias("k"), "text")
    scanned = written(scan(named, "k", "text").select("k.*", "own_license", "own_score"), "licenses")
    return inherit(scanned).select("doc_id", "path", "own_license", F.round("own_score", 6).alias("own_score"), "license", "inherited_from")
