"""Licence scan: TF-IDF cosine to templates, then inheritance from the nearest directory with a licence."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import chunks, utf8

#: Notices of common licences, (licence, words of the notice).
TEMPLATES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("Proprietary", "All rights reserved"),
)
#: Least cosine of a header line or paragraph, and of a whole file that speaks for its directory.
SIMILAR, FILE_SIMILAR = 0.7, 0.6
SALTS = 16
_STRIP = b".,;:!?()[]{}\"'`*/#<>|"


def terms(line: bytes) -> list[bytes]:
    return [x for w in line.lower().split() if (x := w.strip(_STRIP))]


class Scorer:
    """Sparse template vectors under the corpus' document frequencies."""

    def __init__(self, df: dict[bytes, int], n: int, templates=TEMPLATES):
        self.idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in df.items()}
        self.rare = math.log(1 + n) + 1
        self.templates = []
        for name, text in templates:
            v = {w: k * self.idf[w] for w, k in Counter(terms(text.encode())).items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.templates.append((name, {w: x / norm for w, x in v.items()}))
        self.vocabulary = frozenset(self.idf)

    def best(self, words: list[bytes], least: float) -> tuple[str | None, float]:
        """Most similar licence of one piece of text and its cosine; none below ``least``."""
        different = set(words)
        known = different & self.vocabulary
        # Other words weigh at least as much as known ones, so the known share bounds the squared cosine.
        if not known or len(known) < least * least * len(different):
            return None, 0.0
        tf = Counter(words)
        v = {w: tf[w] * self.idf[w] for w in known}
        other = sum(tf[w] ** 2 for w in different - known) * self.rare ** 2
        norm = math.sqrt(sum(x * x for x in v.values()) + other)
        score, name = max((sum(x * t.get(w, 0.0) for w, x in v.items()) / norm, name) for name, t in self.templates)
        return (name, min(score, 1.0)) if score >= least else (None, 0.0)


def _document_counts(rows: DataFrame, vocabulary: frozenset) -> tuple[dict[bytes, int], int]:
    """In how many rows each template word occurs, and the rows; one count per template word reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for part in chunks(batches):
            for text in part.column("text").to_pylist():
                seen[b""] += 1
                seen.update(vocabulary.intersection(x.strip(_STRIP) for x in set(text.lower().split())))
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    counts = rows.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = dict.fromkeys(vocabulary, 0) | {bytes(r["word"]): r["n"] for r in counts}
    return df, df.pop(b"", 0)


def own_licenses(files: DataFrame, path: str = "path", text: str = "text", templates=TEMPLATES, keep: tuple[str, ...] = ()) -> DataFrame:
    """path, the columns in ``keep``, own, own_score, line and file_license of every row.

    ``own`` is the licence most like any line or paragraph (lines between blank ones) of the whole text, at a
    cosine of ``SIMILAR`` or more; equal ones go to the last name. ``line`` is where that piece starts.
    ``file_license`` is set where the whole text is that near to a template.
    """
    rows = files.select(F.col(path).alias("path"), *keep, utf8(F.col(text)).alias("text"))
    vocabulary = frozenset(w for _, t in templates for w in terms(t.encode()))
    df, n = _document_counts(rows, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(df, n, templates)
        for part in chunks(batches):
            out = []
            for text in part.column("text").to_pylist():
                found, whole, block, first = (0.0, None, None), [], [], 0
                for i, line in enumerate([*text.split(b"\n"), b""]):
                    words = terms(line)
                    if words:
                        name, s = scorer.best(words, SIMILAR)
                        if name and (found[1] is None or (s, name) > found[:2]):
                            found = (s, name, i)
                        first = first if block else i
                        block += words
                        whole += words
                    elif block:
                        name, s = scorer.best(block, SIMILAR)
                        if name and s > found[0]:
                            found = (s, name, first)
                        block = []
                name, s = scorer.best(whole, FILE_SIMILAR) if whole else (None, 0.0)
                out.append((found[1], found[0] if found[1] else None, found[2], name))
            kinds = (pa.string(), pa.float64(), pa.int32(), pa.string())
            cols = [pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("path", *keep)), *cols], ["path", *keep, "own", "own_score", "line", "file_license"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    return rows.mapInArrow(run, f"{kinds}, own string, own_score double, line int, file_license string")


def scan(files: DataFrame, path: str = "path", text: str = "text", templates=TEMPLATES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Licence of every file: path, ``keep``, license, origin (own, inherited or null), score, line, license_dir.

    A file with a notice has its own licence. The others take that of the nearest directory above them,
    their own included, that holds a licence file; where a directory holds several, the most frequent, then the first
    by name. Directories are resolved once each, by joins of their ancestors with the licensed
    ones, and looked up by their files. Null and empty texts have no licence of their own; a null path has no
    directory, so nothing is inherited. Repeated rows are repeated. No rows give none.
    """
    rows = staged(own_licenses(files, path, text, templates, keep))
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    rows = rows.withColumn("dir", F.when(F.col("path").isNotNull(), folder))
    licensed = rows.filter("file_license is not null and dir is not null").groupBy("dir", "file_license").agg(F.count("*").alias("n"))
    licensed = licensed.groupBy("dir").agg(F.min_by("file_license", F.struct(-F.col("n"), "file_license")).alias("dir_license"))
    folders = rows.filter("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    pairs = folders.select("dir", above.alias("above")).join(licensed.withColumnRenamed("dir", "above"), "above")
    nearest = pairs.groupBy("dir").agg(F.max_by(F.struct("above", "dir_license"), F.length("above")).alias("near"))
    # A directory may hold a third of the files: its line is copied and the files are dealt over the copies.
    nearest = staged(nearest).withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    out = rows.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).join(nearest.hint("merge"), ["dir", "salt"], "left")
    own = F.col("own").isNotNull()
    inherited = ~own & F.col("near").isNotNull()
    return out.select("path", *keep, F.coalesce("own", "near.dir_license").alias("license"),
                      F.when(own, "own").when(inherited, "inherited").alias("origin"), F.col("own_score").alias("score"), "line",
                      F.when(inherited, F.col("near.above")).alias("license_dir"))
