"""License scans: TF-IDF cosine of headers and license files to templates, and inheritance from the nearest directory.

Templates are short statements of licenses.  Where a text holds a cue word, the words around it are laid beside every
template by its first cue, cue on cue, and their sparse TF-IDF vectors are compared by cosine.  Statements are also tried from
their later cues on ("under the MIT License").  The words that tell licenses apart (names, versions) must stand there too, and
no name of another one.  Document frequencies of all
template words are counted over all texts first.  The best template at or above ``LEAST`` is the license of the file.

A file without a statement of its own inherits from the nearest directory above it that holds a license file.  Directories,
not files, are joined with their ancestors; files meet their own directory only.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import add_column, stash

#: Statements by SPDX identifier.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at"],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License"],
    "LGPL-2.1": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License"],
    "LGPL-3.0": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License"],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License"],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted"],
    "CC0-1.0": ["Released under CC0 1.0, dedicated to the public domain.",
                "has waived all copyright and related or neighboring rights to"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0."],
    "LicenseRef-Proprietary": ["Copyright. All rights reserved."],
}
#: Tags of further versions, which the statements above do not tell apart.
TAGS = ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
        "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later")
for _name in list(TEMPLATES):
    if not _name.startswith("LicenseRef"):
        TEMPLATES[_name].append(f"SPDX-License-Identifier: {_name}")
for _name in TAGS:
    TEMPLATES[_name.removesuffix("-only").removesuffix("-or-later")].append(f"SPDX-License-Identifier: {_name}")
#: Names of licenses: those of a template must stand beside it, and none of the others that make it another license.
NAMES = frozenset(b"mit apache gpl lgpl agpl general lesser affero mozilla mpl bsd isc cc cc0 by nc sa nd commons unlicense spdx "
                  b"unencumbered waived".split())
OTHERS = frozenset(b"lesser affero library nc sa nd noncommercial sharealike noderivatives".split())
#: A statement is looked for where one of these words stands; each template holds at least one.
CUES = (b"license", b"licensed", b"released", b"permission", b"redistribution", b"redistribute", b"reserved",
        b"waived")
LEAST = 0.75
#: File names that speak for their directory.
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|unlicense)([.-].*)?$"
KIND = "struct<license: string, score: double, statements: bigint>"

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c == 46 else 32
               for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Runs of letters, digits and inner points, A-Z lower-cased."""
    return [w for w in (x.strip(b".") for x in (text or b"").translate(_TABLE).split()) if w]


def _version(word: bytes) -> bytes | None:
    """A version number without v and .0, or null."""
    number = word.removeprefix(b"v").removesuffix(b".0")
    return number if number.replace(b".", b"").isdigit() else None


def told_apart(template: list[bytes], beside: list[bytes]) -> bool:
    """Whether the names and versions of a template stand in the words beside it, and no other license's name."""
    here = set(beside)
    return {w for w in template if w in NAMES} <= here and not (here & OTHERS) - set(template) and \
        {v for v in map(_version, template) if v} <= {v for v in map(_version, beside) if v}


def bsd_license(own: list[bytes]) -> str:
    """Which BSD license the words after the common opening make."""
    joined = b" ".join(own)
    if b"neither the name" in joined or b"names of its contributors" in joined:
        return "BSD-3-Clause"
    return "BSD-2-Clause" if b"this software is provided by" in joined else "LicenseRef-BSD"


class Templates:
    """Word counts of the templates, and where their cues stand.

    A template with several cues gives a row from after each cue on, as long as the rest names the license.
    """

    def __init__(self, templates: dict[str, list[str]]):
        self.rows, self.by_cue = [], {}
        for name, texts in templates.items():
            for text in texts:
                whole = words(text.encode())
                held = [i for i, w in enumerate(whole) if w in CUES]
                if not held:
                    raise ValueError(f"no cue in a template of {name}")
                names = {w for w in whole if w in NAMES or _version(w)}
                for before, at in zip([-1, *held], held):
                    own = whole[before + 1:]
                    if before >= 0 and not (names and names <= set(own)):
                        continue
                    self.by_cue.setdefault(whole[at], []).append((len(self.rows), at - before - 1))
                    self.rows.append((name, own))
        self.vocabulary = sorted({w for _, own in self.rows for w in own})


def document_frequencies(docs: DataFrame, templates: dict, text_col: str) -> tuple[int, dict[bytes, int]]:
    """Number of rows and, per template word, the rows that hold it; each task sends one row per template word."""
    known = Templates(templates).vocabulary

    def count(stream):
        wanted, n, seen = set(known), 0, Counter()
        for batch in stream:
            for text in batch.column(0).to_pylist():
                n += 1
                seen.update(wanted & {w.strip(b".") for w in set((text or b"").translate(_TABLE).split())})
        yield pa.RecordBatch.from_arrays([
            pa.array([None, *[w.decode() for w in known]], pa.string()), pa.array([n, *[seen[w] for w in known]], pa.int64())],
            names=["word", "n"])

    found = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(count, "word string, n bigint")
    rows = dict(found.groupBy("word").agg(F.sum("n").alias("n")).collect())
    return rows.pop(None, 0), {w.encode(): n for w, n in rows.items()}


class Matcher:
    def __init__(self, templates: dict[str, list[str]], n: int, seen: dict[bytes, int]):
        self.templates = Templates(templates)
        self.rare = math.log(1 + n) + 1
        self.idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in seen.items()}
        self.vectors = []
        for _, own in self.templates.rows:
            vector = self._vector(own)
            self.vectors.append((vector, self._norm(vector)))

    def _vector(self, own: list[bytes]) -> dict[bytes, float]:
        return {w: c * self.idf.get(w, self.rare) for w, c in Counter(own).items()}

    @staticmethod
    def _norm(vector: dict[bytes, float]) -> float:
        return math.sqrt(sum(x * x for x in vector.values()))

    def match(self, text: bytes | None) -> dict:
        """The best license, its cosine, and how many places of the text state a license; without one, the best cosine at all."""
        best, name, places, most = 0.0, None, 0, 0.0
        lowered = (text or b"").translate(_TABLE)
        if not any(c in lowered for c in CUES):
            return {"license": None, "score": 0.0, "statements": 0}
        own = words(text)
        for i, word in enumerate(own):
            here = 0.0
            for number, at in self.templates.by_cue.get(word, ()):
                vector, norm = self.vectors[number]
                stated, template = self.templates.rows[number]
                window = own[max(0, i - at):max(0, i - at) + len(template)]
                beside = self._vector(window)
                dot = sum(x * beside.get(w, 0.0) for w, x in vector.items())
                cosine = min(1.0, dot / (norm * self._norm(beside)))
                most = max(most, cosine)
                if cosine < LEAST or not told_apart(template, window):
                    continue
                here = max(here, cosine)
                if cosine > best + 1e-12:
                    best, name = cosine, stated
                    if stated == "BSD-3-Clause" and word == b"redistribution":
                        name = bsd_license(own[i:])
            places += here >= LEAST
        return {"license": name, "score": best if name else most, "statements": places}


def with_license(docs: DataFrame, name: str, text_col: str = "text", templates: dict = TEMPLATES, keep=None) -> DataFrame:
    """``docs`` with the column ``name``: license stated in the text, cosine, number of statements."""
    n, seen = document_frequencies(docs, templates, text_col)

    def make():
        matcher = Matcher(templates, n, seen)
        return lambda texts: list(map(matcher.match, texts))

    return add_column(docs, {"text": F.col(text_col).cast("binary")}, name, KIND, make, keep)


def _parent(path):
    """The folder of a path, empty for the topmost one, null for a null path."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def nearest_licenses(folders: DataFrame, licensed: DataFrame) -> DataFrame:
    """``dir, license, from_dir`` of each folder (column ``dir``) with a licensed folder at or above it.

    ``licensed`` holds ``dir, license``, one row per folder.  Each folder is joined with its ancestors, the deepest wins.
    """
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    up = folders.select("dir", F.explode(above).alias("up"))
    found = up.join(licensed.select(F.col("dir").alias("from_dir"), "license"), F.col("up") == F.col("from_dir"))
    return found.groupBy("dir").agg(F.max(F.struct(F.length("from_dir").alias("depth"), "from_dir", "license")).alias("m")) \
        .select("dir", "m.license", "m.from_dir")


def scan_licenses(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text",
                  templates: dict = TEMPLATES) -> DataFrame:
    """One row per file: ``doc_id, path, license, origin, score, statements, from_dir``.

    ``origin`` is ``stated``, ``inherited`` (``from_dir`` says from where) or ``none``.  Of several license files of a folder
    the best match counts, ties by license name.  Null and empty texts state nothing; a null path is in no folder and inherits
    nothing; repeated rows get a row each, an empty table none; other columns are ignored.
    """
    rows = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    found = stash(with_license(rows, "found", templates=templates, keep=["doc_id", "path"]).withColumn(
        "dir", _parent(F.col("path"))), "licenses")
    speaks = found.where(F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENSE_FILE) & F.col("found.license").isNotNull())
    best = F.max_by("found.license", F.struct("found.score", "found.license"))
    licensed = speaks.groupBy("dir").agg(best.alias("license"))
    open_ = found.where(F.col("found.license").isNull() & F.col("path").isNotNull())
    inherited = nearest_licenses(open_.select("dir").distinct(), licensed).select(
        F.col("dir").alias("_dir"), F.col("license").alias("_license"), "from_dir")
    joined = found.join(inherited, found["dir"] == inherited["_dir"], "left")
    own = F.col("found.license")
    return joined.select(
        "doc_id", "path", F.coalesce(own, "_license").alias("license"),
        F.when(own.isNotNull(), "stated").when(F.col("_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        "found.score", "found.statements", F.when(own.isNull(), F.col("from_dir")).alias("from_dir"))
