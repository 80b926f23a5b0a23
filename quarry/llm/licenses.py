"""License scans by conditional compression.

Candidate blocks are runs of lines that hold a word of licensing (a gap of `GAP` lines stays inside a block).
On both sides a block takes in lines with as many words as the longest notice, since wrapped notices begin and end in
lines without such words; blocks that touch are one.
A block is compressed by itself and with each notice as a raw zstandard dictionary.  Notices are ranked by what they save;
those that save enough of their own size are confirmed by wording, the best first, and then ranked again without what is
confirmed, until nothing new is: all but a small share of the notice's
words must stand in the block in order, and what tells licenses apart (a version, Lesser, Affero, ShareAlike and the like)
may neither be missing nor be added.  A place is taken by the first notice that is confirmed there.  What differs is returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines without a licensing word inside a block; least share of a notice's compressed size that it saves; least share of its
#: words; words of a block that are looked at together; blocks that a task remembers.
GAP, SAVED, WORDING, WINDOW, REMEMBERED = 2, 0.05, 0.9, 1_000, 20_000

TRIGGER = r"(?i)licen[cs]e|copyright|spdx|warrant|redistribut|public\W+domain|permission|all\W+rights\W+reserved"

# fixed values: wordings of public license notices
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "MIT": ["Released under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "This work is licensed under the GNU General Public License, version 2."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "EPL-1.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
    "Artistic-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}

#: The tag that names a license by its identifier.
TAG = "SPDX-License-Identifier: "
for _name, _wordings in NOTICES.items():
    _wordings.append(TAG + _name)

#: Words: hyphens part them, since lines are wrapped there.
WORD = re.compile(r"[a-z0-9]+(?:\.[a-z0-9]+)*")
# fixed values: words that tell licenses apart, beside versions
TELLING = frozenset(("lesser", "library", "affero", "sharealike", "noncommercial", "noderivatives", "sa", "nc", "nd", "eclipse", "mozilla", "apache", "boost", "artistic", "not"))
VERSION = re.compile(r"v?\d(?:\.\d)?")


def tells(word: str) -> bool:
    """Whether a word, missing or added, makes another license of a notice."""
    return word in TELLING or VERSION.fullmatch(word) is not None


#: Words before and after a licensing word among which a whole notice may stand.
MARGIN = max(int((2 - WORDING) * len(WORD.findall(wording.lower()))) for wordings in NOTICES.values() for wording in wordings)


def blocks(text: str) -> list[tuple[int, str]]:
    """Candidate blocks of a text: number of the first line (from 0), and the lines."""
    lines = text.split("\n")
    found: list[list[int]] = []
    line = at = 0
    for match in re.finditer(TRIGGER, text):
        line, at = line + text.count("\n", at, match.start()), match.start()
        end = line + match.group().count("\n")
        if found and line - found[-1][1] <= GAP + 1:
            found[-1][1] = max(end, found[-1][1])
        else:
            found.append([line, end])
    wide: list[list[int]] = []
    for a, b in found:
        words = MARGIN
        while a > 0 and words > 0:
            a -= 1
            words -= len(WORD.findall(lines[a].lower()))
        words = MARGIN
        while b < len(lines) - 1 and words > 0:
            b += 1
            words -= len(WORD.findall(lines[b].lower()))
        if wide and a <= wide[-1][1] + 1:
            wide[-1][1] = max(b, wide[-1][1])
        else:
            wide.append([a, b])
    return [(a, "\n".join(lines[a : b + 1])) for a, b in wide]


def places(words: list[str], own: list[str], matcher: SequenceMatcher) -> list[tuple[int, int, list[str], list[str]]]:
    """Where a notice stands among a block's words: begin, end, missing and added words.

    matcher: of the notice and the block.
    """
    size, spare = len(words), int((1 - WORDING) * len(words) + 1e-9)
    least = max(1, (size - spare) // (2 * spare + 1))  # a confirmed notice has a run as long as this without a change
    found, open_ = [], [(0, len(own))]
    while open_:
        low, high = open_.pop()
        run = matcher.find_longest_match(0, size, low, high)
        if run.size < least:
            continue
        begin, end = run.b, run.b + run.size
        start = max(low, run.b - run.a - spare)
        part = own[start : min(high, run.b + size - run.a + spare)]
        matches = [m for m in SequenceMatcher(None, words, part, autojunk=False).get_matching_blocks() if m.size]
        # words of the surroundings that happen to stand in the notice too
        while len(matches) > 1 and matches[0].size <= matches[1].b - matches[0].b - matches[0].size:
            matches.pop(0)
        while len(matches) > 1 and matches[-1].size <= matches[-1].b - matches[-2].b - matches[-2].size:
            matches.pop()
        taken = {i for m in matches for i in range(m.a, m.a + m.size)}
        inside = {j for m in matches for j in range(m.b, m.b + m.size)}
        added = [part[j] for j in range(matches[0].b, matches[-1].b + matches[-1].size) if j not in inside]
        missing = [w for i, w in enumerate(words) if i not in taken]
        if len(missing) <= spare and len(added) <= spare and not any(map(tells, missing + added)):
            begin, end = start + matches[0].b, start + matches[-1].b + matches[-1].size
            found.append((begin, end, missing, added))
        open_ += [(low, begin), (end, high)]
    return found


class Scanner:
    def __init__(self, notices: dict[str, list[str]] = NOTICES):
        import zstandard

        self.plain = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)
        self.notices = []
        for license_id, wordings in notices.items():
            for wording in wordings:
                body = wording.lower().encode()
                raw = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                compressor = zstandard.ZstdCompressor(level=3, dict_data=raw, write_checksum=False, write_content_size=False, write_dict_id=False)
                self.notices.append((license_id, WORD.findall(wording.lower()), compressor, len(self.plain.compress(body))))
        self.longest = max(len(words) for _, words, _, _ in self.notices)
        self.known: dict[str, list[dict]] = {}

    def scan(self, block: str) -> list[dict]:
        """Licenses confirmed in a block, those that save most first: license, saved, missing and added words, line of the block."""
        if block not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[block] = self._scan(block.lower())
        return self.known[block]

    def ranked(self, block: str) -> list[tuple[int, float, str, list[str]]]:
        """Notices that save enough, the most bytes first: bytes, share of the notice's own size, license, words."""
        raw = " ".join(block.split()).encode()
        alone, found = len(self.plain.compress(raw)), []
        for license_id, words, compressor, size in self.notices:
            saved = alone - len(compressor.compress(raw))
            if saved >= SAVED * size:
                found.append((saved, saved / size, license_id, words))
        return sorted(found, key=lambda f: (-f[0], f[2], -len(f[3])))

    def _scan(self, block: str) -> list[dict]:
        at = list(WORD.finditer(block))
        own = [m.group() for m in at]
        kept: list[tuple[int, int, dict]] = []
        # windows that overlap by more than a notice: the work grows with the block, and no notice is cut in all of them
        step = max(WINDOW, 4 * self.longest) - 2 * self.longest
        windows = [(low, SequenceMatcher(None, (), own[low : low + step + 2 * self.longest], autojunk=False)) for low in range(0, max(1, len(own) - 2 * self.longest), step)]
        tried: set[tuple[str, int]] = set()
        rest = block
        while True:
            before = len(kept)
            for _, share, license_id, words in self.ranked(rest):
                if (license_id, len(words)) in tried:
                    continue
                tried.add((license_id, len(words)))
                found = []
                for low, matcher in windows:
                    matcher.set_seq1(words)
                    found += [(len(missing) + len(added), low + begin, low + end, missing, added) for begin, end, missing, added in places(words, matcher.b, matcher)]
                for _, begin, end, missing, added in sorted(found):
                    if all(begin >= stop or start >= end for start, stop, _ in kept):
                        kept.append((begin, end, {"license": license_id, "saved": round(share, 6), "missing": missing, "added": added, "line": block.count("\n", 0, at[begin].start())}))
            if len(kept) == before:
                return [k[2] for k in kept]
            # notices that share wordings hide each other's savings: rank what is left without those that are confirmed
            taken = sorted((at[begin].start(), at[end - 1].end()) for begin, end, _ in kept)
            rest = " ".join(block[stop:start] for (_, stop), (start, _) in zip([(0, 0), *taken], [*taken, (len(block), 0)], strict=True))


_FOUND = "doc_id {kind}, line int, license string, saved double, missing array<string>, added array<string>, exact boolean"


def licenses(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every confirmed notice: doc_id, line (of its first word), license, saved (of its compressed size, in its block),
    missing, added, exact.

    Documents without notices do not appear; null and empty texts have none; repeated rows are each reported.
    """
    kind = documents.schema[doc_id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            at, rows = [], []
            for k, whole in enumerate(batch.column(1).to_pylist()):
                for line, block in blocks(whole):
                    for notice in scanner.scan(block):
                        at.append(k)
                        rows.append(notice | {"line": line + notice["line"], "exact": not notice["missing"] and not notice["added"]})
            strings = pa.list_(pa.string())
            columns = [("line", pa.int32()), ("license", pa.string()), ("saved", pa.float64()), ("missing", strings), ("added", strings), ("exact", pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array([r[c] for r in rows], t) for c, t in columns)], names=["doc_id", *(c for c, _ in columns)])

    some = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("text").rlike(TRIGGER))
    return some.mapInArrow(scan, _FOUND.format(kind=kind))


def op6_licenses(documents: DataFrame) -> DataFrame:
    """The result of `licenses`, with words joined by spaces."""
    found = licenses(documents)
    return found.select("doc_id", "line", "license", "saved", F.array_join("missing", " ").alias("missing"), F.array_join("added", " ").alias("added"), "exact")
