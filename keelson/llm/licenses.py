"""License notices by conditional compression against templates."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import picked, texts_as_bytes
from .registry import load, register

# Fixed wordings of public license notices, by SPDX-like name.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless"
        " required by applicable law or agreed to in writing, software distributed under the License is distributed on"
        ' an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction, including without'
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions: The above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the Software."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met: Redistributions of source code must retain the above copyright notice, this"
        " list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above"
        " copyright notice, this list of conditions and the following disclaimer in the documentation and/or other"
        " materials provided with the distribution."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met: Redistributions of source code must retain the above copyright notice, this"
        " list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above"
        " copyright notice, this list of conditions and the following disclaimer in the documentation and/or other"
        " materials provided with the distribution. Neither the name of the copyright holder nor the names of its"
        " contributors may be used to endorse or promote products derived from this software without specific prior"
        " written permission."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 2 of the License, or (at your"
        " option) any later version."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version."
    ),
    "LGPL-2.1-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General"
        " Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your"
        " option) any later version."
    ),
    "LGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version."
    ),
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version."
    ),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
        " not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
}
ALIKE = 0.6  # share of the words of the longer template from which two are taken to be alike
TELLING = 0.8
# Words that every notice holds at least one of; notices are sought around them.
CUES = rb"(?i:licen[cs]e|copyright|rights[^A-Za-z0-9]+reserved|redistribut|public[^A-Za-z0-9]+domain|hereby[^A-Za-z0-9]+granted)"
_CUE = re.compile(CUES)
# A word may be broken behind a hyphen, also between lines of a comment.
_BREAK = rb"-[ \t]*\r?\n[ \t]*(?:[#*/;%!-]+[ \t]*)?"
_WORD = re.compile(rb"[A-Za-z0-9]+(?:(?:" + _BREAK + rb"|[.-])[A-Za-z0-9]+)*")
_BROKEN = re.compile(_BREAK)
_CLOSING = re.compile(rb"[.,;:!?)\]\"']*")


def _word(token: bytes) -> bytes:
    return (_BROKEN.sub(b"-", token) if b"\n" in token else token).lower()


def words(text: bytes) -> list[bytes]:
    """Words in lower case. Line feeds, comment marks and punctuation between them do not count."""
    return [_word(w) for w in _WORD.findall(text)]


def _parameters() -> zstandard.ZstdCompressionParameters:
    """Settings under which what is not matched is stored as it is.

    Entropy coding of the rest of a small block sets in at a certain size; it would hide
    or feign the few bytes that a short template saves.
    """
    return zstandard.ZstdCompressionParameters(
        compression_level=1, strategy=zstandard.STRATEGY_FAST, target_length=1, min_match=4, window_log=17, hash_log=14,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )


def _reach(length: int) -> int:
    """Words that a notice of a template of ``length`` words may span, with those put in between."""
    return length + length // 2 + 4


def _words_before(text: bytes, end: int, count: int) -> int:
    """Where the ``count`` words before ``end`` start, or somewhat earlier; between words."""
    size = 16 * count
    while True:
        start = max(0, end - size)
        if start == 0:
            return 0
        tokens = [m.start() for m in _WORD.finditer(text, start, end)]
        if len(tokens) > count + 1:  # the first may be the rest of a word
            return tokens[1]
        size *= 2


def blocks(text: bytes, reach: int) -> list[tuple[int, int]]:
    """Byte spans around cues: ``reach`` words on both sides, one span where these meet."""
    out: list[list[int]] = []
    for m in _CUE.finditer(text):
        start = out[-1][0] if out and m.start() < out[-1][1] else _words_before(text, m.start(), reach)
        if out and start <= out[-1][1]:
            start = out.pop()[0]
        end = m.end()
        for w in islice(_WORD.finditer(text, m.start()), reach + 1):
            end = w.end()
        out.append([start, end])
    return [(start, end) for start, end in out]


@dataclass(frozen=True)
class Finding:
    start: int
    end: int
    license: str
    reduction: float
    differences: int


class Matcher:
    """Finds the notices in the blocks around cues, each with the template that explains it best.

    A block of as many words on both sides of a cue as a notice of the template may span
    is compressed alone and with the template as a raw-content dictionary. A template is a
    candidate if that saves at least the share ``least`` of the bytes that it saves on
    itself; the rest of the block hardly matters, because it costs the same both times.
    Candidates are ranked by the bytes saved, so that of two templates that begin alike the
    one that explains more comes first. Their wording decides: ``coverage`` of the
    template's words must stand in the block in order, not spread over more than ``_reach``
    words, no word with a digit may differ, and of the words that tell the template from
    one that is like it ``TELLING`` must be there, and not half of the other's. Of confirmed notices that
    overlap the first in rank wins, then the one with fewer differences; what it leaves is
    compressed and searched again.
    """

    def __init__(self, templates: Mapping[str, str] = TEMPLATES, least: float = 0.4, coverage: float = 0.85) -> None:
        self.least, self.coverage = least, coverage
        self.names = sorted(templates)
        self.wording = [words(templates[n].encode()) for n in self.names]
        self.counts = [Counter(w) for w in self.wording]
        self.reach = [_reach(len(w)) for w in self.wording]
        self.alone = zstandard.ZstdCompressor(compression_params=_parameters())
        plain = [b" ".join(w) for w in self.wording]
        self.given = [
            zstandard.ZstdCompressor(
                dict_data=zstandard.ZstdCompressionDict(t, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=_parameters()
            )
            for t in plain
        ]
        self.own_saving = [self.saving(k, t) for k, t in enumerate(plain)]
        # For each template that is like another: the words that only one of the two holds.
        self.apart: list[list[tuple[set[bytes], set[bytes]]]] = [
            [
                (set(own) - set(other), set(other) - set(own))
                for j, other in enumerate(self.counts)
                if j != k and (own & other).total() >= ALIKE * max(own.total(), other.total())
            ]
            for k, own in enumerate(self.counts)
        ]

    def saving(self, k: int, text: bytes) -> int:
        """Bytes that template ``k`` as a dictionary takes off the compressed text."""
        return len(self.alone.compress(text)) - len(self.given[k].compress(text))

    def ranked(self, block: Sequence[bytes]) -> list[tuple[int, int]]:
        """The templates that explain a block of words: bytes saved and template, best first."""
        text = b" ".join(block)
        saved = ((self.saving(k, text), k) for k in range(len(self.names)))
        return sorted(((n, k) for n, k in saved if n >= self.least * self.own_saving[k]), key=lambda c: (-c[0], c[1]))

    def compare(self, k: int, own: Sequence[bytes]) -> tuple[int, int, int] | None:
        """Differences and span of the notice of template ``k`` in ``own``; None if the wording is another."""
        template = self.wording[k]
        least = self.coverage * len(template)
        if sum(min(n, own.count(w)) for w, n in self.counts[k].items()) < least:
            return None
        same = [m for m in SequenceMatcher(None, template, own, autojunk=False).get_matching_blocks() if m.size]
        best = None
        for i in range(len(same)):
            common = 0
            for j in range(i, len(same)):
                common += same[j].size
                span = same[j].b + same[j].size - same[i].b
                if span > self.reach[k]:
                    break
                if common < least or best and 2 * common - span <= best[0] or not self._same_wording(k, own, same[i : j + 1]):
                    continue
                best = 2 * common - span, len(template) - common + span - common, same[i].b, same[i].b + span
        return best[1:] if best else None

    def _same_wording(self, k: int, own: Sequence[bytes], same: list) -> bool:
        """Neither numbers nor the words that tell the template from another differ."""
        held = {m.b + i for m in same for i in range(m.size)}
        there = {own[i] for i in held}
        added = {own[i] for i in range(same[0].b, same[-1].b + same[-1].size) if i not in held}
        for needed, foreign in self.apart[k]:
            if len(needed & there) < TELLING * len(needed) or foreign and 2 * len(foreign & added) >= len(foreign):
                return False
        return self._same_numbers(self.wording[k], own, same)

    @staticmethod
    def _same_numbers(template: list[bytes], own: Sequence[bytes], same: list) -> bool:
        """No word of the template with a digit is missing, nor comes behind another number put in."""
        number = lambda w: any(c in b"0123456789" for c in w)
        at = {m.a + i: m.b + i for m in same for i in range(m.size)}
        before = None
        for i, w in enumerate(template):
            if number(w) and (i not in at or before is not None and any(map(number, own[before + 1 : at[i]]))):
                return False
            before = at.get(i, before)
        return True

    def notices(self, own: list[bytes], cues: list[int]) -> list[tuple[int, int, float, int, int]]:
        """Template, differences, reduction and word span of each notice; ``cues``: the places of cue words."""
        taken: list[tuple[int, int]] = []
        waiting: list[tuple] = []

        # For text that repeats itself.
        saving = lru_cache(4096)(self.saving)
        compare = lru_cache(1024)(lambda k, *block: self.compare(k, block))

        def look(k: int, cue: int) -> None:
            at = bisect_right(taken, (cue, len(own)))
            low = max(cue - self.reach[k], taken[at - 1][1] if at else 0, 0)
            high = min(cue + self.reach[k], taken[at][0] if at < len(taken) else len(own), len(own))
            if not low <= cue < high:
                return
            block = own[low:high]
            saved = saving(k, b" ".join(block))
            if saved >= self.least * self.own_saving[k] and (found := compare(k, *block)):
                differences, first, last = found
                heappush(waiting, (-saved, differences, k, low + first, low + last, cue))

        for cue in cues:
            for k in range(len(self.names)):
                look(k, cue)
        out = []
        while waiting:
            saved, differences, k, first, last, cue = heappop(waiting)
            at = bisect_right(taken, (first, last))
            if at and taken[at - 1][1] > first or at < len(taken) and taken[at][0] < last:
                look(k, cue)
            else:
                taken.insert(at, (first, last))
                out.append((k, differences, -saved / self.own_saving[k], first, last))
                if not first <= cue < last:  # the cue's own notice may lie beside it
                    look(k, cue)
        return sorted(out, key=lambda n: n[3])

    def scan(self, text: bytes) -> tuple[int, list[Finding]]:
        """How many blocks were candidates, and the notices confirmed."""
        found, spans = [], blocks(text, max(self.reach, default=0))
        for start, end in spans:
            tokens = list(_WORD.finditer(text, start, end))
            ends = [m.end() for m in tokens]
            cues = sorted({min(bisect_right(ends, m.start()), len(ends) - 1) for m in _CUE.finditer(text, start, end)})
            for k, differences, saved, first, last in self.notices([_word(m.group()) for m in tokens], cues):
                closed = _CLOSING.match(text, ends[last - 1]).end()
                found.append(Finding(tokens[first].start(), closed, self.names[k], saved, differences))
        return len(spans), found


def notices(text: Column, templates: Mapping[str, str] = TEMPLATES) -> Column:
    """A struct of ``candidates`` and ``found``: spans in code points, license, saving, differences."""

    @F.arrow_udf("struct<candidates:bigint,found:array<struct<start:bigint,end:bigint,license:string,reduction:double,differences:bigint>>>")
    def of(column: pa.Array) -> pa.Array:
        matcher = Matcher(templates)
        out = []
        for t in texts_as_bytes(column):
            n, found = matcher.scan(t)
            at = lambda byte: len(t[:byte].decode("utf-8", "replace"))  # noqa: E731, B023
            out.append(
                {
                    "candidates": n,
                    "found": [
                        {"start": at(f.start), "end": at(f.end), "license": f.license, "reduction": f.reduction, "differences": f.differences}
                        for f in found
                    ],
                }
            )
        span = pa.struct(
            [("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("reduction", pa.float64()), ("differences", pa.int64())]
        )
        return pa.array(out, pa.struct([("candidates", pa.int64()), ("found", pa.list_(span))]))

    return of(text)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """One row per document: ``doc_id``, ``n_candidates``, ``n_notices``, ``licenses`` (the
    different names, sorted, comma-joined) and ``found`` (the confirmed notices; a span ends
    with the punctuation behind its last word). ``n_candidates`` counts the blocks around cues.

    Null and blank texts have none. Null and repeated ids keep their rows; equal texts get
    equal results. Whole texts are searched, across lines and comment marks; a block may
    hold several notices. Extra columns are not read. An empty table gives no rows.
    """
    own = picked(docs, doc_id=id_col, text=text_col).select("doc_id", notices(F.col("text"), templates).alias("n"))
    return own.select(
        "doc_id",
        F.col("n.candidates").alias("n_candidates"),
        F.size("n.found").cast("bigint").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct("n.found.license")), ",").alias("licenses"),
        F.col("n.found").alias("found"),
    )


@register("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(load(spark, sf_dir, "documents"))
    spans = F.transform("found", lambda f: F.concat_ws(":", f["license"], f["start"], f["end"], f["differences"]))
    return found.select("doc_id", "n_candidates", "n_notices", "licenses", F.array_join(spans, ",").alias("spans"))
