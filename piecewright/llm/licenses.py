"""License scans: conditional compression with each license text as a raw dictionary, confirmed by wording."""

from __future__ import annotations

import bisect
import difflib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Notices by which public licenses are given, as their stewards word them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed under the Apache License, Version 2.0.",
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Licensed under the BSD 2-Clause License.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under the BSD 3-Clause License.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2.",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
    ),
    "LGPL-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Licensed under CC0 1.0.",
    ),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "CC-BY-ND-4.0": ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0."),
    "CC-BY-NC-SA-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."),
    "CC-BY-NC-ND-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "Licensed under CC BY-NC-ND 4.0."),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    ),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}


def spdx(license_: str) -> tuple[str, ...]:
    """The identifier lines of a license."""
    ends = ("", "-only", "-or-later") if "GPL" in license_ else ("",)
    return tuple(f"SPDX-License-Identifier: {license_}{e}" for e in ends)


TEMPLATES = {name: (*texts, *spdx(name)) for name, texts in TEMPLATES.items()}
#: Words without which a stretch isn't a candidate.
TRIGGER = re.compile(r"licen[sc]e|permission[\W_]+(?:is|to)|redistribut|public[\W_]+domain|waived[\W_]+all[\W_]+copyright|implied[\W_]+warrant", re.I)
#: A winner's size must fall by this part, and this part of the template's words must be there in order.
LEAST_GAIN, LEAST_WORDING = 0.25, 0.85
_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
#: A number that begins an item of a list, after a line's or a sentence's end; bullets aren't words anyway.
_MARKER = re.compile(r"(?:[:.;,]\s+|(?:^|\n)[^\w\n]{0,8})\(?(\d{1,2})[.)]\s")
#: Words that tell licenses apart: one that a template has and a block doesn't, or the reverse, rules the template out.
TELLING = frozenset("2 3 1 4 2.0 2.1 3.0 1.0 4.0 lesser affero by-nc by-sa by-nd by-nc-sa by-nc-nd cc0 apache mit mozilla isc bsd eclipse boost 2-clause 3-clause noncommercial sharealike noderivatives attribution-noncommercial attribution-sharealike attribution-noderivatives attribution-noncommercial-sharealike attribution-noncommercial-noderivatives neither endorse".split())


def _even(text: str) -> str:
    return " ".join(w for w in text.lower().split() if _WORD.search(w))


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where words begin and end, without the numbers of list items."""
    markers = {m.start(1) for m in _MARKER.finditer(text)}
    return [m.span() for m in _WORD.finditer(text) if m.start() not in markers]


def words(text: str) -> list[str]:
    return [text[a:b].lower() for a, b in word_spans(text)]


@dataclass(frozen=True)
class Template:
    license: str
    number: int
    text: str

    @cached_property
    def even(self) -> bytes:
        return _even(self.text).encode()

    @cached_property
    def words(self) -> list[str]:
        return words(self.text)

    @cached_property
    def distinct(self) -> frozenset[str]:
        return frozenset(self.words)

    @cached_property
    def places(self) -> list[int]:
        """The words at which triggers stand; any word, if there is none."""
        starts = [a for a, _ in word_spans(self.text)]
        return sorted({bisect.bisect_right(starts, hit.start()) - 1 for hit in TRIGGER.finditer(self.text)}) or list(range(len(starts)))


class Scanner:
    """All templates, each with a compressor that has it as a raw dictionary."""

    def __init__(self, templates: dict[str, tuple[str, ...]], level: int = 3):
        self.templates = [Template(name, i, t) for name, texts in templates.items() for i, t in enumerate(texts)]
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.given = [zstandard.ZstdCompressor(level=level, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(t.even, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for t in self.templates]
        self.memo: dict[tuple[str, int], tuple | None] = {}

    def gain(self, block: str, k: int) -> float:
        """The part of the compressed size that template k saves."""
        data = _even(block).encode("utf-8", "replace")
        return 1 - len(self.given[k].compress(data)) / len(self.plain.compress(data))

    def confirm(self, block: str, template: Template) -> tuple[float, list[str], int, int] | None:
        """(part of the template's words present in order, the differing words, first and end of the block's words that
        it covers), or None if the wording is another's."""
        own, theirs = words(block), template.words
        found = difflib.SequenceMatcher(None, theirs, own, autojunk=False).get_matching_blocks()
        same = sum(m.size for m in found)
        if same < LEAST_WORDING * len(theirs):
            return None
        held = [m for m in found if m.size]
        inside = own[held[0].b : held[-1].b + held[-1].size]
        missing, i = [], 0
        for m in found:
            missing += theirs[i : m.a]
            i = m.a + m.size
        extra, j = [], held[0].b
        for m in held:
            extra += own[j : m.b]
            j = m.b + m.size
        if len(inside) > 1.3 * len(theirs) + 2 or any(w in TELLING for w in missing + extra):
            return None
        return same / len(theirs), [f"-{w}" for w in missing] + [f"+{w}" for w in extra], held[0].b, j

    def fit(self, block: str, k: int) -> tuple | None:
        """(license, template, gain, share of wording, differences, words, first and end of them in the block), if
        template k saves enough of the block and the wording confirms it."""
        if (block, k) not in self.memo:
            if len(self.memo) > 20_000:
                self.memo.clear()
            t, gain = self.templates[k], self.gain(block, k)
            said = self.confirm(block, t) if gain >= LEAST_GAIN else None
            self.memo[block, k] = (t.license, t.number, gain, said[0], said[1], len(t.words) * said[0], said[2], said[3]) if said else None
        return self.memo[block, k]

    def scan(self, text: str) -> Iterator[tuple[int, tuple]]:
        """(line, finding) of each confirmed notice, at the line where it starts. A trigger is laid on each trigger of
        each template; the block is the words that the template then covers, wherever lines end, with and without as
        many to either side as may be added. The template that covers the most words with the trigger among them is
        found, and the triggers after these words go on."""
        hits = [hit.start() for hit in TRIGGER.finditer(text)]
        if not hits:
            return
        spans = word_spans(text)
        starts, own, free = [a for a, _ in spans], [text[a:b].lower() for a, b in spans], 0
        for at in dict.fromkeys(bisect.bisect_right(starts, hit) - 1 for hit in hits):
            if at < free:
                continue
            found = []
            for k, t in enumerate(self.templates):
                n = len(t.words)
                added = int(0.3 * n) + 2
                if len(t.distinct.difference(own[max(free, at - n - added) : at + n + added])) > (1 - LEAST_WORDING) * n:
                    continue  # the wording can't be there
                for lo, hi in {(max(free, at - p - more), min(len(own), at - p + n + more)) for p in t.places for more in (0, added)}:
                    if lo < hi and (f := self.fit(text[spans[lo][0] : spans[hi - 1][1]], k)) and lo + f[6] <= at < lo + f[7]:
                        found.append((f[5], f[2], lo + f[6], lo + f[7], f))
            if found:
                *_, first, free, top = max(found, key=lambda f: f[:2])
                yield text.count("\n", 0, spans[first][0]), top


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(id_col, line, license, template, gain, wording, differences) for each confirmed license notice of each text.

    Words that any notice has give candidate blocks, which may begin and end anywhere in the text's lines (counted
    from 0). Each is compressed alone and with a template as a raw Zstandard dictionary; where that saves enough, the
    template is held against the block word by word: nearly all of the template's words must be there in order, and no
    word that tells licenses apart may differ. `differences` lists the words missing (-) and added (+). All templates are tried
    at each place; of those that fit, the one that covers most words is given, of equals the one that saves most, of
    equals again the first in the list. Null, empty and other texts without notices have no rows; null ids are kept;
    rows that repeat an id each give theirs; other columns are not read; an empty table gives none. Very long texts are
    cut into words once; the work grows with the words that any notice has.
    """
    common.prepare(docs.sparkSession)
    known = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known)
        for batch in batches:
            out = [(i, line, *f[:4], " ".join(f[4])) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for line, f in scanner.scan(t)]
            if out:
                kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [id_col, "line", "license", "template", "gain", "wording", "differences"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` long, line int, license string, template int, gain double, wording double, differences string")
