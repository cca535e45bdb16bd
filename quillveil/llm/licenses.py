"""License scans by conditional compression.

License cues open candidate blocks: at the start of their line and sentence for every template that reaches from there to the
cue, and, for each template that holds the cue, where the template would start if its cue were this one. Every template holds a
cue, so a block that stops short of its cue need not be tried. The notices' wordings and the one-line tags of source files are
templates alike. A block is compressed with a license template as raw
zstandard dictionary; every template that saves a fair share of what the block takes without a dictionary is held against it by
exact comparison of words: most words of the template must occur in order, and the words missing and added are counted. The
template with most words less those is taken.

Edge cases: null and empty texts hold no license; long texts are read whole, line by line; a text with several notices yields
each of them, repeats included; repeated rows are scanned alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from difflib import SequenceMatcher
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillveil.llm.workers import lean

#: The wordings of licenses and of their usual notices.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    "LGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: The line that names a license in a source file; those of the GNU licenses also say which versions hold.
TAG = "SPDX-License-Identifier: "
TAG_ENDS = ("", "-only", "-or-later")
CUES = ("licens", "licenc", "copyright", "permission", "redistribut", "public domain", "creative commons", "cc by", "gnu ", "free software")
#: A block is read to this many characters more than a template has.
SLACK = 32
LEAST_GAIN = 0.3
LEAST_WORDS = 0.85
_WORD = re.compile(r"[a-z0-9][a-z0-9.\-]*[a-z0-9]|[a-z0-9]")
_CUE = re.compile("|".join(map(re.escape, CUES)))


class Found(NamedTuple):
    license: str
    start: int
    end: int
    gain: float
    missing: int
    added: int


class _Template(NamedTuple):
    license: str
    text: str
    words: list[str]
    compressor: zstandard.ZstdCompressor


@lru_cache(1)
def _templates() -> tuple[list[_Template], zstandard.ZstdCompressor]:
    options = zstandard.ZstdCompressionParameters.from_level(12, write_content_size=0, write_checksum=0, write_dict_id=0)
    out = []
    for name, texts in TEMPLATES.items():
        for t in (*texts, *(f"{TAG}{name}{end}" for end in TAG_ENDS if not end or "GPL" in name)):
            own = " ".join(t.lower().split())
            raw = zstandard.ZstdCompressionDict(own.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            out.append(_Template(name, own, _WORD.findall(own), zstandard.ZstdCompressor(compression_params=options, dict_data=raw)))
    return out, zstandard.ZstdCompressor(compression_params=options)


def gain(block: str, i: int) -> float:
    """Share of the compressed size of a block, of the template's length at most, that template i saves."""
    templates, plain = _templates()
    data = block[: len(templates[i].text) + SLACK].encode("utf-8", "surrogatepass")
    return 1 - len(templates[i].compressor.compress(data)) / len(plain.compress(data))


@lru_cache(1)
def _aligned() -> dict[str, list[tuple[int, int]]]:
    """Each cue's places in the templates: words before the one that it starts in, and the template."""
    out: dict[str, set[tuple[int, int]]] = {c: set() for c in CUES}
    for i, t in enumerate(_templates()[0]):
        ends = [m.end() for m in _WORD.finditer(t.text)]
        for m in _CUE.finditer(t.text):
            out[m[0]].add((bisect_right(ends, m.start()), i))
    return {c: sorted(x) for c, x in out.items()}


def scan(text: str) -> list[Found]:
    """The license notices of a text in order; they don't overlap."""
    lower = text.lower()
    if len(lower) != len(text):  # some letters change their length; offsets must hold
        lower = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    if not any(c in lower for c in CUES):
        return []
    out: list[Found] = []
    templates, _ = _templates()
    longest = max(len(t.text) for t in templates) + SLACK
    spots = [m.span() for m in _WORD.finditer(lower)]
    ends = [e for _, e in spots]
    done = 0
    for cue in _CUE.finditer(lower):
        if cue.start() < done:
            continue
        least = max(done, cue.start() - longest)
        line = max(lower.rfind("\n", least, cue.start()) + 1, least)
        stop = lower.rfind(". ", line, cue.start())
        sentence = stop + 2 if stop >= 0 else line
        starts = {(start, i) for start in (line, sentence) for i, t in enumerate(templates) if cue.start() - start < len(t.text) + SLACK}
        at = bisect_right(ends, cue.start())
        starts |= {(spots[at - k][0], i) for k, i in _aligned()[cue[0]] if k <= at and spots[at - k][0] >= done}
        best: Found | None = None
        for start, i in sorted(starts):
            block = re.sub(r"\s", " ", lower[start : start + longest])
            saved = gain(block, i)
            if saved < LEAST_GAIN:
                continue
            t = templates[i]
            words = [(m[0], m.end()) for m in _WORD.finditer(block[: len(t.text) + SLACK])]
            match = SequenceMatcher(None, t.words, [w for w, _ in words], autojunk=False).get_matching_blocks()
            same = sum(m.size for m in match)
            if not same or same < LEAST_WORDS * len(t.words):
                continue
            last = max(m.b + m.size for m in match if m.size)
            found = Found(t.license, start, start + words[last - 1][1], round(saved, 4), len(t.words) - same, last - same)
            if best is None or (found.missing + found.added - len(t.words), -found.gain) < (best.missing + best.added - size, -best.gain):
                best, size = found, len(t.words)
        if best:
            out.append(best)
            done = best.end
    return out


def find(df: DataFrame, text: str = "text", out: str = "licenses") -> DataFrame:
    """df without `text`, with column `out`: an array of structs license, start, end, gain, missing, added."""
    names = [c for c in df.columns if c not in (text, out)]
    kinds = [("license", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("gain", T.DoubleType()), ("missing", T.IntegerType()), ("added", T.IntegerType())]
    arrow = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("gain", pa.float64()), ("missing", pa.int32()), ("added", pa.int32())]))

    def run(batches):
        for batch in batches:
            found = pa.array([[x._asdict() for x in scan(t)] if t else [] for t in batch.column(0).to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], found], names=[*names, out])

    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(out, T.ArrayType(T.StructType([T.StructField(n, t) for n, t in kinds])))])
    return df.select(F.col(text).cast("string").alias("\0text"), *(F.col(f"`{c}`") for c in names)).mapInArrow(lean(run), schema)
