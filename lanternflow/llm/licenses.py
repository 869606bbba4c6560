"""License scan by conditional compression.

Lines are folded into sentences (a notice may be wrapped, indented or commented out), and
neighbouring sentences that use a word of licensing or of a template form candidate blocks. Each
block is compressed alone and with every template as a raw zstandard dictionary; templates that
save anything are compared word by word around their longest common run, and are confirmed if
enough of the words of the notice agree. The one with most words beyond its differences wins
these words; what is left of the block is judged again, so that a block gives every license in
it. The differences in wording are returned.

The scan is a map over documents. Rows without a licensing word are passed over in the JVM.
"""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternflow.llm.common import boxed

# Notices of common licenses, several wordings each.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}
AGREE = 0.8

# White space and what comments put at the begin of a line.
_FOLD = r"[ \t]*\r?\n[ \t]*(?:(?:[#*;%|>!]+|//+|/\*+|--+)[ \t]*)*"
_NEWLINE, _SENTENCE = re.compile(_FOLD), re.compile(r"(?<=[.!?;:])\s+|\n")
_WORD = re.compile(r"\w[\w.+-]*\w|\w")
_LETTERS = re.compile(r"[^\W\d_]{2}")
_GENERAL = r"licen[cs]e|copyright|all rights reserved|spdx|public domain|without warranty|permission is hereby"


def _derived_trigger() -> str:
    """Licensing words, and of every template sentence without one its longest words."""
    more: set[str] = set()
    for wording in (w for ws in TEMPLATES.values() for w in ws):
        for sentence in _SENTENCE.split(wording):
            if not re.search(_GENERAL, sentence, re.I):
                words = sorted({w for w in re.findall("[a-z]{5,}", sentence.lower())}, key=lambda w: (-len(w), w))
                more.update(words[:3])
    return r"(?i)" + _GENERAL.replace(" ", r"\s+(?:(?:[#*;%|>!]+|//+|--+)\s*)*") + "".join(rf"|\b{w}\b" for w in sorted(more))


TRIGGER = _derived_trigger()
_TRIGGER = re.compile(TRIGGER)


@lru_cache(maxsize=1)
def _compressors():
    plain = zstandard.ZstdCompressor(level=19)
    keyed = []
    for name, wordings in sorted(TEMPLATES.items()):
        for wording in wordings:
            raw = zstandard.ZstdCompressionDict(wording.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            keyed.append((name, wording, zstandard.ZstdCompressor(level=19, dict_data=raw)))
    return plain, keyed


def candidate_blocks(text: str) -> list[str]:
    """Runs of neighbouring sentences that use licensing words, in order, white space folded.

    Stops, semicolons, colons and empty lines end a sentence; other line ends are wraps.
    """
    parts = [re.sub(r"\s+", " ", p) for p in re.split(r"\n(?=\n)", _NEWLINE.sub("\n", "\n" + text))]
    blocks, run = [], []
    for part in parts:
        for sentence in _SENTENCE.split(part):
            if not sentence.strip():
                continue
            if _TRIGGER.search(sentence) or run and not _LETTERS.search(sentence):  # a list number ends no run
                run.append(sentence.strip())
            elif run:
                blocks.append(" ".join(run))
                run = []
    return blocks + ([" ".join(run)] if run else [])


def rank_templates(block: str) -> list[tuple[float, str, str]]:
    """(share of the compressed size saved, license, wording), best first; ties by name."""
    plain, keyed = _compressors()
    data = block.encode()
    alone = len(plain.compress(data))
    return sorted(((1 - len(c.compress(data)) / alone, name, wording) for name, wording, c in keyed), key=lambda x: (-x[0], x[1], x[2]))


def _compare(a: list[str], b: list[str]) -> tuple[int, list[str], int, int]:
    """(words that agree in order, differences, begin and end in ``b``) around the longest common run.

    Words of ``b`` before the first and after the last that agrees are no differences.
    """
    m = SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
    low = max(m.b - 2 * m.a - 10, 0)
    near = b[low:m.b + 2 * (len(a) - m.a) + 10]
    ops = SequenceMatcher(None, a, near, autojunk=False).get_opcodes()
    same = [(k, n) for op, _, _, k, n in ops if op == "equal"]
    if not same:
        return 0, [], 0, 0
    begin, end = same[0][0], same[-1][1]
    diff = []
    for op, i, j, k, n in ops:
        if op != "equal":
            diff += [f"-{w}" for w in a[i:j]] + [f"+{w}" for w in near[max(k, begin):min(n, end)]]
    return sum(n - k for k, n in same), diff, low + begin, low + end


def wording_differences(block: str, wording: str) -> tuple[float, list[str]]:
    """(share of the notice's words that agree in order, differences as ``-word`` and ``+word``)."""
    a = _WORD.findall(wording.lower())
    equal, diff, _, _ = _compare(a, _WORD.findall(block.lower()))
    return equal / max(len(a), 1), diff


@lru_cache(maxsize=20_000)
def judge_block(block: str) -> list[tuple[str, float, float, tuple[str, ...]]]:
    """(license, saved, agreement, differences) of every notice in the block, in their order.

    All templates that save anything are tried. The notice with most agreeing words less its
    differences is taken, then its words are taken out and the rest is judged again.
    """
    words = _WORD.findall(block.lower())
    templates = [(saved, name, _WORD.findall(wording.lower())) for saved, name, wording in rank_templates(block) if saved > 0]
    found = []
    while True:
        best, counts = None, Counter(words)
        for saved, name, a in templates:
            if sum((Counter(a) & counts).values()) < AGREE * len(a):    # can't agree
                continue
            equal, diff, begin, end = _compare(a, words)
            if equal >= AGREE * len(a) and (best is None or (equal - len(diff), saved) > best[0]):
                best = (equal - len(diff), saved), name, equal / len(a), tuple(diff), begin, end
        if best is None:
            return [x for _, x in sorted(found)]
        (_, saved), name, agree, diff, begin, end = best
        found.append((begin, (name, saved, agree, diff)))
        words[begin:end] = [""] * (end - begin)     # no word of a template, and the places stay


def scan_text(text: str | None) -> tuple[int, list[dict]]:
    """(number of candidate blocks, confirmed notices in order)."""
    if not text or not _TRIGGER.search(text):
        return 0, []
    blocks = candidate_blocks(text)
    return len(blocks), [{"license": j[0], "saved": round(j[1], 6), "agreement": round(j[2], 6), "differences": list(j[3]), "block": b}
                         for b in blocks for j in judge_block(b)]


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Add ``n_blocks, notices (license, saved, agreement, differences, block), licenses`` to ``docs(text, ...)``.

    ``licenses`` are the distinct names, sorted. Null, empty and unlicensed texts have none. All
    rows and other columns stay; columns of these names are replaced. Whole texts are scanned.
    """
    shape = ("struct<n:long,notices:array<struct<license:string,saved:double,agreement:double,"
             "differences:array<string>,block:string>>>")

    @F.pandas_udf(shape)
    def scan(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scan_text(t) for t in texts], columns=["n", "notices"])

    found = boxed(docs, "n_blocks", "notices", "licenses").withColumn(
        "_s", scan(F.when(F.col("_row.text").rlike(TRIGGER), F.col("_row.text"))))
    return found.select("_row.*", F.col("_s.n").alias("n_blocks"), F.col("_s.notices").alias("notices"),
                        F.array_sort(F.array_distinct(F.transform("_s.notices", lambda x: x["license"]))).alias("licenses"))
