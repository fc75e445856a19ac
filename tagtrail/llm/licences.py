"""License scans: normalised passages against licence templates by the Dice coefficient of their word bigrams.

A text is cut into pieces at line ends and after sentence marks. A piece at least half of whose bigrams occur in the
templates is licence-like; a unit is a maximal run of such pieces or one of them. Pieces without words do not break a run,
nor do those of one word, as a list number or a wrapped line is: what stands between two pieces of a run belongs to it. A unit is compared only with templates whose size allows the threshold: Dice(A, B) >= t needs
t / (2 - t) <= |A| / |B| <= (2 - t) / t. Whole texts are passed over when they hold none of the anchor words. Those are
chosen so that they touch over 1 - t / (2 - t) of each template's bigrams, of which any match has that share at least.

Only DataFrame functions run, row by row: nothing is shuffled. Null or empty text: no row. A licence that stands twice
gives two rows, and a third if both together still match as a run; repeated rows of the table are reported each. Very long
texts are scanned whole. An empty table gives no rows. Carried columns that are named like a new one give way to it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

THRESHOLD = 0.8
LIKE = 0.5

# Wording of public licences and of the notices by which texts refer to them.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit-notice": "Released under the MIT License.",
    "mit-notice-licensed": "Licensed under the MIT License.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-3-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.',
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "epl-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "mit-notice-project": "This project is licensed under the MIT License.",
    "mit-notice-software": "This software is released under the MIT License.",
    "mit-notice-file": "This project is licensed under the MIT License - see the LICENSE file for details.",
    "apache-2.0-notice-project": "This project is licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice-code": "Code in this repository is licensed under the Apache License, Version 2.0.",
    "bsd-3-clause-notice": "This project is licensed under the BSD 3-Clause License.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def words(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def bigrams(of: Column) -> Column:
    """The different pairs of neighbouring words."""
    pairs = F.zip_with(F.slice(of, 1, F.size(of) - 1), F.slice(of, 2, F.size(of) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(of) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def plain_bigrams(text: str) -> list[str]:
    own = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(own, own[1:])})


def anchors(templates: Mapping[str, str], threshold: float) -> list[str]:
    """Long words first, as many as needed to touch over 1 - t / (2 - t) of the bigrams of each template."""
    chosen: set[str] = set()
    for text in templates.values():
        own = plain_bigrams(text)
        need = len(own) * (1 - threshold / (2 - threshold))
        for word in sorted({w for b in own for w in b.split()}, key=lambda w: (-len(w), w)):
            if sum(any(w in chosen for w in b.split()) for b in own) > need:
                break
            chosen.add(word)
    return sorted(chosen)


def _constant(values: Sequence[str]) -> Column:
    return F.split(F.lit("|".join(values)), r"\|")


def scan(
    documents: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",), templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per unit and template that it matches: ``license``, ``dice``, first and last piece, bigrams of the unit."""
    sizes = {name: plain_bigrams(t) for name, t in templates.items()}
    vocabulary = sorted({b for own in sizes.values() for b in own})
    taken = {"license", "dice", "first_piece", "last_piece", "n_bigrams"}
    carried = [c for c in carry if c not in taken]
    source = documents.select(*carried, F.col(text).alias("_text"))
    held = source.where(F.arrays_overlap(words(F.col("_text")), _constant(anchors(templates, threshold))))
    pieces = F.split(F.regexp_replace("_text", "([.!?;:])[ \\t\\r\\n]+", "$1\n"), "\n")
    worded = F.filter(F.transform(pieces, lambda p, i: F.struct(i.alias("at"), words(p).alias("words"))), lambda p: F.size(p["words"]) > 0)
    placed = F.transform(worded, lambda p, i: F.struct(p["at"].alias("at"), i.alias("i"), p["words"].alias("words")))

    def like(own: Column) -> Column:
        pairs = bigrams(own)
        return (F.size(pairs) > 0) & (F.size(F.array_intersect(pairs, _constant(vocabulary))) >= LIKE * F.size(pairs))

    # ``i`` counts all pieces with words, ``nth`` those of two words and more.
    sentences = F.filter("_w", lambda p: F.size(p["words"]) > 1)
    marked = held.select(*carried, placed.alias("_w")).select(
        *carried, "_w",
        F.transform(sentences, lambda p, n: F.struct(p["at"].alias("first"), p["at"].alias("last"), p["i"].alias("i"), n.alias("nth"), p["words"].alias("words"), like(p["words"]).alias("like"))).alias("_p"),
    )
    single = F.filter("_p", lambda p: p["like"])
    empty = F.filter(single, lambda p: F.lit(False))

    def joined(runs: Column, piece: Column) -> Column:
        """Append a licence-like piece to the run before it if only pieces of one word stand between them."""
        before = F.try_element_at(runs, F.lit(-1))
        between = F.flatten(F.transform(F.slice("_w", before["i"] + 2, piece["i"] - before["i"] - 1), lambda p: p["words"]))
        merged = F.struct(
            before["first"].alias("first"), piece["last"].alias("last"), piece["i"].alias("i"), piece["nth"].alias("nth"),
            F.concat(before["words"], between, piece["words"]).alias("words"), F.lit(True).alias("like"),
        )
        return F.when(
            before.isNotNull() & (before["nth"] + 1 == piece["nth"]), F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(merged))
        ).otherwise(F.concat(runs, F.array(piece)))

    runs = F.aggregate(single, empty, joined)
    several = F.filter(runs, lambda r: r["first"] < r["last"])
    units = marked.select(*carried, F.explode(F.concat(single, several)).alias("_u")).select(
        *carried, F.col("_u.first").alias("first_piece"), F.col("_u.last").alias("last_piece"), bigrams(F.col("_u.words")).alias("_b")
    ).withColumn("n_bigrams", F.size("_b"))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold

    def against(name: str, own: list[str]) -> Column:
        fits = F.col("n_bigrams").between(low * len(own) - 1e-9, high * len(own) + 1e-9)
        dice = 2.0 * F.size(F.array_intersect("_b", _constant(own))) / (F.col("n_bigrams") + len(own))
        return F.when(fits, F.struct(F.lit(name).alias("license"), dice.alias("dice")))

    matches = F.array(*[against(name, own) for name, own in sizes.items()])
    return units.select(*carried, "first_piece", "last_piece", "n_bigrams", F.explode(F.array_compact(matches)).alias("_m")).where(F.col("_m.dice") >= threshold).select(
        *carried, "_m.license", "_m.dice", "first_piece", "last_piece", "n_bigrams"
    )
