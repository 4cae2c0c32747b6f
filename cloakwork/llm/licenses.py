"""License scans in DataFrame functions: normalised text against licence templates.

Text is normalised (ASCII capitals lowered, all but letters, digits and characters beyond ASCII taken
as breaks between words). A template is compared, by the Dice coefficient of the sets of word bigrams,
with every window of as many words as it has that begins with one of its bigrams (and is cut off by the
text's end). So a notice is found within other prose and however its lines are wrapped, and a licence
anywhere in a longer text. Size bounds prune: a Dice of `least` takes a share of least / (2 - least) of
the template's bigrams, so a template is left out for a text, and a window for a template, that has fewer;
and most texts are passed by a search for the words without which no template has enough bigrams.

Of windows that overlap and belong to different licences, the one with more shared bigrams stands (then
the higher Dice, then the first name): the text of a longer licence is none of the shorter ones inside it.

Cases: null or empty texts, and texts of one word, hold no licence; repeated rows each get their own
result; texts of any length are read whole; an empty table gives an empty result; columns besides doc_id
and text are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CAPITALS, SMALL, lower_ascii

LEAST = 0.8
_PART = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Public wording by which texts name or hold their licence, by SPDX id.
_AS_IS = "AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NO_ENDORSEMENT = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" '
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} License for more details."
_GNU_NOTICE = "This work is licensed under the GNU {kind} License, version {version}."
_CC = "This work is licensed under a Creative Commons {kind} 4.0 International License."
TEMPLATES = {
    "0BSD": ('Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',),
    "AGPL-3.0": (_GNU_NOTICE.format(kind="Affero General Public", version="3"), _GNU.format(kind="Affero General Public", version="3")),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", f"{_BSD_TWO} {_BSD_END}{_AS_IS}"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", f"{_BSD_TWO} {_NO_ENDORSEMENT} {_BSD_END}{_AS_IS}"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", _CC.format(kind="Attribution")),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", _CC.format(kind="Attribution-NonCommercial")),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", _CC.format(kind="Attribution-ShareAlike")),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "GPL-2.0": (_GNU_NOTICE.format(kind="General Public", version="2"), _GNU.format(kind="General Public", version="2")),
    "GPL-3.0": (_GNU_NOTICE.format(kind="General Public", version="3"), _GNU.format(kind="General Public", version="3")),
    "ISC": ('Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',),
    "LGPL-2.1": (_GNU.format(kind="Lesser General Public", version="2.1"),),
    "LGPL-3.0": (_GNU_NOTICE.format(kind="Lesser General Public", version="3"), _GNU.format(kind="Lesser General Public", version="3")),
    "MIT": ("Released under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    "MPL-2.0": ("This work is licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "Proprietary": ("All rights reserved.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "WTFPL": ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",),
}
COMMON = frozenset("a all an and any are as at be by for from in is it may no not of on or that the this to under use with without you".split())


def templates_of(texts: dict[str, tuple[str, ...]] = TEMPLATES) -> list[tuple[str, str]]:
    """name, text of every template: the given texts, and a line with the SPDX id for every name."""
    return [(name, text) for name in sorted(texts) for text in (*texts[name], f"SPDX-License-Identifier: {name}")]


def words_of(text: str) -> list[str]:
    return [w for w in re.split(_BREAKS, text.translate(str.maketrans(CAPITALS, SMALL))) if w]


def grams_of(text: str) -> list[tuple[str, str]]:
    """The distinct word bigrams of a template."""
    words = words_of(text)
    return sorted(set(zip(words, words[1:])))


def needed(size: int, least: float = LEAST) -> int:
    """How many of its bigrams a window must share with a template of that size."""
    return -int(-(least / (2 - least) * size - 1e-9) // 1)


def telling_words(templates: list[tuple[str, str]], least: float = LEAST) -> list[str]:
    """Words of which every text with a match holds one: without them no template has enough bigrams.

    Long words are preferred, as fewer other texts have them, and common ones taken last.
    """
    chosen: list[str] = []
    open_ = {i: g for i, (_, text) in enumerate(templates) if len(g := grams_of(text))}
    while open_:
        count = Counter(w for grams in open_.values() for g in grams for w in g)
        word = min(count, key=lambda w: (w in COMMON, -min(len(w), 9), -count[w], w))
        chosen.append(word)
        for i in list(open_):
            open_[i] = [g for g in open_[i] if word not in g]
            if len(open_[i]) < needed(len(grams_of(templates[i][1])), least):
                del open_[i]
    return sorted(chosen)


def _normal_words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), _BREAKS, -1), "")


def _pairs(words: Column) -> Column:
    n = F.size(words) - 1
    return F.when(n > 0, F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b))).otherwise(F.expr("cast(array() as array<bigint>)"))


def _named(value: Column, use) -> Column:
    """use(value), with the value bound to a name: it is worked out once and not at every use."""
    return F.transform(F.array(value), use)[0]


def _best_window(pairs: Column, t: Column, least: float) -> Column:
    """struct(shared, dice, at): of the template's windows the best that is near enough, or null."""
    starts = F.filter(F.transform(pairs, lambda h, i: F.when(F.array_contains(t["grams"], h), i)), lambda i: i.isNotNull())

    def judged(found: Column) -> Column:
        # so many bigrams of the template must follow within the window
        far = F.transform(found, lambda s, k: F.struct(s.alias("s"), F.get(found, k + t["need"] - 1).alias("e")))
        close = F.filter(far, lambda x: x["e"] < x["s"] + t["words"] - 1)

        def score(x: Column) -> Column:
            window = F.array_distinct(F.slice(pairs, x["s"] + 1, t["words"] - 1))
            shared = F.size(F.array_intersect(window, t["grams"]))
            dice = F.lit(2.0) * shared / (F.size(window) + F.size(t["grams"]))
            return F.struct(shared.alias("shared"), dice.alias("dice"), (-x["s"]).alias("at"))

        return F.array_max(F.filter(F.transform(close, score), lambda x: x["dice"] >= least - 1e-12))

    return _named(starts, judged)


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, n_licenses, licenses, best_license, best_dice, best_at for every row of docs.

    licenses: the names found, sorted, comma-joined; best_license: the one with most shared bigrams, with
    its Dice and the number of words before it.
    """
    spark = docs.sparkSession
    given = [(name, len(words_of(text)), [" ".join(g) for g in grams_of(text)]) for name, text in templates_of(templates)]
    given = [(name, n, needed(len(grams), least), grams) for name, n, grams in given if grams]
    hashed = spark.createDataFrame(given, "name string, words int, need int, grams array<string>")
    hashed = hashed.select("name", "words", "need", F.transform("grams", lambda g: F.xxhash64(F.split_part(g, F.lit(" "), F.lit(1)), F.split_part(g, F.lit(" "), F.lit(2)))).alias("grams"))
    rows = hashed.collect()  # the templates given
    every = sorted({h for r in rows for h in r["grams"]})
    known = F.array(*(F.struct(F.lit(r["name"]).alias("name"), F.lit(r["words"]).alias("words"), F.lit(r["need"]).alias("need"), F.array(*map(F.lit, r["grams"])).alias("grams")) for r in rows))
    guard = F.col("text").rlike(rf"(?i)(?<!{_PART})(?:{'|'.join(telling_words(templates_of(templates), least))})(?!{_PART})")

    def found(pairs: Column) -> Column:
        own = F.array_distinct(F.filter(pairs, lambda h: h.isin(every)))
        near = _named(own, lambda o: F.filter(known, lambda t: F.size(F.array_intersect(o, t["grams"])) >= t["need"]))
        scored = F.transform(near, lambda t: F.struct(_best_window(pairs, t, least).alias("w"), t["name"].alias("name"), t["words"].alias("words")))
        return F.filter(scored, lambda x: x["w"].isNotNull())

    def stronger(y: Column, x: Column) -> Column:
        more = F.struct(y["w"]["shared"], y["w"]["dice"]) > F.struct(x["w"]["shared"], x["w"]["dice"])
        same = (y["w"]["shared"] == x["w"]["shared"]) & (y["w"]["dice"] == x["w"]["dice"]) & (y["name"] < x["name"])
        return more | same

    def standing(every_: Column) -> Column:
        def beaten(x: Column) -> Column:
            apart = lambda y: (-y["w"]["at"] + y["words"] <= -x["w"]["at"]) | (-x["w"]["at"] + x["words"] <= -y["w"]["at"])
            return F.exists(every_, lambda y: (y["name"] != x["name"]) & ~apart(y) & stronger(y, x))

        return F.filter(every_, lambda x: ~beaten(x))

    pairs = _named(_normal_words(F.col("text")), _pairs)
    df = docs.select("doc_id", F.when(guard, _named(_named(pairs, found), standing)).alias("m"))
    names = F.array_sort(F.array_distinct(F.transform("m", lambda x: x["name"])))
    # most shared bigrams, highest Dice, first name, first place
    best = F.array_min(F.transform("m", lambda x: F.struct((-x["w"]["shared"]).alias("s"), (-x["w"]["dice"]).alias("d"), x["name"].alias("name"), (-x["w"]["at"]).alias("at"))))
    df = df.select("doc_id", F.coalesce(names, F.expr("cast(array() as array<string>)")).alias("names"), best.alias("best"))
    return df.select("doc_id", F.size("names").cast("long").alias("n_licenses"), F.array_join("names", ",").alias("licenses"), F.col("best.name").alias("best_license"), (-F.col("best.d")).alias("best_dice"), F.col("best.at").cast("long").alias("best_at"))
