"""License scans against brute force."""

import pytest

from cloakwork.llm import licenses
from cloakwork.llm.licenses import LEAST, TEMPLATES, grams_of, words_of


def brute(text):
    words = words_of(text or "")
    pairs = list(zip(words, words[1:]))
    found = []
    for name, template in licenses.templates_of():
        own, size = set(grams_of(template)), len(words_of(template))
        best = None
        for at, pair in enumerate(pairs):
            if pair in own:
                window = set(pairs[at : at + size - 1])
                dice = 2 * len(window & own) / (len(window) + len(own))
                if dice >= LEAST:
                    best = max(best or (0, 0, 0), (len(window & own), dice, -at))
        if best:
            found.append((best, name, size))
    def beaten(x):
        for y in found:
            apart = -y[0][2] + y[2] <= -x[0][2] or -x[0][2] + x[2] <= -y[0][2]
            if y[1] != x[1] and not apart and (y[0][:2] > x[0][:2] or y[0][:2] == x[0][:2] and y[1] < x[1]):
                return True
        return False

    stand = [x for x in found if not beaten(x)]
    names = sorted({x[1] for x in stand})
    top = min(((-x[0][0], -x[0][1], x[1], -x[0][2]) for x in stand), default=None)
    return (len(names), ",".join(names), top and top[2], top and -top[1], top and top[3])


PROSE = "Once there was a text that ran on and on without a licence of its own. "
MIT, APACHE = TEMPLATES["MIT"][1], TEMPLATES["Apache-2.0"][1]


def wrapped(text, width=40, before="# "):
    import textwrap

    return "\n".join(before + line for line in textwrap.wrap(text, width))


TEXTS = [
    (PROSE + "\nLicensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("RELEASED under -- the MIT license!", "MIT"),
    ("Released under\nthe MIT\nLicense.", "MIT"),
    (PROSE * 9 + "This work is licensed under the GNU General Public License, version 3. " + PROSE, "GPL-3.0"),
    ("All rights reserved.\n\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.", "CC-BY-NC-4.0,MIT,Proprietary"),
    ("My Title\n\nCopyright (c) 2020 Some One\n\n" + MIT, "MIT"),
    (wrapped(APACHE) + "\nimport os\n" + PROSE, "Apache-2.0"),
    (PROSE * 5 + wrapped(MIT, 60, " * ") + PROSE * 5, "MIT"),
    ("// SPDX-License-Identifier: MIT\nint main", "MIT"),
    ("/* SPDX-License-Identifier: BSD-3-Clause */", "BSD-3-Clause"),
    (TEMPLATES["BSD-3-Clause"][1], "BSD-3-Clause"),
    (TEMPLATES["BSD-2-Clause"][1], "BSD-2-Clause"),
    (TEMPLATES["ISC"][0] + " " + TEMPLATES["Zlib"][0], "ISC,Zlib"),
    (TEMPLATES["AGPL-3.0"][1] + PROSE + TEMPLATES["LGPL-2.1"][0], "AGPL-3.0,LGPL-2.1"),
    (PROSE * 3 + MIT.replace("copies", "issues").replace("persons", "people") + PROSE, "MIT"),
    (MIT[: len(MIT) // 3], ""),
    ("Released under the MIT License. " * 300, "MIT"),
    ("this software is licensed to people without permission, and the rights are all reserved", ""),
    ("mit", ""), ("", ""), (None, ""), ("x " * 4000, ""), ("license " * 4000, ""), ("ß É\n日本", ""),
]


def test_scan_matches_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(TEXTS)] + [(1, TEXTS[1][0], "y"), (None, TEXTS[0][0], "z")], "doc_id long, text string, licenses string")
    rows = licenses.scan(df).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text, names = TEXTS[r.doc_id or 0]
        assert tuple(r)[1:] == brute(text), r
        assert r.licenses == names
    assert licenses.scan(df.limit(0)).count() == 0


def test_every_template_finds_itself_and_no_other_licence():
    for name, text in licenses.templates_of():
        found = brute(PROSE + text)
        assert found[2] == name and (found[1] == name or name == "0BSD"), (name, found)


def test_every_match_holds_a_telling_word():
    """Without them no template keeps enough bigrams for the least Dice."""
    templates = licenses.templates_of()
    telling = set(licenses.telling_words(templates))
    for _, text in templates:
        grams = grams_of(text)
        left = [g for g in grams if not set(g) & telling]
        assert 2 * len(left) / (len(left) + len(grams)) < LEAST


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = licenses.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("size", range(1, 200))
def test_needed_is_the_size_bound(size):
    need = licenses.needed(size)
    assert 2 * need / (need + size) >= LEAST - 1e-9 and 2 * (need - 1) / (need - 1 + size) < LEAST
