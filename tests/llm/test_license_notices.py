"""License notices: relatives, versions, stretched and changed notices, coverage against brute force."""

import random

import pytest

from billscope.llm import licenses
from tests.llm.fixtures import docs


def names(text, coverage=0.8):
    words = licenses.words_of(text)[0]
    found = [(t, p) for t in licenses.prepared(licenses.TEMPLATES, coverage) for p in t.scan(words)]
    return sorted(t.name for t, _ in licenses.apart(found))


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_each_notice_is_found_alone_and_only_as_itself(name):
    text = licenses.TEMPLATES[name]
    assert names(text) == [name]
    assert names(f"some prose before it\n{text.upper()}\nand after it, " + "word " * 50) == [name]


def test_near_relatives_are_not_mixed_up():
    assert names("Licensed under the GNU Lesser General Public License, version 3") == ["LGPL-3.0"]
    assert names("Licensed under the GNU Library General Public License, version 2") == []
    assert names("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3.0"]
    assert names("Licensed under the GNU General Public License, version 3.0") == ["GPL-3.0"]
    assert names("Licensed under CC BY 3.0.") == ["CC-BY-3.0"]
    assert names("Licensed under CC BY 2.5.") == [] == names("Licensed under CC BY-SA 2.0.")
    assert names("Licensed under the Apache License, Version 1.1.") == []
    assert names("Released under the Apache License.") == [] == names("Released under the license.")
    assert names(licenses.TEMPLATES["GPL-3.0-or-later"].replace("version 3", "version 1")) == []


@pytest.mark.parametrize("name", ["MIT", "BSD-3-Clause", "MPL-2.0", "Apache-2.0-header", "GPL-2.0-or-later"])
@pytest.mark.parametrize("between", [1, 2])
def test_foreign_words_after_each_word(name, between):
    words = licenses.TEMPLATES[name].split()
    text = " ".join(f"{w} " + " ".join(f"x{i}y{k}" for k in range(between)) for i, w in enumerate(words))
    assert names("lead in " * 30 + text + " lead out" * 30) == [name]


def test_line_numbers_and_comment_signs():
    words = licenses.TEMPLATES["BSD-2-Clause"].split()
    text = "\n".join(f"REM {n:04d} # " + " ".join(words[n : n + 4]) for n in range(0, len(words), 4))
    assert names(text) == ["BSD-2-Clause"]


def test_coverage_against_the_longest_common_subsequence():
    rng = random.Random(11)
    for _ in range(40):
        name = rng.choice(["MIT", "ISC", "BSD-3-Clause", "GPL-3.0-or-later", "MPL-2.0"])
        template = licenses.Template(name, licenses.TEMPLATES[name], 0.8)
        words = [w for w in template.words if rng.random() > 0.06]
        for _ in range(rng.randint(0, 12)):
            words.insert(rng.randrange(len(words)), "foreign")
        most = longest_common(words, template.words)
        pairs = licenses.align(words, template.words)
        assert len(pairs) <= most and len(pairs) >= 0.97 * most
        found = list(template.scan(["prose"] * 40 + words + ["prose"] * 40))
        told = template.told(words, pairs)
        assert [len(p) for p in found] == ([len(pairs)] if len(pairs) >= template.least and told else [])


def test_whole_and_repeated_notices_in_a_table(spark):
    mit, bsd = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["BSD-3-Clause"]
    rows = [(1, mit + "\n\n" + mit), (2, bsd + " prose " + mit), (3, None), (4, ""), (4, mit), (4, mit)]
    got = sorted((r.doc_id, r.license, r.coverage, dict([(1, rows[0][1]), (2, rows[1][1]), (4, mit)])[r.doc_id][r.start : r.end]) for r in licenses.scan_licenses(docs(spark, rows)).collect())
    whole = {n: licenses.TEMPLATES[n] for n in ("MIT", "BSD-3-Clause")}
    assert [(d, n) for d, n, *_ in got] == [(1, "MIT")] * 2 + [(2, "BSD-3-Clause"), (2, "MIT")] + [(4, "MIT")] * 2
    assert all(c == 1.0 and text == whole[n].rstrip(".") for _, n, c, text in got)
