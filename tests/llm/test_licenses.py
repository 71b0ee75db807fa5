import random

from foliant.llm import licenses as li

NOTICES = {
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "licensed under the gnu lesser general public license, version 2.1": "LGPL-2.1",
}


def full_table_matches(template, words):
    """Most words of the template on one path, by an alignment over the whole table with the same scores."""
    n, m = len(template), len(words)
    best = [[(0, 0)] * (m + 1)] + [[None] * (m + 1) for _ in range(n)]
    for i in range(1, n + 1):
        for j in range(m + 1):
            s, c = best[i - 1][j]
            options = [(s - 1, c)]
            if j:
                s, c = best[i - 1][j - 1]
                same = template[i - 1] == words[j - 1]
                options.append((s + (2 if same else -1), c + same))
                s, c = best[i][j - 1]
                options.append((s - 1, c))
            best[i][j] = max(options)
    return max(best[n])


def test_notices_in_prose():
    scan = li.scanner().scan
    for notice, spdx in NOTICES.items():
        text = "Some words before, 1984.\n" + notice + "\nAnd é words after " * 30 + notice
        found = scan(text)
        assert [f[0] for f in found] == [spdx, spdx]
        for f in found:
            assert f[3] == 1.0 and text[f[4] : f[5]] == notice.rstrip(".")


def test_close_names_are_told_apart_and_prose_is_left():
    scan = li.scanner().scan
    assert scan("Released under the XYZ License. Licensed under the terms. Version 2.0 of the license is under review.") == []
    assert [f[0] for f in scan("Licensed under CC BY-SA 4.0, and licensed under CC BY-NC-ND 4.0")] == ["CC-BY-SA-4.0", "CC-BY-NC-ND-4.0"]
    assert scan("") == [] and scan("the " * 20000) == []


def test_altered_texts_and_coverage():
    rng = random.Random(0)
    scanner = li.scanner()
    for spdx, text in li.TEXTS.items():
        words = text.split()
        for _ in range(3):
            changed = list(words)
            for _ in range(len(words) // 15):
                at = rng.randrange(len(changed))
                changed[at : at + 1] = rng.choice([[], ["other"], [changed[at], "more"]])
            found = [f for f in scanner.scan("pre amble " + " ".join(changed) + " post") if f[1] == "text"]
            assert spdx in {f[0] for f in found} or spdx.startswith(("GPL", "BSD"))
            for f in found:
                t = next(t for t in scanner.templates if (t.license, t.name) == (f[0], f[1]))
                _, most = full_table_matches(t.words, li._words(" ".join(changed)))
                assert f[2] <= most and f[2] >= most - 2 and f[3] >= 0.8
        half = scanner.scan(" ".join(words[: len(words) // 2]))
        assert not any(f[1] == "text" for f in half)


def test_winnowing_sees_every_run():
    scanner = li.scanner()
    for number, t in enumerate(scanner.templates):
        for i in range(0, len(t.words) - li.WIDTH - li.WINDOW + 2, 1 + len(t.words) // 100):
            run = ["zzz", *t.words[i : i + li.WIDTH + li.WINDOW - 1], "zzz"]
            assert scanner.hits(run)[number]


def test_notices_that_follow_each_other():
    for notice, spdx in NOTICES.items():
        for times in (1, 2, 3, 7):
            assert [f[0] for f in li.scanner().scan(" ".join([notice] * times))] == [spdx] * times


def test_whole_texts():
    rng, scanner = random.Random(2), li.scanner()
    whole = [t for t in scanner.templates if t.name == "whole"]
    assert {"MIT", "Apache-2.0", "GPL-3.0", "Zlib", "Unlicense", "BSD-3-Clause"} <= {t.license for t in whole}
    for t in (t for t in whole if len(t.words) < 600):  # the longest take a second each
        changed = [w for w in t.words if rng.random() > 0.04]
        (found,) = [f for f in scanner.scan("before it " + " ".join(changed) + " after it") if f[1] == "whole"]
        assert found[0] == t.license and found[3] > 0.9
        half = scanner.scan(" ".join(t.words[: len(t.words) // 2]))
        assert not any(f[1] == "whole" and f[0] == t.license for f in half)


def test_rows_and_cells_agree(monkeypatch):
    rng, scanner = random.Random(4), li.scanner()
    for _ in range(60):
        template = tuple(rng.choices("abcd", k=rng.randrange(1, 30)))
        words = rng.choices("abcde", k=rng.randrange(1, 40))
        diagonal, band = rng.randrange(-5, 20), rng.randrange(1, 9)
        monkeypatch.setattr(li, "CELLS", 10**9)
        one = scanner.align(template, words, diagonal, band)
        monkeypatch.setattr(li, "CELLS", 0)
        assert scanner.align(template, words, diagonal, band) == one


def test_scan_finds_all_that_brute_force_finds():
    """Every template against every stretch of the text, without index, winnowing or bands."""
    scanner = li.scanner()
    short = [t for t in scanner.templates if len(t.words) < 20]
    rng = random.Random(8)
    for _ in range(6):
        parts = rng.choices([*NOTICES, "some other words", "the license of", "version 2.0"], k=6)
        words = li._words(" ".join(parts))
        want = set()
        for t in short:
            for start in range(len(words)):
                if words[start : start + len(t.words)] == t.words:
                    want.add((start, t.license))
        text = " ".join(words)
        starts = [m.start() for m in li.WORD.finditer(text)]
        got = {(starts.index(f[4]), f[0]) for f in scanner.scan(text) if f[3] == 1.0}
        # Of matches that overlap the longest is given; each exact one is given or lies in one that is.
        spans = [(starts.index(f[4]), starts.index(f[4]) + f[2], f[0]) for f in scanner.scan(text)]
        assert got <= want and all(any(a <= s < b for a, b, _ in spans) for s, _ in want)


def test_spdx_tags():
    text = "// SPDX-License-Identifier: GPL-2.0-or-later\n# SPDX-License-Identifier: MIT"
    assert [(f[0], f[1], text[f[4] : f[5]]) for f in li.scanner().scan(text)] == [
        ("GPL-2.0-or-later", "spdx-tag", "SPDX-License-Identifier: GPL-2.0-or-later"), ("MIT", "spdx-tag", "SPDX-License-Identifier: MIT"),
    ]


def test_operator(spark):
    rows = [(i, f"text {i} {n}", "x") for i, n in enumerate(NOTICES)] + [(50, None, ""), (51, "", ""), (None, "Licensed under CC BY-NC 4.0.", ""), (1, "Released under the MIT License.", ""), (52, "w " * 30000 + "Released under the MIT License", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string").repartition(3)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.license) for r in li.scan_licenses(docs).collect())
    assert got == sorted([(False, i, s) for i, s in enumerate(NOTICES.values())] + [(True, 0, "CC-BY-NC-4.0"), (False, 1, "MIT"), (False, 52, "MIT")])
    assert li.scan_licenses(docs.limit(0)).collect() == []
