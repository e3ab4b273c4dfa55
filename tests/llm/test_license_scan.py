import re

import pytest

from driftframe.llm import license_scan


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


ROWS = [
    (1, "x\nReleased under the MIT License.", "en", "a"), (2, "mit, license! MIT-LICENSE mit licenses éMIT license", "en", "a"), (3, "This work is licensed under the GNU General Public License, version 3.", "en", "a"),
    (4, None, None, None), (5, " ,;. ", "en", "a"), (6, "the apache\tLicense general public license apache license", "en", "a"), (6, "the apache\tLicense general public license apache license", "en", "a"), (None, "MIT License", None, None),
    (7, "word " * 20000 + "general public license", "en", "a"), (8, "ＭＩＴ license mit license", "en", "a"),
]


def test_base_against_brute_force(make, odd_rows):
    for rows in (ROWS, odd_rows):
        got = license_scan.report(make(rows)).collect()
        want = sorted((str(i), *map(str, brute(t))) for i, t, _, _ in rows)
        assert sorted(tuple(str(r[c]) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) for r in got) == want
        assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) for r in got)


@pytest.mark.parametrize(("text", "label", "edits"), [("Licensed under CC BY-NC 4.0.", "cc-by-nc", 0), ("Relesed undr the MIT Licence", "mit", 3), ("licensed under the apache licence, version 2.0", "apache", 1), ("Redistribution and use in sourse and binary froms with or without modifications", "bsd", 3)])
def test_fuzzy_notices(text, label, edits):
    out = license_scan.scan_text(f"some words before. {text} and after".encode())
    best = min((s for s in out["spans"] if s["label"] == label), key=lambda s: s["edits"])
    assert best["edits"] <= edits + 1 and best["first_word"] == 3 and 0 < out["score"] <= 1


def test_every_occurrence_within_the_bound_has_a_seed():
    """Any notice with up to its bound of edits at random places is found."""
    import random

    rng = random.Random(3)
    for notice, label in license_scan.NOTICES:
        for _ in range(20):
            chars = list(notice)
            for _ in range(license_scan.errors(notice)):
                at = rng.randrange(len(chars))
                change = rng.randrange(3)
                if change == 0:
                    chars[at] = "q"
                elif change == 1:
                    del chars[at]
                else:
                    chars.insert(at, "z")
            found = license_scan.find_notices("kx " * 5 + "".join(chars) + " kx" * 5)
            assert any(license_scan.NOTICES[i][1] == label for i, *_ in found), "".join(chars)


def test_worse_occurrences_before_and_after_a_better_one_are_found():
    worse, best = "relesed undr the mit license", "released under the mit license"
    spans = lambda *said: [f[1:] for f in license_scan.find_notices(" ".join(said), license_scan.NOTICES[:1])]
    assert spans(worse, best) == [(0, 28, 2), (29, 59, 0)]
    assert spans(worse, worse, best, worse) == [(0, 28, 2), (29, 57, 2), (58, 88, 0), (89, 117, 2)]


def test_clean_text_has_no_label():
    out = license_scan.scan_text(b"nothing of the kind is said here under the general heading of version 2")
    assert out["labels"] == "" and out["score"] == 0


def test_empty(make):
    assert license_scan.report(make([])).count() == 0


def least_edits(notice, text):
    """The smallest edit distance between the notice and any part of the text (Sellers' table)."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(notice, 1):
        above, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(above[j - 1] + (c != d), above[j] + 1, row[-1] + 1))
    return min(row)


def test_labels_and_edits_against_an_edit_distance_table():
    """Notices with more and fewer edits than their bound: found if and only if some part of the text is within it."""
    import random

    rng = random.Random(12)
    seen = set()
    for _ in range(120):
        i = rng.randrange(len(license_scan.NOTICES))
        chars = list(license_scan.NOTICES[i][0])
        for _ in range(rng.randint(0, 2 * license_scan.errors(license_scan.NOTICES[i][0]))):
            at = rng.randrange(len(chars))
            chars[at] = rng.choice(("", "q", chars[at] + "z", rng.choice(chars)))
        text = " ".join("".join(["some words here ", *chars, " and there"]).split())
        found = {}
        for k, start, end, edits in license_scan.find_notices(text):
            assert least_edits(license_scan.NOTICES[k][0], text[start:end]) <= edits <= license_scan.errors(license_scan.NOTICES[k][0])
            found[k] = min(found.get(k, 99), edits)
        for k, (notice, _) in enumerate(license_scan.NOTICES):
            within = least_edits(notice, text) <= license_scan.errors(notice)
            assert within == (k in found), (notice, text)
            seen.add(within)
    assert seen == {True, False}


def test_crowded_seeds_take_linear_time():
    import time

    took = []
    for n in (4000, 16000):
        for text in ("mit license " * n, "released under the mit license " * (n // 4), "general public " * (n // 4)):
            begin = time.process_time()
            out = license_scan.scan_text(text.encode())
            took.append(time.process_time() - begin)
        assert out["n_base"] == 0
    assert all(b < 8 * a + 0.5 for a, b in zip(took[:3], took[3:]))
    assert len(license_scan.scan_text(b"released under the mit license " * 500)["spans"]) >= 500
