import random
import re

import pytest

from offerweave.llm import licenses
from offerweave.llm.licenses import PHRASES, TEMPLATES, Automaton


def lower(text):
    return re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode())


def as_regex(template):
    """The template as a regular expression over words that each end in a space."""
    out, at = "", 0
    for token in re.findall(r"\[\[|\]\]|<<\d+>>|\{[^}]*\}|[^\s\[\]{}<>]+", template):
        if token == "[[":
            out += "(?:"
        elif token == "]]":
            out += ")?"
        elif token.startswith("<<"):
            out += "(?:[^ ]+ ){0,%s}" % token[2:-2]
        elif token.startswith("{"):
            out += "(?:" + "|".join(" ".join(c.split()) + " " for c in token[1:-1].split("|")) + ")"
        else:
            out += token + " "
    return out


def brute(text):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    base = [(i, l) for p, l in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.encode().split()]
    labels = {l for _, l in base}
    for label, t in TEMPLATES:
        for i in range(len(w)):
            if re.match(as_regex(t).encode(), b" ".join(w[i:]) + b" "):
                labels.add(label)
    return len(w), len(base), min(base)[0] if base else None, max(i for i, _ in base) if base else None, ",".join(sorted({l for _, l in base})), ",".join(sorted(labels))


TEXTS = [
    None, "", "...", "MIT License mit-license", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "mit licenses", "éMIT license",
    "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software a b c d e f g h i to deal in the Software without restriction",
    "under creative commons attribution sharealike 4.0", "under cc by x y 4 0", "cc0 1.0 universal",
]


def test_against_brute_force(spark):
    rng = random.Random(8)
    vocab = "released licensed under the mit license apache version 2 0 gnu general public 3 cc by nc sa 4 this work".split()
    texts = TEXTS + [" ".join(rng.choices(vocab, k=rng.randint(0, 80))) for _ in range(80)] + ["filler " * 3_000 + "MIT License"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, TEXTS[3], "y"), (None, TEXTS[3], None)]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    found = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got), key=str)
    assert found == sorted(((i, *brute(t)) for i, t, _ in rows), key=str)
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)


def test_markup():
    text = lambda s: s.encode().split().__getitem__
    a = Automaton("a [[b c]] <<2>> {d|e f} g")
    for s, n in (("a d g", 3), ("a b c d g", 5), ("a x y d g", 5), ("a x y z d g", 0), ("a e f g", 4), ("a d", 0), ("a b c x y e f g g", 8)):
        assert a.match(text(s), 0, len(s.split())) == n, s
    for bad in ("[[a]] b", "<<2>> a", ""):
        with pytest.raises(ValueError):
            Automaton(bad)


def test_empty(spark):
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def fill(template, optional=True, own="some other holders", choice=0):
    """A text of a template: its optional regions in or out, replaceable ones with ``own``."""
    text = re.sub(r"\[\[([^\[\]]*)\]\]", lambda m: m[1] if optional else "", template)
    text = re.sub(r"<<\d+>>", own, text)
    return re.sub(r"\{([^}]*)\}", lambda m: m[1].split("|")[choice], text)


def test_whole_licence_texts(spark):
    """Optional and replaceable regions may vary; one changed mandatory word rejects the text."""
    whole = [(label, t) for label, t in licenses.TEMPLATES if len(t.split()) > 60]
    assert {label for label, _ in whole} == {"mit", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "unlicense", "apache-2.0"}
    rows, want = [], {}
    for label, t in whole:
        for text, ok in [(fill(t), True), (fill(t, False, "ACME, Inc.", -1).upper(), True), (fill(t, own="one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), "<<" not in t)]:
            want[len(rows)] = {label} if ok else set()
            rows.append((len(rows), f"Intro words.\n{text}; and the rest"))
        fixed = fill(t, False, "xx").split()
        mandatory = [i for i, w in enumerate(fixed) if w != "xx"]
        for at in (mandatory[10], mandatory[len(mandatory) // 2], mandatory[-2]):
            changed = [*fixed[:at], "unless", *fixed[at + 1 :]]
            want[len(rows)] = set()
            rows.append((len(rows), " ".join(changed)))
    got = {r.doc_id: set(r.labels.split(",")) - {""} for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    notices = {"apache", "apache-2.0", "zlib"}  # the header holds a notice too
    for i, labels in want.items():
        assert got[i] - notices == labels - notices, rows[i][1][:80]
        assert labels <= got[i]
