"""License scans against aligning every template at every place."""

import random

import numpy as np

from topictide.llm import licenses
from topictide.llm.common import WordHashes


def found(text):
    index, flat = licenses.build_index(), WordHashes()(licenses.words_of(text.encode()))
    places = licenses.candidates(index, flat, np.array([len(flat)]), 0.75, 6).get(0, [])
    return licenses.matches_of(index, flat, places, 0.75, 6)


def test_changed_and_neighbouring_short_notices():
    for text, name in [("Released under the MIT Licence", "MIT"), ("Licensed under the BSD Licence", "BSD"), ("Released under an MIT License", "MIT"),
                       ("Released under the original MIT License", "MIT"), ("Licensed under the Apache Licence, Version 2.0", "Apache-2.0")]:
        for whole in (text, f"some words before it. {text} and some after"):
            assert [m["license"] for m in found(whole)] == [name], whole
    assert [(m["start"], m["stop"]) for m in found("Released under the MIT License. " * 3)] == [(0, 5), (5, 10), (10, 15)]
    assert [m["start"] for m in found("Licensed under CC BY 4.0. " * 2)] == [0, 6]


def test_candidates_leave_no_place_out():
    rng, index, hashes = random.Random(4), licenses.build_index(), WordHashes()
    bodies = [t for texts in licenses.TEMPLATES.values() for t in texts]
    texts = []
    for _ in range(25):
        words = []
        for body in rng.sample(bodies, 2):
            words += [rng.choice(["the", "of", "and", "stone", "license", "under"]) for _ in range(rng.randint(0, 9))]
            words += [w if rng.random() < 0.85 else rng.choice(["other", "the"]) for w in body.split() if rng.random() < 0.93]
        texts.append(" ".join(words[:60]))
    flats = [hashes(licenses.words_of(t.encode())) for t in texts] + [hashes([])]
    got = licenses.candidates(index, np.concatenate(flats), np.array([len(f) for f in flats]), 0.75, 6)
    n = 0
    for d, flat in enumerate(flats):
        every = [(t, s) for t, b in enumerate(index.templates) if len(b) < 40 for s in range(-6, len(flat))]
        some = [p for p in got.get(d, []) if len(index.templates[p[0]]) < 40]
        all_found = licenses.matches_of(index, flat, every, 0.75, 6)
        assert licenses.matches_of(index, flat, some, 0.75, 6) == all_found
        n += len(all_found)
    assert n > 10
