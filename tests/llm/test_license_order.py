"""Matches of license templates: names and versions in place, overlapping ones by brute force, very many in one text."""

from __future__ import annotations

import random
import time

import pytest

from tracewell.llm import licenses
from tracewell.llm.licenses import TEMPLATES, Templates

INDEX = Templates(TEMPLATES, 0.9, {})


def labels(text: str) -> set[str]:
    words = licenses._words(text.encode())
    return {INDEX.items[k][1] for k, _, _ in INDEX.best(INDEX.named(words, INDEX.meets(words)))}


@pytest.mark.parametrize(("text", "expected"), [
    ("This work is licensed under the GNU General Public License version 1.", set()),
    ("This work is licensed under the GNU Lesser General Public License version 2.1.", {"lgpl-2.1"}),
    ("This work is licensed under the GNU Lesser General Public License, version 3", {"lgpl-3"}),
    ("Licensed under the Mozilla Public License, Version 2.0. This work is licensed under the GNU GPL, version 1", {"mpl-2"}),
    ("This work is licensed under the GNU GPL, version 2 of the General Public License", set()),
    ("This program is free software: you can redistribute it and/or modify\n it under the terms of the GNU General Public License as published by\n the Free Software Foundation, either version 3 of the License, or\n (at your option) any later version.", {"gpl-3"}),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", {"lgpl-2.1"}),
    ("// SPDX-License-Identifier: GPL-2.0-only", {"gpl-2"}), ("# SPDX-License-Identifier: Apache-2.0", {"apache-2"}), ("SPDX-License-Identifier: LGPL-2.1-or-later", {"lgpl-2.1"}),
    ("Licensed under CC BY-NC-SA 4.0", {"cc-by-nc-sa"}), ("by cc licensed under 4 0", set()), ("", set()),
])
def test_names_and_versions_in_place(text, expected):
    assert labels(text) == expected


def test_overlaps_are_brute_force():
    rng = random.Random(5)
    index = Templates({"a b c d e f": "x", "a b c": "y", "b c d e": "z", "e f g h i j k l": "w", "released under the mit license": "mit"}, 0.9, {})
    for _ in range(300):
        met = list({(k, s): (k, s, rng.choice([0.9, 0.95, 1.0])) for k, s in ((rng.randrange(len(index.items)), rng.randrange(120)) for _ in range(rng.randrange(60)))}.values())

        def beaten(k, s, c):
            return not index.phrases[k] and any(t < s + index.width[k] and s < t + index.width[o] and (x > c or x == c and set(index.items[k][0]) < set(index.items[o][0])) for o, t, x in met)  # noqa: B023

        assert index.best(met) == sorted(m for m in met if not beaten(*m))


def test_text_of_notices_only():
    text = " ".join(list(TEMPLATES) * 400)
    begun = time.monotonic()
    assert labels(text) == set(TEMPLATES.values()) and len(text.split()) > 100_000
    assert time.monotonic() - begun < 30
