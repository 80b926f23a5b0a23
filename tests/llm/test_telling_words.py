"""Licenses that differ in a word or a version, tags, and very long blocks; against a plain search for wordings."""

import random
import time

import pytest

from quarry.llm import licenses

REST = "\n\nint main() { return 0; }\n"
GPL = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU{} General Public License as published by\nthe Free Software Foundation; either version {} of the License, or\n(at your option) any later version."


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (GPL.format("", 2), ["GPL-2.0"]),
        (GPL.format("", 3), ["GPL-3.0"]),
        (GPL.format(" Affero", 3), ["AGPL-3.0"]),
        (GPL.format(" Lesser", 3).replace("program", "library"), ["LGPL-3.0"]),
        (GPL.format(" Lesser", "2.1").replace("program", "library"), ["LGPL-2.1"]),
        (GPL.format("", 7), []),
        ("SPDX-License-Identifier: MIT", ["MIT"]),
        ("// SPDX-License-Identifier: CC-BY-SA-4.0", ["CC-BY-SA-4.0"]),
        ("This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License.", ["CC-BY-NC-4.0"]),
        ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ["BSD-3-Clause"]),
        ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at", ["EPL-2.0"]),
        ("all rights reserved, no license is given", []),
    ],
)
def test_licenses_that_differ_in_a_word(text, found):
    scanner = licenses.Scanner()
    got = [n["license"] for whole in (text + REST, "/*\n * " + text.replace("\n", "\n * ") + "\n */") for _, block in licenses.blocks(whole) for n in scanner.scan(block)]
    assert got == found * 2


def test_many_notices_of_one_block_in_linear_time():
    mit = licenses.NOTICES["MIT"][1]
    scanner = licenses.Scanner()
    took = []
    for count in (100, 800):
        began = time.process_time()
        found = [n["license"] for _, block in licenses.blocks("\n".join(f"{mit} {k}x" for k in range(count))) for n in scanner.scan(block)]
        took.append(time.process_time() - began)
        assert found == ["MIT"] * count
    assert took[1] < 24 * took[0] + 1


def test_notices_against_a_plain_search(spark):
    rng = random.Random(6)
    wordings = [(name, w) for name, ws in licenses.NOTICES.items() for w in ws]
    rows, expected = [], set()
    for k in range(150):
        parts = []
        for name, wording in rng.sample(wordings, rng.randint(0, 3)):
            parts += [f"License notice of part {name.lower()[:1]}x", wording, *("plain words of no matter at all" for _ in range(rng.randint(0, 6)))]
            expected.add((k, name))
        rows.append((k, "\n".join(parts)))
    got = licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == expected
    assert all(r["exact"] for r in got)
