"""Licences and their neighbours, inserted and missing words, ties and repeats."""

import pytest

from plazafeed.llm import license
from plazafeed.llm import license_texts as L

NAMES = {label: (name, version) for label, _, name, version, _ in L.GNU}
CASES = {
    "mit": [L.MIT, "Released under the MIT License.", "// SPDX-License-Identifier: MIT"],
    "bsd-2": [f"{L.BSD_2}\n{L.BSD_DISCLAIMER}"],
    "bsd-3": [f"{L.BSD_2}\n{L.BSD_3_CLAUSE}\n{L.BSD_DISCLAIMER}"],
    "bsd-4": [f"{L.BSD_2}\n{L.BSD_4_CLAUSE}\n{L.BSD_3_CLAUSE}\n{L.BSD_DISCLAIMER}"],
    "apache-2": [L.APACHE], "isc": [L.ISC], "zlib": [L.ZLIB], "unlicense": [L.UNLICENSE], "mpl-2": [L.MPL], "mpl-1-1": [L.MPL_1_1], "bsl-1": [L.BOOST], "wtfpl": [L.WTFPL], "cc0-1": [L.CC0],
    **{k: [f"This file is licensed under the GNU {n} version {v}.", f"This program is licensed under the GNU {n} v{v}!"] for k, (n, v) in NAMES.items()},
    **{f"{label}-{v[0]}": [f"The text is under a Creative Commons {name} {v} International licence", L.CC.format(name=name, version=v)] for label, name in L.CC_NAMES for v in ("3.0", "4.0")},
}


def scan(spark, texts):
    rows = license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r for r in sorted(rows, key=lambda r: r.doc_id)]


@pytest.fixture(scope="module")
def around():
    return "int main() {{ return 0; }} /* {} */ and then some more text follows here".format


def test_each_licence_gets_its_own_label_alone(spark, around):
    cases = [(label, around(t)) for label, texts in CASES.items() for t in texts]
    got = scan(spark, [t for _, t in cases])
    base = {"mit", "apache-2"}
    assert [(c[0], r.labels) for c, r in zip(cases, got) if c[0] not in base and r.labels != c[0]] == []
    assert [c[1] for c, r in zip(cases, got) if c[0] in base and set(r.labels.split(",")) != {c[0]}] == []


@pytest.mark.parametrize("version", ["2", "3"])
def test_gpl_notice_as_published(spark, version):
    text = f"""This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.
    This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
    (r,) = scan(spark, [text])
    assert r.labels == f"gpl-{version}" and r.score > 0.97


def test_no_neighbour_without_its_deciding_words(spark):
    texts = ["licensed under the GNU General Public License", "a Creative Commons Attribution licence", "Mozilla Public License", "Creative Commons Attribution-Unknown 4.0 International", "GNU General Public License version 4"]
    assert [r.labels for r in scan(spark, texts)] == [""] * len(texts)


def test_inserted_and_missing_words_cost_little(spark):
    words = L.MIT.split(" ")
    insert = " ".join([*words[:11], "or", "organization", *words[11:]])
    missing = " ".join([*words[:40], *words[42:]])
    changed = " ".join("x" if k % 5 == 4 and 30 < k < 160 else w for k, w in enumerate(words))
    a, b, c = scan(spark, [insert, missing, changed])
    assert a.labels == b.labels == "mit" and a.score > 0.97 and b.score > 0.95 and 0.6 < c.score < 0.95


def test_several_licences_and_repeats(spark):
    gpl = "licensed under the GNU General Public License version 2"
    text = f"{L.MIT}\n\n{L.APACHE}\n{gpl}. {gpl}. cc by nc, cc-by-nc; All rights reserved"
    (r,) = scan(spark, [text])
    assert r.labels == "all-rights-reserved,apache-2,cc-by-nc,gpl-2,mit" and r.base_labels == "apache-2,cc-by-nc" and r.n_base == 3
    assert sum(license.TEMPLATES[p.t].label == "gpl-2" for p in r.places) == 2


def test_hostile_repeats_take_linear_time(spark):
    import time

    began = time.time()
    mit, spdx = scan(spark, ["mit " * 200_000, "under the mit license " * 20_000])
    assert (mit.n_base, spdx.n_base, spdx.last_word) == (0, 20_000, 79_996) and time.time() - began < 60
