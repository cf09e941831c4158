import re

import pytest
from helpers import awkward, documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylight.llm import licenses as L

SCANNER = L.Scanner()


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for phrase, label in L.BASE for p in [phrase.split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def base(r):
    return r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["under the MIT License", "Apache License, Version 2.0", "CC-BY-NC 4.0", "cc by", "under the", "mit license", "é", "日本", "x1", "\x80", "..", "\n", "CC\tBY\nNC"]), max_size=12).map(" ".join))
def test_base_equals_brute_force(text):
    assert base(SCANNER.scan(text)) == brute(text)


def test_rules_and_suppression():
    assert len(SCANNER.rules) > 250 and len({r.pattern.pattern for r in SCANNER.rules}) == len(SCANNER.rules)
    spans = [(0, 9, 5, "a"), (2, 4, 5, "b"), (2, 4, 9, "c"), (8, 12, 1, "d"), (0, 9, 5, "a")]
    assert L.suppressed(spans) == [(0, 9, 5, "a"), (2, 4, 9, "c"), (8, 12, 1, "d")]


def brute_suppressed(found):
    """Pair by pair: one is gone if a kept one of higher rank contains it."""
    kept = []
    for x in sorted(set(found), key=lambda x: (-x[2], x[0] - x[1], x[0], x[3])):
        if not any(y[0] <= x[0] and x[1] <= y[1] for y in kept):
            kept.append(x)
    return sorted(kept)


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 9), st.integers(0, 3), st.sampled_from("ab")).map(lambda x: (x[0], x[0] + x[1], x[2], x[3])), max_size=15))
def test_suppression_equals_brute_force(found):
    assert L.suppressed(found) == brute_suppressed(found)


LETTERS = st.sampled_from("abcdefghijklmnopqrstuvwxyz0123456789 ©éô")


@settings(max_examples=600, deadline=None)
@given(st.sampled_from(L.RULES).flatmap(lambda r: st.tuples(st.just(r), st.from_regex(r[3], fullmatch=True, alphabet=LETTERS))))
def test_every_rule_finds_what_it_describes(case):
    """Whatever a rule's regex matches holds its keyword, and the scan reports the rule or a detection that contains it."""
    (label, keyword, priority, _), text = case
    if "  " in text or text != text.strip():
        return
    assert keyword in text
    n = len(text.split())
    spans = SCANNER.scan(f"before {text} after")["spans"]
    assert any(x["start"] <= 1 and x["start"] + x["length"] >= 1 + n and (x["label"] == label or x["priority"] >= priority) for x in spans)


# Notices as they stand in files, with the label to be found.
NOTICES = [
    ("SPDX-License-Identifier: GPL-3.0-only", "gpl-3.0-only"),
    ("// SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0-or-later"),
    ("SPDX-License-Identifier: MPL-2.0", "mpl-2.0"),
    ("SPDX-License-Identifier: LGPL-2.1", "lgpl-2.1"),
    ("# SPDX-License-Identifier: MIT", "mit"),
    ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
    ("SPDX-License-Identifier: AGPL-3.0-only", "agpl-3.0-only"),
    ("SPDX-License-Identifier: EPL-2.0", "epl-2.0"),
    ("SPDX-License-Identifier: EUPL-1.2", "eupl-1.2"),
    ("SPDX-License-Identifier: BSL-1.0", "boost-1.0"),
    ("SPDX-License-Identifier: CC0-1.0", "cc0-1.0"),
    ("SPDX-License-Identifier: ISC", "isc"),
    ("SPDX-License-Identifier: 0BSD", "0bsd"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
    ("released under GPLv3", "gpl-3.0"),
    ("GPLv3 license", "gpl-3.0"),
    ("Licensed under the GNU GPL version 2", "gpl-2.0"),
    ("it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gpl-2.0-or-later"),
    ("version 3 of the GNU General Public License", "gpl-3.0"),
    ("GNU Lesser General Public License v2.1", "lgpl-2.1"),
    ("the GNU Affero General Public License version 3", "agpl-3.0"),
    ("Permission is granted to copy under the terms of the GNU Free Documentation License, Version 1.3", "gfdl-1.3"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the", "mit"),
    ("The MIT License (MIT)", "mit"),
    ("the Apache 2.0 license", "apache-2.0"),
    ("Licensed under the Apache License, Version 2.0 (the License)", "apache-2.0"),
    ("http://www.apache.org/licenses/LICENSE-2.0", "apache-2.0"),
    ("Apache Software License 1.1", "apache-1.1"),
    ("the BSD 3-Clause License", "bsd-3-clause"),
    ("licensed under the 2-clause BSD license", "bsd-2-clause"),
    ("the New BSD License", "bsd-3-clause"),
    ("Released under the BSD License", "bsd"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("Boost Software License - Version 1.0 - August 17th, 2003", "boost-1.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
    ("Mozilla Public License Version 1.1", "mpl-1.1"),
    ("Eclipse Public License - v 1.0", "epl-1.0"),
    ("COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0", "cddl-1.0"),
    ("The Artistic License 2.0", "artistic-2.0"),
    ("under the same terms as Perl itself", "perl"),
    ("SIL OPEN FONT LICENSE Version 1.1", "ofl-1.1"),
    ("Open Database License (ODbL) v1.0", "odbl-1.0"),
    ("European Union Public Licence v. 1.2", "eupl-1.2"),
    ("Microsoft Public License (Ms-PL)", "ms-pl"),
    ("Server Side Public License, version 1", "sspl-1.0"),
    ("Business Source License 1.1", "busl-1.1"),
    ("PHP License, version 3.01", "php-3.01"),
    ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc-sa"),
    ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "cc-by-nc-sa"),
    ("https://creativecommons.org/licenses/by-sa/3.0/", "cc-by-sa"),
    ("Creative Commons Attribution 4.0 International", "cc-by"),
    ("CC0 1.0 Universal", "cc0-1.0"),
    ("LLAMA 2 COMMUNITY LICENSE AGREEMENT", "llama-2"),
    ("CreativeML Open RAIL-M", "openrail"),
    ("Copyright (c) 2019-2021 A. Person", "copyright"),
    ("All rights reserved.", "all-rights-reserved"),
    ("Alle Rechte vorbehalten", "all-rights-reserved"),
    ("PROPRIETARY AND CONFIDENTIAL", "proprietary"),
]


@pytest.mark.parametrize(("notice", "label"), NOTICES)
def test_notices(notice, label):
    got = SCANNER.scan(f"Some words. {notice} Some more.")
    assert {x["label"] for x in got["spans"]} == {label}, got["spans"]


def test_plain_text_has_no_license():
    for t in ("no license here", "Python 2 was old", "er kam mit 0 Punkten und mit 3 Clowns", "the apache 2 of them", "a general public", "version 3 of the plan", "free software", "licensed plumber", "copyright law"):
        assert SCANNER.scan(t)["labels"] == "", t


def test_awkward(spark):
    docs = awkward(spark)
    rows = L.scan_licenses(docs).collect()
    assert len(rows) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(base(r) == brute(texts[r["doc_id"]]) and r["score"] == 0 for r in rows)
    assert L.scan_licenses(empty(spark)).count() == 0
    hot = "under the MIT License. " * 5000
    r = L.scan_licenses(documents(spark, [(1, hot)])).first()
    assert base(r) == brute(hot) and r["score"] == 0.95
