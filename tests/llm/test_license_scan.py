import math
import random
import re
import textwrap

from packlens.llm import license_scan as S

from .conftest import make

KNOWN = {
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "Released under the MIT License.": "mit",
    "All rights reserved.": "proprietary",
}


def test_lines_of_the_table(docs):
    got = {r.doc_id: r for r in S.scan(docs, S.train(docs)).collect()}
    for r in docs.collect():
        want = sorted({f for line in r.text.split("\n") for k, f in KNOWN.items() if line.strip() == k})
        assert got[r.doc_id].families == ",".join(want), r.doc_id


def test_altered_wordings(spark, docs):
    m = S.train(docs)
    texts = ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "this program is free software you can redistribute it and/or modify it under the terms of the GNU General Public License",
             "we got a license to fish in the river last summer", "version two of the plan", "SPDX-License-Identifier: MPL-2.0\nAll rights reserved."]
    assert [r.families for r in S.scan(make(spark, texts), m).orderBy("doc_id").collect()] == ["mit", "gpl", "", "", "mpl,proprietary"]


def test_odd_and_empty(odd_docs, no_docs, docs):
    m = S.train(docs)
    rows = S.scan(odd_docs, m).collect()
    assert len(rows) == odd_docs.count() and all(r.n_paragraphs == 0 and r.families == "" for r in rows)
    assert S.scan(no_docs, m).count() == 0 and S.scan(docs, S.train(no_docs)).count() == docs.count()


def test_whole_paragraphs_and_sentences_in_longer_lines(spark, docs):
    full = [t for f in ("mit", "bsd", "apache-2.0") for t in S.TEMPLATES[f] if len(t) > 250]
    grant = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
             "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:")  # fmt: skip
    around = "Our neighbours met last summer and built a small boat from old planks near the river. {} Later they sailed it down to the harbour, where children came each day to watch it."
    texts = [grant, around.format("Licensed under the Apache License, Version 2.0."), around.format("Released under the MIT License."), around.format(""), "Everybody has all rights here and asks for more of them each year."]
    got = [r.families for r in S.scan(make(spark, texts), S.train(docs)).orderBy("doc_id").collect()]
    assert got == ["mit", "apache-2.0", "mit", "", ""] and len(full) >= 3


def brute(text, m, confirm=0.5):
    """Families of a text, scored paragraph by paragraph."""
    weights, common, templates, found = dict(zip(m.grams, m.weights.tolist(), strict=True)), set(m.common), S.template_pairs(m), set()
    for line in (text or "").split("\n"):
        words = re.findall("[a-z0-9]+", line.lower())
        have = {(w, "") for w in words} | set(zip(words, words[1:]))
        rows = [weights[g] for g in have if g in weights]
        if not rows and not have & common:
            continue
        z = [b + sum(r[i] for r in rows) for i, b in enumerate(m.bias.tolist())]
        e = [math.exp(x - max(z)) for x in z]
        pairs = {g for g in have if g[1]} - common
        match = [0.0] * (len(e) - 1)
        for fam, t in templates:
            least = max(1, min(len(pairs), len(t)))
            if len(pairs & t) >= min(least, 3):
                match[fam] = max(match[fam], len(pairs & t) / least)
        p, fam, share = max((e[i] / sum(e), m.families[i], match[i]) for i in range(len(e) - 1))
        if p >= m.threshold and share >= confirm:
            found.add(fam)
    return ",".join(sorted(found))


def test_against_brute_force(spark, docs):
    m = S.train(docs)
    full = [t for f in S.TEMPLATES for t in S.TEMPLATES[f]]
    rng = random.Random(3)
    texts = [*full, *[" ".join(w for w in t.split() if rng.random() > 0.2) for t in full], *[r.text for r in docs.limit(100).collect()], None, ""]
    got = {r.doc_id: r.families for r in S.scan(make(spark, texts), m).collect()}
    assert got == {i: brute(t, m) for i, t in enumerate(texts)}


def test_held_out_error(docs):
    """Held out are parts of templates with words left out, of which some have lost what tells the families apart."""
    m = S.train(docs)
    assert m.recall >= 0.85 and m.false_rate <= 0.002 and m.threshold >= 0.5


def test_hard_wrapped_licences(spark, docs):
    texts = ["\n".join(textwrap.wrap(" ".join(t for t in S.TEMPLATES[f] if "SPDX" not in t), 68)) for f in ("mit", "bsd", "apache-2.0")]
    got = [r.families for r in S.scan(make(spark, texts), S.train(docs)).orderBy("doc_id").collect()]
    assert all(f in g.split(",") for f, g in zip(("mit", "bsd", "apache-2.0"), got))


#: Wordings that no template has.
OTHER = {
    "agpl": ("This file is licensed under the GNU Affero General Public License v3 or later.", "See the GNU Affero General Public License for more details."),
    "apache-2.0": ("This project is licensed under the Apache License 2.0, see the file LICENSE.", "Code in this folder is under the Apache License, Version 2.0"),
    "boost": ("Use, modification and distribution are subject to the Boost Software License, Version 1.0.",),
    "bsd": ("This package is distributed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without changes, are permitted if the following conditions are met"),
    "cc-by": ("Content on this site is licensed under a Creative Commons Attribution 4.0 International licence.",),
    "cc-by-nc": ("All photos are licensed under a Creative Commons Attribution-NonCommercial 4.0 licence.",),
    "cc-by-sa": ("The text is available under the Creative Commons Attribution-ShareAlike 4.0 licence.",),
    "cc0": ("The author has waived all copyright and related rights to this work, to the extent possible under law.",),
    "epl": ("Made available under the terms of the Eclipse Public License v2.0.",),
    "gpl": ("This is free software, licensed under the GNU General Public License version 2.", "See the GNU General Public License along with this program."),
    "isc": ("Permission to use, copy, modify and distribute this software for any purpose with or without fee is granted.",),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License v2.1.",),
    "mit": ("Distributed under the MIT License.", "The code is licensed under the MIT license, see LICENSE."),
    "mpl": ("This file is subject to the terms of the Mozilla Public License, version 2.0.",),
    "ofl": ("The font is licensed under the SIL Open Font License 1.1.",),
    "proprietary": ("No part of this book may be reproduced without the prior written permission of the publisher.",),
    "unlicense": ("This is free and unencumbered software in the public domain.",),
    "zlib": ("Permission is granted to anyone to use this program for any purpose, and to alter it and redistribute it freely.",),
}


def test_wordings_that_no_template_has(spark, docs):
    cases = [(f, t) for f, ts in OTHER.items() for t in ts]
    m = S.train(docs)
    got = [r.families for r in S.scan(make(spark, [t for _, t in cases]), m).orderBy("doc_id").collect()]
    missed = [(f, t, g) for (f, t), g in zip(cases, got, strict=True) if f != g]
    print("recall", m.recall, "false rate", m.false_rate, "grams", len(m.grams), "missed", missed)
    assert len(missed) <= 0.1 * len(cases), missed
