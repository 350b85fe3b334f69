"""License scan against shingle containment by brute force."""

import random
import re

from ledgerlens.llm import licenses


def brute(text, template):
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    shingles = lambda w: [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    want, have = set(shingles(words(template))), shingles(words(text))
    span = len(shingles(words(template)))
    best = 0
    for p in range(len(have)):
        near = set(have[max(0, p - span):max(0, p - span) + 2 * span + 4])
        best = max(best, 100 * len(want & near) // len(want))
    return best


def test_every_place_and_edit(spark):
    rng = random.Random(7)
    texts = []
    for name, text in licenses.TEMPLATES.items():
        words = text.split()
        for _ in range(12):
            w = list(words)
            at = rng.randrange(len(w))
            edit = rng.randrange(5)
            if edit == 0:
                w[at] = "changed"
            elif edit == 1:
                del w[at:at + len(w) // 8]
            elif edit == 2:
                w = w[len(w) // 7:]
            elif edit == 3:
                w[at:at] = ["put", "in"]
            pad = lambda: [rng.choice(["lorem", "ipsum", "the", "of", "License"])
                           for _ in range(rng.randrange(40))]
            texts.append(rng.choice([" ", "\n"]).join(pad() + w + pad()))
    texts += ["", None, "MIT License", "no license here " * 2000 + licenses.TEMPLATES["MIT"]]
    df = spark.createDataFrame(
        [(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, licenses int")
    got = licenses.scan(df).orderBy("doc_id").collect()
    for r, text in zip(got, texts):
        want = {n: c for n, t in licenses.TEMPLATES.items() if (c := brute(text, t)) >= 80}
        assert {x["name"]: x["containment"] for x in r["licenses"]["found"]} == want
    assert sum(bool(r["licenses"]["found"]) for r in got) > 40
    assert licenses.scan(df.limit(0)).count() == 0
    assert licenses.scan(df, templates={}).select("licenses.found").distinct().count() == 1


def found(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [{x["name"]: x["containment"] for x in r["licenses"]["found"]}
            for r in licenses.scan(df, **kw).orderBy("doc_id").collect()]


def test_templates_under_five_words(spark):
    got = found(spark, ["the MIT\nLicense, here", "submit license", "MIT", "mit mit license", None],
                templates={"a": "MIT License", "b": "mit", "none": "..."})
    assert got == [{"a": 100, "b": 100}, {}, {"b": 100}, {"a": 100, "b": 100}, {}]


def test_usual_notices(spark):
    gnu = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
           " {}General Public License as published by the Free Software Foundation, either version 2 of the License,")
    texts = {
        gnu.format(""): "GPL-notice", gnu.format("Lesser "): "LGPL-notice",
        gnu.format("Library "): "LGPL-2.0-notice", gnu.format("Affero "): "AGPL-notice",
        licenses.TEMPLATES["MPL-2.0"] + " https://mozilla.org/MPL/2.0/.": "MPL-2.0",
        "// " + licenses.TEMPLATES["ISC-text"]: "ISC-text",
        licenses.TEMPLATES["Unlicense"]: "Unlicense",
        "To the extent possible under law, A has waived all copyright and related or neighboring rights to B.": "CC0-1.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0-notice",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0-notice",
        "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0",
    }
    assert [list(x) for x in found(spark, list(texts))] == [[n] for n in texts.values()]
