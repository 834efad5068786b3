"""Licence scans against loops over all segments and their passages."""

import random

from chronoloom.llm import licenses


def plain(text, templates, least=0.8):
    out = {}
    for s in text.split("\n") + [p for p in text.split("\n\n") if "\n" in p]:
        w = licenses.normalised(s)
        grams = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
        for name, body in templates.items():
            own, n = licenses.bigrams(body), len(licenses.normalised(body)) - 1
            tried = [set(grams)] + [set(grams[i : i + n]) for i in range(len(grams) - n + 1) if len(grams) > n and (i == len(grams) - n or grams[i] in own)]
            best = max((2 * len(t & own) / (len(t) + len(own)) for t in tried if t), default=0)
            if best >= least:
                known = out.get(name, (0, 0))
                out[name] = max(known[0], best), known[1] + 1
    return out


def test_notices_within_lines_and_paragraphs(spark):
    rng = random.Random(2)
    other = "some words that are not of any licence at all but stand around it".split()
    fill = lambda: " ".join(rng.choice(other) for _ in range(rng.randrange(15)))
    texts = ["", "Copyright 2020 Acme Inc. All rights reserved.", "This file is part of Foo and is released under the MIT License."]
    for body in licenses.TEMPLATES.values():
        words = body.split()
        texts.append(f"{fill()} {body} {fill()}")
        texts.append(f"{fill()}\n" + "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)) + f"\n{fill()}\n\n{fill()}")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words) + f"\n\n{body.upper()}")
    docs = spark.createDataFrame([(i, t, "a", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, h string, dice double").repartition(4)
    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r["doc_id"], {})[r["license_id"]] = (r["dice"], r["n_segments"])
    want = {i: p for i, t in enumerate(texts) if (p := plain(t, licenses.TEMPLATES))}
    assert got == want
    assert "proprietary" in got[1] and "mit" in got[2]
    for i, name in enumerate(licenses.TEMPLATES):
        assert got[3 + 3 * i][name][0] == 1 and got[4 + 3 * i][name][0] == 1
