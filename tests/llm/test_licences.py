"""Licence scan on licence files and passages as projects ship them."""

import random
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from shelfgraph.llm import license_scan
from tests.llm.common import LONG, PROSE, nothing, odd


def test_licence_files(spark):
    """Licence files as projects ship them, with their own copyright lines and layout; none is a template."""
    texts = {p.name: p.read_text() for p in (Path(__file__).parent / "licence_files").iterdir()}
    gpl2 = texts["GPL-2.0"][texts["GPL-2.0"].index("This program is free software"):][:760]
    texts |= {"GPL-2.0 of a project": "Copyright 2020 A. Person\n\n" + gpl2}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    best = {r.id: r.licence for r in sorted(license_scan.scan(docs).collect(), key=lambda r: (r.last_line - r.first_line, r.score))}
    assert {n: best.get(n) for n in texts} == {n: "GPL-2.0 header" if n.endswith("project") else f"{n} full text" for n in texts}


def found(spark, texts, **args):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return sorted(tuple(r) for r in license_scan.scan(docs, passages=True, **args).collect())


def test_passages(spark):
    gpl = (Path(__file__).parent / "licence_files" / "GPL-3.0").read_text()
    header = gpl[gpl.index("This program is free software: you"):].split("You should")[0].strip()
    code = "".join(f"def f{i}(x):\n    return x + {i}\n\n" for i in range(20))
    texts = [header + "\n\n" + code, "The code in this repository is released under the MIT License. See the project page for details.",
             "A note. Licensed under\nCC BY-SA 4.0. Then code released under the BSD License, and more words here.", PROSE, None, LONG,
             "Released under the MIT License.", "intro\n\n" + header.replace("\n\n", "\n") + "\n\n" + PROSE, gpl + "\n" + code * 80]
    got = [r for r in found(spark, texts) if r[1] == "passage"]
    assert [r[:5] for r in got] == [
        (0, "passage", 1, 3, "GPL header"), (1, "passage", 1, 1, "MIT"), (2, "passage", 1, 2, "CC-BY-SA-4.0 short"), (2, "passage", 2, 2, "BSD notice"),
        (8, "passage", 1, len(gpl.rstrip().split("\n")), "GPL-3.0 full text")]
    assert license_scan.scan(nothing(spark), passages=True).count() == 0
    assert license_scan.scan(odd(spark), passages=True).filter(F.col("unit") == "passage").count() == 0


def test_best_runs():
    """For one template, the best run of all is the one found; next ones do not overlap it."""
    import numpy as np

    draw = random.Random(5)
    for _ in range(300):
        body = [draw.choice("abcd") for _ in range(draw.randint(3, 9))]
        words = [draw.choice("abcde") for _ in range(40)]
        known = license_scan.Templates({"x": " ".join(body)})
        raw = np.frombuffer(" ".join(words).encode(), np.uint8)
        _, grams = license_scan._bigrams(license_scan.Chunk(0, raw, np.array([0, len(raw)])))
        at = np.minimum(np.searchsorted(known.all, grams), len(known.all) - 1)
        place = np.flatnonzero(known.all[at] == grams)
        got = known.runs(0, place, at[place], np.zeros(len(place), int))
        want, pairs = Counter(zip(body, body[1:])), list(zip(words, words[1:]))
        scores = {(a, b): 2 * (Counter(pairs[a:b]) & want).total() / (b - a + want.total()) for a in range(39) for b in range(a + 1, 40)}
        assert (max(scores.values()) >= 0.7) == bool(got)
        if got:
            assert abs(got[0][0] - max(scores.values())) < 1e-12
        for score, shared, a, b in got:
            assert abs(score - scores[a, b]) < 1e-12 and shared == (Counter(pairs[a:b]) & want).total()
        taken = [i for r in got for i in range(r[2], r[3])]
        assert len(taken) == len(set(taken))
