"""Quality model, host rules, curriculum, licence scan: against plain versions, and on odd rows."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfgraph.llm import curriculum, host_rules, license_scan, quality_model
from shelfgraph.llm.text import chunks, words
from tests.llm.common import LONG, PROSE, WORD, nothing, odd, odd_rows, rows_of


def test_words_of_chunks():
    rows = [PROSE, None, "", " \x0b\x0c ", "a", LONG, "b c", "日本 語　x"]
    got = []
    for chunk in chunks(pa.array(rows), limit=100):
        found, raw = words(chunk), chunk.data.tobytes()
        got += [[raw[found.start[k]:found.end[k]].decode() for k in range(found.first[r], found.first[r + 1])] for r in range(chunk.n)]
    assert got == [WORD.findall(t or "") for t in rows]


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    times = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if times[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_base_rules(spark):
    texts = [r[1] for r in odd_rows()] + ["a b c a b c", "x\ny\nx\n\n\n x\nx", "#a |b <c>\n#a |b <c>", "a b c d a b c e\n" * 30, "w" * 3000]
    docs = spark.createDataFrame([(i, t, None, 5) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_words int")
    got = {r.id: tuple(r[c] for c in host_rules.COUNTS) + (r.base_failed,) for r in host_rules.base_rules(docs).collect()}
    for i, t in enumerate(texts):
        c = plain_counts(t)
        assert got[i] == (*c, c[0] < 50 or 100 * c[4] > 50 * c[0])


def test_host_verdicts(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, good, f"good{i % 8}") for i in range(400)] + [(1000 + i, bad if i % 20 else good, "spam") for i in range(200)]
    rows += [(2000, bad, "small"), (2001, good, None), (2002, bad, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.id: r for r in host_rules.judge(docs).collect()}
    assert all(got[i].kept for i in range(400)) and not any(got[1000 + i].kept for i in range(200))
    assert got[2001].kept and not got[2002].kept and got[2001].host_rejected is None
    assert 0 < got[2000].host_rate < 1  # one failure of one document is not a rate of 1
    assert host_rules.judge(nothing(spark)).count() == 0 and host_rules.judge(odd(spark)).count() == len(odd_rows())


def test_trees_learn_and_flat_arrays_agree_with_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    model = quality_model.fit(x[:2000], y[:2000])
    p = model.scores(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.9
    for i in range(0, 1000, 100):
        z = model.start
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(x[2000 + i, feature[node]] > threshold[node])
            z += leaf[node - len(feature)]
        assert p[i] == pytest.approx(1 / (1 + np.exp(-z)))


def test_model_without_labels_or_with_one_kind():
    assert quality_model.fit(np.zeros((0, 0)), np.zeros(0)).scores(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    one = quality_model.fit(np.zeros((5, 2)), np.ones(5)).scores(np.zeros((1, 2)))
    assert one[0] > 0.99


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_model.train(docs, labels)
    found = quality_model.score(docs, model).join(labels, F.col("id") == F.col("doc_id")).filter(quality_model.held_out(F.col("id"))).collect()
    right = np.mean([(r.score >= quality_model.THRESHOLD) == (r.quality == 1) for r in found])
    kept = np.mean([r.score >= quality_model.THRESHOLD for r in found if r.quality == 1])
    assert len(found) > 50 and right > 0.9 and kept > 0.97
    again = quality_model.train(docs.repartition(3), labels.repartition(5))
    assert all((a == b).all() for a, b in zip(model[1:], again[1:], strict=True))


def test_quality_on_odd_rows(spark):
    labels = spark.createDataFrame([(0, 1, 0), (8, 0, 0), (9, None, None), (None, 1, 1), (0, 0, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_model.train(odd(spark), labels)
    found = quality_model.score(odd(spark), model).collect()
    assert len(found) == len(odd_rows()) and all(0 <= r.score <= 1 for r in found)
    kept = quality_model.keep_good(odd(spark), model, threshold=0.0)
    assert kept.columns == odd(spark).columns and kept.count() == len(odd_rows())
    assert quality_model.score(nothing(spark), quality_model.train(nothing(spark), labels)).count() == 0


def filled(sizes, weights, share=1.5, epochs=2):
    """Targets by sharing, cutting at the caps, and sharing the excess again."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [n for n in sizes if n is None]
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[n] for n in open_)
        step = {n: target[n] + left * weight[n] / total for n in open_}
        left = 0.0
        for n, t in step.items():
            cap = epochs * sizes[n]
            target[n] = min(t, cap)
            if t >= cap:
                left += t - cap
                open_.discard(n)
    return target


def mixed_docs(spark, n=600):
    rng = np.random.default_rng(8)
    rows = [(i, "w " * int(rng.integers(0, 60)), [None, "a", "b", "c", "é", "Z", "big"][min(6, int(rng.integers(0, 12)))]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_taken_words(spark):
    rows, docs = mixed_docs(spark)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = filled(sizes, curriculum.WEIGHTS)
    got = curriculum.positions(docs).collect()
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.copies <= 2 and len(r.times) == r.copies
        taken[r.source] += r.size * r.copies
    assert all(abs(taken[s] - want[s]) <= 60 for s in want)
    assert rows_of(curriculum.positions(docs.repartition(7)).drop("times")) == rows_of(curriculum.positions(docs).drop("times"))


def test_times_follow_the_schedule(spark):
    knots = [1.5, 1.0, 0.5]
    part = spark.range(101).select((F.col("id") / 100).alias("p")).select("p", curriculum.due_time(F.col("p"), F.array(*map(F.lit, knots))).alias("t")).collect()
    for r in part:
        grid = np.linspace(0, r.t, 20_001)
        area = np.trapezoid(np.interp(grid, [0, 0.5, 1], knots), grid) / np.trapezoid(knots, [0, 0.5, 1])
        assert area == pytest.approx(r.p, abs=1e-6)


def test_training_order(spark):
    rows, docs = mixed_docs(spark)
    early = curriculum.training_order(docs, schedules=((1.0, 0.0),) * 6 + ((0.0, 1.0),)).collect()
    place = [i for i, r in enumerate(early) if r.source == "a"]
    assert docs.columns == list(early[0].asDict()) and Counter(Counter(r.doc_id for r in early).values()).keys() <= {1, 2}
    late = [i for i, r in enumerate(early) if r.source is None]  # null is the last source
    assert np.mean(place) < np.mean(late)
    assert curriculum.training_order(nothing(spark)).count() == 0 and curriculum.positions(nothing(spark)).count() == 0
    assert curriculum.positions(odd(spark)).count() == len(odd_rows())
    assert curriculum.training_order(odd(spark)).columns == odd(spark).columns


def test_native_plan(spark):
    plan = curriculum.training_order(mixed_docs(spark)[1])._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def plain_scan(texts, threshold):
    import re

    word = re.compile("[0-9a-z\x80-\U0010ffff]+")

    def grams(lines):
        w = [x for line in lines for x in word.findall(line.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))]
        return Counter(zip(w, w[1:]))

    known = {n: grams([t]) for n, t in license_scan.TEMPLATES.items()}
    out = []
    for name, text in enumerate(texts):
        lines = (text or "").split("\n")
        full = [i for i, line in enumerate(lines, 1) if grams([line + " x x"]).total() > 1]
        blocks: list[list[int]] = []
        for i in full:
            if blocks and blocks[-1][-1] == i - 1:
                blocks[-1].append(i)
            else:
                blocks.append([i])
        found = [("line", [i]) for i in full] + [("block", b) for b in blocks if len(b) > 1] + [("text", full)] * (len(blocks) > 1)
        for kind, at in found:
            a = grams([lines[i - 1] for i in at])
            scores = [(-2 * (a & b).total() / (a.total() + b.total()), n) for n, b in known.items() if a]
            if scores and -min(scores)[0] >= threshold:
                out.append((name, kind, at[0], at[-1], min(scores)[1], round(-min(scores)[0], 9)))
    return sorted(out)


def test_licence_scan(spark):
    mit = license_scan.TEMPLATES["MIT text"]
    cut = mit.split(" ")
    wrapped = "\n".join(" ".join(cut[i:i + 11]) for i in range(0, len(cut), 11))
    texts = [None, "", "\n\n", mit, "intro line\n" + wrapped, "intro\n\n" + wrapped.upper() + "\n\n\nend of it", "Released under the MIT License", "x\nReleased under the BSD license!\ny",
             "This work is licensed under the GNU General Public License, version 2.", "Licensed under CC BY-NC 4.0.\n\nLicensed under CC BY-SA 4.0.", PROSE, "Licensed", LONG,
             mit.replace("Software", "Program"), "Released under the MIT License." * 2, "licensed under the apache license version 1 1 é"]
    docs = spark.createDataFrame([(i, t, "c", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, licence string, score double")
    got = sorted((*tuple(r)[:5], round(r.score, 9)) for r in license_scan.scan(docs).collect())
    assert got == plain_scan(texts, license_scan.THRESHOLD) and len(got) > 8
    assert license_scan.scan(nothing(spark)).count() == 0
    license_scan.scan(odd(spark)).collect()
