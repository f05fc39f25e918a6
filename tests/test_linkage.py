"""Containment joins against brute force over all pairs."""

import random

from pyspark.sql import functions as F

from shelfgraph.functions.titles import linkage_title
from shelfgraph.operators import linkage as L
from shelfgraph.operators.linkage import near_substrings


def words(rng, n, alphabet="ab ", low=1, high=14):
    out = set()
    while len(out) < n:
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high))).strip()
        if t:
            out.add(t)
    return sorted(out)


def test_substrings(value):
    got = set(value(near_substrings("x", 2), "x string", "abcd"))
    assert got == {"abcd", "abc", "bcd", "ab", "bc", "cd"}
    assert value(near_substrings("x", 5), "x string", "a") == ["a"]
    assert value(near_substrings("x", 5), "x string", "") == []


def test_series_against_all_pairs(spark):
    rng = random.Random(3)
    works, series = words(rng, 150, "ABC"), words(rng, 120, "ABC", 1, 20)
    order = list(range(len(works)))
    rng.shuffle(order)
    w = spark.createDataFrame(list(zip(works, order)), "work_key string, ord int")
    s = spark.createDataFrame([(f"s{i}", k) for i, k in enumerate(series)], "series_id string, key string")
    got = {r.series_id: (r.work_key, r.match) for r in L.match_series(s, w, gap=4).collect()}
    by_order = sorted(zip(order, works))
    for i, key in enumerate(series):
        if key in works:
            want = (key, "exact")
        else:
            near = [k for _, k in by_order if (key in k or k in key) and abs(len(k) - len(key)) <= 4]
            want = (near[0], "contained") if near else None
        assert got.get(f"s{i}") == want, key


def test_links_against_all_pairs(spark):
    rng = random.Random(5)
    works = words(rng, 200, "abC ", 3, 12)
    titles = sorted({t.replace(" ", "") for t in words(rng, 250, "abC ", 3, 13)})
    rows = [(f"w{i:03}", t) for i, t in enumerate(works)]
    got = {r.title: (r.id, r.match) for r in L.link_titles(
        spark.createDataFrame([(t,) for t in titles], "title string"), spark.createDataFrame(rows, "id string, title string")).collect()}
    pack = lambda t: t.replace(" ", "")
    for t in titles:
        exact = [i for i, w in rows if w == t]
        if exact:
            want = (min(exact), "exact")
        else:
            low = t.lower()
            near = [
                (abs(len(pack(w)) - len(t)), i, len(pack(w))) for i, w in rows
                if abs(len(pack(w)) - len(t)) <= 3 and (
                    pack(w.lower()) == low or (low in w.lower() and len(t) >= 5) or (w.lower() in low and len(w) >= 5))
            ]
            best = min(near) if near else None
            want = (best[1], "flexible") if best and max(best[2], len(t)) <= 1.8 * min(best[2], len(t)) else None
        assert got.get(t) == want, t


def test_one_title_held_by_a_third_of_the_works(spark):
    """The hot title is reduced to its first work before it meets the other side."""
    works = spark.range(3000).select(
        F.format_string("w%05d", "id").alias("id"),
        F.when(F.col("id") < 1000, "hot title").otherwise(F.concat(F.lit("t"), "id")).alias("title"))
    titles = spark.range(2000).select(F.when(F.col("id") < 700, "hottitle").otherwise(F.concat(F.lit("t"), "id")).alias("title"))
    links = {r.title: r.id for r in L.link_titles(titles, works).collect()}
    assert links["hottitle"] == "w00000" and links["t1500"] == "w01500"


def test_linkage_title(value):
    assert value(linkage_title("x"), "x string", " ONE PIECE～（外伝）-!") == "ONEPIECE"
    assert value(linkage_title("x"), "x string", None) == ""
