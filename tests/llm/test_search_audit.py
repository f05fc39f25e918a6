"""Decontamination, ranked search and source audit against plain versions of what they compute."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfgraph.llm import lexical_search, source_audit, winnowing
from tests.llm.common import LOWER, PROSE, SCHEMA, lowered, nothing, odd, odd_rows, rows_of

ITEM_SCHEMA = "item_id long, text string, doc_id string, hash string, size string, key string, kind string, rank string, id string"


def items_of(spark, pairs):
    return spark.createDataFrame([(i, t, "d", "h", "s", "k", "x", "r", "y") for i, t in pairs], ITEM_SCHEMA)


def docs_of(spark, texts, langs=("en",), sources=("a",)):
    rows = [(i, t, langs[i % len(langs)], sources[i % len(sources)], 0, 1, "h", "r", "d", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def random_texts(seed, count, words, most):
    rng = random.Random(seed)
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, most))) for _ in range(count)]


# Decontamination

LEAK_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits(docs, items, span):
    windows = defaultdict(set)
    for item, text in items:
        ws = LEAK_WORD.findall(lowered(text))
        n = min(span, len(ws))
        for i in range(len(ws) - n + 1 if n else 0):
            windows[tuple(ws[i:i + n])].add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        ws, hit, found = LEAK_WORD.findall(lowered(text)), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(ws) - n + 1):
                if (own := windows.get(tuple(ws[i:i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((doc, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


ODD_ITEMS = [(1, PROSE), (1, PROSE), (2, None), (3, ""), (4, "Fox JUMPS"), (None, "lazy dog while"), (None, "seven wizards mix"), (10, PROSE * 3), (9, " ... "),
             (8, "naïve café 日本語"), (7, "word5 thing5 été word6 thing6 été word7 thing7 été word8"), (6, "two")]


def test_winnowing_odd_rows(spark):
    got = rows_of(winnowing.decontaminate(odd(spark), items_of(spark, ODD_ITEMS)))
    assert got == hits([(r[0], r[1]) for r in odd_rows()], ODD_ITEMS, 10)


def test_winnowing_empty_tables(spark):
    none = spark.createDataFrame([], ITEM_SCHEMA)
    assert rows_of(winnowing.decontaminate(nothing(spark), items_of(spark, ODD_ITEMS))) == []
    assert rows_of(winnowing.decontaminate(odd(spark), none)) == hits([(r[0], r[1]) for r in odd_rows()], [], 10)


@pytest.mark.parametrize("span,k,words", [(10, 5, "ab"), (4, 2, "abc"), (3, 3, "abcdef"), (5, 1, "abcdefghijklmnopqrst"), (10, 5, "abcdefg")])
def test_winnowing_random(spark, span, k, words):
    """Few different words: ties between hashes, overlapping and repeated hits, and windows that begin and end anywhere."""
    docs = random_texts(span, 40, words, 60)
    items = random_texts(k + 50, 12, words, 25)
    docs += [docs[0] + " x " + items[0] + " y " + items[0], items[1], items[1], *docs[:3]]
    got = rows_of(winnowing.decontaminate(docs_of(spark, docs), items_of(spark, list(enumerate(items))), span=span, k=k))
    assert got == hits(list(enumerate(docs)), list(enumerate(items)), span)


def test_winnowing_hot_passage(spark):
    """One passage in most texts and most items: no row for each text and item and place."""
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [f"a{i} {passage} b{i}" for i in range(150)] + ["clean text of a few words"] * 10
    items = [(i, f"{passage} tail{i}") for i in range(60)]
    found = winnowing.decontaminate(docs_of(spark, docs), items_of(spark, items))
    assert rows_of(found) == hits(list(enumerate(docs)), items, 10)


def test_winnowing_is_native(spark):
    plan = winnowing.decontaminate(odd(spark), items_of(spark, ODD_ITEMS))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_slots_of_hashes(spark):
    prints = spark.createDataFrame([(-5,), (0,), (1 << 62,), (123456789123,)], "hash long")
    taken = winnowing.slot_bytes(prints, 1 << 16)
    want = {h % (1 << 16) for h in (-5, 0, 1 << 62, 123456789123)} | {(h >> 24) % (1 << 16) for h in (-5, 0, 1 << 62, 123456789123)}
    assert {i for i, b in enumerate(taken) if b == ord("1")} == want


# Ranked search

SEARCH_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k):
    bags = [(i, Counter(SEARCH_TERM.findall(lowered(t)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked = Counter(SEARCH_TERM.findall(lowered(text)))
        scored = []
        for i, b in bags:
            m = 75 + 25 * sum(b.values()) * n_docs // n_terms
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t, c in asked.items() if b[t])
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def test_search_odd_rows(spark):
    items = [(1, "brown fox été"), (1, "brown fox été"), (2, None), (3, ""), (None, "two words 日本語"), (5, "nowhere"), (6, "The the THE potion"), (7, PROSE)]
    for k in (1, 4, 100):
        got = rows_of(lexical_search.ranked_search(odd(spark), items_of(spark, items), k))
        assert got == ranked([(r[0], r[1]) for r in odd_rows()], items, k)


def test_search_empty_tables(spark):
    items = items_of(spark, [(1, "brown fox")])
    assert rows_of(lexical_search.ranked_search(nothing(spark), items)) == []
    assert rows_of(lexical_search.ranked_search(odd(spark), spark.createDataFrame([], ITEM_SCHEMA))) == []
    assert rows_of(lexical_search.ranked_search(docs_of(spark, ["", None, "..."]), items)) == []


@pytest.mark.parametrize("block_terms", [lexical_search.BLOCK_TERMS, 30])
def test_search_random(spark, block_terms, monkeypatch):
    """Skewed words, copies of a text and near copies: ties at the last rank, several blocks of items, small blocks of vectors."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    docs = [" ".join(words[min(59, int(x))] for x in rng.exponential(12, rng.integers(1, 80))) for _ in range(300)]
    docs += [docs[0]] * 40 + [docs[1] + " w3"] * 30
    items = [(i, " ".join(words[int(x)] for x in rng.integers(0, 60, 15))) for i in range(8)] + [(99, docs[0]), (98, docs[1] + " w3")]
    got = rows_of(lexical_search.ranked_search(docs_of(spark, docs).repartition(6), items_of(spark, items), 7, block_terms=block_terms))
    assert got == ranked(list(enumerate(docs)), items, 7)


def test_search_bounds_hold_and_prune():
    """No bound is below its exact score, and blocks of short vectors are passed over."""
    rng = np.random.default_rng(5)
    weight, rows = rng.integers(0, 9000, 50), 400
    root = np.sqrt(weight.astype(float))
    cells = [np.sort(rng.choice(50, rng.integers(1, 20), replace=False)) for _ in range(rows)]
    slots, size = np.concatenate(cells), np.array([len(c) for c in cells])
    impact = rng.integers(1, 10**6, len(slots))
    cut = np.concatenate([[0], np.cumsum(size)])
    norm = np.sqrt(np.add.reduceat(impact.astype(float) ** 2 * weight[slots], cut[:-1])) * lexical_search.SAFE
    block = lexical_search.Block(np.arange(rows), norm, size, slots, impact, root)
    for _ in range(20):
        own = rng.choice(50, 8, replace=False)
        times = rng.integers(1, 3, 8)
        factor = np.zeros(50, np.int64)
        factor[own] = times * weight[own]
        score = block.scores(np.arange(rows), factor)
        plain = [sum(int(factor[s]) * int(v) for s, v in zip(c, impact[a:a + len(c)])) for c, a in zip(cells, cut)]
        assert score.tolist() == plain
        for part in (0, 3, 8):
            rest = math.sqrt(float((times[part:] ** 2 * weight[own[part:]]).sum()))
            assert (block.bounds(own[:part], times[:part], root, rest) >= score).all()
        assert math.sqrt(float((times ** 2 * weight[own]).sum())) * block.largest >= score.max()


# Source audit

AUDIT_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audited(rows, least, ranks):
    """rows: (lang, source, text)."""
    rows = [(lang or "", source or "", Counter(AUDIT_TERM.findall((text or "").translate(LOWER)))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        kept = [t for t, n in Counter(t for r in own for t in r[2]).items() if n >= least]
        counts = {s: Counter() for s in {r[1] for r in own}}
        for _, s, bag in own:
            counts[s] += Counter({t: bag[t] for t in kept if bag[t]})
        whole = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda p, q: (p - q) ** 2 // q
        for s, c in counts.items():
            pairs = [(o, sum(f(share(c, t), share(d, t)) for t in kept)) for o, d in counts.items() if o != s]
            terms = [(t, f(share(c, t), share(whole, t))) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found if part == "pair" else found[:ranks])]
    return sorted(out, key=repr)


def test_audit_odd_rows(spark):
    want = lambda least, ranks: audited([(r[2], r[3], r[1]) for r in odd_rows()], least, ranks)
    assert rows_of(source_audit.audit(odd(spark))) == want(3, 200)
    assert rows_of(source_audit.audit(odd(spark), least_docs=1, term_ranks=7)) == want(1, 7)


def test_audit_without_terms(spark):
    assert rows_of(source_audit.audit(nothing(spark))) == []
    bare = docs_of(spark, ["", "12", None, "a", "b", "c"], langs=("de", "fr"), sources=("x", "y", "z"))
    got = rows_of(source_audit.audit(bare))
    assert got == audited([(r.lang, r.source, r.text) for r in bare.collect()], 3, 200)
    assert {r[4] for r in got} == {0}


@pytest.mark.parametrize("cells", [source_audit.TREE_CELLS, 40])
def test_audit_random(spark, cells, monkeypatch):
    """Many sources with different words; the tree in one piece and in many."""
    texts = random_texts(8, 400, [chr(97 + i) * j for i in range(26) for j in (1, 2)] + ["été", "Été", "日本"], 40)
    docs = docs_of(spark, texts, langs=("en", "de", None), sources=[f"s{i}" for i in range(7)] + [None, "", "only"])
    monkeypatch.setattr(source_audit, "TREE_CELLS", cells)
    assert rows_of(source_audit.audit(docs)) == audited([(r.lang, r.source, r.text) for r in docs.collect()], 3, 200)


def test_tree_pieces_add_up():
    """Corrections of a tree cut into pieces are those of the rows looked at one by one."""
    rng = np.random.default_rng(1)
    paths = sorted(tuple((int(s), int(rng.integers(1, 4)) * 1000) for s in sorted(rng.choice(6, rng.integers(1, 6), replace=False))) for _ in range(200))
    empty = rng.integers(1, 50, 6)
    times = rng.integers(1, 9, len(paths))

    def corrections(at):
        own = [paths[i] for i in at]
        deepest = max(map(len, own))
        matrix = np.ones((3, len(own), deepest), np.int64)
        for i, path in enumerate(own):
            for j, (s, p) in enumerate(path):
                matrix[:, i, j] = s, p, empty[s]
        g, h, amount = source_audit.tree_corrections(*matrix, np.array([len(p) for p in own]), times[at])
        return Counter({(a, b): c for a, b, c in zip(g.tolist(), h.tolist(), amount.tolist())})

    whole = corrections(np.arange(len(paths)))
    single, halves = Counter(), Counter()
    for i in range(len(paths)):
        for key, c in corrections(np.array([i])).items():
            single[key] += c
    for part in (np.arange(90), np.arange(90, len(paths))):
        for key, c in corrections(part).items():
            halves[key] += c
    drop = lambda c: {k: v for k, v in c.items() if v}
    assert drop(whole) == drop(single) == drop(halves)
