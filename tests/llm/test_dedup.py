"""Exact duplicates, similarity join, repeated byte strings: against plain versions, and on odd rows."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from shelfgraph.llm import exact_dedup, jaccard_join, suffix_dedup
from shelfgraph.llm.components import components
from tests.llm.common import PROSE, WORD, lowered, nothing, odd, odd_rows, rows_of


def test_cuckoo_index_inserts_deletes_and_grows():
    index, plain = exact_dedup.CuckooIndex(2), {}
    rng = np.random.default_rng(3)
    keys = [(hashlib.sha256(bytes([i % 256, i // 256])).digest(), i) for i in range(500)]
    for _ in range(4000):
        key = keys[rng.integers(len(keys))]
        if key in plain:
            assert index.get(key) == plain.pop(key)
            assert index.delete(key) and not index.delete(key)
        else:
            assert index.get(key) is None
            plain[key] = int(rng.integers(1000))
            index.insert(key, plain[key])
    assert dict(index.items()) == plain and len(index) == len(plain) and index.resizes > 0


def test_cuckoo_index_verifies_fingerprint_hits():
    index = exact_dedup.CuckooIndex(1)
    one, two = (b"\1" * 10 + b"a" * 22, 1), (b"\1" * 10 + b"b" * 22, 1)  # same buckets, same fingerprint
    index.insert(one, "x")
    assert index.get(two) is None and not index.delete(two) and index.get(one) == "x"


def test_exact_duplicates_on_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    got = rows_of(exact_dedup.exact_duplicates(odd(spark)).select("id", "digest", "keep_id", "group_size", "kept"))
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = [(i, hashlib.sha256(lowered(t).encode()).digest(), keep[lowered(t)], len(groups[lowered(t)])) for i, t in rows]
    assert sorted((g[:1] + (bytes(g[1]),) + g[2:4] for g in got), key=repr) == sorted(want, key=repr)
    assert sum(g[4] for g in got) == len(groups)
    kept = exact_dedup.drop_exact_duplicates(odd(spark))
    assert kept.columns == odd(spark).columns and Counter(lowered(r.text) for r in kept.collect()) == Counter(groups.keys())


def linked(rows, k, percent):
    """Groups and numbers of links by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = WORD.findall(lowered(t))
        sets.append({tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
                links[i] += 1
                links[j] += 1
    groups: dict[int, list] = {}
    for i, (name, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(name)
    least = {r: min((n for n in names if n is not None), default=None) for r, names in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[root(i)] if sets[i] else rows[i][0], links[i]) for i in range(len(rows))), key=repr)


@pytest.mark.parametrize(("k", "percent", "block_keys"), [(3, 90, 4_000_000), (5, 80, 4_000_000), (2, 60, 200)])
def test_jaccard_groups(spark, k, percent, block_keys):
    rng = np.random.default_rng(k)
    base = [[f"w{x}" for x in rng.integers(0, 400, rng.integers(1, 120))] for _ in range(25)]
    rows = []
    for i in range(260):
        w = list(base[int(rng.integers(len(base)))])
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(len(w)))] = f"x{rng.integers(1000)}"
        rows.append((i, " ".join(w)))
    rows += [(r[0], r[1]) for r in odd_rows() if r[0] != 5]
    got = jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), k, percent, block_keys=block_keys)
    assert rows_of(jaccard_join.component_ids(got)) == linked(rows, k, percent)


@pytest.mark.parametrize(("k", "percent", "listed"), [(3, 90, 64), (3, 90, 2), (5, 80, 2), (1, 50, 64), (1, 50, 2), (2, 100, 2)])
def test_jaccard_groups_of_cut_copies(spark, monkeypatch, k, percent, listed):
    """Copies that are cut to sizes about the least that can be similar, small and large, at keys whose pairs are listed and at keys of many sets."""
    monkeypatch.setattr(jaccard_join, "LISTED", listed)
    rng = np.random.default_rng(percent + listed)
    rows = []
    for size in (1, 2, 4, 8, 9, 10, 16, 20, 25, 40, 81, 90, 100, 200):
        base = [f"w{x}" for x in rng.integers(0, 4000, size)]
        for i in range(8):
            cut = base[: max(1, size - int(rng.integers(0, 2 + size * (100 - percent) // 100)))]
            rows.append((len(rows), " ".join(cut if i % 2 else cut[::-1][:-1][::-1] + ["end"])))
    got = jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), k, percent)
    assert rows_of(jaccard_join.component_ids(got)) == linked(rows, k, percent)


def test_a_shared_passage_alone_makes_no_block(spark):
    """A chain of texts, each with a passage of the one before, and a near copy of every tenth: only the copies are looked at together."""
    texts = []
    for i in range(40):
        own = [f"t{i}w{j}" for j in range(120)]
        own[20:28], own[60:68] = [f"p{i}v{j}" for j in range(8)], [f"p{i + 1}v{j}" for j in range(8)]
        texts += [" ".join(own)] + [" ".join([*own[:119], "end"])] * (i % 10 == 0)
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id long, text_key long, text string")
    schema = "id long, text_key long, n_shingles long, n_low long, node long, name binary"
    sets = rows.mapInArrow(jaccard_join._set_rows(3, 90), schema).persist()
    keys = jaccard_join.prefix_keys(rows.select("text"), sets, 3, 90).persist()
    assert keys.groupBy("key").count().filter("count > 1").count() > 40  # the passages are in the prefixes
    ids = {r.node: r.id for r in sets.collect()}
    found = {tuple(sorted((ids[r.a], ids[r.b]))) for r in jaccard_join.likely_pairs(keys, 90).collect()}
    copies = [i for i, t in enumerate(texts) if t.endswith(" end")]
    assert found == {(i - 1, i) for i in copies}


def test_near_duplicates_kept_at_five_words_and_0_8(spark):
    """The rows that stay, against all pairs: clusters with edits, small texts, passages that many texts share, texts without words."""
    rng = np.random.default_rng(80)
    passage = " ".join(f"p{i}" for i in range(40))
    base = [[f"w{x}" for x in rng.integers(0, 3000, rng.integers(1, 90))] for _ in range(60)]
    rows = []
    for i in range(300):
        w = list(base[int(rng.integers(len(base)))])
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(len(w)))] = f"x{rng.integers(1000)}"
        rows.append((i, " ".join(w) + (" " + passage if i % 3 == 0 else "")))
    rows += [(400, None), (401, ""), (402, PROSE), (403, PROSE.upper()), (404, " \n")]
    kept = jaccard_join.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, n, least, _ in linked(rows, 5, 80) if i == least or not n)


def test_t_occurrence_with_long_lists():
    rng = np.random.default_rng(5)
    shared = np.arange(1, 40, dtype=np.uint64)  # keys of all sets: lists much longer than the others
    sets = [np.unique(np.concatenate([shared, rng.integers(1000, 1400, 60).astype(np.uint64)])) for _ in range(400)]
    sets += [np.unique(np.append(s[:-1], np.uint64(5000 + i))) for i, s in enumerate(sets[:50])]
    found = jaccard_join.t_occurrence(sets, np.ones(len(sets), np.int64), np.zeros(len(sets), np.int64), 90)
    plain = [set(s.tolist()) for s in sets]
    want = [sum(1 for j, b in enumerate(plain) if i != j and 100 * len(a & b) >= 90 * len(a | b)) for i, a in enumerate(plain)]
    assert found.links.tolist() == want


def test_drop_near_duplicates_keeps_texts_without_words(spark):
    kept = jaccard_join.drop_near_duplicates(odd(spark))
    bare = [r for r in odd_rows() if not WORD.findall(r[1] or "")]
    found = kept.collect()
    assert kept.columns == odd(spark).columns and sum(not WORD.findall(r.text or "") for r in found) == len(bare)
    assert sum(1 for r in found if r.text in (PROSE, PROSE.upper())) == 1


@pytest.mark.parametrize("edges_per_task", [7, 1000])
def test_components_of_a_path_and_a_star(spark, edges_per_task):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    found = components(spark.createDataFrame(edges, "a long, b long").repartition(8), edges_per_task=edges_per_task)
    got = dict(tuple(r) for r in found.collect())
    assert got == {i: 0 for i in range(41)} | {100: 100} | {200 + i: 100 for i in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_repeated_windows_from_merged_transforms(seed):
    rng = np.random.default_rng(seed)
    width, n = int(rng.integers(2, 40)), int(rng.integers(1, 12))
    letters = list(b"ab" if seed % 2 else b"abcdefg\x00\xff")
    texts = [bytes(rng.choice(letters, int(rng.integers(width, width + 60))).astype(np.uint8)) for _ in range(n)]
    texts += [texts[0][:width + 5] + texts[-1], b"x" + texts[0]]
    copies = [int(x) for x in rng.integers(1, 3, len(texts))]
    count = Counter()
    for t, m in zip(texts, copies):
        count.update({w: 0 for w in ()})
        for i in range(len(t) - width + 1):
            count[t[i:i + width]] += m
    want = [[count[t[i:i + width]] > 1 for i in range(len(t) - width + 1)] for t in texts]
    for shards in (1, 2, 5):
        assert [f.tolist() for f in suffix_dedup.repeated_windows(texts, copies, width, shards)] == want


def test_merge_orders_and_parts_suffixes():
    texts = [b"banana bandana\x01", b"ananas band\x01"]
    shards = []
    for t in texts:
        symbols = np.append(np.frombuffer(t, np.uint8).astype(np.uint16) + 2, 0).astype(np.uint16)
        shards.append(suffix_dedup.transform(symbols))
    merged = suffix_dedup.merge([s.symbols for s in shards], 4)
    suffixes = [texts[k][int(p):] for k, s in enumerate(shards) for p in s.place]
    heads = [suffixes[r][:4] for r in merged.rows]
    real = [h for h in heads if len(h) == 4]
    assert real == sorted(real)
    for i in range(1, len(heads)):
        if len(heads[i]) == len(heads[i - 1]) == 4:
            common = next((k for k in range(4) if heads[i][k] != heads[i - 1][k]), 4)
            assert merged.common[i] <= common and (merged.common[i] == 4) == (common == 4)


def plain_removals(rows, width):
    count = Counter()
    raw = [(t or "").encode() for _, t in rows]
    for b in raw:
        count.update(b[i:i + width] for i in range(len(b) - width + 1))
    out = []
    for (name, _), b in zip(rows, raw):
        flags = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if count[b[i:i + width]] > 1:
                flags[i:i + width] = True
        out.append((name, len(b), int(flags.sum()), len(suffix_dedup.flag_runs(flags)), hashlib.sha256(np.frombuffer(b, np.uint8)[~flags].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def test_removals(spark):
    rng = np.random.default_rng(9)
    passage = "".join(rng.choice(list("abcdefgh é"), 150))
    rows = []
    for i in range(120):
        parts = ["".join(rng.choice(list("abcdefgh é"), int(rng.integers(0, 200)))) for _ in range(2)]
        rows.append((i, parts[0] + (passage if i % 3 == 0 else passage[:90]) + parts[1]))
    rows += [(200, "ab" * 300), (201, "c" * 199), (202, "c" * 45), (203, None), (204, ""), (204, "x" * 30 + passage), (None, passage), (0, rows[0][1]), (None, None)]
    docs = spark.createDataFrame([(a, b, 1, "k") for a, b in rows], "doc_id long, text string, at int, class string")
    assert rows_of(suffix_dedup.removals(docs, width=50)) == plain_removals(rows, 50)
    keyed = suffix_dedup._keyed(docs, "doc_id", "text")

    def cover(spans):
        out: dict = {}
        for name, key, a, b in spans.collect():
            out.setdefault((name, key), set()).update(range(a, b))
        return out

    assert cover(suffix_dedup.repeated_spans(keyed, 50, class_bytes=500)) == cover(suffix_dedup.repeated_spans(keyed, 50))


def test_empty_tables(spark):
    docs = nothing(spark)
    assert exact_dedup.exact_duplicates(docs).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs).count() == 0
    assert jaccard_join.jaccard_groups(docs).count() == 0
    assert jaccard_join.drop_near_duplicates(docs).count() == 0
    assert suffix_dedup.removals(docs).count() == 0


def test_odd_rows_have_one_result_each(spark):
    assert suffix_dedup.removals(odd(spark)).count() == len(odd_rows())
    assert jaccard_join.jaccard_groups(odd(spark)).count() == len(odd_rows())
