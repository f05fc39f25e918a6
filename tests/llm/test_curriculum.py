"""Times and positions of the training order against a brute-force integration, inversion and sort."""

from collections import defaultdict
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfgraph.llm import curriculum
from shelfgraph.llm.queries import ORACLES, QUERIES
from tests.compare import duck, run_duck, run_spark
from tests.conftest import SF
from tests.llm.common import nothing, odd, odd_rows
from tests.llm.test_rules import filled, mixed_docs

GRID = np.linspace(0, 1, 200_001)


def due(knots):
    """Time by share of the whole: a fine integration, read backwards."""
    weight = np.interp(GRID, np.linspace(0, 1, len(knots)), knots)
    area = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
    return lambda part: float(np.interp(part, area / area[-1], GRID))


def brute(rows):
    """(time, slice, source, n-th row of its source) of each copy, by doc_id."""
    by_source, sizes = defaultdict(list), defaultdict(int)
    for i, text, source in rows:
        by_source[source].append((md5((f"{source}:{i}" if source is not None else str(i)).encode()).hexdigest(), i, len(text.split())))
        sizes[source] += len(text.split())
    target, out = filled(sizes, curriculum.WEIGHTS), defaultdict(list)
    for turn, source in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        when = due(curriculum.SCHEDULES[turn % 3])
        for epoch in (0, 1):
            supplied = epoch * sizes[source]
            for place, i, size in sorted(by_source[source]):
                if 2 * supplied + size <= 2 * target[source]:
                    out[i].append((when(min(1, supplied / target[source])) if target[source] else 0.0, source, place))
                supplied += size
    return out


def test_times_and_positions(spark):
    rows, docs = mixed_docs(spark)
    rows = [(i, t or "", s) for i, t, s in rows]
    want, got = brute(rows), curriculum.training_positions(docs).collect()
    assert sorted(r.id for r in got) == sorted(i for i, _, _ in rows)
    for r in got:
        assert r.times == pytest.approx([c[0] for c in want.get(r.id, [])], abs=1e-6) and len(r.ranks) == r.copies
    ranks = sorted((rank, time, r.id) for r in got for rank, time in zip(r.ranks, r.times))
    assert [r[0] for r in ranks] == list(range(1, sum(map(len, want.values())) + 1))
    assert all(a[1] <= b[1] for a, b in zip(ranks, ranks[1:]))
    assert [r[2] for r in ranks] == [r.doc_id for r in curriculum.training_order(docs).collect()]
    again = curriculum.training_positions(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_positions_of_odd_rows(spark):
    got = curriculum.training_positions(odd(spark)).collect()
    assert len(got) == len(odd_rows()) and curriculum.training_positions(nothing(spark)).count() == 0
    assert sorted(x for r in got for x in r.ranks) == list(range(1, sum(r.copies for r in got) + 1))
    empty = odd(spark).withColumn("text", F.lit(None).cast("string"))  # all due at time 0
    got = curriculum.training_positions(empty).collect()
    assert sorted(x for r in got for x in r.ranks) == list(range(1, 2 * len(got) + 1))


def test_query_has_the_rows_of_the_sql_and_the_training_positions(spark):
    found = QUERIES["op8_curriculum_positions"](spark, SF)
    assert run_spark(found.drop("times", "positions")) == run_duck(duck(SF), ORACLES["op8_curriculum"])
    rows = found.collect()
    assert sorted(p for r in rows for p in r.positions) == list(range(1, sum(map(len, (r.positions for r in rows))) + 1))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
