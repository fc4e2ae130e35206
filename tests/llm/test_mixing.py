import math
from collections import Counter

import numpy as np
import pytest

from stratamesh.llm import mixing as M

TARGETS = "mix_key string, source string, target_share double, max_repeats int, size_factor double"


@pytest.mark.parametrize("cap", [1, 2, 5])
@pytest.mark.parametrize("mean", [0.1, 0.9, 1.5, 4.5])
def test_capped_rate_has_the_mean(mean, cap):
    r = M.capped_rate(mean, cap)
    if mean >= cap:
        assert math.isinf(r)
    else:
        x = np.minimum(np.random.default_rng(1).poisson(r, 400_000), cap)
        assert abs(x.mean() - mean) < 0.02


def docs_of(spark, counts):
    rows, i = [], 0
    for s, n in counts:
        for _ in range(n):
            rows.append((i, s, 10 + i % 7))
            i += 1
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


def test_shares(spark):
    docs = docs_of(spark, [("big", 6000), ("mid", 3000), ("tiny", 4), (None, 50), ("unasked", 500)])
    targets = spark.createDataFrame(
        [("m", "big", 0.5, 2, 0.5), ("m", "mid", 0.3, 2, 0.5), ("m", "tiny", 0.2, 3, 0.5), ("m", "absent", 0.0, 3, 0.5), ("m", "nowhere", 0.1, 3, 0.5), ("z", "big", 0.0, 2, 1.0), ("n", "big", None, None, None)],
        TARGETS,
    )
    plan = M.mix_plan(docs, targets, source="source", tokens="n_tokens").cache()
    total = sum(r.n_tokens for r in docs.collect())
    report = {(r.mix_key, r.source): r for r in M.mix_shares(docs, plan, key="doc_id", source="source", tokens="n_tokens").collect()}
    assert len(report) == 7
    for s, share in (("big", 0.5), ("mid", 0.3)):
        r = report["m", s]
        assert abs(r.drawn_tokens / (total * 0.5) - share) < 0.05 * share + 0.01 and r.most_copies <= 2
    tiny = report["m", "tiny"]
    assert tiny.is_capped and tiny.drawn_copies == 12 and tiny.most_copies == 3
    assert report["m", "nowhere"].drawn_tokens == 0 and report["z", "big"].drawn_copies == 0 and report["n", "big"].drawn_copies == 0
    assert abs(sum(r.actual_share for k, r in report.items() if k[0] == "m") - 1) < 1e-9
    drawn = M.draw(docs, plan, key="doc_id", source="source").collect()
    again = M.draw(docs.repartition(3), plan, key="doc_id", source="source").collect()
    key = lambda r: (r.mix_key, r.doc_id, r.copy_no)
    assert sorted(map(key, drawn)) == sorted(map(key, again)) and len(set(map(key, drawn))) == len(drawn)
    assert Counter(r.source for r in drawn) == {s: r.drawn_copies for (m, s), r in report.items() if m == "m" and r.drawn_copies}
    order = [r.doc_id for r in drawn if r.mix_key == "m"]
    assert order != sorted(order) and abs(np.corrcoef(range(len(order)), order)[0, 1]) < 0.05
    other = M.draw(docs, plan, key="doc_id", source="source", seed=5).collect()
    assert sorted(map(key, other)) != sorted(map(key, drawn))


def test_empty_tables(spark):
    docs, targets = docs_of(spark, [("a", 3)]), spark.createDataFrame([], TARGETS)
    plan = M.mix_plan(docs, targets, source="source", tokens="n_tokens")
    assert M.draw(docs, plan, key="doc_id", source="source").count() == 0
    none = docs.limit(0)
    plan = M.mix_plan(none, spark.createDataFrame([("m", "a", 1.0, 2, 1.0)], TARGETS), source="source", tokens="n_tokens")
    assert M.draw(none, plan, key="doc_id", source="source").count() == 0
    assert M.mix_shares(none, plan, key="doc_id", source="source", tokens="n_tokens").count() == 1
