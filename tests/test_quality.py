import numpy as np
import pytest

from hitmerge import schemas
from hitmerge.operators import quality


def judged(spark, lists, label="off"):
    """lists: engine -> list of (length, bad ranks), one entry per keyword."""
    rows = []
    for engine, keywords in lists.items():
        for k, (n, bad) in enumerate(keywords):
            for rank in range(1, n + 1):
                hit = rank in bad
                rows.append((engine, f"k{k}", rank, hit and label == "ad", hit and label == "off", hit and label == "bad"))
    return spark.createDataFrame(rows, schemas.JUDGED)


def value(df, engine="e", label="off"):
    row = df.filter(f"engine = '{engine}' and label = '{label}'").first()
    return row[[c for c in df.columns if c not in ("engine", "label")][0]]


NONE = (10, [])
GOLDEN = [
    (quality.rank_weighted_rate, [(10, [10])] + [NONE] * 5, 0.003030),
    (lambda j: quality.fixed_scale_rate(j), [(10, [10])] + [NONE] * 5, 0.008730),
    (quality.overall_rate, [(20, [20])] + [(20, [])] * 5, 0.008333),
    (quality.rank_weighted_rate, [(20, [20])] + [(20, [])] * 5, 0.000794),
    (quality.overall_rate, [(10, range(1, 11))] * 2 + [(10, [1, 2, 3])] + [NONE] * 3, 0.383333),
    (quality.rank_weighted_rate, [(10, range(1, 11))] * 2 + [(10, [5, 6, 8])] + [NONE] * 3, 0.375758),
    (quality.rank_weighted_rate, [(10, [1])], 0.181818),
    (quality.topk_rate, [(20, [16, 20]), (20, [1, 15, 16])], round((0 + 2 / 15) / 2, 6)),
    (quality.topk_rate, [(10, [10])], 0.1),
    (quality.pooled_rate, [(20, range(1, 21)), (6, [])], round(210 / 231, 6)),
]


@pytest.mark.parametrize("case", range(len(GOLDEN)))
def test_closed_form(spark, case):
    fn, lists, want = GOLDEN[case]
    assert value(fn(judged(spark, {"e": lists}))) == want


def test_precedence(spark):
    j = spark.createDataFrame([("e", "k", 1, True, True, True), ("e", "k", 2, True, False, False)], schemas.JUDGED)
    got = {r["label"]: r["overall"] for r in quality.overall_rate(j).collect()}
    assert got == {"ad": 0.5, "off": 0.5, "bad": 0.5}


def test_spread_metrics(spark):
    j = judged(spark, {"a": [(10, [1]), (10, [1, 2, 3])], "b": [(10, []), (10, range(1, 11))], "c": [(10, [1, 2]), (10, [])]})
    r = quality.noise_floor(j).filter("label = 'off'").first()
    # rates a 0.1/0.3, b 0/1, c 0.2/0: standard errors 0.1, 0.5, 0.1; means 0.2, 0.5, 0.1
    assert (r["median_se"], r["two_se"], r["engine_range"], r["separable"]) == (0.1, 0.2, 0.4, True)
    v = quality.variance_split(j).filter("label = 'off'").first()
    assert abs(v["keyword_share"] + v["engine_share"] + v["residual_share"] - 1) < 1e-5
    m = 1.6 / 6
    total = sum((x - m) ** 2 for x in (0.1, 0.3, 0, 1, 0.2, 0))
    assert v["engine_share"] == round(2 * sum((x - m) ** 2 for x in (0.2, 0.5, 0.1)) / total, 6)
    q = quality.range_ratio(j).filter("label = 'off'").first()
    assert (q["keyword_range"], q["engine_range"]) == (round(1.3 / 3 - 0.1, 6), 0.4)
    cell = quality.cell_table(j).filter("label = 'off' and collapsed").collect()
    assert [(r["engine"], r["keyword_id"]) for r in cell] == [("b", "k1")]


@pytest.mark.parametrize("seed", range(3))
def test_variance_of_grids_with_gaps(spark, seed):
    """Shares equal those of least squares with a column per engine and keyword, also where parts of the grid have nothing in common."""
    rng = np.random.default_rng(seed)
    there = [(e, k) for e in range(6) for k in range(9) if rng.random() < 0.5 and (seed != 2 or (e < 3) == (k < 4))]
    rows = [(f"e{e}", f"k{k}", r, False, bool(rng.random() < 0.1 + 0.08 * e + 0.04 * k), False) for e, k in there for r in range(1, 21)]
    got = quality.fitted_variance_split(spark.createDataFrame(rows, schemas.JUDGED)).filter("label = 'off'").first()
    v = np.array([np.mean([x[4] for x in rows if x[:2] == (f"e{e}", f"k{k}")]) for e, k in there])
    one, es, ks = np.ones((len(v), 1)), np.eye(6)[[e for e, _ in there]], np.eye(9)[[k for _, k in there]]
    left = lambda *parts: float(np.square(v - (x := np.hstack(parts)) @ np.linalg.lstsq(x, v, rcond=None)[0]).sum())
    t, re, rk, both = left(one), left(one, es), left(one, ks), left(one, es, ks)
    want = [((t - rk) + (re - both)) / 2 / t, ((t - re) + (rk - both)) / 2 / t, both / t]
    assert np.allclose([got["keyword_share"], got["engine_share"], got["residual_share"]], want, atol=2e-6) and min(want) >= 0


def test_flips_and_spearman(spark):
    # a is worse overall, b is worse in the first 15
    j = judged(spark, {"a": [(20, [16, 17, 18, 19])], "b": [(20, [1, 2, 3])], "c": [(20, [])]})
    f = quality.flip_audit(j).filter("label = 'off'").collect()
    assert [(r["a"], r["b"], r["gap"]) for r in f] == [("a", "b", 0.05)]
    assert quality.spearman(j).filter("label = 'off'").first()["top15_rho"] == 0.0


def test_invalid_flags(spark):
    d = spark.createDataFrame([(0, "Title", ""), (1, "Title", "title!"), (2, "T", "this very sentence is repeated. this very sentence is repeated. x"),
                               (3, "T", "short. short. fine text here")], "id int, title string, snippet string")
    got = {r["id"]: (r["empty_snippet"], r["title_only"], r["repeated_segment"]) for r in quality.invalid_flags(d).collect()}
    assert got == {0: (True, False, False), 1: (False, True, False), 2: (False, False, True), 3: (False, False, False)}
