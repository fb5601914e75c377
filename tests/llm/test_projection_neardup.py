import numpy as np
import pytest

from lodestar.llm import projection_neardup as p

VECTORS = "vec_id long, embedding array<float>, label int"


def at_cosine(v, cosine, rng):
    other = rng.normal(size=len(v))
    other -= other @ v * v / (v @ v)
    return cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(400, 64))
    out = [v for v in base]
    out += [at_cosine(base[i], 0.901, rng) * 3 for i in range(150)]
    out += [at_cosine(base[200], 0.96, rng) for _ in range(60)]
    out += [base[3]] * 20 + [base[5] * 2.5]
    return [(i, v.astype(np.float32).tolist(), i % 3) for i, v in enumerate(out)]


def brute(rows):
    x = np.array([r[1] for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.arange(len(rows))
    while True:
        low = np.array([min(label[i], *label[link[i]]) if link[i].any() else label[i] for i in range(len(rows))])
        if (low == label).all():
            return link.sum(axis=1), label
        label = low


def test_recall_against_brute_force(spark, rows):
    n, label = brute(rows)
    got = {r.vec_id: r for r in p.classes(spark.createDataFrame(rows, VECTORS)).collect()}
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= n).all() and found.sum() >= p.RECALL * n.sum()
    assert np.mean([got[i].component_id == label[i] for i in range(len(rows))]) >= p.RECALL
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_large_cells_are_dealt_as_blocks(spark, rows, monkeypatch):
    whole = sorted(map(tuple, p.classes(spark.createDataFrame(rows, VECTORS)).collect()))
    monkeypatch.setattr(p, "CELL_ROWS", 7)
    assert sorted(map(tuple, p.classes(spark.createDataFrame(rows, VECTORS)).collect())) == whole


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0), (6, [None, 1.0], 0), (7, [1.0, 0.0], 0), (8, [1.0, -0.0], 0), (9, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], None), (7, [1.0, 0.0], 0)]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in p.classes(spark.createDataFrame(rows, VECTORS)).collect())
    alone = [(str(i), 0, str(i), True) for i in (1, 2, 3, 4, 5, 6)]
    assert got == sorted([*alone, ("7", 3, "7", True), ("7", 3, "7", True), ("8", 3, "7", False), ("9", 0, "9", True), ("None", 3, "7", False)])
    assert p.classes(spark.createDataFrame([], VECTORS)).count() == 0


def test_plan_grows_slowly_and_keeps_recall():
    small, large = p.Plan.calibrated(10_000), p.Plan.calibrated(10_000_000)
    assert small.width < large.width <= 20
    for plan in (small, large):
        assert (1 - (1 - p.same_side(p.COSINE) ** plan.width) ** plan.bundles) * (1 - p.COUNT_LOSS) >= p.RECALL


def test_recall_of_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6000, 64))
    pairs = np.stack([at_cosine(v, 0.9005, rng) for v in base])
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(np.concatenate([base, pairs]))]
    assert p.Plan.calibrated(len(rows)).width >= 4
    got = {r.vec_id: r.component_id for r in p.classes(spark.createDataFrame(rows, VECTORS)).collect()}
    assert np.mean([got[i] == got[6000 + i] for i in range(6000)]) >= p.RECALL - 0.002  # two standard deviations


def test_nothing_below_the_threshold_is_linked(spark):
    a = np.zeros(8)
    a[0] = 1.0
    rows = []
    for i, cosine in enumerate((0.8999999999995, 0.9000000000005)):
        b = np.zeros(8)
        b[0], b[1] = cosine, np.sqrt(1 - cosine**2)
        rows += [(10 * i, np.roll(a, 4 * i).tolist(), 0), (10 * i + 1, np.roll(b, 4 * i).tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: r.n_links for r in p.classes(df).collect()} == {0: 0, 1: 0, 10: 1, 11: 1}


def test_counts_by_tiles_and_by_steps_agree(spark, rows, monkeypatch):
    whole = sorted(map(tuple, p.classes(spark.createDataFrame(rows, VECTORS)).collect()))
    for tiled in (2, 10**6):
        monkeypatch.setattr(p, "TILED", tiled)
        assert sorted(map(tuple, p.classes(spark.createDataFrame(rows, VECTORS)).collect())) == whole


def test_a_group_of_near_copies_gives_no_pairs(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=32)
    rows = [(i, (centre + 0.05 * rng.normal(size=32)).astype(np.float32).tolist(), 0) for i in range(1500)]
    named = spark.createDataFrame([(i, 1, [float(x) for x in v]) for i, v, _ in rows], "id long, copies long, vector array<double>")
    found = p.links(named, p.Plan.calibrated(1500), kind="f4")
    assert found.count() <= 1500 * 16
    got = p.classes(spark.createDataFrame(rows, VECTORS)).collect()
    assert all(r.n_links == 1499 and r.component_id == 0 for r in got)
