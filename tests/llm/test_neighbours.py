import numpy as np
import pytest

from lodestone.llm import neighbours
from lodestone.llm import neighbours_kernel as k


def clusters(n, dim, per, seed, noise=0.03):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(max(1, n // per), dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = centres[r.integers(0, len(centres), n)] + noise * r.normal(size=(n, dim))
    return (x * r.uniform(0.5, 3, size=(n, 1))).astype(np.float32)


def brute(rows, k=5, least=0.82):
    seen = {}
    for i, v in rows:
        if v is not None and len(v) == 16 and np.isfinite(v).all() and np.abs(v).sum() > 0:
            seen[i] = np.array(v, np.float32).astype(np.float64)
    ids = np.array(sorted(seen))
    if not len(ids):
        return set()
    x = np.array([seen[i] / np.linalg.norm(seen[i]) for i in ids])
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -9)
    out = set()
    for a in range(len(ids)):
        for b in np.argsort(-s[a], kind="stable")[:k]:
            if s[a, b] >= least:
                out.add((min(ids[a], ids[b]), max(ids[a], ids[b])))
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "clash", 0) for i, v in rows], "chunk_id long, embeddings array<float>, key string, cell int")
    pairs = neighbours.nearest_pairs(df, dim=16, **options).collect()
    got = {(r["id_a"], r["id_b"]) for r in pairs}
    assert len(got) == len(pairs) and all(a < b for a, b in got)
    return got


def test_dirty_input(spark):
    x = clusters(300, 16, 12, 1)
    rows = [(int(i * 3), v.tolist()) for i, v in enumerate(x)]
    rows += rows[:20]  # delivered twice
    rows += [(10_000 + i, x[0].tolist()) for i in range(40)]  # equal vectors, many ids
    rows += [(20_000 + i, x[5].tolist()) for i in range(3)]
    rows += [(30_000, None), (30_001, [0.0] * 16), (30_002, [1.0] * 15), (30_003, [float("nan")] * 16), (30_004, (x[7] * 4).tolist()), (30_005, [])]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, [(1, None), (2, [0.0] * 16)]) == set()
    df = spark.createDataFrame([], "chunk_id long, embeddings array<float>")
    assert neighbours.nearest_pairs(df, dim=16).count() == 0
    with pytest.raises(ValueError):
        neighbours.nearest_pairs(df, dim=16, k=0)


@pytest.mark.parametrize("k", [1, 9, 50])
def test_other_numbers_of_neighbours(spark, k):
    x = clusters(400, 16, 60, 3)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(70)]
    assert run(spark, rows, k=k) == brute(rows, k)


@pytest.mark.parametrize("max_cells", [3, 8])
def test_cells_are_cut_until_they_are_small(spark, max_cells, monkeypatch):
    """Many more cells than one tree may have, with a crowd of a third of all rows, routed by several tasks a cell."""
    monkeypatch.setattr(neighbours, "SALT_ROWS", 500)
    x = np.concatenate([clusters(4000, 16, 40, 2), crowd(2000, 16, 8)])
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    want = brute(rows)
    got = run(spark, rows, cell_rows=150, sample_rows=3000, max_cells=max_cells)
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)


def test_no_cell_stays_large(spark):
    x = clusters(5000, 16, 40, 2)
    rows = [(0, bytes([i % 256, i // 256]), [int(i)], v.tobytes()) for i, v in enumerate(x)]
    cells = spark.createDataFrame(rows, neighbours._CELLS)
    out = neighbours._cut_again(cells, 16, 0.0, 100, 4).groupBy("cell").count().collect()
    assert max(r["count"] for r in out) <= 200 and sum(r["count"] for r in out) == 5000


def test_recall_over_many_cells(spark):
    x = clusters(6000, 16, 40, 2)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    want = brute(rows)
    got = run(spark, rows, cell_rows=600, sample_rows=3000)
    assert len(got & want) >= 0.9 * len(want)
    assert len(got & want) >= 0.9 * len(got)


def test_priorities_follow_margins():
    r = np.random.default_rng(0)
    x = r.normal(size=(500, 8)).astype(np.float32)
    tree, parts = k.build_tree(x, 40, r)
    own = k.route(tree, x)
    assert sorted(np.concatenate(parts)) == list(range(500)) and all((own[rows] == leaf).all() for leaf, rows in enumerate(parts))
    p = k.priorities(tree, x)
    assert (p.argmax(1) == own).all() and ((p > 0).sum(1) == 1).all()


def test_search_finds_all_when_it_looks_everywhere():
    x = clusters(700, 12, 30, 4)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, s = k.search(x, 5, trees=3, leaf_size=64, least=10_000, most=10_000)
    full = x @ x.T
    np.fill_diagonal(full, -9)
    assert np.allclose(np.sort(s, 1), np.sort(full, 1)[:, -5:], atol=1e-5)


def crowd(n, dim, seed, noise=0.02):
    r = np.random.default_rng(seed)
    x = r.normal(size=dim) / np.sqrt(dim) + noise * r.normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_rows_beyond_the_cap_are_scored_exactly():
    x = np.concatenate([crowd(3000, 64, 5), clusters(500, 64, 20, 6)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, s = k.search(x, 5, trees=3, leaf_size=32, least=4, most=12, reach=0.055)
    full = x @ x.T
    np.fill_diagonal(full, -9)
    assert np.allclose(np.sort(s[:3000], 1), np.sort(full[:3000], 1)[:, -5:], atol=1e-5)


def test_recall_of_a_crowd_over_many_cells(spark):
    x = np.concatenate([crowd(3000, 16, 8), clusters(3000, 16, 40, 9)])
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    want = {p for p in brute(rows) if p[1] < 3000}
    got = run(spark, rows, cell_rows=150, sample_rows=6000)
    assert len(got & want) >= 0.95 * len(want)


def test_blocks_of_a_crowd_meet(spark, monkeypatch):
    """A crowd of several cells' size stays whole: its blocks meet in pairs, and nothing is lost."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 700)
    x = np.concatenate([crowd(3000, 16, 8), clusters(3000, 16, 40, 9)])
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    want = {p for p in brute(rows) if p[1] < 3000}
    got = run(spark, rows, cell_rows=300, sample_rows=6000)
    assert {p for p in got if p[1] < 3000} == want


def test_crowds_are_found_and_parted():
    x = np.concatenate([crowd(2000, 64, 5), clusters(6000, 64, 20, 6)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = k.find_crowds(x, 500, 0.82, 0.03, np.random.default_rng(0))
    tree, parts = k.build_tree(x, 500, np.random.default_rng(1), tries=16, crowds=found)
    assert tree.crowds == 1 and sorted(parts[0]) == list(range(2000)) and (k.route(tree, x[:2000]) == 0).all()
    assert not k.find_crowds(x[2000:], 500, 0.82, 0.03, np.random.default_rng(0))


def test_means_enter_few_cells_and_keep_neighbours():
    """A margin that grows copies with every level of a tree is needed for rows, not for means of neighbours."""
    x = clusters(8000, 128, 16, 3, noise=0.02)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    full = x @ x.T
    np.fill_diagonal(full, -9)
    near = np.argsort(-full, 1)[:, :5]
    tree, _ = k.build_tree(x, 60, np.random.default_rng(1), tries=16)
    home = k.route(tree, x)
    same = np.where(home[:, None] == home[None, :], full, -9)
    found = np.argsort(-same, 1)[:, :9]
    good = np.take_along_axis(same, found, 1) >= 0.82
    mean = k.smoothed(x, found, good)
    second, _ = k.build_tree(x, 60, np.random.default_rng(2), tries=16)

    def entered(rows, margin):
        into = np.zeros((len(x), second.leaves), bool)
        into[k.close_leaves(second, rows, margin)] = True
        return into.sum(1).mean(), (into[:, None] & into[near]).any(2).mean()

    copies, kept = entered(x, 0.03)
    fewer, kept_too = entered(mean, 0.03 * np.maximum(neighbours.LEAST_MARGIN, 1 / np.sqrt(1 + good.sum(1)))[:, None])
    assert fewer - 1 < 0.3 * (copies - 1) and kept_too > 0.995 and kept_too >= kept - 0.005
