import numpy as np
import pytest

from touchline.llm import embeddings
from touchline.llm.embeddings import links_between, near_duplicate_vectors, quantise


def brute(rows, threshold=0.95):
    ok = {}
    for k, (i, v) in enumerate(rows):
        if v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            ok[k] = np.array(v, np.float32).astype(float)
    near = {k: [] for k in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= threshold:
                near[a].append(b)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, queue = {k}, [k]
        while queue:
            for b in near[queue.pop()]:
                if b not in seen:
                    seen.add(b)
                    queue.append(b)
        c = min((rows[s][0] for s in seen if rows[s][0] is not None), default=None)
        out.append((i, len(near[k]), c, i is not None and i == c))
    return sorted(out, key=str)


@pytest.mark.parametrize("tile", [4096, 16])
def test_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 8))
    rows = []
    for i in range(300):
        v = base[rng.integers(30)] * rng.uniform(0.1, 9) + rng.normal(size=8) * rng.choice([0, 0.1, 0.3])
        rows.append((int(rng.integers(10**6)), v.astype(np.float32).tolist()))
    rows += [rows[0], (5, rows[0][1]), (6, None), (7, []), (8, [0.0] * 8), (9, [None] + [1.0] * 7), (10, [float("nan")] * 8), (11, [float("inf")] + [1.0] * 7)]
    rows += [(12, [1.0, 2.0]), (13, [1.0, 2.0]), (None, [2.0, 4.0])]
    d = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, digest string")
    got = sorted((tuple(r) for r in near_duplicate_vectors(d).collect()), key=str)
    assert got == brute(rows)
    assert near_duplicate_vectors(d.limit(0)).count() == 0


def test_bound_holds():
    rng = np.random.default_rng(1)
    u = rng.normal(size=(200, 64)) * rng.choice([1, 30], size=(200, 64), p=[0.95, 0.05])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    q, s, e = quantise(u)
    approx = (q * s[:, None]) @ (q * s[:, None]).T
    assert (np.abs(approx - u @ u.T) <= e[:, None] + e + e[:, None] * e).all()
    pairs = {(int(i), int(j)) for a, b in links_between(u, u, 0.3, True) for i, j in zip(a, b)}
    assert pairs == {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.3)) if i < j}


def test_bounds_hold_in_many_dimensions_and_at_the_threshold():
    from touchline.llm.embeddings import possible_links

    rng = np.random.default_rng(2)
    for dim in (3, 64, 1024, 5000):
        base = rng.normal(size=(40, dim))
        x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.33]) * rng.uniform(1e-3, 1e3, size=(80, 1))
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        exact = {(int(i), int(j)) for i, j in zip(*np.nonzero(u @ u.T >= 0.95)) if i < j}
        possible = {(int(i), int(j)) for a, b in possible_links(quantise(u), quantise(u), 0.95, True) for i, j in zip(a, b)}
        assert exact <= possible and len(possible) <= len(exact) + 60
        assert {(int(i), int(j)) for a, b in links_between(x, x, 0.95, True) for i, j in zip(a, b)} == exact


def test_huge_and_tiny_components_are_linked(spark):
    rows = [(1, [1e200, 2e200]), (2, [1e-300, 2e-300]), (3, [3.0, 6.0]), (4, [5e-324, 5e-324]), (5, [1.0, 1.0]), (6, [1e308, -1e308])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicate_vectors(d, 0.999).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6)}
