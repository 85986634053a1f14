import numpy as np

from quarry.operators import dense


def test_nearest_in_tiles_equals_whole_product(monkeypatch):
    rng = np.random.default_rng(5)
    v = np.repeat(rng.integers(-2, 3, (70, 3)), 2, axis=0).astype(float)  # many ties
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1)
    ids = rng.permutation(140)
    whole = dense.nearest(ids, v, ids, v, 7)
    monkeypatch.setattr(dense, "TILE", 50)
    tiled = dense.nearest(ids, v, ids, v, 7)
    key = np.round(1 - v @ v.T, 10)
    want = {(ids[i], ids[j]) for i in range(140) for j in np.lexsort((ids, key[i]))[:7]}
    assert {*zip(whole["query_id"], whole["owner_id"])} == {*zip(tiled["query_id"], tiled["owner_id"])} == want


def test_a_block_never_holds_its_whole_product(monkeypatch):
    import tracemalloc

    x = np.random.default_rng(1).normal(size=(4_000, 8))
    tracemalloc.start()
    dense.nearest(np.arange(4_000), x, np.arange(4_000), x, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4_000 * 4_000 * 8 * 1.2  # six arrays of this size before
