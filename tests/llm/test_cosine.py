"""Near-duplicate vectors over many tiles: against brute force, tiles left out, pairs given up early."""

import numpy as np

from reelbook.llm import cosine
from reelbook.session import stage


def brute(vectors, least=0.95):
    """key -> (n_links, component) of a dictionary of vectors that can link."""
    keys = sorted(vectors)
    unit = np.array([vectors[k] for k in keys], float)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    linked = unit @ unit.T >= least
    np.fill_diagonal(linked, False)
    found, left = {}, set(range(len(keys)))
    while left:
        reached, todo = set(), [min(left)]
        while todo:
            x = todo.pop()
            if x not in reached:
                reached.add(x)
                todo.extend(np.flatnonzero(linked[x]).tolist())
        found |= {keys[x]: (int(linked[x].sum()), keys[min(reached)]) for x in reached}
        left -= reached
    return found


def frame(spark, vectors):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in vectors.items()], "vec_id long, embedding array<double>")


def test_many_tiles_give_what_all_pairs_give(spark, monkeypatch):
    rnd = np.random.default_rng(11)
    around = rnd.normal(size=(40, 24))
    vectors = {i: around[i % 40] + rnd.normal(size=24) * (0.02 if i % 3 else 0.3) for i in range(900)}
    vectors |= {1000 + i: vectors[5] * (i + 1) for i in range(300)}  # one direction: a cell that cannot be cut
    vectors |= {2000 + i: vectors[7] for i in range(20)}
    vectors |= {3000 + i: rnd.normal(size=5) for i in range(150)}
    long = brute({k: v for k, v in vectors.items() if k < 3000})
    want = long | brute({k: v for k, v in vectors.items() if k >= 3000})
    assert sum(n for n, _ in long.values()) > 10_000
    monkeypatch.setattr(cosine, "TILE", 70)
    rows = frame(spark, vectors)
    for source in (rows, rows.repartition(5)):
        found = {r["vec_id"]: tuple(r)[1:] for r in cosine.near_duplicate_vectors(source).collect()}
        assert found == {k: (n, c, k == c) for k, (n, c) in want.items()}


def test_pairs_at_the_threshold_and_strips(spark):
    rnd = np.random.default_rng(12)
    unit = lambda x: x / np.sqrt((x * x).sum(axis=-1, keepdims=True))
    one = unit(rnd.normal(size=(700, 32)))
    side = rnd.normal(size=one.shape)
    side = unit(side - (side * one).sum(axis=1, keepdims=True) * one)
    aimed = 0.95 + np.linspace(-3e-7, 3e-7, 700)[:, None]  # nearer than single precision tells apart
    vectors = {2 * i: v for i, v in enumerate(one)} | {2 * i + 1: v for i, v in enumerate(aimed * one + np.sqrt(1 - aimed**2) * side)}
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cosine.near_duplicate_vectors(frame(spark, vectors)).collect()}
    assert found == brute(vectors)
    assert {n for n, _ in found.values()} == {0, 1}


def test_tiles_apart_on_any_axis_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(cosine, "TILE", 64)
    rnd = np.random.default_rng(13)
    around = np.eye(24)[:16]  # every direction has the same variance, so the first axis tells few of them apart
    vectors = {i: around[i % 16] + 0.01 * rnd.normal(size=24) for i in range(1600)}
    own = frame(spark, vectors).selectExpr("vec_id as node", "1L as m", "embedding as vector")
    axes, shares, n = cosine.principal_axes(own, 24)
    leading = cosine.leading_axes(shares, 0.95)
    tiles = stage(cosine.tile_files(own, cosine.cells_of(own, axes, leading, n), axes, leading), "tiles")
    count = tiles.count()
    assert count >= 20
    compared = cosine._near_tiles(tiles, 0.95, leading).selectExpr("sum(size(others))").first()[0]
    assert compared <= count * (count + 1) / 2 / 3


def test_leading_axes_give_up_nearly_all_pairs():
    rnd = np.random.default_rng(14)
    unit = rnd.normal(size=(3000, 64))
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    shares, axes = np.linalg.eigh(unit.T @ unit / len(unit))
    shares, axes = shares[::-1], axes[:, ::-1]

    def left(leading):
        near = cosine.coordinates(unit, axes, leading)
        assert (near.astype(float) @ near.T.astype(float) >= unit @ unit.T - cosine.room(leading)).all()
        return (near @ near.T >= 0.95).mean()

    leading = cosine.leading_axes(shares, 0.95)
    assert leading < 24 and left(leading) < 0.002
    assert left(8) > 0.02  # eight axes are too few


def test_roots_of_chains():
    rnd = np.random.default_rng(15)
    line = rnd.permutation(2000)
    root = np.arange(2100)
    for part in np.array_split(rnd.permutation(1999), 7):
        root = cosine.join_roots(root, line[part], line[part + 1])
    assert (root[:2000] == 0).all() and (root[2000:] == np.arange(2000, 2100)).all()
