"""The context-mixing model of the newest grid, and columnar files that hold one."""

from dataclasses import replace

import numpy as np
import pytest
from test_regions import COLUMNAR, sample

from gridlore.functions import newest_grid as ng
from gridlore.functions import regions as rg

MODELLED = replace(COLUMNAR, modelled=True)


def tiles(seed: int) -> dict:
    rng, out = np.random.default_rng(seed), {}
    for slot in (0, 1, 32, 33, 31, 63, 991, 1023):
        for section in (0, 1):
            kind = rng.integers(0, 5)
            layers, noise = np.arange(4096) // 256, rng.integers(0, 4096, 4096)
            out[slot, section] = (7, layers % 3, np.where(noise < 200, noise % 50, layers), noise % 300, noise)[kind]
    return out


@pytest.mark.parametrize("seed", [0, 3])
def test_grid_round_trip(seed):
    made = tiles(seed)
    grid, atoms, same = ng.decode(ng.encode(made, 2), 2)
    want = np.zeros((32, 512, 512), np.int64)
    for (slot, section), cells in made.items():
        y, z, x = section * 16, slot % 32 * 16, slot // 32 * 16
        want[y : y + 16, z : z + 16, x : x + 16] = cells if np.isscalar(cells) else cells.reshape(16, 16, 16)
    assert np.array_equal(atoms[grid], want)
    counts = np.bincount(want.ravel())
    assert atoms.tolist() == sorted(np.flatnonzero(counts).tolist(), key=lambda a: (-counts[a], a))
    flat = {(slot, s) for slot in range(1024) for s in (0, 1)} - {k for k, v in made.items() if not np.isscalar(v) and len(set(v.tolist())) > 1}
    assert same.keys() == flat


def test_regular_grids_shrink():
    layers = {(slot, 0): np.arange(4096) // 256 for slot in (0, 1, 2, 32, 33, 34)}
    noise = {key: np.random.default_rng(key).integers(0, 16, 4096) for key in layers}
    side = len(ng.encode(dict.fromkeys(layers, 0), 1))
    assert len(ng.encode(layers, 1)) - side < 1200 < 6 * 2048 < len(ng.encode(noise, 1)) - side + 400


def test_a_cell_that_starts_a_grid_costs_its_tree():
    """Two ranks, the second in the first cell only: by hand, no neighbour votes, and the one entry left after the vote is free."""
    cells = np.zeros(4096, np.int64)
    cells[0] = 5
    bits = []

    def code(chance, bit):
        bits.append((chance, bit))
        return bit

    grid, _ = ng.ranked_grid({(0, 0): cells}, 1)
    ng.Model(grid.shape, code).section(grid, 0, 0, [0, 1], known=True)
    # Cell 0: no vote, a miss at an even chance; then one bit of the tree. Cell 1: the vote is rank 1, a miss; nothing else is left.
    assert bits[0] == (2047, 0) and bits[1][1] == 1 and bits[2][1] == 0 and bits[3][1] == 1
    assert sum(b == 0 for _, b in bits) < 12


def plain_vote(near, members):
    """Votes counted value by value."""
    for some in ([v for v in near[:9] if v in members], near[:9]):
        scores = {}
        for v in some:
            if v != ng.NOTHING:
                where = [k for k in range(9) if near[k] == v]
                scores[v] = (sum((3, 3, 3, 2, 2, 2, 2, 1, 1)[k] for k in where), -where[-1], -where[0])
        if scores:
            return max(scores, key=scores.get)
    return ng.NOTHING


def test_vote():
    rng = np.random.default_rng(2)
    for _ in range(400):
        near = tuple(rng.choice([1, 2, 3, 4, ng.NOTHING], 12).tolist())
        members = dict.fromkeys(rng.choice(5, 2).tolist(), 0)
        value, mask = ng.vote(near, members)
        assert value == plain_vote(near, members)
        if value != ng.NOTHING:
            assert mask == sum(1 << k for k in range(9) if near[k] == value)
    assert ng.vote((ng.NOTHING,) * 12, {1: 0}) == (ng.NOTHING, 511)


def test_tables():
    assert [ng.squash(v) for v in (-3000, -2047, 0, 2047, 3000)] == [1, 1, 2047, 4094, 4095]
    assert all(ng.squash(ng.STRETCH[p]) >= p and (ng.STRETCH[p] == -2047 or ng.squash(ng.STRETCH[p] - 1) < p) for p in range(2, 4095))
    chances = ng.Chances(1)
    for _ in range(40):
        chances.learn(0, 1)
    assert chances.uses[0] == 29 and 3900 < chances.of[0] < 4096


def test_window_holds_causal_neighbours_only():
    grid = np.arange(32 * 512 * 512, dtype=np.uint32).reshape(32, 512, 512)
    w = np.array(ng._window(grid, (16, 16, 16), ng.NOTHING)).reshape(18, 18, 19)
    assert w[2, 2, 2] == grid[16, 16, 16] and w[0, 0, 0] == grid[14, 14, 14]
    assert w[1, 1, 18] == grid[15, 15, 32] and (w[2:, :, 18] == ng.NOTHING).all()
    corner = np.array(ng._window(grid, (0, 0, 496), ng.NOTHING)).reshape(18, 18, 19)
    assert (corner[:2] == ng.NOTHING).all() and (corner[:, :2] == ng.NOTHING).all() and (corner[:, :, 18] == ng.NOTHING).all()


def test_modelled_files():
    region = sample()
    data = MODELLED.encode(region)
    assert rg.equal(COLUMNAR.decode(data), region) and MODELLED.encode(COLUMNAR.decode(data)) == data
    assert len(data) != len(COLUMNAR.encode(region))
    empty = rg.Region(0, 1)
    assert rg.equal(COLUMNAR.decode(MODELLED.encode(empty)), empty)


def test_short_words_are_atom_zero():
    short = rg.Snapshot(1, None, (5, 6), rg.pack_words(np.ones(64), 1))
    cells = rg.newest_atoms(short)
    assert cells[:64].tolist() == [6] * 64 and not cells[64:].any()
    assert rg.newest_atoms(rg.Snapshot(1, 9)) == 9 and rg.newest_atoms(rg.Snapshot(1, None, (3,), b"")) == 0


def test_refused_grids():
    payload = ng.encode({(0, 0): np.arange(4096) % 5}, 1)
    for bad in (payload[:10], payload[:20], b"\1" + payload[1:], payload[:8] + b"\2" + payload[9:], payload[:-40] if len(payload) < 60 else payload[:60]):
        with pytest.raises(ValueError):
            ng.decode(bad, 1)
    with pytest.raises(ValueError):
        ng.decode(payload, 2)
