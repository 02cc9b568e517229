"""Context-mixing model of a region's newest block grid, cell by cell, over a binary arithmetic coder.

The grid holds ranks: atoms by falling count. Each section of 16 x 16 x 16 cells is uniform (its rank is listed) or has a
palette. In a section with a palette a cell is first asked whether it is the vote of its nearest neighbours, by ten
mixed contexts; if not, whether it is one of the other neighbours, one by one; if not, its place in the
palette is told bit by bit through a tree that leaves out what it can't be. Every chance adapts as it is used, so
encoder and decoder run the same code: code(chance, bit) writes the bit, or ignores it and gives the one that was read.

A region is one unit of work (about 300 MB for a grid of 24 sections); regions spread over tasks. Cells of sections with
a palette are sequential Python, 20 to 50 microseconds each.

Defined cases: cells without a snapshot, and beyond a snapshot's words, are atom 0; a cut or inconsistent payload is a ValueError.
The order of a section's palette is stored, so any order decodes; this writer's is by rank.
"""

from __future__ import annotations

import struct
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from operator import mul

import numpy as np

from .entropy import BitDecoder, BitEncoder

#: Cells along a region's side and a section's edge, rank of a neighbour outside, the payload's mode.
SIDE, EDGE, NOTHING, MODE = 512, 16, 0xFFFF, 1
#: Fixed values: (dx, dy, dz) of the causal neighbours; the first nine vote, with these weights.
REACH = ((-1, 0, 0), (0, -1, 0), (0, 0, -1), (-1, 0, -1), (-1, -1, 0), (0, -1, -1), (-1, -1, -1), (1, -1, 0), (1, -1, -1), (-2, 0, 0), (0, 0, -2), (0, -2, 0))
VOTES = (3, 3, 3, 2, 2, 2, 2, 1, 1)
#: Multipliers of the nine voters in neighbourhood hashes, and the two multipliers of a hash step.
DIRECTIONS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB27)
STEP, FINISH = 0x9E3779B1, 0x85EBCA6B
#: Seeds of the hashes over all voters forward and backward, and (seed, neighbours) of the other four.
FORWARD, BACKWARD = 0x1F123BB5, 0x2B7E1516
FAR, DIAGONAL, AXIAL, PAIR = (0x9E3779B9, (9, 10, 11)), (0x85EBCA6B, (3, 6, 7)), (0xC2B2AE35, (0, 1, 2)), (0x27D4EB2F, (1, 2))
#: The sigmoid at every 128th logit from -2048, chances of 4096, start and bound of weights.
SIGMOID = (
    1, 2, 3, 6, 10, 16, 27, 45, 73, 120, 194, 310, 488, 747, 1101, 1546, 2047, 2549, 2994, 3348, 3607, 3785, 3901, 3975, 4024, 4050,
    4068, 4079, 4085, 4089, 4092, 4093, 4094,
)
HALF, MOST, UNIT, HEAVIEST = 2048, 4095, 1 << 16, 1 << 20
#: How slowly a chance moves after so many uses; it stays at the last.
RATES = (2,) * 3 + (3,) * 6 + (4,) * 12 + (5,) * 9
#: Bits of the table sizes of head, chain and height contexts; longest run; deepest palette; most entries.
HEAD_BITS, CHAIN_BITS, HEIGHT_BITS, LONGEST_RUN, DEEPEST, MOST_ENTRIES = 18, 16, 12, 255, 16, 4096
_WORD = 0xFFFFFFFF
#: A section's window has two cells before it along each axis and one after it along x.
_Z, _Y = EDGE + 3, (EDGE + 3) * (EDGE + 2)
_OFFSETS = tuple(dx + _Z * dz + _Y * dy for dx, dy, dz in REACH)


def _squash(logit: int) -> int:
    at, part = (logit >> 7) + 16, logit & 127
    return (SIGMOID[at] * (128 - part) + SIGMOID[at + 1] * part + 64) >> 7


_SQUASHED = [_squash(v) for v in range(-2047, 2048)]
#: Chance to logit: the smallest that squashes to it or more.
STRETCH = [-2047, *(np.minimum(np.searchsorted(_SQUASHED, np.arange(1, MOST)), 4094) - 2047).tolist(), 2047]


def squash(logit: int) -> int:
    return MOST if logit > 2047 else 1 if logit < -2047 else _SQUASHED[logit + 2047]


def mix(weights: list[int], logits: list[int]) -> int:
    return squash(sum(map(mul, weights, logits)) >> 16)


def reweigh(weights: list[int], logits: list[int], bit: int, chance: int) -> None:
    error = (bit << 12) - chance
    weights[:] = [min(max(w + (error * s >> 13), -HEAVIEST), HEAVIEST) for w, s in zip(weights, logits, strict=True)]


class Chances:
    """Chances of a 1 with a count of uses each; the more uses, the slower they move."""

    def __init__(self, size: int) -> None:
        self.of, self.uses = array("H", [HALF]) * size, bytearray(size)

    def learn(self, at: int, bit: int) -> None:
        now, uses = self.of[at], self.uses[at]
        self.of[at] = now + (((MOST if bit else 0) - now) >> RATES[uses])
        self.uses[at] = min(uses + 1, len(RATES) - 1)


def fold(seed: int, values: Iterator[int] | tuple[int, ...]) -> int:
    for v in values:
        mixed = (seed ^ v * STEP) & _WORD
        seed = ((mixed << 7 | mixed >> 25) & _WORD) * FINISH & _WORD
    return seed


def vote(near: tuple[int, ...], members: dict[int, int]) -> tuple[int, int]:
    """The voters' choice and which of them agree with it (bit k: voter k).

    Members of the palette come first. The most votes win, then the choice whose last voter comes earliest, then the one that is first.
    """
    for fits in (members.__contains__, lambda _: True):
        best, choice = (0, 0), None
        for v in dict.fromkeys(near[: len(VOTES)]):
            if v == NOTHING or not fits(v):
                continue
            mask = sum(1 << k for k in range(len(VOTES)) if near[k] == v)
            weight = sum(w for k, w in enumerate(VOTES) if mask >> k & 1), -mask.bit_length()
            if choice is None or weight > best:
                best, choice = weight, (v, mask)
        if choice:
            return choice
    return NOTHING, (1 << len(VOTES)) - 1


def mismatches(near: tuple[int, ...], value: int) -> int:
    """Band of the number of voters that differ: 0, 1, 2 to 3, more."""
    n = sum(v != NOTHING and v != value for v in near[: len(VOTES)])
    return (0, 1, 2, 2)[n] if n < 4 else 3


class Model:
    """Codes sections in order. code(chance, bit): see the module."""

    def __init__(self, shape: tuple[int, int, int], code: Callable[[int, int], int]) -> None:
        self.code, self.run, self.missed = code, 0, np.zeros(shape, np.uint8)
        self.heads = [array("H", [HALF]) * (1 << HEAD_BITS) for _ in range(10)]
        self.chains = [Chances(1 << CHAIN_BITS) for _ in REACH]
        self.pointers = Chances((DEEPEST + 1) * 4)
        self.nodes = Chances(1 << HEAD_BITS), Chances(1 << HEAD_BITS), Chances(1 << HEIGHT_BITS), Chances(6 * DEEPEST)
        self.head_weights = defaultdict(lambda: [UNIT // 10] * 10)
        self.node_weights = defaultdict(lambda: [UNIT // 4] * 4)

    def section(self, grid: np.ndarray, slot: int, section: int, palette: list[int], known: bool) -> None:
        """Code one section of grid[y, z, x]; if not known, its cells are filled in."""
        origin = section_origin(slot, section)
        cells, missed = _window(grid, origin, NOTHING), _window(self.missed, origin, 0)
        members, depth = {v: i for i, v in enumerate(palette)}, (len(palette) - 1).bit_length()
        seen: dict[tuple[int, ...], tuple] = {}
        for y in range(2, EDGE + 2):
            for z in range(2, EDGE + 2):
                first = y * _Y + z * _Z + 2
                for at in range(first, first + EDGE):
                    near = tuple([cells[at + o] for o in _OFFSETS])
                    head = seen.get(near) or seen.setdefault(near, _head(near, members, section, depth))
                    truth = cells[at] if known else NOTHING
                    cells[at] = self._cell(head, near, truth, at, missed, members, palette, depth, section)
        for target, window in ((grid, cells), (self.missed, missed)):
            target[_tile(origin)] = np.array(window, target.dtype).reshape(EDGE + 2, EDGE + 2, EDGE + 3)[2:, 2:, 2:-1]

    def _cell(self, head, near, truth, at, missed, members, palette, depth, section) -> int:
        value, mask, spread, contexts, row = head
        hit = 0
        if value == NOTHING or value in members:
            contexts[3] = mask << 8 | self.run
            found = [table[c] for table, c in zip(self.heads, contexts, strict=True)]
            logits = [STRETCH[p] for p in found]
            cluster = missed[at - 1] | missed[at - _Y] << 1 | missed[at - _Z] << 2
            weights = self.head_weights[row, cluster]
            chance = mix(weights, logits)
            hit = self.code(chance, int(truth == value))
            aim = MOST if hit else 0
            for table, c, p in zip(self.heads, contexts, found, strict=True):
                table[c] = p + ((aim - p) >> 4)
            reweigh(weights, logits, hit, chance)
        self.run = min(self.run + 1, LONGEST_RUN) if hit else 0
        missed[at] = 1 - hit
        return value if hit else self._other(near, value, mask, spread, truth, members, palette, depth, section)

    def _other(self, near, value, mask, spread, truth, members, palette, depth, section) -> int:
        """A cell that isn't the vote: another neighbour, or told by the palette's tree."""
        others: dict[int, int] = {}
        for k, v in enumerate(near):
            if v != value and v in members:
                others.setdefault(v, k)
        for entry, (v, k) in enumerate(others.items()):
            if len(others) == 1:
                table, c = self.pointers, depth * 4 + (0 if k < 3 else 1 if k < 7 else 2 if k < 9 else 3)
            else:
                table, c = self.chains[k], fold(v, (entry | mask << 8,)) & ((1 << CHAIN_BITS) - 1)
            bit = self.code(table.of[c], int(truth == v))
            table.learn(c, bit)
            if bit:
                return v
        gone = [members[v] for v in (value, *others) if v in members]
        return self._told(members.get(truth, 0), gone, len(palette), depth, spread, section, palette)

    def _told(self, wanted, gone, size, depth, spread, section, palette) -> int:
        low = 0  # all entries from low up to low + 2 << place are still possible, but for those that are gone
        for place in range(depth - 1, -1, -1):
            node, high = low | 1 << place, min(low + (2 << place), size)
            above = max(high - node, 0) - sum(node <= g < high for g in gone)
            below = min(node, high) - low - sum(low <= g < min(node, high) for g in gone)
            if not above:
                continue
            if not below:
                low = node
                continue
            # Bands of the smaller side: 1, 2, to 4, to 8, to 16, more.
            band = min((min(above, below) - 1).bit_length(), 5)
            at = (fold(spread, (node,)) & ((1 << HEAD_BITS) - 1), node | place << 13, fold(section, (node,)) & ((1 << HEIGHT_BITS) - 1), band * DEEPEST + place)
            logits = [STRETCH[t.of[c]] for t, c in zip(self.nodes, at, strict=True)]
            weights = self.node_weights[depth]
            chance = mix(weights, logits)
            bit = self.code(chance, wanted >> place & 1)
            for t, c in zip(self.nodes, at, strict=True):
                t.learn(c, bit)
            reweigh(weights, logits, bit, chance)
            low |= bit << place
        if low >= size:
            raise ValueError(f"entry {low} is beyond a section's palette of {size}")
        return palette[low]


def _head(near: tuple[int, ...], members: dict[int, int], section: int, depth: int) -> tuple:
    """The vote, its mask, the neighbourhood's hash, ten contexts (the fourth is the run's, filled in later) and the row of weights."""
    value, mask = vote(near, members)
    spun = [v * d & _WORD for v, d in zip(near, DIRECTIONS, strict=False)]
    ahead, back = fold(FORWARD, (*spun, value)), fold(BACKWARD, (*spun[::-1], value))
    far, diagonal, axial, pair = (fold(seed, (*(near[k] for k in of), value)) for seed, of in (FAR, DIAGONAL, AXIAL, PAIR))
    hashes = (ahead, back, far, 0, fold(value, (mask << 1,)), fold(ahead, (value * 3,)), section << 5 | depth, diagonal, axial, pair)
    confidence = min(sum(w for k, w in enumerate(VOTES) if mask >> k & 1) // 3, 7)
    return value, mask, ahead, [h & ((1 << HEAD_BITS) - 1) for h in hashes], (depth, mismatches(near, value), confidence)


def section_origin(slot: int, section: int) -> tuple[int, int, int]:
    """y, z, x of a section's first cell; slots run along z first."""
    return section * EDGE, slot % (SIDE // EDGE) * EDGE, slot // (SIDE // EDGE) * EDGE


def _tile(origin: tuple[int, int, int]) -> tuple[slice, ...]:
    return tuple(slice(o, o + EDGE) for o in origin)


def tile(grid: np.ndarray, atoms: np.ndarray, slot: int, section: int) -> np.ndarray:
    """A section's atoms in the order of its cells."""
    return atoms[grid[_tile(section_origin(slot, section))].ravel()]


def _window(grid: np.ndarray, origin: tuple[int, int, int], outside: int) -> list[int]:
    """The section with the cells that its own can have as causal neighbours; outside elsewhere."""
    out = np.full((EDGE + 2, EDGE + 2, EDGE + 3), outside, np.int64)
    y, z, x = origin
    a, b, c = (min(2, o) for o in origin)
    out[2 - a :, 2 - b :, 2 - c : EDGE + 2] = grid[y - a : y + EDGE, z - b : z + EDGE, x - c : x + EDGE]
    if y and x + EDGE < SIDE:  # the next section along x is coded in the layer below only
        out[1, 2 - b :, -1] = grid[y - 1, z - b : z + EDGE, x + EDGE]
    return out.ravel().tolist()


def order(sections: int) -> Iterator[tuple[int, int]]:
    """(slot, section) as they are coded: by section, then z, then x."""
    per = SIDE // EDGE
    return ((x * per + z, s) for s in range(sections) for z in range(per) for x in range(per))


def ranked_grid(tiles: dict[tuple[int, int], np.ndarray | int], sections: int) -> tuple[np.ndarray, np.ndarray]:
    """(ranks[y, z, x], atoms by rank) of tiles (slot, section) -> atoms or the one atom; gaps are atom 0."""
    grid = np.zeros((sections * EDGE, SIDE, SIDE), np.uint16)
    for (slot, section), atoms in tiles.items():
        grid[_tile(section_origin(slot, section))] = atoms if np.isscalar(atoms) else np.asarray(atoms, np.uint16).reshape(EDGE, EDGE, EDGE)
    counts = np.zeros(1 << 16, np.int64)
    for layer in grid:  # layer by layer, so that no wider copy of the whole grid is made
        counts += np.bincount(layer.ravel(), minlength=1 << 16)
    atoms = np.flatnonzero(counts)
    atoms = atoms[np.lexsort((atoms, -counts[atoms]))]
    rank = np.zeros(1 << 16, np.uint16)
    rank[atoms] = np.arange(len(atoms))
    for layer in grid:
        layer[:] = rank[layer]
    return grid, atoms


def encode(tiles: dict[tuple[int, int], np.ndarray | int], sections: int) -> bytes:
    grid, atoms = ranked_grid(tiles, sections)
    coder = BitEncoder()

    def code(chance: int, bit: int) -> int:
        coder.encode(chance, bit)
        return bit

    model, depths, uniform, palettes = Model(grid.shape, code), bytearray(), [], []
    for slot, section in order(sections):
        used = np.unique(grid[_tile(section_origin(slot, section))])
        if len(used) == 1:
            depths.append(0)
            uniform.append(int(used[0]))
            continue
        palette = used.tolist()
        depths.append((len(palette) - 1).bit_length())
        palettes += [len(palette), *palette]
        model.section(grid, slot, section, palette, known=True)
    short = lambda v: struct.pack(f"<{len(v)}H", *v)
    side = bytes(depths), short(uniform), short(palettes)
    head = struct.pack("<QBI", grid.size, MODE, len(atoms)) + short(atoms.tolist()) + struct.pack("<3Q", *map(len, side))
    return head + b"".join(side) + coder.finish()


def decode(payload: bytes, sections: int) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, int], int]]:
    """(ranks[y, z, x], atoms by rank, ranks of uniform sections)."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if n > len(payload) - at:
            raise ValueError(f"the grid needs {n} bytes at {at} of {len(payload)}")
        at += n
        return payload[at - n : at]

    cells, mode, n = struct.unpack("<QBI", take(13))
    shape = sections * EDGE, SIDE, SIDE
    if cells != shape[0] * SIDE * SIDE or mode != MODE:
        raise ValueError(f"a grid of {cells} cells in mode {mode}")
    shorts = lambda n: np.frombuffer(take(n)[: n // 2 * 2], "<u2").tolist()
    atoms = np.array(shorts(2 * n), np.int64)
    sizes = struct.unpack("<3Q", take(24))
    depths, uniform, palettes = iter(take(sizes[0])), iter(shorts(sizes[1])), iter(shorts(sizes[2]))
    coder = BitDecoder(payload[at:])
    grid, same = np.zeros(shape, np.uint16), {}
    model = Model(shape, lambda chance, _: coder.decode(chance))
    try:
        for slot, section in order(sections):
            depth = next(depths)
            if not depth:
                rank = same[slot, section] = next(uniform)
                if rank >= n:
                    raise ValueError(f"rank {rank} of {n}")
                grid[_tile(section_origin(slot, section))] = rank
                continue
            size = next(palettes)
            if depth > DEEPEST or not 2 <= size <= MOST_ENTRIES or (size - 1).bit_length() != depth:
                raise ValueError(f"a palette of {size} has no depth {depth}")
            palette = [next(palettes) for _ in range(size)]
            if max(palette) >= n:
                raise ValueError(f"rank {max(palette)} of {n}")
            model.section(grid, slot, section, palette, known=False)
    except (StopIteration, RuntimeError) as e:
        raise ValueError("the grid's streams are too short") from e
    return grid, atoms, same
