"""Entropy coders over byte strings: a byte coder with a frequency table, and a binary coder with given chances.

Both run along one value from end to end. The byte coder is Python over one value at a time. The binary coder with adaptive
chances takes many values side by side, a bit of each in one step of numpy, and gives the same code as one at a time; Spark
spreads the values, those of about one length together. Defined cases: no bytes encode to a state alone and decode to no
bytes; null stays null.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a frequency table's total, and the byte coder's lowest state.
PRECISION, LOWEST = 12, 1 << 23
TOTAL = 1 << PRECISION
#: The binary coder keeps chances within these, of 4096.
LEAST_CHANCE, MOST_CHANCE = 1, 4094
_WORD = 0xFFFFFFFF


def frequencies(data: bytes) -> np.ndarray:
    """256 counts scaled to sum TOTAL; see scaled()."""
    return scaled(np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.int64))


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum TOTAL, at least 1 for each that isn't 0. What scaling down leaves over goes to the commonest
    byte; what rounding up took too much comes off the largest entries; ties: the highest byte. No counts stay none."""
    if not counts.any():
        return counts
    out = np.where(counts > 0, np.maximum(counts * TOTAL // counts.sum(), 1), 0)
    last_largest = lambda v: 255 - int(np.argmax(v[::-1]))
    out[last_largest(counts)] += max(TOTAL - int(out.sum()), 0)
    for _ in range(int(out.sum()) - TOTAL):
        out[last_largest(out)] -= 1
    return out


def byte_counts(rows: DataFrame, text: str) -> DataFrame:
    """(byte, n) of all texts: counted a batch at a time, at most 256 rows leave a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            column = batch.column(0)
            for at in range(0, len(column), 256):
                some = column.slice(at, 256).drop_null().cast(pa.large_binary())
                total += np.bincount(np.frombuffer(b"".join(some.to_pylist()), np.uint8), minlength=256)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["byte", "n"])

    return rows.select(text).mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))


def byte_table(rows: DataFrame, text: str) -> DataFrame:
    """(byte, n, freq, start): the whole frequency table of all texts; at most 256 rows come to the driver for it."""
    counts = np.zeros(256, np.int64)
    for r in byte_counts(rows, text).collect():
        counts[r["byte"]] = r["n"]
    freq = scaled(counts)
    made = [(int(b), int(counts[b]), int(freq[b]), int(starts(freq)[b])) for b in np.flatnonzero(counts)]
    return rows.sparkSession.createDataFrame(made, "byte int, n long, freq int, start long")


def starts(freq: np.ndarray) -> np.ndarray:
    """Exclusive running sums."""
    return np.cumsum(freq) - freq


def encode_bytes(data: bytes, freq: np.ndarray) -> bytes:
    """Last byte first, so that decoding runs forward; the final state leads, big-endian."""
    f, s = freq.tolist(), starts(freq).tolist()
    full = [(LOWEST >> PRECISION << 8) * n for n in f]
    state, spilled = LOWEST, bytearray()
    for b in reversed(data):
        while state >= full[b]:
            spilled.append(state & 255)
            state >>= 8
        high, low = divmod(state, f[b])
        state = (high << PRECISION) + low + s[b]
    return struct.pack(">I", state) + spilled[::-1]


def decode_bytes(code: bytes, n: int, freq: np.ndarray) -> bytes:
    if len(code) < 4:
        raise ValueError("a code has at least 4 bytes")
    f, s = freq.tolist(), starts(freq).tolist()
    symbols = np.repeat(np.arange(256, dtype=np.uint8), freq).tolist()
    state, at, out = struct.unpack_from(">I", code)[0], 4, bytearray()
    for _ in range(n):
        slot = state & (TOTAL - 1)
        b = symbols[slot]
        out.append(b)
        state = f[b] * (state >> PRECISION) + slot - s[b]
        while state < LOWEST:
            state = state << 8 | (code[at] if at < len(code) else 0)
            at += 1
    return bytes(out)


class _Interval:
    """The part [low, high] of 32-bit space that the bits so far leave."""

    def __init__(self) -> None:
        self.low, self.high = 0, _WORD

    def split(self, chance: int) -> int:
        return self.low + ((self.high - self.low) * min(max(chance, LEAST_CHANCE), MOST_CHANCE) >> PRECISION)

    def take(self, bit: int, middle: int) -> None:
        if bit:
            self.high = middle
        else:
            self.low = middle + 1

    def settled(self) -> bool:
        return self.low >> 24 == self.high >> 24

    def shift(self) -> int:
        top = self.high >> 24
        self.low, self.high = self.low << 8 & _WORD, (self.high << 8 & _WORD) | 255
        return top


class BitEncoder(_Interval):
    """encode(chance of a 1, of 4096; bit), then finish()."""

    def __init__(self) -> None:
        super().__init__()
        self.out = bytearray()

    def encode(self, chance: int, bit: int) -> None:
        self.take(bit, self.split(chance))
        while self.settled():
            self.out.append(self.shift())

    def finish(self) -> bytes:
        return bytes(self.out) + struct.pack(">I", self.low)


class BitDecoder(_Interval):
    """decode(chance) gives the bits back. Past the code's end its first word reads as 0 bytes, later ones as 255."""

    def __init__(self, code: bytes) -> None:
        super().__init__()
        self.code, self.at = code, 4
        self.word = int.from_bytes(code[:4].ljust(4, b"\0"), "big")

    def decode(self, chance: int) -> int:
        middle = self.split(chance)
        bit = int(self.word <= middle)
        self.take(bit, middle)
        while self.settled():
            self.shift()
            self.word = (self.word << 8 & _WORD) | (self.code[self.at] if self.at < len(self.code) else 255)
            self.at += 1
        return bit


#: Fixed value: the chance that an adaptive coder starts with.
_EVEN = TOTAL // 2
#: The chance after a bit, by 4096 * bit + the chance before: it moves by a thirty-second.
_AFTER = np.array([c + (((TOTAL - 1) * bit - c) >> 5) for bit in (0, 1) for c in range(TOTAL)], np.uint16)
_AFTER_0, _AFTER_1 = _AFTER[:TOTAL].tolist(), _AFTER[TOTAL:].tolist()


def encode_adaptive(data: bytes) -> bytes:
    """Each bit of a byte by the chance that its forerunners in the byte have given it in this value so far."""
    return _encode_rest(data, [_EVEN] * 256, 0, _WORD, bytearray())


def _encode_rest(data: bytes, chances: list[int], low: int, high: int, out: bytearray) -> bytes:
    """BitEncoder over the bits of the bytes, from a state between two bytes; its loops are written out as calls cost more than they do."""
    for b in data:
        node = 1
        b |= 256
        for k in (7, 6, 5, 4, 3, 2, 1, 0):
            chance = chances[node]
            middle = low + ((high - low) * (chance or LEAST_CHANCE) >> PRECISION)
            if b >> k & 1:
                high = middle
                chances[node] = _AFTER_1[chance]
            else:
                low = middle + 1
                chances[node] = _AFTER_0[chance]
            node = b >> k
            while (low ^ high) < 1 << 24:
                out.append(high >> 24)
                low, high = low << 8 & _WORD, (high << 8 & _WORD) | 255
    return bytes(out) + struct.pack(">I", low)


def decode_adaptive(code: bytes, n: int) -> bytes:
    return _decode_rest(code, 4, n, [_EVEN] * 256, 0, _WORD, int.from_bytes(code[:4].ljust(4, b"\0"), "big"))


def _decode_rest(code: bytes, at: int, n: int, chances: list[int], low: int, high: int, word: int) -> bytes:
    """BitDecoder of n bytes, from a state between two bytes."""
    out, end = bytearray(), len(code)
    for _ in range(n):
        node = 1
        while node < 256:
            chance = chances[node]
            middle = low + ((high - low) * (chance or LEAST_CHANCE) >> PRECISION)
            if word <= middle:
                high = middle
                chances[node] = _AFTER_1[chance]
                node = node << 1 | 1
            else:
                low = middle + 1
                chances[node] = _AFTER_0[chance]
                node <<= 1
            while (low ^ high) < 1 << 24:
                low, high = low << 8 & _WORD, (high << 8 & _WORD) | 255
                word = (word << 8 & _WORD) | (code[at] if at < end else 255)
                at += 1
        out.append(node & 255)
    return bytes(out)


#: Values that are coded side by side, and below how many of them one by one is cheaper.
LANES, FEWEST_LANES = 8192, 64
#: Bytes between two looks at the lanes' output, and the output's width: 8 bits shift at most 32 bytes out.
_STRIDE, _WIDTH = 16, 1024
_BYTES = np.arange(256)
#: By depth and byte: the node that a bit is asked at, -1 for a 1, and what the chance moves to.
_NODES = np.array([(_BYTES | 256) >> k for k in range(8, 0, -1)])
_ONES = np.array([-(_BYTES >> k & 1) for k in range(7, -1, -1)])
_AIMS = (_ONES & TOTAL - 1).astype(np.int16)


def _grouped(lengths: list[int]) -> Iterator[np.ndarray]:
    """Places of values of about one length, longest first."""
    order = np.argsort(-np.array(lengths, np.int64), kind="stable")
    for at in range(0, len(order), LANES):
        yield order[at : at + LANES]


class _Lanes:
    """Adaptive coders of several values side by side, longest first; those in use are always the first ones.

    The interval is [low, low + width]. Chances lie by node, then lane: few nodes are common, so these stay in the cache.
    Lanes don't branch. With a part of the width below the middle, and one = -1 for a 1 and 0 for a 0, a 0 adds part + 1 to low,
    and the width becomes part or width - part - 1: ((width & ~one) - part - 1) ^ one."""

    def __init__(self, lengths: np.ndarray) -> None:
        n = len(lengths)
        self.lengths, self.offset, self.lane = lengths, np.cumsum(lengths) - lengths, np.arange(n)
        self.chances = np.full((256, n), _EVEN, np.int16)
        self.low, self.width = np.zeros(n, np.int64), np.full(n, _WORD, np.int64)
        self.at = 0

    def strides(self) -> Iterator[tuple[int, range]]:
        """(lanes in use, positions), until few lanes are left."""
        rising = self.lengths[::-1]
        while (used := len(rising) - int(np.searchsorted(rising, self.at, "right"))) >= FEWEST_LANES:
            stop = min(self.at + _STRIDE, int(self.lengths[used - 1]))
            yield used, range(self.at, stop)
            self.at = stop

    def left(self) -> Iterator[tuple[int, list[int], int, int]]:
        """(lane, its chances, low, high) of those that are not at their end."""
        for lane in np.flatnonzero(self.lengths > self.at).tolist():
            low = int(self.low[lane])
            yield lane, self.chances[:, lane].tolist(), low, low + int(self.width[lane])


def _encode_lanes(texts: list[bytes]) -> list[bytes]:
    n = len(texts)
    lanes = _Lanes(np.array([len(t) for t in texts], np.int64))
    data, chances, nodes = np.frombuffer(b"".join(texts), np.uint8), lanes.chances.reshape(-1), _NODES * n
    out, codes = np.empty(n * _WIDTH, np.uint8), [bytearray() for _ in texts]
    start = lanes.lane * _WIDTH
    filled = start.copy()

    def empty() -> None:
        for lane, (a, b) in enumerate(zip(start.tolist(), filled.tolist(), strict=True)):
            if a < b:
                codes[lane] += out[a:b].tobytes()
        filled[:] = start

    for used, positions in lanes.strides():
        low, width, lane, offset = lanes.low[:used], lanes.width[:used], lanes.lane[:used], lanes.offset[:used]
        part, top, settled = np.empty(used, np.int64), np.empty(used, np.int64), np.empty(used, bool)
        for at in positions:
            byte = data.take(offset + at)
            asked = nodes.take(byte, 1)
            asked += lane
            before = chances.take(asked)
            after = _AIMS.take(byte, 1)
            after -= before
            after >>= 5
            after += before
            chances[asked] = after
            before = np.maximum(before, LEAST_CHANCE).astype(np.int64)
            ones = _ONES.take(byte, 1)
            for chance, one, zero in zip(before, ones, ~ones, strict=True):
                np.multiply(width, chance, part)
                np.right_shift(part, PRECISION, part)
                np.add(part, 1, part)
                np.bitwise_and(width, zero, width)
                np.subtract(width, part, width)
                np.bitwise_xor(width, one, width)
                np.bitwise_and(part, zero, part)
                np.add(low, part, low)
                np.add(low, width, top)
                np.bitwise_xor(top, low, top)
                np.less(top, 1 << 24, settled)
                some = settled.nonzero()[0]
                while some.size:
                    l, w, f = low.take(some), width.take(some), filled.take(some)  # noqa: E741
                    out[f] = l >> 24
                    filled[some] = f + 1
                    low[some] = l = l << 8 & _WORD  # noqa: E741
                    width[some] = w = w << 8 | 255
                    some = some[(l ^ (l + w)) < 1 << 24]
        if (filled - start).max() > _WIDTH - 32 * _STRIDE:
            empty()
    empty()
    done = {lane: _encode_rest(texts[lane][lanes.at :], c, low, high, codes[lane]) for lane, c, low, high in lanes.left()}
    return [done[lane] if lane in done else bytes(c) + struct.pack(">I", low) for lane, (c, low) in enumerate(zip(codes, lanes.low.tolist(), strict=True))]


def _decode_lanes(codes: list[bytes], lengths: np.ndarray) -> list[bytes]:
    n = len(codes)
    lanes = _Lanes(lengths)
    chances, text = lanes.chances.reshape(-1), np.empty(int(lengths.sum()), np.uint8)
    codes = [c.ljust(4, b"\0") for c in codes]
    code = np.frombuffer(b"\xff".join([*codes, b""]), np.uint8)  # what is read past a code's end
    end = np.cumsum([len(c) + 1 for c in codes]) - 1
    start = end - [len(c) for c in codes]
    ahead = start + 4
    beyond = sum(code[start + k].astype(np.int64) << (24 - 8 * k) for k in range(4))  # the word less low
    for used, positions in lanes.strides():
        low, width, lane, offset, over = lanes.low[:used], lanes.width[:used], lanes.lane[:used], lanes.offset[:used], beyond[:used]
        part, top, zero, one = (np.empty(used, np.int64) for _ in range(4))
        aim, settled = np.empty(used, np.int16), np.empty(used, bool)
        for at in positions:
            node = lane + n
            for _ in range(8):
                before = chances.take(node)
                np.multiply(width, np.maximum(before, LEAST_CHANCE), part)
                np.right_shift(part, PRECISION, part)
                np.subtract(part, over, zero)
                np.right_shift(zero, 63, zero)
                np.invert(zero, one)
                np.add(part, 1, part)
                np.bitwise_and(width, zero, width)
                np.subtract(width, part, width)
                np.bitwise_xor(width, one, width)
                np.bitwise_and(part, zero, part)
                np.add(low, part, low)
                np.subtract(over, part, over)
                np.bitwise_and(one, TOTAL - 1, aim, casting="unsafe")
                np.subtract(aim, before, aim)
                np.right_shift(aim, 5, aim)
                np.add(aim, before, aim)
                chances[node] = aim
                np.add(node, node, node)
                np.subtract(node, lane, node)
                np.bitwise_and(one, n, one)
                np.add(node, one, node)
                np.add(low, width, top)
                np.bitwise_xor(top, low, top)
                np.less(top, 1 << 24, settled)
                some = settled.nonzero()[0]
                while some.size:
                    l, w, a = low.take(some), width.take(some), ahead.take(some)  # noqa: E741
                    over[some] = over.take(some) << 8 | code.take(np.minimum(a, end.take(some)))
                    ahead[some] = a + 1
                    low[some] = l = l << 8 & _WORD  # noqa: E741
                    width[some] = w = w << 8 | 255
                    some = some[(l ^ (l + w)) < 1 << 24]
            text[offset + at] = node // n
    made = [text[o : o + m].tobytes() for o, m in zip(lanes.offset.tolist(), lengths.tolist(), strict=True)]
    for lane, c, low, high in lanes.left():
        rest = int(lengths[lane]) - lanes.at
        made[lane] = made[lane][: lanes.at] + _decode_rest(codes[lane], int(ahead[lane] - start[lane]), rest, c, low, high, low + int(beyond[lane]))
    return made


def encode_adaptive_all(texts: list[bytes]) -> list[bytes]:
    """encode_adaptive() of each, many side by side."""
    out = [b""] * len(texts)
    for places in _grouped([len(t) for t in texts]):
        for i, code in zip(places.tolist(), _encode_lanes([texts[i] for i in places]), strict=True):
            out[i] = code
    return out


def decode_adaptive_all(codes: list[bytes], lengths: list[int]) -> list[bytes]:
    """decode_adaptive() of each, many side by side."""
    out = [b""] * len(codes)
    for places in _grouped(lengths):
        for i, text in zip(places.tolist(), _decode_lanes([codes[i] for i in places], np.array(lengths, np.int64)[places]), strict=True):
            out[i] = text
    return out


def _static(data: bytes) -> tuple[int, bytes]:
    freq = frequencies(data)
    code = encode_bytes(data, freq)
    return len(code), decode_bytes(code, len(data), freq)


def _zstd(data: bytes) -> tuple[int, bytes]:
    import zstandard

    code = zstandard.ZstdCompressor(level=8).compress(data)
    return len(code), zstandard.ZstdDecompressor().decompress(code)


def _each(trip: Callable[[bytes], tuple[int, bytes]]) -> Callable[[list[bytes]], list[tuple[int, bytes]]]:
    return lambda values: [trip(v) for v in values]


def _adaptive(values: list[bytes]) -> list[tuple[int, bytes]]:
    """A group is coded and decoded before the next one is begun, so that only one has copies."""
    out = [(0, b"")] * len(values)
    for places in _grouped([len(v) for v in values]):
        codes = encode_adaptive_all([values[i] for i in places])
        back = decode_adaptive_all(codes, [len(values[i]) for i in places])
        for i, code, text in zip(places.tolist(), codes, back, strict=True):
            out[i] = len(code), text
    return out


CODERS: dict[str, Callable[[list[bytes]], list[tuple[int, bytes]]]] = {"static": _each(_static), "adaptive": _adaptive, "zstd": _each(_zstd)}

#: Bytes of texts in a partition of like lengths, at least and at most, and what a text costs besides its bytes. From a length on
#: texts count half, so that a partition has twice as many: a step costs much the same for few lanes as for a thousand.
LEAST_PART, MOST_PART, TEXT_COST, LONG = 1 << 20, 48 << 20, 64, 1 << 13
#: Bytes of texts that a worker holds at once; above a partition's, as the rest of one would have few lanes.
MOST_ROUND = 3 * MOST_PART


def by_length(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) with texts of about one length in a partition, the longest first; partitions are sized by bytes.

    Counted by classes of length (four an octave), of which some hundred rows come to the driver. A class takes a stretch of all
    bytes, and a text's key its place in that stretch, so a class of any size is spread over as many partitions as it fills."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    kind = F.floor(F.log2(size + 1) * 4).cast("int")
    sums = rows.select(kind.alias("kind"), (size + TEXT_COST).alias("n")).groupBy("kind").agg(F.sum("n").alias("n")).collect()
    found = {r["kind"]: r["n"] / (2 if r["kind"] >= 4 * np.log2(LONG) else 1) for r in sums}
    total = sum(found.values())
    part = min(max(total / rows.sparkSession.sparkContext.defaultParallelism, LEAST_PART), MOST_PART)
    starts, at = {}, 0
    for k in sorted(found, reverse=True):
        starts[k] = at
        at += found[k]
    of = lambda known: F.get(F.array(*(F.lit(float(known.get(k, 0))) for k in range(max(found, default=0) + 1))), kind)
    share = F.pmod(F.xxhash64(key), F.lit(1 << 20)) / (1 << 20)
    place = F.floor((of(starts) + of(found) * share) / part).cast("int")
    return rows.select(key, text).repartitionById(int(total // part) + 1, F.coalesce(place, F.lit(0)))


def _rounds(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches put together until they have so many bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def round_trips(rows: DataFrame, key: str, text: str, coder: str) -> DataFrame:
    """(key, bytes, code_bytes, restored): each whole text coded and decoded again."""
    work, together = CODERS[coder], coder == "adaptive"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _rounds(batches, MOST_ROUND if together else 0):
            raw = table.column(1).cast(pa.large_binary()).to_pylist()
            made = iter(work([r for r in raw if r is not None]))
            found = [(None, None, None) if r is None else (len(r), (m := next(made))[0], m[1] == r) for r in raw]
            sizes, codes, same = zip(*found, strict=True) if found else ((), (), ())
            columns = [table.column(0).combine_chunks(), pa.array(sizes, pa.int64()), pa.array(codes, pa.int64()), pa.array(same, pa.bool_())]
            yield from pa.Table.from_arrays(columns, names=[key, "bytes", "code_bytes", "restored"]).to_batches()

    kind = rows.schema[key].dataType.simpleString()
    placed = by_length(rows, key, text) if together else rows.select(key, text)
    return placed.mapInArrow(run, f"{key} {kind}, bytes long, code_bytes long, restored boolean")
