"""Pre-tokens of the two public tokenizers and a bounded cache of what each distinct one becomes.

Splitting with the standard library's pattern engine is an order of magnitude faster than letting
the tokenizers library split, and a distinct pre-token is then encoded once per worker. Python's
Unicode tables and the library's may differ only on code points that Python does not know as
assigned, so a text that holds any such code point takes the library's own path (TextSplitter.known).
"""

from __future__ import annotations

import functools
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex

#: White_Space code points, as the library's splitting pattern understands \\s.
SPACES = "\t-\r \x85\xa0  -     　"
#: The splitting patterns of the two public vocabularies, {L} letters, {N} numbers, {S} spaces.
BYTE_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
WORD_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"


def _ranges(codes: list[int]) -> str:
    runs: list[list[int]] = []
    for c in codes:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


@functools.cache
def classes() -> dict[str, str]:
    """Letters, numbers and unassigned code points of the basic plane as character ranges."""
    kinds: dict[str, list[int]] = {"L": [], "N": [], "C": []}
    for c in range(0x10000):
        kind = unicodedata.category(chr(c))
        if kind[0] in "LN":
            kinds[kind[0]].append(c)
        elif kind == "Cn" or kind == "Cs":
            kinds["C"].append(c)
    return {k: _ranges(v) for k, v in kinds.items()} | {"S": SPACES}


class TextSplitter:
    """findall(text) gives the pre-tokens; known(text) says if both Unicode tables agree on the text."""

    def __init__(self, pattern: str):
        c = classes()
        self._plane0 = re.compile(pattern.format(**c))
        self._all = regex.compile(pattern.format(L=r"\p{L}", N=r"\p{N}", S=SPACES))
        self._odd = re.compile(f"[{c['C']}\U00010000-\U0010ffff]")

    def known(self, text: str) -> bool:
        if text.isascii():
            return True
        return not any(unicodedata.category(m) in ("Cn", "Cs") for m in set(self._odd.findall(text)))

    def findall(self, text: str) -> list[str]:
        if text.isascii() or max(text) < "\U00010000":
            return self._plane0.findall(text)
        return self._all.findall(text)


#: Classes of code points in code_classes().
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)


@functools.cache
def code_classes() -> np.ndarray:
    """The class of every code point; UNKNOWN where Python doesn't know it as assigned."""
    table = np.full(0x110000, OTHER, np.uint8)
    of = {"L": LETTER, "N": NUMBER}
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] in of:
            table[c] = of[kind[0]]
        elif kind in ("Cn", "Cs"):
            table[c] = UNKNOWN
    table[[ord(c) for c in re.findall(f"[{SPACES}]", "".join(map(chr, range(0x3001))))]] = SPACE
    return table


@dataclass
class Words:
    """Pre-tokens of several texts: distinct ones as UTF-8, the number of each place's one, and the places before each text's end."""

    distinct: list[bytes]
    numbers: np.ndarray
    ends: np.ndarray


def split_all(texts: list[str]) -> Words:
    """BYTE_SPLIT over several texts at once, by arrays over their code points; no text may hold an UNKNOWN one.

    Runs of letters, numbers and others are pre-tokens, with a plain space before them. Of a run of white space
    before something else the last one is by itself (or is that space), and the rest is one; at a text's end all of it
    is one. An apostrophe that starts a run without a space before it is one with s, t, m, d, re, ve or ll after it.
    """
    joined = "".join(texts)
    raw = joined.encode()
    if not raw:
        return Words([], np.zeros(0, np.int32), np.zeros(len(texts), np.int64))
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    kind = code_classes()[codes]
    limits = np.cumsum([len(t) for t in texts])
    first = np.zeros(len(codes) + 1, bool)  # a text starts here; the end counts as one more start
    first[0] = True
    first[limits] = True
    new_run = first[:-1].copy()
    new_run[1:] |= kind[1:] != kind[:-1]
    blank = kind == SPACE
    after_space = np.zeros(len(codes), bool)
    after_space[1:] = codes[:-1] == 0x20
    after_space &= ~first[:-1]
    last_blank = blank.copy()
    last_blank[:-1] &= ~blank[1:]
    last_blank &= ~first[1:]
    starts = (new_run & ~(after_space & ~blank)) | last_blank
    quotes = np.flatnonzero((codes == 0x27) & new_run & ~after_space)
    if len(quotes):
        ends_at = limits[np.searchsorted(limits, quotes, "right")]
        padded = np.concatenate((codes, np.zeros(3, codes.dtype)))
        a, b = padded[quotes + 1], padded[quotes + 2]
        one = np.isin(a, [ord(c) for c in "stmd"]) & (quotes + 1 < ends_at)
        pairs = [(a == ord(x)) & (b == ord(y)) for x, y in ("re", "ve", "ll")]
        two = (pairs[0] | pairs[1] | pairs[2]) & (quotes + 2 < ends_at)
        for found, size in ((quotes[one], 2), (quotes[two], 3)):
            starts[found + 1] = False
            starts[(found + size)[found + size < len(codes)]] = True
    places = np.flatnonzero(starts)
    if len(raw) == len(joined):
        offsets = places
    else:
        sizes = (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF) + 1
        offsets = np.cumsum(sizes, dtype=np.int32)[places] - sizes[places]
    offsets = np.append(offsets, len(raw)).astype("<i4")
    words = pa.BinaryArray.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
    own, at = words.dictionary.buffers()[2].to_pybytes(), np.frombuffer(words.dictionary.buffers()[1], "<i4", len(words.dictionary) + 1).tolist()
    return Words([own[a:b] for a, b in zip(at, at[1:], strict=False)], words.indices.to_numpy(), np.searchsorted(places, limits))


class BoundedCache(dict):
    """word -> make(word) for words of bounded length, in two generations of entries / 2 each.

    When the new generation is full it becomes the old one; words found there come back, so frequent words stay.
    From then on a word is admitted when it is made for the second time, which a bit table of hashes remembers,
    so words that come once don't drive out others. Longer words are made each time.
    """

    def __init__(self, make, entries: int = 600_000, longest: int = 48, bits: int = 1 << 22):
        super().__init__()
        self.make, self.half, self.longest, self.bits = make, entries // 2, longest, bits
        self.made, self.marked, self.seen, self.old = 0, 0, bytearray(bits // 8), {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
            self.made += 1
            if len(word) > self.longest or (self.old and not self._second(word)):
                return value
        self._admit(word, value)
        return value

    def all(self, words: list, make_all) -> list:
        """The values of distinct words; make_all(words) makes those that aren't held, in one call."""
        out = list(map(self.get, words))
        old = self.old.get
        lacking = []
        for i in [i for i, v in enumerate(out) if v is None]:
            out[i] = value = old(words[i])
            if value is None:
                lacking.append(i)
            else:
                self._admit(words[i], value)
        made = make_all([words[i] for i in lacking])
        self.made += len(made)
        for i, value in zip(lacking, made, strict=True):
            out[i], word = value, words[i]
            if len(word) <= self.longest and (not self.old or self._second(word)):
                self._admit(word, value)
        return out

    def _admit(self, word, value) -> None:
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[word] = value

    def _second(self, word) -> bool:
        at = hash(word) % self.bits
        at, bit = at >> 3, 1 << (at & 7)
        if self.seen[at] & bit:
            return True
        self.seen[at] |= bit
        self.marked += 1
        if self.marked > self.bits // 2:  # a full table would admit all
            self.seen, self.marked = bytearray(self.bits // 8), 0
        return False


@functools.cache
def byte_alphabet() -> list[str]:
    """The public byte-to-character rule of byte-level vocabularies: printable Latin-1 stays, others go to 256 and up."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, extra = [""] * 256, 0x100
    for b in range(256):
        if b in kept:
            table[b] = chr(b)
        else:
            table[b], extra = chr(extra), extra + 1
    return table


@functools.cache
def _byte_table() -> dict[int, str]:
    return dict(enumerate(byte_alphabet()))


@functools.cache
def _separated() -> dict[int, str]:
    return _byte_table() | {0xFF: " "}


def to_byte_alphabet(word: str) -> str:
    rest = word[1:] if word[:1] == " " else word
    if rest.isascii() and rest.isalnum():  # the commonest kind of pre-token
        return rest if rest is word else byte_alphabet()[0x20] + rest
    return word.encode("utf-8").decode("latin-1").translate(_byte_table())


@functools.cache
def _alphabet_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_alphabet())}


def from_byte_alphabet(piece: str) -> str:
    return bytes(map(_alphabet_bytes().__getitem__, piece)).decode("utf-8")


_CUT = re.compile("[A-Za-z] [A-Za-z]")


class ByteLevelEncoder:
    """Pieces of whole texts for a byte-level vocabulary file of the tokenizers library.

    value(ids) is what is kept of a pre-token (its length, its packed ids, ...).
    Special strings in a text count as the library's default has them: one id each.
    """

    def __init__(self, path: str, value):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.library = Tokenizer.from_file(path)
        self.library.model._resize_cache(0)  # pieces keeps what comes back; the library's own table only costs time
        self.value, self.splitter = value, TextSplitter(BYTE_SPLIT)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self._split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._tokenize = self.library.model.tokenize
        self._many = Tokenizer(self.library.model)
        self._many.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.library.get_vocab()
        self._sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self._sizes[list(vocabulary.values())] = list(map(len, vocabulary))
        self.pieces = BoundedCache(lambda raw: self.make(raw.decode()))  # by UTF-8

    def make(self, word: str):
        return self.value([t.id for t in self._tokenize(to_byte_alphabet(word))])

    def ids_of_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens, one after the other, and where each one's end; by one call of the library."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Byte 255 is in no UTF-8 and stands for a blank, which the byte alphabet has no other use for.
        joined = b"\xff".join(words).decode("latin-1").translate(_separated())
        ids = np.array(self._many.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
        # A token of the byte alphabet has as many characters as it stands for bytes, and none lies in two pre-tokens.
        read = np.cumsum(self._sizes[ids])
        return ids, np.searchsorted(read, np.cumsum(list(map(len, words)))) + 1

    def make_packed(self, words: list[bytes], width: int) -> list[bytes]:
        """Packed ids of each pre-token."""
        ids, ends = self.ids_of_all(words)
        raw, at = ids.astype(f"<u{width}").tobytes(), (ends * width).tolist()
        return [raw[a:b] for a, b in zip([0, *at], at, strict=False)]

    def make_counts(self, words: list[bytes]) -> list[int]:
        """The number of ids of each pre-token."""
        return np.diff(self.ids_of_all(words)[1], prepend=0).tolist()

    def plain(self, text: str) -> bool:
        """No special strings, and no code points on which the Unicode tables may differ."""
        return self.splitter.known(text) and not any(s in text for s in self.special)

    def portions(self, text: str, size: int = 1 << 20) -> list[str]:
        """A plain text in portions of about size, cut between a letter and a space before a letter, where pre-tokens end."""
        out, at = [], 0
        while len(text) - at > size and (cut := _CUT.search(text, at + size)):
            out.append(text[at : cut.start() + 1])
            at = cut.start() + 1
        return [*out, text[at:]] if out else [text]

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings; the library splits where the Unicode tables may differ."""
        if self.splitter.known(text):
            return self.splitter.findall(text)
        return [from_byte_alphabet(piece) for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def segments(self, text: str):
        """('special', id) or ('words', [pre-token, ...]) in text order."""
        if self._split is None or not any(s in text for s in self.special):
            yield "words", self.words(text)
            return
        for part in self._split.split(text):
            if part in self.special:
                yield "special", self.special[part]
            elif part:
                yield "words", self.words(part)
