"""BPE encoding and decoding as streaming transducers.

Encoding. A byte-pair tokenisation is correct exactly when each neighbouring pair of its tokens is:
merging the pair's own symbols must give back those two tokens, so every prefix of a pre-token has one
correct path of tokens. What follows a token can change it only by a merge across its right edge, and
whether merge r happens there depends on the symbols of r's right part and, where these may be taken by
earlier merges across their own right edges, on what follows these. Ranks fall along such a chain, so the
longest one is found by one pass over the merge list: MergeList.lookahead. A token is emitted once that many
symbols after it are known; the transducer holds no more than twice those and the longest token.

Decoding. ByteTextDecoder is a state machine fed with ids in portions of any size; it maps each to bytes and
passes them through an incremental UTF-8 decoder, so a character split over ids comes out once it is complete.

A text is read in portions of bounded size that end before white space, where no pre-token continues. Each
portion's pre-tokens go through the transducer (what a short one becomes is kept in a bounded table), its ids
through the decoder, and both only feed digests, so besides the text itself memory doesn't grow with it. A
run without white space is one portion.

Defined cases: null and empty texts have no ids and decode to ''; repeated rows give repeated
results; a null doc_id stays null; special strings inside a text count as the library's default has
them. A text with code points that Python's Unicode tables don't know as assigned is split by the
library (see pretokens), and its pieces go through the same transducer.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import re
import sys
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .common import docs_text, map_texts
from .pretokens import SPACES, WORD_SPLIT, BoundedCache, TextSplitter, byte_alphabet, to_byte_alphabet

LITTLE = sys.byteorder == "little"


class MergeList:
    """Vocabulary, merge ranks and what follows from them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        top = max(self.ids.values(), default=0) + 1
        self.top, never = top, len(merges)
        #: left id * top + right id -> rank of the merge
        self.ranks: dict[int, int] = {}
        self.size = [0] * top
        for token, i in self.ids.items():
            self.size[i] = self.symbols(token)
        made: dict[int, tuple[int, int, int]] = {}  # token -> rank, left, right of the merge that makes it
        self.proper = True
        for rank, (x, y) in enumerate(merges):
            if x + y not in self.ids or x not in self.ids or y not in self.ids:
                continue
            left, right, whole = self.ids[x], self.ids[y], self.ids[x + y]
            self.ranks.setdefault(left * top + right, rank)
            if whole in made or any(made.get(t, (-1,))[0] > rank for t in (left, right)):
                self.proper = False
            made.setdefault(whole, (rank, left, right))
        if not self.proper:
            raise ValueError("a merge comes before the merges of its parts; streaming is not defined for such a list")
        self.longest = max(self.size, default=1)
        # The pieces of a token that touch its right (left) edge, oldest first, each with the rank of the
        # merge that absorbs it; the token itself is never absorbed from within.
        self.right_edge: list[tuple | None] = [None] * top
        self.left_edge: list[tuple | None] = [None] * top
        for token in sorted(self.ids.values(), key=lambda t: made.get(t, (-1,))[0]):
            if token not in made:
                self.right_edge[token] = self.left_edge[token] = ((token, never),)
                continue
            rank, left, right = made[token]
            self.right_edge[token] = (*self.right_edge[right][:-1], (right, rank), (token, never))
            self.left_edge[token] = (*self.left_edge[left][:-1], (left, rank), (token, never))
        # A token can occur if its own symbols become it: its parts can occur, and the first merge that
        # crosses the edge between them is the one that makes it.
        fine = {i for i in self.ids.values() if i not in made and self.size[i] == 1}
        for token, (_, left, right) in made.items():
            if left in fine and right in fine and self.crossing(left, right) == left * top + right:
                fine.add(token)
        self.usable = {t: i for t, i in self.ids.items() if i in fine}
        #: first three symbols -> length of the longest token that starts with them
        self.reach: dict[str, int] = {}
        for token, i in self.usable.items():
            if self.size[i] > 2:
                self.reach[token[:3]] = max(self.size[i], self.reach.get(token[:3], 0))
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Symbols after a token's end that settle whether any merge crosses it.

        reach of merge r: symbols right of its edge that settle whether r's right part stands there in time.
        The part's right-edge pieces can be taken before they are absorbed by merges with an earlier rank
        that have such a piece on their left, and these reach on from the part's end.
        """
        best: dict[int, tuple[list[int], list[int]]] = {}  # left token -> ranks, most reach of these and earlier ones
        most = 0
        for pair, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            left, right = divmod(pair, self.top)
            further = 0
            for piece, until in self.right_edge[right]:
                if piece in best:
                    ranks, reach = best[piece]
                    before = bisect_left(ranks, min(until, rank))
                    further = max(further, reach[before - 1] if before else 0)
            reach_here = self.size[right] + further
            ranks, reach = best.setdefault(left, ([], []))
            ranks.append(rank)
            reach.append(max(reach_here, reach[-1] if reach else 0))
            most = max(most, reach_here)
        return most

    def symbols(self, token: str) -> int:
        return len(token) - len(self.suffix) if self.suffix and token.endswith(self.suffix) else len(token)

    def crossing(self, left: int, right: int) -> int:
        """The first merge across the edge between two tokens while these are being made, or -1.

        Replays what touches the edge in order of rank: a crossing merge that comes before its left
        piece is absorbed, and not after its right piece is (equal pairs merge leftmost first), wins.
        """
        rights, lefts, ranks, top = self.right_edge[left], self.left_edge[right], self.ranks, self.top
        i = j = 0
        x, x_until = rights[0]
        y, y_until = lefts[0]
        while True:
            rank = ranks.get(x * top + y)
            if rank is not None and rank < x_until and rank <= y_until:
                return x * top + y
            if x_until <= y_until:
                i += 1
                if i == len(rights):
                    return -1
                x, x_until = rights[i]
            else:
                j += 1
                y, y_until = lefts[j]


class Transducer:
    """feed() symbols of one pre-token, finish() it; both give ids as soon as they are final."""

    def __init__(self, merges: MergeList, pairs: int = 1 << 17):
        self.merges = merges
        self.check = 2 * (merges.lookahead + merges.longest)
        self.crossing = functools.lru_cache(pairs)(merges.crossing)  # pairs of tokens come back
        self.peak = 0
        self._clear()

    def _clear(self) -> None:
        self.text, self.left = "", -1  # symbols after the last emitted token, and that token

    def feed(self, symbols: str) -> list[int]:
        out: list[int] = []
        step = self.check
        for at in range(0, len(symbols), step) if len(symbols) > step else (0,):
            self.text += symbols[at : at + step]
            if len(self.text) > step:
                out += self._settle()
        return out

    def _settle(self) -> list[int]:
        """Emit what is final. The newest symbol may still be the word's last, which has an id of its own."""
        m, n = self.merges, len(self.text) - 1
        self.peak = max(self.peak, n + 1)
        path, at, done = self._path(n, ""), 0, 0
        for done, token in enumerate(path):
            if at + m.size[token] > n - m.lookahead:
                break
            at += m.size[token]
        if done:
            self.text, self.left = self.text[at:], path[done - 1]
        return path[:done]

    def _path(self, n: int, suffix: str) -> list[int]:
        """The one path of tokens over the first n symbols held whose neighbours all fit, the token before them included.

        Takes the longest token that fits its left neighbour and goes back from where none does. The path
        to a length is unique, so a length that has failed once has failed for good.
        """
        m, text, path, at, most, failed = self.merges, self.text, [], 0, n, set()
        usable, crossing, reach = m.usable, self.crossing, m.reach
        whole = text[:n] + suffix
        first = left = self.left
        while at < n:
            size = min(most, n - at, reach.get(text[at : at + 3], 2))
            while size:
                to = at + size
                token = usable.get(text[at:to] if to < n else whole[at:])
                if token is not None and to not in failed and (left < 0 or crossing(left, token) < 0):
                    break
                size -= 1
            if size:
                path.append(token)
                at, most, left = at + size, n, token
            elif path:
                failed.add(at)
                size = m.size[path.pop()]
                at, most, left = at - size, size - 1, path[-1] if path else first
            else:
                raise ValueError(f"no tokens for {text!r}")
        return path

    def finish(self) -> list[int]:
        out = self._path(len(self.text), self.merges.suffix)
        self._clear()
        return out


class ByteTextDecoder:
    """ids -> text in pieces of any size. join: the string between tokens, or None for byte-level joining."""

    def __init__(self, tokens: dict[int, str], join: str | None = " "):
        self.join, self.first = (None if join is None else join.encode()), True
        of = {c: b for b, c in enumerate(byte_alphabet())}
        if join is None:
            self.bytes = {i: bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for i, t in tokens.items()}
        else:
            self.bytes = {i: t.encode() for i, t in tokens.items()}
        self.utf8 = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: Iterable[int]) -> str:
        """Text that is complete with these ids; an unfinished character waits for the next ones."""
        parts = list(map(self.bytes.__getitem__, ids))
        if not parts:
            return ""
        raw = (self.join or b"").join(parts)
        if self.join and not self.first:
            raw = self.join + raw
        self.first = False
        return self.utf8.decode(raw)

    def finish(self) -> str:
        self.first = True
        return self.utf8.decode(b"", final=True)


class WordEncoder:
    """Whole texts to ids and back, for a vocabulary with word ends (lower case, white space dropped)."""

    def __init__(self, path: str, known_words: int = 400_000):
        self.path, self.merges = path, MergeList(path)
        self.tokens = {i: t for t, i in self.merges.ids.items()} | {i: t for t, i in self.merges.special.items()}
        self.splitter = TextSplitter(WORD_SPLIT)
        self._spaces = re.compile(f"[{SPACES}]+")
        self._cut = re.compile("[ \n]")  # no character composes with these, and every pre-token ends there
        self._special = re.compile("(" + "|".join(map(re.escape, self.merges.special)) + ")") if self.merges.special else None
        self.transducer = Transducer(self.merges, known_words // 4)
        self.packed = BoundedCache(self._encode_word, known_words)
        self.decoder = ByteTextDecoder(self.tokens)
        self._library = None

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def word_ids(self, word: str) -> list[int]:
        emitted = self.transducer.feed(to_byte_alphabet(word))
        return emitted + self.transducer.finish()

    def _encode_word(self, word: str) -> bytes:
        return array("I", self.word_ids(word)).tobytes() if LITTLE else np.array(self.word_ids(word), "<u4").tobytes()

    def portions(self, text: str, size: int = 1 << 16) -> Iterator[str]:
        """The text in portions of about size, the later ones starting at white space."""
        at = 0
        while len(text) - at > size:
            cut = self._cut.search(text, at + size)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        if at < len(text):
            yield text[at:] if at else text

    def words(self, text: str) -> list[str]:
        if not self.splitter.known(text):
            lib = self.library
            norm = lib.normalizer.normalize_str(text)
            raw = norm.encode()
            return [norm[a:b] for _, (a, b) in lib.pre_tokenizer.pre_tokenize_str(norm)] if raw else []
        norm = text if text.isascii() else unicodedata.normalize("NFC", text)
        norm = self._spaces.sub(" ", norm).replace("Σ", "σ").lower()
        return self.splitter.findall(norm)

    def encode(self, text: str) -> Iterator[bytes]:
        """The text's ids in portions, packed as little-endian unsigned 32-bit integers."""
        get = self.packed.__getitem__
        parts = [text]
        if self._special is not None and any(s in text for s in self.merges.special):
            parts = self._special.split(text)
        for part in parts:
            if part in self.merges.special:
                yield int(self.merges.special[part]).to_bytes(4, "little")
            else:
                for portion in self.portions(part):
                    yield b"".join(map(get, self.words(portion)))


@functools.cache
def word_encoder(path: str, known_words: int = 400_000) -> WordEncoder:
    return WordEncoder(path, known_words)


def encode_decode(docs: DataFrame, tokenizer_path: str, with_ids: bool = False, known_words: int = 400_000) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) and, if asked for, ids and decoded themselves.

    known_words bounds the table of pre-tokens that a worker keeps: memory for time, the same results.
    """

    def rows(doc_ids: list, texts: list[str]) -> dict:
        encoder = word_encoder(tokenizer_path, known_words)
        decoder = encoder.decoder
        out: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
        for text in texts:
            n, ids_sha, text_sha, kept, read = 0, hashlib.sha256(), hashlib.sha256(), [], []
            for packed in chain(encoder.encode(text), (None,)):
                if packed is None:
                    decoded = decoder.finish()
                else:
                    ids_sha.update(packed)
                    ids = np.frombuffer(packed, "<u4")
                    n += len(ids)
                    decoded = decoder.feed(ids.tolist())
                    if with_ids:
                        kept.append(ids.astype("i8"))
                text_sha.update(decoded.encode())
                if with_ids:
                    read.append(decoded)
            out["n_tokens"].append(n)
            out["ids_sha256"].append(ids_sha.hexdigest())
            out["decoded_sha256"].append(text_sha.hexdigest())
            if with_ids:
                out["ids"].append(np.concatenate([np.zeros(0, "i8"), *kept]))
                out["decoded"].append("".join(read))
        return {"doc_id": doc_ids} | out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(docs_text(docs), schema + ", ids array<long>, decoded string" * with_ids, rows, 256)
