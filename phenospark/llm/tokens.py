"""Fast exact encoding with a byte-level BPE of the tokenizers library.

Its merges are those of a table of ranks wherever three things hold, which are proved when a tokenizer is loaded: merges
come in the order of the ids they make; every token of the vocabulary, given alone, ends as that one token; and texts are
split by the same expression. (Take the first step at which merging by pairs and merging by the rank of the result differ:
it joins two parts c, d to a token t. What lies inside t's span was merged as if it stood alone, as nothing crossed the
span's ends; so c, d are the two parts that t alone is made of last, and the pairs' rule joins them too.) Texts for which
any of this isn't proved go to the library itself.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Callable
from functools import lru_cache
from itertools import islice, pairwise

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?=\s|\Z)")


def pieces(text: str) -> list[str]:
    """The text cut before every blank that is followed by something else; each piece but the first lost that blank.

    A byte-level BPE splits texts into pre-tokens that never cross such a place: the blank belongs to the pre-token
    after it. White space in front of it stays with the piece before, where it ends the piece as it would end the text.
    """
    return text.split(" ") if _ODD.search(text) is None else _CUT.split(text)


def byte_names(tok: Tokenizer) -> dict[int, str]:
    """The character that a byte-level vocabulary writes for each byte, asked of the tokenizer's own alphabet.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, take the characters from U+0100.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def load(path: str) -> tuple[Tokenizer, list[str]]:
    """A tokenizer that neither cuts nor pads, and the strings of its special tokens."""
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok, [t.content for t in tok.get_added_tokens_decoder().values()]


def is_plain(tok: Tokenizer, model: dict) -> bool:
    """Whether texts reach the merges of a BPE through a byte-level splitter alone."""
    settings = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    return model.get("type") == "BPE" and not any(model.get(s) for s in settings) and tok.normalizer is None and type(tok.pre_tokenizer).__name__ == "ByteLevel"


def _goes_on(sizes: list[int], starts: np.ndarray) -> np.ndarray:
    """Which parts, of a text in parts of these sizes, that begin at `starts` are longer than 1."""
    n = np.array(sizes)
    at = np.cumsum(n) - n
    i = np.minimum(np.searchsorted(at, starts), len(at) - 1)
    return (at[i] == starts) & (n[i] > 1)


class SplitsAlike:
    """Whether a text's characters are split alike by a tokenizer and by another way, tried on each block of 256 code points
    when one of them first turns up.

    What an expression does with a character depends on its class alone: a letter, a digit, white space or something else.
    So each character is put behind an x, a 1 and a !, and `joins` tells which of these, at the given places of a text, its
    pre-token joins with what follows. (The letters of contractions are in the first block, and tried by KINDS.)
    """

    KINDS = ["a", "Z", "é", "ª", "7", "²", "!", "_", "¿", " ", "  ", "\n", "\t", "\xa0", "\x85", "\x1c", "'s", "'ll", "'D"]

    def __init__(self, tok: Tokenizer, joins: Callable[[str, np.ndarray], np.ndarray]):
        self.tok, self.joins, self.known = tok, joins, {}

    @classmethod
    def texts(cls) -> list[str]:
        """Every kind of character before and after every other."""
        return [a + b + c for a in cls.KINDS for b in cls.KINDS for c in ("", "b", " ", "\n")]

    def others(self, number: int) -> frozenset[str]:
        """The characters of a block whose class isn't the same in both."""
        if number not in self.known:
            points = [c for c in range(256 * number, 256 * number + 256) if not 0xD800 <= c < 0xE000]
            text = "".join([f"{before}{chr(c)}\n" for c in points for before in "x1!"])
            starts = np.arange(0, len(text), 3)
            library = [hi - lo for _, (lo, hi) in self.tok.pre_tokenizer.pre_tokenize_str(text)]
            odd = (_goes_on(library, starts) != self.joins(text, starts)).reshape(-1, 3).any(axis=1)
            self.known[number] = frozenset(chr(c) for c, o in zip(points, odd.tolist(), strict=True) if o)
        return self.known[number]

    def __call__(self, text: str) -> bool:
        if text.isascii():
            return not self.others(0)
        return not any([c in self.others(ord(c) >> 8) for c in set(text)])


class Encoder:
    """Ids of whole texts as the library gives them, without added special tokens.

    Texts that hold the string of a special token, or characters that `pattern` splits in another way than this tokenizer, go
    to the library; so do all texts if the module's three conditions aren't proved for it.
    """

    def __init__(self, path: str, pattern: str):
        self.tok, self.special = load(path)
        self._core = ranked(self.tok, pattern)
        self._alike = SplitsAlike(self.tok, _joins_of_ranks(pattern)) if self._core else None

    def __call__(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a text; none for null."""
        if not text:
            return b""
        if self._core is None or any(s in text for s in self.special) or not self._alike(text):
            return _bytes(self.tok.encode(text, add_special_tokens=False).ids)
        return _bytes(self._core.encode_ordinary(text))


def ranked(tok: Tokenizer, pattern: str) -> tiktoken.Encoding | None:
    """The tokenizer as a table of ranks, or None where that isn't proved to be the same."""
    model, vocab = json.loads(tok.to_str())["model"], tok.get_vocab(with_added_tokens=False)
    if not is_plain(tok, model):
        return None
    made = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", ""), -1) for m in model["merges"]]
    back = {c: b for b, c in byte_names(tok).items()}
    if not (set(back) <= set(vocab) and len(vocab) == len(made) + 256 and all(x < y for x, y in pairwise([-1, *made]))):
        return None
    if any(c not in back for name in vocab for c in name) or any(len(tok.model.tokenize(name)) != 1 for name in vocab):
        return None
    core = _encoding(pattern, {bytes(map(back.__getitem__, name)): i for name, i in vocab.items()})
    alike = all(core.encode_ordinary(x) == tok.encode(x, add_special_tokens=False).ids for x in SplitsAlike.texts())
    return core if alike else None


def _encoding(pattern: str, ranks: dict[bytes, int]) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _joins_of_ranks(pattern: str) -> Callable[[str, np.ndarray], np.ndarray]:
    """What a table of ranks joins, seen through one whose only merges are of x, 1 and ! with the byte behind them."""
    seen = [bytes([b]) for b in range(256)] + [a + bytes([b]) for a in (b"x", b"1", b"!") for b in range(256)]
    toy = _encoding(pattern, {t: i for i, t in enumerate(seen)})

    def joins(text: str, starts: np.ndarray) -> np.ndarray:
        begins = np.flatnonzero(np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0 != 0x80)  # of characters
        return _goes_on([len(seen[i]) for i in toy.encode_ordinary(text)], begins[starts])

    return joins


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path, pattern)


class _Known(dict):
    """Piece to its result; computed when first asked for. Beyond `room` pieces the younger half is forgotten: what is
    frequent comes early."""

    def __init__(self, compute, room: int):
        super().__init__()
        self.compute, self.room = compute, room

    def __missing__(self, piece: str):
        if len(self) >= self.room:
            for old in list(islice(self, self.room // 2, None)):
                del self[old]
        self[piece] = found = self.compute(piece)
        return found


class Counter:
    """Numbers of tokens of whole texts, with merging only where a pre-token isn't a token by itself.

    As with Encoder, the library counts what isn't proved to be split as `pattern` does, or holds a special token's string.
    """

    def __init__(self, path: str, pattern: str, room: int = 500_000):
        self.tok, self.special = load(path)
        self.split = split = regex.compile(pattern).findall
        self.byte_names = byte_names(self.tok)
        self._alike = SplitsAlike(self.tok, lambda text, starts: _goes_on(list(map(len, split(text))), starts))
        self.plain = is_plain(self.tok, json.loads(self.tok.to_str())["model"]) and all(
            [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(x)] == ["".join(self.byte_names[b] for b in p.encode()) for p in split(x)] for x in SplitsAlike.texts()
        )
        self.whole = whole_tokens(self.tok, split, self.byte_names) if self.plain else frozenset()
        self._known = _Known(lambda piece: self._count(" " + piece), room)

    def _count(self, text: str) -> int:
        n = 0
        for pre in self.split(text):
            n += 1 if pre in self.whole else self.merged(pre)
        return n

    def merged(self, pre: str) -> int:
        """Tokens that the merges leave of one pre-token."""
        return len(self.tok.model.tokenize("".join(map(self.byte_names.__getitem__, pre.encode()))))

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.plain or any(s in text for s in self.special) or not self._alike(text):
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        first, *rest = pieces(text)
        return self._count(first) + sum(map(self._known.__getitem__, rest))


def whole_tokens(tok: Tokenizer, split, names: dict[int, str]) -> frozenset[str]:
    """Strings of the vocabulary for which one token is proved: one pre-token, and its merges end in one token.

    A vocabulary string need not qualify: merges of its parts can lead elsewhere, or the pattern can split it.
    """
    back = {c: b for b, c in names.items()}
    proved = set()
    for name in tok.get_vocab(with_added_tokens=False):
        try:
            text = bytes(map(back.__getitem__, name)).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if split(text) == [text] and len(tok.model.tokenize(name)) == 1:
            proved.add(text)
    return frozenset(proved)


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    """One counter for each Python worker."""
    return Counter(path, pattern)
