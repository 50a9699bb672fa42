"""Byte-level BPE by longest match and backtracking.

A byte-level BPE encoding is the one split of a piece into vocabulary tokens in
which every two neighbours are *compatible*: merging the bytes of the two
tokens alone gives back exactly these two.  So the encoder walks from left to
right over the matches of an Aho-Corasick automaton (bytes mapped to Latin-1
characters, as the automaton works on strings), takes the longest token that is
compatible with the one before it, and steps back when none is.  Each position
is given up at most once, so the time is linear in the piece.  Compatibility is
decided by the merge ranks once per token pair and remembered.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache
from itertools import chain
from pathlib import Path

import ahocorasick
import regex

#: Fixed value: the pre-tokenisation pattern published with the vocabulary.
PIECES = r""" ?\p{L}++| ?\p{N}++|'(?:[sdmt]|ll|ve|re)| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def default_directory() -> str:
    """The folder of the installed public vocabulary files."""
    try:
        import public_tokenizers

        return str(Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).parent)
    except ImportError:
        return "/opt/tokenizers"


class Known(dict):
    """Pieces with their ids; a piece that is asked for the first time is encoded."""

    def __init__(self, encode: Callable[[str], list[int]], most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, piece: str) -> list[int]:
        if len(self) >= self.most:
            self.clear()
        ids = self[piece] = self.encode(piece.encode("utf-8", "replace").decode("latin-1"))
        return ids


class ByteBpe:
    """An encoder over the ranks of one ``.tiktoken`` file.

    ``piece_memory`` bounds the number of pieces whose ids are remembered; the
    memory is emptied when full, which costs time only.
    """

    def __init__(self, path: str, pattern: str = PIECES, piece_memory: int = 200_000):
        self.rank: dict[str, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                token, rank = line.split()
                self.rank[base64.b64decode(token).decode("latin-1")] = int(rank)
        self.pieces = regex.compile(pattern).findall
        self.matches = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.matches.add_word(token, rank)
        self.matches.make_automaton()
        self.tokens = {rank: token for token, rank in self.rank.items()}
        self.edges: tuple[dict, dict] = ({}, {})
        self.together: dict[int, bool] = {}
        self.known = Known(self.encode_piece, piece_memory)

    def halves(self, token: str) -> tuple[str, str]:
        """The two parts whose merge makes a token of two bytes or more."""
        rank = self.rank
        splits = [at for at in range(1, len(token)) if token[:at] in rank and token[at:] in rank]
        if len(splits) == 1:
            return token[: splits[0]], token[splits[0] :]
        parts = list(token)
        while len(parts) > 2:
            _, at = min((rank.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def edge(self, token: str, side: int) -> tuple[tuple[str, int], ...]:
        """What lies at one end of a token while it is built, from its outermost
        byte on: each part with the rank of the merge that absorbs it."""
        cache = self.edges[side]
        found = cache.get(token)
        if found is None:
            inner = self.edge(part := self.halves(token)[side], side) if len(token) > 1 else ()
            grown = inner[:-1] + ((part, self.rank[token]),) if inner else ()
            found = cache[token] = grown + ((token, 1 << 30),)
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges of the joined bytes keep the two tokens apart.

        Both sides grow by their own merges in order of rank; they stay apart
        unless the parts that meet at the border have a merge that comes first.
        """
        found = self.together.get(left << 20 | right)
        if found is None:
            if len(self.together) > 2_000_000:
                self.together.clear()
            rank, a, b = self.rank.get, self.edge(self.tokens[left], 1), self.edge(self.tokens[right], 0)
            i = j = 0
            while True:
                (x, x_ends), (y, y_ends) = a[i], b[j]
                across = rank(x + y, 1 << 30)
                if across < x_ends and across <= y_ends and across < 1 << 30:
                    found = False
                    break
                if x_ends == y_ends == 1 << 30:
                    found = True
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            self.together[left << 20 | right] = found
        return found

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece, given as Latin-1 characters of its UTF-8 bytes."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        longest = [rank for _, rank in self.matches.iter_long(piece)]
        known, before = self.together.get, longest[0]
        for rank in longest[1:]:
            if not (known(before << 20 | rank) or self.compatible(before, rank)):
                return self.step_back(piece)
            before = rank
        return longest

    def step_back(self, piece: str) -> list[int]:
        """The search for pieces whose longest matches are not compatible."""
        choices: list[list[int]] = [[] for _ in piece]
        for end, rank in self.matches.iter(piece):
            choices[end + 1 - len(self.tokens[rank])].append(rank)
        at, n = 0, len(piece)
        taken: list[int] = []
        dead = bytearray(n + 1)
        while at < n:
            options = choices[at]
            while options:
                rank = options.pop()
                end = at + len(self.tokens[rank])
                if not dead[end] and (not taken or self.compatible(taken[-1], rank)):
                    taken.append(rank)
                    at = end
                    break
            else:
                dead[at] = 1
                at -= len(self.tokens[taken.pop()])
        return taken

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; a null or an empty text has none."""
        return list(chain.from_iterable(map(self.known.__getitem__, self.pieces(text)))) if text else []

    def count(self, text: str | None) -> int:
        """The number of ids of a text, 0 for a null or an empty one."""
        return sum(map(len, map(self.known.__getitem__, self.pieces(text)))) if text else 0


@lru_cache(maxsize=4)
def encoder(path: str) -> ByteBpe:
    """One encoder per worker process and vocabulary."""
    return ByteBpe(path)
