"""Byte-level BPE on public vocabulary files: pre-tokens, their ids, and joins of separately encoded parts."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache
from itertools import islice

import regex
import tiktoken

#: Splits text before merges; a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters past its end that may decide where a pre-token ends: one for the greedy runs, two for white space before a word.
LOOK = 2
#: Pre-tokens whose ids a worker keeps at most.
KNOWN = 500_000
#: Threads of a worker that encode the leaves of a long text.
THREADS = 4


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in the vocabulary file: printable bytes stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _threads() -> ThreadPoolExecutor:
    return ThreadPoolExecutor(THREADS)


class Bpe:
    """A byte-level BPE vocabulary read from a tokenizer's JSON file."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        chars = _byte_of_char()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rank = {bytes(chars[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bytes_of = {i: t for t, i in self.rank.items()} | {i: t.encode() for t, i in self.special.items()}
        self.core = tiktoken.Encoding("pagegraph", pat_str=PATTERN, mergeable_ranks=self.rank, special_tokens=self.special)
        self.pieces = regex.compile(PATTERN).findall
        self.matches = regex.compile(PATTERN).finditer
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}

    def parts(self, text: str) -> list[tuple[str, int | None]]:
        """The text cut at special tokens: (text, None) or (token, its id)."""
        if not self.special or not any(t in text for t in self.special):
            return [(text, None)]
        return [(p, self.special.get(p)) for p in self.split_special(text) if p]

    def of_piece(self, piece: str, leaf: int = 512) -> tuple[int, ...]:
        """The ids of one pre-token."""
        ids = self.known.get(piece)
        if ids is None:
            raw = piece.encode()
            ids = tuple(self.tree(raw, leaf))
            if len(raw) <= leaf:
                if len(self.known) >= KNOWN:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def single(self, raw: bytes) -> list[int]:
        return self.core._encode_single_piece(raw) if raw else []

    def tree(self, raw: bytes, leaf: int = 512) -> list[int]:
        """The ids of one long pre-token: its halves are encoded apart, the leaves in parallel, and joined."""
        parts = [raw]
        while len(parts[-1]) > leaf:
            parts = [half for p in parts for half in (p[: len(p) // 2], p[len(p) // 2 :])]
        ids = list(_threads().map(self.single, parts)) if len(parts) > 1 else [self.single(raw)]
        while len(ids) > 1:
            ids = [self.joined(a, b) for a, b in zip(ids[::2], ids[1::2], strict=True)]
        return ids[0]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of the bytes of two encodings put together.

        A window around the join is encoded anew and grows until its first and last ids are those
        that stood there: then every pair of neighbours is one that encoding makes, and a sequence of
        which all neighbours are such is the encoding of its bytes.
        """
        i = j = 4
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.single(b"".join(map(self.bytes_of.__getitem__, left[len(left) - i :] + right[:j])))
            low = i == len(left) or window[0] == left[len(left) - i]
            high = j == len(right) or window[-1] == right[j - 1]
            if low and high:
                return left[: len(left) - i] + window + right[j:]
            i, j = (i if low else 2 * i), (j if high else 2 * j)

    def text_tree(self, text: str, leaf: int) -> list[int]:
        """The ids of a text without special tokens: it is halved down to leaves, which are encoded in parallel, and halves are joined."""
        parts = [text]
        while len(parts[-1]) > leaf:  # the last is the longest
            parts = [half for p in parts for half in (p[: len(p) // 2], p[len(p) // 2 :])]
        if len(parts) == 1:
            return self.core.encode_ordinary(text)
        ids = list(_threads().map(self.core.encode_ordinary, parts))  # outside the interpreter's lock
        while len(parts) > 1:
            ids = [self.joined_texts(*x) for x in zip(parts[::2], ids[::2], parts[1::2], ids[1::2], strict=True)]
            parts = [a + b for a, b in zip(parts[::2], parts[1::2], strict=True)]
        return ids[0]

    def last_pieces(self, text: str, count: int) -> list[str]:
        """At least the last `count` pre-tokens of a text, or all.

        White space stands only at the start of a pre-token that has other characters, so that one ends
        wherever white space follows something else: from there the end of the text is split alike.
        """
        back = 16 * count
        while back < len(text):
            for k in range(len(text) - back, len(text) - back // 2):
                if text[k].isspace() and k and not text[k - 1].isspace():
                    found = self.pieces(text[k:])
                    if len(found) > count:
                        return found
                    break
            back *= 2
        return self.pieces(text)

    def joined_texts(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """The ids of two texts put together.

        Splitting runs from left to right and looks LOOK characters ahead. On the left a pre-token with
        as many characters behind it stands; on the right all stand from the first boundary that the
        window around the join also has, with as many characters of the window behind it.
        """
        i = j = 4
        while True:
            head = self.last_pieces(left, i)
            tail = [m[0] for m in islice(self.matches(right), j)]
            cut, end = sum(map(len, head)), sum(map(len, tail))
            window = self.pieces("".join(head) + "".join(tail))
            low = cut == len(left) or (window[0] == head[0] and cut - len(head[0]) >= LOOK)
            whole = end == len(right)
            bounds, at = {}, cut
            for k, piece in enumerate(tail):
                bounds[at] = k
                at += len(piece)
            meet, at_w = None, 0
            for k, piece in enumerate(window):
                if at_w in bounds and (whole or at_w + LOOK <= cut + end):
                    meet = (k, bounds[at_w])
                    break
                at_w += len(piece)
            if whole and meet is None:
                meet = (len(window), len(tail))
            if low and meet is not None:
                dropped, skipped = (sum(len(self.of_piece(p)) for p in x) for x in (head, tail[: meet[1]]))
                middle = [t for p in window[: meet[0]] for t in self.of_piece(p)]
                return left_ids[: len(left_ids) - dropped] + middle + right_ids[skipped:]
            i, j = (i if low else 2 * i), (j if meet is not None else 2 * j)

    def encode(self, text: str, leaf: int = 8192) -> list[int]:
        ids: list[int] = []
        for part, special in self.parts(text):
            ids += [special] if special is not None else self.text_tree(part, leaf)
        return ids

    def decode(self, ids: list[int]) -> str:
        return self.core.decode_bytes(ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)
