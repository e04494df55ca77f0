"""Byte-level BPE: encoding by a segment tree over byte positions, decoding, and chunk splitting.

A pretoken's pairs of neighbouring parts are the leaves of a segment tree that keeps the leftmost pair of the least
rank at its root. A merge takes the root, joins the two parts and updates three leaves (the pair itself, the pair before
it and the one it swallows), each in logarithmic time. Pretokens of up to `WIDE` bytes are worked through many at a
time, one tree per row of a numpy array; longer ones singly.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable

import numpy as np
import regex

#: Pretokens of more bytes get a tree of their own.
WIDE = 64
#: Bytes of a memory of encoded pieces, about, and characters of a piece that is remembered. Both bound memory, not results.
REMEMBERED, LONGEST = 96 << 20, 64

_CHUNKS = re.compile(r"\s*\S+|\s+")
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")


class Memory:
    """Encoded pieces in two generations. When the younger has grown to half of the bound the older goes; what has been used meanwhile is in the younger."""

    #: Bytes of an entry beside its characters and ids, about.
    ENTRY = 200

    def __init__(self, most: int = REMEMBERED):
        self.most, self.size = most, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.passing: list[str] = []

    def holding(self, pieces: set[str], encode: Callable[[list[str]], list[bytes]]) -> dict[str, bytes]:
        """A dictionary that holds all the pieces until `settle`."""
        new = pieces.difference(self.young)
        known = {x: self.old[x] for x in new if x in self.old}
        missing = [x for x in new if x not in known] if known else list(new)
        self.young.update(known)
        self.young.update(zip(missing, encode(missing)))
        self.passing += [x for x in missing if len(x) > LONGEST]
        self.size += sum(map(len, new)) + self.ENTRY * len(new)
        return self.young

    def settle(self) -> None:
        for x in self.passing:
            if self.young.pop(x, None) is not None:
                self.size -= len(x) + self.ENTRY
        self.passing = []
        if self.size > self.most // 2:
            self.old, self.young, self.size = self.young, {}, 0


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class Chunks:
    """Joins remembered encodings of the pieces of a text.

    A pretoken never spans the border between a non-space and a white-space character, so runs of white space with the
    non-space run after them can be encoded apart. `encode_chunks` encodes a list of such chunks, each to bytes that can
    be joined. Texts with the four ASCII separators, which Python calls white space and Unicode does not, go whole.
    """

    def __init__(self, encode_chunks: Callable[[list[str]], list[bytes]], remembered: int = REMEMBERED):
        self.encode_chunks = encode_chunks
        self.after_space, self.whole = Memory(remembered * 3 // 4), Memory(remembered // 4)

    def pieces(self, text: str) -> tuple[bool, str | None, list[str]]:
        """Whether the pieces follow a space that they don't hold, the first piece, which follows none, in that case, and the pieces."""
        if " ".join(text.split()) == text.replace("\n", " "):  # each run of white space is one space or line feed, between others
            first, *rest = text.replace("\n", " \n").split(" ")
            return True, first, rest
        return False, None, [text] if _ODD_SPACE.search(text) else _CHUNKS.findall(text)

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """One bytes object per text; null counts as empty."""
        split = [self.pieces(t) if t else (False, None, []) for t in texts]
        spaced, whole = set(), set()
        for after, first, rest in split:
            if after:
                spaced.update(rest)
                whole.add(first)
            else:
                whole.update(rest)
        after_space = self.after_space.holding(spaced, lambda new: self.encode_chunks([x if x[:1] == "\n" else f" {x}" for x in new]))
        unspaced = self.whole.holding(whole, self.encode_chunks)
        out = [(unspaced[first] if after else b"") + b"".join(map((after_space if after else unspaced).__getitem__, rest)) for after, first, rest in split]
        self.after_space.settle(), self.whole.settle()
        return out


class Codec:
    """Encodes by ranks and decodes; ids are ranks, as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.memory = Memory(REMEMBERED // 2)
        single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]
        self.single = single
        self.chunks = Chunks(self.encode_chunks, REMEMBERED // 2)

    #: A rank that no pair has.
    NONE = 1 << 40

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], self.NONE)

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, pieces without a token of their own having 2 to WIDE bytes; one tree per row."""
        out = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_size.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
        for size, members in by_size.items():
            for start in range(0, len(members), 20_000):
                self._encode_block(size, members[start : start + 20_000], pieces, out)
        return out

    def _encode_block(self, size: int, members: list[int], pieces: list[bytes], out: list) -> None:
        n, none = len(members), self.NONE
        raw = np.frombuffer(b"".join(pieces[i].ljust(size, b"\0") for i in members), np.uint8).reshape(n, size)
        lengths = np.array([len(pieces[i]) for i in members])
        columns = np.arange(size)
        live = columns < lengths[:, None]
        part = np.full((n, size + 1), -1, np.int64)  # the token that starts at a position; column `size` is the end
        part[:, :size] = np.where(live, self.single[raw], -1)
        after = np.tile(np.arange(1, size + 2), (n, 1))
        after[:, :size] = np.where(columns + 1 < lengths[:, None], columns + 1, size)
        before = np.tile(np.arange(-1, size), (n, 1))
        tree = np.full((n, 2 * size), none * size, np.int64)
        has = columns[:-1] + 1 < lengths[:, None]
        ranks = np.full((n, size - 1), none, np.int64)
        ranks[has] = self.pair_rank(part[:, : size - 1][has], part[:, 1:size][has])
        tree[:, size : 2 * size - 1] = np.where(ranks < none, ranks * size + columns[:-1], none * size)
        width = size // 2
        while width >= 1:
            tree[:, width : 2 * width] = np.minimum(tree[:, 2 * width : 4 * width : 2], tree[:, 2 * width + 1 : 4 * width : 2])
            width //= 2
        rows = np.flatnonzero(tree[:, 1] < none * size)
        while len(rows):
            rank, at = np.divmod(tree[rows, 1], size)
            right = after[rows, at]
            beyond, prior = after[rows, right], before[rows, at]
            part[rows, at], part[rows, right] = rank, -1
            after[rows, at], before[rows, beyond] = beyond, at
            self._put(tree, size, rows, right, none * size)
            end = beyond >= size
            pair = np.where(end, none, self.pair_rank(rank, np.where(end, 0, part[rows, beyond])))
            self._put(tree, size, rows, at, np.where(pair < none, pair * size + at, none * size))
            some = prior >= 0
            r, p = rows[some], prior[some]
            pair = self.pair_rank(part[r, p], rank[some])
            self._put(tree, size, r, p, np.where(pair < none, pair * size + p, none * size))
            rows = rows[tree[rows, 1] < none * size]
        ids = part[:, :size]
        flat, ends = ids[ids >= 0].astype("<u4").tobytes(), (4 * np.cumsum((ids >= 0).sum(1))).tolist()
        for i, start, end in zip(members, [0, *ends], ends):
            out[i] = flat[start:end]

    @staticmethod
    def _put(tree: np.ndarray, size: int, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray | int) -> None:
        node = leaf + size
        tree[rows, node] = value
        while node.size and node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def encode_long(self, piece: bytes) -> list[int]:
        """The ids of one piece of any length, with a tree in plain lists."""
        ranks, n = self.ranks, len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        none = self.NONE * size
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        leaf = lambda a: none if (b := after[a]) >= n or (r := ranks.get(piece[a : end[b]])) is None else r * size + a
        tree = [none] * size + [leaf(a) for a in range(n)] + [none] * (size - n)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(a: int, value: int) -> None:
            node = a + size
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while tree[1] < none:
            at = tree[1] % size
            right = after[at]
            beyond = after[right]
            end[at], after[at] = end[right], beyond
            if beyond < n:
                before[beyond] = at
            put(right, none)
            put(at, leaf(at))
            if before[at] >= 0:
                put(before[at], leaf(before[at]))
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : end[at]]])
            at = after[at]
        return out

    def encode_pretokens(self, pretokens: list[str]) -> list[bytes]:
        out, many = [b""] * len(pretokens), []
        for i, t in enumerate(pretokens):
            piece = t.encode("utf-8", "surrogatepass")
            if (rank := self.ranks.get(piece)) is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(piece) > WIDE:
                out[i] = np.array(self.encode_long(piece), "<u4").tobytes()
            else:
                many.append((i, piece))
        for (i, _), ids in zip(many, self.encode_many([p for _, p in many])):
            out[i] = ids
        return out

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        out = []
        for start in range(0, len(chunks), 50_000):
            found = list(map(self.find, chunks[start : start + 50_000]))
            known = self.memory.holding({t for f in found for t in f}, self.encode_pretokens)
            out += [b"".join(map(known.__getitem__, f)) for f in found]
            self.memory.settle()
        return out

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        return self.chunks.encode(texts)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))
