"""Byte-level BPE by speculation: greedy longest matches are proposed, every adjacent pair is checked, and only words
with a pair that the merge order forbids are merged exactly.

A token sequence is what BPE yields if each token, on its own, merges back to itself and no merge across a boundary
of two neighbours could have come before the merges that closed that boundary. Both are checked on arrays.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: White space as the vocabulary's own pattern knows it.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the published pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NEVER = 1 << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class ByteBpe:
    """Encoder and decoder for one vocabulary file. Keeps the chunks of text last used: at most twice max_words, of twice
    max_chars; none over `longest` letters."""

    def __init__(self, path: str, max_words: int = 700_000, max_chars: int = 8_000_000, longest: int = 256):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        raw = {token: bytes(byte_of[c] for c in token) for token in spec["model"]["vocab"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.id_of = {raw[t]: i for t, i in spec["model"]["vocab"].items()}
        size = 1 + max([*self.id_of.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in [*self.id_of.items(), *((t.encode(), i) for t, i in self.special.items())]:
            self.bytes_of[i] = token
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pairs = np.array([(self.id_of[raw[a]], self.id_of[raw[b]], self.id_of[raw[a + b]]) for a, b in merges], dtype=np.int64)
        self.rank_of = {(a, b): (r, c) for r, (a, b, c) in enumerate(pairs.tolist())}
        self._size, codes = size, pairs[:, 0] * size + pairs[:, 1]
        order = np.argsort(codes)
        self._codes, self._ranks = codes[order], order
        # how each token arises: the rank of its merge and its halves; bytes have none
        self._born, self._left, self._right = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        self._born[pairs[::-1, 2]] = np.arange(len(pairs))[::-1]
        self._left[pairs[::-1, 2]], self._right[pairs[::-1, 2]] = pairs[::-1, 0], pairs[::-1, 1]
        self._sound = self._self_encoding(pairs)
        self._byte_id = [self.id_of[bytes([b])] for b in range(256)]
        self._said = [f"{i}," for i in range(size)]
        self._longest = max(map(len, self.id_of))
        self._blob = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self._len = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self._at = np.cumsum(self._len) - self._len
        self._pre = regex.compile(PATTERN)
        self._chunk = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
        self._stop = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self._max, self._max_chars, self._keep, self._chars, self.exact = max_words, max_chars, longest, 0, 0
        self._words: dict[str, tuple[bytes, bytes]] = {}
        self._chunks: dict[str, tuple[bytes, bytes]] = {}
        self._older: dict[str, tuple[bytes, bytes]] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a * self._size + b
        at = np.minimum(np.searchsorted(self._codes, want), len(self._codes) - 1)
        return np.where(self._codes[at] == want, self._ranks[at], _NEVER)

    def _clash(self, a: np.ndarray, b: np.ndarray, skip_top: bool = False) -> np.ndarray:
        """Would BPE merge across the boundary of tokens a and b before both are whole?

        Undoes the merges that made a's right edge and b's left edge, latest first. A merge across the boundary wins
        if it ranks before the one that ends the left piece, or not after the one that ends the right piece (of two
        equal pairs the one further left goes first).
        """
        bad = np.zeros(len(a), dtype=bool)
        live = np.arange(len(a))
        end_a, end_b = np.full(len(a), _NEVER - 1), np.full(len(a), _NEVER - 1)
        while len(live):
            rank = self._rank(a, b)
            hit = (rank < end_a) & (rank <= end_b)
            if skip_top:
                hit[:], skip_top = False, False
            bad[live[hit]] = True
            born_a, born_b = self._born[a], self._born[b]
            on = ~hit & ((born_a >= 0) | (born_b >= 0))
            a, b, end_a, end_b, born_a, born_b, live = (x[on] for x in (a, b, end_a, end_b, born_a, born_b, live))
            undo = born_a > born_b  # equal ranks: the right piece's merge is undone first, as the left one came first
            a, end_a, b, end_b = (
                np.where(undo, self._right[a], a),
                np.where(undo, born_a, end_a),
                np.where(undo, b, self._left[b]),
                np.where(undo, end_b, born_b),
            )
        return bad

    def _self_encoding(self, pairs: np.ndarray) -> np.ndarray:
        own = ~self._clash(pairs[:, 0].copy(), pairs[:, 1].copy(), skip_top=True)
        sound = np.ones(self._size, dtype=bool)
        for (a, b, c), good, rank in zip(pairs.tolist(), own.tolist(), range(len(pairs)), strict=True):
            if self._born[c] == rank:
                sound[c] = good and sound[a] and sound[b]
        return sound

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE of one pre-token: the lowest-ranked pair first, leftmost on ties."""
        ids = list(map(self._byte_id.__getitem__, word))
        if len(ids) > 64:
            return self._merge_long(ids)
        rank_of, none = self.rank_of, (_NEVER, -1)
        found = [rank_of.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while found and (best := min(found))[1] >= 0:
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = rank_of.get((ids[i - 1], ids[i]), none)
            if i < len(found):
                found[i] = rank_of.get((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links, for words without end."""
        nxt, prev, rank_of = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)], self.rank_of
        heap = [(rank_of[p][0], i, p, rank_of[p][1]) for i in range(len(ids) - 1) if (p := (ids[i], ids[i + 1])) in rank_of]
        heapq.heapify(heap)
        while heap:
            _, i, pair, made = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != pair[0] or j < 0 or ids[j] != pair[1]:
                continue
            ids[i], ids[j], nxt[i] = made, -1, nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            for k in (prev[i], i):
                if k >= 0 and nxt[k] >= 0 and (found := rank_of.get(p := (ids[k], ids[nxt[k]]))):
                    heapq.heappush(heap, (found[0], k, p, found[1]))
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = nxt[i]
        return out

    def _propose(self, word: bytes) -> list[int]:
        out, at, n, get, longest = [], 0, len(word), self.id_of.get, self._longest
        while at < n:
            for end in range(min(n, at + longest), at, -1):
                if (i := get(word[at:end])) is not None:
                    out.append(i)
                    at = end
                    break
        return out

    def learn(self, words: list[str]) -> None:
        """Encode new pre-tokens: propose for all, check all pairs at once, merge the failures exactly."""
        raw = [w.encode() for w in words]
        guess = [self._propose(w) for w in raw]
        sizes = np.array([len(g) for g in guess], dtype=np.int64)
        flat = np.fromiter((i for g in guess for i in g), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        fail = np.zeros(len(words), dtype=bool)
        fail[owner[~self._sound[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        codes, back = np.unique(flat[inner] * self._size + flat[inner + 1], return_inverse=True)
        clash = self._clash(codes // self._size, codes % self._size)
        fail[owner[inner[clash[back]]]] = True
        for k in np.flatnonzero(fail).tolist():
            guess[k] = self.merge(raw[k])
        self.exact += int(fail.sum())
        said = self._said.__getitem__
        self._words.update((w, (array("I", ids).tobytes(), "".join(map(said, ids)).encode())) for w, ids in zip(words, guess, strict=True))

    def _split(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk; letters, or letters and a stop or comma, need no pattern."""
        body = chunk[1:] if chunk[0] == " " else chunk
        if body.isalpha():
            return [chunk]
        if body[-1:] in (".", ",") and body[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self._pre.findall(chunk)

    def _fill(self, new: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """Remember new chunks; those over the longest to be kept are returned instead."""
        split = list(map(self._split, new))
        words = list({w for s in split for w in s}.difference(self._words))
        if words:
            self.learn(words)
        get = self._words.__getitem__
        long: dict[str, tuple[bytes, bytes]] = {}
        for chunk, parts in zip(new, split, strict=True):
            into = self._chunks if len(chunk) <= self._keep else long
            if len(parts) == 1:
                into[chunk] = get(parts[0])
            else:
                found = list(map(get, parts))
                into[chunk] = (b"".join([f[0] for f in found]), b"".join([f[1] for f in found]))
            self._chars += len(chunk) if into is self._chunks else 0
        for w in words:
            if len(w) > self._keep:
                del self._words[w]
        return long

    def encode_all(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes]]:
        """Per text the ids, and their decimals with a comma after each.

        New chunks of a run of texts are met at once, so that the checks run on long arrays.
        """
        held, room = [], 0
        for text in texts:
            plain = not self._stop or not self._stop.search(text)
            parts = [text] if plain else self._stop.split(text)
            held.append(([self._chunk.findall(p) for p in parts], [] if plain else self._stop.findall(text)))
            room += len(text)
            if room > 2_000_000:
                yield from self._look_up(held)
                held, room = [], 0
        yield from self._look_up(held)

    def _look_up(self, held: list[tuple[list[list[str]], list[str]]]) -> Iterator[tuple[np.ndarray, bytes]]:
        new = set().union(*(c for parts, _ in held for c in parts)).difference(self._chunks)
        long: dict[str, tuple[bytes, bytes]] = {}
        if new:
            if len(self._chunks) + len(new) > self._max or self._chars > self._max_chars:  # what the last span did not use goes
                self._older, self._words = self._chunks, {}
                self._chunks, self._chars = {}, 0
                new = set().union(*(c for parts, _ in held for c in parts))
            again = new.intersection(self._older)
            self._chunks.update((c, self._older[c]) for c in again)
            self._chars += sum(map(len, again))
            long = self._fill(list(new - again))
        short = self._chunks.__getitem__
        get = (lambda c: long[c] if c in long else short(c)) if long else short
        for parts, stops in held:
            found: list[tuple[bytes, bytes]] = []
            for k, chunks in enumerate(parts):
                if k:
                    i = self.special[stops[k - 1]]
                    found.append((i.to_bytes(4, "little"), b"%d," % i))
                found += map(get, chunks)
            yield np.frombuffer(b"".join([f[0] for f in found]), dtype="<u4"), b"".join([f[1] for f in found])

    def encode(self, text: str) -> tuple[np.ndarray, bytes]:
        return next(iter(self.encode_all([text])))

    def _gather(self, ids: np.ndarray) -> bytes:
        sizes = self._len[ids]
        start = self._at[ids] - (np.cumsum(sizes) - sizes)
        return self._blob[np.repeat(start, sizes) + np.arange(int(sizes.sum()))].tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become U+FFFD."""
        out = b"".join(self._gather(ids[i : i + (1 << 18)].astype(np.int64)) for i in range(0, len(ids), 1 << 18))
        try:
            out.decode()
        except UnicodeDecodeError:
            out = out.decode(errors="replace").encode()
        return out


_loaded: dict[str, ByteBpe] = {}


def codec(path: str) -> ByteBpe:
    """One codec a worker process and vocabulary."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs' doc_id with `ids` array<int> and `decoded`, the text that the ids decode to. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            ids = [i for i, _ in bpe.encode_all([t or "" for t in batch.column(1).to_pylist()])]
            out = [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i).decode() for i in ids])]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "decoded"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text; per document doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text is empty (0 tokens, the digests of nothing).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            counts, a, b = [], [], []
            for ids, said in bpe.encode_all([t or "" for t in batch.column(1).to_pylist()]):
                back = bpe.decode(ids)
                counts.append(len(ids))
                a.append(hashlib.sha256(said[:-1]).hexdigest())
                b.append(hashlib.sha256(back).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bound_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
