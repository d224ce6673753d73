"""Exact, remembered encoding with a lower-casing word BPE of the tokenizers library.

The vocabulary's pre-tokens never reach across ASCII white space, so a text is cut there. The words of many texts are
hashed, looked up and compared with the remembered bytes as arrays; the library encodes only words that a worker does
not remember. A word whose hash belongs to another one, and one too long to be remembered, goes to the library each time.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterator

import numpy as np

from .bytebpe import byte_letters

_PUNCT = string.punctuation
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_SPACES = re.compile(rb"[ \t\n\r\x0b\x0c]")
_P, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1
#: Bytes of a longest remembered word, of all remembered words, of a slice of a text, and of texts that are worked on at once.
LONGEST, MOST_BYTES, SLICE, AT_ONCE = 256, 16 << 20, 1 << 17, 1 << 19
_M = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _ALL, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start[i] to start[i] + size[i] - 1 of every i, in a row."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class WordEncoder:
    """encode_all(texts): the ids of each text (null: none), as little-endian unsigned 32-bit bytes.

    Words are found by a 64-bit hash and known by their bytes. Of more than max_words (or MOST_BYTES), those used last
    are kept. A text of any length takes memory for its bytes, its ids and AT_ONCE bytes of words.
    """

    def __init__(self, path: str, max_words: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self._tok, self._max, self._turn = Tokenizer.from_file(path), max_words, 0
        self._tok.no_truncation()
        self._tok.no_padding()
        # the same model for words that are one pre-token of letters: it takes many in a text, each ends in a final token
        self._bare = Tokenizer(self._tok.model)
        self._bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self._tok.get_vocab()
        self._final = np.zeros(1 + max(vocab.values()), dtype=bool)
        self._final[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._letters = dict(enumerate(byte_letters()))
        self._pow, self._inv = _powers(_P, AT_ONCE), _powers(pow(_P, -1, 1 << 64), AT_ONCE)
        self._hash, self._at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._n, self._used = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self._from, self._size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._flat, self._end = np.zeros(1 << 16, np.uint32), 0
        self._bytes, self._last = np.zeros(1 << 16, np.uint8), 0

    def _words(self, raw: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, hash) of every word of a buffer. One word may have several hashes in a buffer beyond AT_ONCE."""
        edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
        start, end = edge[::2], edge[1::2]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * np.resize(self._pow, len(raw)), dtype=np.uint64)])
        h = (total[end] - total[start]) * self._inv[start % AT_ONCE] + (end - start).astype(np.uint64) * np.uint64(_P)
        h = (h ^ (h >> np.uint64(32))) * _M
        return start, end, h ^ (h >> np.uint64(29))

    def _remember(self, h: np.ndarray, n: np.ndarray, flat: np.ndarray, words: list[bytes]) -> None:
        """Add words with distinct hashes, n[i] ids each in a row in flat."""
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        while self._end + len(flat) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        while self._last + len(raw) > len(self._bytes):
            self._bytes = np.concatenate([self._bytes, np.zeros_like(self._bytes)])
        self._flat[self._end : self._end + len(flat)] = flat
        self._bytes[self._last : self._last + len(raw)] = raw
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        at, start = self._end + np.cumsum(n) - n, self._last + np.cumsum(size) - size
        self._end, self._last = self._end + len(flat), self._last + len(raw)
        place = np.searchsorted(self._hash, h)
        new = np.ones(len(h), bool) if not len(self._hash) else self._hash[np.minimum(place, len(self._hash) - 1)] != h
        order = np.flatnonzero(new)[np.argsort(h[new])]
        place = np.searchsorted(self._hash, h[order])
        for name, values in (("_hash", h), ("_at", at), ("_n", n), ("_from", start), ("_size", size), ("_used", np.full(len(h), self._turn, np.int32))):
            setattr(self, name, np.insert(getattr(self, name), place, values[order]))

    def _forget(self) -> None:
        keep = self._used >= np.sort(self._used)[len(self._used) // 2]
        if keep.all():
            keep = np.zeros(len(self._used), bool)
        for name in ("_hash", "_at", "_n", "_from", "_size", "_used"):
            setattr(self, name, getattr(self, name)[keep])
        flat, raw = self._flat[_runs(self._at, self._n)], self._bytes[_runs(self._from, self._size)]
        self._at, self._from = np.cumsum(self._n) - self._n, np.cumsum(self._size) - self._size
        self._flat, self._end = np.concatenate([flat, np.zeros(max(1 << 16, len(flat)), np.uint32)]), len(flat)
        self._bytes, self._last = np.concatenate([raw, np.zeros(max(1 << 16, len(raw)), np.uint8)]), len(raw)

    @staticmethod
    def _parts(word: str) -> list[str]:
        """A word that ends in punctuation after a letter or digit is two, which are encoded once for all."""
        if "<|" in word:
            return [word]
        small = word.lower() if word.isascii() else word
        head = small.rstrip(_PUNCT)
        return [head, small[len(head) :]] if head and len(head) < len(small) and head.lower()[-1].isalnum() else [small]

    def _encode(self, buffer: bytes, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, number of ids, ids) of the words of a buffer. whole: new words go to the library as they are."""
        raw = np.frombuffer(buffer, dtype=np.uint8)
        gap = _SPACE[raw]
        start, end, h = self._words(raw, gap)
        size = end - start
        alone = size > LONGEST
        one, first, back = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self._hash, one)
        miss = np.ones(len(one), bool) if not len(self._hash) else self._hash[np.minimum(place, len(self._hash) - 1)] != one
        miss &= ~alone[first]
        if miss.any():
            words = [buffer[a:b] for a, b in zip(start[first[miss]].tolist(), end[first[miss]].tolist(), strict=True)]
            texts = [w.decode() for w in words]
            if whole:
                n, flat = self._ask(texts)
            else:
                parts = list(map(self._parts, texts))
                _, count, flat = self._encode(" ".join([p for ps in parts for p in ps]).encode(), True)
                sizes = np.array([len(ps) for ps in parts])
                n = np.add.reduceat(count, np.cumsum(sizes) - sizes).astype(np.int32)
            self._remember(one[miss], n, flat, words)
            place = np.searchsorted(self._hash, one)
        if not len(one):
            return start, np.zeros(0, np.int64), np.zeros(0, np.uint32)
        place = np.minimum(place, len(self._hash) - 1)
        if len(self._hash):
            self._used[place] = self._turn
            place = place[back]
            alone |= self._size[place] != size
            seen = ~alone
            body = raw[~gap] if seen.all() else raw[_runs(start[seen], size[seen])]
            same = self._bytes[_runs(self._from[place[seen]], size[seen])] == body
            if len(same):
                ends = np.cumsum(size[seen])
                alone[np.flatnonzero(seen)[~np.logical_and.reduceat(same, ends - size[seen])]] = True
            n, at = self._n[place].astype(np.int64), self._at[place]
        else:
            n, at = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        flat = self._flat
        if alone.any():
            more, ids = self._ask([buffer[a:b].decode() for a, b in zip(start[alone].tolist(), end[alone].tolist(), strict=True)])
            n[alone], at[alone] = more, self._end + np.cumsum(more) - more
            flat = np.concatenate([self._flat[: self._end], ids])
        return start, n, flat[_runs(at, n)]

    def _ask(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, ids) of words from the library. Lower-case Latin-1 letters need no normaliser."""
        plain = [w.isalpha() and (w.isascii() or max(w) < "\u0100") and w == w.lower() for w in words]
        easy = [w if w.isascii() else w.encode().decode("latin-1").translate(self._letters) for w, p in zip(words, plain, strict=True) if p]
        ids = [self._bare.encode_batch_fast([" ".join(easy[i : i + 1000])], add_special_tokens=False)[0].ids for i in range(0, len(easy), 1000)]
        odd = [w for w, p in zip(words, plain, strict=True) if not p]
        rest = [e.ids for i in range(0, len(odd), 2000) for e in self._tok.encode_batch_fast(odd[i : i + 2000], add_special_tokens=False)]
        first = np.array([x for i in ids for x in i], dtype=np.uint32)
        flat = np.concatenate([first, np.array([x for i in rest for x in i], dtype=np.uint32)])
        n = np.zeros(len(words), dtype=np.int32)
        n[np.array(plain, dtype=bool)] = np.diff(np.flatnonzero(self._final[first]), prepend=-1)
        n[~np.array(plain, dtype=bool)] = [len(i) for i in rest]
        order = np.argsort(~np.array(plain, dtype=bool), kind="stable")
        at = np.zeros(len(words), dtype=np.int64)
        at[order] = np.cumsum(n[order]) - n[order]
        return n, flat[_runs(at, n)]

    @staticmethod
    def _slices(raw: bytes) -> Iterator[bytes]:
        """A text in pieces that end where white space begins."""
        at = 0
        while len(raw) - at > SLICE and (cut := _SPACES.search(raw, at + SLICE)):
            yield raw[at : cut.start()]
            at = cut.start()
        yield raw[at:]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        todo: list[tuple[int, bytes]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if not todo:
                return
            self._turn += 1
            if len(self._hash) > self._max or self._last > MOST_BYTES:
                self._forget()
            sizes = np.array([len(b) + 1 for _, b in todo])
            start, n, ids = self._encode(b" ".join(b for _, b in todo), False)
            ends = np.concatenate([[0], np.cumsum(n)])
            cut = ends[np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))].tolist()
            for (i, _), a, b in zip(todo, cut[:-1], cut[1:], strict=True):
                out[i].append(ids[a:b].tobytes())
            todo.clear()
            held = 0

        for i, text in enumerate(texts):
            for part in self._slices(text.encode()) if text else ():
                if held + len(part) >= AT_ONCE:
                    flush()
                todo.append((i, part))
                held += len(part) + 1
        flush()
        return [b"".join(parts) for parts in out]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
