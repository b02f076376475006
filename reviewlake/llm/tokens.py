"""Byte-level BPE ids of whole texts, split and looked up in numpy inside tasks.

The split into pre-tokens follows the tokenizer's own pattern on code points;
each distinct pre-token is encoded once per worker process by the tokenizer.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from reviewlake.llm.textbytes import Chunk, prefix_hash, span_hash

#: Pre-tokens a worker remembers before it starts afresh (about 40 bytes each).
CACHE_ENTRIES = 3_000_000

_LETTER, _NUMBER, _OTHER, _SPACE, _UNKNOWN = range(5)


class Encoder:
    """Ids of a byte-level BPE tokenizer file (``tokenizers`` format)."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.full(0x110000, _UNKNOWN, np.uint8)
        # The byte alphabet of byte-level BPE: printable bytes stand for themselves, the
        # others for code points from 256 on, in order.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.alphabet = {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}
        # Added tokens are found in the text before it is split, wherever they stand.
        self.added = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.find_added = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)))
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.entry = np.zeros(0, np.int64)
        self.at = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.used = self.filled = 0

    def kinds(self, points: np.ndarray) -> np.ndarray:
        """Letter, number, space or other, as the tokenizer's own splitter sees each code point."""
        kind = self.kind[points]
        new = np.unique(points[kind == _UNKNOWN])
        if len(new):
            split = self.tokenizer.pre_tokenizer.pre_tokenize_str
            for p in new.tolist():
                c = chr(p)
                self.kind[p] = next((k for k, before in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!"))
                                     if len(split(before + c)) == 1), _SPACE)
            kind = self.kind[points]
        return kind

    def encode_piece(self, text: str) -> list[int]:
        mapped = text.encode().decode("latin-1").translate(self.alphabet)
        return [t.id for t in self.tokenizer.model.tokenize(mapped)]

    def entries(self, keys: np.ndarray, piece) -> np.ndarray:
        """Entry numbers of sorted distinct keys; piece(i) is the text of keys[i]."""
        if len(self.keys) > CACHE_ENTRIES:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        missing = np.flatnonzero(~known)
        if len(missing):
            first = self.used
            for i in missing.tolist():
                ids = self.encode_piece(piece(i))
                if self.used == len(self.at):
                    self.at, self.count = (np.concatenate([x, np.zeros_like(x)])
                                           for x in (self.at, self.count))
                while self.filled + len(ids) > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
                self.at[self.used], self.count[self.used] = self.filled, len(ids)
                self.flat[self.filled:self.filled + len(ids)] = ids
                self.used += 1
                self.filled += len(ids)
            self.entry = np.insert(self.entry, at[missing], np.arange(first, self.used))
            self.keys = np.insert(self.keys, at[missing], keys[missing])
            at = np.searchsorted(self.keys, keys)
        return self.entry[at]

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk's texts end to end, and n+1 offsets into them."""
        whole = chunk.data.tobytes()
        if not any(t in whole for t in self.added):
            return self.encode_plain(chunk)
        # Added tokens are segments of their own; what stands between them is split by itself.
        found = [(o + m.start(), o + m.end()) for o, e in zip(chunk.offs[:-1].tolist(), chunk.offs[1:].tolist(), strict=True)
                 for m in self.find_added.finditer(whole[o:e])]
        segments = np.unique(np.concatenate((chunk.offs, np.array(found, np.int64).reshape(-1))))
        ids, offs = self.encode_plain(Chunk(chunk.first, chunk.data, segments))
        parts, at, count = [], 0, np.diff(offs)
        for start, end in found:
            i = int(np.searchsorted(segments, start))
            parts += [ids[at:offs[i]], np.array([self.added[whole[start:end]]], np.uint32)]
            at, count[i] = offs[i + 1], 1
        total = np.concatenate(([0], np.cumsum(count)))
        return np.concatenate([*parts, ids[at:]]), total[np.searchsorted(segments, chunk.offs)]

    def encode_plain(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without added tokens."""
        text = chunk.data.tobytes().decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        begin = np.flatnonzero((chunk.data & 0xC0) != 0x80)
        bounds = np.searchsorted(begin, chunk.offs)
        starts = self.piece_starts(points, bounds)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(chunk) + 1, np.int64)
        ends = np.append(starts[1:], len(points))
        key = span_hash(prefix_hash(points.astype(np.uint64) + np.uint64(1)), starts, ends)
        distinct, first, which = np.unique(key, return_index=True, return_inverse=True)
        entry = self.entries(distinct, lambda i: text[starts[first[i]]:ends[first[i]]])
        count = self.count[entry][which]
        total = np.concatenate(([0], np.cumsum(count)))
        ids = self.flat[np.repeat(self.at[entry][which] - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, bounds)]

    def piece_starts(self, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where pre-tokens start. A space before a run of letters, numbers or other
        characters belongs to the run; the last character of a run of white space
        stands alone otherwise; seven English endings stand alone after an apostrophe."""
        n = len(points)
        if n == 0:
            return np.zeros(0, np.int64)
        kind = self.kinds(points)
        first = np.zeros(n + 1, bool)               # of a text
        first[bounds] = True
        new = np.ones(n, bool)
        new[1:] = (kind[1:] != kind[:-1]) | first[1:n]
        last = np.append(new[1:], True)             # of its run
        is_space = kind == _SPACE
        after_blank = np.zeros(n, bool)
        after_blank[1:] = (points[:-1] == 0x20) & ~first[1:n]
        start = np.where(is_space, new | (last & ~first[1:]), new & ~after_blank)
        for i in np.flatnonzero((points == 0x27) & new & last & ~after_blank).tolist():
            stop = int(bounds[np.searchsorted(bounds, i, "right")]) if i < bounds[-1] else n
            tail = "".join(map(chr, points[i + 1:min(i + 3, stop)].tolist()))
            size = 1 if tail[:1] and tail[0] in "stmd" else 2 if tail in ("re", "ve", "ll") else 0
            if size:
                start[i + 1:i + 1 + size] = False
                if i + 1 + size < stop and kind[i + 1 + size] == _LETTER:
                    start[i + 1 + size] = True
        return np.flatnonzero(start)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker process's encoder of a tokenizer file."""
    return Encoder(path)
