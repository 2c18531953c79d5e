"""Pre-tokens of whole texts, found with array operations and exact for two public vocabularies.

A tokenizer of the BPE kind works on each pre-token alone, so the tokens of a text are
those of its pre-tokens. Texts of ASCII and of the Latin letters U+00C0 to U+00FF are
split with byte masks; any other text, and any text that holds a special token's
string, is split by the library itself. Both ways feed the same tables.
"""

from __future__ import annotations

import re

import numpy as np
import tokenizers

from millrace.llm.hashing import HashTable, span_hashes

#: Byte classes: white space, letter, digit, other; the last ends the fast way.
SPACE, LETTER, DIGIT, OTHER, RARE = range(5)
_CLASS = np.full(256, RARE, np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0D]] = SPACE
_CLASS[0x21:0x7F] = OTHER
_CLASS[0x30:0x3A] = DIGIT
_CLASS[0x41:0x5B] = LETTER
_CLASS[0x61:0x7B] = LETTER
_CLASS[0x80:0xC0] = LETTER  # only after 0xC3, see _plain
_CLASS[0xC3] = LETTER
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
#: Byte-level vocabularies write a byte that prints as itself, and the others as letters from U+0100 on.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTER_OF = {b: b if b in _PRINTS else 256 + sum(x not in _PRINTS for x in range(b)) for b in range(256)}


class Splitter:
    """Splits texts as ``byte`` (a space belongs to the pre-token that follows it) or
    ``word`` (lower case, digits one by one, white space dropped) vocabularies do."""

    def __init__(self, path: str):
        self.tok = tokenizers.Tokenizer.from_file(path)
        self.lower = self.tok.normalizer is not None
        added = self.tok.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.marks = [s.encode() for s in self.special]

    def _plain(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Which texts the byte masks split exactly."""
        bad = kind == RARE
        high = data >= 0x80
        if high.any():
            after = np.zeros(len(data), bool)
            after[1:] = data[:-1] == 0xC3
            bad |= high & (data != 0xC3) & ~after  # another lead byte's tail
            bad |= after & ((data == 0x97) | (data == 0xB7))  # the signs among the letters
        n = np.concatenate([[0], np.cumsum(bad)])
        plain = n[offsets[1:]] == n[offsets[:-1]]
        raw = data.tobytes() if self.marks else b""
        for mark in self.marks:
            at = raw.find(mark)
            while at >= 0:
                plain[np.searchsorted(offsets, at, "right") - 1] = False
                at = raw.find(mark, at + 1)
        return plain

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends, plain): the pre-tokens of the texts that are plain."""
        kind = _CLASS[data]
        plain = self._plain(data, offsets, kind)
        if self.lower:
            data = data.copy()
            data[_UPPER[data]] += 32
            tail = np.zeros(len(data), bool)
            tail[1:] = data[:-1] == 0xC3
            data[tail & (data >= 0x80) & (data <= 0x9E)] += 32
        n = len(data)
        if not n:
            return data, np.zeros(0, np.int64), np.zeros(0, np.int64), plain
        edge = np.zeros(n + 1, bool)  # a text begins here, or the data end
        edge[offsets] = True
        first = edge[:-1]
        before = np.empty_like(kind)
        before[0] = RARE
        before[1:] = kind[:-1]
        start = (kind != before) | first
        white = kind == SPACE
        quote = np.flatnonzero((data == 0x27) & (first | (before != OTHER)))
        quote = quote[quote + 1 < n]
        if self.lower:
            start |= kind == DIGIT
        else:
            joined = (data == 0x20) & white
            joined[:-1] &= ~white[1:] & ~edge[1:-1]
            joined[-1] = False
            then = np.zeros(n, bool)
            then[1:] = joined[:-1]
            last = white & ~joined  # the last of a run that text follows stands alone
            last[:-1] &= ~white[1:] & ~edge[1:-1]
            last[-1] = False
            start = (start & ~then) | joined | last
            quote = quote[~joined[quote - 1] | first[quote]] if len(quote) else quote
        if len(quote):
            d = np.concatenate([data, np.zeros(3, np.uint8)])
            e = np.concatenate([edge, np.ones(3, bool)])
            a, b = d[quote + 1], d[quote + 2]
            one = ~e[quote + 1] & np.isin(a, np.frombuffer(b"stmd", np.uint8))
            two = ~e[quote + 1] & ~e[quote + 2] & (((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C)))
            for at, size in ((quote[one], 2), (quote[two & ~one], 3)):
                start[at + 1] = False
                rest = at + size
                rest = rest[rest < n]
                # what follows begins a pre-token of its own, but for a space that already leads one
                start[rest] |= True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], n)
        keep = plain[np.searchsorted(offsets, starts, "right") - 1]
        if self.lower:
            keep &= kind[starts] != SPACE
        return data, starts[keep], ends[keep], plain

    def parts(self, text: str) -> list[bytes | int]:
        """Pre-tokens of one text as the library finds them, special tokens as their ids."""
        out: list[bytes | int] = []
        for x in self.cut.split(text) if self.cut else [text]:
            if x in self.special:
                out.append(self.special[x])
            elif x:
                if self.tok.normalizer is not None:
                    x = self.tok.normalizer.normalize_str(x)
                out += [p.encode() for p in self._pieces(x)]
        return out

    def _pieces(self, text: str) -> list[str]:
        """The library's own split; offsets give the raw text of each pre-token."""
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def ids(self, pretoken: bytes) -> list[int]:
        """Token ids of one pre-token."""
        return [t.id for t in self.tok.model.tokenize(pretoken.decode("latin-1").translate(_LETTER_OF))]


class Vocabulary:
    """Ids of the pre-tokens seen so far in this worker: at most ``most`` of them are kept."""

    def __init__(self, splitter: Splitter, most: int = 1_500_000):
        self.splitter, self.most = splitter, most
        self.clear()

    def clear(self) -> None:
        self.table, self.pool, self.used = HashTable(), np.zeros(1 << 16, np.int32), 0
        self.at, self.size, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0

    def _put(self, ids: list[int]) -> None:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.int32)])
        if self.n == len(self.at):
            self.at, self.size = np.concatenate([self.at, self.at]), np.concatenate([self.size, self.size])
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[self.n], self.size[self.n] = self.used, len(ids)
        self.used += len(ids)
        self.n += 1

    def index(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where each pre-token stands in the pool; new ones are encoded, each once."""
        if self.n > self.most:
            self.clear()
        found = self.table.find(hashes)
        lost = np.flatnonzero(found < 0)
        if len(lost):
            new, where = np.unique(hashes[lost], return_index=True)
            base = self.n
            for k in lost[where]:
                self._put(self.splitter.ids(data[starts[k] : ends[k]].tobytes()))
            self.table.add(new, np.arange(base, base + len(new)))
            found[lost] = self.table.find(hashes[lost])
        return found

    def gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these pre-tokens in order, and how many each has."""
        size = self.size[index].astype(np.int64)
        total = int(size.sum())
        ids = self.pool[np.repeat(self.at[index] - (np.cumsum(size) - size), size) + np.arange(total)]
        return ids, size


def of_parts(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens given as bytes, in the form of spans: (bytes, starts, ends, hashes)."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
    starts = ends - np.array([len(p) for p in parts], np.int64)
    return data, starts, ends, span_hashes(data, starts, ends)
