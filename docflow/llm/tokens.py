"""Exact, cached tokenisation of many texts.

A text is cut where no token of the vocabulary's pre-tokeniser can cross, each
distinct piece goes through the tokenizers library once, and the ids of a text
are the ids of its pieces in order.  Pieces are told apart by 64-bit hashes, made
for a whole batch at once; only new ones become Python objects.  Texts for which
that cut is not proven safe (unusual white space, text that looks like a special
token) go through the library whole.
"""

from __future__ import annotations

import os
import zlib
from array import array
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa

from .kernels import CHUNK, LOWER, SPACE, mix, runs, span_hashes

#: Every white-space character but space and \n, by Python's set, which contains that of the library; with what
#: special tokens begin with and the separator below, it makes a text go through the library whole.
_SPACES = [c.encode() for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_ODD = [c for c in _SPACES if len(c) == 1] + [b"<|", b"\x02"]
_WIDE = [c for c in _SPACES if len(c) > 1]
_LEADS = sorted({c[:2] for c in _WIDE})
_DOUBLE = (b"  ", b"\n ", b" \n", b"\n\n")
_WORD_END = "\x02"
#: Byte-level vocabularies spell each byte as a visible character: itself, or 256 and up in order for the others.
_ITSELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_VISIBLE = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _ITSELF)}
#: ASCII punctuation but the apostrophe; the pre-tokenisers always part it from a letter before it.
_MARKS = np.zeros(256, bool)
_MARKS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
#: Second bytes, after 0xC3, of the letters from U+00C0 to U+00FF.
_ACCENTED = np.zeros(256, bool)
_ACCENTED[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
_held: dict[tuple[str, str], CachedTokenizer] = {}


def tokenizer(path: str, cut: str) -> CachedTokenizer:
    """One tokenizer, with its cache, for all tasks of a worker process."""
    if (path, cut) not in _held:
        _held[path, cut] = CachedTokenizer(path, cut)
    return _held[path, cut]


def vocabulary_path(name: str) -> str:
    """The place of a public vocabulary file; callers may give any path instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def release() -> None:
    """Drop what tokenizers hold in this worker process, and give unused memory back; operators that need it call this
    before they begin."""
    for tok in _held.values():
        tok.cache, tok.older = {}, {}
    pa.default_memory_pool().release_unused()


class CachedTokenizer:
    """``cut``: "space" when white space is dropped and never inside a token, "bytes" for byte-level BPE
    whose words carry one leading space.  Up to ``most`` pieces are held twice over: those used since the last
    ``most`` came, and those of the time before, which come back when they are met."""

    def __init__(self, path: str, cut: str, most: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.cut, self.most = cut, most
        # what stands between pieces that are encoded together: one pre-token of its own, never part of a piece
        self.sep, odd = ("\n", "\n") if cut == "bytes" else (f" {_WORD_END} ", _WORD_END)
        (self.sep_id,) = self.tok.encode(odd, add_special_tokens=False).ids
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self.cache: dict[int, bytes] = {}
        self.older: dict[int, bytes] = {}
        self.newline = self.whole(b"\n") if cut == "bytes" else b""

    def whole(self, text: bytes) -> bytes:
        return np.array(self.tok.encode(text.decode(), add_special_tokens=False).ids, self.dtype).tobytes()

    def safe(self, text: bytes) -> bool:
        """Whether the ids of a text are those of its words, each with the one space or line break before it."""
        for c in _ODD:
            if c in text:
                return False
        if not text.isascii():
            for c in _LEADS:
                if c in text and any(w in text for w in _WIDE):
                    return False
        if self.cut == "space":
            return True
        for c in _DOUBLE:
            if c in text:
                return False
        return text[0] not in b" \n" and text[-1] not in b" \n"

    def plain(self, word: str) -> bool:
        """Whether a word is letters that neither the normaliser nor a newer Unicode table could change."""
        same = self.cut == "bytes" or (word == word.lower() and is_normalized("NFC", word))
        return word.isalpha() and max(word) < "\u0250" and same

    def learn(self, new: set[bytes], group: int = 256) -> dict[bytes, bytes]:
        """The ids of pieces.  A word of Latin letters alone is one pre-token, which the model takes as it is; the
        others are encoded in groups, with a separator between them."""
        cache: dict[bytes, bytes] = {}
        tokenize = self.tok.model.tokenize
        code, width, spaced = "I" if self.dtype.itemsize == 4 else "H", self.dtype.itemsize, self.cut == "bytes"
        pieces = []
        for p in new:
            word = p[1:] if spaced and p[:1] == b" " else p
            if word.isalpha() and (spaced or word.islower()):
                spelt = p.decode() if word is p else "\u0120" + word.decode()
            elif self.plain(word.decode()):
                spelt = p.decode("latin-1").translate(_VISIBLE)
            else:
                pieces.append(p)
                continue
            cache[p] = array(code, [x.id for x in tokenize(spelt)]).tobytes()
        sep = self.sep.encode()
        groups = [pieces[i : i + group] for i in range(0, len(pieces), group)]
        for part, e in zip(groups, self.tok.encode_batch_fast([sep.join(g).decode() for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            ends = np.flatnonzero(ids == self.sep_id)
            if len(ends) != len(part) - 1:
                raise ValueError("a separator token is missing")
            raw = ids.tobytes()
            ends = ends * width
            cache.update(zip(part, [raw[i:j] for i, j in zip([0, *(ends + width).tolist()], [*ends.tolist(), len(raw)])]))
        return cache

    def encode(self, texts: list[bytes | None], end: int | None = None) -> list[bytes]:
        """Little-endian ids of each UTF-8 text, in ``self.dtype``, with ``end`` after them; null counts as empty."""
        tail = b"" if end is None else np.array([end], self.dtype).tobytes()
        out: list[bytes] = []
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (size < CHUNK or last == first):
                size += len(texts[last] or b"")
                last += 1
            own = [t or b"" for t in texts[first:last]]
            kind = [bool(t) and self.safe(t) for t in own]
            found = iter(self._batch([t for t, k in zip(own, kind) if k]))
            out += [(next(found) if k else self.whole(t) if t else b"") + tail for t, k in zip(own, kind)]
            first = last
        return out

    def _batch(self, texts: list[bytes]) -> list[bytes]:
        """The ids of safe texts."""
        if not texts:
            return []
        raw = b"".join(texts)
        data = np.frombuffer(raw, np.uint8)
        sizes = np.array([len(t) for t in texts])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        spaced = self.cut == "bytes"
        if not spaced:  # lower case first where that cannot change what the normaliser does
            data = np.where(np.repeat([t.isascii() for t in texts], sizes), LOWER[data], data)
            raw = data.tobytes()
        starts, ends = runs(~SPACE[data], offsets)
        before = np.zeros(len(starts), np.uint8)
        if spaced and len(starts):  # 0: a text's first word, 32: after a space, 10: after a line break
            before = data[starts - 1]
            before[np.searchsorted(starts, offsets[:-1])] = 0
        starts, ends, before = _part_marks(data, starts, ends, before)
        h = mix(span_hashes(data, starts, ends) + before.astype(np.uint64))
        units, at, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.cache) > self.most:
            self.older, self.cache = self.cache, {}
        keys = units.tolist()
        ids = list(map(self.cache.get, keys))
        lacking = []
        for i in [i for i, x in enumerate(ids) if x is None]:
            if (old := self.older.get(keys[i])) is None:
                lacking.append(i)
            else:
                ids[i] = self.cache[keys[i]] = old
        if lacking:
            spots = at[lacking]
            words = [raw[a:b] for a, b in zip(starts[spots].tolist(), ends[spots].tolist())]
            marks = before[spots].tolist()
            pieces = [b" " + w if m == 32 else w for w, m in zip(words, marks)]
            learnt = self.learn(set(pieces))
            for i, p, m in zip(lacking, pieces, marks):
                ids[i] = self.cache[keys[i]] = self.newline + learnt[p] if m == 10 else learnt[p]
        width = self.dtype.itemsize
        flat = np.frombuffer(b"".join(ids), self.dtype)
        n = np.array(list(map(len, ids)), np.int64) // width
        source = np.cumsum(n) - n
        counts = n[which]
        ends_at = np.cumsum(counts)
        tokens = flat[np.arange(int(ends_at[-1]) if len(counts) else 0) + np.repeat(source[which] - (ends_at - counts), counts)].tobytes()
        cuts = np.concatenate([[0], ends_at])[np.searchsorted(starts, offsets)] * width
        return [tokens[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def _part_marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words that end in punctuation after a letter as two: far fewer are then new."""
    marks = _MARKS[data]
    which = np.flatnonzero(marks[ends - 1]) if len(ends) else np.zeros(0, np.int64)
    if not len(which):
        return starts, ends, before
    other = np.flatnonzero(~marks)
    at = np.searchsorted(other, ends[which]) - 1
    last = np.where(at >= 0, other[np.maximum(at, 0)], -1) if len(other) else np.full(len(which), -1)
    letter = _LETTERS[data[last]] | ((data[last - 1] == 0xC3) & _ACCENTED[data[last]])
    good = (last >= starts[which]) & letter
    which, cut = which[good], last[good] + 1
    heads = ends.copy()
    heads[which] = cut
    return np.insert(starts, which + 1, cut), np.insert(heads, which + 1, ends[which]), np.insert(before, which + 1, 0)


def crc32_u4(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
