"""Texts to token ids, by the tokenizers library with a cache of what it gave for each piece of text.

Byte-level pre-tokenisation never joins a non-space to a following space, nor an ASCII letter to a following ASCII mark, so a
text with single spaces may be cut there and the pieces encoded apart: the ids are the same. Texts where that might not hold
(two spaces in a row, white space before a final space, or the string of an added token such as <|endoftext|>, which the library
gives its own id) are encoded whole. Pieces repeat by Zipf's law, so most are in the
cache: a hash table of two ways in arrays, looked up for a whole slice of texts at once. A hit must agree in a 64-bit hash of the piece and
in another of its length and its first and last eight bytes.
"""

from __future__ import annotations

import os
import zlib
from array import array

import numpy as np
import pyarrow as pa

from keelson.llm.common import HELD, hash_spans, mix

_ENCODERS: dict[str, Encoder] = {}
#: Buckets of two cached pieces each, of 21 bytes; and ids of pieces, at which those that no bucket names any more go: so a worker's memory is bounded.
BUCKETS, IDS = 1 << 19, 8 << 20
#: Longer pieces are encoded but not kept.
LONGEST = 64

_BYTES = np.arange(256)
_ALPHA = np.array([chr(c).isalpha() and c < 128 for c in range(256)])
_MARK = np.array([32 < c < 127 and not chr(c).isalnum() for c in range(256)])


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that are one token wherever they stand, white space around them perhaps included.
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self._clear()

    def _clear(self) -> None:
        self.keys, self.checks = np.zeros(2 * BUCKETS, np.uint64), np.zeros(2 * BUCKETS, np.uint64)
        self.at, self.n = np.zeros(2 * BUCKETS, np.int32), np.zeros(2 * BUCKETS, np.uint8)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        HELD["tokens"] = _ENCODERS.clear
        return _ENCODERS[path]

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, counts = array("I"), np.zeros(len(texts), np.int32)
        for a in range(0, len(texts), 20_000):
            for k, e in enumerate(self.tokenizer.encode_batch_fast(texts[a : a + 20_000], add_special_tokens=False), a):
                ids = e.ids
                counts[k] = len(ids)
                flat.extend(ids)
        return np.frombuffer(flat, np.uint32).copy() if len(flat) else np.zeros(0, np.uint32), counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and how many each has; null is empty."""
        raw = [(t or "").encode() for t in texts.to_pylist()]
        whole = [k for k, t in enumerate(raw) if b"  " in t or (t[-1:] == b" " and t.decode()[-2:-1].isspace()) or any(a in t for a in self.added)]
        whole_ids = dict(zip(whole, self._split(*self._encoded([raw[k].decode() for k in whole])), strict=True)) if whole else {}
        for k in whole:
            raw[k] = b""
        sizes = np.array([len(t) for t in raw], np.int64)
        buf = np.frombuffer(b"".join(raw), np.uint8)
        ids, counts = self._pieces(buf, sizes) if len(buf) else (np.zeros(0, np.uint32), np.zeros(len(raw), np.int64))
        if whole_ids:
            parts = self._split(ids, counts)
            for k, v in whole_ids.items():
                parts[k] = v
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, counts

    @staticmethod
    def _split(flat: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        return np.split(flat, np.cumsum(counts)[:-1]) if len(counts) else []

    def _pieces(self, buf: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = buf == 32
        cut[1:] |= _MARK[buf[1:]] & _ALPHA[buf[:-1]]
        starts_of = np.cumsum(sizes) - sizes
        cut[starts_of[sizes > 0]] = True
        start = np.flatnonzero(cut)
        size = np.diff(start, append=len(buf))
        keys, first, last = hash_spans(buf, start, size)
        with np.errstate(over="ignore"):
            checks = mix(first ^ mix(last + (size.astype(np.uint64) << np.uint64(56))))
        at, n = self._lookup(keys, checks)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            order = np.lexsort((checks[missing], keys[missing]))
            k, c = keys[missing][order], checks[missing][order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
            one, back = missing[order[new]], np.empty(len(missing), np.int64)
            back[order] = np.cumsum(new) - 1
            data = buf.tobytes()
            extra, extra_n = self._encoded([data[a : a + z].decode() for a, z in zip(start[one].tolist(), size[one].tolist(), strict=True)])
            extra_at = self._held(extra) + np.cumsum(extra_n) - extra_n
            at[missing], n[missing] = extra_at[back], extra_n[back]
            short = size[one] <= LONGEST
            self._keep(keys[one][short], checks[one][short], extra_at[short], extra_n[short])
        total = np.cumsum(n)
        ids = self.ids[np.arange(total[-1]) + np.repeat(at - (total - n), n)]
        if self.used > IDS:
            self._compact()
        doc_piece = np.searchsorted(start, starts_of)  # pieces before each text
        per = np.diff(np.append(doc_piece, len(start)))
        before = np.concatenate([[0], total])
        counts = before[doc_piece + per] - before[doc_piece]
        return ids, counts.astype(np.int64)

    def _compact(self) -> None:
        live = np.flatnonzero(self.n)
        n, at = self.n[live].astype(np.int64), self.at[live].astype(np.int64)
        ends = np.cumsum(n)
        if not len(live) or ends[-1] > IDS // 2 + IDS // 4:
            self._clear()
            return
        kept = self.ids[np.arange(ends[-1]) + np.repeat(at - (ends - n), n)]
        self.at[live] = ends - n
        self.ids, self.used = kept, len(kept)

    def _held(self, ids: np.ndarray) -> int:
        """Puts ids behind those that are there, and says where."""
        at, need = self.used, self.used + len(ids)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids[:at], np.zeros(max(need, at + (1 << 20)) - at, np.uint32)])
        self.ids[at:need] = ids
        self.used = need
        return at

    def _lookup(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, n = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        slot = ((keys & np.uint64(BUCKETS - 1)) << np.uint64(1)).astype(np.int64)
        for way in (0, 1):
            own = slot + way
            hit = np.flatnonzero((self.keys[own] == keys) & (self.checks[own] == checks) & (self.n[own] > 0))
            at[hit], n[hit] = self.at[own[hit]], self.n[own[hit]]
        return at, n

    def _keep(self, keys: np.ndarray, checks: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        """Each piece takes a free way of its bucket, else one by its hash; of several for one place the last stays, in all arrays."""
        slot = ((keys & np.uint64(BUCKETS - 1)) << np.uint64(1)).astype(np.int64)
        way = np.where(self.n[slot] == 0, 0, np.where(self.n[slot + 1] == 0, 1, (keys >> np.uint64(63)).astype(np.int64)))
        slot += way
        self.keys[slot], self.checks[slot], self.at[slot], self.n[slot] = keys, checks, at, n


def crc(data, value: int = 0) -> int:
    return zlib.crc32(data, value) & 0xFFFFFFFF
