"""Exact tokenizer encoding with a piece cache, for the operators that need ids or their number.

A text is cut where the byte-level pre-tokenizer cuts in any case: before a single space, or around a
single newline, that stands between two non-space characters. Arrow finds the distinct pieces of a batch;
each is encoded once by the tokenizers library and kept in a cache of bounded size, and numpy puts the
ids of the pieces together. Text that holds characters the cut can't vouch for goes to the library whole.
"""

from __future__ import annotations

import codecs
import os
import re
from array import array
from itertools import compress

import numpy as np

#: Characters that one Unicode version or another counts as white space besides Python's own.
_DOUBT = "᠎​﻿"
_LINE, _HEAD = "￾", "￿"  # noncharacters before a piece: after a safe newline; first of its text
SAFE_SPACE = re.compile(f"(?<=[^\\s{_DOUBT}]) (?=[^\\s{_DOUBT}])")
_SAFE_NEWLINE = re.compile(f"(?<=[^\\s{_DOUBT}])\n(?=[^\\s{_DOUBT}])")
_EDGES_SAFE = re.compile(f"[^\\s{_DOUBT}](?:.*[^\\s{_DOUBT}])?", re.S)
#: A run of letters, then ASCII punctuation that joins nothing to it: two tokens' texts at most.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@[-`{-~]*)")


def _byte_chars() -> str:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return "".join(chars[b] for b in range(256))


class PieceEncoder:
    """``encode(texts)`` gives what the library's ``encode(text, add_special_tokens=False).ids`` gives.

    Only for byte-level BPE files without prefix space, whose vocabulary fits 16 bits. A piece is kept
    without the space before it; ``_LINE`` before it stands for a newline and no space, ``_HEAD`` for nothing.
    """

    def __init__(self, path: str, cached_pieces: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 65_536:
            raise ValueError("ids don't fit 16 bits")
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.chars, self.limit = self.tokenizer.model, _byte_chars(), cached_pieces
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        """The cache: number of each piece; ids of all pieces in a row, with their ends; pieces met again."""
        self.number: dict[str, int] = {}
        self.pool, self.ends, self.unsafe, self.tails = array("H"), array("q", [0]), array("b"), {}
        self.again = np.zeros(0, bool)

    def _keep(self, key: str, ids: list[int] | None) -> None:
        """``ids``: None where the piece's edges make the cut unsafe."""
        self.number[key] = len(self.number)
        self.pool.extend(ids or ())
        self.ends.append(len(self.pool))
        self.unsafe.append(ids is None)

    def _shrink(self) -> None:
        """Drops the pieces that were met in one batch only; all of them, if those are too few."""
        again = np.append(self.again, np.zeros(len(self.number) - len(self.again), bool))
        if again.sum() >= self.limit // 2:
            self._clear()
            return
        sizes = np.diff(np.frombuffer(self.ends, np.int64))
        pool = np.frombuffer(self.pool, np.uint16)[np.repeat(again, sizes)] if len(self.pool) else np.zeros(0, np.uint16)
        unsafe, kept = np.frombuffer(self.unsafe, np.int8)[again], compress(self.number, again.tolist())  # keys lie in the order of their numbers
        number = {key: n for n, key in enumerate(kept)}
        self._clear()
        self.number, self.pool, self.unsafe = number, array("H", pool.tobytes()), array("b", unsafe.tobytes())
        self.ends = array("q", np.append(0, np.cumsum(sizes[again])).tobytes())

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _word(self, shown: str) -> list[int]:
        """One token's text of the pre-tokenizer, with its leading space if any: the merges alone."""
        mapped = codecs.charmap_decode(shown.encode(), "strict", self.chars)[0]
        return [t.id for t in self.model.tokenize(mapped)]

    def _fill(self, keys: list[str]) -> None:
        number, pool, ends, odd = self.number, self.pool, self.ends, []
        plain = _PLAIN.fullmatch
        for key in keys:
            found = plain(key)
            if found is None:
                odd.append(key)
                continue
            core, tail = found.groups()
            if tail and any(s in key for s in self.special):
                odd.append(key)
                continue
            if (n := number.get(core)) is None:
                n = number[core] = len(number)
                pool.extend(self._word(" " + core))
                ends.append(len(pool))
            if tail:
                if tail not in self.tails:
                    if len(self.tails) > 10_000:
                        self.tails = {}
                    self.tails[tail] = array("H", self._word(tail))
                number[key] = len(number)
                pool.extend(pool[ends[n] : ends[n + 1]] + self.tails[tail])
                ends.append(len(pool))
        self.unsafe.extend(bytes(len(number) - len(self.unsafe)))
        safe = [k for k in odd if (_EDGES_SAFE.fullmatch(k[-1:]) if k[:1] == _HEAD and len(k) > 1 else _EDGES_SAFE.fullmatch(k[1:] if k[:1] == _LINE else k) and k != _HEAD)]
        shown = [k[1:] if k[0] == _HEAD else "\n" + k[1:] if k[0] == _LINE else " " + k for k in safe]
        for key, ids in zip(safe, self._whole(shown), strict=True):
            self._keep(key, ids)
        for key in set(odd).difference(safe):
            self._keep(key, None)

    def _pieces(self, texts: list[str]):
        """Numbers of the pieces of texts, in order, and where each text's pieces begin."""
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " " + _LINE), " ")
        return self._numbers(lists.flatten()), lists.offsets.to_numpy()

    def _numbers(self, flat, may_shrink: bool = True) -> np.ndarray:
        coded = flat.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if may_shrink and len(self.number) > self.limit:
            self._shrink()
        found = list(map(self.number.get, distinct))
        before = len(self.number)
        if None in found:
            self._fill([k for k, n in zip(distinct, found, strict=True) if n is None])
            found = list(map(self.number.get, distinct))
        own = np.array(found, np.int64)
        self.again = np.append(self.again, np.zeros(before - len(self.again), bool))
        self.again[own[own < before]] = True
        return own[coded.indices.to_numpy()]

    def _parts(self, texts: list[str]):
        """For every text, either the numbers of its pieces or None: then it must go to the library whole."""
        import pyarrow as pa

        marked = [_HEAD + t for t in texts]
        numbers, starts = self._pieces(marked)
        bad = np.add.reduceat(np.frombuffer(self.unsafe, np.int8)[numbers], starts[:-1]) > 0  # an array can't grow while a view of it lives
        parts = [numbers[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        again = [i for i in np.flatnonzero(bad).tolist() if texts[i]]
        for i in np.flatnonzero(bad).tolist():
            parts[i] = None if texts[i] else numbers[:0]
        for i, t in enumerate(texts):
            if _LINE in t or _HEAD in t:
                parts[i] = None
        again = [i for i in again if _LINE not in texts[i] and _HEAD not in texts[i]]
        if again:  # texts with runs of white space: only the spaces that the pattern finds safe cut
            cut = [SAFE_SPACE.split(_SAFE_NEWLINE.sub(" " + _LINE, marked[i])) for i in again]
            more, at = self._numbers(pa.array([p for c in cut for p in c], pa.large_string()), may_shrink=False), 0
            unsafe = np.frombuffer(self.unsafe, np.int8)
            for i, c in zip(again, cut, strict=True):
                own = more[at : at + len(c)]
                at += len(c)
                parts[i] = None if unsafe[own].any() else own
        return parts

    def encode(self, texts: list[str], end: int | None = None) -> list[np.ndarray]:
        """16-bit ids of each text, and ``end`` after them if given."""
        ids, ends = self.encode_row(texts, end)
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode_row(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids end."""
        if not texts:
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        parts = self._parts(texts)
        whole = [i for i, p in enumerate(parts) if p is None]
        ends = np.frombuffer(self.ends, np.int64)
        pool = np.frombuffer(self.pool, np.uint16) if len(self.pool) else np.zeros(0, np.uint16)
        numbers = np.concatenate([p for p in parts if p is not None] or [np.zeros(0, np.int64)])
        sizes = ends[numbers + 1] - ends[numbers]
        stops = np.cumsum(sizes)
        ids = pool[np.repeat(ends[numbers] - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)]
        del ends, pool
        of_text = np.concatenate([[0], stops])[np.cumsum([0, *(0 if p is None else len(p) for p in parts)])].tolist()
        last = [] if end is None else [np.array([end], np.uint16)]
        own = dict(zip(whole, self._whole([texts[i] for i in whole]), strict=True))
        out = [[np.array(own[i], np.uint16) if i in own else ids[a:b], *last] for i, (a, b) in enumerate(zip(of_text[:-1], of_text[1:], strict=True))]
        return np.concatenate([x for pair in out for x in pair] or [ids]), np.cumsum([sum(map(len, pair)) for pair in out])

    def count(self, texts: list[str]) -> list[int]:
        """The number of ids of each text."""
        if not texts:
            return []
        parts = self._parts(texts)
        ends = np.frombuffer(self.ends, np.int64)
        out = [0 if p is None else int((ends[p + 1] - ends[p]).sum()) for p in parts]
        del ends
        whole = [i for i, p in enumerate(parts) if p is None]
        for i, own in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            out[i] = len(own)
        return out


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def release() -> None:
    """Drops this worker's encoders and their caches; tasks that don't encode call it, since workers outlive a stage."""
    _encoders.clear()
