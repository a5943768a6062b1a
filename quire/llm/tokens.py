"""Byte-level BPE of whole texts with the tokenizers library, one library call per new unit.

A text is cut only where its pre-tokenizer's pattern always ends a token:
between a letter and a digit or punctuation, before a space that a word follows,
around a lone newline.  Units are looked up by a 64-bit hash; the library encodes
those not seen before.  Characters outside ASCII and Latin-1 letters have no cut
next to them but before a following space, so that no rule rests on their class.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .hashing import HashIndex, range_hashes
from .store import HELD

LETTER, DIGIT, PUNCT, SPACE, WHITE, OTHER, EDGE = range(7)
_CLASS = np.full(256, OTHER, np.uint8)
for _b in range(33, 127):
    _CLASS[_b] = LETTER if chr(_b).isalpha() else DIGIT if chr(_b).isdigit() else PUNCT
_CLASS[9:14], _CLASS[32] = WHITE, SPACE
#: Units that are one token of the pattern, whatever stands beside them.
_SIMPLE = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-&(-/:-@\[-`{-~]+)|\n")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins that byte-level BPE vocabularies use for bytes, as a table for str.translate."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(moved)}


def cuts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Positions in ``data`` at which a unit begins; ``edges``: positions of the bytes between documents."""
    c = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    follow = data[lead + 1]
    lead = lead[(follow >= 0x80) & (follow <= 0xBF) & (follow != 0x97) & (follow != 0xB7)]
    c[lead] = c[lead + 1] = LETTER
    c[edges] = EDGE
    before, after = np.roll(c, 1), np.roll(c, -1)
    before[0] = after[-1] = EDGE
    known, known_before = c <= PUNCT, before <= PUNCT
    cut = (c == SPACE) & (after <= PUNCT)
    cut |= known & known_before & (c != before) & (np.roll(data, 1) != 39)
    cut |= (c == PUNCT) & (before <= DIGIT)
    cut |= ((c == SPACE) | (c == WHITE)) & known_before
    two_before = np.roll(before, 1)
    two_before[0] = EDGE
    cut |= known & (before == WHITE) & ((two_before <= PUNCT) | (two_before == EDGE))
    cut |= (before == EDGE) | (c == EDGE)
    return np.flatnonzero(cut)


class Encoder:
    """Texts to unsigned 32-bit ids; null counts as the empty text.

    ``max_units`` and ``max_ids`` bound what is remembered between batches (about 20
    and 4 bytes each, in arrays that never grow), not what is encoded.
    """

    LONGEST_KEPT = 64

    def __init__(self, path: str, max_units: int = 1_000_000, max_ids: int = 4_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # such strings inside a text are ordinary text
        kind = (json.loads(self.tokenizer.to_str()).get("pre_tokenizer") or {}).get("type")
        if kind != "ByteLevel":
            raise ValueError(f"{path}: a byte-level BPE is needed, not {kind}")
        self.split, self.whole = self.tokenizer.pre_tokenizer, pre_tokenizers.Sequence([])
        self.letters = _byte_letters()
        self.vocab = self.tokenizer.get_vocab_size()
        self.max_units, self.max_ids = max_units, max_ids
        self.flat, self.at, self.n_ids = np.zeros(max_ids, np.uint32), np.zeros(max_units, np.int32), np.zeros(max_units, np.int32)
        self._forget()

    def _forget(self) -> None:
        self.index = HashIndex((2 * self.max_units).bit_length())
        self.n_flat = 0

    def _ids(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units one after another, and how many each has."""
        counts, out = np.zeros(len(units), np.int64), [np.zeros(0, np.uint32)] * len(units)
        plain = [k for k, u in enumerate(units) if _SIMPLE.fullmatch(u)]
        self.tokenizer.pre_tokenizer = self.whole
        for i in range(0, len(plain), 512):
            rows = plain[i : i + 512]
            e = self.tokenizer.encode([units[k].decode("latin1").translate(self.letters) for k in rows], is_pretokenized=True, add_special_tokens=False)
            ids, n = np.array(e.ids, np.uint32), np.bincount(np.array(e.word_ids, np.int64), minlength=len(rows))
            for k, part in zip(rows, np.split(ids, np.cumsum(n)[:-1]), strict=True):
                out[k] = part
            counts[rows] = n
        self.tokenizer.pre_tokenizer = self.split
        rest = sorted(set(range(len(units))) - set(plain))
        for i in range(0, len(rest), 512):
            for k, e in zip(rest[i : i + 512], self.tokenizer.encode_batch([units[k].decode("utf-8") for k in rest[i : i + 512]], add_special_tokens=False), strict=True):
                out[k] = np.array(e.ids, np.uint32)
                counts[k] = len(e.ids)
        return np.concatenate(out) if out else np.zeros(0, np.uint32), counts

    def _learn(self, keys: np.ndarray, units: list[bytes]) -> None:
        """Remembers as many of the units as there is room for."""
        room = min(self.max_units - self.index.n, len(units))
        ids, n = self._ids(units[:room])
        while room and self.n_flat + len(ids) > self.max_ids:
            ids, n, room = ids[: len(ids) - int(n[room // 2 :].sum())], n[: room // 2], room // 2
        first = self.index.n
        self.flat[self.n_flat : self.n_flat + len(ids)] = ids
        self.at[first : first + room] = self.n_flat + np.cumsum(n) - n
        self.n_ids[first : first + room] = n
        self.n_flat += len(ids)
        self.index.add(keys[:room], np.arange(first, first + room, dtype=np.int32))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        if self.index.n >= self.max_units or self.n_flat >= self.max_ids - 1000:
            self._forget()
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(b"\0" + b"\0".join(raw) + b"\0", np.uint8)
        sizes = np.array([len(r) for r in raw], np.int64)
        edges = np.concatenate(([0], np.cumsum(sizes + 1)))
        starts = cuts(data, edges)
        ends = np.append(starts[1:], len(data))
        is_edge = np.zeros(len(data), bool)
        is_edge[edges] = True
        real = ~is_edge[starts]
        starts, ends = starts[real], ends[real]
        rows, extra = np.empty(0, np.int32), []
        if len(starts):
            keys = range_hashes(data, starts, ends)
            rows = self.index.find(keys)
            new = np.flatnonzero(rows < 0)
            if len(new):
                fresh, first = np.unique(keys[new], return_index=True)
                first = new[first]
                long = ends[first] - starts[first] > self.LONGEST_KEPT
                buf = data.tobytes()
                short = first[~long]
                self._learn(fresh[~long], [buf[a:b] for a, b in zip(starts[short].tolist(), ends[short].tolist(), strict=True)])
                rows[new] = self.index.find(keys[new])
                extra = np.flatnonzero(rows < 0).tolist()  # long units, and those without room, are encoded each time, by their bytes
        at, n, flat = self.at[rows].astype(np.int64), self.n_ids[rows].astype(np.int64), self.flat
        if extra:
            buf = data.tobytes()
            ids, counts = self._ids([buf[starts[k] : ends[k]] for k in extra])
            at[extra], n[extra] = self.n_flat + np.cumsum(counts) - counts, counts
            flat = np.concatenate((flat[: self.n_flat], ids))
        upto = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.repeat(at - upto[:-1], n) + np.arange(upto[-1])] if len(n) else np.zeros(0, np.uint32)
        unit_of_edge = np.searchsorted(starts, edges)
        return ids, np.diff(upto[unit_of_edge])


def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary, kept until the worker turns to tasks that do not hold "encoder"."""
    kept = HELD.setdefault("encoder", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def in_slices(n_bytes: list[int], limit: int):
    """Ranges of consecutive rows of about ``limit`` bytes; a longer row is a range of its own."""
    start, total = 0, 0
    for i, n in enumerate(n_bytes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(n_bytes):
        yield start, len(n_bytes)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 18):
    """(slice of the batch, its texts): only one slice's texts are Python strings at a time."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for a, b in in_slices(sizes, limit):
        yield batch.slice(a, b - a), texts.slice(a, b - a).to_pylist()


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text's."""
    return np.insert(ids, np.cumsum(counts), end_id).astype("<u4"), counts + 1
