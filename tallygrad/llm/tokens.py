"""Exact byte-level BPE encoding of whole Arrow batches with the tokenizers library.

The pre-tokenizer never lets a piece run from a non-space character into the
white space behind it, nor from a letter into punctuation, so a text may be cut
there: the ids of the text are the ids of these units in order. Each distinct unit of a batch is encoded once, and units met before
are taken from a memory of bounded size. Lengths come from the vocabulary: a
byte-level encoding loses nothing, so the ids of many units encoded together
can be split again by their bytes.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: Units remembered per generation by one worker; two generations are held.
MEMORY_UNITS = 300_000
#: Bytes of unseen units joined into one text for the library.
JOINED_BYTES = 100_000
#: Longer units are encoded anew each time they are met.
LONGEST_REMEMBERED = 64

_SPACES = (b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b" ")

# The white space of ASCII, and all other characters that Unicode counts, or once counted, as white space.
ASCII_SPACE = b"\t\n\x0b\x0c\r "
WIDE_SPACE = [0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_OTHER, _BLANK, _LETTER, _STOP = range(4)
_kind = np.zeros(256, dtype=np.uint8)
_kind[list(ASCII_SPACE)] = _BLANK
_kind[[*range(65, 91), *range(97, 123)]] = _LETTER
_kind[list(b".,;:!?")] = _STOP  # none of them is part of a special token
_wide = np.array([int.from_bytes(chr(c).encode(), "big") for c in WIDE_SPACE])


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Byte positions before which a text may be cut without changing its ids."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    kind = _kind[data]
    before, after = kind[:-1], kind[1:]
    at = np.flatnonzero(((after == _BLANK) & (before != _BLANK)) | ((after == _STOP) & (before == _LETTER))) + 1
    last = data[at - 1]
    doubtful = np.flatnonzero(last >= 0x80)
    if len(doubtful):
        where = at[doubtful]
        one, two = data[where - 1].astype(np.int64), data[np.maximum(where - 2, 0)].astype(np.int64)
        three = data[np.maximum(where - 3, 0)].astype(np.int64)
        wide = np.isin(two << 8 | one, _wide) | np.isin(three << 16 | two << 8 | one, _wide)
        at = np.delete(at, doubtful[wide])
    return at


def _ends_wide(unit: bytes) -> bool:
    return unit[-1] >= 0x80 and ord(unit[-4:].decode(errors="ignore")[-1]) in WIDE_SPACE


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + size) one after another."""
    total = np.cumsum(sizes)
    n = int(total[-1]) if len(total) else 0
    kind = np.int32 if n < 1 << 31 and (not n or int(starts.max()) + n < 1 << 31) else np.int64
    shift = (starts - (total - sizes)).astype(kind)
    index = np.repeat(shift, sizes)
    index += np.arange(n, dtype=kind)
    return index


def tokenizer_path(name: str) -> str:
    """A path is used as it is; a bare name means a file of the installed public tokenizers."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Encodes and decodes flat byte arrays; one per worker process and tokenizer."""

    def __init__(self, name: str = DEFAULT_TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        byte = _byte_of_char()
        vocabulary = self.tokenizer.get_vocab()
        size = max([*vocabulary.values(), *special], default=-1) + 1
        forms = [b""] * size
        for token, i in vocabulary.items():
            forms[i] = special[i] if i in special else bytes(byte[c] for c in token)
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.sizes = np.array([len(f) for f in forms], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1])) if size else np.zeros(0, np.int64)
        for t in special.values():
            if any(c in t for c in ASCII_SPACE + b".,;:!?"):
                raise ValueError("a special token could be cut")
        self.forms = np.frombuffer(b"".join(forms), np.uint8)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encoded(self, texts: list[bytes]) -> list[np.ndarray]:
        decoded = [t.decode() for t in texts]
        return [
            np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(decoded, add_special_tokens=False)
        ]

    def _fresh(self, units: list[bytes]) -> list[bytes]:
        """Ids of units not met before, as the bytes of ``dtype``."""
        out: list[bytes] = [b""] * len(units)
        # Only a unit that begins with white space and does not end with it has safe bounds within a joined text.
        joinable = [u[:1] in _SPACES and u[-1:] not in _SPACES and not _ends_wide(u) for u in units]
        alone = [i for i, j in enumerate(joinable) if not j]
        for i, ids in zip(alone, self._encoded([units[i] for i in alone])):
            out[i] = ids.tobytes()
        groups: list[list[int]] = [[]]
        size = 0
        for i, j in enumerate(joinable):
            if j:
                groups[-1].append(i)
                size += len(units[i])
                if size >= JOINED_BYTES:
                    groups.append([])
                    size = 0
        for group, ids in zip(groups, self._encoded([b"".join([units[i] for i in g]) for g in groups])):
            ends = np.cumsum([len(units[i]) for i in group])
            reached = np.cumsum(self.sizes[ids])
            cuts = np.searchsorted(reached, ends)
            if not np.array_equal(reached[cuts], ends):
                raise ValueError("unit bounds are not token bounds; a byte-level tokenizer is needed")
            raw, before = ids.tobytes(), 0
            for i, cut in zip(group, ((cuts + 1) * ids.itemsize).tolist()):
                out[i] = raw[before:cut]
                before = cut
        return out

    def _units(self, units: list[bytes]) -> list[bytes]:
        """Ids of distinct units, from memory where they were met before."""
        found = [self.young.get(u) for u in units]
        missing = []
        for i, ids in enumerate(found):
            if ids is None:
                ids = self.old.get(units[i])
                if ids is None:
                    missing.append(i)
                else:
                    found[i] = self.young[units[i]] = ids
        for i, ids in zip(missing, self._fresh([units[i] for i in missing])):
            found[i] = ids
            if len(units[i]) <= LONGEST_REMEMBERED:
                self.young[units[i]] = ids
        if len(self.young) > MEMORY_UNITS:
            self.old, self.young = self.young, {}
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of ids) of the texts ``data[offsets[t]:offsets[t + 1]]``."""
        if len(data) == 0:
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        bound = np.zeros(len(data) + 1, bool)
        bound[safe_cuts(data)] = True
        bound[offsets] = True
        bounds = np.flatnonzero(bound)
        sizes = np.diff(bounds)
        units = pa.Array.from_buffers(
            pa.binary(), len(sizes), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        which = units.indices.to_numpy()
        forms = self._units(units.dictionary.to_pylist())
        width = np.dtype(self.dtype).itemsize
        counts = np.array([len(f) for f in forms], np.int64) // width
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        flat = np.frombuffer(b"".join(forms), self.dtype)
        ids = flat[gathered(starts[which], counts[which])]
        reached = np.concatenate(([0], np.cumsum(counts[which])))
        return ids, reached[np.searchsorted(bounds, offsets)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the decoded ids, special tokens included."""
        ids = ids.astype(np.int64)
        return self.forms[gathered(self.starts[ids], self.sizes[ids])]


_encoders: dict[str, Encoder] = {}


def encoder(name: str = DEFAULT_TOKENIZER) -> Encoder:
    """The worker's encoder of a tokenizer."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]
