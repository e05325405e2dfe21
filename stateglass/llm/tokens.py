"""Token ids of whole texts, by the ``tokenizers`` library and a public vocabulary.

The vocabularies meant here never join what white space parts, so a text is encoded
word by word, and each distinct word once per worker as long as there is room.
A text that holds an added token of the vocabulary is encoded whole by the library,
which gives such tokens their ids.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import islice
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from stateglass.llm.common import worker_cache

# Words a worker remembers; beyond these a word is encoded once per batch.
REMEMBERED = 450_000
# ASCII punctuation that can be parted from a letter or digit before it without
# changing the tokens of either; the apostrophe can not.
_TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = re.compile(rb"[a-z]+").fullmatch
# How byte-level vocabularies write the bytes beyond ASCII: printable Latin-1 as it
# is, the others as the letters from U+0100 + 33 on, after those for ASCII controls.
_BYTE_LETTERS = {b: 0x100 + 34 + b - 0x80 if b <= 0xA0 else 0x100 + 67 if b == 0xAD else b for b in range(0x80, 0x100)}
_SAFE_END = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")

_ENDS_WORD, _WHITE = (np.isin(np.arange(256), list(x)) for x in (_SAFE_END, b" \t\n\v\f\r"))


def load(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    kept = worker_cache("tokenizers")
    if path not in kept:
        kept[path] = Tokenizer.from_file(path)
        # Words are lower-cased before, which must not make an added token of one.
        kept[path].encode_special_tokens = True
    return kept[path]


def parted_words(texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray]:
    """Words of the lower-cased texts, and where those of each text end among them.

    A comma or stop between a letter or digit and white space is a word of its own.
    """
    lowered = b"\n".join([(t or b"").lower() for t in texts]) + b"\n"
    data = np.frombuffer(lowered, np.uint8)
    marks = np.flatnonzero((data == 44) | (data == 46))
    marks = marks[(marks > 0) & _ENDS_WORD[data[marks - 1]] & _WHITE[data[marks + 1]]]
    spaced = np.full(len(data) + len(marks), 32, np.uint8)
    keep = np.ones(len(spaced), bool)
    keep[marks + np.arange(len(marks))] = False
    spaced[keep] = data
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    ends = ends + np.searchsorted(marks, ends)
    solid = ~_WHITE[spaced]
    # The last byte is white space, so every word that begins also ends.
    turns = np.flatnonzero(np.diff(solid, prepend=False))
    begins, stops = turns[::2], turns[1::2]
    offsets = np.zeros(len(begins) + 1, np.int32)
    np.cumsum(stops - begins, out=offsets[1:])
    words = pa.Array.from_buffers(
        pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(spaced[solid])]
    )
    return words, np.searchsorted(begins, ends)


def _as_bytes(words: pa.Array) -> list[bytes]:
    """The values of a binary array without nulls, by slices of its data."""
    _, offsets, data = words.buffers()
    joined = data.to_pybytes() if data is not None else b""
    edges = np.frombuffer(offsets, np.int32, len(words) + 1, 4 * words.offset).tolist()
    return [joined[a:b] for a, b in zip(edges, edges[1:])]


class WordEncoder:
    """Ids of texts under a vocabulary that lower-cases and drops white space."""

    def __init__(self, path: str, remember: int = REMEMBERED):
        self.remember = remember
        self.tokenizer = load(path)
        self.known: dict[bytes, bytes] = worker_cache(f"ids {path}")
        added = self.tokenizer.get_added_tokens_decoder().values()
        # Some are looked for in the lower-cased text only.
        self.folded = any(a.normalized for a in added)
        self.added = [a.content.lower().encode() if self.folded else a.content.encode() for a in added]

    def _has_added(self, text: bytes) -> bool:
        text = text.lower() if self.folded else text
        return any(a in text for a in self.added)

    def _learn(self, missing: set[bytes]) -> dict[bytes, bytes]:
        """Ids of the words, and of the cores that words are made of."""
        cut: dict[bytes, tuple[bytes, bytes]] = {}
        pieces = set()
        for word in missing:
            core = word.rstrip(_TAIL)
            if core and len(core) < len(word) and core[-1] in _SAFE_END:
                cut[word] = parts = (core, word[len(core) :])
                pieces.update(parts)
            else:
                pieces.add(word)
        pieces = pieces.difference(self.known)
        tokenize = self.tokenizer.model.tokenize
        found, other = {}, []
        for piece in pieces:
            if _PLAIN(piece):
                written = piece.decode()
            else:
                word = piece.decode()
                if not (word.isalpha() and word.lower() == word and is_normalized("NFC", word)):
                    other.append(piece)
                    continue
                written = piece.decode("latin-1").translate(_BYTE_LETTERS)
            found[piece] = array("I", [t.id for t in tokenize(written)]).tobytes()
        coded = self.tokenizer.encode_batch_fast([p.decode() for p in other], add_special_tokens=False)
        found.update((p, array("I", e.ids).tobytes()) for p, e in zip(other, coded))
        for word, (core, tail) in cut.items():
            found[word] = b"".join(found[p] if p in found else self.known[p] for p in (core, tail))
        return found

    def encode(self, texts: list[bytes | None], end: int | None = None) -> list[bytes]:
        """The little-endian unsigned 32-bit ids of each text, with ``end`` behind them."""
        tail = b"" if end is None else np.array([end], np.uint32).tobytes()
        marked = {i: t for i, t in enumerate(texts) if t is not None and self._has_added(t)}
        if marked:
            self.tokenizer.encode_special_tokens = False
            whole = {i: self.tokenizer.encode(t.decode(), add_special_tokens=False).ids for i, t in marked.items()}
            self.tokenizer.encode_special_tokens = True
            coded = self.encode([None if i in marked else t for i, t in enumerate(texts)], end)
            return [array("I", whole[i]).tobytes() + tail if i in whole else c for i, c in enumerate(coded)]
        # Neither lower-casing ASCII first nor parting commas and stops changes a token; both save entries.
        words, ends = parted_words(texts)
        numbered = words.dictionary_encode()
        distinct = _as_bytes(numbered.dictionary)
        ids = list(map(self.known.get, distinct))
        missing = {w for w, own in zip(distinct, ids) if own is None}
        if missing:
            found = self._learn(missing)
            room = max(self.remember - len(self.known), 0)
            self.known.update(islice(found.items(), room))
            ids = [found[w] if own is None else own for w, own in zip(distinct, ids)]
        coded = pa.array(ids, pa.large_binary()).take(numbered.indices)
        _, offsets, data = coded.buffers()
        edges = np.append(0, np.frombuffer(offsets, np.int64, len(coded) + 1)[ends]).tolist()
        joined = memoryview(data) if data is not None else b""
        return [bytes(joined[a:b]) + tail for a, b in zip(edges, edges[1:])]
