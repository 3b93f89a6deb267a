"""Token ids of whole texts with the tokenizers library, fast on repeated words.

A byte-level BPE without merges across words encodes each pre-token on its own. Texts of common Latin
characters with single spaces and line breaks are therefore cut, all texts of a group at once, before
spaces, around line breaks and where letters, digits and punctuation meet. The pieces are
dictionary-encoded, unseen ones are encoded together by the library, and the ids of each piece are
kept in a bounded per-process table.
Every other text goes to the library whole, so ids always equal those of the library.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa

from .common import release_memory

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
MAX_WORDS = 800_000
GROUP_CHARS = 2_000_000
_PLAIN = re.compile("[\n\x20-\x7e¡-¬®-ſ]*")
_ODD = ("  ", "\n\n", "\n ", " \n", "<|")
_LETTER, _DIGIT, _MARK = 1, 2, 3
_encoders: dict[str, WordEncoder] = {}


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _kinds() -> np.ndarray:
    """The kind of every UTF-8 byte: letter (also a byte of U+0080 and above), digit, mark, or none of these.

    The apostrophe is none: it may start a pre-token together with letters ("'s").
    """
    out = np.zeros(256, np.uint8)
    out[0x80:] = _LETTER
    for characters, kind in ((string.ascii_letters, _LETTER), (string.digits, _DIGIT), (string.punctuation.replace("'", ""), _MARK)):
        out[np.frombuffer(characters.encode(), np.uint8)] = kind
    return out


_KINDS = _kinds()


def _cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of the UTF-8 bytes of plain texts start; every one of these places starts a pre-token.

    A pre-token is an optional space and letters only, digits only or others only, or a line break, or an
    apostrophe and certain letters. Of U+0080 to U+017F all are taken for letters from U+00C0 on but for the two
    signs among them, so the rest are of no kind and never cut off.
    """
    kind = _KINDS[data]
    for lead, signs in ((0xC2, None), (0xC3, (0x97, 0xB7))):
        at = np.flatnonzero(data == lead)
        if signs:
            at = at[np.isin(data[at + 1], signs)]
        kind[at] = kind[at + 1] = 0
    breaks = np.flatnonzero(data == 0x0A)
    new = np.zeros(len(data) + 1, bool)
    new[1:-1] = (kind[1:] != kind[:-1]) & (kind[1:] != 0) & (kind[:-1] != 0)
    new[:-1] |= data == 0x20
    new[breaks] = new[breaks + 1] = new[starts] = True
    new[-1] = False
    return np.flatnonzero(new)


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size()
        first = [(self.library.id_to_token(i) or "")[:1] for i in range(size)]
        self.begins = np.array([c in ("Ġ", "Ċ") for c in first])
        cutter = self.library.pre_tokenizer
        plain = type(cutter).__name__ == "ByteLevel" and not getattr(cutter, "add_prefix_space", True) and getattr(cutter, "use_regex", False)
        self.by_word = plain and self.library.normalizer is None
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.limit = MAX_WORDS

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, fresh: list[bytes]) -> list[bytes]:
        """The ids of unseen pieces. One without a space before it is encoded after a line break, whose id goes."""
        spaced = [w[0] == 0x20 for w in fresh]
        marked = [w if s else b"\n" + w for w, s in zip(fresh, spaced, strict=True)]
        joined = [b"".join(marked[at : at + 64]).decode() for at in range(0, len(fresh), 64)]
        each = [x.ids for x in self.library.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.array(list(chain.from_iterable(each)), "<u4")
        begin = self.begins[ids]
        ends = np.cumsum([len(x) for x in each])
        counts = np.diff(np.cumsum(begin)[ends - 1], prepend=0)
        if (counts != [min(64, len(fresh) - at) for at in range(0, len(fresh), 64)]).any():
            return [self._whole(w.decode()) for w in fresh]
        first = np.flatnonzero(begin)
        raw, last = ids.tobytes(), [*(4 * first[1:]).tolist(), 4 * len(ids)]
        return [raw[a:b] for a, b in zip((4 * (first + ~np.array(spaced))).tolist(), last, strict=True)]

    def _look_up(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces, in two generations of which the older one goes when the younger one is full.

        A piece of the older generation joins the younger one when it is used. Rare pieces so leave by themselves
        and frequent ones stay.
        """
        if len(self.known) > self.limit // 2:
            self.known, self.older = {}, self.known
        self.known[b"\n"] = self._line_end
        found = list(map(self.known.get, pieces))
        absent = [w for w, ids in zip(pieces, found, strict=True) if ids is None]
        if not absent:
            return found
        again = list(map(self.older.get, absent))
        fresh = [w for w, ids in zip(absent, again, strict=True) if ids is None]
        if fresh:
            learnt = iter(self._learn(fresh))
            again = [next(learnt) if ids is None else ids for ids in again]
        self.known.update(zip(absent, again, strict=True))
        rest = iter(again)
        return [next(rest) if ids is None else ids for ids in found]

    @cached_property
    def _line_end(self) -> bytes:
        return self._whole("\n")

    def encode(self, texts: list[str]) -> list[bytes]:
        out, at, plain = [], [], []
        for i, text in enumerate(texts):
            if not text:
                out.append(b"")
            elif self.by_word and not any(map(text.__contains__, _ODD)) and text[0] != " " != text[-1] and _PLAIN.fullmatch(text):
                at.append(i)
                plain.append(text.encode())
                out.append(b"")
            else:
                out.append(self._whole(text))
        if not plain:
            return out
        data = b"".join(plain)
        starts = np.cumsum([0, *map(len, plain)])
        cuts = _cuts(np.frombuffer(data, np.uint8), starts)
        offsets = np.append(cuts, len(data)).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        found = self._look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        _, ends, content = pa.array(found, pa.large_binary()).take(coded.indices).buffers()
        bounds = np.frombuffer(ends, np.int64)[np.searchsorted(offsets, starts)].tolist()
        raw = memoryview(content)
        for i, start, end in zip(at, bounds, bounds[1:], strict=False):
            out[i] = bytes(raw[start:end])
        return out


def forget_words(path: str) -> None:
    """Empty this process's table of words; the library stays loaded."""
    if path in _encoders:
        _encoders[path].known, _encoders[path].older = {}, {}
    release_memory()


def encode_texts(texts: list[str | None], path: str, group: int = GROUP_CHARS, max_words: int = MAX_WORDS) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of every text; null is empty."""
    return list(encode_each(texts, path, group, max_words))


def encode_each(texts: Iterable[str | None], path: str, group: int = GROUP_CHARS, max_words: int = MAX_WORDS) -> Iterator[bytes]:
    """The ids of one text after another, encoded in groups of about ``group`` characters."""
    encoder = _encoders.get(path)
    if encoder is None:
        encoder = _encoders[path] = WordEncoder(path)
    encoder.limit = max_words
    held, n = [], 0
    for text in texts:
        held.append(text or "")
        n += len(held[-1])
        if n >= group or len(held) >= 4096:
            yield from encoder.encode(held)
            held, n = [], 0
    if held:
        yield from encoder.encode(held)
