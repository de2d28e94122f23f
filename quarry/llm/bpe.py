"""Byte-level BPE ids from the tokenizers library, fast on long corpora.

The library splits a text into pieces and merges each piece alone, so a text may be cut wherever one of its pieces must
end: before a space between two characters that are not white space. Each distinct unit between such cuts is encoded
once by the library, many units in one call, and kept in a cache of the Python worker that is bounded by its memory.
"""

from __future__ import annotations

import os
import re
import sys

import numpy as np

#: Bytes of memory that a worker's cache may hold before it is emptied; a pure cache, results do not depend on it.
CACHE_BYTES = 112 << 20
#: What an entry takes beside its characters and ids: two objects and its slot.
_ENTRY = 150
#: Characters of texts whose units are looked up together; a longer text is cut into stretches of about so many.
STRETCH = 1 << 20
#: Units in one call of the library.
_CALL = 20_000

#: Letters, and ASCII punctuation behind them: two of the library's pieces.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]+)")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """batch(texts) gives the ids of whole texts as little-endian bytes of self.kind; special tokens' strings are text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        n = self.library.get_vocab_size()
        self.kind = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.cuttable = self._may_cut()
        #: Ids that begin with the space: a unit's first, and no other of its ids.
        space = self.library.pre_tokenizer.pre_tokenize_str(" x")[0][0][0] if self.cuttable else None
        self.begins = np.array([space is not None and (self.library.id_to_token(k) or "").startswith(space) for k in range(n)])
        self.cache: dict[str, bytes | None] = {}
        self.marks: dict[str, bytes] = {}
        self.held = 0
        self.most = CACHE_BYTES

    def _may_cut(self) -> bool:
        """True if the file's rules are those that the cuts are proved for: byte-level pieces and nothing before or after."""
        import json

        rules = json.loads(self.library.to_str())
        pre = rules["pre_tokenizer"] or {}
        return pre.get("type") == "ByteLevel" and bool(pre.get("use_regex", True)) and not pre.get("add_prefix_space") and not rules["normalizer"] and sys.byteorder == "little" and not rules["model"].get("dropout") and all(t["special"] for t in rules["added_tokens"])

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _fill(self, units: set[str]) -> None:
        """Puts units into the cache; None for those that stand beside white space, where a cut could be wrong."""
        new = list(units.difference(self.cache))
        odd = [u for u in new if not u or u[0].isspace() or " " in u]
        if odd:
            new = list(set(new).difference(odd))
            self.cache.update((u, None) for u in odd if not u or u[0].isspace())
            self._singly([u for u in odd if u and not u[0].isspace()])
        marked = [m for m in map(_PLAIN.fullmatch, new) if m]
        if marked:
            new = list(set(new).difference([m[0] for m in marked]).union({m[1] for m in marked}.difference(self.cache)))
        self._distinct(new)
        for m in marked:
            self.cache[m[0]] = found = self.cache[m[1]] + self._marks(m[2])
            self.held += _ENTRY + 2 * len(m[0]) + len(found)

    def _marks(self, marks: str) -> bytes:
        found = self.marks.get(marks)
        if found is None:
            found = self._whole([marks])[0]
            if len(marks) <= 4:
                self.marks[marks] = found
        return found

    def _distinct(self, new: list[str]) -> None:
        """Units without space: their ids are told apart by the space that each begins with."""
        for k in range(0, len(new), _CALL):
            some = new[k : k + _CALL]
            ids = np.array(self.library.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            at = (np.append(np.flatnonzero(self.begins[ids]), len(ids)) * self.kind.itemsize).tolist()
            if len(at) != len(some) + 1:
                self._singly(some)
                continue
            data = ids.tobytes()
            self.cache.update(zip(some, [data[a:b] for a, b in zip(at, at[1:])], strict=True))  # noqa: B905
            self.held += len(some) * _ENTRY + 2 * sum(map(len, some)) + len(data)

    def _singly(self, units: list[str]) -> None:
        self.cache.update(zip(units, self._whole([" " + u for u in units]), strict=True))
        self.held += sum(_ENTRY + 4 * len(u) for u in units)

    def drop(self) -> None:
        """Empties the cache."""
        self.cache.clear()
        self.held = 0

    def _stretches(self, text: str):
        """The text's pieces that may be encoded apart; all but the first begin with the space they are cut at."""
        at = 0
        while len(text) - at > 2 * STRETCH:
            cut = _SAFE_CUT.search(text, at + STRETCH)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def _together(self, texts: list[str]) -> list[bytes]:
        """Ids of stretches: a head and the units behind it."""
        if self.held > self.most:
            self.drop()
        heads, rests = [], []
        for t in texts:
            head, space, rest = t.partition(" ")
            rests.append(rest.split(" ") if space else [])
            heads.append(head)
        self._fill(set().union(*rests))
        out = []
        plain = self._whole(heads)
        get = self.cache.__getitem__
        for t, head, first, units in zip(texts, heads, plain, rests, strict=True):
            try:
                if not units or head or len(t) > 1 and not t[1].isspace():
                    out.append(first + b"".join(map(get, units)))
                    continue
            except TypeError:  # a None: white space about a cut
                pass
            head, *units = _SAFE_CUT.split(t)
            self._fill(set(units))
            out.append(self._whole([head])[0] + b"".join(map(get, units)))
        return out

    def batch(self, texts: list[str]) -> list[bytes]:
        if not self.cuttable:
            return self._whole(texts)
        out, waiting, chars = [], [], 0
        for t in texts:
            if len(t) > 2 * STRETCH:
                out += self._together(waiting)
                waiting, chars = [], 0
                out.append(b"".join(self._together([x])[0] for x in self._stretches(t)))
                continue
            waiting.append(t)
            chars += len(t)
            if chars >= STRETCH:
                out += self._together(waiting)
                waiting, chars = [], 0
        return out + self._together(waiting)

    def ids(self, text: str) -> bytes:
        return self.batch([text])[0]


def encoder(path: str, most: int | None = None) -> Encoder:
    """The worker's encoder for this file, its cache of at most so many bytes (CACHE_BYTES)."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].most = most or CACHE_BYTES
    return _encoders[path]


def forget() -> None:
    """Drops the worker's encoders and their caches; the next call of encoder reads the file again."""
    _encoders.clear()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
