"""Token ids of whole texts, by the tokenizers library, with a bounded cache of pieces.

A piece ends where the tokenizer's own pre-tokenizer always ends a token: before a single blank or newline
between other characters, or between a word of Latin letters and the comma or full stop that closes it. Texts
with other white space or with the name of an added token, and tokenizers of other kinds, are encoded whole. New pieces of Latin letters alone are
encoded many at a time, joined by blanks, and told apart by the tokens that begin (or end) a word.
"""

from __future__ import annotations

import functools
import gc
import itertools
import json
import os
import re
from array import array

import numpy as np

_CLOSED = re.compile(r"[\x00\n]?[A-Za-zÀ-ÖØ-öø-ÿ]+[,.]")
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
#: Pieces that a worker keeps (some 250 bytes each) before it starts anew.
CACHE_PIECES = 900_000
SOME_TEXTS = 256
#: New pieces of letters that are encoded as one text.
JOINED = 256


def default_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _led_pieces(text: str) -> list[str] | None:
    """Pieces for a tokenizer whose tokens take the blank before them. A key stands for blank + key; one that starts with a newline, or with NUL (the first), for what follows as it is."""
    if " ".join(text.split()) != text.replace("\n", " ") or "\x00" in text:
        return None
    return ("\x00" + text.replace("\n", " \n")).split(" ") if text else []


def _led_text(key: str) -> str:
    return key[1:] if key[0] == "\x00" else key if key[0] == "\n" else " " + key


def _bare_pieces(text: str) -> list[str] | None:
    """Pieces for a tokenizer that drops white space."""
    return None if _SEPARATORS.search(text) else text.split()


class PieceEncoder:
    """Encodes texts as little-endian unsigned 32-bit ids, as the library does with add_special_tokens=False: an added token's name in a text is that token."""

    def __init__(self, path: str, cache: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(names), re.IGNORECASE) if names else None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.pieces = self.text = None
        if norm is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
            self.pieces, self.text = _led_pieces, _led_text
        elif [x["type"] for x in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in before.get("pretokenizers", [])] == ["Split", "ByteLevel"]:
            self.pieces, self.text = _bare_pieces, str
        self.edge = self._edges(spec["model"])
        self.known: dict[str, bytes] = {}
        self.bound = cache
        self._batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)

    def _edges(self, model: dict) -> np.ndarray | None:
        """Of each id: whether it begins a word (a tokenizer that takes the blank before) or ends one; None if ids do not tell."""
        if model.get("type") != "BPE" or self.pieces is None or (self.pieces is _bare_pieces and model.get("end_of_word_suffix") != "</w>"):
            return None
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        return np.array([x.startswith("Ġ") if self.pieces is _led_pieces else x.endswith("</w>") for x in names], bool)

    def _words(self, keys: list[str]) -> list[bytes]:
        """Ids of each piece of letters."""
        out: list[bytes] = []
        groups = [keys[k : k + JOINED] for k in range(0, len(keys), JOINED)]
        leads = self.pieces is _led_pieces
        encoded = self._batch([(" " if leads else "") + " ".join(g) for g in groups], add_special_tokens=False) if groups else []
        for group, e in zip(groups, encoded, strict=True):
            ids = array("I", e.ids)
            raw, at = ids.tobytes(), 4 * np.flatnonzero(self.edge[ids])
            cuts = [*at.tolist(), len(raw)] if leads else [0, *(at + 4).tolist()]
            if len(cuts) == len(group) + 1 and cuts[0] == 0 and cuts[-1] == len(raw):
                out += [raw[a:b] for a, b in itertools.pairwise(cuts)]
            else:
                out += self._whole([self.text(k) for k in group])
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self._batch(texts, add_special_tokens=False)] if texts else []

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        collecting = gc.isenabled()
        gc.disable()  # long lists of bytes would be walked again and again; they hold no cycles
        try:
            for at in range(0, len(texts), SOME_TEXTS):
                out += self._some(texts[at : at + SOME_TEXTS])
        finally:
            if collecting:
                gc.enable()
        return out

    def _learn(self, missing: set[str]) -> None:
        known = self.known
        closed = [k for k in missing if k[-1] in ",." and _CLOSED.fullmatch(k)]
        marks = {c: "\x00" + c if self.text is _led_text else c for c in ",."}
        plain = missing.difference(closed)
        plain.update(k for k in (*(k[:-1] for k in closed), *marks.values()) if k not in known)
        if self.edge is not None:
            words = [k for k in plain if _LETTERS.fullmatch(k)]
            known.update(zip(words, self._words(words), strict=True))
            plain.difference_update(words)
        plain = list(plain)
        known.update(zip(plain, self._whole([self.text(k) for k in plain]), strict=True))
        known.update([(k, known[k[:-1]] + known[marks[k[-1]]]) for k in closed])

    def _some(self, texts: list[str]) -> list[bytes]:
        if self.pieces is None:
            return self._whole(texts)
        if len(self.known) > self.bound:
            self.known.clear()
        added = self.added
        cut = [None if added and added.search(t) else self.pieces(t) for t in texts]
        get = self.known.get
        found = [None if p is None else list(map(get, p)) for p in cut]
        holes: list[tuple] = []
        for p, f in zip(cut, found, strict=True):
            at = -1
            while f:
                try:
                    at = f.index(None, at + 1)
                except ValueError:
                    break
                holes.append((f, at, p[at]))
        if holes:
            self._learn({k for _, _, k in holes})
            known = self.known
            for f, at, k in holes:
                f[at] = known[k]
        odd = iter(self._whole([t for t, p in zip(texts, cut, strict=True) if p is None]))
        return [next(odd) if f is None else b"".join(f) for f in found]


@functools.cache
def encoder(path: str, cache: int = CACHE_PIECES) -> PieceEncoder:
    """One per Python worker (and size of cache)."""
    return PieceEncoder(path, cache)
