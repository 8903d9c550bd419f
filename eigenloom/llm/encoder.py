"""Encode texts with a tokenizer file inside tasks.

The library encodes; for byte-level BPE this module only spares it from
encoding the same word again and again. Such a tokenizer splits a text by a
fixed pattern and encodes each piece on its own, so a task keeps the ids of
pieces that it has met. Texts of other characters than the pattern is written
for here, texts with a special token's string, and all texts of other kinds of
tokenizer go to the library whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np

#: The byte-level pattern's classes within the characters that SAFE admits.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMBERS = "0-9²³¹¼-¾"
SAFE = re.compile("[\t\n\r\x20-\x7e¡-ſ‐-‧€]*")
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
#: Pieces, and characters of pieces, that a process remembers before it starts anew.
REMEMBERED, REMEMBERED_CHARS = 400_000, 16 << 20
#: Characters of texts that are encoded in one go.
GROUP = 1 << 21


def file_digest(path: str) -> str:
    """SHA-256 of a tokenizer file: the version of the tokenizer."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Numbers(dict):
    """Pieces numbered in the order in which they are first looked up; ``new`` has those since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = number = len(self)
        return number


class Encoder:
    """Ids of texts as the tokenizers library gives them, without added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splitter, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.by_piece = (
            splitter.get("type") == "ByteLevel"
            and splitter.get("use_regex", True)
            and not splitter.get("add_prefix_space")
            and spec.get("normalizer") is None
            and spec.get("post_processor") is None
            and model.get("type") == "BPE"
            and not model.get("dropout")
        )
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        starts = [k for token, k in model["vocab"].items() if token.startswith("Ġ")] if self.by_piece else []
        self.after_space = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.after_space[starts] = True
        self._forget()

    def _forget(self) -> None:
        self.number, self.chars = Numbers(), 0
        self.ids, self.first, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _split_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has."""
        encoding = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        return np.array(encoding.ids, np.int32), np.bincount(np.array(encoding.word_ids, np.int64), minlength=len(pieces))

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_split_pieces``; pieces that begin with a space are encoded as one running text, which is quicker."""
        ids = self._plain(["".join(pieces)])[0]
        begins = np.flatnonzero(self.after_space[ids])
        if len(begins) == len(pieces) and begins[0] == 0:
            return ids, np.diff(begins, append=len(ids))
        return self._split_pieces(pieces)

    def _learn(self, pieces: list[str]) -> None:
        """Remember the ids of new pieces, which have the numbers after those known."""
        running = np.fromiter((len(p) > 1 and p[0] == " " and p[1] > " " for p in pieces), bool, len(pieces))
        lengths, found = np.zeros(len(pieces), np.int64), [None, None]
        for k, how in ((0, self._split_pieces), (1, self._encode_pieces)):
            places = np.flatnonzero(running == k)
            some = [pieces[i] for i in places.tolist()]
            parts = [how(some[at : at + 20_000]) for at in range(0, len(some), 20_000)]
            if parts:
                lengths[places] = np.concatenate([n for _, n in parts])
                found[k] = np.concatenate([ids for ids, _ in parts])
        flat = np.empty(lengths.sum(), np.int32)
        for k in (0, 1):
            if found[k] is not None:
                flat[np.repeat(running == k, lengths)] = found[k]
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.ids = np.concatenate([self.ids, flat])

    def _by_piece(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self._forget()
        found = [PIECES.findall(t) for t in texts]
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(found)), np.int64)
        new, self.number.new = self.number.new, []
        self.chars += sum(map(len, new))
        self._learn(new)
        lengths = self.length[numbers]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.first[numbers] - (ends - lengths), lengths) + np.arange(total)]
        pieces_before = np.cumsum([len(f) for f in found])
        cuts = np.concatenate([[0], ends])[pieces_before]
        return np.split(ids, cuts[:-1])

    def _simple(self, text: str) -> bool:
        return SAFE.fullmatch(text) is not None and not any(s in text for s in self.specials)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, in order."""
        out: list[np.ndarray | None] = [None] * len(texts)
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) <= GROUP):
                size += len(texts[end])
                end += 1
            group = range(at, end)
            fast = [k for k in group if self.by_piece and self._simple(texts[k])]
            slow = [k for k in group if not (self.by_piece and self._simple(texts[k]))]
            for rows, how in ((fast, self._by_piece), (slow, self._plain)):
                if rows:
                    for k, ids in zip(rows, how([texts[k] for k in rows]), strict=True):
                        out[k] = ids
            at = end
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file (a worker serves many tasks)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
