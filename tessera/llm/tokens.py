"""Exact, cached tokenization by the library of a vocabulary file.

A text is cut at ASCII blanks where that provably changes nothing (vocabularies that drop white space and never join
pieces across it); the ids of each distinct chunk come from the library once per worker and are then looked up.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Letters, digits and blanks of Latin-1 as the Unicode classes L, N and White_Space have them.
LETTER, DIGIT = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
#: Chunks of these characters alone are normalised by lower-casing, and cut by PIECE as the library cuts them.
PLAIN = re.compile(r"[!-~¡-¬®-ÿ]*\Z")
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^{LETTER}{DIGIT}]+")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable in Latin-1, else the next
    free code point from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Ids(dict):
    """chunk -> its ids as little-endian unsigned 32-bit bytes; filled by need, emptied at `most` entries."""

    def __init__(self, path: str, most: int = 800_000, most_pieces: int = 300_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__()
        self.most, self.most_pieces, self.tok, self.pieces = most, most_pieces, Tokenizer.from_file(path), {}
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.drops_blanks = spec["model"].get("end_of_word_suffix") == "</w>" and any(p.get("behavior") == "Removed" and p.get("invert") for p in pre.get("pretokenizers", []))
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", []))) if spec.get("added_tokens") else None
        self.mark = os.path.commonprefix([t["content"] for t in spec.get("added_tokens", [])])  # what all special tokens begin with
        self.letters = byte_letters()

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        """Ids of one pre-token, straight from the library's model."""
        if (got := self.pieces.get(piece)) is None:
            got = np.array([t.id for t in self.tok.model.tokenize("".join(map(self.letters.__getitem__, piece.encode())))], "<u4").tobytes()
            if len(piece) <= 40:
                if len(self.pieces) >= self.most_pieces:
                    self.pieces.clear()
                self.pieces[piece] = got
        return got

    def __missing__(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if PLAIN.match(chunk) and not (self.special and self.mark in chunk and self.special.search(chunk)):
            got = b"".join(map(self.piece, PIECE.findall(chunk.lower())))
        else:
            got = self.whole(chunk)
        if len(chunk) <= 40:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = got
        return got

    def chunks(self, text: str) -> list[str]:
        """Chunks whose ids, one after another, are the text's ids."""
        # three searches for a byte, where str.translate looks up each character of a text that is not ASCII
        return text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if self.drops_blanks else [text]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.chunks(text))) if self.drops_blanks else self.whole(text)


_IDS: dict[str, Ids] = {}


def ids(path: str) -> Ids:
    """This worker's cache for a vocabulary file."""
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]
