"""Whole-text tokenization with a bounded memory of pieces already encoded.

The known setups split text into pieces before they merge bytes, and no piece
reaches back over a lone space or a lone line end. So a text may be cut there,
each distinct piece encoded once by the library, and the ids of a text put
together from the pieces' ids: the same ids as for the whole text, for a
fraction of the merges. Plain words go straight to the library's model, marks
after a word never merge with it, and everything else goes through the library
whole. With any other setup whole texts go through the library.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: Pieces kept by a worker before its memory starts anew (about 230 bytes each).
MEMORY = 1_500_000
#: A space with any white space before it may share a piece with it.
GLUED = re.compile(r"\s ")
CUT = re.compile(r"(?<=\S) ")
#: Letters of Latin-1 (all composed already), then marks without the apostrophe that contractions start with.
WORD = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
WORD_AND_MARKS = re.compile(f"({WORD})([,.!?%$#&*:;)|]*)")

_loaded: dict[str, Encoder] = {}


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on, in order."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    other = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(other)) for b in range(256)}


# Setups that are known to split as the module says, as (normalizer, pre-tokenizer).
KNOWN = [
    (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    ),
]


class Pieces(dict):
    """Ids of pieces that follow ``lead`` (a lone space, or nothing), by the piece; what is missing is encoded when asked for."""

    def __init__(self, owner: Encoder, lead: str):
        super().__init__()
        self.owner, self.lead = owner, lead

    def __missing__(self, piece: str) -> bytes:
        own = self.owner
        found = WORD_AND_MARKS.fullmatch(piece)
        if found is not None and found[2]:
            ids = self[found[1]] + own.marks(found[2])
        elif found is not None:
            ids = own.word(piece, self.lead)
        elif "\n" in piece and len(lines := piece.split("\n")) == len(piece.split()) and all(lines):
            ids = self[lines[0]] + b"".join([own.line_end + own.heads[x] for x in lines[1:]])
        else:
            ids = own.whole(self.lead + piece)
        self[piece] = ids
        return ids


class Encoder:
    """Encodes texts to little-endian uint32 ids with the tokenizers library, add_special_tokens=False."""

    def __init__(self, file: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memory = Tokenizer.from_file(file), memory
        self.model = self.tokenizer.model
        setup = json.loads(self.tokenizer.to_str())
        said = (setup["normalizer"], setup["pre_tokenizer"])
        self.lower, self.space = said == KNOWN[1], said == KNOWN[0]
        letters = byte_letters()
        self.table = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        self.known_marks: dict[str, bytes] = {}
        self.line_end = self.whole("\n")
        self._forget()
        # Pieces are used only where they agree with the library on samples of all their letters and of both cuts.
        samples = ["Hello", "ÀÈÏõù", "naïveté", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", *map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])]
        self.direct = said in KNOWN and all(self.word(w, x) == self.whole(x + w) for w in samples for x in ("", " "))
        self.direct = self.direct and all(self.encode([x])[0] == self.whole(x) for x in ["Ab cd", "ab,\ncd ef!)\nGh", "a  b\n\nc", " a\n b", "it's 12 x3\n"])

    def _forget(self) -> None:
        self.tails, self.heads = Pieces(self, " "), Pieces(self, "")

    def word(self, word: str, lead: str) -> bytes:
        """Ids of a word of WORD after a lone space or nothing."""
        own = word.lower() if self.lower else lead + word if self.space else word
        return array("I", [t.id for t in self.model.tokenize(own.translate(self.table))]).tobytes()

    def marks(self, marks: str) -> bytes:
        if marks not in self.known_marks:
            self.known_marks[marks] = self.whole(marks)
        return self.known_marks[marks]

    def whole(self, text: str) -> bytes:
        """Ids of a text by the library's whole way."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def cut(text: str) -> list[str]:
        """The first piece, then those after a lone space."""
        return CUT.split(text) if GLUED.search(text) else text.split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes; null is an empty text."""
        if not getattr(self, "direct", True):
            return [self.whole(x or "") for x in texts]
        if len(self.tails) + len(self.heads) > self.memory:
            self._forget()
        cut = [self.cut(x or "") for x in texts]
        get = self.tails.__getitem__
        return [self.heads[pieces[0]] + b"".join(map(get, pieces[1:])) for pieces in cut]


def encoder(file: str) -> Encoder:
    """One encoder for each file and worker process."""
    if file not in _loaded:
        _loaded[file] = Encoder(file)
    return _loaded[file]
