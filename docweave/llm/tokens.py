"""Token ids of whole texts by a public tokenizers file; each distinct word is encoded once a worker.

Files of the two shapes below break a text wherever a non-space meets a space that a non-space follows, and between
letters and punctuation, so such parts are encoded apart and remembered. A single word of Latin letters needs no
pattern and goes straight to the library's BPE model; whatever else a text holds goes through the library's whole
encoder, and so does every text if the file has any other shape.
"""

from __future__ import annotations

import json
import os
import struct
from pathlib import Path

import numpy as np
import pyarrow as pa

from .common import REMEMBERED

#: Words of a generation; a worker remembers this one and the last (about 200 MB at most).
GENERATION = 450_000
#: Bytes of text that are encoded together.
SLICE = 1 << 21
MARKS = ".,;:!?#$%&*|)]}"
#: Normalizer, pre-tokenizer and end-of-word suffix of the files whose words can be encoded apart.
SPACED = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, None)
SPACELESS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "</w>",
)


def shape(path: str) -> str | None:
    """Which of the two shapes a file has, if any: "spaced" keeps the space before a word in its ids."""
    file = json.loads(Path(path).read_text())
    model = file["model"]
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    plain &= not any(t.get(k) for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")) and not any(set(t["content"]) & set(" \n") for t in file["added_tokens"])
    parts = (file["normalizer"], file["pre_tokenizer"], model.get("end_of_word_suffix"))
    return "spaced" if plain and parts == SPACED else "spaceless" if plain and parts == SPACELESS else None


_PACK = [struct.Struct(f"<{n}I").pack for n in range(40)]


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Words(dict):
    """Part of a text to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.shape = shape(path)
        # Where the tokenizer keeps white space, a word's part holds the space before it.
        self.spaced = self.shape == "spaced"
        self.model = self.tokenizer.model
        self.last: dict[str, bytes] = {}
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})

    def encoded(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, part: str) -> bytes:
        out = self.last.get(part)
        if out is None:
            out = self.parted(part)
        if len(self) >= GENERATION:
            self.last = dict(self)
            self.clear()
        if len(part) < 100:
            self[part] = out
        return out

    def parted(self, part: str) -> bytes:
        space = self.spaced and part[:1] == " "
        core = part.rstrip(MARKS)
        if core != part and core[-1:].isalpha():
            return self[core] + self[part[len(core) :]]
        word = part[1:] if space else part
        if word.isalpha() and (word.isascii() or max(word) < "ɐ" and "İ" not in word):
            if self.spaced:
                tokens = self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))
            else:
                low = word.lower()
                if low != word:
                    return self[low]
                tokens = self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))
            return _PACK[len(tokens)](*[t.id for t in tokens]) if len(tokens) < len(_PACK) else struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        if "\n" in word:
            lines = word.split("\n")
            if all(x.split() == [x] for x in lines):
                mark = self["\n"]
                return self[" " * space + lines[0]] + b"".join([mark + self[x] for x in lines[1:]])
        return self.encoded(part)

    def ids(self, text: str) -> bytes:
        """Ids of a whole text."""
        if not text:
            return b""
        if not self.shape:
            return self.encoded(text)
        get = self.__getitem__
        if not self.spaced:
            return b"".join(map(get, filter(None, text.replace("\n", " ").split(" "))))
        if "  " in text or text[0] == " " or text[-1] == " " or "\0" in text:
            return self.encoded(text)  # the patterns look further than a word there
        return b"".join(map(get, text.replace(" ", "\0 ").split("\0")))

    def batch(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts (null: empty), `end` after each, and the n + 1 places where each text's ids begin."""
        last = struct.pack("<I", end)
        table = [self.ids(t) + last for t in texts.to_pylist()]
        return np.frombuffer(b"".join(table), "<u4"), np.cumsum([0, *(len(t) // 4 for t in table)])


_loaded: dict[str, Words] = {}
REMEMBERED.append(_loaded)


def words(path: str) -> Words:
    if path not in _loaded:
        _loaded[path] = Words(path)
    return _loaded[path]
