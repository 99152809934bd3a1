"""Token counts of whole texts under a byte-level BPE file, by rank-synchronous merging of numpy arrays.

A slice's texts are cut into pre-tokens. The distinct ones that the worker doesn't remember are held together as one
ragged array of symbols. In every round each sequence finds its pair of lowest rank, all sequences replace theirs at the
same time, and sequences without a known pair leave with the symbols that they have left. Only counts are remembered.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import REMEMBERED, forget, slices, text_buffer
from .tokens import SPACED, _byte_letters

#: Pre-tokens of which a worker remembers the count, at most twice as many (about 100 MB).
GENERATION = 400_000
#: Bytes of pre-tokens that are merged together.
TOGETHER = 1 << 20
#: Fixed value: the pattern of byte-level pre-tokenizers.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class Merges:
    """The merges of a byte-level BPE file."""

    def __init__(self, path: str):
        file = json.loads(Path(path).read_text())
        model = file["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [t["content"] for t in file["added_tokens"] if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
        if (file["normalizer"], file["pre_tokenizer"], None) != SPACED or model.get("type") != "BPE" or odd:
            raise ValueError(f"{path} is no plain byte-level BPE file {odd}")
        vocabulary, letters = model["vocab"], _byte_letters()
        if any(c not in vocabulary for c in letters.values()):
            raise ValueError(f"{path} lacks single bytes")
        self.first = np.array([vocabulary[letters[b]] for b in range(256)], np.int64)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        left, right, made = (np.array([vocabulary[t] for t in x], np.int64) for x in (*zip(*pairs, strict=True), [a + b for a, b in pairs])) if pairs else [np.zeros(0, np.int64)] * 3
        self.width = int(max(vocabulary.values())) + 1
        key, rank = np.unique(left * self.width + right, return_index=True)  # of a repeated pair the first rank counts
        self.key, self.rank, self.made = key, rank, made
        # All places of a pair can be replaced at once if what a merge makes is only part of later merges.
        born = np.full(self.width, -1)
        np.maximum.at(born, made, np.arange(len(made)))
        self.at_once = bool((np.maximum(born[left], born[right]) < np.arange(len(made))).all())
        # The library and `regex` know other versions of Unicode: characters whose class differs leave a text to the library.
        from tokenizers.pre_tokenizers import ByteLevel

        self.splitter = ByteLevel(add_prefix_space=False, use_regex=True)
        self.agreed, self.odd = set(map(chr, range(128))), set()
        self.bytes = {c: b for b, c in letters.items()}
        special = sorted((t["content"] for t in file["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.counts: dict[str, int] = {}
        self.last: dict[str, int] = {}

    def ranks(self, symbols: np.ndarray) -> np.ndarray:
        """The rank of each pair of neighbours, len(self.made) where there is none."""
        if not len(self.key):
            return np.full(len(symbols) - 1, 0)
        wanted = symbols[:-1] * self.width + symbols[1:]
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, self.rank[at], len(self.made))

    def merged(self, parts: list[bytes]) -> np.ndarray:
        """How many symbols each part has once no pair of its symbols can be merged."""
        none, size = len(self.made), np.array([len(p) for p in parts], np.int64)
        out = size.copy()
        which = np.flatnonzero(size > 1)
        symbols = self.first[np.frombuffer(b"".join([parts[i] for i in which.tolist()]), np.uint8)]
        size = size[which]
        while len(which):
            start = np.cumsum(size) - size
            rank = np.full(len(symbols), none)
            if len(symbols) > 1:
                rank[:-1] = self.ranks(symbols)
            rank[start + size - 1] = none  # pairs don't cross sequences
            low = np.minimum.reduceat(rank, start)
            hit = (rank == np.repeat(low, size)) & (rank < none)
            at = np.flatnonzero(hit)
            if len(at):
                # Of overlapping places (a a a) every other one counts, from the left.
                new = np.r_[True, np.diff(at) != 1]
                run = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                use = (np.arange(len(at)) - run) % 2 == 0
                if not self.at_once:
                    owner = np.repeat(np.arange(len(size)), size)[at]
                    use &= np.r_[True, owner[1:] != owner[:-1]]
                at = at[use]
                symbols[at] = self.made[rank[at]]
                keep = np.ones(len(symbols), bool)
                keep[at + 1] = False
                size = np.add.reduceat(keep, start, dtype=np.int64)
                symbols = symbols[keep]
            more = (low < none) & (size > 1)
            out[which[~more]] = size[~more]
            symbols, which, size = symbols[np.repeat(more, size)], which[more], size[more]
        return out

    def learn(self, wanted: set[str]) -> None:
        """Have the counts of these pre-tokens."""
        new, held = [], 0
        for part in sorted(wanted, key=len):
            coded = part.encode()
            if held + len(coded) > TOGETHER and new:
                self.counts.update(zip([p for p, _ in new], self.merged([c for _, c in new]).tolist(), strict=True))
                new, held = [], 0
            new.append((part, coded))
            held += len(coded)
        if new:
            self.counts.update(zip([p for p, _ in new], self.merged([c for _, c in new]).tolist(), strict=True))

    def agrees(self, c: str) -> bool:
        return all([b for _, (_, b) in self.splitter.pre_tokenize_str(x)] == [m.end() for m in PRE_TOKEN.finditer(x)] for x in ("a" + c, "1" + c, "!" + c, " " + c, c + "a", "a " + c))

    def pre_tokens(self, text: str) -> list[str]:
        if not text.isascii():
            chars = set(text)
            for c in chars - self.agreed - self.odd:
                (self.agreed if self.agrees(c) else self.odd).add(c)
            if chars & self.odd:
                return [bytes(map(self.bytes.__getitem__, p)).decode() for p, _ in self.splitter.pre_tokenize_str(text)]
        return PRE_TOKEN.findall(text)

    def totals(self, texts: list[str]) -> list[int]:
        """The tokens of each text, special strings being one each."""
        fixed, parts = [], []
        for text in texts:
            n, pieces = 0, [text]
            if self.special is not None and self.special.search(text):
                pieces = self.special.split(text)
                n = len(pieces) - 1
            fixed.append(n)
            parts.append([p for x in pieces for p in self.pre_tokens(x)])
        if len(self.counts) > GENERATION:
            self.last, self.counts = self.counts, {}
        seen = set().union(*parts)
        new = seen - self.counts.keys()
        self.counts.update({p: self.last[p] for p in new & self.last.keys()})
        self.learn(new - self.counts.keys())
        get = self.counts.__getitem__
        out = [n + sum(map(get, p)) for n, p in zip(fixed, parts, strict=True)]
        for p in [p for p in new if len(p) > 100]:
            del self.counts[p]
        return out


_loaded: dict[str, Merges] = {}
REMEMBERED.append(_loaded)


def _counted(path: str):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            forget()
            _loaded[path] = Merges(path)
        merges = _loaded[path]
        for batch in slices(batches, "text"):
            column = batch.schema.get_field_index("text")
            _, at = text_buffer(batch.column(column))
            found = merges.totals(batch.column(column).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at[1:] - at[:-1]), pa.array(found, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return counted


def token_counts(docs: DataFrame, tokenizer: str, limit: int | Column = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs (doc_id, text; other columns are ignored).

    A narrow map over whole texts. Null texts are empty and have no tokens; a null doc_id stays null; repeated rows are
    counted each; an empty table gives no rows. A file other than plain byte-level BPE is an error.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.mapInArrow(_counted(tokenizer), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
