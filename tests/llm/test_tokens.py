import json
import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docweave.llm.packing import best_fit
from docweave.llm.queries import op4_simple8b_digest, op10_packing_rows
from docweave.llm.simple8b import packed, unpacked
from docweave.llm.tokens import Words, shape

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [" a", "a ", "a  b", "a \nb", "a\n b", "\n", "  ", "", "a b c", "á ́b", "<|endoftext|> x<|endoftext|>,y", "I 'm it's", "ǅ İx ẞ", "\t x\x1cy", "Éa.\nÇb, c\n\nd", "naïve|)] <|startoftext|>"]
TEXTS = [None, *ODD, "word " * 5000, "The same text. " * 40, "The same text. " * 40, "x" * 9000]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_words_equal_the_library(path):
    rnd = random.Random(3)
    whole, words = Tokenizer.from_file(path), Words(path)
    texts = [*ODD, *("".join(rnd.choice(" \n\ta1'sÉé, .Z<|>&\x1ć漢") for _ in range(rnd.randint(1, 30))) for _ in range(2000))]
    for part in (texts, [None], ["", ""], []):
        ids, at = words.batch(pa.array(part, pa.string()), 77)
        assert len(at) == len(part) + 1 and at[-1] == len(ids)
        for i, text in enumerate(part):
            assert ids[at[i] : at[i + 1]].tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 77], repr(text)


def test_files_of_other_shapes_are_encoded_whole(tmp_path):
    file = json.loads(Path(BYTE).read_text())
    file["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(file))
    other = str(tmp_path / "other.json")
    assert (shape(BYTE), shape(WORD), shape(other)) == ("spaced", "spaceless", None)
    ids, at = Words(other).batch(pa.array(["one two", None]), 5)
    assert ids.tolist() == [*Tokenizer.from_file(other).encode("one two", add_special_tokens=False).ids, 5, 5] and at.tolist()[-2:] == [len(ids) - 1, len(ids)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1), st.just(2**60 - 1)), max_size=400))
def test_simple8b_round_trip(ids):
    words, escapes, *_ = packed(np.array(ids, np.uint64))
    assert unpacked(words, escapes).tolist() == ids
    half = len(ids) // 2
    words, escapes, at, lost = packed(np.array(ids, np.uint64), np.array([0, 0, half, len(ids)]))
    assert unpacked(words[: at[2]], escapes[: lost[2]]).tolist() == ids[:half]
    assert unpacked(words[at[2] :], escapes[lost[2] :]).tolist() == ids[half:]


def test_simple8b_zero_runs():
    assert len(packed(np.zeros(480, np.uint64))[0]) == 2


def test_file_order_and_crc(spark):
    df = spark.createDataFrame([(7 * i % 23 + 100 * (i % 3), t, "n") for i, t in enumerate(TEXTS)], "doc_id long, text string, start string").repartition(3)
    got = sorted(op4_simple8b_digest(df, BYTE).collect(), key=lambda r: r.doc_id)
    library, start = Tokenizer.from_file(BYTE), 0
    by_id = {7 * i % 23 + 100 * (i % 3): t for i, t in enumerate(TEXTS)}
    assert [r.doc_id for r in got] == sorted(by_id)
    for r in got:
        ids = library.encode(by_id[r.doc_id] or "", add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert op4_simple8b_digest(df.where("false"), BYTE).count() == 0


def test_packing_rows(spark):
    df = spark.createDataFrame([(i if i else None, t, "n") for i, t in enumerate(TEXTS)], "doc_id long, text string, length string").repartition(3)
    rows = op10_packing_rows(df, WORD).collect()
    library, sequences, docs = Tokenizer.from_file(WORD), defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    for i, text in enumerate(TEXTS):
        ids, at = library.encode(text or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(docs[i or None], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    assert op10_packing_rows(df.where("false"), WORD).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_best_fit_against_a_plain_search(lengths):
    sequence, _ = best_fit(np.array(lengths, np.int64), 64)
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(64 - n)
    assert len(room) == len(set(sequence.tolist()))
