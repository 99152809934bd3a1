import json
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docweave.llm.queries import op12_token_counts_rows
from docweave.llm.token_counts import Merges

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OURS = Merges(PATH)


def expected(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def odd_texts():
    rnd = random.Random(3)
    out = ["", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "don't we'll I'M", "aaaa" * 50, "abab" * 33, " x　y", "1234 5678901", "!!! ??? ...", "\x00\x01", "é \U0001f600\U0001f468‍\U0001f469", "日本語のテキスト", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", " <|endoftext|> x  <|endoftext|>", "<|endoftext", "x" * 3000, "".join(rnd.choice("abcdefgh") for _ in range(5000))]
    out += [" ".join("".join(rnd.choice("etaoinshrdluéß9.,'-\n\t ") for _ in range(rnd.randint(1, 12))) for _ in range(rnd.randint(1, 200))) for _ in range(60)]
    return out


def test_counts_of_odd_texts():
    texts = odd_texts()
    assert OURS.totals(texts) == expected(texts)
    assert OURS.totals(texts[::-1]) == expected(texts)[::-1]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_counts_of_any_text(text):
    assert OURS.totals([text, text + "'ll  " + text]) == expected([text, text + "'ll  " + text])


@pytest.mark.parametrize("at_once", [True, False])
def test_small_vocabularies(tmp_path, at_once):
    """Random merges, also ones in which a later merge makes part of an earlier one."""
    rnd = random.Random(5)
    file = json.load(open(PATH))
    for trial in range(30):
        vocab = {c: i for i, c in enumerate(k for k in file["model"]["vocab"] if len(k) == 1)}
        merges, pool = [], ["a", "b", "Ġ"]
        while len(merges) < 25:
            a, b = rnd.choice(pool), rnd.choice(pool)
            if [a, b] not in merges and len(a + b) < 12 and a + b not in vocab:
                merges.append([a, b])
                vocab[a + b] = len(vocab)
                pool.append(a + b)
        if not at_once:
            rnd.shuffle(merges)
        path = tmp_path / f"{trial}.json"
        path.write_text(json.dumps(file | {"added_tokens": [], "model": file["model"] | {"vocab": vocab, "merges": merges}}))
        library, ours = Tokenizer.from_file(str(path)), Merges(str(path))
        assert ours.at_once or not at_once
        texts = [" ".join("".join(rnd.choice("ab") for _ in range(rnd.randint(1, 40))) for _ in range(6)) for _ in range(20)]
        assert ours.totals(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="no plain byte-level"):
        Merges(public_tokenizers.path("word_bpe_49k.json"))


def test_rows(spark):
    texts = [None, *odd_texts(), "word " * 511 + "end", "word " * 512 + "end", "word " * 513]
    rows = [(i if i != 4 else None, t, "x", 1) for i, t in enumerate(texts)] + [(7, texts[7], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, over_limit int").repartition(3)
    got = sorted((tuple(r) for r in op12_token_counts_rows(df).collect()), key=str)
    want = [(i, len((t or "").encode()), n, n > 512) for (i, t, _, _), n in zip(rows, expected([t or "" for _, t, _, _ in rows]))]
    assert got == sorted(want, key=str)
    assert op12_token_counts_rows(df.where("false")).count() == 0
