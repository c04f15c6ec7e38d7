import random

import numpy as np
import pytest

from tidemark.llm import encoding, queries

PIECES = [
    "<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|startoftext|>", "<|", "|>", "İ", "İ.", "ı", "ſ", "K", "é", "é", "́", "̇", "ß", "ﬁ", "Ǆ", "ǅ", "語", "한", "각", "ü", "Ü",
    "'s", "'S", "'ll", "n't", "’s", "1", "12", "3.5", "½", "Ⅷ", "_", "...", ".", ",", ";", ":", "!", "?", "!?", "#", "$$$", "&&&", "-", "(", ")", "a", "B", "word", "Word", "ofreth", "été.", "É,", "naïve;",
    " ", " ", " ", " ", "  ", "\n", "\n", "\n\n", "\r\n", "\r", "\t", "\x0b", "\x0c", "\x00", "\x01", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "​", "﻿", "🙂", "🇩🇪", "͸", "\U0010ffff", "ͅ", "Σ", "ς.", "ΑΣ",
]


@pytest.mark.parametrize("name, style", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_ids_are_the_librarys(name, style):
    """Words, marks, white space, combining marks, controls and case variants of added tokens in any order."""
    from tokenizers import Tokenizer

    rng, path = random.Random(7), queries.vocabulary(name)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 9))) for _ in range(8000)]
    texts += [" ".join(rng.choice(PIECES) for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    ours = encoding.WordCacheEncoder(path, style)
    for i, j in [(0, 100), (100, 5000), (5000, len(texts)), (0, len(texts))]:
        got = [np.frombuffer(x, "<u2").tolist() for x in ours.encode(texts[i:j])]
        wrong = [(t, g, w) for t, g, w in zip(texts[i:j], got, want[i:j], strict=True) if g != w]
        assert not wrong, wrong[:5]
    assert ours.encode([None, ""]) == [b"", b""]


@pytest.mark.parametrize("name, style, model", [("byte_bpe_50k.json", "byte", 4), ("word_bpe_49k.json", "word", 1)])
def test_a_word_is_encoded_once_whatever_marks_follow(name, style, model):
    """The library meets runs of marks alone, the model a word (in the word style in any case) once, and slices of Arrow arrays are texts."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path, seen, words = queries.vocabulary(name), [], []
    ours, library = encoding.WordCacheEncoder(path, style), Tokenizer.from_file(path)
    batch = type("Library", (), {"encode_batch_fast": lambda self, t, **k: (seen.extend(t), library.encode_batch_fast(t, **k))[1]})()
    whole = ours.model
    ours.tokenizer, ours.model = batch, lambda w: (words.append(w), whole(w))[1]
    texts = ["none", "ofréth*** ofréth,### OFRÉTH!!\nofréth Ofréth.", None, "ofréth??? ofréth", ""]
    got = ours.encode(pa.array(texts).slice(1))
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts[1:]]
    assert sorted(x for x in seen if x) == sorted(["***", ",###", "!!", ".", "???"]) and len(words) == model, (seen, words)


def test_chunks_cover_an_array():
    import pyarrow as pa

    texts = pa.array(["abc", None, "", "défg", "h" * 30, "i", None])
    parts = list(encoding.chunks(texts.slice(1), 5))
    assert [x for _, part in parts for x in part.to_pylist()] == texts.to_pylist()[1:]
    assert [at for at, _ in parts] == [0, 3, 4] and not list(encoding.chunks(texts.slice(7)))
