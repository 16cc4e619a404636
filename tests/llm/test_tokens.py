"""Texts cut into pieces against whole texts, and how much of a text the tokenizer library sees."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from veilmark.llm.queries import tokenizer
from veilmark.llm.tokens import Encoder

KINDS = [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")]
TEXTS = [
    None, "", " ", "  ", "a ", "a  b", "a \n b", "x\n\ny", "x\n\n\ny z", "of.\nHahe it.\r\nNo", "\na b\n", "Ab..\n Cd",
    "it's don't. 's we'll, I'd'm", "<|endoftext|> a <|endoftext|>.b x<|startoftext|>", "12 3.4,5 abc123 abc_def a-b-c ...",
    "é x = ≠. ≮ K Å ﬁ.", "İstanbul ΣΑΣ. ß ÿ Ÿ.", "a b c　 d\x85e \x85f \x1cg",
    "日本語 テスト。 Мир\nХай", "\t a\tb\x0bc\x0cd\re", "x" * 300 + ". y", "(Hello) [World]! \"Hi\" a`b~ {x}",
]


@pytest.mark.parametrize("kind, name", KINDS)
@pytest.mark.parametrize("keep", [3, 1_000_000])
def test_ids_are_those_of_whole_texts(kind, name, keep):
    whole = Tokenizer.from_file(tokenizer(name))
    want = [np.array(whole.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in TEXTS]
    encode = Encoder(tokenizer(name), kind, keep=keep)
    assert encode(TEXTS) == want
    assert encode(TEXTS[::-1]) == want[::-1]
    assert [encode([t])[0] for t in TEXTS] == want
    assert encode([]) == []


class Counting:
    def __init__(self, inner):
        self.inner, self.seen = inner, []

    def encode_batch_fast(self, texts, **options):
        self.seen += texts
        return self.inner.encode_batch_fast(texts, **options)


@pytest.mark.parametrize("kind, name", KINDS)
def test_letters_are_encoded_once(kind, name):
    """A word is encoded once, whatever marks and lines stand around it, and new words in one call."""
    encode = Encoder(tokenizer(name), kind)
    encode.tokenizer = counting = Counting(encode.tokenizer)
    words = [f"{a}o{b}" for a in ("th", "er", "st") for b in ("lin", "ger", "mat")]
    text = "so " + " ".join(f"{w} {w}. {w}, {w}; ({w}" for w in words)
    assert encode([text]) == [np.array(counting.inner.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    # Words behind a bracket are left whole.
    plain = [t for t in counting.seen if "(" not in t]
    assert all(sum(t.count(w) for t in plain) == 1 for w in words) and len(plain) < len(words)


def test_other_pre_tokenizers_are_not_cut_further():
    encode = Encoder(tokenizer("byte_bpe_50k.json"), "word")
    assert not encode.finer
