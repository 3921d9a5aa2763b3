"""Token ids of whole batches against the tokenizers library, text by text."""

import random

import pyarrow as pa
import pytest

pytest.importorskip("lodestone.llm.queries")

from lodestone.llm.queries import tokenizer_path
from lodestone.llm.word_bpe import WordBpe


@pytest.fixture(scope="module")
def tok():
    return WordBpe(tokenizer_path())


def same(tok, texts):
    flat, at = tok.ids(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert flat[at[i] : at[i + 1]].tolist() == [*tok.tokenizer.encode(t or "", add_special_tokens=False).ids, 0], t


def test_every_character(tok):
    chars = [chr(i) for i in range(0x3000) if not 0xD800 <= i < 0xE000]
    same(tok, chars)
    same(tok, [f"x{c}Y" for c in chars])
    same(tok, [f"'{c}" for c in chars])


def test_contractions_specials_and_long_words(tok):
    same(tok, ["", None, " ", "don't he'll WE'VE '''s a'sb 'tis x--'s 're 'RE'd", "<|endoftext|> a<|startoftext|>b <| x<|", "é x", "a" * 500 + " b", "1234 12ab34", "\n\n", "ab" * 40_000])


def test_random_texts_and_a_small_memory():
    """Runs are forgotten when there are more than fit; ids stay the same."""
    r = random.Random(5)
    small = WordBpe(tokenizer_path(), remembered=64)
    chars = [chr(i) for i in range(32, 0x250)] + list("'''''stmdrevl  \n\t<||>") * 20 + ["́", "’", "中", "\U0001f600", " ", "İ"]
    for _ in range(60):
        same(small, ["".join(r.choice(chars) for _ in range(r.randint(0, 60))) for _ in range(30)])
