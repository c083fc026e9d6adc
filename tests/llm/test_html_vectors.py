import numpy as np

from tidegrid.llm.html_extract import PATH, WORD, Block, vectors


def vector(text):
    return vectors([Block(text, None, 0)])[0]


def test_every_word_and_digit_of_a_block_counts():
    head = "one two three four five six seven eight nine ten eleven twelve "
    a, b = vector(head + "cookies"), vector(head + "advertisement")
    assert (a[PATH : PATH + WORD] != b[PATH : PATH + WORD]).any()
    assert (vector("abcdefghijklmn")[PATH : PATH + WORD] != vector("abcdefghijklop")[PATH : PATH + WORD]).any()
    assert np.isclose(vector("word " * 500)[PATH : PATH + WORD].sum(), 3.6, atol=1e-3)
    assert np.isclose(vector("a" * 300 + "1" * 100)[PATH + WORD + 5], 0.25)
