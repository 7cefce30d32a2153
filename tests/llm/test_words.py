import random
import re

import numpy as np

from wardline.llm.words import shingle_set, window_hashes, word_hashes

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def test_words_are_runs_without_white_space_whatever_the_block():
    rng = random.Random(1)
    text = bytes(rng.choice(b"abAB \n\t\x0b\x0c\x1c\x85") for _ in range(4000))
    words = WORD.findall(text)
    one = word_hashes(text)
    assert len(one) == len(words)
    for block in (1, 7, 64, 4096):
        assert (word_hashes(text, block=block) == one).all()
    by_word = {}
    for w, h in zip(words, one.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    assert (word_hashes(b"Ab \xc3\x89", lower=True) == word_hashes(b"aB \xc3\x89", lower=True)).all()


def test_windows_depend_on_their_words_only():
    words = np.array([word_hashes(b"%d" % (i % 7))[0] for i in range(60)])
    hashes = window_hashes(words, 5)
    assert len(hashes) == 56 and len(set(hashes.tolist())) == 7
    assert (hashes[7:] == hashes[:-7]).all()
    assert len(window_hashes(words[:4], 5)) == 0 and len(shingle_set(words[:0], 4)) == 0 and len(shingle_set(words[:2], 4)) == 1
