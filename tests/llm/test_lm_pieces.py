"""op2: the quick forms of subwords, windows and training steps give what the plain ones give."""

import struct

import numpy as np
import xxhash

from linewise.llm import op2_lm as LM
from linewise.llm.attention import WINDOW, Attention

WORDS = ["house", "house.", "don't", "'s", "it's'", "ciónes", "éa!?", "x1", "12", "...", "a.b", "straße,", "слово", "á", "ªº", "a b", "中文.", "a×", "\x1c", "w" * 90]


class Counting:
    """An encoding that counts the searches for pieces."""

    def __init__(self, encoding):
        self.encoding, self.searches = encoding, 0

    def encode_ordinary(self, text):
        self.searches += 1
        return self.encoding.encode_ordinary(text)

    def __getattr__(self, name):
        return getattr(self.encoding, name)


def test_subwords_of_letters_need_no_search_and_equal_the_librarys():
    sub = LM.Subwords(LM.ranks())
    library = sub.encoding
    sub.encoding = Counting(library)
    for w in [x.encode() for x in WORDS] + [b"\xed\xa0\x80", b"ab\xff"]:
        want = library.encode_ordinary(" " + w.decode("utf-8", "replace"))
        assert np.frombuffer(sub.word(w), np.uint16).tolist() == want
    sub.encoding.searches = 0
    for w in ("Haus", "haus,", "maisoné", "maisoné)..", "w" * 90):
        sub.word(w.encode())
    assert sub.encoding.searches == 0


def test_windows_of_a_text_are_those_cut_one_by_one():
    rng = np.random.default_rng(5)
    for size in (1, 2, WINDOW - 1, WINDOW, WINDOW + 1, 3 * WINDOW, 200):
        ids, key, n = rng.integers(0, 8192, size), int(rng.integers(-2 ** 63, 2 ** 63)), 8192
        padded = [n, *ids.tolist(), *[n + 1] * WINDOW]
        want = [struct.pack("<qq", key, a) + np.array(padded[a:a + WINDOW + 1], np.uint16).tobytes() for a in range(0, size, WINDOW)]
        got = LM.windows_of(key, ids, n)
        assert [w.tobytes() for w in got] == want
        assert [xxhash.xxh64_intdigest(w, seed=3) for w in got] == [xxhash.xxh64_intdigest(w, seed=3) for w in want]


def test_training_is_adam_on_the_gradient():
    rng = np.random.default_rng(2)
    counts = rng.integers(1, 50, 40)
    w = rng.integers(0, 40, (50, WINDOW + 1))
    m, plain = Attention(counts), Attention(counts)
    m.train(w, np.ones((50, WINDOW), bool), 0.01, batch=20)
    one, two = ({k: np.zeros_like(v) for k, v in plain.p.items()} for _ in range(2))
    for step, a in enumerate(range(0, 50, 20), 1):
        loss, g = plain.gradient(w[a:a + 20, :-1], w[a:a + 20, 1:], np.ones((len(w[a:a + 20]), WINDOW), bool))
        assert np.isfinite(loss)
        lr = float(0.01 * step / 20 * (1 - 0.99 ** step) ** 0.5 / (1 - 0.9 ** step))
        for k, x in g.items():
            one[k] += 0.1 * (x - one[k])
            two[k] += 0.01 * (x * x - two[k])
            plain.p[k] -= lr * one[k] / (np.sqrt(two[k]) + 1e-7)
    for k in m.p:
        assert np.allclose(m.p[k], plain.p[k], rtol=1e-5, atol=1e-6)
    assert np.isnan(m.gradient(w[:, :-1], w[:, 1:], np.ones((50, WINDOW), bool), with_loss=False)[0])
