"""Long texts are scored whole: no word is cut, and occurrences are counted over all of a text."""

import numpy as np

from cohortmart.llm import ngrams, toxicity


def test_pieces_of_whole_texts():
    texts = ["a" * 5, "b" * 30, "", "c" * 2, "d" * 9]
    got = list(ngrams.pieces(texts, 0, 8, whole=True))
    assert [p for _, parts, _ in got for p in parts] == texts and [i for index, _, _ in got for i in index] == list(range(5))
    assert all(sum(map(len, parts[:-1])) < 8 for _, parts, _ in got)


def test_a_long_text_scores_like_a_short_one_of_the_same_words():
    points, cuts = toxicity.code_points([toxicity.running("wog bad fine")])
    keys = np.unique(toxicity._hashes(points, toxicity.places(points, cuts)))
    gains = toxicity.HashTable(keys, np.linspace(-1, 3, len(keys)).astype(np.float32))
    none = toxicity.HashTable(np.zeros(0, np.uint64), np.zeros(0, np.float32))
    texts = ["wog bad fine " * n for n in (1, 50, 150_000)]
    x = toxicity.features(texts, gains, none)
    assert len(texts[2]) > 1 << 20 and np.allclose(x, x[0], atol=1e-9)
