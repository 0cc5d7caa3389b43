"""Scores of op8 are made for many texts at once, and depend neither on the other texts nor on their order."""

import pickle

import numpy as np

from loomwell.llm import toxicity


def test_scores_do_not_depend_on_the_texts_beside():
    rng = np.random.default_rng(3)
    vocabulary = ["".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(900)]
    texts = [" ".join(vocabulary[int(900 * x**2)] for x in rng.random(60)) for _ in range(300)]
    model = pickle.loads(pickle.dumps(toxicity.fit(texts, [i % 2 for i in range(300)], list(range(300)))))
    asked = [*texts[:70], "", "qqqq", *texts[5:40]]
    together = list(model.scores(asked))
    assert list(model.scores(asked[::-1]))[::-1] == together
    assert [model.score(text) for text in asked] == together
    assert together[70] == (model.without, [])
    exact = model.lists * toxicity.GRID
    assert (exact == np.rint(exact)).all()
