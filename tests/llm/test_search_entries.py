"""The search of many words sorts only entries that can still be among the two best."""

import numpy as np
from strataflow.llm import pieces as P


def test_entries_that_cannot_stay_are_not_sorted(monkeypatch):
    lattice = P.Lattice(P.load())
    r = np.random.default_rng(5)
    words = ["▁" + "".join(r.choice(list("aeinrst"), r.integers(1, 20))) for _ in range(400)] + ["▁aaaaaaaaaaaa", "a", "▁", "日本🙂", "▁the"]
    sizes, sort = [], np.lexsort
    monkeypatch.setattr(P.np, "lexsort", lambda keys: sizes.append(len(keys[0])) or sort(keys))
    many = P.ManyLattices(lattice)
    string, score, starts, ids = many(words, 2)
    edges, steps = len(many.end), sum(sizes)
    got: dict = {i: [] for i in range(len(words))}
    for k, (i, s) in enumerate(zip(string.tolist(), score.tolist(), strict=True)):
        got[i].append((round(s, 9), ids[starts[k] : starts[k + 1]].tolist()))
    for i, w in enumerate(words):
        assert got[i] == [(round(s, 9), list(x)) for s, x in lattice.nbest(w, 2)]
    assert steps < 0.75 * edges
