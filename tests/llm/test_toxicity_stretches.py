"""A long text scores as if it were not cut into stretches."""

import numpy as np
from tidewatch.llm import toxicity_cnn


def test_stretches_score_like_the_whole(monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{n}" for n in range(200)]
    texts = [[words[k] for k in rng.integers(0, 200, n)] for n in (0, 1, 15, 16, 17, 18, 19, 33, 90, 400)]
    model = toxicity_cnn.TextCnn([words] * toxicity_cnn.LEAST_TEXTS)
    model.embedding = np.abs(model.embedding)  # so that a word before padding answers more than any before a word
    model.filters = {w: np.concatenate([np.abs(f[:1]), -np.abs(f[1:])]) for w, f in model.filters.items()}
    rows = model.numbers(texts)
    whole = model.logits(rows)
    monkeypatch.setattr(toxicity_cnn, "STRETCH", 16)
    np.testing.assert_allclose(model.logits(rows), whole, atol=1e-5)
