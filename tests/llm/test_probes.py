"""Filters that stay apart (op3): how n-grams are probed."""

import numpy as np
import pandas as pd

from codeloom.llm import language_model


def test_filters_apart_are_probed_together(tmp_path, monkeypatch):
    """With many buckets every chunk asks a few n-grams of each; one call for each of those made larger corpora slow (op3)."""
    rng, sent, want = np.random.default_rng(7), [], []
    for bucket in range(3):
        keys = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
        levels = 1 + np.arange(600) % 5
        (tmp_path / f"f{bucket}").write_bytes(language_model.bloom(keys, levels).tobytes())
        if bucket < 2:  # the last one has no filter
            sent.append((-1, 1, bucket, None, f"file://{tmp_path}/f{bucket}"))
        for chunk in range(200):
            sent.append((chunk, 1, bucket, keys[3 * chunk:3 * chunk + 3].tobytes(), None))
            want.append((chunk, 1, bucket, (levels if bucket < 2 else 0 * levels)[3 * chunk:3 * chunk + 3].tolist()))
    calls, plain = [], language_model.Filters.levels
    monkeypatch.setattr(language_model.Filters, "levels", lambda self, keys: calls.append(len(keys)) or plain(self, keys))
    rows = pd.DataFrame(sent, columns=["chunk", "kind", "bucket", "keys", "name"])
    got = [r for part in language_model.probe(iter([rows.iloc[:250], rows.iloc[250:]])) for r in part.itertuples(index=False)]
    assert [r[:3] for r in got] == [w[:3] for w in want]
    assert all((np.frombuffer(r.levels, np.uint8) >= w[3]).all() for r, w in zip(got, want, strict=True))  # a filter may say more
    assert np.mean([np.array_equal(np.frombuffer(r.levels, np.uint8), w[3]) for r, w in zip(got, want, strict=True)]) > 0.8
    assert len(calls) == 3 and sum(calls) == 1200
