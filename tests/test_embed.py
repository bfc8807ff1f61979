import numpy as np
import pytest

from lectern.operators import embed as E


def load():
    """Hidden states are (id, 1) of each token, so the first token's id decides."""
    return lambda texts: [[len(t), *map(ord, t)] for t in texts], lambda ids, mask: np.stack([ids, np.ones_like(ids)], axis=2) * mask[:, :, None]


def test_embed(spark):
    d = spark.createDataFrame([(k, "x" * k) for k in range(20)] + [(99, None)], "id int, text string")
    got = {r.id: r.v for r in E.embed(d, load).collect()}
    assert got.pop(99) is None and len(got) == 20
    assert all(np.allclose(v, np.array([k, 1]) / np.hypot(k, 1)) for k, v in got.items())


def test_padding_and_zero():
    seen = []

    def encoder(ids, mask):
        seen.append((ids.tolist(), mask.tolist()))
        return np.zeros((*ids.shape, 3))

    assert (E.encode_batch(["", "ab"], lambda ts: [[1] * len(t) for t in ts], encoder) == 0).all()
    assert seen == [([[0, 0], [1, 1]], [[0, 0], [1, 1]])]


def test_missing_model(tmp_path):
    with pytest.raises(FileNotFoundError):
        E.onnx_model(str(tmp_path))
