"""The classifier's convolution, pooling and score against loops over places."""

import numpy as np
import pytest

from coilwave.llm import quality_cnn as Q


@pytest.fixture
def network():
    rng = np.random.default_rng(6)
    return Q.Network(rng.normal(size=(Q.WIDTH, 256, Q.FILTERS)).astype(np.float32), rng.normal(size=Q.FILTERS).astype(np.float32), rng.normal(size=2 * Q.FILTERS), 0.3)


def plain_score(net, text):
    """Chunks of CHUNK bytes that overlap by OVERLAP and cover the text; each filter's greatest response, cut at 0; mean and maximum over chunks."""
    vectors, begin = [], 0
    while text:
        chunk = text[begin : begin + Q.CHUNK]
        padded = chunk + bytes(Q.WIDTH - 1)
        response = [sum(net.table[j, padded[i + j]].astype(float) for j in range(Q.WIDTH)) for i in range(len(chunk))]
        vectors.append(np.maximum(np.max(response, axis=0) + net.bias, 0))
        if begin + Q.CHUNK >= len(text):
            break
        begin += Q.CHUNK - Q.OVERLAP
    joined = np.concatenate([np.mean(vectors, axis=0), np.max(vectors, axis=0)]) if vectors else np.zeros(2 * Q.FILTERS)
    return 1 / (1 + np.exp(-(joined @ net.out + net.offset)))


def test_scores_of_texts_of_any_length(network):
    rng = np.random.default_rng(7)
    texts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (1, 5, 0, 127, 128, 1023, 1024, 1025, 1920, 1921, 5000, 0)]
    at = np.append(0, np.cumsum([len(t) for t in texts]))
    got = Q.score(network, np.frombuffer(b"".join(texts), np.uint8), at)
    assert got == pytest.approx([plain_score(network, t) for t in texts], rel=1e-4, abs=1e-6)
    assert got[2] == got[-1] == pytest.approx(1 / (1 + np.exp(-0.3)))


def test_training_lowers_the_loss():
    rng = np.random.default_rng(8)
    words = [[b"good ", b"fine "], [b"bad! ", b"%%% "]]
    texts = [b"".join(words[k % 2][i] for i in rng.integers(0, 2, 40)) for k in range(60)]
    label = np.array([1 - k % 2 for k in range(60)])
    at = np.append(0, np.cumsum([len(t) for t in texts]))
    loss = lambda p: float(-np.log(np.where(label == 1, p, 1 - p)).mean())
    before, after = (Q.score(Q.train(texts, label, epochs=e), np.frombuffer(b"".join(texts), np.uint8), at) for e in (0, 4))
    assert loss(after) < 0.5 * loss(before) and ((after > 0.5) == (label == 1)).all()
