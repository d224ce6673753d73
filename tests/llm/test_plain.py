"""Models and fingerprints against versions written out from their definitions."""

import math
import random

import numpy as np

from sunloom.llm import classifier, langid, syncmers

ALL = (1 << 64) - 1


def test_ridge_equals_the_dual_solution():
    """With every text a landmark, the fitted scores are kernel ridge regression solved in the dual."""
    rng = random.Random(3)
    alphabets = {"aa": "abcdefgh", "bb": "ghijklmn", "cc": "nopqrstu"}
    rows = [(c, " ".join("".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(8))) for c, letters in alphabets.items() for _ in range({"aa": 12, "bb": 6, "cc": 9}[c])]
    shape = langid.Shape(grams=4096, landmarks=len(rows), ridge=0.05)
    x, y = np.array([langid.presence(t, shape.grams) for _, t in rows], dtype=np.float32), [c for c, _ in rows]
    model = langid.fit(x, y, shape)
    new = np.array([langid.presence("".join(rng.choices("abghnouv ", k=50)), shape.grams) for _ in range(40)], dtype=np.float32)

    def plain(a, b):
        return np.array([[float(p @ q) / math.sqrt(max(p.sum(), 1) * max(q.sum(), 1)) for q in b] for p in a]) + 1

    weight = np.array([len(y) / (y.count(c) * 3) for c in y])
    target = np.array([[1.0 if c == k else -1.0 for k in sorted(alphabets)] for c in y])
    want = plain(new, x) @ np.linalg.solve(plain(x, x) + shape.ridge * np.diag(1 / weight), target)
    got = model.scores(new)
    assert np.allclose(got, want, atol=2e-3) and (got.argmax(axis=1) == want.argmax(axis=1)).mean() > 0.95


def test_machine_by_all_pairs_and_descent():
    """Margins by the double sum over pairs; the fit separates what only a pair of words tells."""
    rng = np.random.default_rng(1)
    m = classifier.Machine(0.3, rng.standard_normal(6).astype(np.float32), rng.standard_normal((6, 3)).astype(np.float32), rng.standard_normal(6).astype(np.float32), rng.random(6).astype(np.float32))
    x = rng.standard_normal((20, 6)).astype(np.float32)
    for row, got in zip(x, m.score(x), strict=True):
        z = [(float(v) - float(a)) * float(s) for v, a, s in zip(row, m.mean, m.scale, strict=True)]
        margin = 0.3 + sum(a * float(b) for a, b in zip(z, m.w, strict=True)) + sum(z[i] * z[j] * float(m.v[i] @ m.v[j]) for i in range(6) for j in range(i))
        assert abs(got - 1 / (1 + math.exp(-margin))) < 1e-4
    bits = rng.integers(0, 2, (600, 2))
    texts = np.zeros((600, classifier.Shape().words + classifier.STATS), dtype=np.float32)
    texts[:, -2:] = bits
    y = (bits[:, 0] ^ bits[:, 1]).astype(np.float32)
    fitted = classifier.fit(texts.copy(), y, classifier.Shape(epochs=120))
    assert ((fitted.score(texts) > 0.5) == y).mean() > 0.95


def plain_hash(b, last):
    h = 0
    for c in b:
        h = (h * syncmers._MULT + c + 1) & ALL
    h = ((h ^ (h >> (29 if last == 32 else 31))) * 0xD6E8FEB86659FD93) & ALL
    return h ^ (h >> last)


def test_anchors_and_hashes_by_definition():
    rng = random.Random(5)
    raw = "".join(rng.choice("abc de\nfé") for _ in range(500)).encode() + b"repeat this line " * 20
    want = []
    for i in range(len(raw) - syncmers.K + 1):
        window = raw[i : i + syncmers.K]
        inner = [plain_hash(window[j : j + syncmers.S], 32) for j in range(syncmers.K - syncmers.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            want.append((plain_hash(window, 33), i))
    h, at = syncmers.anchors(raw)
    assert list(zip(h.tolist(), at.tolist(), strict=True)) == want
