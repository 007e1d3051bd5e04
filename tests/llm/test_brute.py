"""Language and quality verdicts against slow statements of the same methods, a sign and a number at a time."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from quillmark.llm import langid, quality

M = (1 << 64) - 1


def mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


# --- language ID -----------------------------------------------------------------------------------


def letter(code):
    """+-1 signs of a letter: the bits of hashed counters, from the highest of each byte on."""
    bits = []
    for k in range(langid.DIM // 64):
        word = mix(mix((k + code * 1009 + 17) & M))
        for byte in word.to_bytes(8, "little"):
            bits += [1 if byte >> (7 - b) & 1 else -1 for b in range(8)]
    return bits


LETTERS: dict[int, list[int]] = {}


def trigrams(text):
    signs = [0]
    for ch in text:
        code = 0
        if ch.isalpha():
            low = ch.lower()
            code = ord(low) if len(low) == 1 else ord(ch)
        if code or signs[-1]:
            signs.append(code)
    if signs[-1]:
        signs.append(0)
    return [tuple(signs[i : i + 3]) for i in range(len(signs) - 2) if signs[i + 1]]


def bundle(text):
    out = [0] * langid.DIM
    for a, b, c in trigrams(text):
        x, y, z = (LETTERS.setdefault(k, letter(k)) for k in (a, b, c))
        for i in range(langid.DIM):
            out[i] += x[i - 2] * y[i - 1] * z[i]
    return out


def cosine(a, b):
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / size if size else 0.0


def test_languages_are_those_of_bundles_and_cosines(spark):
    r = random.Random(8)
    words = {"en": ["the", "of", "and", "ing", "Thing"], "de": ["der", "und", "über", "Straße", "ein"], "fr": ["les", "été", "ça", "où", "une"]}
    rows = []
    for i in range(36):
        lang = sorted(words)[i % 3]
        rows.append((i, " ".join(r.choice(words[lang]) for _ in range(r.randint(2, 9))) + r.choice(["", ".", " 12!", "…"]), lang if i % 7 else None))
    rows += [(100, "the der les", None), (101, "İstanbul ÀÉ 東京 ẞ", None), (102, "123 -", "en"), (103, None, "de"), (104, "x", None), (None, "the thing", "en"), (105, "the of", "xx"), (0, "the of and", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    import zlib

    learned: dict[str, list[float]] = {}
    texts: dict[tuple[str, int], str] = {}
    for i, t, lang in rows:
        if i is not None and t is not None and lang is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            texts[lang, i] = min(texts.get((lang, i), t), t)
    for (lang, _), t in texts.items():
        v = bundle(t)
        size = math.sqrt(sum(x * x for x in v))
        if size:
            own = learned.setdefault(lang, [0.0] * langid.DIM)
            for k, x in enumerate(v):
                own[k] += x / size
    got = langid.predict(docs, langid.train(docs)).collect()
    by_text = {}
    for x in got:
        by_text.setdefault(x.doc_id, []).append(x)
    for i, t, _ in rows:
        v = bundle(t) if t else []
        if not t or not trigrams(t):
            want = ("und", 0.0)
        else:
            scores = sorted(((-cosine(v, p), lang) for lang, p in learned.items()))
            want = (scores[0][1], max(0.0, -scores[0][0]))
            if len(scores) > 1 and abs(scores[0][0] - scores[1][0]) < 1e-5:
                continue
        assert any(x.lang_pred == want[0] and x.score == pytest.approx(want[1], abs=1e-5) and x.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for x in by_text[i]), (i, want, by_text[i])


# --- quality ---------------------------------------------------------------------------------------

BASE1, BASE2 = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1


def word_hash(w):
    b = w.encode()
    total = sum((x + 1) * pow(BASE1, k, 1 << 64) for k, x in enumerate(b)) & M
    return mix(total ^ (len(b) << 48))


def features(text):
    """Two families of {bucket: share}: words and pairs of words; runs of 3 to 5 code points."""
    import re

    shift, words = 64 - quality.BITS, [word_hash(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    one = [h >> shift for h in words] + [mix((a + b * BASE2) & M) >> shift for a, b in zip(words, words[1:])]
    points = [int.from_bytes(c.encode(), "big") for c in text]
    two = []
    for n in quality.CHARS:
        for i in range(len(points) - n + 1):
            total = sum(points[i + k] * pow(BASE1, k, 1 << 64) for k in range(n)) & M
            two.append((((total ^ (n - 1)) * BASE2 & M) >> shift) + (1 << quality.BITS))
    return [{f: fam.count(f) / len(fam) for f in set(fam)} for fam in (one, two)]


def corpus(seed, n=60):
    r = random.Random(seed)
    good, bad = ["river", "naïve", "stone", "東京", "light", "of", "the"], ["buy", "now", "$$$", "click", "free", "the"]
    texts, labels = [], []
    for i in range(n):
        own = good if i % 2 else bad
        texts.append(" ".join(r.choice(own if r.random() < 0.8 else good + bad) for _ in range(r.randint(3, 30))))
        labels.append(i % 2)
    return texts, np.array(labels)


def test_probabilities_and_verdicts(spark):
    texts, labels = corpus(3)
    model = quality.fit(texts, labels)
    rows = [(i, t) for i, t in enumerate([*texts, "", None, "one", "río ça été " * 9, "x " * 40])]
    got = {r.doc_id: r for r in quality.score(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), model).collect()}
    for i, t in rows:
        z = model.bias + sum(float(model.weights[f]) * share for family in features(t or "") for f, share in family.items())
        p = 1 / (1 + math.exp(-max(-50, min(50, model.a * z + model.b))))
        assert got[i].probability == pytest.approx(p, abs=1e-6)
        assert got[i].kept == (not got[i].base_failed and got[i].probability >= 0.5)
    right = sum(got[i].probability >= 0.5 for i in range(60) if labels[i]) + sum(got[i].probability < 0.5 for i in range(60) if not labels[i])
    assert right >= 54


def test_the_fit_is_a_minimum_and_the_calibration_platt_s():
    """By plain sums: at the fitted weights the penalised log loss of four fifths of the rows hardly falls along its gradient,
    and no neighbour of the calibration has a smaller loss on the fifth."""
    import hashlib

    texts, labels = corpus(4)
    order = sorted(range(len(texts)), key=lambda k: hashlib.sha256(f"{labels[k]}{texts[k]}".encode()).digest())
    rows = [features(texts[k]) for k in order]
    y = [int(labels[k]) for k in order]
    fold = [k % 5 == 4 for k in range(len(rows))]
    scale = [1 / math.sqrt(sum(s * s for r in rows for s in r[f].values()) / len(rows)) for f in (0, 1)]
    model = quality.fit(texts, labels, steps=400)
    weight = lambda f: float(model.weights[f]) / scale[f >> quality.BITS]
    z = [model.bias + sum(weight(f) * s * scale[k] for k in (0, 1) for f, s in r[k].items()) for r in rows]
    used = [k for k, held in enumerate(fold) if not held]
    g = {k: (1 / (1 + math.exp(-z[k])) - y[k]) / len(used) for k in used}
    grad: dict[int, float] = {}
    for k in used:
        for fam in (0, 1):
            for f, s in rows[k][fam].items():
                grad[f] = grad.get(f, 0.0) + g[k] * s * scale[fam]
    size = math.sqrt(sum((v + quality.RIDGE * weight(f)) ** 2 for f, v in grad.items()) + sum(g.values()) ** 2)
    assert size < 0.02

    held = [k for k, h in enumerate(fold) if h]
    good = sum(y[k] for k in held)
    target = {k: (good + 1) / (good + 2) if y[k] else 1 / (len(held) - good + 2) for k in held}
    loss = lambda a, b: sum(math.log1p(math.exp(-abs(a * z[k] + b))) + max(a * z[k] + b, 0) - target[k] * (a * z[k] + b) for k in held)
    here = loss(model.a, model.b)
    for da in (-0.05, 0, 0.05):
        for db in (-0.05, 0, 0.05):
            assert loss(model.a * (1 + da), model.b + db) >= here - 1e-6
