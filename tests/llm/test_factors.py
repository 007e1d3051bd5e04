"""Factors of the substring operator against a greedy parse by plain word comparison."""

from __future__ import annotations

import random

import pytest

from quillmark.llm import substrings


def greedy(docs, window):
    """{doc: [(start, end, source doc, source start)]}: from each position that starts a match, the longest match with the
    reference, which holds every window at its first place only; then from the first position whose window isn't in the factor."""
    words = {i: t.split() for i, t in docs}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s : s + window]), (i, s))
    reference = set(first.values())
    out = {}
    for i, w in words.items():
        out[i], s = [], 0
        while s + window <= len(w):
            d, p = first[tuple(w[s : s + window])]
            if (d, p) == (i, s):
                s += 1
                continue
            n = window
            # word by word, as far as the source says the same and its text belongs to the reference
            while s + n < len(w) and p + n < len(words[d]) and words[d][p + n] == w[s + n] and (d, p + n - window + 1) in reference and (d, p + n - window + 1) != (i, s + n - window + 1):
                n += 1
            out[i].append((s, s + n, d, p))
            s += n - window + 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_factors_are_the_longest_matches(spark, seed):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(6 if seed % 2 else 300)]
    new = lambda n: [r.choice(vocab) for _ in range(n)]
    docs = [new(r.randint(0, 60)) for _ in range(12)]
    for _ in range(30):  # nested copies: pieces of what may be copies already
        parts = []
        for _ in range(r.randint(1, 4)):
            d = r.choice(docs)
            a = r.randrange(len(d) + 1)
            parts += d[a : a + r.randint(0, 50)] + new(r.randint(0, 4))
        docs.append(parts)
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {x.doc_id: [tuple(s) for s in x.spans] for x in substrings.find_spans(df, window=8, run_words=4, block_bytes=400).collect()}
    want = greedy(rows, 8)
    assert got == want and sum(map(len, want.values())) > 20
