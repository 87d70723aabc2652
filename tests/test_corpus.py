"""Near copies across sources: the filters lose no link, and a common passage doesn't join all its texts."""

from __future__ import annotations

import random

import numpy as np
import pytest

from archivolt.operators import corpus

SCHEMA = "id long, text string"


def drawn_texts(seed, n=60):
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(4000)}"
    passages = [" ".join(word() for _ in range(40)) for _ in range(3)]
    texts = []
    for i in range(n):
        body = " ".join(word() for _ in range(draw.choice((3, 10, 60, 120))))
        texts.append(f"{passages[i % 3]} {body}" if i % 4 else body)
    for i in range(n):
        words = draw.choice(texts).split(" ")
        for _ in range(draw.randrange(5)):
            words[draw.randrange(len(words))] = word()
        texts.append(" ".join([*words, *passages[i % 3].split(" ")[: draw.choice((0, 0, 12))]]))
    return texts + ["", "one", "one", "One  ", "two words"]


def components(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return {i: r for i, r in enumerate(root) if r != i}


@pytest.mark.parametrize(("sampled", "crowded"), [(10_000, 64), (5, 4)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, sampled, crowded):
    """With few sampled texts no passage is known beforehand, so the crowded hashes have to move back."""
    monkeypatch.setattr(corpus, "SAMPLED", sampled)
    monkeypatch.setattr(corpus, "CROWDED", crowded)
    texts = drawn_texts(crowded)
    got = {r["id"]: r["dup_of"] for r in corpus.near_copies(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert got == components(texts) and len(got) > 20


def test_filters_keep_every_similar_pair():
    draw = random.Random(8)
    none = np.zeros(0, np.int64)
    for _ in range(400):
        n = draw.randint(1, 80)
        base = np.array(draw.sample(range(10**6), n), np.int64)
        keep = base[: max(1, n - draw.randint(0, n // 5 + 1))]
        other = np.unique(np.concatenate([keep, np.array(draw.sample(range(10**6, 2 * 10**6), draw.randint(0, n // 6 + 1)), np.int64)]))
        base = np.unique(base)
        common = len(np.intersect1d(base, other))
        if 5 * common < 4 * (len(base) + len(other) - common):
            continue
        late = np.array(draw.sample(list(base), len(base) // 3), np.int64)
        for behind in (None, late):
            x, y = corpus._in_order(base, none, none, behind), corpus._in_order(other, none, none, behind)
            px, py = x[: corpus._prefix(len(x))].tolist(), y[: corpus._prefix(len(y))].tolist()
            met = set(px) & set(py)
            assert met
            for h in met:  # the bound by places holds wherever the two meet
                i, j = px.index(h), py.index(h)
                assert 9 * (min(i, j) + min(len(x) - i, len(y) - j)) >= 4 * (len(x) + len(y))
        bits = [np.unpackbits(np.frombuffer(corpus._parities(s), np.uint8)) for s in (base, other)]
        assert 9 * int((bits[0] ^ bits[1]).sum()) <= len(base) + len(other)


def test_a_passage_of_five_thousand_texts(spark, monkeypatch):
    """Nobody meets for the passage alone, whether or not the sample has told it; planted copies are found."""
    draw = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [" ".join([*(f"a{draw.randrange(10**6)}" for _ in range(30)), passage, *(f"b{draw.randrange(10**6)}" for _ in range(30))]) for _ in range(5000)]
    texts += [t + " more" for t in texts[:20]]
    pairs, similar = [], corpus._similar
    monkeypatch.setattr(corpus, "_similar", lambda p, *rest: (pairs.append(p.count()), similar(p, *rest))[1])
    for sampled in (10_000, 50):
        monkeypatch.setattr(corpus, "SAMPLED", sampled)
        got = {r["id"]: r["dup_of"] for r in corpus.near_copies(spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(4)).collect()}
        assert got == {5000 + i: i for i in range(20)}
    assert max(pairs) < 20_000  # all pairs would be twelve million


def test_a_passage_that_a_sample_hardly_tells_moves_no_text(spark, monkeypatch):
    """Counted with all other shingles it stands last from the start; no text has to be read again for it."""
    draw = random.Random(5)
    word = lambda: f"w{draw.randrange(10**6)}"
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [" ".join([*(word() for _ in range(40)), passage if i % 10 == 0 else "", *(word() for _ in range(40))]) for i in range(400)]
    texts += [t + " more" for t in texts[:6]]
    read, later = [], corpus._later
    monkeypatch.setattr(corpus, "SAMPLED", 20)
    monkeypatch.setattr(corpus, "CROWDED", 8)
    monkeypatch.setattr(corpus, "_later", lambda t, *rest: (read.append(t.count()), later(t, *rest))[1])
    got = {r["id"]: r["dup_of"] for r in corpus.near_copies(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert got == {400 + i: i for i in range(6)} and not read
