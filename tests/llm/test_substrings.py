"""Seed and extend against plain Python, in numpy and on Spark, with frequent anchors and colliding hashes."""

import random

import numpy as np
import pytest

from earshot.llm import substrings


def repeats(texts, ids, length):
    """For each text its window starts that a text of a smaller id holds too."""
    words, first = [t.split() for t in texts], {}
    for i in np.argsort(ids, kind="stable"):
        for a in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][a : a + length]), ids[i])
    return [{a for a in range(len(w) - length + 1) if first[tuple(w[a : a + length])] < ids[i]} for i, w in enumerate(words)]


def extended(blocks, length, state_of):
    """The same from two blocks that meet in one shard of the extension."""
    windows = [substrings.Windows(texts, length) for texts, _ in blocks]
    holders = {}
    for k, w in enumerate(windows):
        for anchor, doc in zip(w.anchor.tolist(), w.doc[w.place].tolist()):
            holders.setdefault(anchor, set()).add((k, doc))
    state = {a: state_of() if len(d) > 1 else substrings.ALONE for a, d in holders.items()}
    seeds = [w.seeds(np.array([state[a] for a in w.anchor.tolist()], dtype=np.int64), ids) for w, (_, ids) in zip(windows, blocks)]
    index, words = {b"": 0}, []
    for w, s in zip(windows, seeds):
        words.append(np.array([0] + [index.setdefault(v, len(index)) for v in w.vocabulary])[s.words])
    told = substrings.earlier_windows(*(np.concatenate(x) for x in ([s.route for s in seeds], words, [s.low for s in seeds])), length)
    found = []
    for w, s, own, (texts, ids) in zip(windows, seeds, np.split(told, [len(seeds[0].low)]), blocks):
        at = w.at[s.window]
        hit = at[(own[s.seed] >> s.left & 1 > 0) | (s.low[s.seed] < ids[w.doc[at]])]
        first = np.cumsum(w.counts) - w.counts
        found += [{int(x - first[d]) for x in hit if w.doc[x] == d} for d in range(len(texts))]
    return found


@pytest.mark.parametrize("seed", range(30))
def test_extension_matches_brute_force(seed):
    r = random.Random(seed)
    length, words = r.choice([1, 2, 3, 5, 6, 13, 13, 70]), [bytes([97 + k]) for k in range(r.choice([2, 3, 8, 20]))]
    texts = [b" ".join(r.choices(words, k=r.randint(0, 90))) for _ in range(30)]
    texts += [r.choice(texts) + b" " + r.choice(texts) for _ in range(10)]
    ids = np.array([r.randint(-5, 60) for _ in texts])
    blocks = [(texts[:20], ids[:20]), (texts[20:], ids[20:])]
    assert extended(blocks, length, lambda: r.choice([substrings.SHARED, substrings.HOT])) == repeats(texts, ids, length)


def test_words_are_compared_not_hashes(monkeypatch):
    monkeypatch.setattr(substrings.xxhash, "xxh3_64_intdigest", lambda w: len(w))
    r = random.Random(5)
    words = ["".join(r.choices("abc", k=r.randint(1, 3))).encode() for _ in range(12)]
    texts = [b" ".join(r.choices(words, k=40)) for _ in range(20)]
    texts += [t[5:] for t in texts[:5]]
    ids = np.arange(len(texts))
    assert extended([(texts[:13], ids[:13]), (texts[13:], ids[13:])], 5, lambda: substrings.SHARED) == repeats(texts, ids, 5)


def test_frequent_anchors_on_spark(docs, monkeypatch):
    plain = {r.doc_id: r.asDict() for r in substrings.remove_repeats(docs, length=5).collect()}
    monkeypatch.setattr(substrings, "HOT_PLACES", 2)
    assert plain == {r.doc_id: r.asDict() for r in substrings.remove_repeats(docs, length=5).collect()}
