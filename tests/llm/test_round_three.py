"""Divergence of sources, packing by swaps and the conversation trie against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from earshot.llm import best_fit, divergence, prefix_trie

CONV = "conv_id long, turn long, role string, text string"


# ---- conversation trie


def plain_trie(rows):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    rebuilt = {}
    for c, turns in own.items():
        base = c - (c - 20 * int(c / 20))
        h = 0 if base == c else zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    n_words = lambda path: len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
    out = set()
    for path, m in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = lambda p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p]
        ends = sorted(c for c in m if len(rebuilt[c]) == len(path))
        out.add(
            (
                min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(kids(path)), sum(not kids(p) for p in below),
                sum((len(members[p]) - 1) * n_words(p) for p in below), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return out


def conversations(n=70, seed=5):
    r = random.Random(seed)
    texts = ["hello there", "what is it", None, "", "  one\ttwo\n", "ünï çödé", "a" * 3000, "x y z"]
    rows = []
    for c in [*range(n), -3, -20, -27, 10**12 + 7, 10**12]:
        if c == 40:
            continue  # an absent base
        k = r.choice([1, 1, 2, 3, 5, 9])
        rows += [(c, t if r.random() < 0.95 else None, r.choice(["user", "assistant", None]), r.choice(texts)) for t in range(k)]
    copy = [(t, role, text) for c, t, role, text in rows if c == 20]
    rows += [(c, *turn) for c in range(300, 420) for turn in copy]  # one conversation many times over
    rows += [rows[3], rows[3], (None, 1, "user", "nobody"), (7, None, None, None)]
    r.shuffle(rows)
    return rows


def trie_of(frame):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = prefix_trie.prefix_trie(frame).collect()
    assert len(got) == len({(g.conv_id, g.depth) for g in got})
    return {tuple(g[c] for c in cols) for g in got}


def test_trie_equals_plain_python(spark):
    rows = conversations()
    assert trie_of(spark.createDataFrame(rows, CONV).repartition(5)) == plain_trie(rows)


def test_trie_of_crowded_parents_and_small_ranges(spark, monkeypatch):
    """Parents whose children come by broadcast, and digests over several ranges of ids, give the same nodes."""
    monkeypatch.setattr(prefix_trie, "CROWDED", 2)
    monkeypatch.setattr(prefix_trie, "LISTS", 1)
    monkeypatch.setattr(prefix_trie, "ROWS_OUT", 3)
    rows = conversations(seed=8)
    assert trie_of(spark.createDataFrame(rows, CONV)) == plain_trie(rows)


def test_trie_of_long_conversations(spark):
    rows = [(c, t, "user", f"{t % 50} w" if t < 700 else f"{c} {t}") for c in (0, 1, 2) for t in range(900)]
    got = trie_of(spark.createDataFrame(rows, CONV))
    assert max(g[1] for g in got) == 900 and {g[0] for g in got} == {0, 1, 2}
    root = next(g for g in got if g[1] == 0)
    assert root[3] == 3 and root[5] == 3


def test_trie_of_odd_tables(spark):
    assert trie_of(spark.createDataFrame([], CONV)) == set()
    assert trie_of(spark.createDataFrame([(None, 1, "a", "b")], CONV)) == set()
    from pyspark.sql import functions as F

    clash = spark.createDataFrame([(21, 0, "u", "a b")], CONV)
    for c in ("base", "key", "parent", "depth", "first", "members", "words", "ends"):
        clash = clash.withColumn(c, F.lit("clash"))
    assert trie_of(clash) == plain_trie([(21, 0, "u", "a b")])


# ---- divergence


def plain_divergence(rows, min_docs=30, top=50):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(fold))) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= min_docs}
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in mine}}
        share = lambda c, v: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * v) for t in kept}
        p = {s: share(c, len(kept)) for s, c in counts.items()}
        q = share(sum(counts.values(), Counter()), len(kept))
        for s in counts:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s))
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            terms = sorted(((q[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]))[:top]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(terms)]
    return sorted(out, key=str)


def divergence_of(docs, **kw):
    return sorted((tuple(r) for r in divergence.source_divergence(docs, **kw).collect()), key=str)


@pytest.mark.parametrize("min_docs", [1, 3, 30])
def test_divergence_equals_plain_python(docs, rows, min_docs):
    assert divergence_of(docs, min_docs=min_docs, top=7) == plain_divergence(rows, min_docs, 7)


def test_divergence_in_small_tallies(docs, rows, monkeypatch):
    monkeypatch.setattr(divergence, "TALLY_ROWS", 40)
    monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", 3)
    monkeypatch.setattr(divergence, "BLOCK_CHARS", 500)
    monkeypatch.setattr(divergence, "HELD", 30)
    assert divergence_of(docs, min_docs=2) == plain_divergence(rows, 2)


def test_divergence_of_odd_tables(spark, odd_docs, no_docs):
    assert divergence_of(no_docs) == []
    base = [(1, "one two three", "en", "a", 13), (1, "one two three", "en", "a", 13), (None, "four five six seven", None, None, None), (None, None, None, None, None)]
    assert divergence_of(odd_docs, min_docs=1) == plain_divergence(base, 1)
    # A group without terms, a tie that is decided by bytes, a language that keeps nothing, counts that differ by one.
    some = [(i, t, lang, s, 0) for i, (t, lang, s) in enumerate([("Zé zé zz ZZ é", "x", "s1"), (None, "x", "s2"), ("zz é É", "x", "s3"), ("12 .,", "y", "t1"), ("34", "y", "t2"), ("zz " * 5000, "x", "\U0001f600"), ("é", "x", "￿")])]
    for n in (1, 2):
        assert divergence_of(spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long"), min_docs=n) == plain_divergence(some, n)


def test_shares_are_exact_beyond_long(spark):
    from pyspark.sql import functions as F

    big = spark.createDataFrame([(7 * 10**17, 9 * 10**17, 10**9)], "n long, total long, v long")
    assert big.select(divergence._share("n", "total", "v").alias("p")).first().p == 1 + 10**9 * (7 * 10**17 + 5) // (9 * 10**17 + 5 * 10**9)


# ---- packing by swaps


def filled(lengths, bins):
    return np.bincount(bins, lengths).astype(np.int64)


def test_best_fit_prefers_the_fullest_bin():
    lengths = np.array([6, 5, 4, 3, 2], np.int64)
    fill = filled(lengths, best_fit.best_fit(lengths, 10))
    assert sorted(fill.tolist()) == [10, 10]
    assert len(best_fit.best_fit(np.array([], np.int64), 10)) == 0


def test_swaps_empty_bins_and_raise_squared_fill():
    r = np.random.default_rng(3)
    for k in range(12):
        size = int(r.integers(20, 300))
        lengths = r.integers(1, size + 1, int(r.integers(1, 250))).astype(np.int64)
        start = np.cumsum(np.ones(len(lengths), np.int64)) - 1  # each in a bin of its own
        if k % 2:
            start = best_fit.best_fit(lengths, size)
        end = best_fit.swap_search(lengths, start, size)
        a, b = filled(lengths, start), filled(lengths, end)
        assert b.max() <= size and b.sum() == a.sum() and (b**2).sum() >= (a**2).sum()
        assert (b > 0).sum() <= (a > 0).sum() and (b > 0).sum() >= -(-lengths.sum() // size)


def test_swaps_find_exchanges():
    # 6 3 | 5 | 4 2 becomes 6 4 | 5 3 2, and 5 3 | 2 2 | 8 becomes 8 2 | 5 3 2.
    lengths, bins = np.array([6, 3, 5, 4, 2], np.int64), np.array([0, 0, 1, 2, 2])
    assert (filled(lengths, best_fit.swap_search(lengths, bins, 10)) > 0).sum() == 2
    lengths, bins = np.array([5, 3, 2, 2, 8], np.int64), np.array([0, 0, 1, 1, 2])
    assert (filled(lengths, best_fit.swap_search(lengths, bins, 10)) > 0).sum() == 2


def check_packed(pieces, texts, size, end):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, end]
        for k in range(0, len(ids), size):
            want[(i, k // size, k, np.array(ids[k : k + size], "<u4").tobytes(), len(ids))] += 1
    assert Counter((p.doc_id, p.piece, p.start, bytes(p.ids), p.doc_tokens) for p in pieces) == want
    by = {}
    for p in pieces:
        assert p.length * 4 == len(p.ids)
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= size
    return len(by)


@pytest.mark.parametrize("block,group,carried", [(6 << 20, 1024, 32), (4000, 3, 2), (1, 4, 1)])
def test_packing_is_whole_and_tight(docs, rows, monkeypatch, block, group, carried):
    for name, v in (("BLOCK_BYTES", block), ("GROUP_BINS", group), ("CARRIED", carried), ("FAN_IN", 3)):
        monkeypatch.setattr(best_fit, name, v)
    pieces = best_fit.pack_best_fit(docs, window=256).collect()
    used = check_packed(pieces, [(i, t) for i, t, *_ in rows], 256, 1)
    assert used <= 1.12 * -(-sum(p.length for p in pieces) // 256)


def test_packing_of_odd_tables(odd_docs, no_docs):
    assert best_fit.pack_best_fit(no_docs).collect() == []
    got = best_fit.pack_best_fit(odd_docs).collect()
    base = [(1, "one two three"), (1, "one two three"), (None, "four five six seven"), (None, None)]
    assert check_packed(got, base, 4096, 1) == 1 and len({(p.block, p.row) for p in got}) == 4
