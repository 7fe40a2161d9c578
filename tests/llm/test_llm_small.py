"""Operators against plain Python on small inputs, with nulls, empties, ties, repeats and clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from earshot.llm import eliasfano, jpeg, language, media, mixing, ngram_lm, packing, quality, sharding, simhash, substrings, topk, trie
from earshot.llm.components import connected_components


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_matches_plain_python(spark):
    keys = [0, 1, 2, 7, -1, -(1 << 63), (1 << 63) - 1, *range(1000, 1400)]
    frame = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    for n in (1, 2, 24, 1000):
        for r in sharding.shard(frame, n).collect():
            assert (r.shard, r.grown_shard) == (jump(r.doc_id % (1 << 64), n), jump(r.doc_id % (1 << 64), n + 1))


def test_slots_are_gapless(docs, odd_docs, no_docs):
    for d in (docs, odd_docs.select("doc_id", "text"), no_docs):
        got = sharding.with_slots(sharding.shard(d, 5), order=["doc_id", "text"]).collect()
        by = {}
        for r in got:
            by.setdefault(r.shard, []).append(r.slot)
        assert len(got) == d.count() and all(sorted(v) == list(range(len(v))) for v in by.values())


def removed(rows, length=13):
    words = {i: (t or "").encode().split() for i, t, *_ in rows}
    first = {}
    for i in sorted(words):
        for a in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][a : a + length]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for a in range(len(w) - length + 1):
            if first[tuple(w[a : a + length])] < i:
                gone[a : a + length] = [True] * length
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize("length", [13, 5, 3])
def test_substrings_match_brute_force(docs, rows, length):
    want = removed(rows, length)
    got = {r.doc_id: r for r in substrings.remove_repeats(docs, length=length, carry=["lang"]).collect()}
    assert {i: (r.n_words, r.n_removed, r.kept) for i, r in got.items()} == want
    langs = {r[0]: r[2] for r in rows}
    for i, r in got.items():
        assert sum(s["words"] for s in r.spans) == r.n_removed and all(s["words"] >= length for s in r.spans)
        assert r.rest["lang"] == langs[i]


def test_substrings_of_odd_rows(odd_docs, no_docs):
    got = substrings.remove_repeats(odd_docs, length=3).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in got) == [(-1, 0, 0), (-1, 4, 0), (1, 3, 0), (1, 3, 0)]
    assert substrings.remove_repeats(no_docs).collect() == []


def test_elias_fano_round_trip_and_successor():
    r = np.random.default_rng(2)
    for n, universe in ((0, 10), (1, 1), (5, 1 << 60), (1000, 1 << 20), (1000, 50), (300, 1 << 63)):
        v = np.sort(r.integers(0, universe, n, dtype=np.uint64))
        e = eliasfano.EliasFano.of(eliasfano.encode(v, universe))
        assert (e.decode() == v).all() and (e[np.arange(n)] == v).all()
        q = np.concatenate([r.integers(0, universe, 200, dtype=np.uint64), v])
        assert (e.successor(q) == np.searchsorted(v, q)).all()


def test_trie_in_a_memory_map(tmp_path):
    r = np.random.default_rng(3)
    pairs = np.unique(r.integers(0, 300, (2000, 2)), axis=0).astype(np.uint64)
    p = r.uniform(1e-9, 1, len(pairs))
    path = tmp_path / "shard"
    path.write_bytes(trie.Trie.build(pairs[:, 0], pairs[:, 1], p, 300))
    t = trie.Trie.open(str(path))
    every = np.stack(np.meshgrid(np.arange(320), np.arange(300)), -1).reshape(-1, 2).astype(np.uint64)
    got = trie.dequantise(t.lookup(every[:, 0], every[:, 1]))
    want = {tuple(x): y for x, y in zip(pairs.tolist(), p)}
    for (a, b), g in zip(every.tolist(), got):
        assert g == pytest.approx(want.get((a, b), 0.0), rel=3e-4)


def lm(rows, strength):
    taught = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t, *_ in rows]
    one, two = Counter(), Counter()
    for i, t in tokens:
        if taught(i):
            one.update(t)
            two.update(zip([None, *t], t))
    n, v = sum(one.values()), len(one)
    for i, t in tokens:
        p = [(one[w] + 1) / (n + v + 1) for w in t]
        s = [(two[h, w] + strength * q) / (one[h] + strength) if one[h] else q for h, w, q in zip([None, *t], t, p)]
        yield i, not taught(i), len(t), sum(one[w] > 0 for w in t), n, sum(map(math.log10, p)), sum(map(math.log10, s))


def test_lm_matches_plain_python(docs, rows, odd_docs, no_docs):
    got = {r.doc_id: r for r in ngram_lm.lm_scores(docs, strength=7.0, shard_bytes=1000).collect()}
    assert len(got) == len(rows)
    for i, held, n_tokens, n_known, n, base, score in lm(rows, 7.0):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n_tokens, n_known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and abs(r.score - score) < 2e-4 * n_tokens
    assert len(ngram_lm.lm_scores(odd_docs).collect()) == 4
    assert ngram_lm.lm_scores(no_docs).collect() == []


def test_lm_spreads_hot_contexts(docs, rows, monkeypatch):
    want = {i: s for i, *_, s in lm(rows, 50.0)}
    monkeypatch.setattr(ngram_lm, "OCCURRENCES_PER_SHARD", 5)
    for r in ngram_lm.lm_scores(docs, strength=50.0, shard_bytes=500).collect():
        assert abs(r.score - want[r.doc_id]) < 2e-4 * r.n_tokens


def test_quality_learns_and_takes_anything(spark, docs, odd_docs, no_docs, sf_dir):
    d, y = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(d, y).join(y, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9
    for f in (docs, odd_docs, no_docs):
        assert len(quality.quality_scores(f, y).collect()) == f.count()
    none = y.where("false")
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    assert quality.keep_good(odd_docs, none, threshold=0.3).count() == 4
    assert quality.keep_good(odd_docs, none, threshold=0.6).columns == odd_docs.columns


def plain_statistics(text):
    raw = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w]
    odds = lambda a, n: math.log((min(a, n) + 0.5) / (n - min(a, n) + 0.5))
    share = [n / len(raw) for n in Counter(raw).values()]
    symbols = sum(33 <= c < 127 and not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123) and c not in b".,|" for c in raw)
    n = len(words)
    return [
        math.log1p(n), math.log1p(sum(map(len, words)) / max(n, 1)), math.log((len(set(words)) + 1) / (n + 1)),
        odds(sum(65 <= c < 91 for c in raw), sum(c >= 65 for c in raw)), odds(sum(48 <= c < 58 for c in raw), len(raw)), odds(symbols, len(raw)),
        odds(raw.count(b"|"), n), odds(raw.count(b"."), n), odds(raw.count(b","), n), odds(sum(a == b for a, b in zip(words, words[1:])), n),
        odds(max([words.count(w) for w in set(words)], default=0), n), -sum(p * math.log2(p) for p in share), odds(raw.count(b"\n"), n), odds(sum(65 <= w[0] < 91 for w in words), n),
    ]


def test_quality_equals_a_plain_discriminant(spark, docs, rows):
    """Statistics, sums over partitions and scores against plain loops and scipy-free matrix inverses."""
    for text in ("", None, "A  b\tc\nA A | x,y. 12% É", *(t for _, t, *_ in rows[:40])):
        assert quality.statistics(text) == pytest.approx(plain_statistics(text), abs=1e-9)
    labels = [(i, 1 if len(t or "") % 3 else 0, 0) for i, t, *_ in rows if i % 7]
    frame = spark.createDataFrame([*labels, (1, None, 0), (2, 5, 0)], "doc_id long, quality int, toxic int")
    x, y = (np.array(v) for v in zip(*((plain_statistics(rows[i][1]), c) for i, c, _ in labels if zlib.crc32(str(i).encode()) % 5)))
    covs = {c: np.cov(x[y == c].T, bias=True) for c in (0, 1)}
    pooled = sum((y == c).mean() * covs[c] for c in (0, 1))
    logs = []
    for c in (0, 1):
        s = 0.95 * covs[c] + 0.05 * pooled
        s = 0.95 * s + 0.05 * np.diag(np.diag(s)) + 1e-3 * np.eye(len(s))
        d = np.array([plain_statistics(t) for _, t, *_ in rows]) - x[y == c].mean(0)
        logs.append(math.log((y == c).mean()) - np.linalg.slogdet(s)[1] / 2 - (d @ np.linalg.inv(s) * d).sum(1) / 2)
    got = {r.doc_id: r for r in quality.quality_scores(docs, frame).collect()}
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    for (i, *_), w in zip(rows, want):
        assert got[i].score == pytest.approx(w, abs=1e-6) and got[i].predicted == int(got[i].score >= 0.3)


def test_quality_model_equals_direct_density():
    r = np.random.default_rng(5)
    x = r.normal(size=(200, 4)) @ np.diag([1, 2, 3, 0.5])
    c = (x[:, 0] > 0).astype(int)
    sums = {k: (int((c == k).sum()), x[c == k].sum(0), x[c == k].T @ x[c == k]) for k in (0, 1)}
    model = quality.fit(sums, 0.0, 0.0, 0.0)
    logs = []
    for k in (0, 1):
        m, s = x[c == k].mean(0), np.cov(x[c == k].T, bias=True)
        z = ((x - m) @ np.linalg.inv(s) * (x - m)).sum(1)
        logs.append(np.log((c == k).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * z)
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_packing_round_trip(docs, rows, odd_docs, no_docs, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for window, largest in ((64, 255), (4096, 1)):
        monkeypatch.setattr(packing, "LARGEST", largest)
        got = packing.pack(docs, window=window).collect()
        ids, windows = {}, {}
        for r in sorted(got, key=lambda r: r.start):
            own = ids.setdefault(r.doc_id, [])
            assert r.start == len(own) and r.length * 4 == len(r.ids)
            own += np.frombuffer(r.ids, "<u4").tolist()
            windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for i, text, *_ in rows:
            assert ids[i] == t.encode(text or "", add_special_tokens=False).ids + [2]
        for w, pieces in windows.items():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at == window or w == max(windows)
    assert sum(r.length for r in packing.pack(odd_docs).collect()) == 3 + 1 + 3 + 1 + 4 + 1 + 1
    assert packing.pack(no_docs).collect() == []


def test_every_source_of_many_keeps_its_share(spark, monkeypatch):
    monkeypatch.setattr(packing, "LARGEST", 4)
    monkeypatch.setattr(packing, "BRANCHES", 5)
    rows = [(i, "word " * (3 if i % 1200 else 30), f"site {i % 1200}") for i in range(12_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = packing.pack(frame, window=64, weights={"site 7": 0.01, "nowhere": 5.0}).select("doc_id", "source", "start", "length", "sequence_id", "offset", "block", "row").collect()
    total = sum(r.length for r in got)
    taken = sorted((r.sequence_id * 64 + r.offset, r.length) for r in got)
    assert [at for at, _ in taken] == np.cumsum([0] + [n for _, n in taken])[:-1].tolist() and len({(r.block, r.row) for r in got}) == 12_000
    own = {}
    for r in got:
        own.setdefault(r.source, []).append((r.sequence_id * 64 + r.offset, r.length))
    spread = 0
    for source, pieces in own.items():
        if source != "site 7":
            size, half = sum(n for _, n in pieces), sum(n for at, n in pieces if at < total / 2)
            spread = max(spread, abs(half - size / 2))
    assert len(own) == 1200 and spread <= 16  # of 40 tokens; a third or half of its node's tokens are one window of the node
    # a hundredth of all tokens until it is dry
    assert max(at for at, _ in own["site 7"]) < 6000 < total / 8


def test_weights_that_pack_nothing_raise(docs):
    for w in (0.0, -1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="positive"):
            packing.pack(docs, weights={"a": w})


def test_packing_words_are_exact():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, w, r = Tokenizer.from_file(path), packing.WordTokenizer(path), random.Random(4)
    parts = [*"abcXYZ'sé´ñßΣσÄ́  \x1c\x85.,!$<|>0123 \t\n\r\x0b日本 İ", "<|endoftext|>", "<|ENDOFTEXT|>", "'re", "é", "a,", "b.|"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(3000)]
    ids, counts = w.texts(texts, 2)
    at = 0
    for x, n in zip(texts, counts.tolist()):
        assert ids[at : at + n].tolist() == t.encode(x, add_special_tokens=False).ids + [2]
        at += n


def test_windows_follow_weights_and_carry_deficits():
    totals, weights = np.array([700_000, 200_000, 90_000, 10_000]), np.array([0.7, 0.2, 0.09, 0.01])
    edges = packing.served(totals, weights, np.arange(0, 1_000_001, 1000))
    assert (edges.sum(1) == np.arange(0, 1_000_001, 1000)).all() and (np.diff(edges, axis=0) >= 0).all()
    assert np.abs(edges - np.arange(0, 1_000_001, 1000)[:, None] * weights).max() <= 2
    even = packing.served(np.array([100, 900]), np.array([0.5, 0.5]), np.array([0, 100, 200, 600, 1000]))
    assert even.tolist() == [[0, 0], [50, 50], [100, 100], [100, 500], [100, 900]]


def test_mixing_counts_invert_the_poisson(docs, rows, odd_docs, no_docs):
    got = mixing.replicate(docs, weights={"hot": 0.2, "a": 0.5, "b": 0.3}, epochs=3.0).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, _, _, source, _ in rows:
        copies = by.get(i, [])
        u = int(hashlib.md5(f"mix-1:{i}:0".encode()).hexdigest()[:13], 16) / (1 << 52)
        rate = copies[0].rate if copies else None
        if source is None:
            assert not copies
        if rate is not None:
            k, p = 0, math.exp(-rate)
            c = p
            while c <= u:
                k += 1
                p *= rate / k
                c += p
            assert [r.copy for r in sorted(copies, key=lambda r: r.copy)] == list(range(k))
            assert all(r.copies == k for r in copies)
    assert mixing.replicate(no_docs).collect() == []
    assert set(mixing.replicate(odd_docs).columns) >= set(odd_docs.columns) - {"place", "copies"}


def test_mixing_reaches_its_rate(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("source"))
    n = {r.source: r["count"] for r in mixing.replicate(d, weights={"rare": 0.5, "hot": 0.5}, epochs=200.0).groupBy("source").count().collect()}
    assert n["rare"] == pytest.approx(400_000, rel=0.02) and n["hot"] == pytest.approx(400_000, rel=0.02)


def test_topk_matches_brute_force(spark):
    r = np.random.default_rng(6)
    m = r.normal(size=(300, 40)).astype(np.float32).astype(float)
    m[100:150] = m[:50]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(1000, None), (1001, [1.0, None]), (1002, [float("nan")]), (1003, [float("inf")]), (None, [1.0]), (1010, []), (1005, [2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = {i: np.zeros(40, int) for i, v in rows if i is not None and i not in (1000, 1001, 1002, 1003)}
    for i in q:
        v = dict(rows)[i]
        q[i][: len(v)] = np.floor(64 * np.array(v, dtype=float)) if v else 0
    want = []
    for i in q:
        if i % 5 == 0:
            best = sorted(((-int(q[i] @ q[j]), j) for j in q if j != i))[:7]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    got = topk.top_k(frame, k=7, query_every=5, rows_per_block=64, queries_per_block=16).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(frame.where("false"), k=3, query_every=1).collect() == []
    few = topk.top_k(frame.where("vec_id < 3"), k=20, query_every=1).collect()
    assert len(few) == 6


def test_language(spark, docs, odd_docs, no_docs, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language.language_scores(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.9
    found = {r.doc_id: r for r in language.language_scores(docs).collect()}
    assert all(0 <= r.score <= 1 for r in found.values())
    assert {r.lang_pred for r in language.language_scores(docs.where("text is null or trim(text) = ''")).collect()} == {"und"}
    assert language.language_scores(odd_docs).count() == 4 and language.language_scores(no_docs).count() == 0


def plain_buckets(text, orders, buckets):
    s = " " + " ".join(text.lower().split()) + " "
    for n in orders:
        for i in range(len(s) - n + 1):
            h = n * 0x9E3779B97F4A7C15 % 2**64
            for c in s[i : i + n]:
                h = (h ^ ord(c)) * 0xFF51AFD7ED558CCD % 2**64
                h ^= h >> 32
            yield h % buckets


def test_language_equals_plain_bayes(spark, sf_dir):
    """Predictions and scores of a plain multinomial naive Bayes, text by text."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 4 = 0")
    rows = [(r.doc_id, r.text, r.lang) for r in d.collect()] + [(900001, "", "en"), (900002, None, "en"), (900003, "123 ...", None), (900004, "ab", None)]
    orders, buckets, alpha = (1, 2, 3), 512, 0.1
    counts, texts = {}, Counter()
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 5 and text is not None and lang is not None:
            texts[lang] += 1
            own = counts.setdefault(lang, [0] * buckets)
            for b in plain_buckets(text, orders, buckets):
                own[b] += 1
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.language_scores(frame, buckets=buckets, orders=orders, alpha=alpha).collect()}
    logs = {k: [math.log((c + alpha) / (sum(v) + alpha * buckets)) for c in v] for k, v in counts.items()}
    for i, text, _ in rows:
        if text is None or not any(c.isalpha() for c in text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        grams = Counter(plain_buckets(text, orders, buckets))
        total = {k: math.log(texts[k] / sum(texts.values())) + sum(n * logs[k][b] for b, n in grams.items()) for k in sorted(counts)}
        best = max(total, key=total.get)
        assert got[i].lang_pred == best and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].score == pytest.approx(1 / sum(math.exp(max(-700, v - total[best])) for v in total.values()), abs=1e-4)


def test_too_many_languages_raise(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_MODEL_BYTES", 4 * 512 * 3)
    frame = spark.createDataFrame([(i, "some text", f"l{i % 7}") for i in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        language.language_scores(frame, buckets=512)


def plain_pictures(payload):
    """RGB pixels, row by row, of a payload's 4:2:0 picture: sums of cosines, replicated chroma, the colour equations in floats."""
    blocks = [[b if b >= 128 else b - 255 for b in payload[a : a + 64]] for a in range(0, len(payload), 64)]
    wide, high = jpeg.shape_of(len(blocks))
    blocks += [[0] * 64] * (6 * wide * high - len(blocks))
    zigzag = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    wave = [[(math.sqrt(0.125) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16) for u in range(8)] for x in range(8)]

    def sample(own, columns, y, x):
        b = blocks[own + y // 8 * columns + x // 8]
        v = sum(c * wave[y % 8][fy] * wave[x % 8][fx] for c, (fy, fx) in zip(b, zigzag) if c)
        return min(255, max(0, math.floor(v + 128.5 + 1e-6)))

    cb, cr = 4 * wide * high, 5 * wide * high
    out = []
    for y in range(16 * high):
        for x in range(16 * wide):
            l, u, v = sample(0, 2 * wide, y, x), sample(cb, wide, y // 2, x // 2) - 128, sample(cr, wide, y // 2, x // 2) - 128
            out.append([min(255, max(0, round(z))) for z in (l + 1.402 * v, l - 0.344136 * u - 0.714136 * v, l + 1.772 * u)])
    return 16 * wide, 16 * high, out


def test_jpeg_pictures_and_features_equal_a_plain_decoder():
    r = np.random.default_rng(3)
    payloads = [r.integers(118, 138, 64 * n, dtype=np.uint8).tobytes() for n in (1, 9, 14)] + [bytes(64)]
    for p, (back, tensor) in zip(payloads, zip(*jpeg.read_payloads(jpeg.write_payloads(payloads)))):
        wide, high, pixels = plain_pictures(p)
        assert back == p and tensor.shape == (high, wide, 3) and np.abs(tensor.reshape(-1, 3).astype(int) - pixels).max() <= 1
        flat = tensor.reshape(-1, 3).tolist()
        bright = [(299 * a + 587 * b + 114 * c) // 1000 for a, b, c in flat]
        bins = Counter(v >> 5 for v in bright)
        cell = lambda i, j: [bright[y * wide + x] for y in range(i * high // 8, (i + 1) * high // 8) for x in range(j * wide // 9, (j + 1) * wide // 9)]
        grid = [[sum(c) // len(c) for c in (cell(i, j) for j in range(9))] for i in range(8)]
        bits = "".join("1" if b > a else "0" for row in grid for a, b in zip(row, row[1:]))
        means = ",".join(str(sum(x) // len(flat)) for x in zip(*flat))
        assert media.picture_features(tensor) == f"{wide}x{high} mean {means} bins {','.join(str(bins[i]) for i in range(8))} dhash {int(bits, 2):016x}"


def test_texts_too_long_for_a_picture_raise(docs, monkeypatch):
    batch = pa.record_batch([pa.array([1]), pa.array([b"x" * 500], pa.binary())], ["doc_id", "raw"])
    monkeypatch.setattr(media, "MAX_SIDE", 16)
    with pytest.raises(ValueError, match="too long"):
        list(media._write(iter([batch])))


def test_jpeg_round_trip_and_features(docs, rows, odd_docs, no_docs):
    got = {r.doc_id: r for r in media.from_media(media.to_media(docs)).collect()}
    for i, text, *_ in rows:
        raw = (text or "").encode()
        want = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert bytes(r.payload) == want and r.n_bytes == len(raw) and len(r.rgb) == r.width * r.height * 3
    assert media.to_media(odd_docs).count() == 4 and media.from_media(media.to_media(no_docs)).count() == 0


def test_jpeg_same_bytes_in_any_batch():
    r = np.random.default_rng(8)
    p = [r.integers(0, 256, 64 * n, dtype=np.uint8).tobytes() for n in (1, 3, 40, 700)]
    together = jpeg.write_payloads(p)
    assert [jpeg.write_payloads([x])[0] for x in p] == together
    alone = [jpeg.read_payloads([f])[1][0].tobytes() for f in together]
    assert [t.tobytes() for t in jpeg.read_payloads(together)[1]] == alone


class Bits:
    def __init__(self):
        self.s = ""

    def add(self, value, n):
        self.s += format(value, f"0{n}b") if n else ""

    def close(self):
        self.s += "1" * (-len(self.s) % 8)
        return bytes(int(self.s[i : i + 8], 2) for i in range(0, len(self.s), 8)).replace(b"\xff", b"\xff\x00")


def test_jpeg_reads_any_progressive_stream():
    """A grey picture coded by a plain coder: long zero runs, runs of ended blocks, refinement with new values, no restarts."""
    r = np.random.default_rng(9)
    n, start, end = 6, 1, 63
    blocks = np.zeros((n, 64), int)
    for b in (0, 1, 4):
        for k in r.choice(np.arange(1, 64), 9, replace=False):
            blocks[b, k] = r.choice([-5, -3, -2, -1, 1, 2, 3, 6])
    blocks[:, 0] = r.integers(-40, 40, n)
    symbols = sorted({x << 4 | y for x in range(16) for y in range(11)})
    spec = (bytes([0] * 7 + [len(symbols)] + [0] * 8), bytes(symbols))
    codes, sizes = jpeg.huffman_codes(*spec)

    def emit(out, symbol):
        out.add(int(codes[symbol]), int(sizes[symbol]))

    dc, last = Bits(), 0
    for v in blocks[:, 0]:
        d, last = int(v) - last, int(v)
        s = abs(d).bit_length()
        emit(dc, s)
        dc.add(d if d >= 0 else d + (1 << s) - 1, s)
    first, ended = Bits(), 0

    def end_run(out, count, tail=""):
        if count:
            e = count.bit_length() - 1
            emit(out, e << 4)
            out.add(count - (1 << e), e)
        out.s += tail

    for b in blocks:
        v = np.sign(b) * (abs(b) >> 1)
        nz = [k for k in range(start, end + 1) if v[k]]
        at = start
        for k in nz:
            end_run(first, ended)
            ended = 0
            while k - at > 15:
                emit(first, 0xF0)
                at += 16
            s = int(abs(v[k])).bit_length()
            emit(first, (k - at) << 4 | s)
            first.add(int(v[k]) if v[k] > 0 else int(v[k]) + (1 << s) - 1, s)
            at = k + 1
        if at <= end:
            ended += 1
    end_run(first, ended)
    fine, ended, tail = Bits(), 0, ""
    for b in blocks:
        v, run, held = abs(b), 0, ""
        top = max([k for k in range(start, end + 1) if v[k] == 1], default=0)
        for k in range(start, end + 1):
            if v[k] == 0:
                run += 1
                continue
            while run > 15 and k <= top:
                end_run(fine, ended, tail)
                ended, tail = 0, ""
                emit(fine, 0xF0)
                fine.s += held
                held, run = "", run - 16
            if v[k] > 1:
                held += str(v[k] & 1)
                continue
            end_run(fine, ended, tail)
            ended, tail = 0, ""
            emit(fine, run << 4 | 1)
            fine.add(int(b[k] > 0), 1)
            fine.s += held
            held, run = "", 0
        if run or held:
            ended, tail = ended + 1, tail + held
    end_run(fine, ended, tail)
    seg = jpeg._segment
    data = bytes([0xFF, 0xD8]) + seg(0xDB, bytes([0, *[1] * 64])) + seg(0xC2, bytes([8, 0, 9, 0, 20, 1, 1, 0x11, 0]))
    data += seg(0xC4, bytes([0]) + spec[0] + spec[1]) + seg(0xC4, bytes([16]) + spec[0] + spec[1])
    for band, bit, out in (((0, 0), 0, dc), ((1, 63), 1, first), ((1, 63), 0x10, fine)):
        data += seg(0xDA, bytes([1, 1, 0, *band, bit])) + out.close()
    images, coded = jpeg.coefficients([data + bytes([0xFF, 0xD9])])
    assert (coded == blocks).all()
    assert jpeg.rgb_tensors(images, coded)[0].shape == (9, 20, 3)
    with pytest.raises(jpeg.Corrupt):
        jpeg.coefficients([data[:-6]])


def plain_fingerprint(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_classes(fps, most):
    ids = list(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if (fps[i] ^ fps[j]).bit_count() <= most and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def test_simhash_matches_brute_force(docs, rows, odd_docs, no_docs):
    fps = {i: plain_fingerprint(t, 4) for i, t, *_ in rows}
    want = plain_classes(fps, 4)
    got = {r.doc_id: r for r in simhash.near_duplicate_classes(docs, shingle=4).collect()}
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == fps and {i: r.component_id for i, r in got.items()} == want
    assert simhash.near_duplicate_classes(odd_docs).count() == 4 and simhash.near_duplicate_classes(no_docs).count() == 0


def test_first_of_similar_texts_stays(spark, odd_docs, no_docs):
    """Chains of edited copies and strangers; what is told apart lies well on either side of the threshold."""
    import random

    r = random.Random(11)
    words = ["".join(r.choices("abcdefghij", k=5)) for _ in range(3000)]
    texts, group = [], []
    for g in range(30):
        base = r.choices(words, k=r.randint(150, 400))
        for c in range(6):
            own = list(base)
            for _ in range(len(own) // 200 * (c > 0)):  # about one word in two hundred: similarity 0.95
                own[r.randrange(len(own))] = "edited" + str(r.random())
            texts.append(" ".join(own))
            group.append(g)
        texts.append(" ".join(w if r.random() > 0.15 else "other" for w in base))  # similarity below 0.4
        group.append(1000 + g)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, odd_docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    kept = simhash.keep_first(frame)
    want = {}
    for i, g in enumerate(group):
        want.setdefault(g, i)
    assert kept.columns == frame.columns and sorted(x.doc_id for x in kept.collect()) == sorted(want.values())
    left = simhash.keep_first(odd_docs)
    assert left.columns == odd_docs.columns and sorted(str(x.text) for x in left.collect()) == ["None", "four five six seven", "one two three"]
    assert simhash.keep_first(no_docs).collect() == []


def test_simhash_links_of_dense_clusters(spark):
    """Chains and balls of fingerprints around a few centres, as many near copies of one text give."""
    r = np.random.default_rng(10)
    fps = set()
    for centre in r.integers(0, 1 << 63, 4, dtype=np.uint64).tolist():
        x = centre
        for _ in range(60):
            for b in r.choice(64, r.integers(1, 6), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
            if r.random() < 0.7:
                x = centre
    fps |= {0, (1 << 64) - 1, 1, 15, 31}
    fps = sorted(fps)
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = plain_classes(dict(enumerate(fps)), 4)
    roots = {x.fp % (1 << 64): x.root for x in simhash.near_links(frame).collect()}
    groups = {}
    for i, f in enumerate(fps):
        groups.setdefault(want[i], set()).add(roots.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(200)] + [(300, 301), (301, 300), (5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and got[301] == 300
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_large_star_of_similar_fingerprints(spark):
    """1500 fingerprints near one and not near each other, the one neither first nor last in any order: one class."""
    r = np.random.default_rng(3)
    centre = r.integers(0, 2, 1024).astype(np.uint8)
    rows = []
    for key in range(1, 1502):
        own = centre.copy()
        if key != 751:
            own[r.choice(1024, 150, replace=False)] ^= 1
        rows.append((key, np.packbits(own, bitorder="little").view("<i8").tolist()))
    sets = [(k, list(range(100)) + ([] if k == 751 else list(range(100 * k, 100 * k + 20)))) for k, _ in rows]  # 100/120 to the one, 100/140 else
    sets = spark.createDataFrame(sets, "key long, shingles array<long>")
    found = simhash.similar_links(spark.createDataFrame(rows, "key long, fp array<long>"), 0.8, lambda keys: sets.join(keys, "key", "left_semi")).collect()
    largest = Counter(x.root for x in found).most_common(1)[0][1] if found else 0
    assert largest >= 0.98 * len(rows), largest


@pytest.mark.parametrize("whole", [4096, 7])
def test_chains_in_large_cells(spark, monkeypatch, whole):
    """400 fingerprints, each 40 bits from the one before, in two chains: two classes, whether cells are compared whole or in parts."""
    monkeypatch.setattr(simhash, "WHOLE_CELL", whole)
    r = np.random.default_rng(4)
    rows, sets = [], []
    for chain in range(2):
        own = r.integers(0, 2, 1024).astype(np.uint8)
        for i in range(200):
            own[r.choice(1024, 40, replace=False)] ^= 1
            rows.append((chain * 1000 + i, np.packbits(own, bitorder="little").view("<i8").tolist()))
            sets.append((chain * 1000 + i, list(range(100_000 * chain + 10 * i, 100_000 * chain + 10 * i + 100))))  # 90/110 to the next
    sets = spark.createDataFrame(sets, "key long, shingles array<long>")
    found = simhash.similar_links(spark.createDataFrame(rows, "key long, fp array<long>"), 0.8, lambda keys: sets.join(keys, "key", "left_semi")).collect()
    assert sorted(Counter(x.root for x in found).items()) == [(0, 200), (1000, 200)]


def test_sets_that_share_a_key_are_told_apart(spark):
    rows = [(1, 7, "a"), (1, 9, "b"), (2, 7, "c"), (3, 1, "d")]
    got = {r.fp: r.key for r in simhash._keyed(spark.createDataFrame(rows, "key long, more long, fp string")).collect()}
    assert (got["a"], got["c"], got["d"]) == (1, 2, 3) and got["b"] not in (1, 2, 3)


def test_of_repeated_rows_the_first_in_order_stays(spark):
    rows = [(5, "a b c", "x", {"k": 1}), (5, "a b c", "w", {"k": 2}), (6, "a b c", "v", {"k": 3})]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _kept_id string, m map<string, int>")
    assert [(r.doc_id, r["_kept_id"], r.m) for r in simhash.keep_first(frame).collect()] == [(5, "w", {"k": 2})]


def edited(base, n, r):
    """``base`` with ``n`` words replaced, so far apart that each takes five shingles."""
    own = list(base)
    for k in r.sample(range(1, len(base) // 5 - 1), n):
        own[5 * k] = "edited%d" % r.randrange(1 << 40)
    return own


def shingle_set(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(x, y):
    x, y = shingle_set(x), shingle_set(y)
    return len(x & y) / len(x | y)


@pytest.fixture(scope="module")
def near_and_far():
    """(texts as words, groups): pairs at 0.75, 0.79, 0.81 and 0.85, and texts that share a line many times over and little else."""
    import random

    r = random.Random(21)
    word = lambda: f"w{r.randrange(20000)}"
    texts = []
    for n in (57, 47, 42, 32):  # of 2000 words
        for _ in range(12):
            base = [word() for _ in range(2000)]
            texts += [base, edited(base, n, r)]
    line = [word() for _ in range(9)]
    texts += [line * 300 + [word() for _ in range(120)] for _ in range(10)]
    seen = [round(jaccard(texts[i], texts[i + 1]), 2) for i in range(0, 96, 24)]
    assert seen == [0.75, 0.79, 0.81, 0.85]
    want = {i: i - i % 2 if 48 <= i < 96 else i for i in range(len(texts))}
    sets = [shingle_set(t) for t in texts]
    assert all((len(a & b) >= 0.8 * len(a | b)) == (want[i] == want[j]) for i, a in enumerate(sets) for j, b in enumerate(sets))
    return texts, want


def test_links_are_decided_on_shingle_sets(spark, near_and_far):
    texts, want = near_and_far
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {x.doc_id for x in simhash.keep_first(frame).select("doc_id").collect()} == set(want.values())


def test_pipeline_links_on_shingle_sets(spark, near_and_far, tmp_path, monkeypatch):
    """run() up to its packed pieces, with the stages that would drop or copy texts made idle."""
    import corpus_pipeline

    texts, want = near_and_far
    rows = [(i, " ".join(t), "en", "s", len(" ".join(t))) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    same = lambda spark, docs, sf_dir: docs
    idle = {"quality classifier", "substring deduplication", "source mixing"}
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, same if n in idle else f) for n, f in corpus_pipeline.STAGES])
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == set(want.values())


def test_grids_grow_with_the_fingerprints():
    for n in (10, 10**5, 10**7, 10**9):
        bits, grids = simhash.grid_shape(n, 0.8)
        assert 1 << bits >= n and (1 - (1 - simhash.differing_share(0.8)) ** bits) ** grids <= simhash.MISSED


@pytest.mark.parametrize("sizes", [[1], [6], [8], [9, 1], [3, 70_000, 2]])
def test_cells_of_any_size(sizes):
    """Arrays of few rows, and a cell longer than an array: a star for each cell, and no row for one that is alone."""
    cell = np.repeat(np.arange(len(sizes)), sizes)
    rows = pa.record_batch([pa.array(cell), pa.array(np.arange(len(cell))), pa.array(np.zeros(len(cell), np.int64))], ["cell", "key", "sketch"])
    found = list(simhash._cell_members(0, 0)(rows.slice(a, 500) for a in range(0, len(cell), 500)))
    assert sum(b.num_rows for b in found) == sum(n for n in sizes if n > 1)
    assert sum(b.num_rows - b.column(1).null_count for b in found) == sum(n - 1 for n in sizes if n > 1)


def test_op6_shuffles_whole_documents(docs, spark, tmp_path):
    """What is stored after the shuffle holds each copy's own text and all other columns, in the order of place."""
    from earshot.llm import queries

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    listed = queries.op6_poisson_mixing(spark, str(tmp_path))
    want = {r.doc_id: r for r in docs.collect()}
    for r in listed.collect():
        text = want[r.doc_id].text
        assert r.text_md5 == (None if text is None else hashlib.md5(text.encode()).hexdigest()) and r.text_bytes == len((text or "").encode())
        assert (r.lang, r.n_chars) == (want[r.doc_id].lang, want[r.doc_id].n_chars)
    plan = listed._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" in plan[: plan.index("RepartitionByExpression")] and "text#" in plan[plan.index("RepartitionByExpression") :]
    rows = mixing.shuffled(mixing.replicate(docs), 7).withColumn("part", F.spark_partition_id()).collect()
    assert [r.place for r in rows] == sorted(r.place for r in rows) and all(r.part == int(r.place * 7) for r in rows)
    assert all(r[c] == want[r.doc_id][c] for r in rows for c in docs.columns)


def test_mixing_of_odd_weights_and_names(docs, no_docs):
    clash = docs.withColumn("rate", F.lit("old")).withColumn("_source", F.lit("mine")).withColumn("COPIES", F.lit(1))
    got = mixing.replicate(clash, temperature=1.0).collect()
    assert len(got) > 0 and all(r["_source"] == "mine" and r["rate"] == pytest.approx(1.0) for r in got)
    assert mixing.replicate(docs, weights={"elsewhere": 1.0}).where("source is not null").count() == 0
    assert mixing.replicate(no_docs, weights={}).count() == 0
    for w in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="not negative"):
            mixing.replicate(docs, weights={"a": w})


def test_shards_and_slots_keep_columns_of_their_names(spark):
    frame = spark.createDataFrame([(i, f"{i}", i, "x", "y") for i in range(50)], "doc_id long, _key string, _jump long, shard string, slot string")
    frame = frame.withColumn("_range", F.lit("r")).withColumn("_first", F.lit("f")).withColumn("_at", F.lit("a"))
    got = sharding.with_slots(sharding.shard(frame, 3), order=["doc_id"])
    assert got.columns == [*frame.columns, "grown_shard"]
    for r in got.collect():
        assert (r["_key"], r["_jump"], r["_range"], r["_first"], r["_at"]) == (str(r.doc_id), r.doc_id, "r", "f", "a") and r.shard in (0, 1, 2) and r.slot < 50


def test_topk_of_repeated_rows(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, [0.5, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2, query_every=20).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(20, 1, 1, 64 * 128), (20, 2, 2, 64 * 64)]


@pytest.mark.parametrize("block", [4, 64])
def test_topk_of_ids_with_several_vectors(spark, block):
    """All vectors of an id take part, as queries and as candidates, and the best score between two ids counts."""
    r = np.random.default_rng(9)
    rows = [(int(i), [float(x) for x in r.integers(-3, 4, 6)]) for i in r.integers(0, 40, 200)] + [(7, [3.0] * 6)] * 3 + [(8, [3.0] * j + [1.0] * (6 - j)) for j in range(7)]
    best = {}
    for i, v in rows:
        for j, w in rows:
            if i % 4 == 0 and i != j:
                best[i, j] = max(best.get((i, j), -(10**9)), int(np.floor(64 * np.array(v)) @ np.floor(64 * np.array(w))))
    want = []
    for i in {i for i, _ in best}:
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(sorted((-s, j) for (a, j), s in best.items() if a == i)[:5])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, query_every=4, rows_per_block=block, queries_per_block=8).collect()
    assert sorted(map(tuple, got)) == sorted(want)
