"""The whole pipeline on the smallest tables against plain Python, stage by stage."""

import hashlib
import math
from collections import Counter

import pytest

import corpus_pipeline
from earshot.llm import quality


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def first_of_similar(texts):
    """The smallest id of each class of texts linked at 0.8, by comparing all pairs."""
    ids = sorted(texts)
    sets = {i: shingles(texts[i]) for i in ids}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or (x and y and len(x & y) >= 0.8 * len(x | y)):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i for i in ids if find(i) == i}


def without_repeats(texts, length=13):
    words, first = {i: (t or "").encode().split() for i, t in texts.items()}, {}
    for i in sorted(words):
        for a in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][a : a + length]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for a in range(len(w) - length + 1):
            if first[tuple(w[a : a + length])] < i:
                gone[a : a + length] = [True] * length
        out[i] = b" ".join(x for x, g in zip(w, gone) if not g).decode() if any(gone) else texts[i] or ""
    return out


def copies(texts, sources):
    size = Counter()
    for i, t in texts.items():
        size[sources[i]] += len((t or "").encode())
    wanted = {s: n**0.7 for s, n in size.items() if n}
    out = {}
    for i in texts:
        s = sources[i]
        rate = wanted[s] / sum(wanted.values()) * sum(size.values()) / size[s] if size[s] else 1.0
        u = int(hashlib.md5(f"mix-1:{i}:0".encode()).hexdigest()[:13], 16) / (1 << 52)
        k, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        out[i] = k
    return out


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """What each stage returns, written and read again as run() does."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append((name, docs))
    return out


def test_stages_equal_plain_python(spark, sf_dir, stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    scores = quality.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    good = {r.doc_id: texts[r.doc_id] for r in scores if r.score >= 0.3}
    first = {i: good[i] for i in first_of_similar(good)}
    clean = without_repeats(first)
    drawn = copies(clean, source)
    for (name, got), want in zip(stages[:3], (good, first, clean)):
        assert got.columns == docs.columns, name
        assert {r.doc_id: r.text or "" for r in got.collect()} == {i: t or "" for i, t in want.items()}, name
    assert {i: n for i, n in drawn.items() if n} == dict(Counter(r.doc_id for r in stages[3][1].collect())) and stages[3][1].columns == docs.columns
    assert all((r.text or "") == clean[r.doc_id] for r in stages[3][1].collect())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    size = {i: len(tokenizer.encode(clean[i], add_special_tokens=False).ids) + 1 for i in drawn if drawn[i]}
    pieces = {}
    for r in stages[4][1].select("doc_id", "start", "length", "doc_tokens", "block", "row").collect():
        pieces.setdefault((r.block, r.row, r.doc_id), []).append((r.start, r.length, r.doc_tokens))
    assert Counter(i for _, _, i in pieces) == Counter({i: n for i, n in drawn.items() if n})
    for (_, _, i), own in pieces.items():
        own.sort()
        assert [s for s, _, _ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))] and sum(n for _, n, _ in own) == size[i] == own[0][2]


def test_run_is_its_stages(spark, sf_dir, stages):
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.columns == stages[-1][1].columns and whole.count() == stages[-1][1].count()


def test_stages_take_odd_and_no_rows(spark, sf_dir, odd_docs, no_docs):
    plain = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (plain, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, sf_dir)
            assert got.count() >= 0 and (name == "packing" or got.columns == docs.columns), name
