"""Spelling variants, whitening and packing against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache
from itertools import combinations_with_replacement

import numpy as np
import pytest

from wirelens.llm import packing, spelling, whitening

DATA = "/root/testdata/sf0.001"


# -- spelling variants --------------------------------------------------------------------------------------------------


def variants(docs, least_chars=6, least_count=5, ratio=5, every=199):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_count}
    holes, near = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            holes[w[:k], w[k + 1 :]].add(w)
            if (d := w[:k] + w[k + 1 :]) in words:
                near[w].add(d)
                near[d].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= ratio * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items())


def found_variants(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def word_docs(seed, texts=60, words=80):
    rng = random.Random(seed)
    stems = ["colour", "colours", "étéété", "aaaaaaa", "abababab", "straßenbahn", "x×÷yzab"]
    out = []
    for k in range(texts):
        picked = []
        for _ in range(words):
            w = list(rng.choice(stems[: rng.randrange(1, len(stems) + 1)]))
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = rng.choice("abcé") * rng.randrange(2)
            picked.append("".join(w).upper() if rng.random() < 0.1 else "".join(w))
        out.append((k, rng.choice([" ", "-", "1"]).join(picked)))
    return [*out, (None, out[0][1]), (None, None), (7, ""), (8, "a" * 3000 + " " + "b" * 2999), out[0], out[0], (9, "chainab " * 2 + "chainabc " * 5 + "chainabcd " * 14)]


@pytest.mark.parametrize("most_group, chunk_bytes, every", [(50_000, 1 << 20, 199), (3, 1, 3), (1, 40, 2), (8, 200, 1)])
def test_variants(spark, most_group, chunk_bytes, every):
    """Also where every group is split down to one edit position and every chunk is one group."""
    docs = word_docs(every)
    df = spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, word string, n int").repartition(3)
    want = variants(docs, 5, 2, 2, every)
    assert len(want) > 20 and any(r[5] for r in want) and (every < 9 or any(r[2] != r[1] and r[1] for r in want))
    assert found_variants(spelling.group_variants(df, 5, 2, 2, every, most_group, chunk_bytes)) == want


def test_variants_of_repeated_long_runs(spark):
    long = "ab" * 800
    docs = [(k, f"{long} {long}c {long[:700]}x{long[701:]} {'z' * 1200}") for k in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found_variants(spelling.group_variants(df, every=10**9)) == variants(docs, every=10**9)


def test_variants_pieces(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 7)
    text = "Straße  aa bbbbbbbbbbbbb Éİ cc" * 3
    assert [w for runs in spelling._runs(text) for w in runs] == spelling.RUN.findall(text.encode().lower().decode())


def test_variants_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert found_variants(spelling.op11_spelling_variants(spark, DATA)) == variants(docs)


def test_variants_odd(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found_variants(spelling.group_variants(odd_docs, 1, 1)) == variants(rows, 1, 1)
    assert spelling.group_variants(no_docs).count() == 0


def test_wavelet_tree():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 64, 100):
        values = rng.permutation(n)
        tree = spelling.WaveletTree(values)
        box = rng.integers(0, n + 1, (50, 4))
        q, v = tree.report(*box.T)
        want = sorted((k, x) for k, (a, b, lo, hi) in enumerate(box) for x in values[a:b] if lo <= x < hi)
        assert sorted(zip(q.tolist(), v.tolist())) == want


# -- whitening ----------------------------------------------------------------------------------------------------------


def usable(vectors):
    return [(i, e) for i, e in vectors if e is not None and all(c is not None and math.isfinite(c) for c in e)]


def check_whitened(spark, vectors, components=4, **sizes):
    df = spark.createDataFrame([(*v, "x", 3) for v in vectors], "vec_id long, embedding array<double>, x string, n int").repartition(3)
    got = whitening.whiten(df, components, **sizes).collect()
    kept = usable(vectors)
    d = max(len(e) for _, e in kept)
    x = [[math.floor(256 * c) for c in e] + [0] * (d - len(e)) for _, e in kept]
    fit = np.array(sorted(set(map(tuple, x))), float)
    n, s, k = len(fit), [sum(int(r[j]) for r in fit) for j in range(d)], min(components, d)
    e, u = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(d, d))
    e, u = e[::-1], u[:, ::-1]
    assert sorted((r.vec_id is None, r.vec_id, r.component) for r in got) == sorted((i is None, i, c + 1) for i, _ in kept for c in range(k))
    sums = {tuple(r): sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in map(tuple, x)}
    by_dev = Counter(v if v < 1 << 63 else None for r in map(tuple, x) for v in [sums[r]] * k)
    assert Counter(r.deviation for r in got) == by_dev and {r.n for r in got} == {n}
    for c in range(k):
        rows = sorted((r for r in got if r.component == c + 1), key=lambda r: (r.vec_id is None, r.vec_id))
        if e[c] <= 1e-9:
            assert all(r.whitened is None and r.explained == 0 for r in rows)
            continue
        own = sorted(zip(kept, x), key=lambda p: (p[0][0] is None, p[0][0]))
        want = (np.array([r for _, r in own], float) - np.array(s) / n) @ u[:, c] / math.sqrt(e[c])
        have = np.array([r.whitened for r in rows])
        assert np.allclose(have, want, atol=1e-8) or np.allclose(have, -want, atol=1e-8)
        assert all(abs(r.explained / (e[c] / e.sum()) - 1) < 1e-8 and r.identity_error < 1e-8 for r in rows)
    return got


@pytest.mark.parametrize("block_rows, tile, most", [(4096, 32, 256), (5, 3, 2), (1, 1, 1), (7, 2, 100)])
def test_whitening(spark, monkeypatch, block_rows, tile, most):
    monkeypatch.setattr(whitening, "MOST_TILES", most)
    rng = random.Random(1)
    vectors = [(k, [rng.gauss(0, 1 + j) for j in range(7)]) for k in range(60)]
    vectors += [(100 + k, vectors[0][1]) for k in range(30)]  # one vector in a third of the rows
    odd = [(200, None), (201, [1.0, None] + [0.0] * 5), (202, [math.nan] * 7), (203, [math.inf] * 7), (204, [0.5]), (205, [])]
    check_whitened(spark, vectors + odd, block_rows=block_rows, tile=tile)


def test_whitening_ties_and_few(spark):
    check_whitened(spark, [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0])])  # one distinct vector: no variance
    check_whitened(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (None, [3.0, 0.0])])  # one component of two
    check_whitened(spark, [(k, [1e12 * k, -3e11 * k * k]) for k in range(3)], components=1)  # whole numbers beyond 32 bits
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(empty).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, None)], empty.schema)).count() == 0


def test_whitening_beyond_long(spark):
    rows = whitening.whiten(spark.createDataFrame([(1, [4e13]), (2, [-4e13]), (3, [0.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: r.deviation for r in rows} == {1: None, 2: None, 3: 0}


def test_whitening_whole_table(spark):
    got = whitening.op12_embedding_whitening(spark, DATA).collect()
    vectors = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert len(got) == 4 * len(usable(vectors)) and 0 <= got[0].identity_error < 1e-4


# -- packing ------------------------------------------------------------------------------------------------------------


def least(items, capacity):
    """The fewest bins, by exhaustive search."""
    items = sorted(items, reverse=True)

    def fits(k, room):
        if k == len(items):
            return True
        return any(room[b] >= items[k] and fits(k + 1, room[:b] + (room[b] - items[k],) + room[b + 1 :]) for b in range(len(room)) if room[b] not in room[:b])

    return next(n for n in range(len(items) + 1) if fits(0, (capacity,) * n))


def test_packing_is_optimal_on_small_inputs():
    rng = random.Random(2)
    for _ in range(400):
        capacity = rng.randrange(5, 40)
        items = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 11))]
        found = packing.completed(Counter(items), capacity)
        assert Counter(x for f, times in found for x in f * times) == Counter(items) and all(sum(f) <= capacity for f, _ in found)
        best = least(items, capacity)
        assert sum(times for _, times in found) == best and packing.least_sequences(Counter(items), capacity) <= best


def test_packing_of_many_reaches_the_bound():
    rng = random.Random(3)
    for tail in (0, 5, 48):
        counts = Counter(rng.randrange(1, 257) for _ in range(5000)) + Counter({200: 3000, 256: 7})
        found = packing.completed(counts, 256, tail)
        assert Counter({x: sum(t * f.count(x) for f, t in found) for x in counts}) == counts and all(sum(f) <= 256 for f, _ in found)
        assert tail < 48 or sum(t for _, t in found) == packing.least_sequences(counts, 256)


def test_packing_fillings_are_undominated():
    left = packing.Lengths({10: 1, 7: 1, 5: 2, 4: 1, 3: 2, 2: 1}, 20)
    got = list(left.fillings(20))
    assert got[0] == (10, 7, 3) and all(f[0] == 10 and sum(f) <= 20 for f in got)
    # 5 + 2 and 4 + 3 can give way to the 7
    assert (10, 5, 3, 2) not in got and (10, 4, 3, 3) not in got and (10, 5, 5) in got
    for size in range(1, 5):  # any filling left out is dominated or can take more
        for f in combinations_with_replacement([7, 5, 4, 3, 2], size):
            if sum(f) <= 10 and not Counter(f) - Counter({7: 1, 5: 2, 4: 1, 3: 2, 2: 1}) and (10, *f) not in got:
                rest = Counter({7: 1, 5: 2, 4: 1, 3: 2, 2: 1}) - Counter(f)
                assert left._dominated(f, 10 - sum(f), sum(1 << x for x in left.left), dict(left.left)) or any(x <= 10 - sum(f) for x in rest)


@cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def read_ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [2]


def check_packed(rows, docs, capacity):
    want = Counter()
    for doc_id, text in docs:
        ids = read_ids(text)
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        want.update((doc_id, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values(), default=0) <= capacity
    counts = Counter(r.length for r in rows)
    assert len(ends) <= sum(times for _, times in packing.best_fit(counts, capacity))
    assert len(ends) <= 1.01 * packing.least_sequences(counts, capacity) or len(counts) == 1


def test_packing_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    check_packed(packing.op13_packing(spark, DATA).collect(), docs, 1024)


def test_packing_odd(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check_packed(packing.pack(odd_docs).collect(), docs, 1024)
    check_packed(packing.pack(odd_docs, capacity=7).collect(), docs, 7)
    assert packing.pack(no_docs).count() == 0
    same = spark.createDataFrame([(k, "same text") for k in range(300)], "doc_id long, text string").repartition(5)
    check_packed(packing.pack(same, capacity=16).collect(), [(k, "same text") for k in range(300)], 16)


def test_packing_special_text(spark):
    texts = ["<|endoftext|>", "a<|endoftext|> b", "it's  \n\n x" * 50, " " * 5000, "日本語" * 900]
    docs = list(enumerate(texts))
    check_packed(packing.pack(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs, 1024)


def test_packing_sequences(spark, odd_docs):
    rows = packing.sequences(odd_docs).collect()
    assert all(len(r.ids) <= 1024 for r in rows)
    assert Counter(i for r in rows for i in r.ids) == Counter(i for d in odd_docs.collect() for i in read_ids(d.text))
