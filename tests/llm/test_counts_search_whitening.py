"""Token counts, ranked search and whitening against the library, SQL, brute force and numpy, and on edge rows."""

import collections
import heapq
import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import queries, ranked_search, token_counts, whitening, wordhash

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 911}x{i}" for i in range(20_000))
ODD = [None, "", " \t\n", "it's don't we'll THEY'VE I'm he'd x're ''s 's 't '''s -'s 's's it'star 1's", "<|endoftext|>hi<|startoftext|><|END",
       "a<|endoftext|>", "aaaaaaaa " * 3 + "-" * 501 + "=" * 77, "İstanbul ẞ ſ ﬁ é é x a  b \u0085c", "日本語、です。 한국어 ১২৩ Ⅷ ½²", "😀👍🏽 ☃️",
       "ΑΣΑΣ ΟΔΟΣ'S", "x\x00y\x1c z\x1fq", LONG, LONG, "'" * 40 + "s"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.default_vocabulary())


def test_counts_match_the_library(spark, library):
    rng = random.Random(3)
    letters = "abcdefghi'st re LlvVmMdD  \n\t éÉñß12345!?-–’́µİŉ<|endoftext|>"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(500)]
    docs = spark.createDataFrame([(i if i else None, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, over_limit string")
    got = {r.doc_id or 0: r for r in token_counts.token_counts(docs, limit=30).collect()}
    for i, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 30), text
    assert token_counts.token_counts(docs.where("false")).collect() == []


def test_counts_of_whole_table(spark, library):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = queries.op11_token_counts(spark, FOLDER).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_tokens == len(library.encode(rows[r.doc_id] or "", add_special_tokens=False).ids) and r.over_limit == (r.n_tokens > 2048)


def test_long_texts_in_pieces():
    counter = token_counts.TokenCounter(open(token_counts.default_vocabulary()).read())
    texts = pa.array([t or "" for t in ODD], pa.large_string())
    whole = counter.counts(texts)
    cut = np.zeros(len(texts), np.int64)
    for rows, part in token_counts.pieces(texts, 300):
        np.add.at(cut, rows, counter.counts(part))
    assert (cut == whole).all()


def merged_one_by_one(ids, ranks):
    """Byte pair merging with a queue: lowest rank first, then leftmost."""
    ids = list(ids)
    while True:
        found = min(((ranks[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks), default=None)
        if found is None:
            return len(ids)
        i = found[1]
        ids[i:i + 2] = [ranks[ids[i], ids[i + 1]][1]]


@pytest.mark.parametrize("merges", [["a a", "aa a", "b a", "aa b"], ["b c", "x bc", "a b", "ab c", "abc abc", "a bc", "abc x"], ["c abc", "a b", "ab c", "bc a"]])
def test_merging_all_at_once(merges):
    vocab = {}
    for part in [*"abcx", *(m.replace(" ", "") for m in merges), *(p for m in merges for p in m.split())]:
        vocab.setdefault(part, len(vocab))
    ranks = {tuple(vocab[p] for p in m.split()): (i, vocab[m.replace(" ", "")]) for i, m in enumerate(merges)}
    merger = token_counts.Merger(vocab, merges)
    rng = random.Random(1)
    rows = [[vocab[rng.choice("aabcx")] for _ in range(rng.randint(1, 14))] for _ in range(400)]
    got = merger.survivors(np.array([x for r in rows for x in r], np.int32), np.array([len(r) for r in rows]))
    assert got.tolist() == [merged_one_by_one(r, ranks) for r in rows]
    assert token_counts.Merger({"a": 0}, []).survivors(np.array([0, 0, 0], np.int32), np.array([3])).tolist() == [3]


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        token_counts.TokenCounter(open(public_tokenizers.path("byte_bpe_50k.json")).read())


def brute_search(docs, items, top=10):
    held = [(d, collections.Counter(ranked_search.terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    count, total = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        best = []
        for d, c in held:
            m = 25 + 75 * sum(c.values()) * count // total
            score = sum(ranked_search.weight(count, df[t]) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ranked_search.terms(text) if t in c)
            if score > 0:
                best.append((-score, d is None, d or 0))
        for rank, (s, none, d) in enumerate(heapq.nsmallest(top, best), 1):
            out.append((item, rank, None if none else d, -s))
    return sorted(out, key=str)


def test_search_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"t{i}" for i in range(40)] + ["É", "ñu"]
    texts = [None, "", " .,;", "T1 t1", LONG + " t1 t2 t2", "t3-t4/t5", *[" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(42)], k=rng.randint(1, 30)))
             for _ in range(900)]]
    docs = [(i if i != 9 else None, t) for i, t in enumerate(texts)] + [(30, texts[30]), (30, texts[30]), (31, "t1 t2 t3")] + [(2000 + i, "t7 t8 t7") for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for i in range(30)]
    items += [(3, items[3][1]), (None, "t1 t1 T2"), (50, None), (51, ""), (52, "absent words"), (53, " ".join(vocabulary * 2)), (54, LONG), (55, "É ñu É"), (56, "t8")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, score int").repartition(5)
    queries_ = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    want = brute_search(docs, items)
    for options in ({}, {"most_terms": 20, "batch_rows": 70}):
        got = ranked_search.search(frame, queries_, **options).collect()
        assert sorted(map(tuple, got), key=str) == want
    assert sorted(map(tuple, ranked_search.search(frame, queries_, top=3).collect()), key=str) == brute_search(docs, items, 3)
    assert ranked_search.search(frame.where("false"), queries_).collect() == []
    assert ranked_search.search(frame, queries_.where("false")).collect() == []


def test_search_of_ties_and_one_term(spark):
    frame = spark.createDataFrame([(i, "same text") for i in range(100, 0, -1)], "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(1, "same"), (2, "text same same")], "item_id long, text string")
    assert ranked_search.weight(100, 100) == 4
    got = sorted(map(tuple, ranked_search.search(frame, items).select("item_id", "rank", "doc_id").collect()))
    assert got == [(i, r, r) for i in (1, 2) for r in range(1, 11)]


def test_search_beside_very_long_terms(spark):
    """A term of more than 256 bytes must not change how the other terms beside it are found."""
    docs = [(1, "alpha beta"), (2, "alpha " + "z" * 300 + " beta beta"), (3, "y" * 700), (4, "gamma alpha")]
    items = [(1, "alpha beta"), (2, "beta " + "y" * 700), (3, "z" * 300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = ranked_search.search(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute_search(docs, items)
    texts = pa.array(["one two", "x" * 257, "one"])
    words = [wordhash.Words(texts, a, b, wordhash.separators()).hashes().tolist() for a, b in ((0, 1), (0, 3))]
    assert words[1][:2] == words[0] and words[1][3] == words[0][0]


def test_long_documents_are_cut_between_terms():
    texts = pa.array([LONG.replace(" ", "-"), "a b", LONG], pa.string())
    for limit in (500, 5000):
        parts = [(row, part) for row, part in ranked_search._parts(texts, limit)]
        found = collections.defaultdict(list)
        for row, part in parts:
            for i, t in enumerate(part.to_pylist()):
                found[row + i] += ranked_search.terms(t)
        assert [found[i] for i in range(3)] == [ranked_search.terms(t) for t in texts.to_pylist()] and len(parts) > 3


def whitened_by_numpy(vectors):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    y = x - sums / n
    e, v = np.linalg.eigh(y.T @ y / n)
    return x, n, sums, y, e[::-1], v[:, ::-1]


def held_against_numpy(got, ids, vectors, width):
    x, n, sums, y, e, v = whitened_by_numpy(vectors)
    place = {d: i for i, d in enumerate(ids)}
    w = np.zeros((n, width))
    for r in got:
        assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[place[r.vec_id]], sums))
        assert abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-8
        w[place[r.vec_id], r.component - 1] = r.whitened
    want = y @ v[:, :width] / np.sqrt(e[:width])
    assert len(got) == n * width and np.abs(w * np.sign((w * want).sum(axis=0)) - want).max() < 1e-6


def test_whitening_of_whole_table(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    held_against_numpy(queries.op13_embedding_whitening(spark, FOLDER).collect(), [r.vec_id for r in rows], [r.embedding for r in rows], 8)


def test_whitening_of_ill_conditioned_and_flat_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 12)) * np.logspace(6, -1, 12)
    flat = np.hstack([rng.normal(size=(300, 3)) * [9, 3, 1], np.ones((300, 4))])
    for vectors, width in ((base, 8), (flat, 3)):
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        held_against_numpy(whitening.whiten(frame).collect(), range(300), vectors, width)


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [1.5, -2.0]), (2, [1.5, -2.0]), (None, [0.25, 7.0]), (5, None), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, -inf]),
            (10, [-3.0, 0.5])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, n string")
    got = whitening.whiten(frame).collect()
    assert collections.Counter(r.vec_id for r in got) == {1: 2, 2: 4, None: 2, 10: 2} and {r.n for r in got} == {5}
    for none in (frame.where("false"), frame.where("vec_id = 1"), frame.where("vec_id = 2"), frame.where("vec_id = 5"),
                 spark.createDataFrame([(1, [])], "vec_id long, embedding array<float>")):
        assert whitening.whiten(none).collect() == []
    with pytest.raises(ValueError):
        whitening.whiten(frame.unionByName(spark.createDataFrame([(1, [1.0], "x")], frame.schema)))
    far = spark.createDataFrame([(i, [1e9 * i, 1.0 + i % 3]) for i in range(40)], "vec_id long, embedding array<double>")
    assert {r.vec_id: int(r.deviation) for r in whitening.whiten(far).where("component = 1").collect()} == {
        i: sum((40 * a - b) ** 2 for a, b in zip((1024 * 10**9 * i + 100_000, 1024 * (1 + i % 3) + 100_000),
                                                 (1024 * 10**9 * 780 + 4_000_000, 1024 * sum(1 + j % 3 for j in range(40)) + 4_000_000))) for i in range(40)}
