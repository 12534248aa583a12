"""Each operator of the llm folder against brute force on whole small tables, and on nulls, empty, tied, repeated and long rows."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import (decontaminate, exact_dedup, line_dedup, mixing, ngram_join, queries, secret_scan, substring_dedup,
                          token_output, toxicity, warc, wordhash)
from tidemark.llm.common import keep

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 911}x{i}" for i in range(20_000))
SHARED = " ".join(f"common{i}" for i in range(60))
DOC = "doc_id long, text string, lang string, source string, n_chars long, row_key string, size int, key string"


def rows(*texts, first=0):
    return [(first + i, t, "en", "s", len(t or ""), "x", 1, "k") for i, t in enumerate(texts)]


EDGES = rows(None, "", " \t\n", "one", "a b c", "a b c", SHARED, "start " + SHARED + " end", SHARED.upper(), LONG, LONG + " tail", "a\nb\nc\nd\na\nb\nc\nd")
EDGES += [(None, SHARED, None, None, None, None, None, None), (3, "one", "en", "s", 3, "x", 1, "k"), (6, "other text under a used id", "fr", None, 1, "x", 1, "k")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_matches_sql(name, spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double"}
    got = queries.QUERIES[name](spark, FOLDER)
    assert dict(got.dtypes) == {c[0]: kinds[str(c[1])] for c in want.description}  # the whole schema, not the SQL's part of it
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(map(tuple, want.fetchall()), key=str)


def test_exact_dedup_edges(edges, empty):
    for budget in (exact_dedup.BUDGET, 2000):  # the small one empties tables early and spills
        got = exact_dedup.grace_dedup(edges, budget=budget).collect()
        assert len(got) == len(EDGES)
        groups = collections.defaultdict(list)
        for doc, text, *_ in EDGES:
            groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0))
        for content, members in groups.items():
            own = [r for r in got if r.text_sha256 == hashlib.sha256(content.encode()).hexdigest()]
            assert len(own) == len(members) and {r.group_size for r in own} == {len(members)}
            assert sum(r.kept for r in own) == 1
            assert {r.keep_id for r in own} == {min(members)[2] if not min(members)[1] else None}
    assert exact_dedup.grace_dedup(empty).collect() == []


def test_substring_edges(edges, empty):
    got = {(r.doc_id, r.n_words): r for r in substring_dedup.substring_dedup(edges).collect()}
    assert got[(7, 62)].n_removed == 60 and got[(7, 62)].kept_sha256 == hashlib.sha256(b"start end").hexdigest()
    assert got[(6, 60)].n_removed == got[(8, 60)].n_removed == got[(None, 60)].n_removed == 0  # case counts, null ids stay out
    assert got[(10, 20_001)].n_removed == 20_000
    assert got[(0, 0)].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert substring_dedup.substring_dedup(empty).collect() == []


def test_line_edges(edges, empty):
    got = line_dedup.line_dedup(edges).collect()
    assert len(got) == len(EDGES)
    assert {(r.n_lines, r.n_removed) for r in got if r.doc_id in (0, 1)} == {(1, 0)}
    assert line_dedup.line_dedup(empty).collect() == []


def test_line_chunks_resist_shifts(spark):
    body = "\n".join(f"line {i * i}" for i in range(60))
    docs = spark.createDataFrame([(0, body), (1, "new first line\n" + body + "\nnew last line"), (2, "nothing\nshared")], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert got[0].n_removed == got[2].n_removed == 0 and got[1].n_removed >= 40


def test_line_repeated_runs_against_brute_force(spark):
    own = [(0, "x\na\nb\ny"), (1, "p\na\nb\nq\nr"), (2, "s\ns\ns\ns\ns"), (3, "b\np\na"), (4, "q"), (5, None)]
    own += [(10 + i, f"u{i}\nm{i % 7}\nn{i % 7}\nv{i}\n" + "\n".join(f"z{j}" for j in range(i % 5))) for i in range(60)]
    real = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    for docs in (own, real):
        first, want, total = {}, {}, 0
        for doc, text in sorted(docs):
            lines = (text or "").split("\n")
            gone = set()
            for i in range(len(lines) - 1):
                seen, at = first.setdefault((lines[i], lines[i + 1]), (doc, i))
                if seen != doc or at + 2 <= i:
                    gone |= {i, i + 1}
            kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
            want[doc] = len(gone), hashlib.sha256(kept.encode()).hexdigest()
        got = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert {r.doc_id: (r.n_repeated, r.unrepeated_sha256) for r in got} == want
        assert sum(n for n, _ in want.values()) > sum(r.n_removed for r in got)
        assert all(r.n_repeated >= r.n_removed for r in got)


def test_secret_scan(spark, edges, empty):
    rng = np.random.default_rng(1)
    key = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 40))
    texts = [f"Token = '{'a1' * 5}' x AKIA{'Q7' * 6} é {'0f' * 20} password: short", "token=secret:abcdefghij", f"see {key} here",
             "averyveryverylongordinarywordwithoutdigits and so on", None, "", "secret=abcdefgh" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    patterns = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)),
                ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+")))
    for i, text in enumerate(texts):
        spans = sorted((m.start(), k, m.end()) for k, (_, p) in enumerate(patterns) for m in p.finditer(text or "")
                       if (len(m[2]) >= 8 if k == 0 else len(m[0]) >= (16 if k == 1 else 32)))
        joined = ",".join(f"{patterns[k][0]}:{a}:{b}" for a, k, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == n for _, k, _ in spans) for n in range(3)]
    assert got[2].spans == "random:4:44" and got[3].n_random == 0
    assert len(secret_scan.scan(edges).collect()) == len(EDGES) and secret_scan.scan(empty).collect() == []


def test_warc_edges(spark, tmp_path):
    pages = [(3, "u3", "same\r\n\r\nWARC/1.1"), (1, "u\n1", "same\r\n\r\nWARC/1.1"), (None, None, "same\r\n\r\nWARC/1.1"), (4, "u4", None), (5, "u5", ""),
             (6, "u6", "é" * 50_000), (6, "u6", "é" * 50_000), (None, "n", "only null")]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, record_type string")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.revisit_archives(frame).collect()), key=str)
    assert got == sorted([(3, 16, "revisit", 1), (1, 16, "response", None), (None, 16, "revisit", 1), (4, 0, "response", None), (5, 0, "revisit", 4),
                          (6, 100_000, "response", None), (6, 100_000, "response", None), (None, 9, "response", None)], key=str)
    assert {r.record_type for r in warc.revisit_archives(frame, min_bytes=10**9).collect()} == {"response"}
    assert warc.revisit_archives(frame.where("false")).collect() == []


def test_decontamination(spark, edges, empty):
    item = "A train leaves Berlin with 120 passengers and after 3 hours reaches Madrid where 45 of them get off the train"
    items = spark.createDataFrame([(1, item, "x"), (2, "tiny item", "x"), (3, None, "x"), (4, "seven plain words make one short item", "x")], "item_id long, text string, doc string")
    other = item.replace("120", "800").replace("3 hours", "7 hours").replace("Madrid", "Lisbon")
    broken = " ".join(w for i, w in enumerate(item.split()) if i % 4)
    docs = spark.createDataFrame([(10, "before " + item + " after", 1), (11, f"x y z {other}", 1), (12, broken, 1), (13, None, 1), (14, "", 1),
                                  (15, "here seven plain words make one short item ends", 1), (16, "tiny item", 1), (None, item, 1), (10, "clean text", 1)],
                                 "doc_id long, text string, item long")
    got = {(r.doc_id, r.item_id): r.exact for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(10, 1): True, (11, 1): False, (15, 4): True, (None, 1): True}
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.text for r in kept.collect()))) == sorted(map(str, [broken, None, "", "tiny item", "clean text"]))
    assert decontaminate.contaminated(empty, items).collect() == [] and decontaminate.contaminated(edges, items.where("false")).collect() == []


def test_decontamination_finds_verbatim_copies(spark):
    series = "What comes next 2 4 8 16 32 64 128 256 512 1024"
    trip = "On Monday the guide Anna drove from Bergen to Oslo with four old friends of Peter and Maria"
    short = "Seven plain words make one item"
    items = spark.createDataFrame([(1, series), (2, trip), (3, short)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so: {series} ?"), (2, f"he said {trip.lower()}"), (3, trip.replace(" ", "  ")), (4, trip.replace(" ", "\r\n")),
                                  (5, f"note {short}"), (6, series.replace("4 8", "5 7").replace("64", "63")), (7, "What comes next is unknown"),
                                  (8, trip.replace(" ", "  ").replace("Anna", "Berta").replace("Oslo", "Bonn"))], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.exact for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 1): True, (2, 2): True, (3, 2): True, (4, 2): True, (5, 3): True, (8, 2): False}


def test_decontamination_finds_whole_items(spark):
    con = duckdb.connect()
    want = con.execute(f"SELECT DISTINCT d.doc_id, b.item_id FROM '{FOLDER}/documents.parquet' d JOIN '{FOLDER}/benchmark.parquet' b ON contains(d.text, b.text)").fetchall()
    got = {(r.doc_id, r.item_id) for r in queries.op5_decontamination(spark, FOLDER).collect()}
    assert want and set(want) <= got


def test_token_round_trip(spark, edges, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_output.default_vocabulary())
    odd = ["a   b", "a \n b", "x\n \ny", " lead", "trail ", "don't 's  ok", "é ñ\t\tz 12", "naïve Straße, mañana.", "ſ́   z"]
    docs = edges.unionByName(edges.sparkSession.createDataFrame(rows(*odd, first=100), DOC))
    got = token_output.token_output(docs, block_tokens=5000).orderBy("start").collect()
    start = 0
    wanted = collections.Counter()
    for _, text, *_ in [*EDGES, *rows(*odd, first=100)]:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        wanted[len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert collections.Counter((r.n_tokens, r.ids_crc32) for r in got) == wanted
    order = [r.doc_id for r in got]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert token_output.token_output(empty).collect() == []


def test_token_ids_equal_the_library(monkeypatch):
    from tokenizers import Tokenizer

    with open(token_output.default_vocabulary(), encoding="utf-8") as file:
        vocabulary = file.read()
    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.encode_special_tokens = True
    rng = np.random.default_rng(3)
    letters = list(" \n\t '" "''sstmdrevll aB129é!?.,-ñß\x85\xa0\x1c中ſI ")
    texts = ["".join(rng.choice(letters, rng.integers(0, 14))) for _ in range(20_000)]
    texts += [None, "", "a  ", "a\n ", "x<|endoftext|>y", "don't can't we'll 'tis 'sup x'really", "\n\n's", " 's", "e" * 5000, "中" * 700]
    monkeypatch.setattr(token_output, "GROUP_WORDS", 999)
    got = token_output.WordEncoder(vocabulary).encode(pa.array(texts))
    assert [x.tolist() for x in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    with pytest.raises(ValueError):
        token_output.WordEncoder(vocabulary.replace('"type":"ByteLevel","add_prefix_space":false', '"type":"ByteLevel","add_prefix_space":true'))


@pytest.mark.parametrize("n", [1, 63, 64, 5000, 700_000])
def test_coder_round_trip_and_damage(n):
    ids = np.random.default_rng(n).geometric(0.01, n).astype(np.uint32) % 3000
    coder = token_output.Coder(token_output.scaled(np.bincount(ids)))
    block = coder.pack([7, None], [n - 1, 1], ids)
    docs, lengths, back = coder.unpack(block)
    assert docs == [7, None] and list(lengths) == [n - 1, 1] and (back == ids).all()
    with pytest.raises(ValueError):
        coder.unpack(block[:50] + bytes([block[50] ^ 1]) + block[51:])


def test_toxicity_learns(spark, edges, empty):
    rng = np.random.default_rng(0)
    plain = [f"word{i}" for i in range(300)]
    texts, toxic = [], []
    for i in range(600):
        own = list(rng.choice(plain, 40))
        toxic.append(int(i % 4 == 0))
        if toxic[-1]:
            own[int(rng.integers(40))] = f"nasty{rng.integers(50)}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame([(i, t, ["en", "fr", None][i % 3], "clash") for i, t in enumerate(texts)], "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([*((i, y) for i, y in enumerate(toxic)), (None, 1), (5, None)], "doc_id long, toxic int")
    model, thresholds = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model, thresholds).collect()}
    held = [i for i in got if got[i].held_out]
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == got[i].held_out for i in got)
    assert np.mean([got[i].predicted == toxic[i] for i in held]) > 0.95
    kept = toxicity.keep_clean(docs, model, thresholds)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].rejected}
    assert len(toxicity.score(edges, model, thresholds).collect()) == len(EDGES) and toxicity.score(empty, model, {}).collect() == []
    untrained, none = toxicity.fit(docs, labels.where("false"))
    assert none == {} and len(toxicity.score(docs, untrained, none).collect()) == 600


def test_jaccard_edges(edges, empty):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.jaccard_join(edges).collect()}
    assert got[(0, 0)] == 0 and got[(2, 0)] == 2 and got[(4, 1)] == got[(5, 1)] == 4
    assert got[(8, 56)] == got[(7, 58)] == got[(6, 56)] == got[(None, 56)] == 6 and got[(10, 19_997)] == 9
    assert ngram_join.jaccard_join(empty).collect() == []
    kept = ngram_join.keep_one(edges)
    assert kept.columns == edges.columns
    # One row of each group stays: the one of smallest id, one of repeated rows; texts without words and unlike texts under a used id stay.
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "a b c"), (6, SHARED), (9, LONG),
        (11, EDGES[11][1]), (6, "other text under a used id")], key=str)
    assert ngram_join.keep_one(empty).collect() == []


def test_keep_one_goes_by_row(spark):
    like, unlike = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(1, like, "x"), (1, like, "y"), (2, like, "z"), (2, unlike, "z"), (None, unlike + " more", "n"), (None, None, "n"), (None, None, "n")],
                                 "doc_id long, text string, component string")
    got = sorted(((r.doc_id, r.text) for r in ngram_join.keep_one(docs).collect()), key=str)
    assert got == sorted([(1, like), (2, unlike), (None, None), (None, None)], key=str)


def test_jaccard_chain_of_near_copies(spark):
    base = [f"t{i}" for i in range(120)]
    docs = [(i, " ".join(base[i * 4:] + [f"n{j}" for j in range(i * 4)])) for i in range(20)]  # each like its neighbours only
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.component_id for r in ngram_join.jaccard_join(frame).collect()} == {0}


def test_mixing(spark, edges, empty):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (i % 90)), ["a", "b", "c", None][(i % 8) % 4 if i % 8 < 4 else 0]) for i in range(4000)],
                                 "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    sums, targets = collections.Counter(), {}
    for r in got:
        sums[r.source_size] += r.taken
        targets[r.source_size] = r.target
    total = sum(r.size for r in got)
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 * total
    for s, t in targets.items():
        assert t <= 2 * s + 1e-6 and abs(sums[s] - t) <= mixing.BLOCK + 1
    mixed = {r.doc_id: len(words(r.text)) for r in mixing.mix_documents(docs).collect()}
    assert mixed == {r.doc_id: r.taken for r in got if r.taken}
    assert len(mixing.mix(edges).collect()) == len(EDGES) and mixing.mix(empty).collect() == []
    assert mixing.mix_documents(edges).columns == edges.columns


def test_mix_is_written_by_shard(spark):
    own = [(i if i % 9 else None, " ".join(f"w{i % 500}_{j}" for j in range(i % 90)), "ab"[i % 3 == 0]) for i in range(1500)]
    docs = spark.createDataFrame([*own, *own[:40], (7, None, "a"), (8, "x y", None)], "doc_id long, text string, source string")
    sizes, pieces, slots = mixing.plan(mixing.keyed(docs, "doc_id", "source", "text"), shard_blocks=100)
    written = mixing.write_shards(docs, pieces, slots)
    got = written.collect()
    want = {(r.shard, r.source_no, r.slot): r.block for r in slots.collect()}
    assert len({r.shard for r in got}) > 5 and len({tuple(f.split("/")[-2:-1]) for f in written.inputFiles()}) == len({r.shard for r in got})
    assert len(got) == len(want) and {(r.shard, r.source_no, r.slot) for r in got} == set(want)
    blocks, texts = {}, {r.row_key: words(r.text) for r in mixing.keyed(docs, "text").collect()}
    for p in sorted(pieces.collect(), key=lambda p: (p.source_no, p.block, p["at"])):
        blocks.setdefault((p.source_no, p.block), []).extend(texts[p.row_key][p["first"]:p["first"] + p.words])
    for r in got:
        assert r.words.split(" ") == blocks[r.source_no, want[r.shard, r.source_no, r.slot]]
        assert sum(p.n for p in r.of) == len(r.words.split(" ")) <= mixing.BLOCK
    last = max(w for _, w in blocks)
    assert all(len(words_) == mixing.BLOCK for (no, block), words_ in blocks.items() if (no, block + 1) in blocks) and last > 1


def test_permutation_is_one():
    for n in (1, 2, 7, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, b"k")) == list(range(n))


def test_word_hashes_match_python():
    texts = ["A bb\tccc", None, "", " x ", "é" * 300, "bb"]
    column = pa.array(texts)
    got = wordhash.Words(column, 0, len(texts), wordhash.separators())
    hashes = got.hashes()
    assert [got.bounds[i + 1] - got.bounds[i] for i in range(len(texts))] == [len(words(t)) for t in texts]
    assert hashes[1] == hashes[-1] and len(set(hashes.tolist())) == 5
    assert (wordhash.sliding_min(np.arange(10)[::-1].copy(), 4) == [6, 5, 4, 3, 2, 1, 0]).all()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.keep(stage(spark, docs, FOLDER), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert 0 < docs.count() <= before, name
        before = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert out.count() == before


def test_number_tables_do_not_meet_number_items(spark):
    """Windows of placeholders alone stay out of the index; one with enough words beside the numbers is still found."""
    rng = np.random.default_rng(1)

    def numbers(n):
        return " ".join(str(x) for x in rng.integers(100, 10**8, n))

    told = "the sum of all {} {} {} {} {} {} {} makes a total here"
    docs = [*(numbers(600) for _ in range(20)), "start now " + told.format(*range(11, 18)) + " and so on"]
    items = [*(numbers(100) for _ in range(10)), told.format(*range(31, 38))]
    kept = []
    keep = decontaminate.keep
    try:
        decontaminate.keep = lambda df, name, *rest: kept.append((name, keep(df, name, *rest))) or kept[-1][1]
        got = decontaminate.contaminated(spark.createDataFrame(rows(*docs), DOC),
                                         spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    finally:
        decontaminate.keep = keep
    assert [tuple(r) for r in got] == [(20, 10, False)]
    assert sum(t.count() for name, t in kept if name == "bench-hits") < 20


def test_near_copies_cost_a_few_comparisons_a_member(spark, monkeypatch):
    """Copies of one text, each with its own changes: the head links with some only, yet not all pairs are compared."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]

    def copy(changes):
        words = list(base)
        for at in rng.choice(150, changes, replace=False):
            words[at] = f"x{rng.integers(10**9)}"
        return " ".join(words)
    texts = [copy(3 - i % 3) for i in range(300)] + [" ".join(f"y{i}{j}" for j in range(30)) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    compared, verify = [], ngram_join.Join._verified

    def counted(self, pairs, reps, name):
        compared.append(pairs.count())
        return verify(self, pairs, reps, name)
    monkeypatch.setattr(ngram_join.Join, "_verified", counted)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_join(docs).collect()}
    sets = [{tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    near = [[b for b, y in enumerate(sets) if 100 * len(x & y) >= 75 * len(x | y)] for x in sets]
    low = list(range(len(texts)))
    for _ in low:
        new = [min(low[b] for b in near[a]) for a in range(len(texts))]
        if new == low:
            break
        low = new
    assert [got[i] for i in range(len(texts))] == low
    assert len(set(low[:300])) < 30 and sum(compared) < 40 * 300


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """Groups cover all labelled rows, long ones too, and what only one group has seen is learned as well."""
    rng = np.random.default_rng(1)
    texts, toxic = [], []
    for i in range(900):
        own = [f"word{j}" for j in rng.integers(0, 200, 30)]
        toxic.append(int(i % 3 == 0))
        if toxic[-1]:
            own[int(rng.integers(30))] = f"nasty{rng.integers(30)}"
        texts.append(" ".join(own))
    texts[6] = " ".join(["word1"] * 50_000) + " nasty1"
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    kept = []
    monkeypatch.setattr(toxicity, "keep", lambda df, name: kept.append(keep(df, name)) or kept[-1])
    model, thresholds = toxicity.fit(docs, labels, group_rows=100)
    known = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 != 1]
    taught = kept[0].collect()
    assert sorted(r.text for r in taught) == sorted(texts[i] for i in known)
    sizes = collections.Counter(r.part for r in taught)
    assert len(sizes) == 6 and kept[1].count() == sizes[-1] and max(n for part, n in sizes.items() if part >= 0) < 150
    got = {r.doc_id: r for r in toxicity.score(docs, model, thresholds).collect()}
    high, low = ([got[i].score for i in got if got[i].held_out and toxic[i] == y] for y in (1, 0))
    assert np.mean([a > b for a in high for b in low]) > 0.8  # a group of 100 rows has three steps a round


def test_long_texts_pool_in_blocks(monkeypatch):
    column = pa.array([" ".join(f"w{i % 97}x{i % 13}" for i in range(5000)), "one", ""])
    model = toxicity.fresh(3)
    whole = toxicity.logits(model, column, 0, 3)
    for places in (1 << 16, 64, 1):
        monkeypatch.setattr(toxicity, "PLACES", places)
        assert np.allclose([toxicity.logits(model, column, i, i + 1)[0] for i in range(3)], whole, atol=1e-5)


def test_language_thresholds_are_those_of_all_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(lang, float(np.round(np.clip(0.2 + 0.4 * y + rng.normal(0, 0.2), 0, 1), 2)), y) for lang in ("en", "de") for y in rng.integers(0, 2, 80).tolist()]
    rows += [("fr", 0.3, 0), ("fr", 0.9, 0)]
    got = toxicity.language_thresholds(spark.createDataFrame(rows, "lang string, score double, toxic int"))
    assert got["fr"] == 0.7

    def f1(lang, cut):
        own = [(s >= cut, y) for at, s, y in rows if at == lang]
        return 2 * sum(said and y for said, y in own) / (sum(said for said, _ in own) + sum(y for _, y in own))
    for lang in ("en", "de"):
        assert f1(lang, got[lang]) == pytest.approx(max(f1(lang, c / 1000) for c in range(5, 1000, 10)))


def test_toxicity_groups_are_parts_of_their_own(spark, monkeypatch):
    """An even number of groups: each has about its share of the rows and one file; rows without a label are not shuffled, no row with one is lost."""
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('w', id, ' text') as text", "'en' as lang")
    labels = spark.range(0, 4000, 2).selectExpr("cast(id as int) as doc_id", "cast(id % 4 = 0 as int) as toxic")
    known = labels.where(toxicity.fold(F.col("doc_id")) != 1)
    near = toxicity.likely_labelled(docs, known)
    assert near.join(known, "doc_id", "left_anti").count() < 20 and near.join(known, "doc_id").count() == known.count()
    kept = []
    monkeypatch.setattr(toxicity, "keep", lambda df, name: kept.append(keep(df, name)) or kept[-1])
    toxicity.fit(docs, labels, group_rows=180)
    taught = kept[0].withColumn("file", F.input_file_name()).groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files")).collect()
    sizes = {r.part: r.n for r in taught}
    groups = max(sizes) + 1
    assert sum(sizes.values()) == known.count() and groups % 2 == 0 and sorted(sizes) == [-1, *range(groups)]
    assert all(r.files == 1 and 90 < r.n < 270 for r in taught if r.part >= 0)


def test_near_copies_that_do_not_link_are_rarely_compared(spark, monkeypatch):
    """Texts that share rare n-grams and 0.70 of their sets: the filters in the join drop most of their pairs, and no link is lost."""
    rng = np.random.default_rng(5)
    base = [f"base{i}" for i in range(120)]
    texts = []
    for i in range(40):
        words = list(base)
        for place in rng.choice(23, 2, replace=False):
            words[5 * place + 4] = f"own{i}x{place}"
        texts.append(" ".join(words))
    texts.append(texts[7] + " more")  # links with one of them
    sets = [{tuple(t.split()[j:j + 5]) for j in range(len(t.split()) - 4)} for t in texts]
    linked = {(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    compared, verified = [], ngram_join.Join._verified
    monkeypatch.setattr(ngram_join.Join, "_verified", lambda self, pairs, reps, name: compared.append(pairs.count()) or verified(self, pairs, reps, name))
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_join(spark.createDataFrame(rows(*texts), DOC)).collect()}
    low = list(range(len(texts)))
    for _ in texts:
        for i, j in linked:
            low[i] = low[j] = min(low[i], low[j])
    assert got == dict(enumerate(low)) and (40, 7) in linked
    assert sum(compared) < 820 // 2
