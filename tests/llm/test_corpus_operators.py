"""The corpus operators against plain versions on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from factloom.llm import embedding_dedup, line_dedup, minhash_dedup, mixing, packing, quality_model, quality_rules, substring_dedup, token_counts, warc
from factloom.llm.components import connected_components
from factloom.llm.queries import BYTE_MODEL, PRETOKEN_MODEL, tokenizer_path

DOCS = "doc_id long, text string, source string, kept string, n_words long"
WORDS = [f"w{i}" for i in range(60)]


def words(t):
    return [w for w in __import__("re").split("[\x20\x09-\x0d]+", t or "") if w]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 120))) for _ in range(40)]
    passage = " ".join(f"p{i}" for i in range(50))
    for i in (3, 9, 17):
        texts[i] = " ".join([*words(texts[i])[:30], passage, *words(texts[i])[30:]])
    texts += [texts[5], texts[5] + " extra", "x " * 90, "", None, "one", "two words", " \t\n", "É ß ö\x1c x　y", "tab\tsep\x0bvt\nline", "<|endoftext|> a<|endoftext|>b", "  lead  double \n next", "a" * 4000]
    rows = [(i, t, rng.choice(["s1", "s2", "s3", None]), "clash", 7) for i, t in enumerate(texts)]
    return [*rows, (None, "null id text here", "s1", "clash", 7), rows[4], rows[4]]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_substrings(docs, corpus, empty):
    at = Counter()
    for r in corpus:
        w = words(r[1])
        at.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = []
    for r in corpus:
        w = words(r[1])
        gone = {i + k for i in range(len(w) - 34) if at[tuple(w[i : i + 35])] > 1 for k in range(35)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r)[:4] for r in substring_dedup.remove_repeats(docs).collect()]
    assert Counter(got) == Counter(want)
    assert substring_dedup.remove_repeats(empty).collect() == []


def test_index_finds_repeats_across_batches_and_compacts(spark):
    index = substring_dedup.FingerprintIndex.create(spark, fanout=2)
    batch = lambda xs: spark.createDataFrame([(x, 1) for x in xs], "fp long, n int")
    assert index.add(batch([1, 2, 3])).collect() == []
    assert sorted(map(tuple, index.add(batch([3, 4, 4])).collect())) == [(3, 2), (4, 2)]
    index.compact()
    assert [k for k, _ in index.runs] == [1]
    assert [tuple(r) for r in index.add(batch([1, 9])).collect()] == [(1, 2)]
    assert sorted(map(tuple, index.hits().collect())) == [(1, 2), (3, 2), (4, 2)]
    index.delete()


def test_index_of_three_batches_in_two_sessions_equals_one_run(spark, docs, corpus):
    want = Counter(tuple(r)[:4] for r in substring_dedup.remove_repeats(docs).collect())
    first = substring_dedup.FingerprintIndex.create(spark)
    part = lambda k: docs.where(f"coalesce(doc_id, 0) % 3 = {k}")
    substring_dedup.add_texts(first, part(0))
    substring_dedup.add_texts(first, part(1))
    first.compact()
    first.close()
    # what the first left is found by its folder alone
    other = spark.newSession()
    second = substring_dedup.FingerprintIndex.open(other, first.path)
    assert second.runs == first.runs and not other.catalog.tableExists(second.runs[0][1])
    later = other.createDataFrame([r for r in corpus if (r[0] or 0) % 3 == 2], DOCS)
    substring_dedup.add_texts(second, later)
    got = substring_dedup.remove_repeats(other.createDataFrame(corpus, DOCS), index=second).collect()
    assert Counter(tuple(r)[:4] for r in got) == want
    second.delete()


def test_old_runs_are_not_moved(spark):
    index = substring_dedup.FingerprintIndex.create(spark, buckets=4)
    for xs in ([1, 2, 3], [3, 4]):
        index.add(spark.createDataFrame([(x, 1) for x in xs], "fp long, n int"))
    (_, a), (_, b) = index.runs
    with index._sorted():
        plan = index._run(a).join(index._run(b).select("fp"), "fp", "left")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    index.delete()


def test_mixing(docs, corpus, empty):
    got = mixing.mix_documents(docs).collect()
    again = mixing.mix_documents(docs.repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r.r1, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in corpus)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r.taken <= 3 * r.size
        size[r.target] += r.size
        taken[r.target] += r.taken
        target[r.target] = r.source_size
    assert sum(target) == pytest.approx(sum(size.values()))
    for t in target:
        assert abs(taken[t] - t) <= 2 and t <= 3 * target[t] + 1e-9
    texts = mixing.mixed_texts(docs)
    assert texts.columns == docs.columns
    assert sum(len(words(r.text)) for r in texts.collect()) == sum(r.taken for r in got)
    assert mixing.mix_documents(empty).collect() == []


def test_mixing_shards_hold_all_sources(docs):
    got = mixing.mix_documents(docs, block=1, shard_slots=400).collect()
    held, shards = Counter(), {}
    for r in got:
        for p in r.parts:
            assert len(p.shards) == p.times
            for s in p.shards:
                held[s] += p["to"] - p["from"]
                shards.setdefault(r.target, Counter())[s] += p["to"] - p["from"]
    assert sum(held.values()) == sum(r.taken for r in got)
    total = sum(held.values())
    assert sorted(held) == list(range(total // 400)) and all(abs(n - total / len(held)) < total / len(held) / 3 for n in held.values())
    # the sources share the shards, with counts that vary about their weights
    for by in shards.values():
        assert len(by) > len(held) / 2 and len(set(by.values())) > 1


def test_mixing_blocks_have_one_length(spark):
    sizes = {"a": 20_000, "b": 300_000, "c": 700, "d": 1_000}
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(n)), s) for i, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
    for seed in (7, 8):
        got = mixing.mix_documents(docs, weights=(1, 2, 40, 1), seed=seed).collect()
        for r in got:
            assert abs(r.taken - r.target) <= 0.5 and r.taken == sum((p["to"] - p["from"]) * p.times for p in r.parts)
            assert all(x["to"] <= y["from"] for x, y in zip(r.parts, r.parts[1:])) and all(p["from"] < p["to"] and len(p.shards) == p.times <= 3 for p in r.parts)
            edges = {e for p in r.parts for e in (p["from"], p["to"])} - {r.size}
            assert sum(e % 256 > 0 for e in edges) <= 1


def test_permutation_back(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        there = mixing.permuted(F.col("id"), F.lit(n), F.lit(5))
        assert all(r[0] == r[1] for r in spark.range(n).select("id", mixing.permuted(there, F.lit(n), F.lit(5), back=True)).collect())


def test_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(5)).alias("p"))
        assert sorted(r[0] for r in df.collect()) == list(range(n))


def test_quality_classifier_learns_and_holds_out(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        rows.append((i, " ".join(rng.choice(["the", "of", "tree", "house"] if good else ["zz%%", "qq##", "the", "xx$$"]) for _ in range(60))))
        labels.append((i, int(good)))
    rows += [(900, None), (901, ""), (None, "the of tree")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (900, None), (None, 1)], "doc_id long, quality int")
    got = quality_model.quality_scores(docs, lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) > 0.95 * len(held)
    assert quality_model.quality_scores(docs.limit(0), lab).collect() == []


def test_near_duplicates(docs, corpus, empty):
    def shingles(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = words(w)
        return {tuple(w)} if len(w) == 1 else {(a, b) for a, b in zip(w, w[1:])}

    sets = {r[0]: shingles(r[1]) for r in corpus if r[0] is not None}
    comp = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                comp[a] = comp[b] = min(comp[a], comp[b])
    got = minhash_dedup.near_duplicates(docs, k=2).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id)
    assert minhash_dedup.near_duplicates(empty, k=2).collect() == []
    assert minhash_dedup.keep_one(docs).columns == docs.columns


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 1000).astype(np.uint64)
    sets = [base[:900], base[100:], base[:1]]
    doc = np.repeat(np.arange(3), [len(s) for s in sets])
    s = minhash_dedup.sketches(doc, np.concatenate(sets), 3, 256)
    assert (s != np.uint64(2**64 - 1)).all()
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.1


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (40, 40)]
    got = dict((r.node, r.component) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30}


def test_lines(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na \nb\n\nc\ny"), (3, None), (4, ""), (5, "q\nq\nq\nq\nq"), (None, "a\nb\nc"), (6, "a\nb")]
    got = {r.doc_id: tuple(r.lines) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (4, 0, "a\nb\nc\nd"), 2: (5, 3, "x\n\ny"), 3: (0, 0, None), 4: (0, 0, ""), 5: (5, 4, "q"), None: (3, 3, ""), 6: (2, 0, "a\nb")}


def test_archives(spark):
    big = "é" * 600
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "http://a/4", "small"), (5, "http://a/5", "small"), (6, "u\r\nx", None), (None, "http://n", big), (7, "http://a/7", "x\r\n\r\nWARC/1.1\r\n" * 100)]
    got = warc.archived_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = [(i, len((h or "").encode()), sha(h), "revisit" if h == big and i != 3 else "response", 3 if h == big and i != 3 else None) for i, _, h in rows]
    assert Counter(map(tuple, got)) == Counter(want)
    assert warc.archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_token_counts(docs, corpus, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(PRETOKEN_MODEL))
    want = [(r[0], len((r[1] or "").encode()), len(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in corpus]
    for hot in (131_072, 3):
        assert Counter(map(tuple, token_counts.token_counts(docs, tokenizer_path(PRETOKEN_MODEL), hot).collect())) == Counter(want)
    assert token_counts.token_counts(empty, tokenizer_path(PRETOKEN_MODEL)).collect() == []


def test_known_pieces_forget_between_texts_only(corpus):
    from tokenizers import Tokenizer

    tok, rules = Tokenizer.from_file(tokenizer_path(PRETOKEN_MODEL)), token_counts.split_rules(tokenizer_path(PRETOKEN_MODEL))
    size = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    texts = [r[1] for r in corpus if r[1]] + ["rare-one, rare-two; rare-one! <|endoftext|> ÉTÉ ﬁn a\x1cb " * 2, "x" * 200 + " y"]
    cut = token_counts.PreTokens(rules)
    pieces = {p for t in texts for u in cut.units(t) for p in cut.of_unit(u)}
    known = {p: size(p) for p in sorted(pieces)[::2]}
    for most in (1, 1 << 23):
        costs = token_counts.KnownPieces(token_counts.PreTokens(rules), known, most)
        for t in texts * 2:
            sure, late = costs.of(t)
            assert sure + sum(size(p) * n for p, n in late.items()) == size(t) and not late.keys() & known.keys()


def test_quality_rules(docs, corpus, empty):
    got = {r.doc_id: r.quality for r in quality_rules.quality_rules(docs, into="quality").collect()}
    for r in corpus:
        w = words(r[1])
        tri = Counter(zip(w, w[1:], w[2:]))
        rep = {i + k for i, t in enumerate(zip(w, w[1:], w[2:])) if tri[t] > 1 for k in range(3)}
        lines = [x for x in (r[1] or "").split("\n") if words(x)]
        q = got[r[0]]
        assert (q.n_words, q.word_chars, q.n_repeat_words, q.n_dup_lines) == (len(w), sum(map(len, w)), len(rep), len(lines) - len(set(lines)))
        assert q.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w)) and not (q.base_failed and q.kept)
    assert quality_rules.quality_rules(empty).collect() == []


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 16))
    x = np.concatenate([base, base[:10] + rng.normal(size=(10, 16)) * 0.1, base[:5]])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(100, None), (101, [0.0] * 16), (102, [float("nan")] * 16), (103, [1.0, None] * 8), (104, [1.0, 2.0]), (105, [2.0, 4.0]), (None, [1.0] * 16)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell_rows=5, block=7).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    found = sum(got[i][0] for i in range(len(x)))
    assert found >= 0.9 * links.sum() and all(got[i][0] <= links[i].sum() for i in range(len(x)))
    assert got[100] == (0, 100, True) and got[101] == (0, 101, True) and got[102] == (0, 102, True) and got[103] == (0, 103, True)
    assert got[104] == (1, 104, True) and got[105] == (1, 104, False)


def test_vectors_of_low_rank_lose_no_link(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1200, 5)) @ rng.normal(size=(5, 64))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(table, cell_rows=20, block=300).collect()}
    assert [got[i].n_links for i in range(len(x))] == links.sum(1).tolist()
    component = list(range(len(x)))
    while (new := [min([component[i], *(component[j] for j in np.nonzero(links[i])[0])]) for i in range(len(x))]) != component:
        component = new
    assert [got[i].component_id for i in range(len(x))] == component


def test_vectors_past_many_slabs(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16))
    # one cell's vectors fill several slabs and files
    x[200:500] = x[0] + 0.14 * rng.normal(size=(300, 16))
    x[500:600] = x[:100] + 0.1 * rng.normal(size=(100, 16))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    table = spark.createDataFrame([(int(i), x[i].tolist()) for i in rng.permutation(len(x))], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(table, cell_rows=30, block=16, slab_bytes=150 * 16 * 8).collect()}
    assert [got[i].n_links for i in range(len(x))] == links.sum(1).tolist()
    component = list(range(len(x)))
    while (new := [min([component[i], *(component[j] for j in np.nonzero(links[i])[0])]) for i in range(len(x))]) != component:
        component = new
    assert [(got[i].component_id, got[i].kept) for i in range(len(x))] == [(c, c == i) for i, c in enumerate(component)]
    parts = embedding_dedup.slabs({-4: 7, 0: 25, 1: 4, 2: 6, 3: 1}, 10)
    assert parts == [[(-4, 0, 1)], *[[(0, i, 3)] for i in range(3)], [(1, 0, 1), (2, 0, 1)], [(3, 0, 1)]]


def test_vectors_are_not_copied_to_the_cells_they_are_near_to(spark):
    n = 6000
    x = np.random.default_rng(8).normal(size=(n, 64)).astype(np.float32)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    shuffled = lambda: sum(e.totalShuffleWrite() for e in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    before = shuffled()
    assert embedding_dedup.near_vectors(table).count() == n
    # 15.7 times when each was copied to every cell it is near to
    assert shuffled() - before < 4 * x.nbytes


def test_packing(docs, corpus, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(BYTE_MODEL))
    got = packing.pack_documents(docs, tokenizer_path(BYTE_MODEL), length=64).collect()
    want = Counter()
    for r in corpus:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]
        start = 0
        for k, n in enumerate(packing.piece_lengths(len(ids), 64)):
            want[(r[0], k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()))] += 1
            start += n
    assert Counter(tuple(r)[:5] for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 64
    assert len(by) <= 1.1 * sum(n for p in by.values() for _, n in p) / 64 + 1
    assert packing.pack_documents(empty, tokenizer_path(BYTE_MODEL)).collect() == []


def test_best_fit_closes_the_fullest():
    b = packing.BestFit(10, 2)
    assert [b.add(n) for n in (6, 7, 3, 4, 8, 9)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0)]
    assert b.add(5)[0] == 4 and b.add(2) == (2, 8)


def test_encoder_agrees_with_the_library():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(tokenizer_path(BYTE_MODEL)), packing.Encoder(tokenizer_path(BYTE_MODEL))

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.sampled_from(list("aAbz 's\n\t.,!09é 　中<|endoftext|>")), max_size=40))
    def same(text):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids

    same()
