"""What the corpus operators and the pipeline's stages do with colliding hashes, clashing names, ties, repeated rows, long texts and empty tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from factloom.llm import embedding_dedup, line_dedup, minhash_dedup, mixing, packing, quality_model, quality_rules, substring_dedup, token_counts, warc
from factloom.llm.queries import BYTE_MODEL, PRETOKEN_MODEL, tokenizer_path

SF = "/root/testdata/sf0.001"
#: Names that helper columns have or had.
CLASHES = "r1 r2 at lines words joined hashes sorted repeated counts quality passed d1 d2 nd p1 p2 np size parts times nth mark __d __k __n __m __at __w __l __id __mark __parts __e __c __kept hot n".split()


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]


@pytest.fixture(scope="module")
def colliding(spark):
    """Two texts of many words and lines that Spark's 32-bit hash takes for one."""
    text = F.concat(F.concat_ws("\n", *[F.concat_ws(" ", *[F.concat(F.lit(f"a{i}x{j}y"), F.col("id").cast("string")) for j in range(20)]) for i in range(4)]), F.when(F.col("id") % 2 == 0, "").otherwise(" tail words of odd ones"))
    table = spark.range(600_000).select(text.alias("text")).groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("t")).where("size(t) > 1 and (t[0] like '%tail%') <> (t[1] like '%tail%')")
    return table.first()["t"][:2]


@pytest.mark.parametrize("key", [None, 7])
def test_texts_whose_short_hashes_meet_are_told_apart(spark, colliding, key):
    a, b = colliding
    rows = [(key, a), (key, b), (1, a), (2, "\n".join(b.split("\n")[1:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(PRETOKEN_MODEL))
    want = Counter((i, len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids)) for i, t in rows)
    assert Counter(map(tuple, token_counts.token_counts(docs, tokenizer_path(PRETOKEN_MODEL)).collect())) == want
    at = Counter(tuple(words(t)[i : i + 35]) for _, t in rows for i in range(len(words(t)) - 34))
    kept = []
    for i, t in rows:
        w = words(t)
        gone = {j + k for j in range(len(w) - 34) if at[tuple(w[j : j + 35])] > 1 for k in range(35)}
        kept.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    assert Counter(tuple(r)[:4] for r in substring_dedup.remove_repeats(docs).collect()) == Counter(kept)
    near = minhash_dedup.near_duplicates(docs, k=2).collect()
    shingles = lambda t: len(set(zip(words(t), words(t)[1:])))
    assert Counter((r.doc_id, r.n_shingles) for r in near) == Counter((i, shingles(t)) for i, t in rows)
    if key is None:
        assert all(r.component_id == 1 for r in near if r.doc_id == 1)
    done = {(r.doc_id, r.text): (r.lines.n_lines, r.lines.n_removed) for r in line_dedup.dedup_lines(docs).collect()}
    # the least place keeps its lines: of id 1 or 2 where ids are null or greater
    assert done == {(key, a): (4, 4), (key, b): (4, 3), (1, a): (4, 0), (2, rows[3][1]): (3, 0)}


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(5)
    vocabulary = ["the", "of", "and", *[f"w{i}" for i in range(400)]]
    texts = ["\n".join(" ".join(rng.choice(vocabulary) for _ in range(20)) for _ in range(6)) for _ in range(20)]
    texts += [texts[0], texts[1] + "\nmore", None, "", texts[2]]
    rows = [(i, t, "s", len(t or "")) for i, t in enumerate(texts)] + [(2, texts[2], "s", 1), (None, texts[3], None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    return docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string"), F.lit("/"), F.col("n_chars").cast("string")).alias(c) for c in CLASHES])


def test_clashing_names_stay_as_they_are(spark, clashing):
    at = clashing.columns.index("r1")
    want = {tuple(r)[at:] for r in clashing.collect()}

    def held(df, names=clashing.columns):
        assert df.columns == names
        got = df.collect()
        assert got and {tuple(r[c] for c in CLASHES) for r in got} <= want
        return got

    for stage in (cp.keep_good, cp.drop_lines, cp.drop_copies, cp.mix):
        held(stage(spark, clashing, SF))
    assert quality_rules.quality_rules(clashing, into="verdict").columns == [*clashing.columns, "verdict"]
    replaced = quality_rules.quality_rules(clashing, into="quality")
    assert sorted(replaced.columns) == sorted(clashing.columns) and "base_failed" in replaced.select("quality.*").columns
    assert "n_removed" in line_dedup.dedup_lines(clashing).select("lines.*").columns
    n = clashing.count()
    assert substring_dedup.remove_repeats(clashing).count() == n
    assert token_counts.token_counts(clashing, tokenizer_path(PRETOKEN_MODEL)).count() == n
    assert mixing.mix_documents(clashing).count() == n
    assert minhash_dedup.near_duplicates(clashing).count() == n
    labels = clashing.select(F.col("doc_id"), F.lit(1).alias("quality_label"), F.lit(0).alias("x"), F.lit("k").alias("y")).withColumnRenamed("quality_label", "quality")
    assert quality_model.quality_scores(clashing, labels).count() == n
    assert packing.pack_documents(clashing, tokenizer_path(BYTE_MODEL)).select("doc_id").distinct().count() == clashing.select("doc_id").distinct().count()
    pages = clashing.select(F.col("doc_id").alias("page_id"), F.lit("http://u").alias("url"), F.col("text").alias("html"), *[F.lit(1).alias(c) for c in ("digest", "len", "first", "records", "file", "value")])
    assert warc.archived_pages(pages).count() == n
    vectors = clashing.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.col("n_chars").cast("double")).alias("embedding"), *[F.lit(1).alias(c) for c in ("k1", "k2", "node", "weight", "cell", "home", "good")])
    assert embedding_dedup.near_vectors(vectors).count() == n


def test_rows_that_tie_go_the_same_way_again(spark, clashing):
    tied = clashing.select("doc_id", "text", "source", "n_chars").crossJoin(spark.createDataFrame([("de",), ("en",), ("fr",)], "lang string"))
    for stage in (cp.drop_copies, cp.mix):
        once, again = (Counter(tuple(r) for r in stage(spark, tied.repartition(n, F.col("lang")), SF).collect()) for n in (2, 5))
        assert once == again


def test_repeated_rows(spark):
    base = [(i, f"the tree {i} of houses " * 5) for i in range(12)]
    docs, labels = spark.createDataFrame([*base, *base], "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    got = quality_model.quality_scores(docs, labels).collect()
    assert len(got) == 24 and len({(r.doc_id, r.score) for r in got}) == 12
    lines = line_dedup.dedup_lines(spark.createDataFrame([(1, "a\nb\nc")] * 2 + [(2, "a\nb\nc")], "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.lines.n_removed) for r in lines) == Counter({(1, 0): 2, (2, 3): 1})
    big = "x" * 1200
    pages = spark.createDataFrame([(1, "http://a", big)] * 2 + [(3, "http://b", big), (3, "http://c", big), (2, "http://d", "y")], "page_id long, url string, html string")
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.archived_pages(pages).collect())
    # rows of the greatest page_id are all responses
    assert got == Counter({(1, "revisit", 3): 2, (3, "response", None): 2, (2, "response", None): 1})
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01])], "vec_id long, embedding array<double>")
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_vectors(vectors).collect()) == Counter({(1, 2, 1): 2, (2, 2, 1): 1})


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=(4, 9, 300)[i % 3 if i < 298 else 2])[: 4 if i % 3 == 0 else 9 if i % 3 == 1 else 30].tolist()) for i in range(300)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell_rows=10, block=16).collect()}
    unit = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    links = np.array([[i != j and len(a) == len(b) and a @ b >= 0.9 for j, b in enumerate(unit)] for i, a in enumerate(unit)])
    assert [got[i][0] for i in range(300)] == links.sum(1).tolist()


def test_long_texts_are_read_whole(spark):
    rng = random.Random(8)
    long = " ".join(f"u{rng.randrange(10**6)}" for _ in range(700_000))
    assert len(long) > 5 << 20
    passage = " ".join(words(long)[-60:])
    rows = [(1, long), (2, f"head {passage} foot"), (3, long + " end"), (4, "line\n" * 3 + long)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == {1: 700_000, 2: 60, 3: 700_000, 4: 700_000}
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(docs).collect()}
    assert near[2] == (58, 2) and near[3][1] == 1 and near[4][1] == 1
    assert {r.doc_id: r.lines.n_lines for r in line_dedup.dedup_lines(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(PRETOKEN_MODEL))
    short = spark.createDataFrame([(1, long[: 1 << 22] + "é"), (2, None)], "doc_id long, text string")
    n = len(tok.encode(long[: 1 << 22] + "é", add_special_tokens=False).ids)
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(short, tokenizer_path(PRETOKEN_MODEL)).collect()} == {1: n, 2: 0}
    assert {r.doc_id: r.size for r in mixing.mix_documents(docs).collect()} == {i: len(words(t)) for i, t in rows}
    assert {r.doc_id: r.quality.n_words for r in quality_rules.quality_rules(docs).collect()} == {i: len(words(t)) for i, t in rows}
    pages = spark.createDataFrame([(1, "http://a", long), (2, "http://b", long), (3, "http://c", "z" * (17 << 20))], "page_id long, url string, html string")
    found = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived_pages(pages).collect()}
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert found == {1: (len(long), sha(long), "revisit", 2), 2: (len(long), sha(long), "response", None), 3: (17 << 20, sha("z" * (17 << 20)), "response", None)}
    pieces = packing.pack_documents(short, tokenizer_path(BYTE_MODEL)).where("doc_id = 1").agg(F.sum("length"), F.max("length")).first()
    whole = Tokenizer.from_file(tokenizer_path(BYTE_MODEL)).encode(long[: 1 << 22] + "é", add_special_tokens=False).ids
    assert tuple(pieces) == (len(whole) + 1, 2048)
    assert quality_model.quality_scores(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 4


def test_archive_files_are_bounded_and_hold_a_member_a_record(spark, tmp_path):
    import glob
    import gzip
    import zlib

    rng = random.Random(1)
    rows = [(i, f"http://h/{i}", "".join(rng.choice("abcdef") for _ in range(5000))) for i in range(40)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), f"file://{tmp_path}/w", file_bytes=40_000)
    files = glob.glob(f"{tmp_path}/w/*/*.txt")
    assert len(files) > 4
    members = 0
    for f in files:
        raw = open(f, "rb").read()
        assert len(gzip.decompress(raw)) <= 40_000
        while raw:
            one = zlib.decompressobj(31)
            assert one.decompress(raw).startswith(b"WARC/1.1\r\n")
            raw, members = one.unused_data, members + 1
    assert members == 120


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).collect() == []
    assert line_dedup.dedup_lines(docs).collect() == []
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def water_filled(sizes: dict, weights=(5, 2, 1)) -> dict:
    """Targets by raising the level step by step: shares by weight, capped sources at their cap, the rest shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5000, "c": 900}, {"a": 10, "b": 20, "c": 3000, "d": 7, None: 400}, {None: 50}, {"z": 1, "y": 1, "x": 10_000, "w": 0}])
def test_targets_against_water_filling(spark, sizes):
    docs = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
    got = mixing.mix_documents(docs).collect()
    want = water_filled(sizes)
    by = {list(sizes)[r.doc_id]: r for r in got}
    for s, n in sizes.items():
        assert by[s].target == pytest.approx(want[s]) and by[s].source_size == n and abs(by[s].taken - want[s]) <= 1


def test_both_ways_of_looking_up_repeated_windows_agree(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcde") for _ in range(n)) for n in (3, 10, 60, 200)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    h = quality_rules.window_hashes(quality_rules.words_of(F.col("text")))
    forms = [quality_rules.covered(F.col("h"), quality_rules.twice(F.sort_array("h")), few).alias(f"n{few}") for few in (0, 10_000)]
    for r in df.withColumn("h", h).select("text", *forms).collect():
        w = words(r.text)
        tri = Counter(zip(w, w[1:], w[2:]))
        assert r.n0 == r.n10000 == len({i + k for i, t in enumerate(zip(w, w[1:], w[2:])) if tri[t] > 1 for k in range(3)})


def test_verdicts_follow_the_threshold_table(spark):
    body = [f"the cat{i} of house{i} and dog{i} is mouse{i} to that{i} was w{i} v{i} u{i}" for i in range(8)]
    rows = [(1, "\n".join(body)), (2, "\n".join(body).replace(" w", " #$#$#$# ").replace(" v", " %%%%%%%%%%%%%%%%%%%%%%%%%%%% ")), (3, " ".join(f"q{i}" for i in range(80))), (4, "\n".join(f"{x}!!!!!!!!!!!!!!!!!!!" for x in body))]
    got = {r.doc_id: r.quality for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].kept for i in (1, 2, 3, 4)] == [True, False, False, False] and not any(got[i].base_failed for i in (1, 2, 3, 4))
    assert got[2].n_symbols == sum(rows[1][1].count(c) for c in "#*$%&|<>")


def test_a_tokenizer_that_cannot_be_cut_counts_whole_texts(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path(BYTE_MODEL)
    assert token_counts.split_rules(path) is None and token_counts.split_rules(tokenizer_path(PRETOKEN_MODEL)) is not None
    assert packing.byte_ranks(tokenizer_path(PRETOKEN_MODEL)) is None
    tok, texts = Tokenizer.from_file(path), ["Some Words  here", "x", None, "Some Words  here"]
    got = token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    word = Tokenizer.from_file(tokenizer_path(PRETOKEN_MODEL))
    packed = packing.pack_documents(spark.createDataFrame([(1, "Some words here")], "doc_id long, text string"), tokenizer_path(PRETOKEN_MODEL)).first()
    assert packed.length == len(word.encode("Some words here", add_special_tokens=False).ids) + 1


def test_many_alike_but_unlinked_documents(spark):
    rng = random.Random(3)
    core = [f"c{i}" for i in range(300)]
    rows = [(i, " ".join([*core, *(f"p{i}x{k}" for k in range(92))])) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " tail") for i in range(5)]
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()}
    assert got == {i: i % 1000 for i, _ in rows}
