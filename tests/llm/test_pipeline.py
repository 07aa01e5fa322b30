"""The pipeline's stages on a small table: columns, effects, and plain versions of the steps that SQL cannot express."""

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = cp.keep_good(spark, docs, SF)
    assert first.columns == docs.columns
    assert 0 < first.count() < docs.count()
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality_rules", "line_dedup", "minhash_dedup", "source_mixing", "best_fit_packing"]


def test_lines_and_copies_take_effect(spark):
    line = lambda k: " ".join(f"w{k}x{i}" for i in range(12))
    body = [line(k) for k in range(8)]
    rows = [(1, "\n".join(body), "en", "s", 1), (2, "\n".join([line(50), *body[:4], line(51)]), "en", "s", 1), (3, "\n".join(body[2:7]), "en", "s", 1), (4, " ".join(body) + " tail", "en", "s", 1), (5, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lines = {r.doc_id: r.text for r in cp.drop_lines(spark, docs, SF).collect()}
    assert lines == {1: rows[0][1], 2: "\n".join([line(50), line(51)]), 4: rows[3][1], 5: None}
    left = cp.drop_copies(spark, docs, SF)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 5]


def test_run_equals_its_stages_and_loses_nothing(spark, tmp_path):
    """A small corpus through run(): what each step must do is known beforehand, and packing holds every token of the mix."""
    import random
    import zlib
    from collections import Counter

    import numpy as np
    from tokenizers import Tokenizer

    from factloom.llm.queries import BYTE_MODEL, tokenizer_path

    rng = random.Random(12)
    words = ["the", "of", "and", "in", *[f"word{i}" for i in range(3000)]]
    line = lambda: " ".join(rng.choice(words) if rng.random() < 0.7 else "the" for _ in range(12))
    good = ["\n".join(line() for _ in range(7)) for _ in range(30)]
    shared = "\n".join(line() for _ in range(3))
    texts = [*good, good[0] + " end", good[1], "too short", None, "", shared + "\n" + good[2], good[3] + "\n" + shared]
    rows = [(i, t, "en", ("a", "b", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    packed = cp.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = cp.keep_good(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [*range(32), 35, 36]
    lines = cp.drop_lines(spark, kept, "")
    left = {r.doc_id: r.text for r in lines.collect()}
    # copies lose every line that stood before, and with none left they go
    assert 31 not in left and left[35] == shared and 36 not in left
    one = cp.drop_copies(spark, lines, "")
    assert {r.doc_id for r in one.collect()} >= set(range(30)) and one.columns == docs.columns
    mixed = cp.mix(spark, one, "").collect()
    tok = Tokenizer.from_file(tokenizer_path(BYTE_MODEL))
    want = Counter()
    for r in mixed:
        ids = [*tok.encode(r.text, add_special_tokens=False).ids, 0]
        assert r.n_chars == len(r.text)
        start = 0
        first = len(ids) % 2048 if len(ids) > 2048 else len(ids)
        for k, n in enumerate([n for n in (first, *[2048] * ((len(ids) - first) // 2048)) if n]):
            want[(r.doc_id, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()))] += 1
            start += n
    assert Counter(tuple(r)[:5] for r in packed) == want
    ends = Counter()
    for r in packed:
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048
