"""All operators and stages over hard rows: nulls in any column, empty and long texts, ties, repeats, empty tables, extra columns of clashing names."""

import hashlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lamina.llm import bagminhash, bitsliced, bpe_lexicon, common, mixing, pseudo_lm, quality_qda, quality_rules, suffix_dedup, token_store, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, node long, part int, words string, `a b` string, _row int"
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def rows():
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdeéü"), int(rng.integers(1, 9)))) for _ in range(n))
    base = prose(300)
    texts = [None, "", "   \n\t", "one", "two words", base, base, base + " more", prose(60), "# $ % " * 40, "Le " * 200, "日本語 テキスト 😀 " * 30, prose(30_000), " x y", "a\x00b"]
    out = [(i, t, "en" if i % 3 else None, None if i % 4 == 0 else f"s{i % 3}", None if t is None else len(t), "x", i, 1, "w", "z", 9) for i, t in enumerate(texts)]
    out += [out[5], out[5], (None, base, None, None, 1, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None), (5, prose(20), "de", "s1", 3, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (5, 0, 0), (7, 1, 0), (9, 0, 1), (10, 0, None), (None, 1, 0), (11, None, 0), (999, 1, 0), (8, 1, 0), (12, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")


def count(frame):
    return len(frame.collect())


def test_mixing(hard, none):
    got = mixing.plan(hard).collect()
    assert len(got) == len(rows()) and all(r.taken <= 2 * r.size for r in got) and all(r.taken == 0 for r in got if r.size == 0)
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, mixing.plan(hard.repartition(7)).collect()))
    assert count(mixing.plan(none)) == 0 and count(mixing.mix(none)) == 0
    mixed = mixing.mix(hard)
    assert mixed.columns == hard.columns and count(mixed) == sum(r.copies for r in mixing.allocate(hard.select("source", mixing.word_count(F.col("text")).alias("size"), mixing._row_hash(hard, hard.columns).alias("h"))).collect())
    maps = hard.withColumn("m", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("n", F.array(F.struct(F.create_map(F.lit(1), F.lit("x")).alias("y"))))
    assert mixing.mix(maps).schema.simpleString() == maps.schema.simpleString() and count(mixing.mix(maps)) > 0


def test_mixing_of_a_row_that_is_a_third_of_the_table(spark):
    """Its copies are shared evenly, the target is met, and it does not matter how rows are dealt out."""
    rows = [(7, "the same words again", "a")] * 900 + [(100 + i, " ".join(["w"] * (i % 30 + 1)), "ab"[i % 2]) for i in range(1800)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [mixing.plan(frame.repartition(n)).collect() for n in (1, 13)]
    assert sorted(map(str, runs[0])) == sorted(map(str, runs[1])) and len(runs[0]) == len(rows)
    assert len({r.copies for r in runs[0] if r.doc_id == 7}) <= 2 and max(r.copies for r in runs[0] if r.doc_id == 7) - min(r.copies for r in runs[0] if r.doc_id == 7) <= 1
    for source in "ab":
        own = [r for r in runs[0] if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 16
    taken = mixing.mix(frame).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()
    assert all(abs(r.n - next(x.target for x in runs[0] if x.source == r.source)) <= 16 for r in taken)


def test_near_duplicates(hard, none):
    got = bagminhash.assign(hard).collect()
    assert len(got) == len(rows()) and count(bagminhash.assign(none)) == 0 and count(bagminhash.deduplicate(none)) == 0
    classes = {r.class_id for r in got if r.doc_id in (5, 6, 7)}
    assert 5 in classes and all(r.class_id == r.doc_id for r in got if r.doc_id in (0, 1, 2, 3, 4))
    kept = bagminhash.deduplicate(hard)
    assert kept.columns == hard.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(6) == 0 and ids.count(7) == 0 and sorted(i for i in ids if i in (0, 1, 2, 3, 4)) == [0, 1, 2, 3, 4]


def test_quality_rules(hard, none, labels, spark):
    got = quality_rules.verdicts(hard, labels).collect()
    assert len(got) == len(rows()) and all(not r.kept for r in got if r.base_failed) and all(r.base_failed for r in got if r.n_words < 20)
    assert all(r.kept is not None and r.n_repeat_words is not None for r in got)
    assert count(quality_rules.verdicts(none, labels)) == 0 and count(quality_rules.verdicts(hard, labels.limit(0))) == len(rows())
    kept = quality_rules.keep(hard, labels)
    assert kept.columns == hard.columns and count(kept) == sum(r.kept for r in got) and count(quality_rules.keep(none, labels)) == 0


def test_classifier(hard, none, labels):
    got = quality_qda.classify(hard, labels).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out is not None for r in got)
    assert count(quality_qda.classify(none, labels)) == 0 and {r.score for r in quality_qda.classify(hard, labels.limit(0)).collect()} == {0.5}


def test_suffix_dedup(hard, none):
    got = suffix_dedup.digests(hard).collect()
    assert len(got) == len(rows()) and count(suffix_dedup.digests(none)) == 0
    by_id = {r.doc_id: r for r in got if r.doc_id not in (None, 5)}
    assert by_id[0].n_bytes == 0 and by_id[0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    base = rows()[5][1]
    assert by_id[6].n_removed == len(base.encode()) and all(r.n_removed == 0 for r in got if r.doc_id == 5)
    cut = suffix_dedup.remove_repeats(hard)
    assert cut.columns == hard.columns and cut.schema == hard.schema
    texts = {r.doc_id: r for r in cut.collect() if r.doc_id not in (None, 5)}
    assert texts[0].text is None and texts[6].text == "" and texts[6].n_chars == 0 and texts[12].text == rows()[12][1]


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (0, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (None, [1.0, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [0.9, -0.1]), (50, [-1.0, 0.25]), (8, [])]
    v = bitsliced.quantised(spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("number", F.lit(2)))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in bitsliced.search(v, v.filter("vec_id % 50 = 0"), 5).collect()]
    assert [g for g in got if g[0] == 50] and {g[2] for g in got} <= {0, 1, 2, 7, 50}
    vectors = [(i, np.floor(256 * np.array(x)).astype(int)) for i, x in data if i in (0, 1, 2, 7, 50)]
    want = []
    for q, x in vectors:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in vectors if i != q)[:5]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted(got) == sorted(want)
    assert not bitsliced.search(v.limit(0), v.limit(0), 5).count()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_top_k_of_large_components_and_repeated_queries(spark, kind, monkeypatch):
    """Against whole numbers of any length; scores beyond 64 bits are the nearest such number."""
    rng = np.random.default_rng(1)
    exact = np.float32 if kind == "float" else np.float64
    values = rng.normal(0, 1, (60, 4)) * 10.0 ** rng.integers(-3, 12 if kind == "float" else 25, (60, 1))
    values[3] = [1e30, -1e30, 1.0, 0.5]
    values[4] = [-1e30, 1e30, 2.0, 0.25]
    values[5] = [3e38, 3e38, 0, 0]
    values[6:30] = rng.normal(0, 1, (24, 4))
    values = values.astype(exact)
    ids = [0, 0, 50, 50, 100, 1, 2, *range(150, 203)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, values, strict=True)], f"vec_id long, embedding array<{kind}>").repartition(3)
    v = bitsliced.quantised(frame)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in bitsliced.search(v, v.filter("vec_id % 50 = 0"), 5).collect())
    floors = [[(Fraction(float(x)) * 256).__floor__() for x in row] for row in values]
    want = []
    for i, x in zip(ids, floors, strict=True):
        if i % 50 == 0:
            best = sorted((-max(min(sum(a * b for a, b in zip(x, y, strict=True)), 2**63 - 1), -(2**63)), j) for j, y in zip(ids, floors, strict=True) if j != i)[:5]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)


def test_pseudo_likelihood(hard, none):
    got = pseudo_lm.score_documents(hard).collect()
    assert len(got) == len(rows()) and count(pseudo_lm.score_documents(none)) == 0
    assert all(np.isfinite(r.pseudo_log_likelihood) and r.pseudo_log_likelihood <= 0 for r in got)
    assert all((r.mean_log_likelihood is None) == (r.n_tokens == 0) for r in got)


def test_bpe(hard, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    got = bpe_lexicon.encode(hard, WORDS)
    assert [c for c in hard.columns if c != "text"] == got.columns[:-2] and count(bpe_lexicon.encode(none, WORDS)) == 0
    want = sorted((str(r[0]), library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows())
    assert sorted((str(r.doc_id), r.input_ids) for r in got.collect()) == want
    decoded = sorted((str(r.doc_id), r.decoded) for r in bpe_lexicon.decode(got, WORDS).collect())
    assert decoded == sorted((i, library.decode(ids, skip_special_tokens=False)) for i, ids in want)
    digests = {(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_lexicon.digests(hard, WORDS).collect()}
    assert digests == {(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()) for i, ids in want}


def test_warc(spark):
    long_ = "x" * 1000
    data = [(1, "u", long_), (2, "u\r\nEvil: 1", long_), (2, None, long_), (3, "v", "short"), (4, "v", "short"), (None, "w", long_), (5, None, None), (6, "z", ""), (7, "z", "é" * 600), (8, "z", "é" * 600), (9, "b", "\x1f\u008b\x08" * 500)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    for split in (97, 1 << 20):
        manifest = warc.write(pages.withColumn("path", F.lit("p")).withColumn("key", F.lit(1)), common.new_folder(spark, "warc"))
        got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, warc.splits(manifest, split)).collect()), key=str)
        want = []
        for i, _, html in data:
            body = (html or "").encode()
            top = max((j for j, _, h in data if h == html and j is not None), default=None)
            revisit = len(body) >= 1000 and top is not None and i != top
            want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
        assert got == sorted(want, key=str)
    payloads = {r.page_id: bytes(r.payload) for r in warc.read(spark, warc.splits(manifest)).collect() if r.payload is not None}
    assert payloads[9] == data[-1][2].encode() and payloads[5] == b""
    assert not warc.write(pages.limit(0), common.new_folder(spark, "warc")).count()


def test_token_store(spark, hard, none):
    import zlib

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    manifest = token_store.write(hard, common.new_folder(spark, "tokens"), BYTES, sequence=64)
    got = token_store.read_documents(manifest).orderBy("start", "n_tokens").collect()
    tie = {r.text: r.tie for r in hard.select("text", F.xxhash64("text").alias("tie")).collect()}
    order = lambda r: (-1 if r[0] is None else r[0], tie[r[1]], r[1] or "")
    encoded = [(r[0], [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in sorted(rows(), key=order)]
    start = 0
    for r, (i, ids) in zip(got, encoded, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    flat, at = [t for _, x in encoded for t in x], 0
    for m in manifest.orderBy("shard").collect():
        shard = token_store.Shard(m.tokens_path)
        for batch in range(shard.file.num_record_batches):
            ids, packed = shard.sequences(batch)
            assert not ids.flags.owndata and not packed.flags.owndata and packed.shape == (len(ids), 8)
            mask = shard.unpacked(packed)
            assert mask.dtype == bool and ids.shape == mask.shape
            real = ids[mask].tolist()
            assert real == flat[at : at + len(real)] and not ids[~mask].any()
            at += len(real)
    assert at == len(flat)
    assert not token_store.read_documents(token_store.write(none, common.new_folder(spark, "tokens"), BYTES)).count()


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_hard_rows(spark, hard, none, sf_dir, name, stage):
    """All columns go along, clashing names too; what each stage keeps of the hard rows is said here."""
    docs = common.stage(hard, "hard")
    out = common.stage(stage(spark, docs, sf_dir), "out")
    got, texts = out.collect(), {i: r[1] for i, r in enumerate(rows())}
    ids = [r.doc_id for r in got]
    assert count(stage(spark, none, sf_dir)) == 0
    if name == "bpe":
        assert out.columns == [c for c in docs.columns if c != "text"] + ["input_ids", "n_tokens"]
        assert len(got) == len(rows()) and all(r.n_tokens == len(r.input_ids) for r in got) and all(r.label in ("x", None) and r.node == (r.doc_id if r.label else None) for r in got)
        return
    assert out.schema.simpleString() == docs.schema.simpleString() and all(r["a b"] in ("z", None) and r._row in (9, None) for r in got)
    if name == "quality_rules":
        assert not {0, 1, 2, 3, 4, 9, 10, 13, 14} & set(ids) and {5, 6, 7, 8, 12} <= set(ids)
    elif name == "near_dedup":
        assert all(ids.count(i) == 1 for i in (0, 1, 2, 3, 4, 8, 12)) and not {6, 7} & set(ids)
    elif name == "suffix_dedup":
        assert len(got) == len(rows()) and [r.text for r in got if r.doc_id == 6] == [""] and [r.text for r in got if r.doc_id == 0] == [None]
        assert all(r.text == texts[r.doc_id] for r in got if r.doc_id in (1, 2, 3, 4, 8, 12))
    else:
        assert all(r.text is not None and r.text.strip() for r in got) and all(ids.count(i) <= 2 for i in range(15) if i != 5) and len(got) > 0
