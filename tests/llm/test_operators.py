"""Each operator's query against brute force on a small fixture, and the methods' own properties."""

import collections
import hashlib
import math
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from lamina.llm import bagminhash, bitsliced, bpe_lexicon, common, deepshallow, mixing, pseudo_lm, quality_qda, quality_rules, queries, suffix_dedup, warc
from lamina.llm import textarray as ta

Q = queries.queries()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r for r in common.table(spark, sf_dir, "documents").collect()}


def words(text):
    return [w for w in (text or "").replace("\v", " ").replace("\f", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]


def oracle(sf_dir, sql):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con.execute(sql).fetchall()


# 1


def test_mixing_targets_and_sums(spark, sf_dir, docs):
    got = {r.doc_id: r for r in Q["op1_mixing"](spark, sf_dir).collect()}
    sizes = collections.Counter()
    for d in docs.values():
        sizes[d.source] += len(words(d.text))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    target, free, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s], left = 2 * sizes[s], left - 2 * sizes[s]
        free -= over
    target |= {s: weight[s] * level for s in free}
    taken = collections.Counter()
    for i, r in got.items():
        s = docs[i].source
        assert r.size == len(words(docs[i].text)) and r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and r.taken <= 2 * r.size
        taken[s] += r.taken
    longest = {s: max(len(words(d.text)) for d in docs.values() if d.source == s) for s in sizes}
    assert len(got) == len(docs) and all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1 for s in sizes)


def test_pivotal_rounding_keeps_expectations():
    rng = np.random.default_rng(0)
    sizes, shares = rng.integers(1, 50, 40), np.full(40, 0.3)
    sums, means = [], np.zeros(40)
    for t in range(400):
        out = mixing.settle(rng.integers(-(1 << 62), 1 << 62, 40), sizes, shares, True)
        assert set(out) <= {0.0, 1.0}
        sums.append((out * sizes).sum())
        means += out / 400
    assert abs(np.array(sums) - 0.3 * sizes.sum()).max() <= 50 and abs(means - 0.3).max() < 0.12


# 2


def shingle_counts(text):
    w = words(text)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def near_classes(docs):
    counts = {i: shingle_counts(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = collections.defaultdict(set)
    for i, c in counts.items():
        for s in c:
            where[s].add(i)
    for a, b in {(a, b) for v in where.values() for a in v for b in v if a < b}:
        least = sum(min(n, counts[b][s]) for s, n in counts[a].items())
        if 5 * least >= 4 * (sum(counts[a].values()) + sum(counts[b].values()) - least):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in docs}


def test_near_duplicates(spark, sf_dir, docs):
    assert {r.doc_id: r.class_id for r in Q["op2_bagminhash"](spark, sf_dir).collect()} == near_classes({i: d.text for i, d in docs.items()})


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]
    base = list(rng.choice(vocabulary, 150))
    texts = {}
    for i in range(160):
        w = list(base)
        for _ in range(int(rng.integers(0, 8))):
            w[int(rng.integers(150))] = str(rng.choice(vocabulary))
        texts[i] = " ".join(w)
    texts |= {200 + i: " ".join(rng.choice(vocabulary, 90)) for i in range(20)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in bagminhash.assign(frame).collect()} == near_classes(texts)


def test_signatures_are_unbiased():
    rng, off = np.random.default_rng(0), []
    for trial in range(40):
        a = rng.poisson(2, 50)
        b = np.where(rng.random(50) < 0.5, a, rng.poisson(2, 50))
        h = ta.mix(np.arange(50, dtype=np.uint64) + np.uint64(trial * 1000))
        m = bagminhash.signatures(np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()]), np.concatenate([h[a > 0], h[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 400)
        off.append((m[0] == m[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.04


# 3


def test_quality_statistics(spark, sf_dir, docs):
    for r in Q["op3_quality_rules"](spark, sf_dir).collect():
        text = docs[r.doc_id].text or ""
        w = words(text)
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))


@pytest.mark.parametrize(("n", "k", "p"), [(10, 0, 0.1), (200, 3, 0.05), (5000, 40, 0.0125), (7, 7, 0.2), (1, 0, 0.5)])
def test_binomial_tail(spark, n, k, p):
    from pyspark.sql import functions as F

    got = spark.range(1).select(quality_rules.log_binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), F.lit(p)).alias("v")).first().v
    want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log(1 - p)) for j in range(k + 1))
    assert got == pytest.approx(math.log(want), abs=1e-6) if k < n * p else got == 0


def test_cutoffs_hold_their_risk(spark):
    """Good documents with a few symbols, bad ones with many: the strictest cutoff that passes rejects few of the good."""
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(1500):
        good = i % 5 > 0
        w = [f"w{int(x)}" for x in rng.integers(0, 10_000, 40)]
        w = [x + ("*" if rng.random() < (0.05 if good else 0.8) else "") for x in w]
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, int(good), 0))
    frame, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality_rules.verdicts(frame, marks).collect() if r.kept}
    good, bad = {i for i, q, _ in labels if q}, {i for i, q, _ in labels if not q}
    assert len(good - kept) <= 0.05 * len(good) and len(bad - kept) >= 0.95 * len(bad)
    few = marks.filter("doc_id < 60")
    assert {r.doc_id for r in quality_rules.verdicts(frame, few).collect() if not r.kept} == set()


# 4


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in common.table(spark, folder, "labels").collect()}
    scored = [r for r in Q["op4_quality_classifier"](spark, folder).collect() if r.held_out and r.doc_id in labels]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in scored)
    assert np.mean([r.predicted == labels[r.doc_id] for r in scored]) >= 0.95


def test_discriminant_of_two_gaussians():
    rng, d = np.random.default_rng(1), len(quality_qda.FEATURES)
    x = {0: rng.normal(0, 3, (4000, d)), 1: rng.normal(0, 1, (4000, d))}
    sums = {c: np.column_stack([np.ones(len(v)), v]).T @ np.column_stack([np.ones(len(v)), v]) for c, v in x.items()}
    model = quality_qda.fit(sums)
    right = [(model.scores(v) >= 0.5) == bool(c) for c, v in x.items()]
    assert np.mean(right) > 0.99 and quality_qda.fit({1: sums[1]}).scores(x[0][:3]).tolist() == [1.0, 1.0, 1.0]


# 5


def removed_by_force(texts, length=100):
    seen, out = set(), {}
    for i in sorted(texts):
        data = texts[i].encode()
        mark = bytearray(len(data))
        for at in range(len(data) - length + 1):
            window = data[at : at + length]
            if window in seen:
                mark[at : at + length] = b"\1" * length
            seen.add(window)
        out[i] = (len(data), sum(mark), sum(m and not (at and mark[at - 1]) for at, m in enumerate(mark)), hashlib.sha256(bytes(c for c, m in zip(data, mark, strict=True) if not m)).hexdigest())
    return out


def test_suffix_dedup(spark, sf_dir, docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in Q["op5_suffix_dedup"](spark, sf_dir).collect()}
    assert got == removed_by_force({i: d.text or "" for i, d in docs.items()})


@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_of_repetitive_bytes(spark, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    pool = ["".join(rng.choice(list("ab"), int(rng.integers(1, 200)))) for _ in range(6)] + ["a" * 300, "xyz" * 80, "é" * 60]
    texts = {i: "".join(pool[j] for j in rng.integers(0, len(pool), int(rng.integers(0, 9)))) for i in range(40)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(frame).collect()}
    assert got == removed_by_force(texts)


def test_deep_shallow_sorting():
    rng = np.random.default_rng(1)
    for _ in range(60):
        base = bytes(rng.integers(97, 100, 400).astype(np.uint8))
        strings, groups = [], []
        for _ in range(int(rng.integers(1, 80))):
            g = int(rng.integers(0, 3))
            length, at = [5, 40, 100][g], int(rng.integers(0, 6)) * 7
            s = bytearray(base[at : at + length])
            s[int(rng.integers(0, length))] = int(rng.choice([97, 98, 99, 0]))
            strings.append(bytes(s))
            groups.append(g)
        lengths = np.array(list(map(len, strings)))
        order, equal = deepshallow.sort_groups(np.frombuffer(b"".join(strings) + bytes(8), np.uint8), np.cumsum(lengths) - lengths, lengths, np.array(groups))
        got = [(groups[i], strings[i]) for i in order]
        assert got == sorted(zip(groups, strings, strict=True)) and all(equal[i] == (i > 0 and got[i] == got[i - 1]) for i in range(len(got)))


# 6


def test_top_k(spark, sf_dir):
    got = sorted(tuple(r) for r in Q["op6_bitsliced_top5"](spark, sf_dir).select("query_id", "rank", "vec_id", "score").collect())
    assert got == sorted(oracle(sf_dir, queries.OP6_SQL))


@pytest.mark.parametrize("shift", [0, 2, 5])
def test_bit_sliced_scores_and_selection(shift):
    rng = np.random.default_rng(shift)
    x = rng.integers(-256, 256, (700, 9))
    index = bitsliced.Slices(x, shift)
    for q in rng.integers(-256, 256, (5, 9)):
        exact = x @ q
        rows, scores = index.top(q, 10, shift)
        kth = np.sort(exact)[-10]
        assert sorted(rows) == sorted(np.flatnonzero(exact >= kth)) and (scores == exact[rows]).all()
    if not shift:
        slices, constant = index.scores(q, 0)
        total = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:700].astype(int) << j for j, s in enumerate(slices))
        width = len(slices)
        assert ((total + constant - exact) % (1 << width) == 0).all() or (total + constant == exact).all()


# 7


def test_network_beats_word_frequencies():
    rng = np.random.default_rng(0)
    follow = rng.permutation(200)
    ids = [int(rng.integers(200))]
    for _ in range(60_000):
        ids.append(int(follow[ids[-1]]) if rng.random() < 0.9 else int(rng.integers(200)))
    padded, at, _ = pseudo_lm._padded([np.array(ids, np.uint16).tobytes()])
    counts = np.bincount(ids, minlength=pseudo_lm.WORDS).astype(float)
    net, squares = pseudo_lm.Network.start(counts), pseudo_lm.Network(np.zeros(pseudo_lm.Network.size(), np.float32))
    before = net.log_probabilities(padded, at[50_000:]).mean()
    for _ in range(2):
        for first in range(0, 50_000, 1024):
            net.step(squares, padded, at[first : first + 1024], 0.15)
    assert net.log_probabilities(padded, at[50_000:]).mean() > before + 1.5
    mass = np.exp(net.log_probabilities(np.array([pseudo_lm.WORDS] * 2 + [0] + [pseudo_lm.WORDS] * 2, np.uint16), np.array([2])))
    total = 0.0
    for word in range(pseudo_lm.WORDS):
        total += float(np.exp(net.log_probabilities(np.array([5, 6, word, 7, 8], np.uint16), np.array([2])))[0])
    assert total == pytest.approx(1, abs=1e-3) and 0 < mass[0] < 1


def test_gradient():
    rng = np.random.default_rng(3)
    net = pseudo_lm.Network.start(rng.random(pseudo_lm.WORDS))
    padded, at = rng.integers(0, pseudo_lm.WORDS, 40).astype(np.uint16), np.arange(2, 38)
    squares = pseudo_lm.Network(np.zeros(net.size(), np.float32))
    flat = net.flat.copy()
    loss = lambda f: -pseudo_lm.Network(f).log_probabilities(padded, at).mean()
    pseudo_lm.Network(flat.copy()).step(squares, padded, at, 0.0)
    for place in rng.choice(np.flatnonzero(squares.flat > 1e-7), 12):
        up, down = flat.copy(), flat.copy()
        up[place] += 0.02
        down[place] -= 0.02
        assert abs((loss(up) - loss(down)) / 0.04) == pytest.approx(math.sqrt(squares.flat[place]), rel=0.1, abs=2e-4)


@pytest.fixture(scope="module")
def language_model(spark, sf_dir):
    frame = common.table(spark, "/root/testdata/sf0.01", "documents")
    counts = common.stage(pseudo_lm.count_words(frame), "counts")
    vocabulary = pseudo_lm.build_vocabulary(counts)
    return frame, counts, vocabulary, pseudo_lm.train(common.stage(pseudo_lm.token_ids(frame, vocabulary), "tokens"), vocabulary)


def scores(docs, counts, vocabulary, net):
    tokens = common.stage(pseudo_lm.token_ids(docs, vocabulary), "tokens")
    return {r.doc_id: r.pseudo_log_likelihood for r in pseudo_lm.score(tokens, net, vocabulary, pseudo_lm.rare_logs(tokens, counts, 3)).collect()}


def test_scores_prefer_the_corpus_to_shuffled_words(spark, language_model):
    frame, *model = language_model
    rng = np.random.default_rng(0)
    rows = [(r.doc_id, r.text) for r in frame.collect() if len(words(r.text)) >= 50]
    mixed = spark.createDataFrame([(i, " ".join(rng.permutation(words(t)))) for i, t in rows], "doc_id long, text string")
    plain, other = scores(spark.createDataFrame(rows, "doc_id long, text string"), *model), scores(mixed, *model)
    assert len(plain) > 100 and np.mean([plain[i] > other[i] for i in plain]) > 0.9


def test_scores_by_brute_force(language_model):
    """Each word's log probability from the trained parameters by plain loops in double precision, times its share of its id."""
    frame, counts, vocabulary, net = language_model
    rows = {r.doc_id: r.text for r in frame.filter("doc_id < 40").collect()}
    got = scores(frame.filter("doc_id < 40"), counts, vocabulary, net)
    n = {r.word: r.n for r in counts.collect()}

    def parts(text):
        data = np.frombuffer(text.encode(), np.uint8)
        hashes, _ = pseudo_lm._word_hashes(data, np.array([0, len(data)]))
        return hashes.tolist(), vocabulary(hashes)[0].tolist()

    def log_softmax(x, at):
        return x[at] - math.log(sum(math.exp(v) for v in x))

    assert len(got) == len(rows) == 40
    for i, text in rows.items():
        hashes, ids = parts(text or "") if text else ([], [])
        hashes, ids = hashes[:300], ids[:300]
        if len(words(text)) > 300:
            continue
        padded, total = [net.words] * 2 + ids + [net.words] * 2, 0.0
        for k, (h, word) in enumerate(zip(hashes, ids, strict=True)):
            around = [padded[k + 2 + o] for o in (-2, -1, 1, 2)]
            hidden = [math.tanh(float(net.bias[d]) + sum(float(net.context[j][w][d]) for j, w in enumerate(around))) for d in range(pseudo_lm.WIDTH)]
            kind, member = word % net.classes, word // net.classes
            outputs = lambda weights, bias: (np.array(hidden) @ weights.astype(float) + bias.astype(float)).tolist()
            total += log_softmax(outputs(net.to_class, net.class_bias), kind) + log_softmax(outputs(net.to_member[kind], net.member_bias[kind]), member)
            if word >= vocabulary.size - pseudo_lm.rare_ids(vocabulary.size):
                total += math.log(n[h] / vocabulary.unigram[word])
        assert got[i] == pytest.approx(total, rel=1e-4, abs=1e-3)


# 8


def test_bpe(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in Q["op8_bpe_lexicon"](spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    for i, d in docs.items():
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_hard_texts_encode_as_in_the_library():
    from tokenizers import Tokenizer

    from lamina.llm import token_store

    texts = ["it's we'll 'S 's''s  a\n\n b\t\tc  \n x'tis ''s !'s  'd d'1' x 're'vex'  ", "ΣΑΣ İstanbul ǅ 123 aaaa aaaaaaa !!!!!! é 日本語 😀😀 don't", " 　 x​  ", "<|endoftext|>a <|startoftext|>", "\x1c\x1d a\x85b", "'", "x'", "é é'll", "½²Ⅷ٣", ""]
    rng = np.random.default_rng(0)
    texts += ["".join(rng.choice(list("ab'stremdl  \n\t.!1é日"), 60)) for _ in range(200)]
    word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoder = bpe_lexicon.WordEncoder(bpe_lexicon.Merges(public_tokenizers.path("word_bpe_49k.json")), None)
    byte = token_store.ByteLevelEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    for make, library in ((encoder, word), (byte, byte.library)):
        for part in (texts, texts[:3], texts[4:]):
            ids, bounds = make(part)
            for i, e in enumerate(library.encode_batch(part, add_special_tokens=False)):
                assert ids[bounds[i] : bounds[i + 1]].tolist() == e.ids, part[i]


def test_automaton_is_minimal_and_numbers_words(tmp_path):
    rng = np.random.default_rng(4)
    vocabulary = sorted({"".join(rng.choice(list("abc"), int(rng.integers(1, 8)))) for _ in range(300)})
    merges = bpe_lexicon.Merges(public_tokenizers.path("word_bpe_49k.json"))
    bpe_lexicon.save_lexicon(str(tmp_path / "lex"), vocabulary, merges)
    lexicon = bpe_lexicon.Lexicon(str(tmp_path / "lex"))
    tails = {frozenset(w[len(p) :] for w in vocabulary if w.startswith(p)) for word in vocabulary for p in (word[:i] for i in range(len(word) + 1))}
    assert len(lexicon.final) == len(tails)
    probe = [*vocabulary, "abcabcabcabc", "d", "zzz"]
    codes, starts = ta.code_points(probe)
    numbers = lexicon.numbers(codes, starts[:-1], starts[1:] - 1)
    assert numbers.tolist() == [vocabulary.index(w) if w in vocabulary else -1 for w in probe]


# 9


def test_warc(spark, sf_dir):
    got = sorted((tuple(r) for r in Q["op9_warc"](spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    assert got == sorted(oracle(sf_dir, queries.OP9_SQL), key=str)


def warc_record(i, payload):
    return warc.record_bytes(i, "u", payload, hashlib.sha1(payload).hexdigest(), None, False)


def gzip_member(data, level=0, extra=b"", name=b""):
    """A member with optional header fields."""
    flags = 4 * bool(extra) | 8 * bool(name)
    head = b"\x1f\x8b\x08" + bytes([flags]) + bytes(6) + (len(extra).to_bytes(2, "little") + extra if extra else b"") + (name + b"\0" if name else b"")
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    return head + packer.compress(data) + packer.flush() + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


@pytest.fixture(scope="module")
def hard_archive():
    """(page id, payload, offset) of each record, and the file: payloads that hold members, chains of members and whole archives, long headers, several records in a member."""
    rng = np.random.default_rng(0)
    inner = warc.member(warc_record(900, b"nested"))
    chain = b"".join(warc.member(warc_record(901 + i, rng.bytes(300)), 0) for i in range(12))
    archive = b"".join(warc.member(warc_record(950 + i, rng.bytes(30_000)), 0) for i in range(6))
    payloads = [bytes([31, 139, 8]) * 50, inner, chain, b"", rng.bytes(5000), archive, archive[:100_000], inner + b"\x1f\x8b\x08"]
    data, want, page = b"", [], 0
    for level in (0, 6):
        for p in payloads:
            want.append((page, p, len(data)))
            data += gzip_member(warc_record(page, p), level)
            page += 1
    for extra, name in ((rng.bytes(600), b""), (inner, b""), (rng.bytes(65_000), b"n" * 70_000), (chain[:3000], b"x" * 600)):
        want.append((page, b"long header", len(data)))
        data += gzip_member(warc_record(page, b"long header"), 6, extra, name)
        page += 1
    data += gzip_member(b"")
    several = [rng.bytes(n) for n in (0, 700, 300_000, 5)]
    want += [(page + i, p, len(data)) for i, p in enumerate(several)]
    data += gzip_member(b"".join(warc_record(page + i, p) for i, p in enumerate(several)), 1)
    want.append((77, b"last", len(data)))
    return want, data + gzip_member(warc_record(77, b"last"), 9)


@pytest.mark.parametrize("padding", [0, 1000])
def test_all_records_and_no_others_are_read_from_any_ranges(spark, tmp_path, hard_archive, padding):
    want, data = hard_archive
    (tmp_path / "a.warc.gz").write_bytes(data + bytes(padding))
    size = len(data) + padding
    for step in (len(data) // 9, 70_000, size):
        ranges = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", i, min(i + step, size)) for i in range(0, size, step)], "path string, first long, last long")
        got = sorted(((r.page_id, bytes(r.payload), r.offset) for r in warc.read(spark, ranges).collect()), key=lambda r: (r[2], r[0]))
        assert got == sorted(want, key=lambda r: (r[2], r[0]))


@pytest.mark.parametrize("step", [1, 13, 700])
def test_members_are_found_from_any_place(tmp_path, hard_archive, step):
    """Every member is the first one of the ranges that end just behind its start, and ranges without a start have none."""
    want, data = hard_archive
    (tmp_path / "a.warc.gz").write_bytes(data)
    source, starts = warc._Source(f"file://{tmp_path}/a.warc.gz"), sorted({o for _, _, o in want})
    starts.insert(starts.index(want[-1][2]) - 1, starts[-2] - len(gzip_member(b"")))
    starts = np.array(starts)
    near = np.unique(np.concatenate([np.clip(np.arange(s - 40, s + 60), 0, len(data) - 1) for s in starts] + [np.arange(0, 3000)]))
    for first in np.unique(near // step * step).tolist():
        inside = starts[(starts >= first) & (starts < first + step)]
        assert warc.first_member(source, first, min(first + step, len(data))) == (inside[0] if len(inside) else None)


@pytest.mark.parametrize("step", [1, 13, 700])
def test_stored_members_are_read_from_every_byte(spark, tmp_path, step):
    """Stored members whose payloads hold magic bytes, headers that end with the file, and whole members: every byte of the file is asked, and the records are the same for all ranges."""
    rng = np.random.default_rng(7)
    hostile = [b"\x1f\x8b\x08\x04" + bytes(6) + b"\xff\xff" + rng.bytes(500), b"\x1f\x8b\x08" * 40, warc.member(warc_record(9, b"in")) + b"\x1f\x8b\x08\x08" + bytes(6) + b"name", b"\x1f\x8b\x08\x04" + bytes(6) + b"\xff\xff", b"end\x1f\x8b\x08\x00"]
    data, starts = b"", []
    for i, (payload, level) in enumerate(zip([b"first", *hostile, b"last"], (6, 0, 0, 0, 0, 0, 6), strict=True)):
        starts.append(len(data))
        data += gzip_member(warc_record(i, payload), level)
    (tmp_path / "a.warc.gz").write_bytes(data)
    source, places = warc._Source(f"file://{tmp_path}/a.warc.gz"), np.array(starts)
    for first in range(0, len(data), step):
        inside = places[(places >= first) & (places < first + step)]
        assert warc.first_member(source, first, min(first + step, len(data))) == (inside[0] if len(inside) else None)
    wide = max(step, 100)
    ranges = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", i, min(i + wide, len(data))) for i in range(0, len(data), wide)], "path string, first long, last long")
    assert sorted((r.page_id, r.offset) for r in warc.read(spark, ranges.repartition(2)).collect()) == list(enumerate(starts))


def test_a_member_that_is_cut_off_raises(spark, tmp_path):
    data = gzip_member(warc_record(1, os.urandom(3000)))
    (tmp_path / "a.warc.gz").write_bytes(data[:-100])
    with pytest.raises(Exception, match="cut off"):
        warc.read(spark, spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", 0, len(data) - 100)], "path string, first long, last long")).collect()


@pytest.mark.parametrize("most", [0, 3])
def test_revisits_beyond_what_is_broadcast(spark, sf_dir, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", most)
    test_warc(spark, sf_dir)


# 10


def test_token_store(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, got = 0, Q["op10_token_store"](spark, sf_dir).orderBy("doc_id").collect()
    for r, i in zip(got, sorted(docs), strict=True):
        ids = [*library.encode(docs[i].text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


# pipeline


def test_pipeline(spark, sf_dir, docs):
    labels = common.table(spark, sf_dir, "labels")
    stages = dict(corpus_pipeline.STAGES)
    frame = common.table(spark, sf_dir, "documents")
    kept = common.stage(stages["quality_rules"](spark, frame, sf_dir), "t")
    judged = {r.doc_id: r.kept for r in quality_rules.verdicts(frame, labels).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, k in judged.items() if k}
    single = common.stage(stages["near_dedup"](spark, kept, sf_dir), "t")
    classes = near_classes({r.doc_id: r.text for r in kept.collect()})
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(classes.values()))
    cut = common.stage(stages["suffix_dedup"](spark, single, sf_dir), "t")
    before, after = {r.doc_id: r.text for r in single.collect()}, {r.doc_id: r.text for r in cut.collect()}
    forced = removed_by_force(before)
    assert before.keys() == after.keys() and all((after[i] == t) == (forced[i][1] == 0) and 0 <= len(after[i].encode()) - (forced[i][0] - forced[i][1]) <= 6 * forced[i][2] for i, t in before.items())
    mixed = common.stage(stages["mixing"](spark, cut, sf_dir), "t")
    assert {r.doc_id: r.text for r in mixed.collect()}.items() <= after.items() and mixed.columns == frame.columns
    final = stages["bpe"](spark, mixed, sf_dir)
    assert sorted((r.doc_id, r.n_tokens) for r in final.collect()) == sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, sf_dir).collect())
