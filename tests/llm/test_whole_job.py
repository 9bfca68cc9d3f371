"""Nothing of the corpus is left out: each test fails where a part of it plays no part."""

import collections
import math

import numpy as np
import pyarrow as pa
import pytest

from lamina.llm import common, pretokens, pseudo_lm, quality_rules, suffix_dedup
from lamina.llm import textarray as ta


def corpus(spark, rng):
    names = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(names, 40)) for _ in range(200)] + ["typo", "", None]
    return texts, spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_words_that_share_an_id_count_as_often_as_they_occur(spark, monkeypatch):
    """Scores differ from the network's own by each sharing word's log share of its id, by its own count."""
    monkeypatch.setattr(pseudo_lm, "OWN", 1 << 40)
    texts, docs = corpus(spark, np.random.default_rng(0))
    counts = common.stage(pseudo_lm.count_words(docs), "counts")
    vocabulary = pseudo_lm.build_vocabulary(counts)
    tokens = common.stage(pseudo_lm.token_ids(docs, vocabulary), "tokens")
    logs = {r.row: r.logs for r in pseudo_lm.rare_logs(tokens, counts, 3).collect()}
    n, total = collections.Counter(w for t in texts for w in (t or "").split()), collections.Counter()
    rows = {r.doc_id: r for r in tokens.collect()}
    ids = {i: np.frombuffer(r.ids, np.uint16) for i, r in rows.items()}
    of = {w: int(k) for i, t in enumerate(texts) for w, k in zip((t or "").split(), ids[i], strict=True)}
    shared = {w for w in n if of[w] >= vocabulary.size - pseudo_lm.rare_ids(vocabulary.size)}
    for w in shared:
        total[of[w]] += n[w]
    assert len(shared) > 1000 and all(vocabulary.unigram[k] == v and math.isclose(vocabulary.log_total[k], math.log(v)) for k, v in total.items())
    for i, t in enumerate(texts):
        assert logs.get(rows[i].row, 0.0) == pytest.approx(sum(math.log(n[w]) for w in (t or "").split() if w in shared))
    net = pseudo_lm.Network.start(vocabulary.unigram)
    got = {r.doc_id: r.pseudo_log_likelihood for r in pseudo_lm.score(tokens, net, vocabulary, pseudo_lm.rare_logs(tokens, counts, 3)).collect()}
    for i, t in enumerate(texts):
        padded, at, _ = pseudo_lm._padded([rows[i].ids], vocabulary.size)
        share = sum(math.log(n[w] / total[of[w]]) for w in (t or "").split() if w in shared)
        assert got[i] == pytest.approx(net.log_probabilities(padded, at).sum() + share, rel=1e-5, abs=1e-5)


def test_ids_grow_with_the_corpus(spark):
    few, many = (spark.range(k).selectExpr("id AS word", "60L AS n") for k in (100, 5000))
    assert pseudo_lm.build_vocabulary(few).size == pseudo_lm.WORDS < pseudo_lm.build_vocabulary(many).size


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_every_word_is_trained_on_once(rounds):
    """At any length, with its own neighbours; equal lengths do not hide the same words in the same round."""
    rng = np.random.default_rng(1)
    for n in [*range(40), 255, 256, 257, 1300]:
        docs = [rng.permutation(2000)[:n].astype(np.uint16).tobytes() for _ in range(8)]
        full, at, _ = pseudo_lm._padded(docs)
        windows = lambda padded, at: [tuple(padded[a - pseudo_lm.REACH : a + pseudo_lm.REACH + 1].tolist()) for a in at]
        got = [windows(*pseudo_lm._hidden(docs, number, rounds)) for number in range(rounds)]
        assert sorted(w for g in got for w in g) == sorted(windows(full, at))


def test_training_looks_at_all_words(spark):
    """Documents of one and of five words, which a choice by length and place left out."""
    for length in (1, 5):
        docs = spark.createDataFrame([(i, " ".join(["often"] * length)) for i in range(50)], "doc_id long, text string")
        counts = common.stage(pseudo_lm.count_words(docs), "counts")
        vocabulary = pseudo_lm.build_vocabulary(counts)
        net = pseudo_lm.train(common.stage(pseudo_lm.token_ids(docs, vocabulary), "tokens"), vocabulary)
        assert not np.array_equal(net.flat, pseudo_lm.Network.start(vocabulary.unigram).flat)


@pytest.mark.parametrize("most", [0, 1, 7, 50, 99, 100, 1000])
def test_most_frequent_is_exact(spark, most):
    """Also where the limit falls within words of about equal counts."""
    rng = np.random.default_rng(4)
    for top in (2, 30, 10_000):
        pairs = [(w, int(n)) for w, n in enumerate(rng.integers(1, top, 100))]
        got = common.most_frequent(spark.createDataFrame(pairs, "word long, n long"), most).collect()
        assert sorted((-r.n, r.word) for r in got) == sorted((-n, w) for w, n in pairs)[:most]


def test_a_stratum_with_few_labels_has_the_rules_it_can_prove(spark):
    """Good labels without a false rejection: 600 prove four rules, 311 two, 86 one, 85 none (four strata, alpha and delta 0.05)."""
    sizes = {"a": 600, "b": 311, "c": 86, "d": 85}
    text = "plain words of a good text that goes on and on without any symbol or shouting for quite a long while until it ends here"
    rows = [(i, lang, text) for i, lang in enumerate(lang for lang, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    stats = common.stage(quality_rules.with_statistics(docs), "statistics")
    labels = docs.selectExpr("doc_id", "1 AS quality")
    got = {r.stratum: set(r.cutoffs) for r in quality_rules.thresholds(stats, labels).collect()}
    names = list(quality_rules.GRIDS)
    assert got == {"a": set(names), "b": set(names[:2]), "c": set(names[:1])}


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_words_that_agree_in_their_hash_are_told_apart(n):
    """A Thue-Morse word and its complement collide in any polynomial hash modulo a power of two; alone, together and after other batches."""
    import public_tokenizers

    from lamina.llm import bpe_lexicon, token_store

    one = thue_morse(n)
    two = one.translate(str.maketrans("ab", "ba"))
    word, byte = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    for make, path in ((bpe_lexicon.WordEncoder(bpe_lexicon.Merges(word), None), word), (token_store.ByteLevelEncoder(byte), byte)):
        library = pretokens.library_tokenizer(path)
        for texts in ([f"{one} {two}"], [two], [one], ["other words"], [f"{two} {one} {two}", f"x {two}"], [f"x {one}"]):
            ids, bounds = make(texts)
            for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
                assert ids[bounds[i] : bounds[i + 1]].tolist() == e.ids


def test_distinct_spans_are_exact(monkeypatch):
    """With a hash that tells nothing apart, and one that tells most apart, against a dictionary."""
    rng = np.random.default_rng(2)
    symbols = rng.integers(97, 100, 5000).astype(np.uint32)
    first = rng.integers(0, 4900, 900)
    end = first + rng.choice([0, 1, 2, 3, 70, 100], 900)
    spelled = [symbols[a:b].tobytes() for a, b in zip(first, end, strict=True)]
    true = ta.span_hash
    for hashed in (true, lambda p, a, b: true(p, a, b) % np.uint64(7), lambda p, a, b: np.zeros(len(a), np.uint64)):
        monkeypatch.setattr(ta, "span_hash", hashed)
        at, inverse, _ = ta.distinct(symbols, first, end)
        assert len(at) == len(set(spelled)) and all(spelled[at[i]] == s for i, s in zip(inverse, spelled, strict=True))
        stored: list[str] = []
        numbers = pretokens.Distinct(stored.extend, stored.clear, most=200)
        text = "".join(map(chr, symbols.tolist()))
        for part in range(0, 900, 90):
            own = slice(part, part + 90)
            rows = numbers.rows(text, symbols, first[own], end[own])
            assert [stored[r] for r in rows] == [text[a:b] for a, b in zip(first[own], end[own], strict=True)]


def by_force(rows, length=100):
    """(id, text) to what is removed: ids in order, none last; rows of one id by SHA-256; equal rows are one document."""
    import hashlib

    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    out, seen = {}, set()
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, digest(r[1])[:30])):
        data = (t or "").encode()
        mark = bytearray(len(data))
        for at in range(len(data) - length + 1):
            if (window := data[at : at + length]) in seen:
                mark[at : at + length] = b"\1" * length
            seen.add(window)
        out[i, t] = (i, len(data), sum(mark), sum(m and not (at and mark[at - 1]) for at, m in enumerate(mark)), hashlib.sha256(bytes(c for c, m in zip(data, mark, strict=True) if not m)).hexdigest())
    return out


def removed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted(map(str, ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(docs).collect())))


def test_rows_without_an_id_or_of_one_id_are_documents_of_their_own(spark):
    """None loses a byte for another row's hash: the two texts without an id agree in the low 32 bits of xxhash64."""
    import xxhash

    rng = np.random.default_rng(0)
    prose = lambda: "".join(rng.choice(list("abcdefgh "), 257))
    seen, base = {}, prose()
    while True:
        text = f"{rng.integers(1 << 60):x}{prose()}"[:257]
        low = xxhash.xxh64_intdigest(text.encode(), 42) & 0xFFFFFFFF
        if low in seen:
            pair = [seen[low], text]
            break
        seen[low] = text
    last = (1 << 63) - 1
    rows = [(1, pair[0]), (None, pair[0]), (None, pair[1]), (5, prose()), (5, base), (5, prose() + base), (7, base), (last, pair[0]), (last, prose()), (None, None), (None, base + base), (None, base + base)]
    want = by_force(rows)
    assert removed(spark, rows) == sorted(str(want[r]) for r in rows)
    assert want[None, pair[1]][2] == 0 and want[None, pair[0]][2] == 257


@pytest.mark.parametrize("hot", [0, 3, 1 << 30])
def test_windows_of_frequent_grams_are_dealt_out_by_content(spark, hot, monkeypatch):
    """A line that stands in most documents, in neighbourhoods of all kinds, at every limit."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = np.random.default_rng(hot % 7)
    prose = lambda n: "".join(rng.choice(list("abcdefgh \né"), n))
    line, passage = prose(95), prose(300)
    rows = [(i, prose(int(rng.integers(0, 60))) + line + (passage if i % 4 == 0 else prose(50)) + line + line[: i % 30]) for i in range(40)] + [(50, "ab" * 300), (51, "ab" * 200)]
    assert removed(spark, rows) == sorted(map(str, by_force(rows).values()))


@pytest.mark.parametrize("n", [1024, 2048])
def test_texts_whose_words_agree_in_a_polynomial_hash_are_classes_of_their_own(spark, n):
    """Alone, within longer texts, and through the stage that drops documents; op7 counts the words apart."""
    from lamina.llm import bagminhash

    rng = np.random.default_rng(n)
    one = thue_morse(n)
    two = one.translate(str.maketrans("ab", "ba"))
    around = [f"w{rng.integers(1 << 40):x}" for _ in range(4)]
    texts = [one, two, "something else", " ".join([*around[:2], one, *around[2:]]), " ".join([*around[:2], two, *around[2:]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in bagminhash.assign(docs).collect()) == [(i, i) for i in range(5)]
    assert sorted(r.doc_id for r in bagminhash.deduplicate(docs).collect()) == list(range(5))
    assert pseudo_lm.count_words(docs.filter("doc_id < 2")).count() == 2


def test_overlaps_compare_words(monkeypatch):
    """Shingles have one number exactly if their words are equal, whatever hashes say."""
    from lamina.llm import bagminhash

    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["a", "b", "ab", "é", "c" * 70], int(n))) for n in (0, 1, 4, 5, 6, 300)]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    true = ta.span_hash
    for hashed in (true, lambda p, a, b: true(p, a, b) % np.uint64(3)):
        monkeypatch.setattr(ta, "span_hash", hashed)
        row, number, times = bagminhash.exact_shingles(data, offsets)
        want = [collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)) if w) for w in map(str.split, texts)]
        assert [sorted(times[row == i].tolist()) for i in range(len(texts))] == [sorted(c.values()) for c in want]
        assert len(set(number.tolist())) == len(set().union(*want))
        assert all(len(set(number[row == a].tolist()) & set(number[row == b].tolist())) == len(set(want[a]) & set(want[b])) for a in range(6) for b in range(6))


def test_texts_of_one_number_are_told_apart(spark, monkeypatch):
    """With a hash of texts that takes 7 values, classes are what they are with the true one."""
    from lamina.llm import bagminhash

    rng = np.random.default_rng(5)
    prose = lambda n: [f"w{rng.integers(500)}" for _ in range(n)]
    base = [prose(80) for _ in range(4)]
    texts = [" ".join(b) for b in base for _ in range(3)] + [" ".join([*b[:60], "other", *b[61:]]) for b in base] + [" ".join(prose(30)) for _ in range(10)] + ["", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want, kept = ({r.doc_id: r.asDict() for r in f(docs).collect()} for f in (bagminhash.assign, bagminhash.deduplicate))
    true = bagminhash.node_of
    monkeypatch.setattr(bagminhash, "node_of", lambda text: true(text) % 7)
    assert {r.doc_id: r.asDict() for r in bagminhash.assign(docs).collect()} == want
    assert {r.doc_id: r.asDict() for r in bagminhash.deduplicate(docs).collect()} == kept


def statistics_by_force(text):
    """The classifier's statistics of one text, character by character."""
    data = (text or "").encode()
    words = [w for w in data.translate(bytes.maketrans(b"\t\n\v\f\r", b"     ")).split(b" ") if w]
    n, lengths = len(words), [len(w) for w in words]
    mean = sum(lengths) / max(n, 1)
    spread = math.sqrt(max(sum(k * k for k in lengths) / max(n, 1) - mean * mean, 0))
    count = lambda kinds: sum(b in kinds for b in data)
    upper, smooth = count(range(65, 91)), n + 10
    letters = upper + count(range(97, 123)) + count(range(0xC0, 256))
    rate = lambda k: math.log1p(100 * k / smooth)
    twice = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        math.log1p(n), math.log1p(mean), math.log1p(spread), rate(count(b"#*$%&|<>")), math.log((upper + 0.5) / (letters + 10)), rate(count(b"0123456789")), rate(count(b"!")), rate(count(b".,;:?'\"()-")),
        math.log((len(set(words)) + 10) / smooth), rate(twice), rate(sum(k == 1 for k in lengths)), rate(data.count(b"\n")), math.log((sum(65 <= w[0] < 91 for w in words) + 1) / smooth),
    ]


def test_every_quality_score_by_a_plain_refit(spark):
    """All of sf0.01: statistics by loops, classes' covariances with numpy's own, log densities by solving and determinants instead of cached factors."""
    import zlib

    from lamina.llm import quality_qda, queries

    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in common.table(spark, folder, "documents").collect()}
    labels = {}
    for r in common.table(spark, folder, "labels").collect():
        labels.setdefault(r.doc_id, []).append(r.quality)
    labels = {i: min(v for v in q if v in (0, 1)) for i, q in labels.items() if any(v in (0, 1) for v in q)}
    rest = {i: zlib.crc32(str(i).encode()) % 3 for i in docs}
    x = {i: np.array(statistics_by_force(t)) for i, t in docs.items()}
    own = {c: np.array([x[i] for i in docs if rest[i] != 1 and labels.get(i) == c]) for c in (0, 1)}
    total = sum(map(len, own.values()))
    spread = {c: np.cov(v.T, bias=True) for c, v in own.items()}
    pooled = sum(len(own[c]) * spread[c] for c in own) / total
    scale = np.sqrt(np.diag(pooled))
    density = {}
    for c, v in own.items():
        cov = ((1 - quality_qda.TO_POOLED) * spread[c] + quality_qda.TO_POOLED * pooled) / np.outer(scale, scale)
        cov = (1 - quality_qda.TO_IDENTITY) * cov + quality_qda.TO_IDENTITY * np.trace(cov) / len(cov) * np.eye(len(cov))
        away = (np.array(list(x.values())) - v.mean(axis=0)) / scale
        density[c] = math.log(len(v) / total) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (away * np.linalg.solve(cov, away.T).T).sum(axis=1)
    want = dict(zip(x, 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700))), strict=True))
    got = queries.queries()["op4_quality_classifier"](spark, folder).collect()
    assert len(got) == len(docs) and all(r.held_out == (rest[r.doc_id] == 1) for r in got)
    assert max(abs(r.score - want[r.doc_id]) for r in got) < 1e-6
    assert all(r.predicted == int(r.score >= 0.5) for r in got)


def test_a_step_is_that_of_plain_sums():
    """Classes of no, few and very many words, and one whose outputs are too large for exponentials: one step moves all parameters as in doubles, each read before it moves."""
    rng = np.random.default_rng(11)
    net = pseudo_lm.Network.start(rng.random(pseudo_lm.WORDS))
    net.member_bias[3] += 200
    net.class_bias[5] -= 100
    kinds = np.concatenate([np.full(1500, 3), np.full(900, 4), rng.integers(8, net.classes - 2, 600)])
    ids = rng.permutation(kinds + net.classes * rng.integers(0, net.members, len(kinds))).astype(np.uint16)
    padded, at, _ = pseudo_lm._padded([ids[:1000].tobytes(), b"", ids[1000:].tobytes()])
    at = at[rng.random(len(at)) < 0.7]
    plain = {name: getattr(net, name).astype(float) for name in ("context", "bias", "to_class", "class_bias", "to_member", "member_bias")}
    slopes = {name: np.zeros(x.shape) for name, x in plain.items()}
    for a in at:
        around, (member, kind) = padded[[a + o for o in pseudo_lm._OFFSETS]], divmod(int(padded[a]), net.classes)
        h = np.tanh(plain["bias"] + sum(plain["context"][j][w] for j, w in enumerate(around)))
        dh = np.zeros(len(h))
        for weights, bias, which, dw, db in (
            (plain["to_class"], plain["class_bias"], kind, slopes["to_class"], slopes["class_bias"]),
            (plain["to_member"][kind], plain["member_bias"][kind], member, slopes["to_member"][kind], slopes["member_bias"][kind]),
        ):
            out = h @ weights + bias
            e = np.exp(out - out.max())
            e /= e.sum()
            e[which] -= 1
            e /= len(at)
            dw += np.outer(h, e)
            db += e
            dh += weights @ e
        dz = dh * (1 - h * h)
        slopes["bias"] += dz
        for j, w in enumerate(around):
            slopes["context"][j][w] += dz
    squares = pseudo_lm.Network(np.zeros(net.size(), np.float32))
    net.step(squares, padded, at, 0.15)
    for name, slope in slopes.items():
        # Adagrad's first step is the slope over its size
        want = plain[name] - 0.15 * slope / np.sqrt(slope * slope + 1e-10)
        assert np.allclose(np.sqrt(getattr(squares, name)), abs(slope), rtol=1e-3, atol=1e-7), name
        assert np.allclose(getattr(net, name), want, rtol=1e-4, atol=2e-3), name
    assert all(net.tables[w].flags.c_contiguous and np.array_equal(net.tables[w], net.context[:, w]) for w in (0, 7, pseudo_lm.WORDS))


def test_words_are_counted_in_pieces_that_stay_in_memory(spark, monkeypatch):
    """Texts of a batch are hashed some at a time, at most 128 KiB unless one is longer; the counts are those of all words."""
    from unittest.mock import MagicMock

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 900, n)) for n in (9000, 9000, 1, 20_000, 60_000, 9000, 0, 9000, 9000, 9000)]
    docs, seen, hashed = MagicMock(), [], pseudo_lm._word_hashes
    pseudo_lm.count_words(docs, 3)
    work = docs.select.return_value.mapInArrow.call_args[0][0]
    monkeypatch.setattr(pseudo_lm, "_word_hashes", lambda data, offsets: seen.append(len(data)) or hashed(data, offsets))
    got = collections.Counter()
    for batch in work(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])):
        for words, n in zip(batch["words"].to_pylist(), batch["n"].to_pylist(), strict=True):
            for word, m in zip(np.frombuffer(words, np.int64).tolist(), np.frombuffer(n, np.int64).tolist(), strict=True):
                got[word] += m
    assert sum(seen) == sum(map(len, texts)) and all(n <= 1 << 17 or n in map(len, texts) for n in seen)
    want = collections.Counter(w for t in texts for w in t.split())
    assert sorted(got.values()) == sorted(want.values())


def test_ids_are_those_of_a_plain_lookup():
    """Words at either end of all numbers, many that begin alike, unknown ones between them, and no frequent words at all."""
    rng = np.random.default_rng(9)
    ends = np.iinfo(np.int64)
    known = np.unique(np.concatenate([rng.integers(ends.min, ends.max, 500), np.arange(300) * 2 + (1 << 40), [ends.min, -1, 0, ends.max]]))
    asked = np.concatenate([known, known[:-1] + 1, rng.integers(ends.min, ends.max, 2000), np.arange(700) + (1 << 40), [ends.max - 1]])
    for frequent in (known, known[:-1], known[:0]):
        assert np.array_equal(pseudo_lm._Places(frequent)(asked), np.searchsorted(frequent, asked))
        mixed = rng.permutation(frequent).tolist()
        of = {w: i for i, w in enumerate(mixed)}
        vocabulary = pseudo_lm.Vocabulary(mixed, [1] * pseudo_lm.WORDS)
        ids, sharing = vocabulary(asked)
        assert ids.dtype == np.uint16 and sharing.tolist() == [w not in of for w in asked.tolist()]
        assert [i for i, s in zip(ids.tolist(), sharing, strict=True) if not s] == [of[w] for w in asked.tolist() if w in of]
        assert not sharing.any() or ids[sharing].min() >= pseudo_lm.WORDS - pseudo_lm.rare_ids(pseudo_lm.WORDS)


def test_hyperbolic_tangents():
    z = np.array([[0, 1e-6, -0.01, 0.3, -1, 4, -12, 60, -60, 1000, -1000]], np.float32)
    assert np.allclose(pseudo_lm._tanh(z.copy()), np.tanh(z.astype(float)), rtol=0, atol=3e-7)
