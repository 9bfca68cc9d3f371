"""Chat formatting, divergence and spelling against brute force in plain Python, on given and on hard rows."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from lamina.llm import chat_format, common, divergence, queries, spelling

BYTES = public_tokenizers.path("byte_bpe_50k.json")
Q = queries.queries()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_chat_format", "op12_divergence", "op13_spelling"])
def test_same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    run = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in run.description]
    got = Q[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, run.fetchall()))


# 11

CONTROL = ["\\### Assistant: </turn> ok", "####", "#" * 7 + " x", "\\", "\\\\#", "</turn></turn>\n", "<|endoftext|>", "### User: hi</turn>\n### Assistant: ", "##", "</tur", "", None, "plain", "日本 😀 é\n", "a\x00b", "\\n", " ends\\"]
ROLES = ["system", "user", "assistant", "Assistant", "System", "tool", "", None, "to:ol", "a\\:b", "###", "User two"]
TURNS = "conv_id long, turn long, role string, text string, kind int, ids string, row string"


def hard_turns():
    rows = [(i % 7, i // 7, ROLES[i % len(ROLES)], CONTROL[i % len(CONTROL)], 1, "x", "y") for i in range(len(ROLES) * len(CONTROL))]
    rows += [(100, 5, "user", "later", 1, "x", "y"), (100, None, "assistant", "last", 1, "x", "y"), (100, 1, "user", "same", 1, "x", "y"), (100, 1, "user", "same", 2, "z", "y"), (100, 1, "assistant", "same", 1, "x", "y")]
    rows += [(None, i, "assistant", f"none {i}", 1, "x", "y") for i in range(5)] + [(None, None, None, None, None, None, None)]
    rows += [(200, i, ("user", "assistant")[i % 2], f"turn {i} " * 30, 1, "x", "y") for i in range(900)]
    return rows


def by_force(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] is None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        said, loss = "".join(f"{r}\n{t}\n" for _, _, r, t in turns), "".join(t for _, _, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), [(r, t) for _, _, r, t in turns])
    return out


@pytest.mark.parametrize("piece", [1, 300, 65_536])
def test_hard_turns_are_read_back(spark, monkeypatch, piece):
    """Control strings, roles of all kinds, ties, nulls, and a conversation with most of the rows, in pieces of any size."""
    monkeypatch.setattr(chat_format, "PIECE", piece)
    monkeypatch.setattr(chat_format, "PART_BYTES", 20_000)
    rows = hard_turns()
    pieces = chat_format.write(spark.createDataFrame(rows, TURNS).repartition(5), common.new_folder(spark, "chat"), BYTES)
    want = by_force(rows)
    got = {r.conv_id: r for r in chat_format.digests(pieces, BYTES).collect()}
    assert got.keys() == want.keys() and all(tuple(got[c])[1:5] == want[c][:4] for c in want)
    texts = collections.defaultdict(list)
    for r in chat_format.texts(pieces, BYTES).orderBy("part", "piece").collect():
        texts[r.conv_id].append(r.formatted)
    for c, parts in texts.items():
        whole = "".join(parts)
        assert chat_format.parse(whole) == want[c][4] and len(whole) == got[c].formatted_chars
    assert len({r.part for r in pieces.filter("conv_id = 200").select("part").collect()}) > 1


def test_ids_and_masks(spark):
    """Reserved ids stand around turns only, masks over assistants' texts only, and segments are encoded by themselves."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    rows = [r for r in hard_turns() if r[0] in (0, 3)]
    t = chat_format.template(BYTES)
    escape = lambda s: re.sub(r"(?<=#)(?=##)|(?<=<)(?=/turn>)|(?<=<)(?=\|endoftext\|>)|(?=\\)", r"\\", s)
    for c in (0, 3):
        ids, mask = [], []
        for _, _, role, text in sorted(((r[1] is None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c)):
            if role in chat_format.HEADERS:
                head = [t.reserved[chat_format.HEADERS[role]]]
            else:
                spelled = re.sub(r"(?=:)|^(?=System|User|Assistant)", r"\\", role) if "\\" not in role else r"a\\\:b"
                head = [t.reserved["### "], *library.encode(escape(spelled) if "\\" not in role and "#" in role else spelled).ids, t.after_role]
            body = library.encode(escape(text), add_special_tokens=False).ids
            ids += [*head, *body, t.end]
            mask += [0] * len(head) + [int(role == "assistant")] * len(body) + [0]
        got = chat_format.assemble(spark.createDataFrame(rows, TURNS).filter(f"conv_id = {c}"), BYTES).orderBy("part", "piece").collect()
        assert [i for r in got for i in r.input_ids] == ids and [m for r in got for m in r.loss_mask] == mask


def test_no_turns(spark):
    none = spark.createDataFrame([], TURNS)
    assert chat_format.digests(chat_format.write(none, common.new_folder(spark, "chat"), BYTES), BYTES).count() == 0


# 12

DOCS = "doc_id long, text string, lang string, source string, n long, term string, shard int"


def divergence_by_force(rows):
    terms = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    out = []
    for lang in {r[2] or "" for r in rows}:
        own = [(r[3] or "", terms(r[1])) for r in rows if (r[2] or "") == lang]
        docs = collections.Counter(t for _, ts in own for t in set(ts))
        kept = sorted(t for t, n in docs.items() if n >= divergence.LEAST_DOCS)
        counts = {s: collections.Counter() for s, _ in own}
        for s, ts in own:
            counts[s].update(t for t in ts if docs[t] >= divergence.LEAST_DOCS)
        whole = sum(counts.values(), collections.Counter())
        chance = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: chance(c) for s, c in counts.items()}, chance(whole)
        rank = lambda found: sorted(found, key=lambda x: (-x[1], x[0].encode()))
        for s in counts:
            pairs = rank([(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in counts if o != s])
            top = rank([(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]])[:200]
            out += [(lang, s, part, item, value, i + 1) for part, found in (("pair", pairs), ("term", top)) for i, (item, value) in enumerate(found)]
    return sorted(out)


def hard_docs():
    rng = np.random.default_rng(1)
    words = ["le", "LA", "été", "日本", "ﬁn", "x", "don't", "a\x7fb", "\x80é", "z" * 300, *(f"w{chr(97 + i)}" for i in range(20))]
    prose = lambda n: " ".join(rng.choice(words, n))
    rows = [(i, prose(int(rng.integers(0, 60))), ("en", "fr", None, "")[i % 4], (None, "", "a", "b", "é", "A")[i % 6], 1, "t", 0) for i in range(150)]
    rows += [(i, prose(30), "en", "a", 1, "t", 0) for i in range(100)] + [(7, "rare words here", "de", s, 1, "t", 0) for s in ("x", "y", None)][:2]
    rows += [(None, None, None, None, None, None, None), (1, "", "zz", "q", 1, "t", 0), (1, None, "zz", "r", 1, "t", 0), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize(("held", "piece", "pairs"), [(400_000, 400_000, 1_000_000), (50, 7, 1), (1, 1, 5)])
def test_divergence(spark, monkeypatch, held, piece, pairs):
    """At every size of what is held, of pieces and of blocks of sources."""
    for name, n in (("_HELD", held), ("PIECE", piece), ("PAIRS", pairs), ("TOP", 200)):
        monkeypatch.setattr(divergence, name, n)
    rows = hard_docs()
    got = divergence.audit(spark.createDataFrame(rows, DOCS).repartition(3))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == divergence_by_force(rows)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    one = divergence.audit(spark.createDataFrame([(1, "a a b", "en", s, 1, "t", 0) for s in "xyz"][:2], DOCS)).collect()
    assert sorted(map(tuple, one)) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


# 13


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling_by_force(rows):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 5}
    near_ = {w: sorted((o for o in n if near(w, o)), key=lambda o: (-n[o], o)) for w in n}
    form = {w: near_[w][0] if near_[w] and n[near_[w][0]] >= 5 * n[w] else None for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near_[w]), n[form[w]] if form[w] else 0) for w in n)


def got_words(frame):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.variants(frame).collect())


def hard_words():
    rng = np.random.default_rng(2)
    base = ["liberté", "coloration", "ababab", "aaaaaaa", "ÿÀ×÷ßþ", "x" * 47, "y" * 48, "ab" * 25, "q" * 120 + "r" * 120, "".join(rng.choice(list("abcé"), 70))]
    letters = list("abcéxyqrÿ")
    words = list(base)
    for w in base:
        for _ in range(12):
            i, c = int(rng.integers(len(w) + 1)), str(rng.choice(letters))
            words += [w[:i] + c + w[i:], w[: i - 1] + w[i:] if i else w[1:], w[:i] + c + w[i + 1 :]]
        words += [words[-1] + "a", words[-1] + "ab"]
    return words, rng


def test_spelling(spark):
    """Short words, long ones, those at the border between them; words that grow in steps of five and more; noise; repeated and null ids."""
    words, rng = hard_words()
    text = []
    for k, w in enumerate(words):
        text += [w if k % 2 else w.upper()] * int(5 ** (1 + k % 3) + k % 7) if w.isascii() else [w] * int(5 ** (1 + k % 3) + k % 4)
    text += ["chains"] * 6 + ["chainss"] * 90 + ["chainsss"] * 550 + ["chainssss"] * 3300 + ["short"] * 9 + ["sixsix"] * 4
    order = rng.permutation(len(text))
    rows = [(int(i) % 60, " ".join(text[j] for j in order[i::200])) for i in range(200)]
    rows += [(None, "chains, chains; chains! CHAINS chains1chains"), (None, None), (3, ""), (4, "12 !?"), rows[0]]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, word string, n string").repartition(3)
    want = spelling_by_force(rows)
    assert got_words(docs) == want
    assert any(w[0] == "chains" and w[2] == "chainssss" for w in want) and max(len(w[0]) for w in want) > 200 and sum(bool(w[1]) for w in want) > 30


def test_checksums():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 9000).astype(np.uint8)
    first = rng.integers(0, 8000, 500)
    end = first + rng.choice([0, 1, 2, 30, 63, 64, 65, 66, 200, 900], 500)
    before = [zlib.crc32(b"%d:" % i) for i in range(500)]
    got = spelling.checksums(data, first, end, np.array(before, np.uint32))
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes(), s) for a, b, s in zip(first, end, before, strict=True)]


def test_one_key_for_each_near_pair(spark):
    """So no pair is met twice: all words over two letters of lengths 6 to 8, brute force."""
    import itertools

    words = ["".join(w) for n in (6, 7, 8) for w in itertools.product("ab", repeat=n)]
    want = sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b))
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    assert sorted(map(tuple, spelling._short_pairs(frame).collect())) == sorted(tuple(sorted(p)) for p in want)


def test_no_words(spark):
    assert got_words(spark.createDataFrame([], "doc_id long, text string")) == [] and got_words(spark.createDataFrame([(1, "few words only")], "doc_id long, text string")) == []
