"""Line dedup, decontamination, tokens, language and toxicity against brute force, with untidy tables."""

import hashlib
import math
import random
import re
import zlib

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from quernstone.llm import bpe, decontaminate, language_id, line_dedup, token_counts, toxicity

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
LONG = "word " * 60_000
#: Nulls in any column, empty and very long texts, repeated rows, and columns named like inner ones.
ROWS = [
    (1, "The first line\nshared LINE \nend", "en", "src0", 30, "x", 1),
    (1, "The first line\nshared LINE \nend", "en", "src0", 30, "x", 1),
    (2, "\tshared line\n\n", "en", None, None, None, None),
    (None, "shared line", None, "src1", 1, "y", 2),
    (4, None, "fr", "src1", 0, "z", 3),
    (5, "", "fr", "src1", 0, "z", 3),
    (6, LONG, "en", "src1", 1, "z", 3),
    (7, "123 ... été \U0001f642 日本語", "fr", "src1", 1, "z", 3),
    (8, "\n\n", "de", "src1", 1, "z", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `__k0` string, n_words int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def test_lines(docs, empty):
    out = line_dedup.dedup_lines(docs, min_docs=4)
    assert out.columns == [*docs.columns, "line_dedup"]
    got = {(r.doc_id, r.text): r.line_dedup for r in out.collect()}
    # "shared line" stands in four rows: the repeated row counts twice.
    assert got[1, ROWS[0][1]].kept == "The first line\nend"
    assert got[2, ROWS[2][1]] == ("\n", 3, 1)
    assert got[None, "shared line"] == ("", 1, 1)
    assert got[4, None] == (None, 1, 0)
    assert got[5, ""] == ("", 1, 0)
    assert got[8, "\n\n"] == ("\n\n", 3, 0)
    assert out.count() == len(ROWS)
    assert line_dedup.dedup_lines(empty).count() == 0
    clash = line_dedup.dedup_lines(docs.withColumn("line_dedup", F.lit(1)).withColumn("__pos", F.lit(2)))
    assert clash.columns == [*docs.columns, "__pos", "line_dedup"]


def test_lines_fuzz(spark):
    rng = random.Random(4)
    lines = ["", " ", "a", "A ", "b\t", "\x0bb", "É", "é", "long line " * 20]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 8)))) for k in range(60)]
    got = {r.doc_id: r.line_dedup for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=25, min_chars=1).collect()}
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    count = {}
    for _, t in rows:
        for k in {key(x) for x in t.split("\n")}:
            count[k] = count.get(k, 0) + 1
    assert any(n >= 25 for k, n in count.items() if k)
    for k, t in rows:
        split = t.split("\n")
        kept = [x for x in split if not (key(x) and count[key(x)] >= 25)]
        assert got[k] == ("\n".join(kept), len(split), len(split) - len(kept))


def brute_hits(text, items, window):
    words, hit, found = decontaminate.words_of(text.encode()), set(), set()
    for name, item in items:
        w = decontaminate.words_of((item or "").encode())
        for k in range(max(1, len(w) - window + 1) if w else 0):
            part = w[k : k + window]
            for a in range(len(words) - len(part) + 1):
                if words[a : a + len(part)] == part:
                    hit.update(range(a, a + len(part)))
                    found |= {str(name)} if name is not None else set()
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_contamination(spark, docs, empty, block):
    rng = random.Random(6)
    alphabet = ["a", "B", "c", "éx", "zz"]
    items = [(k % 4, " ".join(rng.choice(alphabet[:4]) for _ in range(rng.randint(0, 9)))) for k in range(7)] + [(None, "a a"), (9, None), (9, "...")]
    rows = [(k, " ".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))) for k in range(80)] + [(80, None), (81, ""), (None, "a B c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench, window=4, block_bytes=block)
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in got.collect()}
    for k, t in rows:
        assert got[k] == brute_hits(t or "", items, 4), (k, t)
    kept = decontaminate.remove_contaminated(docs, bench.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert decontaminate.find_contamination(empty, bench).count() == 0


def test_full_index_fuzz():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(40):
        s = rng.integers(0, 4, rng.integers(1, 200))
        index = decontaminate.FmIndex(s, 3)
        for n in (1, 2, 3):
            w = rng.integers(1, 4, (5, n))
            who, lo, hi = index.search(w, np.full(5, n))
            got = {int(k): sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(who, lo, hi, strict=True)}
            for k in range(5):
                assert got.get(k, []) == [i for i in range(len(s) - n + 1) if (s[i : i + n] == w[k]).all()]


def test_contamination_across_shards(monkeypatch):
    """Documents longer than a shard, and texts split in pieces."""
    rng = random.Random(7)
    items = [("i1", " ".join(rng.choice("abc") for _ in range(6)).encode()), ("i2", b"a b")]
    texts = [" ".join(rng.choice(["a", "b", "c", "zz", "y y"]) for _ in range(n)).encode() for n in (200, 3, 0, 90)]
    found = []
    for shard, piece in ((1_000_000, 1 << 20), (7, 10), (50, 3)):
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
        monkeypatch.setattr(decontaminate, "PIECE", piece)
        held = decontaminate._Shard(decontaminate.Windows(items, 4))
        held.add(texts[:3])
        held.add(texts[3:])
        spans, names = held.spans()
        found.append((held.n_words, spans, names))
    assert found[0] == found[1] == found[2]
    for t, n, spans, names in zip(texts, *found[0], strict=True):
        assert (n, sum(x["end"] - x["start"] for x in spans), names) == brute_hits(t.decode(), [(i, b.decode()) for i, b in items], 4)


def test_a_long_text_against_a_benchmark(spark):
    item = " ".join(f"q{k}" for k in range(30))
    rows = [(1, "pad " * 400_000 + item + " pad" * 400_000), (2, item)]
    got = {r.doc_id: r for r in decontaminate.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_hit, list(got[1]["items"])) == (800_030, 30, ["5"]) and (got[1].spans[0].start, got[1].spans[0].end) == (400_000, 400_030)
    assert got[2].n_hit == 30


@pytest.fixture(scope="module")
def tik():
    ranks = bpe.read_ranks(open(RANKS, "rb").read())
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_against_the_library(tik):
    codec = bpe.Codec(open(RANKS, "rb").read(), P.PATTERN)
    rng = random.Random(2)
    parts = ["a", "the", "é", "ö", " ", "  ", "\n", "日本", "\U0001f642", "1", "23", "!?", "--", "ing", "Ω", "́", "'s", "'ll", "x" * 50, "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 120))) for _ in range(800)] + ["a" * 5000, "ab" * 3000, ""]
    assert [codec.encode(t) for t in texts] == [tik.encode_ordinary(t) for t in texts]
    assert ["".join(codec.decode(codec.chunks(t))) for t in texts] == texts


def test_bpe_with_a_full_table(tik, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    codec = bpe.Codec(open(RANKS, "rb").read(), P.PATTERN)
    text = " ".join(f"w{k}ord{k * 7919}ing" for k in range(3000))
    assert codec.encode(text) == tik.encode_ordinary(text)


def test_bpe_decodes_cut_characters():
    codec = bpe.Codec(open(RANKS, "rb").read(), P.PATTERN)
    ids = codec.encode("\U0001f642日")
    assert "".join(codec.decode([i] for i in ids)) == "\U0001f642日"


def test_bpe_tables(docs, empty, tik, monkeypatch):
    out = bpe.encode_decode(docs, RANKS, P.PATTERN, outputs=("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")).collect()
    assert len(out) == len(ROWS)
    by_text = sorted((r[1] or "", r[0] or 0) for r in ROWS)
    for (text, _), r in zip(by_text, sorted(out, key=lambda r: (r.decoded, r.doc_id or 0)), strict=True):
        ids = tik.encode_ordinary(text)
        assert (r.decoded, r.ids, r.n_tokens) == (text, ids, len(ids))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_decode(empty, RANKS, P.PATTERN).count() == 0


def test_token_counts(docs, empty):
    import regex

    trie = token_counts.Trie(bpe.read_ranks(open(RANKS, "rb").read()))

    def brute(word):
        """All segmentations by a table over places."""
        b = word.encode()
        score, best = [0.0] + [None] * len(b), [(0, 0)] + [None] * len(b)
        for j in range(1, len(b) + 1):
            ends = [(score[i] + trie.pieces[b[i:j]][0], (best[i][0] + trie.pieces[b[i:j]][1], best[i][1] + 1)) for i in range(j) if b[i:j] in trie.pieces]
            score[j], best[j] = math.log(math.fsum(math.exp(x) for x, _ in ends)), min(x for _, x in ends)
        return best[-1][1], score[-1]

    words = ["the", "there", "therein", "xqzé", " international", "\U0001f642" * 5, "aaaaaaaaaaaaaaaa"]
    for w in words:
        n, score = trie[w]
        assert n == brute(w)[0] and score == pytest.approx(brute(w)[1])
    got = {(r.doc_id, r.n_pretokens): r for r in token_counts.count_tokens(docs, RANKS, P.PATTERN).collect()}
    pre = regex.findall(P.PATTERN, ROWS[7][1])
    row = got[7, len(pre)]
    assert row.n_tokens == sum(brute(w)[0] for w in pre) and row.score == pytest.approx(sum(brute(w)[1] for w in pre))
    assert got[4, 0].n_tokens == 0 and got[5, 0].score == 0
    assert token_counts.count_tokens(empty, RANKS, P.PATTERN).count() == 0


def test_very_long_pretokens_get_no_nodes(monkeypatch):
    trie = token_counts.Trie(bpe.read_ranks(open(RANKS, "rb").read()))
    words = ["x" * 500, "international" * 40, "日本語\U0001f642" * 60]
    want = [trie[w] for w in words]
    monkeypatch.setattr(token_counts, "LONG_WORD", 100)
    trie.begin()
    got = [trie[w] for w in words]
    assert [n for n, _ in got] == [n for n, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want])
    assert len(trie.score) == 1 and not trie


def test_new_tries_change_nothing(monkeypatch):
    ranks = bpe.read_ranks(open(RANKS, "rb").read())
    whole = token_counts.Trie(ranks)
    monkeypatch.setattr(token_counts, "MAX_NODES", 10)
    small = token_counts.Trie(ranks)
    for k in range(300):
        assert whole[f"w{k * 31}x"] == small[f"w{k * 31}x"]


PIECES = P.path("piece_bpe_32k.model")


def test_lattice_sums_all_segmentations():
    import numpy as np

    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "abab"]
    p = np.array([[0.3], [0.2], [0.1], [0.15], [0.1], [0.05], [0.1], [language_id.UNKNOWN]])
    number = {x: k for k, x in enumerate(pieces)}

    def total(text):
        return 1.0 if not text else sum(p[number[text[:n]], 0] * total(text[n:]) for n in range(1, len(text) + 1) if text[:n] in number) + (language_id.UNKNOWN * total(text[1:]) if text[0] not in number else 0)

    known = language_id.Pieces(pieces)
    words = ["ab", "abab", "bab", "x", "axb", "", "🙂a"]
    want = [math.log(total("▁" + w)) for w in words]
    assert language_id.Lattice(words, known).score(p)[:, 0] == pytest.approx(want)
    assert language_id.Lattice(words, known).score_by_logs(p)[:, 0] == pytest.approx(want)
    assert [language_id.long_score(w, known, p)[0] for w in words] == pytest.approx(want)
    counts = language_id.Lattice(["abab"], known).expect(p, np.array([1.0]))
    step = 1e-6
    for k in range(len(pieces)):  # the expected count is the slope of the log probability in log p
        q = p.copy()
        q[k] *= 1 + step
        slope = (language_id.Lattice(["abab"], known).score(q) - language_id.Lattice(["abab"], known).score(p))[0, 0] / step
        assert counts[k] == pytest.approx(slope, abs=1e-4)


def test_language(spark, docs, empty):
    words = {"en": "the house and then they went there with this", "fr": "les maisons sont avec une petite rue dans", "de": "die häuser sind und nicht eine kleine strasse"}
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(words[x].split(), k=12)), x) for k, x in enumerate(["en", "fr", "de"] * 40)] + [(900, None, "en"), (901, "123 ² _", "fr"), (902, "maisons avec les rue", None), (None, "nicht eine strasse", "en")]
    out = language_id.predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES)
    got = {r.doc_id: r for r in out.collect()}
    for k, t, x in rows[:120]:
        assert got[k].lang_pred == x and 0 <= got[k].score <= 1, t
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0)
    assert (got[900].lang_pred, got[900].score) == ("und", 0.0) == (got[901].lang_pred, got[901].score)
    assert got[902].lang_pred == "fr" and got[None].lang_pred == "de"
    kept = language_id.keep_identified(docs, PIECES)
    assert kept.columns == docs.columns
    filled = language_id.keep_identified(spark.createDataFrame(rows[:120] + [(902, "maisons avec les rue", None)], "doc_id long, text string, lang string"), PIECES)
    assert {r.doc_id: r.lang for r in filled.collect()}[902] == "fr"
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 2, 6, 7]
    assert language_id.predict_languages(empty, PIECES).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.predict_languages(unlabelled, PIECES).collect()} == {"und"}


def test_the_trie_holds_every_piece():
    import numpy as np

    pieces = language_id.read_pieces(PIECES)
    known = language_id.Pieces(pieces)
    node, alive = np.zeros(len(pieces), np.int32), np.arange(len(pieces))
    for k in range(known.longest):
        alive = alive[[len(pieces[p]) > k for p in alive]]
        node[alive] = known.step(node[alive], np.array([ord(pieces[p][k]) for p in alive], np.uint32))
    assert known.piece[node].tolist() == list(range(len(pieces)))
    assert known.step(np.zeros(3, np.int32), np.array([0x1F642, 0x10FFFF, 0], np.uint32)).tolist()[1:] == [0, 0]


def test_words_of_any_length_are_scored_whole(monkeypatch):
    import numpy as np

    assert language_id.words_of("x" * 100) == ["x" * 100] and language_id.words_of("12 3_4") == []
    pieces, rng = language_id.read_pieces(PIECES), np.random.default_rng(1)
    model = {x: (v := rng.random(len(pieces)) ** 6) / v.sum() for x in ("aa", "bb")}
    scorer = language_id.Scorer(pieces, model)
    words = ["".join(rng.choice(list("abcdeé日本x"), n)) for n in (3, 32, 33, 400, 70_000)]
    whole = language_id.Lattice(words, scorer.pieces).score_by_logs(scorer.probability)
    assert scorer.words(words) == pytest.approx(whole)
    # 32 rare letters: no sum becomes zero, no score is undefined.
    rare = scorer.texts(["\u1200\u1201" * 16, "\U00020000" * 5000 + " a"])
    assert all(0 <= x <= 1 for x in rare[1]) and len(scorer.row) == 2
    monkeypatch.setattr(language_id, "MAX_WORDS", 0)
    assert scorer.texts(["ab cd", "日本"]) == language_id.Scorer(pieces, model).texts(["ab cd", "日本"])


def test_prediction_by_brute_force(spark):
    """The model by expectation-maximisation over all segmentations, written out for small words."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(k, t, x) for k, (t, x) in enumerate([("the cat sat", "en"), ("a cat", "en"), ("le chat", "fr"), ("chat la", "fr"), ("un chat le", "fr"), ("the", "en")] * 5)]
    pieces = language_id.read_pieces(PIECES)
    number = {p: k for k, p in enumerate(pieces)}

    def ways(text):
        """All segmentations as lists of piece numbers."""
        if not text:
            return [[]]
        out = []
        for n in range(1, len(text) + 1):
            if text[:n] in number or n == 1:
                out += [[number.get(text[:n], -1), *w] for w in ways(text[n:])]
        return out

    model = {x: [1 / len(pieces)] * len(pieces) for x in ("en", "fr")}
    probability = lambda way, p: math.prod(p[k] if k >= 0 else language_id.UNKNOWN for k in way)
    for _ in range(2):
        after = {}
        for x in model:
            count = [language_id.SMOOTH] * len(pieces)
            for k, t, y in rows:
                if y == x and zlib.crc32(str(k).encode()) % 5:
                    for word in t.split():
                        each = [(probability(w, model[x]), w) for w in ways("▁" + word)]
                        total = sum(p for p, _ in each)
                        for p, w in each:
                            for piece in w:
                                if piece >= 0:
                                    count[piece] += p / total
            after[x] = [c / sum(count) for c in count]
        model = after
    got = {r.doc_id: r for r in language_id.predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES).collect()}
    for k, t, _ in rows:
        log = {x: sum(math.log(sum(probability(w, model[x]) for w in ways("▁" + word))) for word in t.split()) for x in model}
        best = max(sorted(log), key=log.get)
        assert got[k].lang_pred == best and got[k].score == pytest.approx(1 / sum(math.exp(v - log[best]) for v in log.values()))
    assert sp.get_piece_size() > len(pieces)


def test_at_most_so_many_languages(spark):
    rows = [(k, "the house", f"x{min(k, 6)}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(language_id.learn(df, ["\u2581", "h", "e"], max_langs=1)) == {"x6"}


def test_toxicity(spark, docs, empty):
    rng = random.Random(5)
    plain, bad = [f"word{k}" for k in range(200)], ["scumbag", "morons", "vequx", "vequy"]
    rows, labels = [], []
    for k in range(600):
        toxic = k % 6 == 0
        words = rng.choices(plain, k=40) + (rng.choices(bad, k=3) if toxic else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        if k % 2 == 0:
            labels.append((k, int(k % 3 > 0), int(toxic)))
    labels += [(None, 1, 1), (601, None, 1), (0, 0, 1)]
    rows += [(700, None), (701, ""), (None, "scumbag morons"), (702, "scumbag " * 50_000)]
    out = toxicity.predict_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), ("quality", "toxic"))
    got = {r.doc_id: r.p_toxic for r in out.collect()}
    held = [k for k in range(600) if k % 2]
    assert all((got[k] >= 0.5) == (k % 6 == 0) for k in range(0, 600, 2))
    assert sum((got[k] >= 0.5) == (k % 6 == 0) for k in held) >= 0.99 * len(held)
    assert got[700] == got[701] < 0.5 and got[None] > 0.5 and got[702] > 0.5
    twice = spark.createDataFrame([*rows[:600], (0, "plain"), (0, "scumbag plain"), (0, None), (2, rows[2][1])], "doc_id long, text string")
    again = [toxicity.predict_toxicity(twice.repartition(n), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), ("quality", "toxic")) for n in (1, 5)]
    one, two = (sorted((r.doc_id, round(r.p_toxic, 9)) for r in x.collect()) for x in again)
    assert one == two and len(one) == 604
    clash = toxicity.predict_toxicity(docs.withColumn("id", F.lit(1)).withColumn("y0", F.lit(2)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), ("toxic",))
    assert clash.columns == ["doc_id", "p_toxic"] and clash.count() == len(ROWS)
    none = toxicity.predict_toxicity(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), ("quality", "toxic"))
    assert {r.p_toxic for r in none.collect()} == {0.5}
    assert toxicity.predict_toxicity(empty, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), ("toxic",)).count() == 0


def test_features_do_not_depend_on_the_groups(monkeypatch):
    from quernstone.llm import rolling

    rng = random.Random(3)
    texts = [" ".join("x" * rng.randint(1, 9) + str(rng.randrange(9)) + "yé" * rng.randint(0, 60) for _ in range(n)).encode() for n in (0, 1, 40, 3)]
    want = [x.tolist() for x in toxicity.features(texts)]
    assert len(want[0]) > 50
    for size in (10, 64):
        monkeypatch.setattr(rolling, "CHUNK", size)
        monkeypatch.setattr(toxicity, "CHUNK", size)
        assert [x.tolist() for x in toxicity.features(texts)] == want


def test_chain_by_brute_force():
    """The chain, refitted with plain matrices: later models learn from out-of-fold probabilities of earlier ones."""
    import numpy as np

    from quernstone.llm.common import mix

    rng = np.random.default_rng(2)
    n, used = 240, np.arange(40) * 5000 + 7
    x = rng.random((n, len(used))) < 0.3
    first = (x[:, :3].sum(1) + rng.random(n) > 1.6).astype(float)
    second = ((first + x[:, 5] + rng.random(n)) > 1.7).astype(float)
    ids = np.arange(n) * 3
    rows, cols = np.nonzero(x)
    chain = toxicity.fit_chain(ids, rows, used[cols], np.stack([first, second], 1))

    def fit(x, earlier, y):
        p1, p0, p = x[y == 1].mean(0), x[y == 0].mean(0), x.mean(0)
        z = np.abs(p1 - p0) / np.sqrt(p * (1 - p) * (1 / y.sum() + 1 / (len(y) - y.sum())) + 1e-12)
        chosen = (z > 2) & (x.sum(0) >= 3)
        a = np.column_stack([x * chosen, earlier, np.ones(len(y))]).astype(float)
        w, penalty = np.zeros(a.shape[1]), np.append(np.full(a.shape[1] - 1, toxicity.RIDGE), 0)
        for _ in range(60):
            q = 1 / (1 + np.exp(-a @ w))
            w -= np.linalg.solve(a.T @ (a * (q * (1 - q))[:, None]) + np.diag(penalty) + 1e-9 * np.eye(len(w)), a.T @ (q - y) + penalty * w)
        return lambda x, earlier: 1 / (1 + np.exp(-np.column_stack([x, earlier, np.ones(len(x))]) @ w))

    none, fold = np.zeros((n, 0)), mix(ids.view(np.uint64)) % np.uint64(toxicity.FOLDS)
    out = np.zeros((n, 1))
    for f in range(toxicity.FOLDS):
        out[fold == f, 0] = fit(x[fold != f], none[fold != f], first[fold != f])(x[fold == f], none[fold == f])
    want_first = fit(x, none, first)(x, none)
    want_second = fit(x, out, second)(x, want_first[:, None])
    got_first = chain[0].predict(rows, used[cols], n, none)
    assert got_first == pytest.approx(want_first, abs=1e-3)
    assert chain[1].predict(rows, used[cols], n, got_first[:, None]) == pytest.approx(want_second, abs=1e-3)


def test_word_pattern():
    assert re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower("Ab-C9 é_d")) == [w.decode() for w in decontaminate.words_of("Ab-C9 é_d".encode())]


def test_a_rare_language_is_learned(spark, monkeypatch):
    assert language_id.fair_quota([5, 1000, 3000], 405) == 200 and language_id.fair_quota([5, 7], 40) == 7
    rows = [(k, "the house and the boat", "en") for k in range(3000)] + [(5000 + k, "rue petite maison", "fr") for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    met = []
    count = language_id._count_words
    monkeypatch.setattr(language_id, "_count_words", lambda train: met.append({r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}) or count(train))
    model = language_id.learn(df, ["\u2581the", "\u2581rue", "e", "t", "h"], max_train=60)
    rare = df.filter("lang = 'fr'").filter(~language_id.held_out(F.col("doc_id"))).count()
    assert set(model) == {"en", "fr"} and met[0]["fr"] == rare and 20 < met[0]["en"] < 100
