"""Tokens, language, toxicity, decontamination."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from deltaloom.llm import decontaminate, language_rank, sentencepiece_codec, token_planes, toxicity
from deltaloom.llm.common import LOOSE_SPACE, fresh_path, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
ODD = ["", "  a  b ", "\n\n x\ty", "▁▁a▁ b", "日本語 \U0001f600 x", "é <s> </s><unk> <0x41> <|endoftext|>x", "a" * 3000, "   ", "\x00\x01 q", "don't I'll it's***", "word*** a.b.c 12,3", " lead", "trail ", "x\x1cy z", "é*́ *́", "Σας ΑΣ. <|end|>"]


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, None, None, None) for i, t in enumerate(texts)], DOCS)


def test_sentencepiece_equals_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = sentencepiece_codec.PieceCodec(path, memo=40, check=False)
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice("ab c▁.é\n😀ß") for _ in range(rnd.randrange(60))) for _ in range(200)]
    for t in texts:
        assert codec.encode(t) == sp.encode(t), t
        assert codec.decode(sp.encode(t)) == sp.decode(sp.encode(t)), t
    for _ in range(200):
        ids = [rnd.choice([0, 1, 2, rnd.randrange(3, 259), rnd.randrange(3, 32000)]) for _ in range(rnd.randrange(8))]
        assert codec.decode(ids) == sp.decode(ids), ids
    got = {r.doc_id: r for r in sentencepiece_codec.encode_documents(docs_of(spark, [*ODD, None]).withColumn("n_tokens", F.lit("clash")), path, with_ids=True, with_text=True).collect()}
    for i, t in enumerate([*ODD, ""]):
        ids = sp.encode(t)
        assert (got[i].n_tokens, got[i].token_ids, got[i].decoded) == (len(ids), ids, sp.decode(ids))
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert sentencepiece_codec.encode_documents(docs_of(spark, []), path).count() == 0


def test_words_of_bytes():
    texts = ["a b", "", None, "x" * 1_500_000 + " y  x", " lead trail ", "A a É\n\tb", "zz"]
    key = b"k" * 16
    words, counts = word_hashes(pa.array(texts), key)
    assert counts.tolist() == [2, 0, 0, 3, 2, 4, 1]
    assert words[0] == words[7] == words[8] and words[1] == words[10] and len(set(words.tolist())) == 9
    assert word_hashes(pa.array(["a.b,, C"]), key, LOOSE_SPACE)[1].tolist() == [3]
    assert word_hashes(pa.array([], pa.string()), key)[1].tolist() == []


@pytest.mark.parametrize("kind", [token_planes.BIT, token_planes.BYTE])
def test_planes_round_trip(kind):
    rnd = np.random.default_rng(1)
    for n in (1, 7, 8, 1000):
        ids = rnd.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        assert (token_planes.from_planes(token_planes.to_planes(ids, kind), n, kind) == ids).all()


@pytest.mark.parametrize("kind,block", [(token_planes.BYTE, 1 << 16), (token_planes.BIT, 64)])
def test_token_files_equal_the_library(spark, kind, block):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    texts = [*ODD, None]
    manifest = token_planes.write_tokens(docs_of(spark, texts, 100).repartition(3), path, fresh_path(spark, "t"), kind=kind, block=block)
    got = sorted(token_planes.read_tokens(manifest, with_ids=True).collect())
    at = 0
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        assert (got[i].doc_id, got[i].start, got[i].n_tokens, got[i].token_ids) == (100 + i, at, len(ids), ids)
        assert got[i].ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        at += len(ids)
    assert token_planes.store_and_read(docs_of(spark, []), path).count() == 0
    twice = token_planes.store_and_read(docs_of(spark, ["a", "b"]).union(docs_of(spark, ["c"])).union(spark.createDataFrame([(None, "d", None, None, None)], DOCS)), path).collect()
    assert sorted(r.start for r in twice) == [0, 2, 4, 6] and sorted((r.doc_id for r in twice), key=repr) == [0, 0, 1, None]
    assert next(r.start for r in twice if r.doc_id is None) == 0


def brute_profile_distance(text, profiles, top):
    """The definition, on dictionaries."""
    from collections import Counter

    chars = [c.lower() if c.isalpha() else " " for c in text]
    s = " " + " ".join("".join(chars).split()) + " "
    grams = Counter()
    for n in (1, 2, 3):
        grams.update(g for i in range(len(s) - n + 1) if (g := s[i : i + n]).strip() and not (n == 3 and g[1] == " "))
    def code(g):
        x = 0
        for c in g:
            x = x << 21 | (0 if c == " " else ord(c))
        return x | {1: 0, 2: 1 << 61, 3: 1 << 62}[len(g)]
    own = [code(g) for g, _ in sorted(grams.items(), key=lambda kv: (-kv[1], code(kv[0])))][:top]
    best = {}
    for name, gs in profiles:
        place = {g: i for i, g in enumerate(gs)}
        best[name] = sum(abs(place[g] - i) if g in place else top for i, g in enumerate(own))
    return min(best.items(), key=lambda kv: (kv[1], kv[0]))[0], own


def test_language_equals_the_definition(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    train = docs.where(~language_rank.held_out(F.col("doc_id")))
    profiles = language_rank.train_profiles(train)
    assert [n for n, _ in profiles] == ["de", "en", "es", "fr"] and all(len(g) == 400 for _, g in profiles)
    got = {r.doc_id: r for r in language_rank.identify(docs, profiles).collect()}
    for r in docs.limit(60).collect():
        want, own = brute_profile_distance(r.text, profiles, 400)
        assert language_rank.ranked(language_rank.grams(r.text), 400).tolist() == own
        assert got[r.doc_id].lang_pred == want and 0 <= got[r.doc_id].score <= 1
    right = [got[r.doc_id].lang_pred == r.lang for r in docs.where(language_rank.held_out(F.col("doc_id"))).collect() if len(r.text) > 50]
    assert sum(right) / len(right) > 0.95
    odd = docs_of(spark, ["", None, "12 !?", "the", "the"])
    assert [(r.lang_pred, r.score) for r in language_rank.identify(odd, profiles).orderBy("doc_id").collect()][:3] == [("und", 0.0)] * 3
    assert language_rank.train_profiles(odd) == [] and {r.lang_pred for r in language_rank.identify(odd, []).collect()} == {"und"}
    assert language_rank.identify(odd.limit(0), profiles).count() == 0


def test_isotonic_and_trees():
    at, to = toxicity.fit_isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(to) > 0).all() and len(to) == 3 and abs(to[1] - 0.5) < 0.01
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = toxicity.margins(toxicity.fit_trees(x, y), x)
    assert ((m > 0) == y).mean() > 0.95
    flat = toxicity.fit_trees(x, np.zeros(600))
    assert flat["trees"] == [] and toxicity.margins(flat, x).max() < 0


def test_plain_words():
    assert toxicity.plain("Id1ot!!") == ("idiot", True)
    assert toxicity.plain("st*pid,")[0] == "stpid" and toxicity.plain("(Hello)") == ("hello", False)
    assert toxicity.plain("+1") == ("", False) and toxicity.plain("...") == ("", False)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels.where(~language_rank.held_out(F.col("doc_id"))))
    got = toxicity.score(docs, model).join(labels, "doc_id").where(language_rank.held_out(F.col("doc_id"))).toPandas()
    assert (got.predicted == (got.toxic > 0)).mean() > 0.97
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    odd = toxicity.score(docs_of(spark, ["", None, "x" * 100_000]), model).orderBy("doc_id").collect()
    assert [r.predicted for r in odd] == [0, 0, 0] and odd[0].score == odd[1].score


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs_of(spark, ["a", "b"]), labels)
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs_of(spark, ["a", None]), model).collect())
    one = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.score(docs_of(spark, ["a", "b"]), toxicity.train(docs_of(spark, ["a", "b"]), one)).collect()} == {0}


def brute_scores(index, items, text):
    """BM25 of every unit against every passage, without an index."""
    import re

    words = [w for w in re.split(r"[^0-9A-Za-z\u0080-\U0010ffff]+", text) if w]
    low = [w.lower() if w.isascii() else w.translate({i: i + 32 for i in range(65, 91)}) for w in words]
    hashes, _ = word_hashes(pa.array([" ".join(low)]), index.key, LOOSE_SPACE)
    out, lots = {}, max(1, -(-len(low) // index.unit))
    for lot in range(lots):
        terms = set(index.lookup(hashes[lot * index.unit : (lot + 2) * index.unit]).tolist()) - {-1}
        for u in range(index.n):
            s = sum(index.impact[p] for t in terms for p in range(index.at[index.starts[t]], index.at[index.starts[t + 1]]) if index.owner[p] == u)
            out[lot, u] = s
    return out


def test_wand_retrieves_all_above_the_threshold(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontaminate.BlockMaxIndex(items, unit=16, block=4)
    rnd = random.Random(4)
    texts = []
    for _ in range(12):
        a, b = rnd.choice(items)[1].split(), rnd.choice(items)[1].split()
        texts.append(" ".join(a[: rnd.randrange(1, len(a))] + b[rnd.randrange(len(b)) :]))
    for least in (0.3, 0.6):
        for t in texts:
            words, counts = word_hashes(pa.array([t]), index.key, LOOSE_SPACE)
            got = {(p, u): s for _, p, u, s in index.passages(words, counts, least)}
            want = {k: s for k, s in brute_scores(index, items, t).items() if s >= least + 1e-9}
            assert want.keys() <= got.keys() and all(abs(got[k] - brute_scores(index, items, t)[k]) < 1e-9 for k in got)


def test_decontamination_finds_copies_only(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    exact = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in r.text}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == exact and exact
    filler = " ".join(f"word{i}" for i in range(300))
    q, a = decontaminate.split_item(items[0][1])
    made = docs_of(spark, [filler + " " + items[0][1].upper() if items[0][1].isascii() else filler + items[0][1], items[1][1] + " " + filler, filler, None, "", q, items[2][1].replace(" ", "*** ")])
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(made, bench).collect()}
    assert {(0, items[0][0]), (1, items[1][0]), (6, items[2][0])} <= found and not {d for d, _ in found} & {2, 3, 4}
    whole = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench, shard_bytes=2000).collect())) == whole
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs, bench.select("item_id", F.lit(None).cast("string").alias("text"))).count() == 0


def test_items_split():
    assert decontaminate.split_item("Who? Me.") == ("Who?", " Me.")
    assert decontaminate.split_item("One. Two. Three.") == ("One. Two.", " Three.")
    assert decontaminate.split_item("one") == ("one", "")


def thue_morse(bits, a="a", b="b"):
    word = a
    for _ in range(bits):
        word += word.translate(str.maketrans(a + b, b + a))
    return word


def test_long_regular_words_stay_apart(spark):
    """Words on which polynomial hashes modulo a power of two collide whatever their base."""
    for bits in (5, 10, 11, 12):
        one = thue_morse(bits)
        two = one.translate(str.maketrans("ab", "ba"))
        words, _ = word_hashes(pa.array([one, two]), b"k" * 16)
        assert words[0] != words[1]
        texts = ["x " + one, "x " + two, two]
        path = public_tokenizers.path("word_bpe_49k.json")
        lib = Tokenizer.from_file(path)
        got = token_planes.ChunkTokenizer(path).encode_batch(pa.array(texts), None)
        assert [x.tolist() for x in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
        codec = sentencepiece_codec.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
        assert codec.encode_batch(texts) == codec.library.encode(texts)


def test_pool_survives_equal_hashes(monkeypatch):
    """Hashes of few bits under the first keys: the pool finds out and goes on under others."""
    from deltaloom.llm import common

    whole, keys = common.RunPool._hashes, []

    def narrow(self, raw, begins, sizes):
        if self.key not in keys:
            keys.append(self.key)
        return whole(self, raw, begins, sizes) & np.uint64(7 if keys.index(self.key) < 3 else 2**64 - 1)

    monkeypatch.setattr(common.RunPool, "_hashes", narrow)
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), token_planes.ChunkTokenizer(path)
    texts = [" ".join(f"w{i * j}" for j in range(9)) for i in range(40)]
    for _ in range(2):
        got = own.encode_batch(pa.array(texts), None)
        assert [x.tolist() for x in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(keys) >= 4


def test_pool_confirms_every_byte():
    """Runs of every size about the words that they are compared by, with zero bytes at their ends; tables that grow."""
    from deltaloom.llm import common

    rnd = random.Random(8)
    runs = [b"".join(rnd.choice([b"a", b"b", b"\x00"]) for _ in range(n)) for n in [*range(1, 60)] * 40]
    runs += [r + b"\x00" for r in runs[:200]] + [b"%d" % i for i in range(60_000)] + [b"z" * 5000, b"z" * 4999 + b"y"]
    pool, seen = common.RunPool(1 << 20), {}

    def learn(text, sizes):
        raw, ends = text.tobytes(), np.cumsum(sizes)
        got = [seen.setdefault(raw[e - n : e], len(seen)) for e, n in zip(ends, sizes)]
        yield np.arange(len(sizes)), np.array(got, np.uint32), np.ones(len(sizes), np.int64)

    for _ in range(3):
        rnd.shuffle(runs)
        for lot in (runs[:999], runs[999:]):
            sizes = np.array([len(r) for r in lot])
            ends = np.cumsum(sizes)
            (got,) = pool.fill(np.frombuffer(b"".join(lot), np.uint8), ends - sizes, ends, np.array([len(lot)]), learn, [])
            assert got.tolist() == [seen[r] for r in lot]


def test_decoding_equals_the_library_on_any_ids():
    """Byte pieces in any order, control and unknown pieces among them, spaces at the start."""
    own = sentencepiece_codec.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    rnd, n = random.Random(1), len(own.pieces)
    kinds = [list(own.byte_ids.values()), [*own.silent, own.unknown], [own.ids["▁"]], range(n)]
    for _ in range(5000):
        ids = [rnd.choice(rnd.choice(kinds)) for _ in range(rnd.randrange(9))]
        assert own.decode(ids) == own.library.decode(ids)


def test_index_grows_with_the_benchmark():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(30_000)]
    sizes = []
    for n in (200, 800, 3200):
        items = [(i, " ".join(words[int(rnd.paretovariate(0.4)) % 30_000] for _ in range(120))) for i in range(n)]
        sizes.append(decontaminate.BlockMaxIndex(items).nbytes() / sum(len(t) for _, t in items))
    assert max(sizes) < 1.3 * min(sizes) and max(sizes) < 12
