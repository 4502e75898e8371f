"""Registered queries that SQL can't express, and the pipeline, against plain versions."""

import bisect
import hashlib
import math
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_search_and_join import brute_links
from test_text_operators import brute_profile_distance

import corpus_pipeline
from deltaloom.llm import decontaminate, language_rank, ngram_join, toxicity
from deltaloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_features(text, words, begins):
    tokens = (text or "").split()
    n, raw = len(tokens), (text or "").encode()
    if not n:
        return [0.0] * len(toxicity.FEATURES)
    seen = []
    for t in tokens:
        word, disguised = toxicity.plain(t)
        own = [w for w in [words.get(word), *[begins.get(word[:k]) for k in (3, 4, 5, 6) if len(word) > k]] if w is not None]
        seen.append((word in words, any(word[:k] in begins for k in (3, 4, 5, 6) if len(word) > k), max(own, default=0.0), disguised, word in toxicity.SECOND_PERSON, len(word) == 1, len(t) > 2 and t.isupper(), "!!" in t or "??" in t or t.endswith("!")))
    hits = [i for i, s in enumerate(seen) if s[0] or s[1]]
    you = [i for i, s in enumerate(seen) if s[4]]
    near = sum(1 / (1 + min(abs(i - j) for j in you)) for i in hits) / len(hits) if hits and you else 0.0
    rate = lambda k: sum(s[k] for s in seen) / n
    bytes_in = lambda *spans: sum(any(lo <= b <= hi for lo, hi in spans) for b in raw) / len(raw)
    return [sum(s[0] for s in seen), sum(s[1] for s in seen), len(hits) / n, sum(seen[i][2] for i in hits) / n, max((seen[i][2] for i in hits), default=0.0), math.log1p(len(hits)), near, rate(4), rate(6), bytes_in((65, 90)), rate(7), bytes_in((33, 47), (58, 64)), bytes_in((48, 57)), rate(3), sum(seen[i][3] for i in hits), rate(5), math.log1p(n)]


def plain_score(model, x):
    m = model.trees["base"]
    for split, values in model.trees["trees"]:
        node = 0
        for _ in range(model.trees["depth"]):
            feature, cut = split[node]
            node = 2 * node + 1 + (x[feature] > cut)
        m += values[node - len(split)]
    raw, (at, to) = 1 / (1 + math.exp(-m)), model.calibration
    if len(at) < 2:
        return raw
    best, up = 0.0, []
    for t in to:
        best = max(best, t)
        up.append(best)
    k = bisect.bisect_right(list(at), m)
    level = up[0] if k == 0 else up[-1] if k == len(at) else up[k - 1] + (up[k] - up[k - 1]) * (m - at[k - 1]) / (at[k] - at[k - 1])
    return min(max(level * 0.999 + raw * 0.001, 0.0), 1.0)


def test_op10_equals_a_plain_version(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels.where(~language_rank.held_out(F.col("doc_id"))))
    got = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        want = plain_score(model, plain_features(r.text, model.words, model.begins))
        assert abs(got[r.doc_id].score - want) < 1e-9 and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.5)


def plain_contaminated(texts, items, least=0.6, overlap=0.75, unit=64):
    """{(document, item)} by scoring every passage against every unit of every item."""
    words = lambda t: [w for w in re.split("[^0-9A-Za-z\x80-\U0010ffff]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) if w]
    units = []
    for i, t in items:
        w = words(t)
        lots = -(-len(w) // unit)
        size, more = divmod(len(w), lots) if lots else (0, 0)
        at = 0
        for k in range(lots):
            units.append((i, w[at : at + size + (k < more)]))
            at += size + (k < more)
    df = Counter(t for _, u in units for t in set(u))
    mean = sum(len(u) for _, u in units) / len(units)
    idf = {t: math.log(1 + (len(units) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    impacts = []
    for i, u in units:
        own = {t: idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(u) / mean)) for t, n in Counter(u).items()}
        total = sum(own.values())
        impacts.append((i, {t: x / total for t, x in own.items()}))
    runs = lambda w, k: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    found, by_item = set(), dict(items)
    for d, text in texts:
        w = words(text)
        hit = set()
        for lot in range(max(1, -(-len(w) // unit))):
            passage = set(w[lot * unit : (lot + 2) * unit])
            hit |= {i for i, own in impacts if round(sum(x for t, x in own.items() if t in passage), 9) >= least}
        for i in hit:
            shares = []
            for side in decontaminate.split_item(by_item[i]):
                s = words(side)
                k = min(5, len(s))
                shares.append(len(runs(s, k) & runs(w, k)) / len(runs(s, k)) if s else 1.0)
            if min(shares) >= overlap:
                found.add((d, i))
    return found


def test_op1_equals_a_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op1_decontaminate"](spark, SF).collect()}
    assert got == plain_contaminated(docs, items) and got


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """The small tables with copies, leaks and texts without a language put in."""
    d = str(tmp_path_factory.mktemp("planted"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    text = docs.where("length(text) > 600").orderBy("doc_id").first().text
    more = [(10**6, text, "en", "s", 1), (10**6 + 1, text + " and so on", "en", "s", 1), (10**6 + 2, "1 2 3", "en", "s", 1), (10**6 + 3, None, None, None, None), (10**6 + 4, f"Some words before it. {item} And some after.", "en", "s", 1), (None, text + " without an id", None, "s", 1), (10**6 + 5, "", "en", "s", 0)]
    docs.union(spark.createDataFrame(more, docs.schema)).write.parquet(f"{d}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    return d


def test_pipeline_equals_plain_stages(spark, planted):
    """run() against the stages done in plain Python, one after the other, on the same rows."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{planted}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{planted}/labels.parquet").where(~language_rank.held_out(F.col("doc_id")))
    profiles = language_rank.train_profiles(spark.read.parquet(f"{planted}/documents.parquet").where(~language_rank.held_out(F.col("doc_id"))))
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    for _, text, _ in rows[:5]:
        assert brute_profile_distance(text, profiles, 400)[0] in dict(profiles)
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels)
    rows = [r for r in rows if plain_score(model, plain_features(r[1], model.words, model.begins)) < 0.5]
    _, roots = brute_links([t if d is not None else None for d, t, _ in rows])
    best = {}
    for (d, _, _), root in zip(rows, roots):
        if d is not None:
            best[root] = min(best.get(root, d), d)
    rows = [r for r, root in zip(rows, roots) if r[0] is None or best[root] == r[0]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{planted}/benchmark.parquet").collect()]
    leaks = {k for k, _ in plain_contaminated([(k, t) for k, (_, t, _) in enumerate(rows)], items)}
    assert leaks
    rows = [r for k, r in enumerate(rows) if k not in leaks]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for d, text, _ in rows:
        ids = sp.encode(text)
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, planted).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) < len(rows) + len(leaks) + 1


def test_pipeline_of_nothing_and_of_clashing_columns(spark, planted, tmp_path):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    for name, frame in (("documents", docs.limit(0)), ("labels", spark.read.parquet(f"{planted}/labels.parquet")), ("benchmark", spark.read.parquet(f"{planted}/benchmark.parquet"))):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    clashing = docs.withColumns({c: F.lit("x") for c in ("row", "id", "score", "predicted", "lang_pred", "component_id", "sig", "key", "item_id", "block", "_carried_0")})
    now = plain = None
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now, plain = stage(spark, clashing if now is None else now, planted), stage(spark, docs if plain is None else plain, planted)
        assert now.columns == corpus_pipeline.COLUMNS
        now, plain = (spark.createDataFrame(f.collect(), docs.schema) for f in (now, plain))
        assert sorted(now.collect(), key=repr) == sorted(plain.collect(), key=repr)
        now = now.withColumns({c: F.lit("x") for c in ("row", "id", "sig", "score", "key")})


def test_queries_of_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark", "pages", "embeddings", "conversations"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_labels_with_clashing_columns(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    more = labels.withColumns({c: F.lit("x") for c in ("text", "fold", "score", "n")})
    one, two = toxicity.train(docs, labels), toxicity.train(docs.withColumn("toxic", F.lit("x")), more)
    assert one.words == two.words and one.trees["base"] == two.trees["base"]


def test_ranges_follow_the_input():
    assert ngram_join.ranges(10, 8) == 8 and ngram_join.ranges(15_000_000, 8) == 10
