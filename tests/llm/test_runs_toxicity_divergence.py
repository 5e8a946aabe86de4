"""Periodic runs, toxicity and source divergence against brute force and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagerecs.llm import divergence, registry, runs, toxicity
from pagerecs.llm.common import held_out

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_runs long, score double, _text string, value long"
LONG = " ".join(f"w{i % 313}" for i in range(5000))
ODD = [
    (1, None, "en", "s", 1, 1.0, "k", 1),
    (2, "", None, "s", 1, 1.0, "k", 1),
    (3, " \n\t ", "en", None, 1, 1.0, "k", 1),
    (4, "la la la la la la", "en", "s", 1, None, "k", 1),
    (4, "la la la la la la", "en", "s", 1, None, "k", 1),
    (5, "12 34 !!", "en", "s", 1, 1.0, None, 1),
    (None, "a null id  with\n\nspaces and é ü", "de", "s", 1, 1.0, "k", 1),
    (8, LONG, "en", "s", 1, 1.0, "k", 1),
    (9, "héé " * 7 + "\x1c \x85 x", "", "", 1, 1.0, "k", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def all_runs(w):
    """Every run, from its definition."""
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - start
            smallest = not any(all(w[start + k] == w[start + k + d] for k in range(n - d)) for d in range(1, q))
            if n >= max(6, 4 * q) and smallest:
                found.append((start, n, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected_runs(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = all_runs(w)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    rest = sha(" ".join(x for i, x in enumerate(w) if i not in dropped))
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), rest)


def test_runs_of_random_words_equal_the_definition():
    rng = random.Random(7)
    for _ in range(3000):
        w = [b"abcd"[k : k + 1] for k in rng.choices(range(rng.randint(1, 4)), k=rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            if w:
                at, q = rng.randrange(len(w)), rng.randint(1, 8)
                w[at:at] = w[at : at + q] * rng.randint(3, 6)
        assert runs.document_runs(w) == all_runs(w)


def test_last_ends_are_those_of_every_suffix():
    rng = random.Random(8)
    for _ in range(200):
        w = rng.choices(range(3), k=40)
        tree = runs.LastEnds()
        for end, word in enumerate(w):
            tree.append(word)
            for before, equal in tree.access(end):
                assert w[before - equal + 1 : before + 1] == w[end - equal + 1 : end + 1]
                assert before - equal < 0 or w[before - equal] != w[end - equal]


def test_runs_of_a_table_equal_the_definition(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    short = {d for d, t in docs.items() if len(t or "") < 4000}
    found = [r for r in registry.op11_periodic_runs(spark, SF).collect() if r.doc_id in short]
    assert len(found) == len(short) and sum(r.n_runs > 0 for r in found) > 5
    for r in found:
        assert tuple(r)[1:] == expected_runs(r.doc_id, docs[r.doc_id]), r.doc_id


def test_runs_of_odd_rows(odd, empty):
    rows = runs.find_runs(odd).collect()
    assert runs.find_runs(odd).columns[:6] == ["doc_id", "lang", "source", "score", "_text", "value"]
    by_text = {(d[0], d[1]): expected_runs(0, d[1]) for d in ODD}  # crc32 of "0" leaves a text as it is
    assert zlib.crc32(b"0") % 10
    texts = Counter((r.doc_id, tuple(r)[6:]) for r in rows)
    assert texts == Counter((d[0], by_text[d[0], d[1]]) for d in ODD)
    assert runs.find_runs(empty).count() == 0
    altered = runs.find_runs(odd.select("doc_id", "text"), altered=runs.periodic_copy).collect()
    assert Counter(tuple(r) for r in altered) == Counter((d[0], *expected_runs(d[0], d[1])) for d in ODD)


def test_a_long_periodic_text_is_whole():
    words = [b"%d" % (i % 5000) for i in range(40_000)]
    assert runs.document_runs(words) == [(0, 40_000, 5000)]


def test_machine_learns_pairs_that_no_sum_of_weights_has():
    """Two terms that mean 1 together and 0 each alone, in equal shares."""
    rng = np.random.default_rng(5)
    documents, labels = [], []
    for k in range(2400):
        a, b = k % 2, k // 2 % 2
        noise = rng.choice(np.arange(100, 160), 8, replace=False)
        documents.append(np.unique(np.r_[noise, [1] * a, [2] * b].astype(np.int64)))
        labels.append(float(a and b))
    model = toxicity.train(documents[:2000], np.array(labels[:2000]))
    rows = np.repeat(np.arange(400), [len(d) for d in documents[2000:]])
    scores = toxicity.sigmoid(model.logits(rows, np.concatenate(documents[2000:]), 400))
    assert ((scores >= 0.5) == np.array(labels[2000:], bool)).all()
    at = np.searchsorted(model.buckets, [1, 2])
    assert (model.factors[at[0]] * model.factors[at[1]]).sum() * model.values[at].prod() > 0.05


def test_logits_equal_the_sum_over_all_pairs():
    rng = np.random.default_rng(6)
    model = toxicity.Model(0.3, np.array([2, 5, 9, 11]), rng.normal(size=4), rng.normal(size=4), rng.normal(size=(4, 4)))
    document = np.array([2, 3, 9, 11])
    at = [0, 2, 3]
    want = 0.3 + sum(model.weights[i] * model.values[i] for i in at)
    for x, i in enumerate(at):
        for j in at[x + 1 :]:
            want += (model.factors[i] @ model.factors[j]) * model.values[i] * model.values[j]
    got = model.logits(np.r_[np.zeros(4, int), 2], np.r_[document, 4], 3)
    assert np.allclose(got, [want, 0.3, 0.3])


def test_features_are_terms_and_their_beginnings():
    def of(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return set(toxicity.features(data, np.array([0, len(data)]))[1].tolist())

    assert of("Idiot!") == of("idiot idiot") and len(of("idiot")) == 3
    assert len(of("idiots") & of("idiotic")) == 2 and len(of("abc")) == 1 and of("12 _") == set()
    data = np.frombuffer("abcdef".encode(), np.uint8)
    rows, _ = toxicity.features(data, np.array([0, 3, 3, 6]))  # rows end terms
    assert Counter(rows.tolist()) == {0: 1, 2: 1}


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = registry.op12_toxicity(spark, sf).where("held_out").join(labels, "doc_id").collect()
    right = Counter((r.toxic, r.predicted) for r in rows)
    assert right[0, 1] <= 0.01 * (right[0, 0] + right[0, 1])
    assert right[1, 1] >= 0.85 * (right[1, 0] + right[1, 1])


def test_toxicity_of_odd_rows(odd, empty):
    labelled = odd.withColumn("toxic", F.when(F.col("doc_id") == 4, 1).otherwise(0))
    model = toxicity.fit(labelled)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    blank = [r.score for r in rows if r.doc_id in (1, 2, 3, 5)]
    assert len(set(blank)) == 1
    assert toxicity.fit(labelled.limit(0)) is None and toxicity.fit(labelled.where("toxic = 2")) is None
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.5}
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.score(odd, model).columns == [c for c in odd.columns if c != "score"] + ["score", "predicted"]


def test_training_sample_is_bounded_under_copies(spark):
    copies = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same words").alias("text"))
    labelled = copies.withColumn("toxic", (F.col("doc_id") % 2).cast("int"))
    seen = []
    real = toxicity.train
    toxicity.train = lambda documents, labels: seen.append((len(documents), labels.mean())) or real(documents, labels)
    try:
        toxicity.fit(labelled, rows=200)
    finally:
        toxicity.train = real
    assert seen[0][0] == 200 and 0.3 < seen[0][1] < 0.7


def audit_of(rows, least):
    """(lang, source, part, item, value, rank) from the definition."""
    given = [(r[2] or "", r[3] or "", r[1] or "") for r in rows]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    documents, n = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in given:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(low))
        documents[lang].update(set(terms))
        n[lang, source].update(terms)
    found = []
    for lang in documents:
        kept = [t for t, c in documents[lang].items() if c >= least]
        sources = [s for g, s in n if g == lang]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 2) // total for t in kept}

        p = {s: shares(n[lang, s]) for s in sources}
        q = shares(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [
                ((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t]), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]
            ]
            for part, values in (("pair", pairs), ("term", terms)):
                values.sort(key=lambda v: (-v[0], v[1].encode()))
                some = values if part == "pair" else values[:10]
                found += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(some, 1)]
    return Counter(found)


@pytest.mark.parametrize("first,cells", [(6, 1 << 21), (1, 40)])
def test_audit_equals_the_definition(spark, monkeypatch, first, cells):
    monkeypatch.setattr(divergence, "FIRST_LEVEL", first)
    monkeypatch.setattr(divergence, "BLOCK_CELLS", cells)
    monkeypatch.setattr(divergence.surviving_terms, "__defaults__", (10, first))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = [tuple(r) for r in docs.collect()]
    found = divergence.audit(docs).collect()
    assert Counter(tuple(r) for r in found) == audit_of(rows, 10)


def test_audit_of_odd_rows(spark, odd, empty):
    for least in (1, 2, 99):
        found = divergence.audit(odd, least=least).collect()
        assert Counter(tuple(r) for r in found) == audit_of(ODD, least)
    assert divergence.audit(empty).count() == 0


def test_prefixes_below_the_threshold_are_discarded(spark):
    rows = [(k, f"alpha{chr(97 + k)} betamax", "en", "s") for k in range(12)] + [(99, "alpha alphab " * 50, "en", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    seen = []
    real = divergence._level
    divergence._level = lambda docs, width, bitmap: seen.append((width, rows := real(docs, width, bitmap))) or rows
    try:
        complete = divergence.surviving_terms(docs, least=10, first=2)
    finally:
        divergence._level = real
    # al, be | alph, beta | betamax, complete: alpha? and alphab have too few documents each
    assert [(w, r.where("documents >= 10").count()) for w, r in seen] == [(2, 2), (4, 2), (8, 1)]
    assert [r.term for r in divergence.term_counts(docs, complete).collect()] == ["betamax"]


def test_shares_are_exact_beyond_nine_billion():
    count, total = np.array([7 * 10**14 + 3]), np.array([9 * 10**14 + 1])
    assert divergence.scaled_share(count, total)[0] == 1 + 10**9 * int(count[0]) // int(total[0])


def test_new_queries_count_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", held_out(F.col("doc_id"), 0))
    want = Counter((r.doc_id, r.held_out) for r in docs.collect())
    found = registry.op12_toxicity(spark, SF).collect()
    assert Counter((r.doc_id, r.held_out) for r in found) == want
