import random
import zlib

import numpy as np

from skein.llm import languages, quality, queries, topk

FOX = {"en": "the quick brown fox jumps over the lazy dog and the other animals of the house", "de": "der schnelle braune fuchs springt über den faulen hund und die anderen tiere des hauses"}


def test_parse_counts_equal_a_direct_search():
    rnd = random.Random(1)
    learned = tuple((k, t * 3) for k, t in sorted(FOX.items()))
    p = languages.Parser(learned)
    texts = ["".join(rnd.choice("the quick fuchß? Ω") for _ in range(rnd.randint(1, 3000))) for _ in range(20)]
    texts += [t * 20 for t in FOX.values()] + [" ".join(learned[i % 2][1][i * 7 :] for i in range(20)), ""]
    counts, _ = p.phrases(texts)
    for n, (_, sample) in enumerate(learned):
        known = "".join(map(chr, p.codes([sample])[0]))
        for i, t in enumerate(texts):
            codes, made = "".join(map(chr, p.codes([t])[0])), 0
            at = 0
            while at < len(codes):
                to = at + 1
                while to <= len(codes) and codes[at:to] in known:
                    to += 1
                at, made = max(at + 1, to - 1), made + 1
            assert made == counts[n, i]


def test_languages_of_odd_rows(spark):
    rows = [(i, t, k) for k, t in FOX.items() for i in range(8)] + [(50, None, "en"), (51, "123 ...", "en"), (52, "Der Fuchs und das Haus", None), (None, "the house of the dog", None), (50, "over the dog", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = languages.identify(docs)
    assert got.count() == len(rows)
    by = {(r["doc_id"], r["lang_pred"]) for r in got.collect()}
    assert {(50, "und"), (51, "und"), (52, "de"), (None, "en"), (50, "en")} <= by
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got.collect())
    assert languages.recognised(docs).count() == len(rows) - 2
    assert {r["lang_pred"] for r in languages.identify(docs.where("lang is null")).collect()} == {"und"}
    assert languages.identify(docs.where("false")).count() == 0


def test_a_language_is_learned_from_its_texts_with_letters(spark):
    docs = spark.createDataFrame([(i, "123 ...", "en") for i in range(50)] + [(50, FOX["en"], "en"), (51, FOX["de"], "de")], "doc_id long, text string, lang string")
    assert languages.sample(docs, most_docs=1) == (("de", FOX["de"]), ("en", FOX["en"]))


def test_every_language_is_learned_within_the_bounds(spark):
    rows = [(i, f"alpha beta l{i} " * 4, f"l{i:03d}") for i in range(300)] + [(400 + i, "gamma " * 100, "l000") for i in range(50)] + [(500, "delta " * 9000, "l001"), (501, "eta " * 9000, "long")]
    learned = dict(languages.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), chars=1000, total=10**6))
    assert len(learned) == 301 and learned["long"] == "eta " * 9000 and "delta" not in learned["l001"] and 1000 <= len(learned["l000"]) < 1700


def test_a_sample_is_bounded_however_many_labels_and_long_texts(spark):
    rows = [(i, f"alpha beta {i} " * 40, f"l{i % 1500:04d}") for i in range(3000)] + [(5000 + i, "theta " * 30, "most") for i in range(9)] + [(6000, "eta " * 90_000, "long"), (6001, "iota", "long"), (6002, "eta " * 90_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = dict(languages.sample(docs, chars=1000, total=10_000, most_languages=100))
    assert len(learned) == 100 and {"most", "long", "l0000", "l0097"} <= set(learned) and "l0098" not in learned
    assert max(map(len, learned.values())) <= 100 + 64 and learned["l0000"].startswith("alpha beta")
    only = languages.sample(docs.where("doc_id = 6000"), chars=1000, total=10_000)
    assert only == (("long", ("eta " * 90_000)[:10_000]),)


def test_rows_laid_over_each_other_lead_where_a_matrix_leads():
    rnd = random.Random(3)
    for symbols, length in ((2, 50), (6, 4000), (700, 5000), (60, 1)):
        edges = languages.SuffixAutomaton([int(symbols * rnd.random() ** 3) for _ in range(length)]).next
        dense, laid = languages.Dense(edges, symbols + 2), languages.Displaced(edges, symbols + 2)
        a, b = np.full(9, dense.start, np.int32), np.full(9, laid.start, np.int32)
        for _ in range(3000):
            column = np.array([int((symbols + 2) * rnd.random() ** 3) for _ in range(9)], np.uint16)
            (a, lost), (b, failed) = dense.step(a, column), laid.step(b, column)
            assert (a == b * (symbols + 2)).all() and (lost == failed).all()
    full = [{c: 0 for c in range(0, 400, 2)} for _ in range(300)]
    laid = languages.Displaced(full, 400)
    every = np.repeat(np.arange(300, dtype=np.int32), 400)
    assert (laid.step(every, np.tile(np.arange(400, dtype=np.uint16), 300))[1] == np.tile([0, -1], 60_000)).all()


def test_tables_of_many_letters_are_small():
    rnd = random.Random(5)
    letters = [chr(0x4E00 + i) for i in range(10_000)]
    learned = tuple((f"l{k}", "".join(letters[2500 * k + int(2500 * rnd.random() ** 2)] for _ in range(20_000))) for k in range(4))
    model = languages.Parser(learned)
    size = sum(x.nbytes for t in model.tables for x in vars(t).values() if isinstance(x, np.ndarray))
    assert size < 50_000_000
    assert [p[0] for p in model.predict([t[100:400] for _, t in learned])] == ["l0", "l1", "l2", "l3"]


def test_choice_and_score_equal_a_direct_parse(spark):
    rnd = random.Random(8)
    texts = {**FOX, "nl": "de snelle bruine vos springt over de luie hond en de andere dieren van het huis"}
    rows = [(i, " ".join(rnd.sample(t.split(), 9)), k) for k, t in texts.items() for i in range(rnd.randint(0, 5), 90, 7)]
    rows += [(200 + i, " ".join(rnd.sample(" ".join(texts.values()).split(), 6)), None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = languages.sample(docs.where(~languages.held_out()))
    clean = lambda t: "".join(c if c.isalpha() else " " for c in t.lower() + " ")
    known = {k: " ".join(clean(t).split()) + " " for k, t in learned}
    want = []
    for doc, text, _ in rows:
        left, entropy = " ".join(clean(text).split()) + " ", {}
        for k, sample in known.items():
            at = made = 0
            while at < len(left):
                to = at + 1
                while to <= len(left) and left[at:to] in sample:
                    to += 1
                at, made = max(at + 1, to - 1), made + 1
            entropy[k] = made * np.log2(len(sample)) / len(left)
        first, second = sorted(entropy, key=lambda k: (entropy[k], k))[:2]
        want.append((doc, first, round(entropy[second] / (entropy[first] + entropy[second]), 9)))
    got = sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in languages.identify(docs).collect())
    assert got == sorted(want)


def test_recognised_texts_carry_their_language(spark):
    docs = [(i, f"{t} {t[i:]}", k, 1) for k, t in FOX.items() for i in range(30)]
    odd = [(70, "съешь же ещё этих мягких французских булок " * 9, None, 1), (71, FOX["de"], None, 1), (72, None, None, 1), (73, "", None, 1), (None, "house of the dog", None, 1), (71, FOX["de"], None, 1), (74, "lazy", None, 1)]
    kept = languages.recognised(spark.createDataFrame(docs + odd, "doc_id long, text string, lang string, entropy long"))
    assert kept.columns == ["doc_id", "text", "lang", "entropy"]
    got = [(r["doc_id"], r["lang"]) for r in kept.collect() if r["doc_id"] is None or r["doc_id"] >= 70]
    assert sorted(got, key=str) == sorted([(71, "de"), (71, "de"), (None, "en"), (74, "en")], key=str)
    assert languages.recognised(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_languages_with_clashing_columns_and_a_very_long_text(spark):
    rows = [(i, t, k, 1.5, "x") for k, t in FOX.items() for i in range(8)] + [(9, FOX["de"] * 3000, None, 0.0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    assert [r["lang_pred"] for r in languages.identify(docs).where("doc_id = 9").collect()] == ["de"]


def test_language_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = queries.op4_language_id(spark, sf).where("held_out").join(truth, "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = queries.op10_quality(spark, sf).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["quality"] == r["predicted"] for r in rows]) > 0.94


def test_quality_of_odd_rows(spark, make):
    docs = make([(1, "fine words here"), (2, None), (3, " "), (None, "x"), (1, "fine words here")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (77, 0)], "doc_id long, quality int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality.classify(docs, labels.where("false")).collect()} == {0.5}
    assert quality.classify(docs.where("false"), labels).count() == 0


def test_labels_of_absent_documents_use_up_no_rows(spark, make):
    docs = make([(k, "good fine words" if k % 2 else "bad poor junk") for k in range(20)])
    labels = spark.range(3000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    model = quality.train(docs, labels, most_rows=20)
    want = quality.fit([("good fine words" if k % 2 else "bad poor junk", k % 2) for k in range(20)])
    assert model.bias == want.bias and np.array_equal(model.share, want.share)


def test_word_shares_give_the_score_of_the_average():
    model = quality.fit([("good text here", 1), ("bad *** text", 0)] * 5, epochs=3)
    buckets, weight = quality.bag("good text here here")
    direct = float(weight @ model.share[buckets])
    words = "good text here here".split()
    assert abs(direct - np.mean(model.words(words))) < 1e-9


def test_sliced_index_never_loses_a_top_row():
    rng = np.random.default_rng(0)
    for n, scale in ((1, 20), (70, 3), (3000, 20), (3000, 200)):
        code = rng.normal(0, scale, (n, 16)).round().astype(np.int64)
        code[: n // 3] = code[0]
        index = topk.SlicedIndex(code)
        for q in code[:: max(1, n // 20)]:
            score = code @ q
            want = np.lexsort((np.arange(n), -score))[:21]
            rows = index.top(q, 21)
            assert (rows[np.lexsort((rows, -score[rows]))[:21]] == want).all()


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 0.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, k=2).collect())
    assert got == [(0, 1, 1, 4096), (0, 2, 2, 4096), (20, 1, 0, 4096), (20, 2, 1, 4096)]
    assert topk.top_k(df.where("false")).count() == 0


def test_top_k_with_clashing_columns_and_many_ties(spark):
    rng = np.random.default_rng(2)
    codes = rng.integers(-3, 4, (9000, 4))
    df = spark.createDataFrame([(i, (c / 64).tolist(), 1, 2, "x") for i, c in enumerate(codes)], "vec_id long, embedding array<double>, bundle int, side int, code string")
    got = {}
    for r in topk.top_k(df, k=5, every=300).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for q in range(0, 9000, 300):
        score = codes @ codes[q]
        want = [i for i in np.lexsort((np.arange(9000), -score))[:6] if i != q][:5]
        assert [got[q][r + 1] for r in range(5)] == [(i, score[i]) for i in want]
    assert len(got) == 30


def test_training_is_bounded_in_rows_of_an_id_and_in_bytes(make, spark):
    texts = [(k, "good fine words" if k % 2 else "bad poor junk") for k in range(20)]
    docs = make(texts + [(3, "zzz other") for _ in range(500)] + [(50, "x " * 100_000)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(3, 0), (50, 1)], "doc_id long, quality int")
    rows = [(t, y % 2) for y, t in texts]
    model = quality.train(docs, labels.where("doc_id < 50"))
    assert np.array_equal(model.share, quality.fit(rows).share)
    # The long text takes all bytes at its place in the order: what comes before it stays.
    order = [r["doc_id"] for r in labels.select("doc_id").distinct().selectExpr("doc_id", "xxhash64(doc_id) h").orderBy("h", "doc_id").collect()]
    before = sorted(order[: order.index(50)])
    bounded = quality.train(docs, labels, most_bytes=100_000)
    assert np.array_equal(bounded.share, quality.fit([rows[k] for k in before]).share if before else np.zeros(quality.BUCKETS))
    assert np.array_equal(quality.train(docs, labels, most_bytes=0).share, np.zeros(quality.BUCKETS))


def test_scores_of_a_table_equal_the_model_applied_to_each_text(make, spark):
    rnd = np.random.default_rng(4)
    words = ["good", "fine", "bad", "poor", "été", "x" * 40, "***"]
    rows = [(k, " ".join(rnd.choice(words, rnd.integers(0, 12)))) for k in range(60)] + [(60, None), (61, ""), (None, "good bad"), (5, "good poor"), (62, "long words " * 60_000)]
    labels = [(k, int("good" in t and "bad" not in t)) for k, t in rows[:60]] + [(61, 0), (99, 1), (4, None)]
    got = quality.classify(make(rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    learned = {}
    for k, y in labels:
        if y is not None and k != 99 and zlib.crc32(str(k).encode()) % 5:
            learned[k] = max(y, learned.get(k, 0))
    smallest = {}
    for k, t in rows:
        if k is not None:
            smallest[k] = min(t or "", smallest.get(k, t or ""))
    model = quality.fit([(smallest[k], learned[k]) for k in sorted(learned)])

    def direct(text):
        own = (text or "").split()
        if not own:
            return 1 / (1 + np.exp(-model.bias))
        buckets, weight = quality.bag(text)
        return 1 / (1 + np.exp(-(model.share[buckets] @ weight + model.bias)))

    want = sorted((str(k), round(float(direct(t)), 9)) for k, t in rows)
    assert sorted((str(r["doc_id"]), round(r["score"], 9)) for r in got) == want
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
