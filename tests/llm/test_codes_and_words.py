import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import quality_rules, spelling, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, pos long, entry long, code string"


def lloyd(vectors, parts, entries, rounds, scale):
    v = np.array([[int(np.floor(np.float64(np.float32(x)) * scale)) for x in r] for r in vectors])
    p = v.reshape(len(v), parts, -1).transpose(1, 0, 2)
    book = p[:, :entries].copy()
    for k in range(rounds + 1):
        far = ((p[:, :, None, :] - book[:, None]) ** 2).sum(-1)
        at = far.argmin(-1)
        if k < rounds:
            for i in range(parts):
                for e in range(book.shape[1]):
                    if (at[i] == e).any():
                        book[i, e] = p[i][at[i] == e].sum(0) // (at[i] == e).sum()
    return at.T, far.min(-1).sum(0), book


def table(spark, rows):
    return spark.createDataFrame([(k, v, y, 1, 2, "x") for k, v, y in rows], VECTORS).repartition(3)


def test_codes_equal_rounds_by_hand(spark):
    rnd = np.random.default_rng(5)
    rows = [(k, (rnd.normal(size=16) * (3 if k % 3 else 0.01)).round(3).tolist(), k % 4 if k % 5 else None) for k in range(150)]
    rows += [(200 + k, rows[7][1], 1) for k in range(60)]
    odd = [(1000, None, 1), (1001, [], 1), (1002, [None] + [0.1] * 15, 1), (1003, [float("nan")] * 16, 1), (1004, [float("inf")] * 16, 1), (1005, [1.0] * 15, 1), (1006, [1.0] * 8, 1)]
    got = {r["vec_id"]: r for r in vector_codes.compress(table(spark, rows + odd), parts=4, entries=6, rounds=5).collect()}
    at, error, book = lloyd([v for _, v, _ in rows], 4, 6, 5, 4096)
    of_label = Counter()
    for (_, _, y), e in zip(rows, error):
        of_label[y] += int(e)
    assert len(got) == len(rows)
    for (k, _, y), a, e in zip(rows, at, error):
        assert (got[k]["code"], got[k]["error"], got[k]["label_error"]) == ("".join(f"{i:02x}" for i in a), e, of_label[y])
    assert {r["codebooks_sha256"] for r in got.values()} == {vector_codes.digest(book)}


def test_codes_of_ties_repeats_few_rows_and_none(spark):
    assert vector_codes.compress(table(spark, [])).collect() == []
    assert vector_codes.compress(table(spark, [(1, None, 0)])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    same = [(None, [0.5] * 8, None), (3, [0.5] * 8, None), (3, [0.5] * 8, None), (4, [0.5] * 8, 1)]
    got = vector_codes.compress(table(spark, same)).collect()
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in got) == [(k, "00" * 8, 0, 0) for k in ("3", "3", "4", "None")]
    huge = vector_codes.compress(table(spark, [(k, [(-1.0) ** k * 3e38] * 16, 1) for k in range(40)]), entries=1).collect()
    assert len(huge) == 40 and all(0 <= r["error"] <= r["label_error"] for r in huge)


def test_only_members_that_change_their_entry_are_shuffled(spark):
    rows = vector_codes.integers(table(spark, [(k, [float(k)] * 8, 0) for k in range(40)]), "vec_id", "embedding", "label", 1.0, 8)
    members = rows.selectExpr("0 pos", "-1 entry", "0 salt", "slice(v, 1, 1) part")
    first = vector_codes.assigned(members, np.array([[[0], [30]]])).cache()
    assert first.where("moved").count() == 40
    second = vector_codes.assigned(vector_codes.migrated(first), np.array([[[0], [40]]]))
    assert sorted(r["part"][0] for r in second.where("moved").collect()) == [16, 17, 18, 19, 20]


def apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants(rows, least=7, occurrences=2, times=10, every=31):
    n = Counter()
    for k, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    kept = {w: c for w, c in n.items() if len(w) >= least and c >= occurrences}
    near = {w: [x for x in kept if apart(w, x)] for w in kept}
    form = {w: min(((-kept[x], x) for x in near[w] if kept[x] >= times * kept[w]), default=(0, None))[1] for w in kept}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (kept[w], len(near[w]), form[w], kept.get(form[w]), root(w)) for w in kept}


def grouped(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def test_variants_equal_brute_force(make):
    rnd = random.Random(2)
    letters = "abcdé×ÿ"
    texts = []
    for _ in range(60):
        w = "".join(rnd.choice(letters) for _ in range(rnd.randint(6, 12)))
        texts += [w.upper() if rnd.random() < 0.2 else w] * rnd.choice([1, 2, 30, 400])
        for _ in range(12):
            i, x = rnd.randrange(len(w)), rnd.choice(letters)
            texts += [rnd.choice([w[:i] + w[i + 1 :], w[:i] + x + w[i:], w[:i] + x + w[i + 1 :], w + x, x + w])] * rnd.choice([1, 2, 3, 25])
    rnd.shuffle(texts)
    rows = [(k, rnd.choice([" ", "1", "\n", "ŭ"]).join(texts[k::40])) for k in range(40)] + [(40, None), (41, ""), (None, "abcdabcd " * 3), (7, "again again again"), (7, "again again again")]
    assert grouped(spelling.group(make(rows))) == variants(rows)
    assert grouped(spelling.group(make(rows), every=2, times=2)) == variants(rows, every=2, times=2)


def test_variants_of_a_common_beginning_of_long_words_and_of_nothing(make):
    assert grouped(spelling.group(make([]))) == {}
    assert grouped(spelling.group(make([(1, None), (2, "1 2 three")]))) == {}
    rnd = random.Random(4)
    hot = ["beginning" + "".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(800)]
    rows = [(1, " ".join(hot * 2)), (2, ("z" * 30_000 + " ") * 2), (3, ("z" * 29_999 + " ") * 2)]
    assert grouped(spelling.group(make(rows))) == variants(rows)


def histograms(rows, common, least):
    words = {}
    chars = {}
    for _, text, lang in rows:
        for key in {lang, None}:
            words.setdefault(key, Counter()).update(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
            chars.setdefault(key, Counter()).update(map(kind, text or ""))
    out = {}
    for key, n in words.items():
        total = sum(n.values())
        top = {w: c / total for w, c in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:common]}
        if key is None or total >= least:
            out[key] = top | {None: 1 - sum(top.values())}, {k: c / max(1, sum(chars[key].values())) for k, c in chars[key].items()}
    return out


def kind(c):
    import unicodedata

    u = unicodedata.category(c)
    return "space" if c in " \t\n\x0b\x0c\r" else {"Lu": "upper"}.get(u, u[0] if u[0] in "NPS" else "")


def far(p, q):
    total = 0.0
    for k in {*p, *q}:
        a, b = p.get(k, 0), q.get(k, 0)
        total += sum(x * np.log2(2 * x / (a + b)) for x in (a, b) if x > 0) / 2
    return float(np.sqrt(max(total, 0)))


def judged(rows, least_reference):
    known = histograms(rows, quality_rules.COMMON, least_reference)
    out = []
    for k, text, lang in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen = Counter(zip(w, w[1:], w[2:]))
        repeated = len({i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)})
        common, classes = known.get(lang, known[None])
        n, c = Counter(x if x in common else None for x in w), Counter(map(kind, text))
        wd = far({x: y / len(w) for x, y in n.items()}, common) if len(w) >= 50 else None
        cd = far({x: y / len(text) for x, y in c.items()}, classes) if len(text) >= 200 else None
        failed = len(w) < 50 or 100 * repeated > 50 * len(w)
        odd = (cd or 0) > 0.25 or (wd or 0) > 0.15 + np.sqrt(33 / (8 * np.log(2) * max(1, len(w))))
        out.append((k, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), repeated, failed, not failed and not odd, cd and round(cd, 6), wd and round(wd, 6)))
    return out


def pages(seed):
    rnd = random.Random(seed)
    prose = lambda words, n: " ".join(rnd.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))
    one, two = [f"w{''.join(rnd.choices('abcdef', k=4))}" for _ in range(300)], [f"é{''.join(rnd.choices('uvwxyz', k=4))}" for _ in range(300)]
    rows = [(k, prose(one, rnd.randint(40, 300)).capitalize() + ".\n" + prose(one, 20), "aa") for k in range(60)]
    rows += [(100 + k, prose(two, rnd.randint(40, 300)), "bb") for k in range(30)]
    rows += [(200, prose(one, 100).upper() + " !!", "aa"), (201, " | ".join(one[200:290]), "aa"), (202, "same same " * 60, "aa"), (203, "a b c\na b c\n \n\n", "aa"), (204, None, "aa"), (205, "", None), (206, prose(one, 120), None), (207, prose(two, 120), "rare"), (208, " " + prose(two, 70) + "　", "bb")]
    return rows + [rows[3], (3, "another text of the id", "aa"), (None, prose(one, 80), "aa")]


@pytest.mark.parametrize("place", [24, 60])
def test_rules_equal_the_stated_ones(spark, monkeypatch, place):
    """With 4 bits of hash, neighbours of one hash differ and the texts are sorted."""
    monkeypatch.setattr(quality_rules, "PLACE", place)
    rows = pages(1)
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, lang string, n_words long, score double").repartition(3)
    got = sorted(map(str, map(tuple, quality_rules.judge(df, least_reference=500).collect())))
    assert got == sorted(map(str, judged(rows, 500)))


@pytest.mark.parametrize("lengths", [[1], [3, 31], range(128, 1024, 8)])
def test_common_words_are_found_in_slots_and_without(spark, monkeypatch, lengths):
    """In one slot, words come together, so that each is looked up."""
    monkeypatch.setattr(quality_rules, "SLOTS", lengths)
    rows = [(k, text and text.replace("w", ".*").replace("a", "\\E|("), lang) for k, text, lang in pages(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = sorted(map(str, map(tuple, quality_rules.judge(df, least_reference=500).collect())))
    assert got == sorted(map(str, judged(rows, 500)))


def test_a_word_is_not_compared_with_each_common_word(spark, tmp_path):
    """Finding common words takes a few times as long as reading the words; comparing each with 32 took 7.7 times as long."""
    word = lambda i: F.substring(F.hex(F.xxhash64("id", i)), 1, 4)
    spark.range(400).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(5000)), word), " ").alias("text"), F.lit("aa").alias("lang")).write.parquet(f"{tmp_path}/texts")
    texts = spark.read.parquet(f"{tmp_path}/texts")
    texts.select(quality_rules.words_of(F.col("text")).alias("w"), F.lit(5000).alias("n_words")).write.parquet(f"{tmp_path}/words")
    known = quality_rules.common_words(texts, 32, 0).where("lang is null").drop("lang")
    known.write.parquet(f"{tmp_path}/known")
    words = spark.read.parquet(f"{tmp_path}/words").crossJoin(F.broadcast(spark.read.parquet(f"{tmp_path}/known")))

    def seconds(df):
        took = []
        for _ in range(4):
            began = time.time()
            df.write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        return min(took)

    assert seconds(quality_rules.with_word_distance(words, 50)) < 5 * seconds(words)


def test_rules_keep_clean_texts_and_drop_odd_ones(spark):
    rows = pages(2)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(df, least_reference=500).collect() if not r["base_failed"]}
    assert not kept[200] and not kept[201]
    assert all(v for k, v in kept.items() if k is not None and k < 200)


def test_rules_of_nothing_and_of_a_very_long_text(spark):
    schema = "doc_id long, text string, lang string"
    assert quality_rules.judge(spark.createDataFrame([], schema)).collect() == []
    long = [(1, " ".join(f"word{i}" for i in range(200_000)), "aa"), (2, "x" * 1_000_000, "aa"), (3, "ab " * 100_000, None)]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(long, schema)).collect()}
    assert (got[1]["n_words"], got[1]["n_repeat_words"], got[2]["n_words"], got[3]["n_repeat_words"]) == (200_000, 0, 1, 100_000)


def test_rules_use_no_python(spark, sf):
    plan = quality_rules.judge(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
