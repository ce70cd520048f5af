import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from skein.llm import decontaminate, near_dup
from skein.llm.common import Stages


def bag(text):
    w = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def corpus(seed=1):
    rnd = random.Random(seed)
    draw = lambda n: [f"w{rnd.randint(0, 3000)}" for _ in range(n)]
    texts = []
    for _ in range(12):
        base = draw(rnd.choice([20, 60, 150]))
        texts.append(" ".join(base))
        for _ in range(rnd.choice([1, 3, 8])):
            copy = list(base)
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(len(copy))] = draw(1)[0]
            texts.append(" ".join(copy).upper() if rnd.random() < 0.3 else " ".join(copy))
    texts += [" ".join(draw(50)) for _ in range(20)] + ["a b", "A, b!", "a b c", "", None, "?!", "z " * 40, "z " * 42]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def brute_classes(rows):
    parent = {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [(k, bag(t)) for k, t in rows]
    for i, (a, x) in enumerate(bags):
        for b, y in bags[i + 1 :]:
            if x == y or similarity(x, y) >= 0.8:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k, _ in rows}


def test_classes_equal_brute_force(make):
    rows = corpus()
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(make(rows)).collect()}
    assert got == brute_classes(rows)


def test_deduplication_keeps_one_row_of_each_class(make):
    rows = corpus() + [(None, "null id"), (None, "null id"), (0, corpus()[0][1])]
    kept = near_dup.deduplicated(make(rows))
    assert kept.columns == make(rows).columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids.pop(None) == 1
    assert ids == Counter(set(brute_classes(corpus()).values()))


def test_rows_with_one_id_are_one_document(make):
    got = {(r["doc_id"], r["class_id"]) for r in near_dup.classes(make([(5, "one two three four five six"), (5, "other words entirely here now ok"), (3, "other words entirely here now ok")])).collect()}
    assert got == {(5, 3), (3, 3)}


def test_a_text_of_a_document_with_several_texts_keeps_its_links(make):
    rnd = random.Random(2)
    a, b, c = ([f"{x}{rnd.randint(0, 999)}" for _ in range(60)] for x in "abc")
    near = [*b[:30], "changed", *b[31:]]
    join = " ".join
    for one, other in ((a, b), (b, a)):
        rows = [(5, join(one)), (5, join(other)), (7, join(b)), (9, join(near)), (3, join(c)), (11, join(c)), (11, join(a).upper()), (20, "alone here")]
        got = {(r["doc_id"], r["class_id"]) for r in near_dup.classes(make(rows)).collect()}
        assert got == {(5, 3), (7, 3), (9, 3), (3, 3), (11, 3), (20, 20)}
        without = {(r["doc_id"], r["class_id"]) for r in near_dup.classes(make(rows[2:])).collect()}
        assert without == {(7, 7), (9, 7), (3, 3), (11, 3), (20, 20)}


def test_texts_of_one_hot_id_are_one_document(spark):
    """One id with 3,000 texts, of which one is a near copy of another document."""
    body = "array_join(transform(sequence(0, 39), j -> concat('t', id, 'w', j)), ' ')"
    docs = spark.range(3000).selectExpr("7L as doc_id", f"{body} as text").union(spark.range(5, 6).selectExpr("2L", f"concat({body}, ' end')")).union(spark.range(9000, 9050).selectExpr("id", body))
    got = {tuple(r) for r in near_dup.classes(docs).distinct().collect()}
    assert got == {(7, 2), (2, 2)} | {(i, i) for i in range(9000, 9050)}


def test_a_very_long_text_and_its_near_copy(make):
    rnd = random.Random(6)
    long = [f"w{rnd.randint(0, 10**6)}" for _ in range(300_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[2000:])), (3, "w " * 400_000), (4, "w " * 390_000), (5, " ".join(long[:9000]))]
    assert {tuple(r) for r in near_dup.classes(make(rows)).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)}


def test_near_duplicates_of_an_empty_table(make):
    assert near_dup.classes(make([(1, "a")]).where("false")).count() == 0


def test_links_hold_and_join_the_classes(make):
    rows = corpus(3)
    firsts, pairs = near_dup.linked(make(rows))
    first, bags, want = {r["doc_id"]: r["first"] for r in firsts.collect()}, {k: bag(t) for k, t in rows}, brute_classes(rows)
    found = {(r["a"], r["b"]) for r in pairs.collect()}
    assert all(similarity(bags[a], bags[b]) >= 0.8 for a, b in found) and all(bags[k] == bags[f] and f <= k for k, f in first.items())
    root = {k: k for k, _ in rows}
    for _ in range(len(rows)):
        for a, b in found:
            root[a] = root[b] = min(root[a], root[b])
    assert {k: root[first[k]] for k in first} == want


def test_a_large_group_of_near_copies_is_one_class(spark):
    """20,000 near copies of one text, each with a word of its own."""
    copy = "array_join(transform(sequence(0, 79), j -> if(j = id % 80, concat('own', id), concat('w', j))), ' ')"
    docs = spark.range(20_000).selectExpr("id as doc_id", f"{copy} as text").union(spark.range(20_000, 20_100).selectExpr("id", "repeat(concat('x', id, ' y', id, ' z '), 20)"))
    got = {r["class_id"]: r["n"] for r in near_dup.classes(docs).groupBy("class_id").agg(F.count("*").alias("n")).collect()}
    assert got.pop(0) == 20_000 and len(got) == 100
    pairs = spark.range(1, 5001).selectExpr("0L as a", "id as b")
    texts = docs.select("doc_id", "text").where("doc_id <= 5000")
    assert near_dup.compared(pairs, texts, 0.8, Stages(spark, "pairs")).count() == 5000


def test_deduplication_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 7, 8), (2, "a b c d e f", 9, 10), (None, "A b c d e f", 1, 2), (None, "g", 3, 4)], "doc_id long, text string, __row long, kept_id long")
    assert {tuple(r) for r in near_dup.deduplicated(docs).collect()} == {(1, "a b c d e f", 7, 8), (None, "g", 3, 4)}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    roots = {r["node"]: r["root"] for r in near_dup.components(edges, Stages(spark, "chain")).collect()}
    assert roots == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_signatures_estimate_the_weighted_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(40):
        names = rng.integers(0, 2**63, 200).astype(np.uint64)
        a = rng.integers(0, 9, 200)
        b = np.where(rng.random(200) < 0.7, a, rng.integers(0, 9, 200))
        owner = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        s = near_dup.bag_minhash(np.append(names[a > 0], names[b > 0]), np.append(a[a > 0], b[b > 0]), owner, 2, 512)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.04


def words(text):
    return [w for w in re.sub(r"[\W_]+", " ", (text or "").lower()).split(" ") if w]


def brute_leaks(docs, items):
    found = {}
    for item, text in items:
        w = words(text)
        size = min(5, len(w))
        if item is None or not w:
            continue
        grams = lambda x, size=size: Counter(tuple(x[i : i + size]) for i in range(len(x) - size + 1))
        for doc, body in docs:
            v = words(body)
            for start in range(max(1, len(v) - len(w) + 1)):
                s = similarity(grams(v[start : start + len(w)]), grams(w))
                if doc is not None and s >= 0.8 and s > found.get((doc, item), (0,))[0]:
                    found[doc, item] = (round(s, 9), start)
    return found


def test_leaks_equal_brute_force(spark, make):
    rnd = random.Random(4)
    draw = lambda n: [f"w{rnd.randint(0, 400)}" for _ in range(n)]
    items = [(i, " ".join(draw(rnd.choice([15, 30, 60])))) for i in range(8)] + [(8, "tiny item"), (9, None), (None, "lost words"), (10, "...")]
    docs = []
    for k in range(60):
        body = draw(rnd.choice([5, 40, 120]))
        if k % 2:
            passage = items[rnd.randrange(9)][1].split()
            for _ in range(rnd.randint(0, 2)):
                passage[rnd.randrange(len(passage))] = draw(1)[0]
            at = rnd.randrange(len(body))
            body[at:at] = [w.upper() + "," for w in passage]
        docs.append((k, " ".join(body)))
    docs += [(100, None), (101, ""), (None, items[0][1]), (102, " ".join(items[0][1].split()[1:])), (103, items[1][1] + " " + items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["start"]) for r in decontaminate.leaks(make(docs), bench).collect()}
    assert got == brute_leaks(docs, items)
    clean = decontaminate.clean(make(docs), bench)
    assert clean.columns == make(docs).columns
    assert {r["doc_id"] for r in clean.collect()} == {k for k, _ in docs} - {d for d, _ in got} - {None}


def best_windows(docs, items):
    """As brute_leaks, for items of five words or more; of windows that are equal
    before rounding the first counts."""
    grams = lambda x: Counter(tuple(x[i : i + 5]) for i in range(len(x) - 4))
    found = {}
    for item, w in ((k, words(t)) for k, t in items):
        for doc, v in ((k, words(t)) for k, t in docs):
            if set(w) & set(v):
                s, start = max((similarity(grams(v[i : i + len(w)]), grams(w)), -i) for i in range(max(1, len(v) - len(w) + 1)))
                if s >= 0.8:
                    found[doc, item] = (round(s, 9), -start)
    return found


def edited(words, ends, inserted, deleted, draw):
    """Words replaced at both ends, and some put in or taken out in the middle."""
    half = len(words) // 2
    return draw(ends) + words[ends:half] + draw(inserted) + words[half + deleted : len(words) - ends] + draw(ends)


def test_leaks_between_the_diagonals_of_a_passage(spark, make):
    rnd = random.Random(7)
    fresh = iter(range(10**6))
    draw = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    items = [(i, draw(n)) for i, n in enumerate([80, 100, 120, 160, 200])]
    docs = [draw(30) + edited(items[0][1], 2, 4, 0, draw) + draw(30), draw(30) + edited(items[1][1], 3, 6, 0, draw) + draw(30)]
    for _ in range(30):
        w = rnd.choice(items)[1]
        docs.append(draw(rnd.randint(0, 30)) + edited(w, rnd.randint(0, 3), rnd.choice([0, 3, 6]), rnd.choice([0, 3, 6]), draw) + draw(rnd.randint(0, 30)))
    docs = [(k, " ".join(d)) for k, d in enumerate(docs)]
    items = [(k, " ".join(w)) for k, w in items]
    want = best_windows(docs, items)
    assert {(0, 0), (1, 1)} <= set(want)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["start"]) for r in decontaminate.leaks(make(docs), bench).collect()}
    assert got == want


def test_filtering_judges_each_row_by_its_own_text(spark, make):
    item = " ".join(f"w{i}" for i in range(30))
    docs = [(1, f"see {item} here"), (1, "another text of this id"), (None, item), (None, "clean"), (2, None), (2, "")]
    kept = decontaminate.clean(make(docs), spark.createDataFrame([(5, item), (6, None)], "item_id long, text string")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([(1, "another text of this id"), (None, "clean"), (2, None), (2, "")])


def test_a_long_document_holds_items_at_its_end(spark, make):
    rnd = random.Random(9)
    draw = lambda n: [f"w{rnd.randint(0, 5000)}" for _ in range(n)]
    item = draw(40)
    docs = [(1, " ".join(draw(150_000) + item)), (2, " ".join(item * 500))]
    got = {r["doc_id"]: (r["start"], r["similarity"]) for r in decontaminate.leaks(make(docs), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {1: (150_000, 1.0), 2: (0, 1.0)}


def test_no_fingerprint_drops_a_window_that_reaches_the_threshold(spark, make):
    """SimHash within 19 of 64 bits lost 12 of 20,000 such windows."""
    n, each = 1000, 20
    items = spark.range(n).selectExpr("id as item_id", "array_join(transform(sequence(0, 58), j -> concat('w', id, 'x', j)), ' ') as text")
    docs = spark.range(n * each).selectExpr("id as doc_id", f"array_join(transform(sequence(0, 58), j -> if(j < 53, concat('w', id div {each}, 'x', j), concat('v', id, 'x', j))), ' ') as text")
    got = decontaminate.leaks(docs, items).where(f"item_id = doc_id div {each} and start = 0 and abs(similarity - 49 / 61) < 1e-9")
    assert got.count() == n * each


def test_leaks_of_empty_tables(spark, make):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(make([(1, "a b c d e f")]), nothing).count() == 0
    assert decontaminate.leaks(make([(1, "a")]).where("false"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
