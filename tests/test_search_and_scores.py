import itertools
import random
import re

import numpy as np
import pytest

from skein.functions import licences
from skein.operators import evaluation, neighbours

VECTORS = "vec_id long, embedding array<float>, rank int, score double"


def nearest(rows, queries, k):
    """Exact neighbours by cosine, each key by its best row."""
    unit = [(i, np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float))) for i, v in rows]
    out = set()
    for q, v in unit:
        if q in queries:
            best = {}
            for i, w in unit:
                if i != q and len(v) == len(w):
                    best[i] = max(best.get(i, -2.0), round(float(v @ w), 9) + 0.0)
            first = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
            out |= {(q, n + 1, i, round(s, 6)) for n, (i, s) in enumerate(first)}
    return out


def sides(spark, rows):
    df = spark.createDataFrame([(*r, 1, 0.5) for r in rows], VECTORS).repartition(3)
    base = neighbours.usable(df, "vec_id", "embedding")
    return base, base.where("id % 7 = 0")


def found(df):
    return {(r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in df.collect()}


def vectors(seed, n=300):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, 8))
    rows = [(k, (centres[k % 12] + 0.3 * rnd.normal(size=8)).tolist()) for k in range(n)]
    return rows + [(1000 + k, rows[14][1]) for k in range(150)] + [(2000, [1.0, 2.0, 3.0]), (2100, [2.0, 4.0, 6.1])]


UNUSABLE = [(3000, None), (3001, []), (3002, [None] * 8), (3003, [float("nan")] * 8), (3004, [0.0] * 8), (None, [1.0] * 8), (3006, [float("inf")] * 8)]


def test_exact_neighbours_in_many_slices(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SLICE", 40)
    monkeypatch.setattr(neighbours, "CHUNK", 5)
    rows = vectors(1)
    queries = {i for i, _ in rows if i % 7 == 0}
    assert found(neighbours.exact(*sides(spark, rows + UNUSABLE), k=5)) == nearest(rows, queries, 5)
    assert neighbours.exact(*sides(spark, []), k=5).count() == 0


def test_all_probes_of_a_table_are_an_exact_search(spark, monkeypatch):
    """A bucket of copies is cut into slices, and no row is lost in them."""
    monkeypatch.setattr(neighbours, "SLICE", 16)
    rows = vectors(2)
    queries = {i for i, _ in rows if i % 7 == 0}
    got = neighbours.approximate(*sides(spark, rows), k=5, tables=1, bits=2, most=4)
    assert found(got) == nearest(rows, queries, 5)


def test_a_key_of_several_rows_counts_once(spark):
    rows = [(7, [1.0, 0.0]), *[(8, [1.0, 0.01 * i]) for i in range(30)], (9, [0.0, 1.0]), (10, [-1.0, 0.0])]
    assert found(neighbours.exact(*sides(spark, rows), k=3)) == {(7, 1, 8, 1.0), (7, 2, 9, 0.0), (7, 3, 10, -1.0)}


def test_recall_against_exact_neighbours(spark):
    base, queries = sides(spark, vectors(3, 3000))
    r = neighbours.recall(neighbours.approximate(base, queries, k=10), neighbours.exact(base, queries, k=10)).head()
    assert r["n"] > 4000 and r["hits"] >= 0.9 * r["n"]


def test_probes_are_fitted_where_a_few_would_not_do(spark, monkeypatch):
    """Nearly random vectors in small buckets: 16 probes meet fewer than nine tenths."""
    monkeypatch.setattr(neighbours, "BUCKET", 4)
    monkeypatch.setattr(neighbours, "VISIT", 1)
    rnd = np.random.default_rng(4)
    base, queries = sides(spark, [(k, rnd.normal(size=32).tolist()) for k in range(4000)])
    truth = neighbours.exact(base, queries, k=10).cache()
    share = lambda **x: (r := neighbours.recall(neighbours.approximate(base, queries, k=10, **x), truth).head())["hits"] / r["n"]
    assert share(most=16) < 0.85 and share() >= 0.9 and share(bits=9) >= 0.9
    assert neighbours.approximate(base, queries.where("false"), k=10).count() == 0
    assert neighbours.approximate(*sides(spark, []), k=10).count() == 0


def test_places_are_those_of_the_probes():
    rnd = np.random.default_rng(5)
    query, others = rnd.normal(size=6), rnd.normal(size=(40, 6))
    p, want = neighbours.planes(6, 3, 7, 1), []
    for v in others:
        at = []
        for t in range(3):
            code = int(sum(1 << i for i, x in enumerate(p[7 * t : 7 * t + 7] @ v) if x > 0))
            every = neighbours.probes(p[7 * t : 7 * t + 7] @ query, 1000)
            assert len(set(every)) == len(every) == 128
            at.append(every.index(code))
        want.append(min(at))
    assert neighbours.places(query, others, 3, 7, 1).tolist() == want


def test_probes_go_by_the_distances_crossed():
    side = np.array([0.9, -0.1, 0.3, -2.0])
    assert neighbours.probes(side, 5) == [0b0101, 0b0111, 0b0001, 0b0011, 0b0100]


NOTICES = {"five": "alpha beta gamma delta epsilon", "gap": "one two three four five <> six seven eight nine ten eleven", "long": " ".join(f"w{i}" for i in range(26))}


def fewest(notice, words):
    """Edits to align all words with the notice, gaps tried one by one."""
    parts, best = [[]], None
    for word, gap in zip(notice.words, notice.gaps):
        if gap:
            parts.append([])
        parts[-1].append(word)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    holes = len(parts) - 1
    for cuts in itertools.combinations_with_replacement(range(len(words) + 1), 2 * holes):
        if all(cuts[i + 1] - cuts[i] <= licences.GAP for i in range(0, 2 * holes, 2)):
            edges = [0, *cuts, len(words)]
            total = sum(distance(p, words[edges[2 * i] : edges[2 * i + 1]]) for i, p in enumerate(parts))
            best = total if best is None else min(best, total)
    return best


def brute(text, notices):
    spans = [m.span() for m in re.finditer(r"[^\W_]+", text)]
    words = [text[a:b].lower() for a, b in spans]
    out = []
    for name, stated in notices.items():
        notice, kept = licences.Notice(stated), []
        every = []
        for a in range(len(words)):
            for b in range(a + 1, min(len(words), a + len(notice.words) + notice.slack) + 1):
                if b - a >= len(notice.words) - notice.edits:
                    edits = fewest(notice, words[a:b])
                    if edits is not None and edits <= notice.edits:
                        every.append((edits, b, -a))
        # For each stop the fewest edits and the latest start, then apart.
        at_stop = {}
        for e, b, a in every:
            at_stop[b] = min(at_stop.get(b, (e, a)), (e, a))
        for e, a, b in sorted((e, -a, b) for b, (e, a) in at_stop.items()):
            if all(b <= x or a >= y for x, y in kept):
                kept.append((a, b))
                out.append((name, spans[a][0], spans[b - 1][1], e))
    return sorted(out)


def licence_texts(seed):
    rnd = random.Random(seed)
    words = [w for n in NOTICES.values() for w in re.findall(r"\w+", n)] + ["other", "More", "ÉTÉ"]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(1, 3)):
            own = re.findall(r"\w+|<>", rnd.choice(list(NOTICES.values())))
            own = [x for w in own for x in (rnd.choices(words, k=rnd.choice([0, 1, 3, 8, 9])) if w == "<>" else [w])]
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                i = rnd.randrange(len(own))
                own[i : i + rnd.randint(0, 1)] = rnd.choice([[], [rnd.choice(words)]])
            parts += rnd.choices(words, k=rnd.randint(0, 4)) + [w.upper() if rnd.random() < 0.3 else w for w in own]
        texts.append("".join(w + rnd.choice([" ", "\n", ", ", "  (", "\t"]) for w in parts))
    return texts


def test_notices_equal_the_alignment_of_every_part(spark):
    texts = licence_texts(1)
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(900, None, 1), (901, "", 1), (902, "alpha beta", 1), (903, "alpha beta gamma delta epsilon", 1), (903, "alpha beta gamma delta epsilon", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    got = sorted(map(str, ((r["doc_id"], r["licence"], r["start"], r["stop"], r["edits"]) for r in licences.find(df, notices=NOTICES).collect())))
    want = sorted(str((k, *m)) for k, t, _ in rows for m in brute(t or "", NOTICES))
    assert got == want and len(want) > 60
    assert licences.find(df.where("false"), notices=NOTICES).count() == 0


def test_notices_as_they_are_stated_are_found_in_a_long_text(spark):
    filler = " ".join(f"word{i % 977}" for i in range(100_000))
    rows = [(k, f"{filler}\n// {text.replace('<>', 'Some Body, Inc.')}\n{filler}".replace(" the ", "  THE\n")) for k, text in enumerate(licences.NOTICES.values())]
    found = {(r["doc_id"], r["licence"]): r["edits"] for r in licences.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found.get((k, name)) == 0 for k, name in enumerate(licences.NOTICES))
    with pytest.raises(ValueError):
        licences.Notice("too short")


def scores(seed, n=2000):
    rnd = random.Random(seed)
    rows = [(rnd.choice([0.5, 0.5, round(rnd.gauss(0.4, 0.3), 2)]), int(rnd.random() < 0.3)) for _ in range(n)]
    return [(s, max(y, int(s > 0.9))) for s, y in rows]


def test_areas_and_rates_equal_pairs_and_thresholds(spark):
    rows = scores(1)
    df = spark.createDataFrame([*rows, (None, 1), (float("nan"), 1), (0.3, None)], "s double, y int").repartition(4)
    up, down = [s for s, y in rows if y], [s for s, y in rows if not y]
    points = evaluation.curve(df, "s", "y")
    got = evaluation.summary(points).head()
    auc = sum((a > b) + 0.5 * (a == b) for a in up for b in down) / (len(up) * len(down))
    precision = lambda t: sum(s >= t for s in up) / sum(s >= t for s, _ in rows)
    assert (got["rows"], got["positives"]) == (len(rows), len(up)) and abs(got["auc"] - auc) < 1e-12
    assert abs(got["average_precision"] - sum(precision(s) for s in up) / len(up)) < 1e-12
    rates = {r["threshold"]: r for r in evaluation.rates(points).collect()}
    assert set(rates) == {s for s, _ in rows}
    for t, r in rates.items():
        assert abs(r["true_positive_rate"] - sum(s >= t for s in up) / len(up)) < 1e-12 and abs(r["precision"] - precision(t)) < 1e-12
        assert abs(r["false_positive_rate"] - sum(s >= t for s in down) / len(down)) < 1e-12
    assert got["best_f1"] == max(r["f1"] for r in rates.values())


def test_calibration_and_what_lacks_a_class(spark):
    df = spark.createDataFrame([(0.05, 0), (0.05, 1), (0.95, 1), (1.0, 1), (1.3, 0), (-0.2, 0)], "s double, y int")
    bins = {r["bin"]: (r["rows"], round(r["mean_score"], 9), round(r["share"], 9)) for r in evaluation.calibration(df, "s", "y").collect()}
    assert bins == {0: (3, round(-0.1 / 3, 9), round(1 / 3, 9)), 9: (3, round(3.25 / 3, 9), round(2 / 3, 9))}
    errors = evaluation.calibration_error(evaluation.calibration(df, "s", "y")).head()
    assert abs(errors["expected_error"] - (0.5 * (1 + 0.1) / 3 + 0.5 * 1.25 / 3)) < 1e-9
    one = evaluation.summary(evaluation.curve(df.where("y = 1"), "s", "y")).head()
    assert one["auc"] is None and one["positives"] == 3
    none = evaluation.summary(evaluation.curve(df.where("false"), "s", "y")).head()
    assert none["rows"] == 0 and none["auc"] is None and none["best_f1"] is None


def test_no_task_of_the_curve_holds_all_scores(spark):
    """The one window without a key runs over blocks, not over scores."""
    df = spark.range(200_000).selectExpr("id / 200000.0 s", "cast(id % 3 = 0 as int) y")
    assert evaluation.curve(df, "s", "y").count() == 200_000
    plan = evaluation.curve(df, "s", "y")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if re.search(r"\bWindow \[", line)]
    assert windows and all("block" in line or "sum(p" in line or "sum(q" in line for line in windows)
