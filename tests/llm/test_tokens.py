import bisect
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from skein.llm import attribution, mph, packing, token_store
from skein.llm.encoding import Encoder, vocabulary

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
ODD = [
    "it's '''s foo'bar naïve cómo x́ 12'3 a1b2 ***'s '''x *'sfoo", "a  b\n\n c\t\td \n e   ", "łódź Straße İstanbul ΑΣ x²y ½ ①a", "  x y \x1cfoo\x1f bar",
    "<|endoftext|> a<|startoftext|>b", "don'tx 're'll a'́ é'é", "日本語 text，mixed", "🙂👍🏽 ok﻿ z", "١٢٣ 4٥", "", " ", "\n", "a\x01b \x01", "x" * 9000, "foo bar\xa0baz",
]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_chunked_ids_equal_those_of_the_library(path):
    plain = Tokenizer.from_file(path)
    rnd = random.Random(5)
    texts = ODD + ["".join(rnd.choice([*"ab1 .'\n*|-é́\tA_", "'s", "  ", "<|endoftext|>", "<|startoftext|>", "<|"]) for _ in range(rnd.randint(0, 60))) for _ in range(500)]
    enc = Encoder(path)
    for _ in range(2):  # what was learned gives the same
        for text, raw in zip(texts, enc.ids(texts)):
            assert np.frombuffer(raw, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_spans_equal_those_of_the_library():
    plain = Tokenizer.from_file(BYTES)
    texts = [*ODD, "日本 x\n\n\n語é", "áb\n"]
    for text, (starts, ends) in zip(texts, Encoder(BYTES).token_spans(texts)):
        assert list(zip(starts.tolist(), ends.tolist())) == plain.encode(text, add_special_tokens=False).offsets, text


def expected(rows, path):
    k = Tokenizer.from_file(path)
    return {key: np.array(k.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for key, t in rows}


ROWS = [(7, "b c"), (3, None), (5, ""), (-2, "x y z é\n"), (9, "long " * 5000), (4, "same"), (6, "same"), (8, "a!!<|endoftext|>b <|startoftext|>c")]


def test_token_files_round_trip(spark, make):
    want, start = expected(ROWS, BYTES), 0
    manifest = token_store.write(make(ROWS), BYTES)
    got = {r["doc_id"]: r for r in token_store.scan(manifest).collect()}
    assert set(got) == set(want)
    for key in sorted(want):
        assert (got[key]["start"], got[key]["n_tokens"], got[key]["ids_crc32"]) == (start, len(want[key]), zlib.crc32(want[key].tobytes()))
        start += len(want[key])
    keys = spark.createDataFrame([(7,), (9,), (18,), (None,), (7,)], "k long")
    found = {r["doc_id"]: r["ids"] for r in token_store.lookup(manifest, keys).collect()}
    assert found == {k: want[k].tolist() for k in (7, 9)}


def test_token_files_with_repeated_and_null_ids(spark, make):
    rows = [(None, "n"), (1, "b"), (1, "a"), (2, "c")]
    manifest = token_store.write(make(rows), BYTES)
    got = token_store.scan(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 1, 2]
    assert [len(r["ids"]) for r in token_store.lookup(manifest, spark.createDataFrame([(1,)], "k long")).collect()] == [2, 2]


def test_token_files_of_an_empty_table(make):
    assert token_store.scan(token_store.write(make(ROWS).where("false"), BYTES)).count() == 0


def test_perfect_hash_uses_every_slot_once():
    for n in (1, 2, 5, 1000, 5000):
        keys = np.random.default_rng(n).choice(2**40, n, replace=False).astype(np.uint64)
        assert sorted(mph.slots(keys, mph.build(keys), n).tolist()) == list(range(n))


def check_packing(found, want, capacity):
    by_sequence = {}
    for r in found:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == r["piece"] * capacity and len(ids) == r["length"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(r["length"] for r in found) == sum(map(len, want.values()))
    return len(by_sequence)


def test_packing_holds_every_id_once_and_is_tight(make):
    rnd = random.Random(2)
    rows = [(i, "w " * rnd.choice([3, 3, 3, 20, 50, 97, 150])) for i in range(400)] + [(1000, None), (1001, ""), (1002, "v " * 1000)]
    want = expected(rows, WORDS)
    used = check_packing(packing.pack(make(rows), WORDS, 128).collect(), want, 128)
    assert used <= 1.03 * -(-sum(map(len, want.values())) // 128) + 1


def test_packing_of_repeated_rows_and_an_empty_table(make):
    same = [(1, "a b c")] * 30
    got = packing.pack(make(same), WORDS, 16).collect()
    assert len(got) == 30 and len({(r["sequence_id"], r["offset"]) for r in got}) == 30 and len({r["sequence_id"] for r in got}) == 8
    assert packing.pack(make(same).where("false"), WORDS, 16).count() == 0


def test_plans_place_every_count():
    rng = np.random.default_rng(4)
    for _ in range(20):
        counts = rng.integers(0, 40, 65)
        counts[0] = 0
        placed = np.zeros(65, int)
        for own, times in packing.plan(counts, 64):
            assert sum(v * n for v, n in own) <= 64
            for v, n in own:
                placed[v] += n * times
        assert (placed == counts).all()


def best_fit_decreasing(lengths, capacity):
    """Sequences of plain best-fit decreasing: each piece where least stays free."""
    gaps = []
    for v in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, v)
        gap = gaps.pop(i) if i < len(gaps) else capacity
        bisect.insort(gaps, gap - v)
    return len(gaps)


@pytest.mark.parametrize("n", [50, 500, 5000])
def test_plans_use_no_more_sequences_than_best_fit_decreasing(n):
    lengths = np.random.default_rng(n).integers(1, 2049, n)
    used = sum(times for _, times in packing.plan(np.bincount(lengths, minlength=2049), 2048))
    assert -(-lengths.sum() // 2048) <= used <= best_fit_decreasing(lengths.tolist(), 2048)


def brute_sections(text):
    """n_tokens and n_crossing of every line, token by token from the library."""
    edges = [0] + [i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < len(text)] + [len(text)]
    out = [[a, b, 0, 0] for a, b in zip(edges, edges[1:])] if text else [[0, 0, 0, 0]]
    for a, b in Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).offsets:
        held = [max(0, min(b, stop) - max(a, start)) for start, stop, *_ in out]
        home = held.index(max(held))
        out[home][2] += 1
        out[home][3] += sum(h > 0 for h in held) > 1
    return [tuple(x) for x in out]


def test_attribution_equals_brute_force(make):
    rnd = random.Random(11)
    bits = ["word", " ", "\n", "\n\n\n", "é", "🙂", "  ", "a.b", "<|endoftext|>", "\t\n", "123"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40)))) for i in range(80)] + [(100, "long line " * 3000 + "\n\n" * 50), (101, None)]
    got = {}
    for r in attribution.by_line(make(rows), BYTES).collect():
        got.setdefault(r["doc_id"], []).append((r["section"], r["start"], r["stop"], r["n_tokens"], r["n_crossing"]))
    assert {k: [x[1:] for x in sorted(v)] for k, v in got.items()} == {k: brute_sections(t or "") for k, t in rows}


def test_attribution_of_repeated_rows_and_an_empty_table(make):
    got = attribution.by_line(make([(1, "a\nb")] * 3), BYTES)
    assert sorted((r["section"], r["n_tokens"]) for r in got.collect()) == [(0, 2)] * 3 + [(1, 1)] * 3
    assert attribution.by_line(make([(1, "a")]).where("false"), BYTES).count() == 0


def test_attribution_adds_up_and_crossing_tokens_follow_the_rule(make):
    rows = [(1, "one two\n\n\nthree"), (2, None), (3, "a\n"), (None, "x\ny"), (4, "")]
    got = attribution.by_line(make(rows), BYTES).collect()
    for key, text in rows:
        own = sorted((r for r in got if r["doc_id"] == key), key=lambda r: r["section"])
        assert sum(r["n_tokens"] for r in own) == len(expected([(key, text)], BYTES)[key]) - 1
        assert [(text or "")[r["start"] : r["stop"]] for r in own] == ((text or "").splitlines(True) or [""])
    home, crossing = attribution.allot(np.array([0, 2, 4]), np.array([2, 4, 9]), np.array([0, 3, 6]))
    assert home.tolist() == [0, 0, 2]
    assert crossing.tolist() == [False, True, True]


def test_attribution_to_fields(spark):
    df = spark.createDataFrame([(1, "title", None, "body text")], "k long, a string, b string, c string")
    got = {r["section"]: r["n_tokens"] for r in attribution.by_field(df, "k", ["a", "b", "c"], BYTES).collect()}
    assert sum(got.values()) == len(expected([(1, "title\n\nbody text")], BYTES)[1]) - 1
