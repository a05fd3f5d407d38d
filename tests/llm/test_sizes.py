"""Packing, mixing and splitting."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import mixing, packing, splitting, tokens
from lodestone.llm import packing_kernel as pk
from lodestone.llm import splitting_kernel as sk

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.DEFAULT_VOCABULARY), reason="no vocabulary")

# ------------------------------------------------------------------ splitting

TEXT = st.text(alphabet=list("ab é轮.,;\n  😀"), max_size=400)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(4, 60), st.integers(0, 50))
def test_pieces(text, limit, overlap):
    if overlap >= limit:
        with pytest.raises(ValueError):
            sk.split_text(text, limit, overlap, None)
        return
    pieces = sk.split_text(text, limit, overlap, None)
    size = lambda t: len(t.encode())
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert (len(pieces) > 1) == (size(text) > limit)
    for (a, b, n), (c, d, _) in zip(pieces, pieces[1:]):
        assert c <= b < d  # every piece adds text, nothing is lost
        shared = size(text[c:b])
        assert overlap <= shared <= overlap + 3 or c == 0 or limit < overlap + 8
    for a, b, n in pieces:
        assert n == size(text[a:b]) <= limit


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(6, 60), st.integers(0, 3))
def test_doubling_equals_walking(text, limit, overlap):
    where = sk.char_tokens(text, None)
    if where[-1] <= limit:
        return
    places, strength = sk.boundaries(text, where)
    succ = sk.successors(places, strength, limit, overlap)
    walk, at = [0], 0
    while at != len(succ) - 1:
        assert succ[at] > at
        at = int(succ[at])
        walk.append(at)
    assert list(sk.reached(succ)) == walk


def test_natural_cuts():
    text = "First one here. Second one.\n\nNew paragraph starts. And ends."
    assert [text[a:b] for a, b, _ in sk.split_text(text, 40, 0, None)] == ["First one here. Second one.\n\n", "New paragraph starts. And ends."]
    assert [b - a for a, b, _ in sk.split_text("x" * 25, 10, 0, None)] == [10, 10, 5]
    assert sk.split_text("轮" * 4, 7, 0, None) == [(0, 2, 6), (2, 4, 6)]


LIMITS = "purpose string, source string, max_tokens int, overlap_tokens int"


def test_split_frame(spark):
    limits = spark.createDataFrame([("cut", "a", 10, 2), ("cut", None, 20, 0), ("pack", None, 16, 0), ("pack", None, 64, 0)], LIMITS)
    docs = spark.createDataFrame([(1, "word " * 5, "a", 9), (2, "word " * 4, "b", 9), (3, None, "a", 9), (4, "", None, 9), (5, "word " * 5000, None, 9), (5, "word " * 5000, None, 9)], "doc_id long, text string, source string, piece_no long")
    p = splitting.split_documents(docs, limits, "bytes")
    assert sorted(r["doc_id"] for r in splitting.oversized(docs, limits).collect()) == [1, 5]
    assert p.filter("doc_id = 2").count() == 1 and p.filter("doc_id = 4").count() == 1 and p.filter("doc_id = 3").count() == 0
    assert p.agg(F.max("n_tokens")).first()[0] <= 20
    one = p.filter("doc_id = 1").orderBy("piece_no").collect()
    assert all(x["end_char"] - y["start_char"] == 2 for x, y in zip(one, one[1:])) and one[-1]["end_char"] == 25
    assert splitting.split_documents(docs.limit(0), limits, "bytes").count() == 0
    none = limits.filter("source IS NOT NULL")
    assert splitting.split_documents(docs, none, "bytes").select("doc_id").distinct().count() == 1


@needs_vocabulary
def test_split_with_vocabulary(spark):
    limits = spark.createDataFrame([("cut", None, 50, 7)], LIMITS)
    text = "The wheel turns; 轮胎模型 needs 12.5 steps.\n\n" * 40 + "x1y2" * 300
    docs = spark.createDataFrame([(1, text, None)], "doc_id long, text string, source string")
    rows = splitting.split_documents(docs, limits).orderBy("piece_no").collect()
    shared = tokens.load(spark, tokens.DEFAULT_VOCABULARY)
    count = lambda t: len(tokens.encoding(shared).encode_ordinary(t))
    assert all(count(r["piece"]) == r["n_tokens"] <= 50 and r["piece"] == text[r["start_char"] : r["end_char"]] for r in rows)
    assert rows[0]["start_char"] == 0 and rows[-1]["end_char"] == len(text) and all(x["end_char"] > y["start_char"] for x, y in zip(rows, rows[1:]))
    assert spark.range(1).select(tokens.count_tokens(spark, F.lit(text)).alias("n"), tokens.count_tokens(spark, F.lit(None).cast("string")).alias("z")).first() == (count(text), 0)


# ------------------------------------------------------------------ packing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 8))
def test_packer(sizes, windows):
    p = pk.Packer(50, windows)
    done = [w for i, n in enumerate(sizes) if (w := p.put(n, [(i, n)])) is not None]
    assert len(p.room) <= windows and p.room == sorted(p.room)
    done += list(p.rest())
    assert sorted(i for _, items in done for i, _ in items) == list(range(len(sizes)))
    assert all(used == sum(n for _, n in items) <= 50 for used, items in done)
    merged = list(pk.merge(50, done))
    assert sorted(i for _, items in merged for i, _ in items) == list(range(len(sizes))) and len(merged) <= len(done)


def test_packer_fit():
    p = pk.Packer(10, 2)
    assert p.put(6, ["a"]) is None and p.put(7, ["b"]) is None
    assert p.put(3, ["c"]) == (10, ["b", "c"])  # best fit fills b
    assert p.put(8, ["d"]) is None and p.put(9, ["e"]) == (8, ["d"])  # nothing fits: the fullest leaves
    with pytest.raises(ValueError):
        p.put(11, ["f"])


def test_pack_frame(spark):
    texts = ["w" * (1 + i * 7 % 40) for i in range(500)] + ["a b " * 60, None, "", "z" * 16, "z" * 16]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, part_no long").repartition(5)
    got = packing.pack(docs, [16, 64], "bytes", open_windows=4).collect()
    for c in (16, 64):
        rows = [r for r in got if r["capacity"] == c]
        used, tokens_of = {}, {}
        for r in rows:
            used[r["container"]] = used.get(r["container"], 0) + r["n_tokens"]
            tokens_of.setdefault(r["doc_id"], []).append(r["n_tokens"])
        assert max(used.values()) <= c
        assert {i: sum(v) for i, v in tokens_of.items()} == {i: len(t) for i, t in enumerate(texts) if t}
        assert all(len(v) == 1 for i, v in tokens_of.items() if len(texts[i]) <= c)
        assert sum(used.values()) >= 0.85 * c * len(used)
        assert all(sorted(r["position"] for r in rows if r["container"] == name) == list(range(sum(r["container"] == name for r in rows))) for name in list(used)[:20])
    report = {r["capacity"]: r for r in packing.fill_report(packing.pack(docs, [16], "bytes")).collect()}
    assert report[16]["fullest"] <= 16 and report[16]["tokens"] == sum(len(t) for t in texts if t)
    assert packing.pack(docs.limit(0), [16], "bytes").count() == 0


# ------------------------------------------------------------------ mixing

TARGETS = "source string, target_share double, max_repeats int"


def test_mix(spark):
    r = np.random.default_rng(5)
    rows = [(i, "x" * int(r.integers(5, 60)), ["big", "big", "big", "mid", "small", None, "other"][i % 7], 7) for i in range(7000)] + [(7000, None, "big", 7), (7001, "", "mid", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    targets = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.4, 3), ("small", 0.25, 4), ("absent", 0.05, 2)], TARGETS)
    drawn = mixing.draw(docs, targets, "bytes")
    got = drawn.collect()
    caps = {"big": 1, "mid": 3, "small": 4}
    assert all(1 <= x["copies"] <= caps[x["source"]] for x in got) and len({x["doc_id"] for x in got}) == len(got)
    report = {x["source"]: x for x in mixing.share_report(drawn, targets).collect()}
    assert set(report) == {"big", "mid", "small", "absent"} and report["absent"]["share"] == 0 and abs(sum(x["share"] for x in report.values()) - 1) < 1e-5
    wanted = {"big": 0.3 / 0.95, "mid": 0.4 / 0.95, "small": 0.25 / 0.95}
    assert all(abs(report[s]["share"] - w) < 0.01 for s, w in wanted.items())
    assert drawn.collect() and sorted(map(tuple, drawn.collect())) == sorted(map(tuple, mixing.draw(docs, targets, "bytes").collect()))  # stable


def test_mix_limits(spark):
    docs = spark.createDataFrame([(i, "x" * 10, "a" if i else "b") for i in range(100)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], TARGETS)
    few = {x["source"]: x for x in mixing.share_report(mixing.draw(docs, targets, "bytes"), targets).collect()}
    assert few["b"]["most_copies"] <= 3 and abs(few["a"]["tokens"] - few["b"]["tokens"]) <= 10
    more = {x["source"]: x for x in mixing.share_report(mixing.draw(docs, targets, "bytes", total_tokens=1000), targets).collect()}
    assert more["b"]["tokens"] == 30 and abs(more["a"]["tokens"] - 500) <= 10
    assert mixing.draw(docs.limit(0), targets, "bytes").count() == 0
    assert mixing.share_report(mixing.draw(docs.limit(0), targets, "bytes"), targets).count() == 2


def longer_alone(t):  # short stretches have more tokens
    return np.diff(np.linspace(0, len(t), 1 + (len(t) if len(t) < 150 else 90 if len(t) < 300 else len(t) // 4)).astype(np.int64))


@pytest.mark.parametrize("overlap", [0, 7, 30])
def test_pieces_that_retokenise_longer_are_cut_again(overlap):
    text = "word and more " * 60
    pieces = sk.split_text(text, 60, overlap, longer_alone)
    assert max(n for _, _, n in pieces) <= 60 and all(n == len(longer_alone(text[a:b])) for a, b, n in pieces)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(c <= b < d for (_, b, _), (c, d, _) in zip(pieces, pieces[1:]))
    if not overlap:
        assert "".join(text[a:b] for a, b, _ in pieces) == text


def test_limits_are_checked(spark):
    docs = spark.createDataFrame([(1, "x", "a")], "doc_id long, text string, source string")
    for row in (("cut", "a", 10, 10), ("cut", "a", 3, 0), ("cut", "a", 10, -1)):
        with pytest.raises(ValueError):
            splitting.split_documents(docs, spark.createDataFrame([row], LIMITS), "bytes")


def test_draw_does_not_depend_on_buckets(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * (5 + i * 7 % 40), "a" if i % 3 else "b") for i in range(3000)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.7, 2)], TARGETS)
    few = sorted(map(tuple, mixing.draw(docs, targets, "bytes").collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    assert sorted(map(tuple, mixing.draw(docs, targets, "bytes").collect())) == few
