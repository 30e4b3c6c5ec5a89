"""Leaked evaluation items: planted passages are found however they are typed, shorter and merely similar ones are not."""

import random
from collections import Counter

import numpy as np
import pytest

from graphweft.llm import leaks
from graphweft.llm.words import words

rng = random.Random(11)
VOCAB = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(3000)]
TEMPLATE = "the {} archive at {} holds {} ledgers of which {} were copied by {} during the summer of {} and the keepers refused to sign".split()


def passage(n):
    return [rng.choice(VOCAB) for _ in range(n)]


ITEMS = {k: passage(60) + [rng.choice(VOCAB) if w == "{}" else w for w in TEMPLATE] for k in range(20)}


def opening(texts):
    """Positions of the seeds that open a match, by the definition."""
    df = {}
    for v in {tuple(v) for v in texts}:
        for seed in set(leaks.runs(v)):
            df[seed] = df.get(seed, 0) + 1
    out = []
    for v in texts:
        n = [df[seed] for seed in leaks.runs(v)]
        at = {k for k, c in enumerate(n) if c <= leaks.RARE}
        for lo in range(max(1, len(n) - leaks.WINDOW + 1)):
            part = n[lo : lo + leaks.WINDOW]
            if part and min(part) > leaks.RARE:
                at |= {lo + k for k, c in enumerate(part) if c == min(part)}
        out.append(sorted(at))
    return out


def held(items):
    at = opening([tuple(v) for v in items.values()])
    df = Counter(w for v in {tuple(v) for v in items.values()} for w in set(v))
    return leaks.ItemTexts([(k, list(v), o, [i for i, w in enumerate(v) if df[w] <= leaks.RARE]) for (k, v), o in zip(items.items(), at)])


OWN = held({k: [w.lower() for w in v] for k, v in ITEMS.items()})


def found(text):
    return {x[1]: x[1:] for x in OWN.leaks_in(["", text, "one two"])}


def around(text):
    return " ".join(passage(150)) + "\n" + text + "\n" + " ".join(passage(150))


@pytest.mark.parametrize(
    "typed",
    [
        " ".join,
        lambda ws: " ".join(ws).upper(),
        lambda ws: "  ".join(ws),
        lambda ws: "\n> ".join(" ".join(ws[k : k + 5]) for k in range(0, len(ws), 5)),
        lambda ws: "<p>" + " ".join(f"<b>{w}</b>," for w in ws) + "</p>",
        lambda ws: " ".join(w[:2] + "​" + w[2:] for w in ws),
        lambda ws: " ".join(w[:2] + "-\n" + w[2:] if k % 4 == 1 else w for k, w in enumerate(ws)),
        lambda ws: " ".join(ws).replace("o", "о").replace("a", "а"),
        lambda ws: " ".join(chr(0xFEE0 + ord(w[0])) + w[1:] for w in ws),
        lambda ws: " ".join("exchanged" if k in (6, 15) else w for k, w in enumerate(ws)),
        lambda ws: " ".join([*ws[:9], "inserted", *ws[9:]]),
        lambda ws: " ".join([*ws[:9], *ws[10:]]),
    ],
)
def test_passages_are_found(typed):
    ws = ITEMS[3][10:34]
    assert set(found(around(typed(ws)))) == {3}


def test_length_limits_and_similar_wording():
    assert 5 in found(around(" ".join(ITEMS[5][:15])))
    assert not found(around(" ".join(ITEMS[5][:13])))
    similar = " ".join(rng.choice(VOCAB) if w == "{}" else w for w in TEMPLATE)
    assert not found(around(similar))
    assert not found("") and not found("  \n") and not found(" ".join(passage(5)))


def test_short_passages_with_exchanged_words():
    """Fifteen words with one exchanged and twenty with three, of words that many items share; with a name exchanged they are merely similar."""
    common = passage(3)
    items = {k: [*passage(6), common[0], *passage(6), common[1], *passage(6), common[2], *passage(8)] for k in range(20)}
    own = held(items)
    ws = items[4]
    one = [w if k != 6 else "exchanged" for k, w in enumerate(ws[:15])]
    three = [w if w not in common else "exchanged" for w in ws[2:23]]
    assert [x[:2] for x in own.leaks_in([around(" ".join(one)), around(" ".join(three))])] == [(0, 4), (1, 4)]
    assert not own.leaks_in([around(" ".join("exchanged" if k == 5 else w for k, w in enumerate(ws[:15])))])


def test_two_items_and_best_stretch():
    text = around(" ".join(ITEMS[1][:20])) + around(" ".join(ITEMS[2][5:40])) + " ".join(ITEMS[1][20:60])
    got = found(text)
    assert set(got) == {1, 2} and got[1][1] >= 38


def test_alignment_against_plain_dynamic_programming():
    r = random.Random(4)
    for _ in range(40):
        a, b = [r.randrange(5) for _ in range(r.randrange(1, 25))], [r.randrange(5) for _ in range(r.randrange(1, 25))]
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -2), h[i - 1][j] - 2, h[i][j - 1] - 2)
        assert leaks.align(np.array(a), np.array(b))[0] == max(map(max, h))


def test_frames_passes_nulls_and_repeats(spark):
    items = spark.createDataFrame([(k, " ".join(v), "x") for k, v in ITEMS.items()] + [(99, None, "x"), (None, "a", "x"), (98, "", "x"), (3, " ".join(ITEMS[3]), "x")], "item_id long, text string, passage string")
    docs = spark.createDataFrame([(1, around(" ".join(ITEMS[3]).title()), 0), (2, None, 0), (3, "", 0), (4, around(""), 0), (5, " ".join(ITEMS[7][:30]) * 1 + " " + "z " * 200_000, 0)], "doc_id long, text string, words int")
    for per_pass in (10_000, 200):
        assert {(r.doc_id, r.item_id) for r in leaks.leaks(docs, items, per_pass).collect()} == {(1, 3), (5, 7)}
    assert leaks.leaks(docs.limit(0), items).count() == 0 and leaks.leaks(docs, items.limit(0)).count() == 0


def test_opening_seeds_against_the_definition(spark):
    shared = passage(30)
    texts = [passage(5) + shared + passage(k % 3) for k in range(8)] + [shared[:9] + shared[:9], passage(3), passage(4)]
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in enumerate(texts)], "item_id long, text string")
    got = {r.text_id: r.opening for r in leaks.item_texts(df)[0].collect()}
    assert got == {k: o for k, o in enumerate(opening([tuple(v) for v in texts])) if len(texts[k]) >= leaks.SEED}


@pytest.mark.parametrize("copies", [6, 60])
def test_items_of_the_same_or_a_shared_wording(spark, copies):
    """The same item under many ids, and a stem that many items share: found for each of them, in any number of passes."""
    text, stem = passage(60), passage(25)
    items = spark.createDataFrame([(k, " ".join(text)) for k in range(copies)] + [(1000 + k, " ".join(stem + passage(20))) for k in range(copies)], "item_id long, text string")
    docs = spark.createDataFrame([(1, around(" ".join(text[20:40]))), (2, around(" ".join(stem[4:20]))), (3, around(" ".join(stem[:10])))], "doc_id long, text string")
    want = {(1, k) for k in range(copies)} | {(2, 1000 + k) for k in range(copies)}
    for per_pass in (1_000_000, copies * 10):
        assert {(r.doc_id, r.item_id) for r in leaks.leaks(docs, items, per_pass).collect()} == want


def test_short_items_and_scripts_without_spaces(spark):
    short, han = passage(12), "图数据库将节点与关系作为一等公民存储并支持多跳遍历查询和最短路径计算"
    items = spark.createDataFrame([(1, " ".join(short)), (2, han), (3, "one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, around(" ".join(short))), (2, "前言。" + han[3:25] + "。结束"), (3, around(" ".join(short[:11]))), (4, "one two three " * 9)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(docs, items).collect()} == {(1, 1), (2, 2)}


def test_words():
    assert words("Don't stop-\nping Café­ &amp; x_y 12.5") == ["don", "t", "stopping", "cafe", "x", "y", "12", "5"]
