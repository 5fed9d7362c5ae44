import random

from graphloom.llm import leaks
from graphloom.llm.leaks import leaked_items, matched_windows, reparameterised
from graphloom.llm.words import word_finder

DOCS, ITEMS = "doc_id bigint, text string, key string, hash string, words string, salt int", "item_id bigint, text string, key string, item string, len int"


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "a", "b", "c", 1) for d in docs], DOCS), spark.createDataFrame([(*i, "a", "b", 1) for i in items], ITEMS)


def match(spark, docs, items, **options):
    d, i = frames(spark, docs, items)
    return matched_windows(d, "doc_id", "text", i, "item_id", "text", **options)


def brute(docs, items, width=12):
    words = word_finder()
    out = set()
    for i, t in items:
        w = words(t)
        n = min(len(w), width)
        windows = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if n else set()
        for d, text in docs:
            v = words(text)
            if any(tuple(v[a : a + n]) in windows for a in range(len(v) - n + 1)) and n:
                out.add((d, i))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    names = ["Alpha", "betaGamma", "Köln", "zeta9", "Ωmega", "ﬁne"]
    frame = "between {} and {} lies exactly one hop which the graders of {} overlook for {} minutes on every commit of the day".split()
    fill = lambda: " ".join(r.choice(names) if w == "{}" else w for w in frame)
    items = [(i, fill() if i % 3 else " ".join(r.choice(names) + str(r.randrange(9)) for _ in range(r.randrange(1, 9)))) for i in range(30)]
    docs = []
    for d in range(120):
        parts = [" ".join(r.choice("the of and graph node edge".split()) for _ in range(20))]
        if d % 3 == 0:
            t = r.choice(items)[1]
            w = t.split()
            a = r.randrange(max(1, len(w) - 12))
            t = " ".join(w[a:] if r.random() < 0.5 else w[: 11 + r.randrange(3)])
            parts.append(r.choice([t, t.upper(), t.replace(" ", ",\n* "), t.replace("e", "e​")]))
        if d % 5 == 0:
            parts.append(fill())
        docs.append((d, ". ".join(parts)))
    return docs + [(900, None), (901, ""), (902, "  \n "), (0, docs[0][1])], items + [(99, None), (98, ""), (97, "..."), (1, items[1][1])]


def test_copies_equal_brute_force(spark, rows, monkeypatch):
    for seed in range(2):
        docs, items = corpus(seed)
        want = sorted(brute(docs, items), key=repr)
        assert len(want) > 20
        assert rows(leaked_items(match(spark, docs, items))) == want
        assert rows(leaked_items(match(spark, docs, items, sieve_limit=0))) == want  # without the sieve
    monkeypatch.setattr(leaks, "BROADCAST", 0)
    assert rows(leaked_items(match(spark, docs, items))) == want  # by shuffle


def test_reparameterised_texts(spark):
    item = "between Alpha and Beta lies exactly one hop which graders of Gamma overlook after 12 minutes"
    items = [(i, item.replace("Alpha", f"Alpha{chr(97 + i)}").replace("Beta", f"Beta{chr(97 + i)}").replace("Gamma", f"Gamma{chr(97 + i)}")) for i in range(6)]
    docs = [
        (1, "Between Foo and Bar lies exactly one hop, which graders of Baz overlook after 99 seconds."),  # other values
        (2, "Between Alphaa and Betaa lies exactly one hop, which graders of Gammaa overlook after 12 minutes."),  # a copy
        (3, "Nothing of the kind is written here, at any length that would matter to anyone at all."),
        (4, "Between Foo and Foo lies exactly one hop, which graders of Baz overlook after 99 seconds."),  # one value for two slots
    ]
    found = reparameterised(match(spark, docs, items)).collect()
    assert {r["doc_id"] for r in found} - {4} == {1}
    assert all(r["item_id"] == 0 and r["n_items"] == 6 for r in found if r["doc_id"] == 1)
    whole = {(r["doc_id"], r["is_consistent"]) for r in match(spark, docs, items).where("len = 12").collect()}
    assert (4, False) in whole and (1, True) in whole


def test_empty_sides_and_long_texts(spark, rows):
    assert rows(leaked_items(match(spark, [], [(1, "some words to find")]))) == []
    assert rows(leaked_items(match(spark, [(1, "some words to find")], []))) == []
    long = "filler " * 200_000 + "some words to find " + "filler " * 100
    assert rows(leaked_items(match(spark, [(1, long), (2, None)], [(7, "Words, to find!"), (8, None)]))) == [(1, 7)]


def test_words():
    words = word_finder()
    assert words("Ｆｕｌｌ １２ x²​_y ﬁn ÀB") == ["full", "12", "x2", "y", "fin", "àb"]
    assert words("a­b") == ["ab"] and words(None) == []
