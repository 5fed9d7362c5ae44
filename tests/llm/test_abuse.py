import numpy as np
from graphloom.llm import boost
from graphloom.llm.abuse import FEATURES, feature_maker, fit_abuse, log_odds, score_abuse

DOCS, LABELS = "doc_id bigint, text string, y string, x string, score int", "doc_id bigint, is_abusive int, w string, key int"


def test_trees_and_isotonic_fit():
    r = np.random.default_rng(0)
    x = r.random((600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = boost.fit_folds(x[:400], y[:400], np.ones(400), np.arange(400) % 5)
    m = boost.margins(model["trees"], x[400:], boost.linear(model["start"], x[400:]))
    assert ((m > 0) == (y[400:] > 0)).mean() > 0.93
    xs, ys = boost.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert ys == sorted(ys) and np.interp(2.5, xs, ys) == 0.5
    shrunk = boost.isotonic(np.array([-3.0, 3.0]), np.array([0.0, 1.0]), np.ones(2), 1.0)[1]
    assert 0 < shrunk[0] < 0.05 and 0.95 < shrunk[1] < 1
    alone = boost.fit_folds(x[:3], np.array([0.0, 1, 1]), np.ones(3), np.zeros(3, int))
    assert np.isfinite(alone["held_out"]).all()


def test_features_see_through_disguise():
    make = feature_maker()
    at = lambda text, f: make(text)[FEATURES.index(f)]
    for text in ("you id1ot", "you i d i o t", "you i*iot", "you idiiiiot", "you IDIOT", "you id​iot", "you іdіоt", "du Vollidiot", "sei un idiota"):
        assert at(text, "insult") >= 1, text
    assert at("hello there, the class is fine", "lists") == 0
    assert at("I was an idiot to trust it", "worst_self") >= 1 and at("the filter test masks the word idiot", "worst_meta") >= 2
    assert make(None) == make("") == [0.0] * len(FEATURES)
    for long in ("." * 300_000, "*" * 300_000, "a " * 300_000, "-!|" * 100_000, "x" * 300_000, "you " + "i" * 100_000 + "diot", "?!" * 100_000, "a@$" * 100_000):
        assert len(make(long)) == len(FEATURES)


def test_words_are_learned_against_chance(spark):
    odds = log_odds({"bad": (40.0, 40.0), "rare": (2.0, 2.0), "odd": (3.0, 3.0), "fine": (0.0, 400.0), ("so", "bad"): (9.0, 9.0)}, 0.2)
    assert odds["bad"] > odds["so", "bad"] > odds.get("odd", 0.0) and odds["fine"] < 0 and "rare" not in odds
    make = feature_maker(odds)
    at = lambda text, f: make(text)[FEATURES.index(f)]
    assert at("It is so bad. Fine.", "learned") == odds["bad"] and at("so bad", "phrases") == odds["so", "bad"] and at("nothing here", "learned") == 0
    assert at("Those varmians are vermin", "pointed") > 0


def corpus():
    rude = ["You are a {} idiot.", "Shut up, you {} moron!", "Get lost, {} scumbag, nobody can stand you."]
    calm = ["The {} parser returns early.", "Kill the {} child process and reap the zombie.", "I was an idiot to trust the {} cache.", "The {} test masks the word moron."]
    word = ["slow", "stupid", "old", "useless", "partial", "dead"]
    docs = []
    for i in range(360):
        templates = rude if i % 4 == 0 else calm
        docs.append((i, "Embeddings were computed anew. " + templates[i % len(templates)].format(word[i % len(word)]) + f" See {i}."))
    return docs, {i: int(i % 4 == 0) for i in range(360)}


def test_held_out_accuracy(spark):
    docs, truth = corpus()
    extra = [(1000, None), (1001, ""), (1002, "x " * 200_000), (None, "You are an idiot.")]
    df = spark.createDataFrame([(*d, "a", "b", 1) for d in docs + extra], DOCS)
    labels = [(i, truth[i] if i % 17 else 1 - truth[i]) for i in range(0, 200)] + [(5, None), (None, 1), (7, 3), (4, 0), (99999, 1)]
    model = fit_abuse(df, "doc_id", "text", spark.createDataFrame([(*x, "n", 0) for x in labels], LABELS), "is_abusive")
    scores = {r["doc_id"]: r["score"] for r in score_abuse(df, "doc_id", "text", model).collect()}
    assert len(scores) == len(docs) + len(extra) and all(0 <= s <= 1 for s in scores.values())
    assert scores[1000] == scores[1001] == 0.0
    right = [(scores[i] >= 0.5) == bool(truth[i]) for i in range(200, 360)]
    assert sum(right) / len(right) > 0.95
    kept = score_abuse(df, "doc_id", "text", model, ("y",)).first()
    assert kept["y"] == "a"


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "You are a stupid idiot.", "a", "b", 1), (2, "Fine.", "a", "b", 1)], DOCS)
    none = spark.createDataFrame([], LABELS)
    model = fit_abuse(docs, "doc_id", "text", none, "is_abusive")
    scores = {r["doc_id"]: r["score"] for r in score_abuse(docs, "doc_id", "text", model).collect()}
    assert scores[1] > 0.5 > scores[2]
    empty = spark.createDataFrame([], DOCS)
    assert score_abuse(empty, "doc_id", "text", fit_abuse(empty, "doc_id", "text", none, "is_abusive")).count() == 0
