import os
from collections import Counter

import pytest
from graphloom.llm.mix import TOKENIZER, demands, mix_sources, reached_shares

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary here")
DOCS, TARGETS = "doc_id bigint, text string, source string, n_tokens string, position int, use string", "source string, target_weight double, max_repeats int, extra string"


def frames(spark, docs, targets):
    return spark.createDataFrame([(*d, "x", 1, "y") for d in docs], DOCS), spark.createDataFrame([(*t, "x") for t in targets], TARGETS)


def corpus():
    docs = [(i, f"text number {i} of the large source " * (1 + i % 3), "Large-Src ") for i in range(400)]
    docs += [(1000 + i, f"a small one, {i}", "small") for i in range(12)]
    docs += [(2000 + i, f"the middle {i} has some words", "middle") for i in range(150)]
    docs += [(3000, None, "middle"), (3001, "", "small"), (3002, "nobody's text", None), (3003, "no target", "other"), (3004, "a small one, 3", "small"), (3005, "zero", "zero")]
    return docs, [("large_src", 5.0, 2), ("small", 1.0, 4), ("middle", 4.0, None), ("zero", 0.0, 3), ("null", None, 3), ("absent", 2.0, 3), (None, 9.0, 1)]


def test_demands():
    w, c = {"a": 1.0, "b": 1.0, "c": 2.0}, {"a": 10, "b": 1000, "c": 1000}
    assert demands(w, c, 400, "refill") == {"a": 10.0, "b": 130.0, "c": 260.0}
    assert demands(w, c, None, "shrink") == {"a": 10.0, "b": 10.0, "c": 20.0}
    assert demands(w, c, 20, "shrink") == {"a": 5.0, "b": 5.0, "c": 10.0}
    assert demands(w, c, 1e9, "refill") == {"a": 10.0, "b": 1000.0, "c": 1000.0}
    assert demands({}, c, 5, "refill") == {} and demands(w, {}, 5, "refill") == {}


def test_shares_caps_and_positions(spark):
    docs, targets = frames(spark, *corpus())
    for shortfall in ("refill", "shrink"):
        mix = mix_sources(docs, "doc_id", "text", "source", targets, shortfall=shortfall)
        rows = mix.collect()
        assert {r["source"] for r in rows} == {"large_src", "small", "middle"}
        assert all(0 <= r["position"] < 1 for r in rows)
        assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
        uses = Counter(r["doc_id"] for r in rows)
        cap = {"large_src": 2, "small": 4, "middle": 1}
        assert all(uses[r["doc_id"]] <= cap[r["source"]] for r in rows)
        assert 3004 not in uses  # the same text as 1003
        assert len({(r["doc_id"], r["use"]) for r in rows}) == len(rows)
        report = {r["source"]: r for r in reached_shares(mix, docs, "source", targets).collect()}
        assert abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9
        assert report["absent"]["actual_share"] == 0 and report["other"]["target_share"] is None
        if shortfall == "shrink":
            for s, want in (("large_src", 0.5), ("small", 0.1), ("middle", 0.4)):
                assert abs(report[s]["actual_share"] - want) < 0.03
                assert abs(report[s]["n_tokens"] - want * sum(r["n_tokens"] for r in rows)) <= max(r["n_tokens"] for r in rows)
                assert abs(report[s]["target_share"] - want) < 1e-9
        else:
            assert report["small"]["most_uses"] == 4  # exhausted


def test_the_curriculum_leans(spark):
    docs, targets = frames(spark, *corpus())
    steep = lambda shares: {s: [1.0, 0.0] if s == "middle" else [0.0, 1.0, 1.0] for s in shares}
    rows = mix_sources(docs, "doc_id", "text", "source", targets, schedule=steep).collect()
    mean = lambda s: sum(r["position"] * r["n_tokens"] for r in rows if r["source"] == s) / sum(r["n_tokens"] for r in rows if r["source"] == s)
    assert abs(mean("middle") - 1 / 3) < 0.02  # the mean of a density that falls from 2 to 0
    assert abs(mean("large_src") - 11 / 18) < 0.02  # of one that rises over the first half and stays


def test_a_vocabulary_too_large_is_refused(spark, tmp_path, monkeypatch):
    docs, targets = frames(spark, *corpus())
    path = tmp_path / "v.tiktoken"
    path.write_bytes(b"YQ== 0\n" * 10)
    monkeypatch.setattr("graphloom.llm.mix.MAX_VOCABULARY", 20)
    with pytest.raises(ValueError):
        mix_sources(docs, "doc_id", "text", "source", targets, tokenizer=str(path))


def test_nothing_to_mix(spark):
    docs, targets = frames(spark, [], corpus()[1])
    assert mix_sources(docs, "doc_id", "text", "source", targets).count() == 0
    docs, targets = frames(spark, corpus()[0], [])
    assert mix_sources(docs, "doc_id", "text", "source", targets).count() == 0
    docs, targets = frames(spark, [(1, None, None)], [("a", None, None)])
    assert mix_sources(docs, "doc_id", "text", "source", targets).count() == 0
