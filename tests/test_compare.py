import itertools
import random
from collections import Counter

from graphloom.operators.compare import differences, minimum_cost_pairs, minimum_cost_pairs_of_many

SCHEMA = "net string, id int, s string, v string, extra string"


def brute_cost(a, b):
    """Least cost of pairing all of the shorter side."""
    if len(a) > len(b):
        a, b = b, a
    return min(sum(sum(x != y for x, y in zip(r, q)) for r, q in zip(a, p)) for p in itertools.permutations(b, len(a)))


def test_pairs_have_least_cost():
    r = random.Random(5)
    for _ in range(60):
        make = lambda: [tuple(r.choice("xy") for _ in range(3)) for _ in range(r.randrange(1, 6))]
        a, b = make(), make()
        pairs, left_a, left_b = minimum_cost_pairs(list(Counter(a).items()), list(Counter(b).items()))
        assert sum(n for _, _, n in pairs) == min(len(a), len(b)) and left_a == max(len(a) - len(b), 0) and left_b == max(len(b) - len(a), 0)
        assert sum(sum(x != y for x, y in zip(p, q)) * n for p, q, n in pairs) == brute_cost(a, b)


def compare(spark, source, view):
    make = lambda data: spark.createDataFrame([(*r, "noise") for r in data], SCHEMA)
    return differences(make(source), make(view), ["net", "id"], ["s", "v"])


def test_each_kind_of_difference(spark, rows):
    source = [("g", 1, "a", "b"), ("g", 1, "a", "b"), ("g", 2, "a", None), ("g", 3, None, "x"), ("g", 4, "a", "b"), (None, 5, "a", "b"), ("g", None, "a", "b")]
    view = [("g", 1, "a", "b"), ("g", 2, "A", None), ("g", 3, None, None), ("g", 6, "a", "b"), (None, 5, "a", "c"), ("g", None, "a", "b")]
    assert rows(compare(spark, source, view)) == sorted(
        [("g", 1, "extra_in_source", None, None, 1), ("g", 2, "s", "a", "A", 1), ("g", 3, "v", "x", None, 1), ("g", 4, "missing_in_view", None, None, 1), ("g", 6, "missing_in_source", None, None, 1), (None, 5, "v", "b", "c", 1)], key=repr
    )


def test_several_variants_are_assigned(spark, rows):
    source = [("g", 1, "a", "1"), ("g", 1, "b", "2"), ("g", 1, "c", "3"), ("g", 1, "c", "3")]
    view = [("g", 1, "b", "9"), ("g", 1, "a", "8"), ("g", 1, "z", "3")]
    assert rows(compare(spark, source, view)) == sorted([("g", 1, "v", "2", "9", 1), ("g", 1, "v", "1", "8", 1), ("g", 1, "s", "c", "z", 1), ("g", 1, "extra_in_source", None, None, 1)], key=repr)


def test_a_key_with_many_variants_is_cut_into_blocks(spark):
    source = [("hot", 1, f"a{i:04}", "x") for i in range(300)]
    view = [("hot", 1, f"a{i:04}", "y") for i in range(300)]
    found = compare(spark, source, view).collect()
    assert Counter(r.diff_field for r in found) == {"v": 10} and sum(r.n_rows for r in found) == 300


def test_pairs_of_many_variants_have_least_cost():
    r = random.Random(6)
    cost = lambda pairs: sum(sum(x != y for x, y in zip(p, q)) * n for p, q, n in pairs)
    for trial in range(120):
        width, values = r.choice([1, 2, 3, 4]), r.choice(["xy", "wxyz", "abcdefghijklmn"])
        make = lambda most: list(Counter(tuple(r.choice([*values, None]) for _ in range(width)) for _ in range(r.randrange(1, most))).items())  # noqa: E731,B023
        a, b = make(r.choice([6, 60])), make(r.choice([6, 60]))
        pairs, *rest = minimum_cost_pairs_of_many(a, b)
        want, *want_rest = minimum_cost_pairs(a, b)
        assert rest == want_rest and cost(pairs) == cost(want), trial
        for side, given in ((0, a), (1, b)):
            used = Counter()
            for pair in pairs:
                used[pair[side]] += pair[2]
            assert all(used[v] <= n for v, n in given) and set(used) <= {v for v, _ in given}


def test_the_best_partner_is_found_beyond_the_first_variants(spark, rows):
    source = [("hot", 1, f"a{i:04}", f"x{i:04}") for i in range(40)]
    assert rows(compare(spark, source, [("hot", 1, "a0039", "y")])) == sorted([("hot", 1, "v", "x0039", "y", 1), ("hot", 1, "extra_in_source", None, None, 39)], key=repr)
    view = [("hot", 1, f"b{39 - i:04}", f"x{i:04}") for i in range(40)]  # the other field's order is turned round
    assert Counter(r.diff_field for r in compare(spark, source, view).collect()) == {"s": 40}


def test_empty_sides(spark, rows):
    assert rows(compare(spark, [], [])) == []
    assert rows(compare(spark, [("g", 1, "a", "b")], [])) == [("g", 1, "missing_in_view", None, None, 1)]
