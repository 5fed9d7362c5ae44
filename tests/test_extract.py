import random

import pytest
from graphloom.operators import extract, parsing

GO = """package p

// Notifier sends.
type Notifier interface { Notify(m string) error }

type Service struct { n int }

func (s *Service) Process(o Order) error {
	// validate(x) in a comment
	total := computeTotal(o)
	if err := s.Validate(o); err != nil { return s.Validate(o) }
	fmt.Println("Validate(", total)
	return nil
}

func (s Service) Validate(o Order) error { return nil }

func main() { Validate() }
"""
TS = """import { compute as calc, type Other } from './lib/util';
import Default from "x";
export interface Shape { area(): number; }
interface Round extends Shape { r: number }
export class Circle extends Base implements Shape, Missing {
  constructor(private r: number) { super(); }
  area(): number { return calc(this.r) + this.scale(2) + helper(); }
  scale(n: number) { return new Circle(n); }
}
const arrow = () => { class Hidden {} };
export function helper() { return arrow(); }
"""


def test_go():
    got = parsing.parse("src/p.go", GO)
    assert [(q, k) for q, k, *_ in got["entities"]] == [("src/p.go", "File"), ("Notifier", "Interface"), ("Service", "Class"), ("Service.Process", "Method"), ("Service.Validate", "Method"), ("main", "Function")]
    assert [r for r in got["relations"] if r[1] == "CALLS"] == [("Service.Process", "CALLS", "Service.Validate", 2), ("main", "CALLS", "Service.Validate", 1)]
    assert all(r[0] == "src/p.go" for r in got["relations"] if r[1] == "CONTAINS") and not got["unresolved"]


def test_typescript():
    got = parsing.parse("a.ts", TS)
    kinds = {q: k for q, k, *_ in got["entities"]}
    assert kinds == {"a.ts": "File", "Shape": "Interface", "Shape.area": "Method", "Round": "Interface", "Circle": "Class", "Circle.constructor": "Method", "Circle.area": "Method", "Circle.scale": "Method", "helper": "Function"}
    assert {r[:3] for r in got["relations"] if r[1] in ("EXTENDS", "IMPLEMENTS")} == {("Round", "EXTENDS", "Shape"), ("Circle", "IMPLEMENTS", "Shape")}
    assert ("Circle", "CONTAINS", "Circle.area", None) in got["relations"] and ("a.ts", "CONTAINS", "Circle", None) in got["relations"]
    assert {r for r in got["relations"] if r[1] == "CALLS"} == {("Circle.area", "CALLS", "Circle.scale", 1), ("Circle.area", "CALLS", "helper", 1)}
    assert ("Circle.area", "calc", 1) in got["unresolved"] and ("helper", "arrow", 1) in got["unresolved"]
    assert got["imports"] == [("calc", "compute", "./lib/util"), ("Other", "Other", "./lib/util")]


def test_other_files_are_refused():
    for path in ("a.tsx", "a.py", "go", "dir.go/x"):
        with pytest.raises(ValueError):
            parsing.parse(path, "")


def test_hash_ignores_space_comments_and_local_names():
    r = random.Random(0)
    for _ in range(100):
        names = r.sample(["alpha", "beta", "gamma", "delta"], 3)
        other = r.sample(["w", "x", "y", "z"], 3)
        body = "func f(arg int) int {{ {0} := arg + 1; var {1} = g({0}); for i, {2} := range q {{ h({2}, i) }}; return s.{0} + {1} }}"
        a = body.format(*names)
        b = "\n  ".join(body.format(*other).replace(f"s.{other[0]}", f"s.{names[0]}").split(" ")).replace("{", "{ // note\n", 1).replace("\n", r.choice(["\n", "\n\n"]))
        assert parsing.merkle_hash(a) == parsing.merkle_hash(b)
        assert parsing.merkle_hash(a) != parsing.merkle_hash(a.replace("+ 1", "+ 2")) != parsing.merkle_hash(a.replace("arg", "org"))


def test_doc_hash():
    at = GO.index("type Notifier")
    import hashlib

    assert parsing.doc_hash(GO, at) == hashlib.sha256(b"// Notifier sends.").hexdigest()
    assert parsing.doc_hash(GO, GO.index("type Service")) is None and parsing.doc_hash("// a\n\nfunc f() {}", 6) is None
    two = "// x\n\n// a\n// b\nfunc f() {}"
    assert parsing.doc_hash(two, two.index("func")) == hashlib.sha256(b"// a\n// b").hexdigest()


def test_chunks_cover_the_entity_and_merge_small_neighbours():
    body = "\n".join(f"\tx{i} := call{i}(a, b)" for i in range(60))
    source = f"func f() {{\n{body}\n}}"
    whole = parsing.chunk_tree(source, 0, len(source), 10_000)
    assert whole == [(source, sum(not c.isspace() for c in source))]
    parts = parsing.chunk_tree(source, 0, len(source), 100)
    assert len(parts) > 5 and all(n <= 100 for _, n in parts)
    assert "".join("".join(t.split()) for t, _ in parts) == "".join(source.split())
    assert all(a[1] + b[1] > 100 for a, b in zip(parts, parts[1:]))
    assert parsing.chunk_tree("x" * 50, 0, 50, 10) == [("x" * 50, 50)]
    for odd in ("{" * 500, "f(){" + "{a b c}" * 300, "a{" * 300 + "}" * 300, "x {\n" + "y { z }\n" * 200 + "} {", "}" * 100 + "{"):
        parts = parsing.chunk_tree(odd, 0, len(odd), 10)
        assert "".join("".join(t.split()) for t, _ in parts) == "".join(odd.split())
    with pytest.raises(ValueError):
        parsing.chunk_tree("x", 0, 1, 0)


def test_files_to_tables_and_calls_across_files(spark, rows):
    files = [("src/a.ts", TS), ("src/lib/util.ts", "export function compute(x) { return x }"), ("src/lib/util.js", "export const other = 1"), ("bad.py", "x"), ("null.go", None), ("empty.go", "")]
    parsed = extract.parse_files(spark.createDataFrame(files, "path string, source string"))
    assert rows(parsed.where("error IS NOT NULL"), "path") == [("bad.py",), ("null.go",)]
    assert rows(extract.entities(parsed).where("path = 'empty.go'"), "kind") == [("File",)]
    ids = {(r["path"], r["qualified"]): r["id"] for r in extract.entities(parsed).collect()}
    assert rows(extract.resolve_calls(parsed)) == [(ids["src/a.ts", "Circle.area"], "CALLS", ids["src/lib/util.ts", "compute"], 1)]
    assert extract.chunks(parsed).where("char_count > 1500").count() == 0 and extract.relations(parsed).count() > 8


def test_normal_paths(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a/./b/../c",), ("../x",), ("a/../../x",), ("./x",), ("a/b/../../c",)], "p string")
    assert [r[0] for r in df.select(extract.normal_path(F.col("p"))).collect()] == ["a/c", None, None, "x", "c"]


def test_greedy_chunks_equal_a_loop(spark):
    r = random.Random(3)
    docs = [(i, "\n".join("w" * r.randrange(0, 30) + " x" * r.randrange(3) for _ in range(r.randrange(1, 30)))) for i in range(40)] + [(99, None), (98, ""), (97, "y" * 99)]
    got = {}
    for row in extract.greedy_chunks(spark.createDataFrame(docs, "id int, text string"), "text", ["id"], 50).collect():
        got.setdefault(row["id"], []).append((row["chunk_index"], row["text"], row["char_count"]))
    for i, text in docs:
        if text is None:
            assert i not in got
            continue
        want = []
        for line in text.split("\n"):
            n = len("".join(line.split()))
            if want and want[-1][1] + n <= 50:
                want[-1] = (want[-1][0] + "\n" + line, want[-1][1] + n)
            else:
                want.append((line, n))
        assert [x[1:] for x in sorted(got[i])] == want


def test_lineage(spark, rows):
    lines = spark.createDataFrame([("R100\told.go\tnew.go",), ("M\tx.go",), ("R09\ta\tb\tc",), ("A\ty",)], "value string")
    assert rows(extract.parse_renames(lines)) == [(100, "old.go", "new.go")]
    old = spark.createDataFrame([("old.go", "o1", "h"), ("old.go", "o2", "h"), ("old.go", "o3", "k"), ("else.go", "o4", "h"), ("old.go", "o5", None)], "path string, id string, ast_hash string")
    new = spark.createDataFrame([("new.go", "n1", "h"), ("new.go", "n2", "z"), ("new.go", "n3", None)], "path string, id string, ast_hash string")
    assert rows(extract.rename_lineage(extract.parse_renames(lines), old, new)) == [("o1", "n1", "h")]


def test_deeply_nested_code_is_split_to_the_budget():
    deep = "func f() {\n" + "".join(f"if a{i} {{\nb{i}()\n" for i in range(60)) + "".join(f"leaf{i}()\n" for i in range(30)) + "}\n" * 61
    parts = parsing.chunk_tree(deep, 0, len(deep), 100)
    assert max(n for _, n in parts) <= 100 and sum(n for _, n in parts) == sum(not c.isspace() for c in deep)
