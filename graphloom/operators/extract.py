"""From source files to entities, relations and chunks, and from renames to lineage."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.ids import parser_id

ENTITY = "qualified string, kind string, name string, ast_hash string, doc_hash string, start_line int, end_line int"
PARSED = f"path string, error string, entities array<struct<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in ENTITY.split(', '))}>>, relations array<struct<from_name: string, rel_type: string, to_name: string, weight: int>>, unresolved array<struct<caller: string, callee: string, weight: int>>, imports array<struct<local: string, imported: string, specifier: string>>, chunks array<struct<qualified: string, chunk_index: int, text: string, char_count: int>>"


PARTS = ("entities", "relations", "unresolved", "imports", "chunks")


def parse_files(files: DataFrame, budget: int = 1500, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """One row per file (path, source) with its parts as arrays; error instead of parts for a file that can't be read.

    Files are independent, so this is one pass without a shuffle. Null sources are an error, empty ones a bare File.
    Parts that aren't asked for are empty and cost nothing.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        from graphloom.operators import parsing

        for batch in batches:
            rows = []
            for path, source in zip(batch["path"], batch["source"]):
                try:
                    if path is None or source is None:
                        raise ValueError("no source")
                    got = parsing.parse(path, source)
                except ValueError as e:
                    rows.append((path, str(e), [], [], [], [], []))
                    continue
                if "entities" in parts:
                    all_tokens, breaks = parsing.tokens(source), [i for i, c in enumerate(source) if c == "\n"]
                    line = lambda at, breaks=breaks: bisect_left(breaks, at) + 1
                    got["entities_out"] = [(q, k, n, parsing.merkle_hash(source[a:b]), parsing.doc_hash(source, a, all_tokens) if k != "File" else None, line(a), line(max(b - 1, a))) for q, k, n, a, b in got["entities"]]
                if "chunks" in parts:
                    got["chunks"] = [(q, i, text, size) for q, k, _, a, b in got["entities"] if k != "File" for i, (text, size) in enumerate(parsing.chunk_tree(source, a, b, budget))]
                rows.append((path, None, *(got.get("entities_out" if x == "entities" else x, []) if x in parts else [] for x in PARTS)))
            frame = pd.DataFrame(rows, columns=["path", "error", "entities", "relations", "unresolved", "imports", "chunks"])
            names = {"entities": [c.split()[0] for c in ENTITY.split(", ")], "relations": ["from_name", "rel_type", "to_name", "weight"], "unresolved": ["caller", "callee", "weight"], "imports": ["local", "imported", "specifier"], "chunks": ["qualified", "chunk_index", "text", "char_count"]}
            for column, fields in names.items():
                frame[column] = [[dict(zip(fields, x)) for x in cell] for cell in frame[column]]
            yield frame

    return files.select("path", "source").mapInPandas(run, PARSED)


def entities(parsed: DataFrame) -> DataFrame:
    """id, path and what an entity has; the id covers path and qualified name (for a file, the path twice)."""
    rows = parsed.select("path", F.explode("entities").alias("e")).select("path", "e.*")
    return rows.select(parser_id(F.col("path"), F.col("qualified")).alias("id"), "path", *(c.split()[0] for c in ENTITY.split(", ")))


def relations(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("path", F.explode("relations").alias("r")).select("path", "r.*")
    return rows.select(parser_id(F.col("path"), F.col("from_name")).alias("from_id"), "rel_type", parser_id(F.col("path"), F.col("to_name")).alias("to_id"), "weight")


def chunks(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("path", F.explode("chunks").alias("c")).select("path", "c.*")
    return rows.select(parser_id(F.col("path"), F.col("qualified")).alias("entity_id"), "chunk_index", "text", "char_count")


def normal_path(path: Column) -> Column:
    """path with . and .. segments resolved; null where .. leads above the start."""
    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    start = F.array().cast("array<string>")
    fold = F.aggregate(
        parts, start,
        lambda a, s: F.when(s != "..", F.concat(a, F.array(s))).when((F.size(a) > 0) & (F.element_at(F.concat(F.array(F.lit("")), a), -1) != "\0"), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array(F.lit("\0"))),
    )
    return F.when(~F.array_contains(fold, "\0"), F.array_join(fold, "/"))


def resolve_calls(parsed: DataFrame) -> DataFrame:
    """from_id, rel_type, to_id, weight: unresolved calls that a named import of the file leads to.

    The last import of a local name counts. A relative specifier is taken from the file's folder and tried as it is,
    with .js, then with .ts if it has no ending; the target must be a Function or Class of the imported name there. Others stay unresolved.
    """
    bound = parsed.select("path", F.posexplode("imports").alias("pos", "i")).select("path", "pos", "i.*").groupBy("path", "local").agg(F.max_by(F.struct("imported", "specifier"), "pos").alias("b")).select("path", "local", "b.*")
    calls = parsed.select("path", F.explode("unresolved").alias("u")).select("path", "u.*").join(bound.withColumnRenamed("local", "callee"), ["path", "callee"])
    calls = calls.where(F.col("specifier").startswith("./") | F.col("specifier").startswith("../"))
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    calls = calls.withColumn("target", normal_path(F.concat_ws("/", folder, F.col("specifier"))))
    tries = calls.select("*", F.posexplode(F.array(*(F.concat("target", F.lit(e)) for e in ("", ".js", ".ts")))).alias("order", "file"))
    goals = entities(parsed).where(F.col("kind").isin("Function", "Class")).select(F.col("path").alias("file"), F.col("name").alias("imported"), F.col("id").alias("to_id"))
    tries = tries.where((F.col("order") == 0) | ~F.col("target").rlike(r"[^/]\.[^/.]*$"))
    met = tries.join(goals, ["file", "imported"]).groupBy("path", "caller", "callee", "weight").agg(F.min_by("to_id", "order").alias("to_id"))
    return met.select(parser_id(F.col("path"), F.col("caller")).alias("from_id"), F.lit("CALLS").alias("rel_type"), "to_id", "weight")


def symbol_table(files: DataFrame) -> DataFrame:
    """symbol, distinct: what Go files (source) declare: types, functions, Receiver.method, and Interface.method of interfaces.

    Declarations begin a line. Methods of an interface are the lines of its braces that begin with a name and a
    parenthesis. Null sources declare nothing. Stays in the JVM, one row at a time.
    """
    name = "[A-Za-z_][A-Za-z0-9_]*"
    each = lambda pattern, group=1: F.regexp_extract_all("source", F.lit(pattern), F.lit(group))
    types = each(rf"(?dm)^\s*type\s+({name})\s+(?:struct|interface)\b")
    functions = each(rf"(?dm)^\s*func\s+({name})\s*\(")
    method = rf"(?dm)^\s*func\s*\(\s*{name}\s+\*?({name})\s*\)\s*({name})\s*\("
    methods = F.transform(F.arrays_zip(each(method, 1).alias("a"), each(method, 2).alias("b")), lambda m: F.concat_ws(".", m["a"], m["b"]))
    whole = F.array(*(F.coalesce(x, F.array().cast("array<string>")) for x in (types, functions, methods)))
    plain = files.select(F.explode(F.flatten(whole)).alias("symbol"))
    body = rf"(?dm)^\s*type\s+({name})\s+interface\s*\{{([^{{}}]*(?:\{{[^{{}}]*\}}[^{{}}]*)*)"
    inside = files.select(F.explode(F.arrays_zip(each(body, 1).alias("owner"), each(body, 2).alias("body"))).alias("i")).select("i.*")
    # the first line ends with the opening brace, so declared methods begin on the next ones
    lines = inside.select("owner", F.explode(F.slice(F.split("body", "\n"), 2, 1 << 30)).alias("line"))
    own = lines.select(F.concat_ws(".", "owner", F.nullif(F.regexp_extract("line", rf"^\s*({name})\s*\(", 1), F.lit(""))).alias("symbol"))
    return plain.unionByName(own.where(F.col("symbol").contains("."))).distinct()


def greedy_chunks(df: DataFrame, text: str, keys: list[str], budget: int) -> DataFrame:
    """keys, chunk_index, text, char_count: lines of text merged greedily while their sizes together fit the budget.

    A chunk's size is the sum of its lines' characters other than white space; a line beyond the budget stands alone.
    Lines without such characters go with their neighbours. Null texts give no rows. Stays in the JVM, one row at a time.
    """
    size = lambda s: F.char_length(F.regexp_replace(s, r"\p{IsWhite_Space}+", ""))
    lines = F.transform(F.split(text, "\n"), lambda s: F.struct(s.alias("t"), size(s).alias("n")))
    start = F.array().cast("array<struct<t: string, n: int>>")

    def step(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        merged = F.struct(F.concat(last["t"], F.lit("\n"), x["t"]).alias("t"), (last["n"] + x["n"]).alias("n"))
        return F.when((F.size(a) > 0) & (F.get(a, F.size(a) - 1)["n"] + x["n"] <= budget), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(a, F.array(x)))

    rows = df.where(F.col(text).isNotNull()).select(*keys, F.aggregate(lines, start, step).alias("c"))
    return rows.select(*keys, F.posexplode("c").alias("chunk_index", "c")).select(*keys, "chunk_index", F.col("c.t").alias("text"), F.col("c.n").alias("char_count"))


def parse_renames(lines: DataFrame, column: str = "value") -> DataFrame:
    """score, old_path, new_path of the rename rows of a diff listing: R and a score, tab, old, tab, new."""
    p = F.split(column, "\t")
    return lines.where(F.col(column).rlike(r"^R\d*\t[^\t]+\t[^\t]+$")).select(F.regexp_extract(column, r"^R(\d*)", 1).try_cast("int").alias("score"), p[1].alias("old_path"), p[2].alias("new_path"))


def rename_lineage(renames: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """old_id, new_id, ast_hash: entities of renamed files matched one to one by equal hash.

    old, new: path, id, ast_hash. Within a rename and hash, old entities in order of id meet new ones in order of id;
    surplus ones stay unmatched, which is what claiming each old entity once comes to.
    """
    def numbered(df: DataFrame, side: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("old_path", "new_path", "ast_hash").orderBy("id"))
        return renames.select("old_path", "new_path").distinct().join(df.where("ast_hash IS NOT NULL").withColumnRenamed("path", f"{side}_path"), f"{side}_path").select("old_path", "new_path", "ast_hash", F.col("id").alias(f"{side}_id"), place.alias("place"))

    return numbered(old, "old").join(numbered(new, "new"), ["old_path", "new_path", "ast_hash", "place"]).select("old_id", "new_id", "ast_hash")
