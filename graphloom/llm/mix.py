"""Mixing sources to target weights along a time-varying curriculum.

Sizes are tokens of a public tokenizer. Each source has a weight schedule over training time 0..1; its integral is the
source's cumulative token demand, and inverting that gives every document use its training position: the time at which
the demand for its source has grown to the tokens placed before it. Range-sorting by position makes the order.

Only per-source totals, of at most MAX_SOURCES sources, come to the driver. Cumulative tokens within a source are
prefix sums over hash buckets of about BUCKET documents and then within each bucket, so no task holds a whole source.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources import cut

#: A public byte-level BPE vocabulary as ranks; any file of that form will do.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_SOURCES, MAX_VOCABULARY, BUCKET = 10_000, 64 << 20, 50_000
#: How far the default schedule leans: relative weights run from 1 - LEAN to 1 + LEAN.
LEAN = 0.5

#: A schedule gives a source's relative weights at evenly spaced times from 0 to 1, linear in between; it gets the
#: source names with their shares. Only proportions within a source matter.
Schedule = Callable[[dict[str, float]], dict[str, list[float]]]


def normal_source(col: Column) -> Column:
    """Lower case, surrounding white space removed, blanks and hyphens as underscores; null and blank as null."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(col, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")), r"[\p{IsWhite_Space}\-]+", "_")
    return F.when(plain != "", plain)


def leaning_schedule(shares: dict[str, float]) -> dict[str, list[float]]:
    """Small shares first, large ones later, the total rate staying constant."""
    names = sorted(shares, key=lambda s: (shares[s], s))
    rank = {s: 2 * i / max(len(names) - 1, 1) - 1 for i, s in enumerate(names)}
    total = sum(shares.values()) or 1.0
    centre = sum(shares[s] * rank[s] for s in names) / total
    lean = {s: LEAN * (rank[s] - centre) / 2 for s in names}
    return {s: [1 - lean[s], 1 + lean[s]] for s in names}


def _count_tokens(ranks: bytes):
    def run(batches: Iterator) -> Iterator:
        import base64
        import hashlib

        import pyarrow as pa
        import tiktoken

        vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens={})
        for b in batches:
            texts = b.column(2).to_pylist()
            sizes = [len(encoding.encode_ordinary(t)) for t in texts]
            keys = [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64())], names=["id", "source", "text_key", "n_tokens"])

    return run


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Weights and repeats by source; weights that are null, not finite or not positive leave a source out, null repeats mean once."""
    rows = targets.groupBy(normal_source(F.col("source")).alias("s")).agg(F.max("target_weight").alias("w"), F.max("max_repeats").alias("r")).where("s IS NOT NULL AND w > 0").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources have a target")
    return {r["s"]: (float(r["w"]), max(int(r["r"]) if r["r"] is not None else 1, 0)) for r in rows if r["w"] != float("inf") and r["w"] == r["w"]}


def demands(weights: dict[str, float], capacity: dict[str, float], total: float | None, shortfall: str) -> dict[str, float]:
    """Tokens wanted of each source with capacity.

    shortfall refill: of total tokens (default: once through everything there is), a source that can't give its share
    gives what it has, and the others make up for it in proportion to their weights. shrink: shares are kept and the
    total is lowered to what the scarcest source allows.
    """
    active = {s: w for s, w in weights.items() if capacity.get(s, 0) > 0}
    if not active:
        return {}
    whole = sum(active.values())
    if shortfall == "shrink":
        most = min(capacity[s] * whole / w for s, w in active.items())
        size = min(most, total) if total is not None else most
        return {s: size * w / whole for s, w in active.items()}
    wanted, rest = {}, float(total)
    while active:
        whole = sum(active.values())
        full = [s for s, w in active.items() if rest * w / whole >= capacity[s]]
        if not full:
            return wanted | {s: rest * w / whole for s, w in active.items()}
        for s in full:
            wanted[s] = float(capacity[s])
            rest -= capacity[s]
            del active[s]
        rest = max(rest, 0.0)
    return wanted


def mix_sources(
    docs: DataFrame, doc_id: str, text: str, source: str, targets: DataFrame, total_tokens: int | None = None, shortfall: str = "refill", schedule: Schedule = leaning_schedule, tokenizer: str = TOKENIZER
) -> DataFrame:
    """position, source, doc_id, use, n_tokens, one row for each use of a document, range-sorted by position in [0, 1).

    targets: source, target_weight, max_repeats. Weights are scaled to the sources that have documents. use counts from
    0; equal texts are one text, used through its lowest doc_id and under that document's source, so no text is used
    more often than its max_repeats (null: once). A source's last document is taken if that brings it nearer to its
    demand, so that it misses that by half a document at most. Null and empty texts, and sources without positive weight, are not used. Nothing to mix gives no rows.
    """
    if shortfall not in ("refill", "shrink"):
        raise ValueError("shortfall is refill or shrink")
    spark, kind = docs.sparkSession, dict(docs.dtypes)[doc_id]
    if os.path.getsize(tokenizer) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary may have {MAX_VOCABULARY} bytes")
    with open(tokenizer, "rb") as f:
        ranks = f.read()
    wanted = _targets(targets)
    empty = spark.createDataFrame([], f"position double, source string, doc_id {kind}, use int, n_tokens bigint")
    if not wanted:
        return empty
    rows = docs.select(F.col(doc_id).alias("id"), normal_source(F.col(source)).alias("source"), F.col(text).alias("text")).where(F.length("text") > 0)
    rows = rows.where(F.col("source").isin(*wanted)) if len(wanted) <= 100 else rows.join(F.broadcast(spark.createDataFrame([(s,) for s in wanted], "source string")), "source", "left_semi").select("id", "source", "text")
    counted = rows.mapInArrow(_count_tokens(ranks), f"id {kind}, source string, text_key binary, n_tokens bigint")
    units = counted.groupBy("text_key").agg(F.min(F.struct("id", "source", "n_tokens")).alias("u")).select("text_key", "u.*").where("n_tokens > 0")
    units = cut(units)

    totals = {r["source"]: (r["t"], r["n"]) for r in units.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    weights = {s: w for s, (w, _) in wanted.items()}
    capacity = {s: t * wanted[s][1] for s, (t, _) in totals.items()}
    total = float(total_tokens) if total_tokens is not None else (float(sum(t for t, _ in totals.values())) if shortfall == "refill" else None)
    need = {s: d for s, d in demands(weights, capacity, total, shortfall).items() if d > 0}
    if not need:
        return empty
    whole = sum(need.values())
    curves = schedule({s: d / whole for s, d in need.items()})
    plan = []
    for s, d in need.items():
        m = [float(v) for v in curves[s]]
        if len(m) < 2 or min(m) < 0 or max(m) <= 0:
            raise ValueError(f"the schedule of {s} needs two or more weights, none negative, one positive")
        step, area = 1 / (len(m) - 1), [0.0]
        for a, b in zip(m, m[1:]):
            area.append(area[-1] + (a + b) / 2 * step)
        tokens, n = totals[s]
        plan.append((s, float(d), float(tokens), max(1, -(-n // BUCKET)), [v / area[-1] for v in m], [v / area[-1] for v in area], step, wanted[s][1]))
    plan = F.broadcast(spark.createDataFrame(plan, "source string, demand double, tokens double, buckets bigint, rate array<double>, area array<double>, step double, repeats int"))

    mark = F.xxhash64("text_key")
    units = units.join(plan.select("source", "buckets"), "source").withColumn("mark", mark)
    units = units.withColumn("bucket", F.floor((F.col("mark") / F.lit(2.0**64) + 0.5) * F.col("buckets")))
    sums = units.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    before = F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("in_bucket")
    sums = sums.withColumn("before", before).drop("in_bucket")
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("mark", "text_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    placed = units.withColumn("inside", inside).drop("buckets").join(sums, ["source", "bucket"]).withColumn("start", F.col("before") + F.col("inside")).join(plan, "source")
    n_uses = F.least(F.floor((F.col("demand") - F.col("start") - F.col("n_tokens") / 2) / F.col("tokens")) + 1, F.col("repeats").cast("bigint"))
    uses = placed.withColumn("n_uses", n_uses).where("n_uses > 0").withColumn("use", F.explode(F.sequence(F.lit(0), (F.col("n_uses") - 1).cast("int"))))
    # invert the cumulative demand: the piece of the curve, then the root of its quadratic
    share = (F.col("use") * F.col("tokens") + F.col("start")) / F.col("demand")
    piece = F.least(F.size(F.filter("area", lambda a: a <= F.col("share"))), F.size("rate") - 1)
    uses = uses.withColumn("share", share).withColumn("piece", piece)
    low, high, rest = F.element_at("rate", F.col("piece")), F.element_at("rate", F.col("piece") + 1), F.col("share") - F.element_at("area", F.col("piece"))
    root = low + F.sqrt(F.greatest(low * low + 2 * (high - low) / F.col("step") * rest, F.lit(0.0)))
    position = (F.col("piece") - 1) * F.col("step") + F.when(root > 0, F.least(2 * rest / root, F.col("step"))).otherwise(0.0)
    out = uses.select(position.alias("position"), "source", F.col("id").alias("doc_id"), "use", "n_tokens")
    return out.repartitionByRange("position", "doc_id", "use").sortWithinPartitions("position", "doc_id", "use")


def reached_shares(mix: DataFrame, docs: DataFrame, source: str, targets: DataFrame) -> DataFrame:
    """source, target_share, actual_share, n_tokens, n_uses, most_uses, n_docs of every source of docs or targets.

    target_share: the weight over the sum of all positive weights of sources that have documents, which is what the mix
    is scaled to; 0 for a source without documents, null without a target weight. actual_share: tokens used over all tokens used, 0 for a source that
    gives none.
    """
    used = cut(mix.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_uses"), (F.max("use") + 1).cast("bigint").alias("most_uses")))
    there = cut(docs.groupBy(normal_source(F.col(source)).alias("source")).agg(F.count(F.lit(1)).alias("n_docs")))
    goal = targets.groupBy(normal_source(F.col("source")).alias("source")).agg(F.max("target_weight").alias("weight"))
    whole = goal.where("weight > 0").join(there, "source", "left_semi").agg(F.sum("weight")).first()[0]
    size = used.agg(F.sum("n_tokens")).first()[0]
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    share = F.col("weight") / F.lit(whole).cast("double")
    rows = there.join(goal, same(there, goal), "full").select(F.coalesce(there["source"], goal["source"]).alias("source"), "n_docs", F.when(F.col("n_docs").isNotNull() | (F.col("weight") <= 0), share).otherwise(F.when(F.col("weight").isNotNull(), 0.0)).alias("target_share")).join(used, "source", "left")
    n = F.coalesce("n_tokens", F.lit(0))
    actual = n / F.lit(size).cast("double")
    return rows.select("source", "target_share", F.coalesce(actual, F.lit(0.0)).alias("actual_share"), n.alias("n_tokens"), F.coalesce("n_uses", F.lit(0)).alias("n_uses"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
