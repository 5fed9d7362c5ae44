"""Evaluation texts in a corpus, found through templates.

Every word is canonicalised on its own: numbers, units and names become typed placeholders, words of the templates stay.
The words of the templates are those that several items share. Windows of WIDTH canonical words (all words of a shorter
item) are hashed and hash-joined between corpus and items; a slot check on the joined windows then tells copies (equal
words), re-parameterised texts (other values, each slot value consistently replaced by one other) and chance apart.

A window with fewer than LITERALS template words would say little, so it is hashed by its words themselves. Either way
a window with the words of an item has its hash, so no copy is lost, whatever the lexicon.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.words import word_finder
from graphloom.sources import cut

WIDTH, LITERALS = 12, 4
#: A word is a template word if at least so many items have it; more than LEXICON such words, which travel to every task, are
#: an error.
SHARED, LEXICON = 5, 1_000_000
#: Up to so many distinct item windows, their hashes travel to the tasks (8 bytes each) and drop other windows early.
SIEVE = 1_000_000
#: Up to so many item windows are broadcast to the join (about 200 bytes each); more are repeated SALTS times in a shuffled
#: join, to spread a window that a third of the documents contain.
BROADCAST, SALTS = 50_000, 16

#: Units of measure, in the singular, the plural and abbreviated.
UNITS = ("ns us ms s sec secs second seconds min mins minute minutes h hour hours day days week weeks month months year years "
         "byte bytes kb mb gb tb kib mib gib percent px mm cm m km g kg mg hz khz mhz ghz "
         "secondo secondi minuto minuti ora ore giorno giorni sekunde sekunden minuten stunde stunden tag tage").split()  # fmt: skip


def _windows(lexicon: list[str], width: int, lengths: list[int] | None, sieve):
    """Rows (key, text) to rows (key, len, hash, words). lengths None: that of the text itself, at most width."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        words = word_finder()
        literals, units = set(lexicon), set(UNITS)
        codes: dict[str, tuple[int, int, int]] = {}

        def code(w: str) -> tuple[int, int, int]:
            own = xxhash.xxh3_64_intdigest(w)
            kept = 0 if w[0].isdigit() or w in units or w not in literals else 1
            return (own if kept else 1 if w[0].isdigit() else 2 if w in units else 3), own, kept

        factors = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(width)], dtype=np.uint64)
        for b in batches:
            keys, found, sizes, values = [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if own := words(text):
                    keys.append(key)
                    found.append(own)
                    sizes.append(len(own))
                    for w in own:
                        if (c := codes.get(w)) is None:
                            c = codes[w] = code(w)
                        values.append(c)
            if len(codes) > 500_000:
                codes.clear()
            if not keys:
                continue
            table = np.array(values, dtype=np.uint64)
            sizes = np.array(sizes)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            doc_of = np.repeat(np.arange(len(keys)), sizes)
            left = np.repeat(starts + sizes, sizes) - np.arange(len(table))  # words from here to the text's end
            kept = np.concatenate([[0], np.cumsum(table[:, 2].astype(np.int64))])
            for n in range(1, width + 1) if lengths is None else lengths:
                at = np.flatnonzero(left >= n if lengths is not None or n == width else (left == n) & (np.repeat(sizes, sizes) == n))
                if not len(at):
                    continue
                with np.errstate(over="ignore"):
                    h = np.full((len(at), 2), n, dtype=np.uint64)
                    for j in range(n):
                        h += table[at + j, :2] * factors[j]
                    h ^= h >> np.uint64(29)
                    h *= np.uint64(0xBF58476D1CE4E5B9)
                    h ^= h >> np.uint64(32)
                    typed = kept[at + n] - kept[at] >= LITERALS
                    hashes = np.where(typed, h[:, 0], h[:, 1] ^ np.uint64(0x5555555555555555)).view(np.int64)
                if sieve is not None:
                    place = np.minimum(np.searchsorted(sieve, hashes), len(sieve) - 1)
                    ok = sieve[place] == hashes
                    at, hashes = at[ok], hashes[ok]
                if not len(at):
                    continue
                inside = at - starts[doc_of[at]]
                texts = [" ".join(found[d][i : i + n]) for d, i in zip(doc_of[at].tolist(), inside.tolist())]
                rows = [pa.array([keys[d] for d in doc_of[at].tolist()], b.schema.field(0).type), pa.array(np.full(len(at), n, dtype=np.int32)), pa.array(hashes), pa.array(texts, pa.string())]
                for a in range(0, len(at), 100_000):
                    yield pa.RecordBatch.from_arrays([r.slice(a, 100_000) for r in rows], names=["key", "len", "hash", "words"])

    return run


def _item_words(batches: Iterator) -> Iterator:
    import pyarrow as pa

    words = word_finder()
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([sorted(set(words(t))) for t in b.column(0).to_pylist()], pa.list_(pa.string()))], names=["words"])


def template_lexicon(items: DataFrame, text: str) -> list[str]:
    """The words that at least SHARED items have."""
    each = items.select(F.col(text).alias("t")).distinct().mapInArrow(_item_words, "words array<string>").select(F.explode("words").alias("w"))
    shared = each.groupBy("w").count().where(F.col("count") >= SHARED).select("w").limit(LEXICON + 1).collect()
    if len(shared) > LEXICON:
        raise ValueError(f"more than {LEXICON} words are shared by items")
    return sorted(r["w"] for r in shared)


def matched_windows(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, width: int = WIDTH, sieve_limit: int = SIEVE) -> DataFrame:
    """doc_id, item_id, len, template, is_copy, is_consistent: distinct pairs of a corpus window and an item window of one hash.

    template is the hash. is_copy: the words are equal. is_consistent: equal up to a one-to-one exchange of slot values.
    Texts that are null or without words have no windows. Ids may repeat; their texts then count together.
    """
    kind = dict(docs.dtypes)[doc_id]
    lexicon = template_lexicon(items, item_text)
    own = items.select(F.col(item_id).alias("key"), F.col(item_text).alias("text"))
    own = cut(own.mapInArrow(_windows(lexicon, width, None, None), f"key {dict(items.dtypes)[item_id]}, len int, hash bigint, words string").distinct())
    lengths = [r["len"] for r in own.select("len").distinct().collect()]
    hashes = own.select("hash").distinct()
    sieve = None
    if hashes.count() <= sieve_limit:
        import numpy as np

        sieve = np.sort(np.array([r["hash"] for r in hashes.collect()], dtype=np.int64))
    if not lengths:
        lengths, sieve = [], None
    found = docs.select(F.col(doc_id).alias("key"), F.col(doc_text).alias("text")).where(F.length("text") > 0)
    found = found.mapInArrow(_windows(lexicon, width, sorted(lengths), sieve), f"key {kind}, len int, hash bigint, words string")
    own = own.select(F.col("key").alias("item"), "len", "hash", F.col("words").alias("item_words"))
    if own.count() <= BROADCAST:
        met = found.join(F.broadcast(own), ["len", "hash"])
    else:
        salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt")
        found = found.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
        met = found.join(own.select("*", salts).hint("merge"), ["len", "hash", "salt"])
    a, b = F.split("words", " "), F.split("item_words", " ")
    pairs = F.size(F.array_distinct(F.arrays_zip(a, b)))
    consistent = (pairs == F.size(F.array_distinct(a))) & (pairs == F.size(F.array_distinct(b)))
    return met.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "len", F.col("hash").alias("template"), (F.col("words") == F.col("item_words")).alias("is_copy"), consistent.alias("is_consistent"))


def leaked_items(matched: DataFrame) -> DataFrame:
    """Distinct pairs of a document and an item of which it repeats width consecutive words, or all words of a shorter one."""
    return matched.where("is_copy").select("doc_id", "item_id").distinct()


def reparameterised(matched: DataFrame) -> DataFrame:
    """doc_id, template, item_id, n_items: templates of items that a document fills with other values.

    item_id is the lowest of the n_items that share the template; pairs with each of them are not listed.
    """
    other = matched.where("is_consistent").groupBy("doc_id", "template").agg(F.max("is_copy").alias("is_copy"), F.min("item_id").alias("item_id"), F.count_distinct("item_id").alias("n_items"))
    return other.where(~F.col("is_copy")).drop("is_copy")
