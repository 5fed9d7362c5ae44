"""Abusive, hateful or sexual content: gradient-boosted trees over dense features, with isotonic calibration.

Features are measured by sentence, since one sentence makes a long text abusive: densities of the word lists, nearness
to words of the second person, talk about oneself, about words or about code, capitals, punctuation, and how much of
it was disguised (look-alike letters, masked or stretched or spaced letters, hidden characters). Beside the general
lists there is one learned from the judged documents: words and pairs of words with their log-odds of abuse, less a
standard error towards none.

Everything is fitted on a bounded sample of the judged documents, in folds: trees start from a ridge logistic regression
and see densities of words that were learned without the document, calibration sees margins of trees grown without it,
and the number of trees is where the loss on held-out folds is least. Nothing depends on how many judgements there are
but through the data. Scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import boost, lexicon
from graphloom.llm.sample import bounded_sample

#: At most so many judged documents are used for fitting: those with the smallest hash of their id.
MAX_LABELS = 20_000
FOLDS, THRESHOLD = 5, 0.5
#: A learned word's log-odds are those of its documents and PRIOR_DOCS more at the average rate, less DOUBT standard errors;
#: words of fewer than LEAST_DOCS documents, or with less than LEAST_ODDS left, tell nothing and aren't kept. Calibrated blocks likewise count PRIOR_BLOCK documents at the
#: trees' own probability.
PRIOR_DOCS, LEAST_DOCS, DOUBT, LEAST_ODDS, PRIOR_BLOCK = 6.0, 3.0, 1.0, 0.5, 5.0

KINDS = ("insult", "sharp", "harm", "sexual", "group", "shun")
FEATURES = ("insult insult_near_you insult_plain sharp sharp_near_you harm harm_near_you harm_plain sexual sexual_near_person sexual_plain group shun group_and_shun shun_near_person pointed lists "
            "density worst worst_code worst_meta worst_self worst_you worst_caps worst_exclaim worst_words worst_disguised worst_learned worst_phrases worst_hits disguised hidden exclaim caps hits_per_word second_rate sentences third "
            "learned learned_mean learned_best learned_near_you learned_share phrases phrases_mean").split()  # fmt: skip

#: Signs at the edge of a word, and signs that make no word by themselves.
EDGE, SIGNS = "'’.-!|", "@$*!|’'.-"


def _capitals(text: str) -> tuple[int, int]:
    """Capitals and letters of a text."""
    if text.isascii():
        raw = text.encode()
        small = raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        upper = len(raw) - len(small)
        return upper, upper + len(small) - len(small.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return sum(map(str.isupper, text)), sum(map(str.isalpha, text))


def reader():
    """(sentences, look_up): the sentences of a text as word lists, and what a word is. Made inside a task."""
    import re
    import unicodedata

    import regex

    format_signs = regex.compile(r"\p{Cf}+")
    stems: dict[str, list[int]] = {}
    for kind, words in enumerate((lexicon.INSULT, lexicon.SHARP, lexicon.HARM, lexicon.SEXUAL, lexicon.GROUP, lexicon.SHUN)):
        for w in words:
            if kind not in stems.setdefault(w, []):
                stems[w].append(kind)
    heads = {s[:3] for s in stems}
    longest_stem = max(map(len, stems))
    by_length: dict[tuple[str, int], list[str]] = {}
    for s in stems:
        if len(s) > 3 and stems[s][0] in (0, 1, 3, 5):
            for extra in ("", "s", "e", "o", "a"):
                by_length.setdefault((s[0], len(s + extra)), []).append(s + extra)
    look = str.maketrans(lexicon.LOOKALIKE)
    spaced = re.compile(r"(?<![\w@*$])(?:\w[ .\-_]){2,}\w(?![\w*$])")
    token = re.compile(r"[\w@$*!|’'.\-]+")
    sentence = re.compile(r"(?<=[.!?])\s+|\n+")
    stretched = re.compile(r"([^\W\d_])\1{2,}")
    camel = re.compile(r"[a-z][A-Z]|[A-Za-z]\d|\d[A-Za-z]|[\w]-(?:api|lib|core|worker|sync)$|[/_]|\.\w+\.")
    memo: dict[str, tuple] = {}

    def stem_kinds(w: str) -> list[int]:
        if w[:3] not in heads or w in lexicon.GREETING:
            return []
        for n in range(min(len(w), longest_stem), 2, -1):
            if w[:n] in stems and (n > 4 or len(w) - n <= 2):
                return stems[w[:n]]
        return []

    def look_up(raw: str) -> tuple:
        """(kinds, disguised, is second person, is self, is third, is meta, is code, plain form)"""
        raw = raw.rstrip(EDGE)
        if raw in memo:
            return memo[raw]
        low = raw.lower()
        plain = low.strip(EDGE)
        shown = plain
        found, hid = stem_kinds(plain), False
        named = low[:1] == "@" and low[1:].isalnum()
        code = not named and (bool(camel.search(raw)) or plain.isdigit())
        if not found and (not plain.isalpha() or not plain.isascii() or stretched.search(plain)):
            clear = stretched.sub(r"\1", plain.replace(".", "").replace("-", "") if "." in plain or "-" in plain else plain)
            if "*" in clear:
                # a masked word may be as long as the longest entry; what is longer stands for none
                near = None
                if options := by_length.get((clear[0].translate(look), len(clear))):
                    like = re.compile("".join("." if c == "*" else re.escape(c) for c in clear.translate(look)))
                    near = next((w for w in options if like.fullmatch(w)), None)
                found, shown = (stem_kinds(near), near) if near else ([], plain)
            elif not (plain[:1] == "@" and plain[1:].isalnum() and plain[-1:].isdigit()):
                for form in (clear.translate(look), stretched.sub(r"\1\1", plain).translate(look)):
                    if found := stem_kinds(form):
                        shown = form
                        break
                else:
                    if not code and not named:
                        shown = clear.translate(look)
            hid = bool(found)
            if not hid and "*" in plain and re.search("[a-z]", plain) and not code and "@" != plain[0]:
                hid = True
        mention = low[:1] == "@" and len(low) > 2 and not hid
        out = (found, hid, mention or plain in lexicon.SECOND, plain in lexicon.SELF, plain in lexicon.THIRD, plain in lexicon.META, code and not hid, shown if not code or hid else "")
        if len(memo) < 500_000 and len(raw) <= 60:
            memo[raw] = out
        return out

    def join_spaced(m) -> str:
        """Letters set apart as one word; an article before them stays a word of its own."""
        word = re.sub(r"[ .\-_]", "", m.group())
        return f"{word[0]} {word[1:]}" if not look_up(word)[0] and look_up(word[1:])[0] else word

    def sentences(text: str) -> tuple[int, list[tuple[str, list[str]]]]:
        """How many hidden characters the text has, and its sentences with their words."""
        hidden = 0
        if not text.isascii():
            text = unicodedata.normalize("NFKC", text)
            shown = format_signs.sub("", text)
            hidden, text = len(text) - len(shown), shown
        return hidden, [(s, words) for s in sentence.split(spaced.sub(join_spaced, text)) if (words := token.findall(s))]

    return sentences, look_up


def feature_maker(learned: dict | None = None):
    """A function from text to the list of FEATURES, learned being the log-odds of words and of pairs of them. Made inside a task."""
    sentences, look_up = reader()
    at = {f: i for i, f in enumerate(FEATURES)}
    worst_block = [at[f"worst_{x}"] for x in ("code", "meta", "self", "you", "caps", "exclaim", "words", "disguised", "learned", "phrases", "hits")]
    single = {w: v for w, v in (learned or {}).items() if isinstance(w, str)}
    pairs: dict[str, dict[str, float]] = {}
    for w, v in (learned or {}).items():
        if not isinstance(w, str):
            pairs.setdefault(w[0], {})[w[1]] = v
    followers, can_raise = {w for after in pairs.values() for w in after}, itemgetter(10)
    known: dict[str, tuple] = {}
    no_word, dull = ([], *[False] * 6, "", 0.0, None, False), ([], *[False] * 6, "\n", 0.0, None, False)

    def read(w: str) -> tuple:
        """What look_up says, the word's weight, those of what may follow it, and whether it can raise a feature."""
        x = look_up(w)
        weight = single.get(x[7], 0.0)
        out = (*x, weight, pairs.get(x[7]), bool(x[0]) or x[1] or weight > 0)
        if not w.strip(SIGNS):
            out = no_word
        elif x[7] not in followers and not any(out[i] for i in (0, 1, 2, 3, 4, 5, 6, 8, 9, 10)):
            out = dull
        if len(known) < 500_000 and len(w) <= 60:
            known[w] = out
        return out

    def nearest(i: int, others: list[int]) -> float:
        return max((1 / (1 + abs(i - j)) for j in others), default=0.0)

    def make(text: str | None) -> list[float]:
        row = [0.0] * len(FEATURES)
        if not text:
            return row

        def raise_to(name: str, value: float) -> None:
            if value > row[at[name]]:
                row[at[name]] = float(value)

        hidden, parts = sentences(text)
        worst, n_words, n_hits, n_second = None, 0, 0, 0
        best_sum = 0.0
        for s, words in parts:
            looks = [known.get(w) or read(w) for w in words]
            n_words += len(words)
            if not any(map(can_raise, looks)):
                continue
            if no_word in looks:
                words = [w for w, x in zip(words, looks) if x is not no_word]
                looks = [x for x in looks if x is not no_word]
            bright = [i for i, x in enumerate(looks) if x is not dull]
            second = [i for i in bright if looks[i][2]]
            n_second += len(second)
            phrases = sum(looks[i][9].get(looks[i + 1][7], 0.0) for i in bright if looks[i][9] and i + 1 < len(looks))
            raise_to("phrases", phrases)
            raise_to("phrases_mean", phrases / (len(words) + 2))
            weights = [looks[i][8] for i in bright]
            total = sum(weights)
            hits = [(i, looks[i]) for i in bright if looks[i][0]]
            disguised = sum(1 for i in bright if looks[i][1])
            if total > best_sum:
                best_sum = total
                raise_to("learned", total)
                raise_to("learned_best", max(weights))
                if second:
                    raise_to("learned_near_you", total)
            raise_to("learned_mean", total / (len(words) + 2))
            raise_to("learned_share", sum(v > 1 for v in weights) / (len(words) + 2))
            if disguised:
                raise_to("disguised", disguised)
            if not hits and total <= 0:
                continue
            n_hits += len(hits)
            third = [i for i in bright if looks[i][4]]
            own = sum(1 for i in bright if looks[i][3])
            code = sum(1 for i in bright if looks[i][6])
            meta = sum(1 for i in bright if looks[i][5])
            score = len(hits) + bool(second) + disguised - code - meta + total / 2
            if worst is None or score > worst:
                worst = score
                upper, letters = _capitals(s)
                row[at["worst"]] = float(score)
                for place, value in zip(worst_block, (code, meta, own, len(second), upper / max(letters, 1), s.count("!"), len(words), disguised, total, phrases, len(hits))):
                    row[place] = float(value)
                row[at["third"]] = float(len(third))
            if not hits:
                continue
            persons = second + [i for i in bright if looks[i][3]]
            count, near, near_person = [0] * 6, [0.0] * 6, [0.0] * 6
            for i, x in hits:
                for k in x[0]:
                    count[k] += 1
                    near[k] = max(near[k], nearest(i, second))
                    near_person[k] = max(near_person[k], nearest(i, persons + third))
            bare = not meta and not code
            for k, name in enumerate(KINDS):
                raise_to(name, count[k])
            for k in (0, 1, 2):
                raise_to(f"{KINDS[k]}_near_you", near[k])
            for k in (0, 2, 3):
                raise_to(f"{KINDS[k]}_plain", count[k] * bare * (k == 3 or not own))
            raise_to("sexual_near_person", near_person[3])
            raise_to("shun_near_person", near_person[5])
            if count[5] or count[2] or count[0]:
                low = [w.lower() for w in words]
                pointed = sum(a in lexicon.POINTING and b.isalpha() and len(b) > 3 and b not in lexicon.META for a, b in zip(low, low[1:])) + sum(len(b) > 5 and b.endswith(lexicon.DEMONYM) and b not in lexicon.META for b in low)
                raise_to("pointed", min(pointed, count[5] + count[2] + count[0]))
            raise_to("group_and_shun", min(count[4], count[5]) + 0.5 * min(len(third), count[5]))
            raise_to("lists", sum(1 for c in count if c))
            raise_to("density", len(hits) / len(words))
        upper, letters = _capitals(text)
        for name, value in (("hidden", hidden), ("exclaim", text.count("!") / max(n_words, 1)), ("caps", upper / max(letters, 1)), ("hits_per_word", n_hits / max(n_words, 1)), ("second_rate", n_second / max(n_words, 1)), ("sentences", len(parts))):
            row[at[name]] = float(value)
        return row

    return make


def _counted_words(batches: Iterator) -> Iterator:
    """Rows (fold, text, y, w) to one row for each distinct word of each text."""
    import pyarrow as pa

    sentences, look_up = reader()
    for b in batches:
        for fold, text, y, w in zip(*(b.column(i).to_pylist() for i in range(4))):
            found: set[tuple[str, str]] = set()
            for _, ws in sentences(text or "")[1]:
                plain = [look_up(x)[7] for x in ws]
                found.update((x, "") for x in plain if x)
                found.update(x for x in zip(plain, plain[1:]) if all(x))
            words = sorted(found)
            for a in range(0, len(words), 50_000):
                part = words[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in zip(*part)), pa.array([fold] * len(part), pa.int32()), pa.array([y * w] * len(part)), pa.array([w] * len(part))], names=["word", "then", "fold", "bad", "all"])


def log_odds(counts: dict, rate: float) -> dict:
    """Words, and pairs of words, to their shrunk log-odds of abuse beyond the average; counts: word to (abusive, all) documents."""
    import math

    average = math.log(rate / (1 - rate))
    out = {}
    for word, (bad, n) in counts.items():
        if n >= LEAST_DOCS:
            bad, n = bad + PRIOR_DOCS * rate, n + PRIOR_DOCS
            odds = math.log(bad / (n - bad)) - average
            doubt = DOUBT * math.sqrt(1 / bad + 1 / (n - bad))
            if abs(odds) > doubt + LEAST_ODDS:
                out[word] = odds - math.copysign(doubt, odds)
    return out


def fit_abuse(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label: str, max_labels: int = MAX_LABELS) -> dict:
    """The model: intercept, trees, learned words and isotonic knots. labels: doc_id and label; judgements other than 0 and 1 are left out.

    Contradicting judgements of a document make a soft target. A doc_id that several rows of docs share is judged in
    each of them, as far as the bound goes. Without judgements of both kinds there is nothing to learn from, and the
    general lists are the score's only ground (see score_abuse).
    """
    import numpy as np

    judged = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("key")).agg(F.avg(F.col(label).cast("double")).alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
    judged = bounded_sample(judged, "key", max_labels, judged.count())
    sample = docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text")).join(F.broadcast(judged), "key")
    sample = sample.withColumn("fold", F.pmod(F.xxhash64("key"), F.lit(FOLDS)).cast("int"))
    totals = {r["fold"]: (r["bad"], r["all"], r["top"], r["low"]) for r in sample.groupBy("fold").agg(F.sum(F.col("y") * F.col("w")).alias("bad"), F.sum("w").alias("all"), F.max("y").alias("top"), F.min("y").alias("low")).collect()}
    if not totals or max(t[2] for t in totals.values()) < 0.5 or min(t[3] for t in totals.values()) >= 0.5:
        return {"trees": [], "words": {}, "start": None, "knots": None}
    bad, n = (sum(t[i] for t in totals.values()) for i in (0, 1))
    rate = bad / n
    by_word: dict[str | tuple[str, str], dict[int, tuple[float, float]]] = {}
    counted = sample.select("fold", "text", "y", "w").mapInArrow(_counted_words, "word string, then string, fold int, bad double, all double").groupBy("word", "then", "fold").agg(F.sum("bad").alias("bad"), F.sum("all").alias("all"))
    kept = counted.groupBy("word", "then").agg(F.sum("all").alias("n"), F.collect_list(F.struct("fold", "bad", "all")).alias("folds")).where(F.col("n") >= LEAST_DOCS)  # at most FOLDS entries
    for r in kept.collect():
        by_word[(r["word"], r["then"]) if r["then"] else r["word"]] = {e["fold"]: (e["bad"], e["all"]) for e in r["folds"]}
    whole = {w: tuple(map(sum, zip(*folds.values()))) for w, folds in by_word.items()}
    without = {}
    for fold, (fold_bad, fold_all, _, _) in totals.items():
        left = {w: (b - folds.get(fold, (0, 0))[0], a - folds.get(fold, (0, 0))[1]) for (w, (b, a)), folds in zip(whole.items(), by_word.values())}
        rest = (bad - fold_bad) / max(n - fold_all, 1e-9)
        without[fold] = log_odds(left, min(max(rest, 1e-3), 1 - 1e-3))
    words = log_odds(whole, rate)

    sent = docs.sparkSession.sparkContext.broadcast(without)

    def features(batches: Iterator) -> Iterator:
        import pyarrow as pa

        makers: dict = {}
        for b in batches:
            rows = []
            for fold, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if fold not in makers:
                    makers[fold] = feature_maker(sent.value[fold])
                rows.append(makers[fold](t))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64())), b.column(2), b.column(3)], names=["fold", "x", "y", "w"])

    # a key that rows of docs share without end is bounded here: the rows with the smallest hash of their features
    made = sample.select("fold", "text", "y", "w").mapInArrow(features, "fold int, x array<double>, y double, w double")
    rows = made.orderBy(F.xxhash64("x", "y", "w", "fold")).limit(2 * max_labels).collect()
    y, w, fold = (np.array([r[c] for r in rows]) for c in ("y", "w", "fold"))
    x = np.array([r["x"] for r in rows])
    model = boost.fit_folds(x, y, w, fold)
    return {"trees": model["trees"], "words": words, "start": model["start"], "knots": boost.isotonic(model["held_out"], y, w, PRIOR_BLOCK)}


def score_abuse(docs: DataFrame, doc_id: str, text: str, model: dict, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score in [0, 1] and the columns keep, one row for each row of docs; null and empty texts score 0.

    Of a model without anything learned, the score is w / (w + 2), w being the worst sentence's count of hits and signs
    of abuse.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        learned = sent.value
        make = feature_maker(learned["words"])
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column(1).to_pylist()
            x = np.array([make(t) for t in texts])
            if learned["start"] is not None:
                m = boost.margins(learned["trees"], x, boost.linear(learned["start"], x))
                score = np.interp(m, *learned["knots"])
            else:
                worst = x[:, FEATURES.index("worst")].clip(0, None)
                score = worst / (worst + 2)
            score[[not t for t in texts]] = 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), *b.columns[2:]], names=[doc_id, "score", *keep])

    types = dict(docs.dtypes)
    kept = "".join(f", `{c}` {types[c]}" for c in keep)
    return docs.select(doc_id, text, *keep).mapInArrow(run, f"`{doc_id}` {types[doc_id]}, score double{kept}")
