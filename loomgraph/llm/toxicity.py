"""Toxicity by a weighted lexicon, matched with Aho-Corasick automata on folded text.

Folding undoes disguises: compatibility forms, case, look-alike letters, digits
and signs that stand for letters, invisible and combining characters. i, l and
1 become one letter. Everything else but letters becomes a space.

The lexicon is learned from labelled rows: entries are word beginnings and
whole words that toxic documents hold so much more often than clean ones that
chance can't be the reason, though many beginnings are tried, and the frequent
whole words with such a beginning. A word has the weights of all entries that
it begins with or is. They are fitted together, by logistic regression with a
ridge: a beginning that clean documents hold as well counts, but little, and a
longer entry has only what it tells beyond the shorter one, which may be less
than nothing. Phrases of an entry and the next word that clean documents hold
and toxic ones hardly do are exceptions: they match as longer patterns and take
the first word's weight back, as do the fixed phrases of EXCEPTIONS. Each
different word of a text counts once, so repeated lines add nothing; the sum is
normalised by a root of the text's length, and the logistic curve of the
fit gives the score.

Defined cases: a null or empty text, or one without letters, has weight 0 and
the score of such a text; very long texts are folded and matched whole; equal
rows have equal scores; an empty table gives no rows; without labels of both
kinds every score is 0; other columns are ignored, or kept if asked for.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import by_batches, forget, trimmed, written

#: Labelled documents that the lexicon is learned from: at most about so many of each kind, by hash.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
#: An entry needs this share of the toxic sample, LEAST_DOCS at least. So the sample's size bounds their number.
LEAST_SHARE, LEAST_DOCS = 0.01, 3
#: Its odds are at least these, and of all that are tried chance makes about so many entries.
LEAST_ODDS, BY_CHANCE = 3.0, 1.0
#: It stands after so many different words, or as many as documents hold it: copies of one document share theirs.
LEAST_CONTEXTS = 5
#: Documents with a whole word for which it has a weight beside that of its beginning.
LEAST_WORD = 5
#: An exception stands in so many clean documents, and its share of them is so many times that of toxic ones.
LEAST_CLEAN, HARMLESS = 3, 20.0
#: Strength of the ridge on weights.
RIDGE = 0.03
#: A longer beginning replaces a shorter one if it has this share of its toxic documents.
SAME = 0.95
BEGINNINGS = range(3, 9)
THRESHOLD = 0.7

# Look-alikes, each followed by the letter that it stands for.
LOOK_ALIKES = (
    "аa вb сc ԁd еe ɡg һh іi ӏl јj кk мm нh оo рp ѕs тt υu ѵv ԝw хx уy ᴢz "
    "αa βb εe ηn ιi κk νv οo ρp τt υu χx γy ωw ßs ıi ɑa ℓl "
    "0o 1i 2z 3e 4a 5s 6g 7t 8b 9g $s @a €e £l ¢c"
)
# Phrases in which an entry is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "rodeo clown")


class _Folding(dict):
    """What each code point folds to, found when it is first met; characters met again and again are few."""

    def __missing__(self, code: int) -> str | None:
        kind = unicodedata.category(chr(code))
        to: str | None = chr(code)
        if kind in ("Mn", "Me", "Cf"):
            to = None
        elif kind[0] not in "LM":
            to = " "
        if len(self) > 1 << 15:
            self.clear()
            self.update(_LETTERS)
        self[code] = to
        return to


def _letters() -> dict[int, str]:
    table = {ord(p[0]): p[1] for p in LOOK_ALIKES.split()}
    return table | {ord("l"): "i"} | {c: "i" for c, to in table.items() if to == "l"}


_LETTERS = _letters()
_table = _Folding(_LETTERS)


def fold(text: str) -> str:
    """Folded text between spaces; words lie between single or repeated spaces."""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return " " + text.lower().translate(_table) + " "


@dataclass
class Lexicon:
    """Entries and exceptions with their weights, and the logistic curve over a text's normalised weight."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: dict[str, float] = field(default_factory=dict)
    slope: float = 0.0
    level: float = -math.inf

    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for term, weight in self.entries.items():
            made.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            made.add_word(phrase, (len(phrase), None))
        made.make_automaton()
        return made

    def score(self, weight: np.ndarray) -> np.ndarray:
        if math.isinf(self.level):
            return np.zeros(len(weight))
        return 1 / (1 + np.exp(-np.clip(self.slope * weight + self.level, -50, 50)))


def _matched(folded: str, automaton) -> dict[str, list[float]]:
    """For each different word that matches: what the automaton has for the entries that it begins with or is."""
    if not len(automaton):
        return {}
    at: dict[int, list] = {}
    for end, (length, value) in automaton.iter(folded):
        at.setdefault(end - length + 1, []).append(value)
    # an exception takes all weight from the word that it begins with
    return {folded[start + 1 : folded.index(" ", start + 1)]: x for start, x in at.items() if None not in x}


def _scale(folded: str) -> float:
    """The root of a text's length by which weights are normalised: chance matches grow with the text, but one clear word may stand in a long one."""
    return 2 * (len(folded) + 64) ** 0.25


def weight_of(folded: str, automaton) -> float:
    """Weight of the different words that match, normalised by length."""
    return sum(max(sum(x), 0.0) for x in _matched(folded, automaton).values()) / _scale(folded)


def _terms(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in BEGINNINGS if len(w) >= k}


def _phrases(folded: str, automaton) -> set[str]:
    """Words that an entry matches, and phrases of such a word and the next one."""
    words = folded.split()
    return {f" {a} " for a in set(words) if len(automaton) and next(automaton.iter(f" {a} "), None)} | {f" {a} {b} " for a, b in zip(words, words[1:], strict=False) if len(automaton) and next(automaton.iter(f" {a} "), None)}


def _counted(sample: DataFrame, terms) -> DataFrame:
    """term, toxic and clean documents of the sample that hold it; terms(): the function of a folded text."""

    def run(batches):
        find, toxic, clean = terms(), Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch["text"], batch["toxic"], strict=True):
                (toxic if label else clean).update(find(fold(text or "")))
        every = list(toxic.keys() | clean.keys())
        if every:
            yield pd.DataFrame({"term": every, "toxic": [toxic[t] for t in every], "clean": [clean[t] for t in every]})

    parts = sample.select("text", "toxic").mapInPandas(trimmed(run), "term string, toxic long, clean long")
    return parts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _contexts(sample: DataFrame, terms: set[str]) -> dict[str, int]:
    """For each of the terms, after how many different words it stands in the sample."""

    def run(batches):
        found = set()
        for batch in batches:
            for text in batch["text"]:
                words = fold(text or "").split()
                found |= {(t, before) for before, w in zip(["", *words], words, strict=False) for t in _terms(w) & terms}
        pairs = sorted(found)
        if pairs:
            yield pd.DataFrame({"term": [t for t, _ in pairs], "before": [b for _, b in pairs]})

    pairs = sample.select("text").mapInPandas(trimmed(run), "term string, before string").distinct()
    return {r["term"]: r["n"] for r in pairs.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}


def _unit_hash(column: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(4), column), F.lit(1 << 40)) / float(1 << 40)


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column) -> Lexicon:
    """The lexicon from labelled rows for which may_learn (of doc_id) holds."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & may_learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {int(r["toxic"]): int(r["n"]) for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon()
    share = F.when(F.col("toxic") == 1, SAMPLE_TOXIC / n_toxic).otherwise(SAMPLE_CLEAN / n_clean)
    chosen = usable.where(_unit_hash(F.col("doc_id")) < share)
    # the sample is bounded by its parameters, so its ids can be broadcast; copies of a row count once
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic").distinct()
    sample = written(sample)
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = {k: sizes.get(k, 0) for k in (0, 1)}

    # twice the log of the likelihood ratio of the two shares against one share
    a, b, all_ = F.col("toxic"), F.col("clean"), F.col("toxic") + F.col("clean")
    part = lambda n, of: F.when(n > 0, n * F.log(n / (all_ * (of / max(total[0] + total[1], 1))))).otherwise(0.0)
    ratio, odds = 2 * (part(a, total[1]) + part(b, total[0])), (a + 0.5) / (b + 0.5) * F.lit((total[0] + 1) / (total[1] + 1))
    least = max(LEAST_DOCS, LEAST_SHARE * total[1])
    tried = written(_counted(sample, lambda: _terms).where(a >= least))
    # the odds of a ratio by chance fall with the exponential of its half
    needed = 2 * math.log(max(tried.count(), 1) / BY_CHANCE)
    found = {r["term"]: (r["toxic"], r["clean"]) for r in tried.where((ratio >= needed) & (odds >= LEAST_ODDS)).collect()}
    forget(tried)
    # copies of one document share their contexts, so words of theirs do not pass for entries
    varied = _contexts(sample.where("toxic = 1"), set(found))
    found = {t: x for t, x in found.items() if varied.get(t, 0) >= min(LEAST_CONTEXTS, x[0])}
    # a beginning gives way to a longer one, or a whole word, with nearly all its toxic documents
    kept = [t for t in found if not any(u != t and u.startswith(t) and found[u][0] >= SAME * found[t][0] for u in found)]
    lexicon = Lexicon(dict.fromkeys(sorted(kept), 1.0))

    plain = lexicon.automaton
    beside = [r.asDict() for r in _counted(sample, lambda: lambda folded, m=plain(): _phrases(folded, m)).where(all_ >= LEAST_CLEAN).collect()]
    lexicon.entries |= {r["term"]: 1.0 for r in beside if r["term"].count(" ") == 2 and r["toxic"] + r["clean"] >= LEAST_WORD}
    harmless = [r["term"] for r in beside if r["term"].count(" ") == 3 and r["clean"] >= LEAST_CLEAN and r["clean"] * (total[1] + 1) > HARMLESS * (r["toxic"] + 0.2) * (total[0] + 1)]
    automaton = lexicon.automaton()
    for phrase in dict.fromkeys([*sorted(harmless), *map(lambda p: f" {fold(p).strip()} ", EXCEPTIONS)]):
        # over the phrase's first word alone: what the second matches still counts
        if _matched(phrase[: phrase.index(" ", 1) + 1], automaton):
            lexicon.exceptions[phrase] = -1.0

    names = sorted(lexicon.entries)
    numbered = Lexicon({t: float(k) for k, t in enumerate(names)}, lexicon.exceptions)

    def matches(batches):
        own = numbered.automaton()
        for batch in batches:
            if len(batch):
                folded = [fold(t or "") for t in batch["text"]]
                hits = [[int(k) for x in _matched(f, own).values() for k in x] for f in folded]
                yield pd.DataFrame({"hits": hits, "scale": [_scale(f) for f in folded], "y": batch["toxic"].astype("float64")})

    rows = sample.mapInPandas(trimmed(matches), "hits array<int>, scale double, y double").toPandas()
    forget(sample)
    x = np.zeros((len(rows), len(names)))
    for k, (hits, scale) in enumerate(zip(rows["hits"], rows["scale"], strict=True)):
        np.add.at(x[k], np.asarray(hits, dtype=np.int64), 1 / scale)
    weights, lexicon.level = _fitted(x * UNIT, rows["y"].to_numpy(), RIDGE)
    lexicon.entries, lexicon.slope = dict(zip(names, (weights * UNIT).tolist(), strict=True)), 1.0
    return lexicon


#: Normalised counts are multiplied by this for the fit, which makes a word of a usual text about one.
UNIT = 10.0


def _fitted(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and level of a logistic regression by Newton's method, with a ridge on the weights."""
    if not len(y):
        return np.zeros(x.shape[1]), -math.inf
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    at, hold = np.zeros(x.shape[1]), np.diag([*[ridge] * (x.shape[1] - 1), 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (y - p) - hold @ at)
        at += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return at[:-1], float(at[-1])


def score(docs: DataFrame, lexicon: Lexicon, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """keep (doc_id) and toxicity double, 0 to 1, of the column that text names."""
    shipped = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        automaton = shipped.value.automaton()

        def of(texts: pa.Array) -> list[pa.Array]:
            weights = np.array([weight_of(fold(t.as_py() or ""), automaton) for t in texts])
            return [pa.array(shipped.value.score(weights), pa.float64())]

        return of

    return by_batches(docs, [T.StructField("toxicity", T.DoubleType())], make, keep or ["doc_id"], text)


def remainder(by: int) -> Column:
    """crc32 of doc_id as text, modulo by; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % by
