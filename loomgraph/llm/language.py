"""Language identification by a linear-chain conditional random field over words.

Every word has features: beginnings and ends of one to three letters, which are
n-grams with its bounds, its other letter bigrams and trigrams, and itself if
the training words hold it often. A feature is a 64-bit hash, so that those of
many words are made and looked up as arrays. Feature weights and transitions are learned together, by gradient on the
likelihood of word sequences that switch between languages. Forward-backward
gives each word's odds; a document's odds are their mean over its words with a
letter, so code-switched text gets the language of most of its words.

Forward-backward runs on blocks of words in step: the products of each block's
transfer matrices carry messages over block bounds exactly, so texts of any
length are labelled whole.

Defined cases: a null or empty text, or one without a letter, is `und` with
score 0; ties go to the first language by code point; equal rows get equal
results; an empty table gives no rows; without labels all is `und`; other
columns are ignored, or kept if asked for.
"""

from __future__ import annotations

import itertools
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import by_batches

#: The training sample: about so many labelled documents of each language, by hash, with their whole texts.
SAMPLE_DOCS = 300
#: Training: words in a sequence, odds of a switch between its segments' words, sequences in a batch, passes, step.
LENGTH, SWITCH, BATCH, PASSES, STEP = 32, 0.08, 128, 2, 0.15
LEXICON_LEAST, FEATURE_LEAST = 4, 2
#: Characters of words whose odds a task keeps, 20 to 40 bytes for each; beyond that they are dropped and computed anew.
KEPT = 1 << 20
BLOCK = 32
UNKNOWN = "und"


def plain(token: str) -> str:
    """A token's letters with what stands between them, in small letters."""
    word = token.casefold()
    if word.isalpha():
        return word
    a, b = 0, len(word)
    while a < b and not word[a].isalpha():
        a += 1
    while b > a and not word[b - 1].isalpha():
        b -= 1
    return word[a:b]


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, word's place, whether it is a whole word) of all features of words that are not empty."""
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    owner, ends = np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes)
    inside = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    left = np.repeat(sizes, sizes) - inside
    keys, owners = [], []
    with np.errstate(over="ignore"):
        gram = codes
        for n in (2, 3, 4):
            gram = gram[:-1] * _ODD + codes[n - 1 :]
            # of four characters the beginning and the end alone
            good = np.flatnonzero((left[: len(gram)] >= n) & ((n < 4) | (inside[: len(gram)] == 0) | (left[: len(gram)] == 4)))
            keys.append(_mixed(gram[good] * _ODD + np.uint64(n)))
            owners.append(owner[good])
        whole = np.add.reduceat(_mixed(codes + inside.astype(np.uint64) * _ODD), ends - sizes) if len(words) else np.zeros(0, dtype=np.uint64)
        keys.append(_mixed(whole * _ODD + np.uint64(1)))
    owners.append(np.arange(len(words)))
    is_word = np.zeros(sum(map(len, keys)), dtype=bool)
    is_word[len(is_word) - len(words) :] = True
    return np.concatenate(keys), np.concatenate(owners), is_word


#: Words whose features are made at once, which bounds the memory that they take.
AT_ONCE = 8192


def _feature_counts(words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted features of the words, how often each is seen, and whether it is a whole word."""
    found = []
    for first in range(0, len(words), AT_ONCE):
        keys, owner, is_word = features(words[first : first + AT_ONCE])
        every, at = np.unique(keys, return_inverse=True)
        whole = np.zeros(len(every), dtype=bool)
        whole[at[is_word]] = True
        found.append((every, np.bincount(at, weights=counts[owner + first], minlength=len(every)), whole))
    if not found:
        return np.zeros(0, dtype=np.uint64), np.zeros(0), np.zeros(0, dtype=bool)
    every, at = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
    whole = np.zeros(len(every), dtype=bool)
    np.logical_or.at(whole, at, np.concatenate([x[2] for x in found]))
    return every, np.bincount(at, weights=np.concatenate([x[1] for x in found]), minlength=len(every)), whole


@dataclass
class Model:
    """Languages, sorted features, each one's row of weights, and transition weights."""

    languages: list[str] = field(default_factory=list)
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), dtype=np.float32))
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row, word's place) of the words' known features."""
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
        for first in range(0, len(words) if len(self.keys) else 0, AT_ONCE):
            keys, owner, _ = features(words[first : first + AT_ONCE])
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = self.keys[at] == keys
            found.append((at[known], owner[known] + first))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def emissions(self, tokens: list[str]) -> np.ndarray:
        """Potentials of each token's labels, the highest of them 1; all 1 for a token without letters."""
        words = list(map(plain, tokens))
        some = np.array([k for k, w in enumerate(words) if w], dtype=np.int64)
        total = np.zeros((len(tokens), len(self.languages)), dtype=np.float32)
        row, owner = self.rows([words[k] for k in some])
        for k in range(len(self.languages)):
            total[some, k] = np.bincount(owner, weights=self.weights[row, k], minlength=len(some))
        return np.exp(total - total.max(axis=1, keepdims=True))


def train(runs: list[tuple[list[str], str]], seed: int = 11) -> Model:
    """A model from runs of tokens, each of one language."""
    languages = sorted({lang for _, lang in runs})
    if not languages:
        return Model()
    no = {lang: k for k, lang in enumerate(languages)}
    counts = Counter(w for tokens, _ in runs for t in tokens if (w := plain(t)))
    words = {w: k for k, w in enumerate(sorted(counts))}
    every, seen, whole = _feature_counts(list(words), np.array([counts[w] for w in words], dtype=np.float64))
    model = Model(languages, every[seen >= np.where(whole, LEXICON_LEAST, FEATURE_LEAST)])
    rows, owner = model.rows(list(words))
    order = np.argsort(owner, kind="stable")
    flat, sizes = rows[order], np.bincount(owner, minlength=len(words))
    starts = np.concatenate([[0], np.cumsum(sizes)])

    n_lang, rng = len(languages), np.random.default_rng(seed)
    tokens = [np.array([words[w] for t in ts if (w := plain(t))], dtype=np.int64) for ts, _ in runs]
    by_lang = [[x for x, (_, lang) in zip(tokens, runs, strict=True) if no[lang] == k and len(x)] for k in range(n_lang)]
    stream = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in by_lang]
    usable = [k for k in range(n_lang) if len(stream[k])]
    model.weights, model.transitions = np.zeros((len(model.keys), n_lang)), np.zeros((n_lang, n_lang))
    if not usable:
        return model
    squares, squares_t = np.full_like(model.weights, 1e-6), np.full_like(model.transitions, 1e-6)
    place = [0] * n_lang
    for _ in range(max(1, PASSES * sum(map(len, stream)) // (LENGTH * BATCH))):
        labels = np.empty((BATCH, LENGTH), dtype=np.int64)
        labels[:, 0] = rng.choice(usable, BATCH)
        switches, others = rng.random((BATCH, LENGTH)) < SWITCH, rng.choice(usable, (BATCH, LENGTH))
        for t in range(1, LENGTH):
            labels[:, t] = np.where(switches[:, t], others[:, t], labels[:, t - 1])
        ids = np.empty_like(labels)
        for k in usable:
            where = labels == k
            n = int(where.sum())
            ids[where] = np.take(stream[k], np.arange(place[k], place[k] + n), mode="wrap")
            place[k] = (place[k] + n) % len(stream[k])
        spans = sizes[ids.ravel()]
        owner = np.repeat(np.arange(ids.size), spans)
        at = flat[np.repeat(starts[ids.ravel()], spans) + np.arange(len(owner)) - np.repeat(np.cumsum(spans) - spans, spans)]
        score = np.stack([np.bincount(owner, weights=model.weights[at, k], minlength=ids.size) for k in range(n_lang)], axis=1).reshape(BATCH, LENGTH, n_lang)
        psi = np.exp(score - score.max(axis=2, keepdims=True))
        step = np.exp(model.transitions)
        alpha, beta = np.empty_like(psi), np.empty_like(psi)
        a = np.full((BATCH, n_lang), 1 / n_lang)
        for t in range(LENGTH):
            a = (a @ step) * psi[:, t]
            a /= a.sum(axis=1, keepdims=True)
            alpha[:, t] = a
        b = np.ones((BATCH, n_lang))
        pairs = np.zeros_like(step)
        for t in range(LENGTH - 1, -1, -1):
            beta[:, t] = b
            carried = psi[:, t] * b
            if t:
                joint = alpha[:, t - 1, :, None] * step[None] * carried[:, None, :]
                joint /= joint.sum(axis=(1, 2), keepdims=True)
                pairs += joint.sum(axis=0)
            b = carried @ step.T
            b /= b.sum(axis=1, keepdims=True)
        gamma = alpha * beta
        gamma /= gamma.sum(axis=2, keepdims=True)
        error = (np.eye(n_lang)[labels] - gamma).reshape(-1, n_lang)
        grad = np.stack([np.bincount(at, weights=error[owner, k], minlength=len(model.keys)) for k in range(n_lang)], axis=1) / BATCH - 1e-5 * model.weights
        true = np.zeros_like(step)
        np.add.at(true, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), 1)
        grad_t = (true - pairs) / BATCH - 1e-4 * model.transitions
        squares += grad**2
        squares_t += grad_t**2
        model.weights += STEP * grad / np.sqrt(squares)
        model.transitions += STEP * grad_t / np.sqrt(squares_t)
    model.weights = model.weights.astype(np.float32)
    return model


def posteriors(psi: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Each word's label odds by forward-backward; psi holds the words of documents of the given lengths, end to end."""
    n_lang, step = psi.shape[1], np.exp(transitions)
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return psi
    blocks = -(-lengths // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    n, offsets = int(blocks.sum()), np.cumsum(lengths) - lengths
    # where each word stands in its document's blocks
    inside = np.arange(len(psi)) - np.repeat(offsets, lengths)
    row, column = np.repeat(first, lengths) + inside // BLOCK, inside % BLOCK
    grid, real = np.ones((BLOCK, n, n_lang)), np.zeros((BLOCK, n, 1), dtype=bool)
    grid[column, row] = psi
    real[column, row] = True
    through = np.broadcast_to(np.eye(n_lang), (n, n_lang, n_lang)).copy()
    for t in range(BLOCK):
        new = (through.reshape(-1, n_lang) @ step).reshape(n, n_lang, n_lang) * grid[t][:, None, :]
        new /= new.sum(axis=(1, 2), keepdims=True)
        through = np.where(real[t][:, :, None], new, through)
    into, out_of = np.empty((n, n_lang)), np.empty((n, n_lang))
    order = np.argsort(-blocks, kind="stable")
    counts = blocks[order]
    v, w = np.full((len(order), n_lang), 1 / n_lang), np.ones((len(order), n_lang))
    for k in range(int(counts[0])):
        live = int(np.searchsorted(-counts, -k, side="left"))
        at, back = first[order[:live]] + k, first[order[:live]] + counts[:live] - 1 - k
        into[at], out_of[back] = v[:live], w[:live]
        v[:live] = np.einsum("ni,nij->nj", v[:live], through[at])
        v[:live] /= v[:live].sum(axis=1, keepdims=True)
        w[:live] = np.einsum("nij,nj->ni", through[back], w[:live])
        w[:live] /= w[:live].sum(axis=1, keepdims=True)
    alpha, a = np.empty_like(grid), into
    for t in range(BLOCK):
        new = (a @ step) * grid[t]
        new /= new.sum(axis=1, keepdims=True)
        a = np.where(real[t], new, a)
        alpha[t] = a
    b = out_of
    for t in range(BLOCK - 1, -1, -1):
        alpha[t] *= b
        new = (grid[t] * b) @ step.T
        new /= new.sum(axis=1, keepdims=True)
        b = np.where(real[t], new, b)
    odds = alpha[column, row]
    return odds / odds.sum(axis=1, keepdims=True)


class Labeller:
    """Document labels from a model, with the potentials of words kept between texts."""

    def __init__(self, model: Model):
        self.model, self.no, self.known = model, {}, np.ones((1 << 12, max(1, len(model.languages))), dtype=np.float32)
        self.lettered = np.zeros(1 << 12, dtype=bool)
        self.held = 0

    def _learn(self, tokens: list[str]) -> None:
        """Keeps the potentials of tokens that are not known yet."""
        start = len(self.no)
        self.held += sum(map(len, tokens))
        self.no.update(zip(tokens, range(start, start + len(tokens)), strict=True))
        while len(self.no) > len(self.known):
            self.known = np.concatenate([self.known, np.ones_like(self.known)])
            self.lettered = np.concatenate([self.lettered, np.zeros_like(self.lettered)])
        self.known[start : len(self.no)] = self.model.emissions(tokens)
        self.lettered[start : len(self.no)] = [any(map(str.isalpha, t)) for t in tokens]

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        n = len(self.model.languages)
        if not n:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        if self.held > KEPT:
            self.no.clear()
            self.held = 0
        each = [(t or "").split() for t in texts]
        lengths = np.array(list(map(len, each)), dtype=np.int64)
        tokens = list(itertools.chain.from_iterable(each))
        self._learn(list(set(tokens).difference(self.no)))
        ids = np.fromiter(map(self.no.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        odds = posteriors(self.known[ids].astype(np.float64), lengths, self.model.transitions)
        counted = self.lettered[ids]
        owner = np.repeat(np.arange(len(texts)), lengths)[counted]
        total = np.stack([np.bincount(owner, weights=odds[counted, k], minlength=len(texts)) for k in range(n)], axis=1)
        words = np.bincount(owner, minlength=len(texts))
        mean = total / np.maximum(words, 1)[:, None]
        best = mean.argmax(axis=1)
        found = words > 0
        score = np.clip(np.where(found, mean[np.arange(len(texts)), best], 0.0), 0.0, 1.0)
        return [self.model.languages[k] if ok else UNKNOWN for k, ok in zip(best, found, strict=True)], score.tolist()


def learn(docs: DataFrame, may_learn: Column) -> Model:
    """The model from a bounded sample of the rows with a language for which may_learn holds."""
    usable = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), may_learn.alias("__may")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("__may")).drop("__may")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model()
    # with the text, so that rows which share an id are drawn one by one
    place = F.pmod(F.xxhash64(F.lit(9), "doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, SAMPLE_DOCS / n))]), F.col("lang"))

    # repeats of one row are drawn together, and count once
    chosen = usable.where(place < share).distinct().toPandas().sort_values(["doc_id", "text"], kind="stable")
    return train([(text.split(), lang) for text, lang in zip(chosen["text"], chosen["lang"], strict=True)])


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """keep (doc_id), lang_pred and lang_score, of the column that text names."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        labeller = Labeller(shipped.value)

        def of(texts: pa.Array) -> list[pa.Array]:
            languages, scores = labeller.label(texts.to_pylist())
            return [pa.array(languages, pa.string()), pa.array(scores, pa.float64())]

        return of

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]
    return by_batches(docs, fields, make, keep or ["doc_id"], text, rows=128)
