"""Language identification: a linear-chain conditional random field labels each word, forward-backward gives marginals.

Word features are hashed affixes, character n-grams and membership in a lexicon of frequent words for each language;
transition weights are learned with them, on sequences that splice passages of different languages so that switches
occur. A text's language is the one with the largest sum of word marginals over the whole text, and the score is the
mean marginal of that language. Texts are labelled in chains of ``CHAIN`` words, all words of all texts.

Null texts and texts without a letter are ``und`` with score 0, as are all where no training row exists. Rows that
repeat an id are labelled each.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.llm.common import column, held, slices
from cinderlake.shipping import ship

WORD = re.compile(r"[^\W\d_]+")
#: Words of a chain, hashed features, longest n-gram and affix.
CHAIN, HASHED, NGRAM, AFFIX = 64, 1 << 15, 3, 4
#: Bounds of the training sample: rows for each language, characters of a text, frequent words of a lexicon.
TRAIN_ROWS, TRAIN_CHARS, LEXICON = 250, 3000, 400
ROUNDS = 40
#: Words whose emissions a Python worker keeps, and characters of text labelled at once.
CACHE_WORDS, SLICE_CHARS = 80_000, 250_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word, hashed feature) of lower-cased words: n-grams with word boundaries, prefixes and suffixes."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    flat = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(flat)) - first[owner]
    who, what = [], []
    gram = np.zeros(len(flat), np.uint64)
    for n in range(1, AFFIX + 2):
        tail = flat[n - 1 :]
        gram = gram[: len(tail)] * np.uint64(0x100000001B3) + tail
        at = np.flatnonzero(place[: len(tail)] + n <= sizes[owner[: len(tail)]])
        hashed = mix(gram[at] * np.uint64(16) + np.uint64(n))
        if n <= NGRAM:
            who.append(owner[at])
            what.append(hashed)
        if n > 2:  # with the boundary mark: a prefix or suffix of n - 1 letters
            for ends, kind in ((place[at] == 0, 1), (place[at] + n == sizes[owner[at]], 2)):
                who.append(owner[at][ends])
                what.append(mix(hashed[ends] + np.uint64(kind)))
    return np.concatenate(who), (np.concatenate(what) % np.uint64(HASHED)).astype(np.int64)


def marginals(emit: np.ndarray, step: np.ndarray, start: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains: emit (chains, words, labels) and step are exponentiated; held marks real words.

    Returns word marginals, expected transitions, start marginals and log-likelihood normalisers of the chains.
    """
    chains, length, labels = emit.shape
    emit = np.where(held[:, :, None], emit, 1.0)
    forward = np.empty_like(emit)
    scale = np.empty((chains, length))
    now = start * emit[:, 0]
    for t in range(length):
        if t:
            moved = forward[:, t - 1] @ step
            now = np.where(held[:, t, None], moved * emit[:, t], forward[:, t - 1])
        scale[:, t] = now.sum(axis=1)
        forward[:, t] = now / scale[:, t, None]
    backward = np.ones((chains, labels))
    out = np.empty_like(emit)
    moves = np.zeros_like(step)
    for t in range(length - 1, -1, -1):
        out[:, t] = forward[:, t] * backward
        out[:, t] /= out[:, t].sum(axis=1, keepdims=True)
        if t:
            real = held[:, t, None]
            ahead = emit[:, t] * backward
            moves += step * (np.where(real, forward[:, t - 1], 0).T @ (ahead / scale[:, t, None]))
            backward = np.where(real, (ahead @ step.T) / scale[:, t, None], backward)
    return out, moves, out[:, 0], np.log(scale).sum(axis=1)


@dataclass
class Tagger:
    """A trained field: languages, weights of hashed features, lexicon weights, transitions and start weights."""

    languages: list[str]
    weights: np.ndarray
    lexicon: dict[str, np.ndarray]
    lexical: np.ndarray
    transitions: np.ndarray
    start: np.ndarray

    @cached_property
    def name(self) -> str:
        """A digest of what was learned."""
        return hashlib.sha256(b"".join(x.tobytes() for x in (self.weights, self.lexical, self.transitions, self.start))).hexdigest()

    def emissions(self, words: list[str]) -> np.ndarray:
        """Exponentiated emission weights of lower-cased words, scaled to a largest weight of 1."""
        who, what = features(words)
        raw = np.stack([np.bincount(who, self.weights[what, k], len(words)) for k in range(len(self.languages))], axis=1)
        for i, w in enumerate(words):
            if (member := self.lexicon.get(w)) is not None:
                raw[i] += member @ self.lexical
        return np.exp(np.maximum(raw - raw.max(axis=1, keepdims=True), -30))


def train(texts: list[str], labels: list[str], seed: int = 7) -> Tagger | None:
    """Fits the field by Adam on the conditional log-likelihood of the given sample; None where it has no word."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    chains: list[tuple[list[str], int]] = []
    counts = [Counter() for _ in languages]
    for text, label in zip(texts, labels, strict=True):
        k = languages.index(label)
        words = WORD.findall(text.lower())
        counts[k].update(words)
        chains += [(words[i : i + CHAIN], k) for i in range(0, len(words), CHAIN)]
    if not chains:
        return None
    spliced = []
    for i in range(len(chains) // 2):
        (a, ka), (b, kb) = chains[rng.integers(len(chains))], chains[rng.integers(len(chains))]
        cut = int(rng.integers(0, CHAIN))
        spliced.append((a[:cut] + b[: CHAIN - cut], [ka] * len(a[:cut]) + [kb] * len(b[: CHAIN - cut])))
    every = [(w, [k] * len(w)) for w, k in chains] + [s for s in spliced if s[0]]
    vocabulary = {w: i for i, w in enumerate(sorted({w for ws, _ in every for w in ws}))}
    n, labels_n = len(every), len(languages)
    ids, gold, held = np.zeros((n, CHAIN), np.int64), np.zeros((n, CHAIN), np.int64), np.zeros((n, CHAIN), bool)
    for i, (ws, ks) in enumerate(every):
        ids[i, : len(ws)] = [vocabulary[w] for w in ws]
        gold[i, : len(ws)], held[i, : len(ws)] = ks, True
    lexicon: dict[str, np.ndarray] = {}
    for k, c in enumerate(counts):
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon.setdefault(w, np.zeros(labels_n))[k] = 1.0
    words = list(vocabulary)
    who, what = features(words)
    member = np.stack([lexicon.get(w, np.zeros(labels_n)) for w in words])
    fit = [np.zeros((HASHED, labels_n)), np.zeros((labels_n, labels_n)), np.zeros((labels_n, labels_n)), np.zeros(labels_n)]
    m, v = [np.zeros_like(p) for p in fit], [np.zeros_like(p) for p in fit]
    one = np.eye(labels_n)[gold] * held[:, :, None]
    seen = np.einsum("ijk,ijl->kl", one[:, :-1], one[:, 1:])
    for r in range(1, ROUNDS + 1):
        w, lex, trans, start = fit
        raw = np.stack([np.bincount(who, w[what, k], len(words)) for k in range(labels_n)], axis=1) + member @ lex
        emit = np.exp(np.maximum(raw - raw.max(axis=1, keepdims=True), -30))
        p, moves, first, _ = marginals(emit[ids], np.exp(trans), np.exp(start), held)
        rest = (one - p * held[:, :, None]).reshape(-1, labels_n)
        by_word = np.stack([np.bincount(ids.ravel(), rest[:, k], len(words)) for k in range(labels_n)], axis=1)
        up = [
            np.stack([np.bincount(what, by_word[who, k], HASHED) for k in range(labels_n)], axis=1),
            member.T @ by_word, seen - moves, (one[:, 0] - first).sum(axis=0),
        ]
        for i, g in enumerate(up):
            g = g / n - 1e-4 * fit[i]
            m[i], v[i] = 0.8 * m[i] + 0.2 * g, 0.95 * v[i] + 0.05 * g * g
            fit[i] = fit[i] + 0.15 * (m[i] / (1 - 0.8**r)) / (np.sqrt(v[i] / (1 - 0.95**r)) + 1e-6)
    return Tagger(languages, fit[0], lexicon, fit[1], np.exp(fit[2]), np.exp(fit[3]))


def training_sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> tuple[list[str], list[str]]:
    """At most ``rows`` rows of each language, those of the least id hash, and of each a passage of ``chars`` characters.

    The rows are first thinned by a hash bound from the counts, so that only a bounded set is ordered.
    """
    named = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    counts = named.groupBy("lang").count()
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    bounded = named.join(F.broadcast(counts), "lang").where(share < 2.0 * rows / F.col("count"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = bounded.withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows).select(F.col("id").alias("wanted")).distinct()
    begin = 1 + F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.greatest(F.lit(1), F.length(text_col) - chars + 1))
    passage = F.substring(F.col(text_col), begin.cast("int"), F.lit(chars))
    got = labelled.join(F.broadcast(chosen), F.col(id_col) == F.col("wanted"), "left_semi").select(id_col, passage.alias("text"), F.col(lang_col).alias("lang"))
    found = sorted((r[0], r["lang"], r["text"]) for r in got.collect())
    return [f[2] for f in found], [f[1] for f in found]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Tagger | None:
    """Trains on rows with a language and a text whose id does not hash into the held-out fifth."""
    three = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).alias("text"), column(docs, lang_col).alias("lang"))
    labelled = three.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    return train(*training_sample(labelled, "id", "text", "lang"))


def held_out(id_col):
    """True for the fifth of ids whose CRC-32 of the decimal text is a multiple of 5."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def labeller_of(tagger: Tagger | None) -> Labeller:
    """The worker's labeller for a tagger, so that what one task has learned serves the next."""
    return held(f"language {tagger.name if tagger else None}", lambda: Labeller(tagger))


class Labeller:
    """Labels texts with a tagger; keeps the emissions of words that it has met."""

    def __init__(self, tagger: Tagger | None) -> None:
        self.tagger = tagger
        self.known: dict[str, int] = {}
        self.emit = np.ones((1, len(tagger.languages) if tagger else 1))

    def learn(self, words: set[str]) -> bool:
        """Makes all ``words`` known; False if they alone are more than the cache holds.

        A full cache keeps the half that was learned first, which has the frequent words.
        """
        fresh = [w for w in words if w not in self.known]
        for keep in (CACHE_WORDS // 2, 0):
            if len(self.known) + len(fresh) > CACHE_WORDS:
                self.known = {w: i for w, i in self.known.items() if 0 < i <= keep}
                self.emit = self.emit[: keep + 1]
                fresh = [w for w in words if w not in self.known]
        if len(fresh) > CACHE_WORDS:
            return False
        if fresh:
            letters = [w for w in fresh if any(map(str.isalpha, w))]
            self.known.update(dict.fromkeys(fresh, -1))
            if letters:
                self.known.update(zip(letters, range(len(self.emit), len(self.emit) + len(letters)), strict=True))
                self.emit = np.concatenate([self.emit, self.tagger.emissions(letters)])
        return True

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if self.tagger is None:
            return [("und", 0.0)] * len(texts)
        split = [WORD.findall(t.lower()) if t else [] for t in texts]
        if not self.learn(set().union(*split)):
            return self.crowded(texts, split)
        chains, owners = [], []
        for i, words in enumerate(split):
            ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            ids = ids[ids >= 0]
            if len(ids):
                short = -len(ids) % CHAIN
                chains.append(np.pad(ids, (0, short)).reshape(-1, CHAIN))
                owners.append(np.full(len(chains[-1]), i))
        total = np.zeros((len(texts), len(self.tagger.languages)))
        if chains:
            ids, owner = np.concatenate(chains), np.concatenate(owners)
            held = ids > 0
            found = marginals(self.emit[ids], self.tagger.transitions, self.tagger.start, held)[0]
            np.add.at(total, owner, (found * held[:, :, None]).sum(axis=1))
        words = total.sum(axis=1)
        best = total.argmax(axis=1)
        return [(self.tagger.languages[b], float(min(1.0, t[b] / n))) if n > 0 else ("und", 0.0) for b, t, n in zip(best, total, words, strict=True)]

    def crowded(self, texts: list[str | None], split: list[list[str]]) -> list[tuple[str, float]]:
        if len(texts) > 1:
            half = len(texts) // 2
            return self.label(texts[:half]) + self.label(texts[half:])
        letters = [w for w in split[0] if any(map(str.isalpha, w))]
        total = np.zeros(len(self.tagger.languages))
        for at in range(0, len(letters), 64 * CHAIN):
            part = letters[at : at + 64 * CHAIN]
            emit = np.ones((-(-len(part) // CHAIN) * CHAIN, len(total)))
            emit[: len(part)] = self.tagger.emissions(part)
            held = (np.arange(len(emit)) < len(part)).reshape(-1, CHAIN)
            found = marginals(emit.reshape(-1, CHAIN, len(total)), self.tagger.transitions, self.tagger.start, held)[0]
            total += (found * held[:, :, None]).sum(axis=(0, 1))
        best = int(total.argmax())
        return [(self.tagger.languages[best], float(min(1.0, total[best] / total.sum())))]


def label_batches(docs: DataFrame, tagger: Tagger | None, text_at: int, schema: str, shape) -> DataFrame:
    """Runs ``shape(batch, labels)`` over the Arrow batches of ``docs`` with the labels of the column ``text_at``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = labeller_of(tagger)
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            labels: list[tuple[str, float]] = []
            for lo, hi in slices(texts, SLICE_CHARS):
                labels += labeller.label(texts[lo:hi])
            yield shape(batch, labels)

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` per row of ``docs``; only the id and the text are read. No shuffle."""

    def shape(batch: pa.RecordBatch, labels: list[tuple[str, float]]) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), pa.array([x[0] for x in labels], pa.string()), pa.array([x[1] for x in labels], pa.float64())], names=["id", "lang_pred", "score"])

    two = docs.select(column(docs, id_col).cast("long").alias("id"), column(docs, text_col).cast("string").alias("text"))
    return label_batches(two, tagger, 1, "id long, lang_pred string, score double", shape)


def keep_identified(docs: DataFrame, tagger: Tagger | None, least_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language with at least ``least_score``."""

    def shape(batch: pa.RecordBatch, labels: list[tuple[str, float]]) -> pa.RecordBatch:
        return batch.filter(pa.array([x[0] != "und" and x[1] >= least_score for x in labels], pa.bool_()))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # whatever the columns are called
    return label_batches(plain, tagger, docs.columns.index(text_col), plain.schema, shape).toDF(*docs.columns)
