"""Toxicity by weak supervision.

Voters with different views give their opinion on a text or abstain: lexicons by kind, words and word beginnings mined from
labelled documents, patterns of address, threat, disguised spelling and shouting, density, and quiet prose. A generative
label model estimates each voter's accuracy from how the voters agree; voters whose votes go together beyond what the
label explains are merged into one joint voter, so that correlated votes don't count twice. A linear classifier on hashed
words and letter n-grams is then trained on the model's posterior labels, so that it also knows words that no voter has; a second part of it has the counts of lexicon words as
features, and the higher of both decides.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, remainder, saved, word_bytes
from .labelled import training_rows

#: At most about this many labelled documents are mined for terms, and this many of them teach the classifier.
TRAIN_ROWS = 8_000
FIT_ROWS = 4_000
#: A mined term stands in so many toxic documents at least, has such a log-likelihood ratio and such a share of toxic ones.
LEAST_TOXIC = 4
LEAST_RATIO = 24.0
LEAST_SHARE = 0.3
STEMS = range(4, 11)
ROUNDS = 60
#: Hashed features: words in the upper half, and byte 4-grams of words with their edges marked in the lower one.
DIMENSIONS = 1 << 18
RIDGE = 0.5
STEPS = 60
#: Scale of the features that count lexicon words: as much ridge on them as on so many n-grams less.
COUNTED = 2.0
#: Ordinary features of texts with more of them than this weigh less, so that a long text is not judged by its length.
DISTINCT = 300
#: Three fixed lexicons, mined words, mined beginnings, and how many words at most one of both sources has.
LEXICON_FEATURES = 6
# Lexicons by kind.
STUPIDITY = "clown dumb dumbass dunce fool idiot idiotic idiots imbecile moron moronic morons stupid".split()
CONTEMPT = "disgusting filth garbage jerk loser losers pathetic pig scum scumbag trash ugly vermin worthless".split()
PROFANITY = "asshole bastard bitch bullshit crap damn fuck fucking motherfucker shit".split()
LEXICONS = (frozenset(STUPIDITY), frozenset(CONTEMPT), frozenset(PROFANITY))
INSULTS = frozenset().union(*LEXICONS)
# Patterns over lower-cased words, and what digits and marks stand for in disguised spellings.
ADDRESS = re.compile(r"\b(?:you|your|he|she|they|these|those|all)(?: \w+){0,3} (?:" + "|".join(sorted(INSULTS)) + r")s?\b")
THREAT = re.compile(r"\b(?:(?:i|we) (?:will|ll|am going to|are going to|gonna) (?:kill|hurt|destroy|beat|find) you|kill your ?self|(?:go|hope you|should just) die)\b")
DISGUISE = str.maketrans("0134578@$!*", "oieastbasi*")
_DISGUISED = re.compile(r"(?<![A-Za-z0-9@$!*])(?=[A-Za-z0-9@$!*]*[A-Za-z])(?=[A-Za-z]*[0-9@$!*][A-Za-z0-9@$!*]*[A-Za-z])[A-Za-z0-9@$!*]{3,20}")
_SHOUTED = re.compile(r"(?:\b[A-Z]{2,}\b[^A-Za-z\n]{1,4}){2,}[A-Z]{2,}\b")
VOTERS = ("stupidity", "contempt", "profanity", "mined words", "mined beginnings", "addressed", "threat", "disguised", "shouted", "dense", "quiet")


def terms(text: str | None) -> set[str]:
    """The distinct words of a text, and their beginnings, marked by a star."""
    words = {w.decode("utf-8", "replace") for w in word_bytes(text)}
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def without_copies(train: DataFrame) -> DataFrame:
    """Of training texts with the same least hash of four words, which near copies share, the one with the smallest id: terms
    of one much copied text would else look like terms of many. Ties by a hash of the text."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = []
        for text in batch.column(2).to_pylist():
            w = word_bytes(text)
            keys.append(min((crc32(b" ".join(w[i : i + 4])) for i in range(max(1, len(w) - 3))), default=0))
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(keys, pa.int64())], names=["doc_id", "y", "text", "key"])

    rows = train.select(F.col("doc_id").cast("string").alias("doc_id"), "y", "text")
    keyed = mapped(rows, of, "doc_id string, y int, text string, key bigint")
    least = keyed.groupBy("key").agg(F.min_by(F.struct("doc_id", "y", "text"), F.struct("doc_id", F.xxhash64("text"))).alias("r"))
    return saved(least.select("r.*"), "distinct")


def mined(train: DataFrame) -> list[str]:
    """Terms that stand in far more toxic documents than chance has it, strongest first. Counts and limits are made in the
    engine; only the terms that pass come to the driver. Of terms that are beginnings of each other the strongest stays."""
    sizes = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return []
    rate = sizes[1] / (sizes[0] + sizes[1])

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found[y].update(terms(text))
        rows = [(x, n, i) for i in (0, 1) for x, n in found[i].items()]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] * (1 - r[2]) for r in rows], pa.int64()), pa.array([r[1] * r[2] for r in rows], pa.int64())], names=["term", "c", "t"])

    counted = mapped(train.select("y", "text"), of, "term string, c bigint, t bigint").groupBy("term").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    t, c, both = F.col("t"), F.col("c"), F.col("t") + F.col("c")
    ratio = 2 * (t * F.log(t / both / rate) + F.when(c > 0, c * F.log(c / both / (1 - rate))).otherwise(0.0))
    strong = counted.where((t >= LEAST_TOXIC) & (t >= LEAST_SHARE * both) & (t > rate * both)).select("term", ratio.alias("ratio")).where(F.col("ratio") >= LEAST_RATIO)
    stems: set[str] = set()  # of accepted terms
    heads: set[str] = set()  # all beginnings of accepted terms
    accepted: list[str] = []
    for _, _, term in sorted((-r["ratio"], -len(r["term"].rstrip("*")), r["term"]) for r in strong.collect()):
        bare = term.rstrip("*")
        if any(bare[:k] in stems for k in range(1, len(bare) + 1)) or (term[-1] == "*" and bare in heads):
            continue
        accepted.append(term)
        heads.update(bare[:k] for k in range(1, len(bare) + 1))
        if term[-1] == "*":
            stems.add(bare)
    return accepted


def joined_words(text: str | None) -> bytes:
    """The words of a text with a blank before, between and behind; one blank without words."""
    words = word_bytes(text)
    return b" " + b" ".join(words) + b" " if words else b" "


class Voters:
    """Votes on a text in the order of VOTERS: 1 toxic, 0 not toxic, -1 no opinion."""

    def __init__(self, found: list[str] = ()):
        self.words = frozenset(x for x in found if x[-1] != "*")
        self.stems = frozenset(x[:-1] for x in found if x[-1] == "*")
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}  # each worker makes its own

    def hits(self, joined: bytes) -> np.ndarray:
        """How many words each lexicon has: the fixed ones, mined words, mined beginnings. One pass of an automaton."""
        if self._automaton is None:
            kinds: dict[str, list[int]] = {}
            for i, lexicon in enumerate((*LEXICONS, self.words)):
                for w in lexicon:
                    kinds.setdefault(f" {w} ", []).append(i)
            for stem in self.stems:
                kinds.setdefault(f" {stem}", []).append(len(LEXICONS) + 1)
            self._automaton = ahocorasick.Automaton()
            for pattern, of in kinds.items():
                self._automaton.add_word(pattern, of)
            self._automaton.make_automaton()
        found = np.zeros(len(LEXICONS) + 2, int)
        for _, of in self._automaton.iter(joined.decode("utf-8", "replace")):
            found[of] += 1
        return found

    def __call__(self, text: str | None) -> list[int]:
        raw, joined = text or "", joined_words(text)
        hits, n = self.hits(joined), joined.count(b" ") - 1
        total, spoken = total_of(hits), joined.decode("utf-8", "replace")
        disguised = any(m[0].lower().translate(DISGUISE) in INSULTS for m in _DISGUISED.finditer(raw))
        shouted = any({"you", "your", *INSULTS} & set(re.findall("[a-z]+", m[0].lower())) for m in _SHOUTED.finditer(raw))
        patterns = [bool(ADDRESS.search(spoken)), bool(THREAT.search(spoken)), disguised, shouted]
        dense = 1 if total >= 2 and total > 0.002 * n else 0 if total and total < 0.001 * n else -1
        quiet = 0 if total <= 1 and not any(patterns) else -1
        return [*(1 if k >= 2 else -1 for k in hits), *(1 if p else -1 for p in patterns), dense, quiet]


def total_of(hits: np.ndarray) -> int:
    """Words of the fixed lexicons, or of the mined ones if these are more: what both have counts once."""
    return int(max(hits[: len(LEXICONS)].sum(), hits[len(LEXICONS) :].sum()))


def label_model(votes: np.ndarray) -> np.ndarray:
    """Posterior of toxic for each row of votes (-1 no opinion, 0, 1), by expectation maximisation, without any label.

    Begins from the majority of the votes given (a text with none is taken as not toxic), where voters that nearly always say
    the same have one vote together. After some rounds voters whose votes correlate, given the posterior, by more than 0.3
    are joined: a joint voter's vote is the whole combination, with a probability of its own per class. A voter that goes
    against the others gets a low accuracy and hardly counts."""
    n, k = votes.shape
    if not n:
        return np.zeros(0)
    groups = _correlated(votes, np.ones(n), 0.9)
    share = np.zeros(k)
    for g in groups:
        share[g] = 1 / len(g)
    post = np.clip((votes == 1) @ share / np.maximum((votes >= 0) @ share, 1e-9), 0.02, 0.98)
    for turn in range(ROUNDS):
        if turn == ROUNDS // 3:
            groups = _correlated(votes, post)
        prior = float(np.clip(post.mean(), 0.005, 0.5))
        odds = np.full(n, math.log(prior / (1 - prior)))
        for g in groups:
            code = np.zeros(n, np.int64)
            for j in g:
                code = np.unique(code * 3 + votes[:, j] + 1, return_inverse=True)[1]
            size = int(code.max()) + 1
            one = np.bincount(code, post, size) + 0.5
            none = np.bincount(code, 1 - post, size) + 0.5
            odds += np.log(one / one.sum())[code] - np.log(none / none.sum())[code]
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if turn > ROUNDS // 3 and np.abs(new - post).max() < 1e-6:
            return new
        post = new
    return post


def _correlated(votes: np.ndarray, post: np.ndarray, least: float = 0.3) -> list[list[int]]:
    """Groups of voters that go together within the classes by more than least."""
    k = votes.shape[1]
    v = votes.astype(float)
    inside = np.zeros((k, k))
    for weight in (post, 1 - post):
        if weight.sum() > 1:
            centred = v - (weight @ v) / weight.sum()
            inside += (centred * weight[:, None]).T @ centred
    spread = np.sqrt(np.maximum(np.diag(inside), 1e-9))
    together = np.abs(inside / spread[:, None] / spread[None, :]) > least
    groups: list[list[int]] = []
    for j in range(k):
        mine = [g for g in groups if any(together[j, i] for i in g)]
        groups = [g for g in groups if g not in mine] + [sum(mine, []) + [j]]
    return groups


_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(0x100000001B3, i, 2**64) for i in range(4096)], np.uint64)


def hashed(joined: bytes) -> np.ndarray:
    """The distinct hashed features of joined words, in order. All words at once: a word's hash is a sum over its bytes, each
    times a power by its place."""
    a = np.frombuffer(joined, np.uint8).astype(np.uint64)
    if len(a) < 3:
        return np.zeros(0, np.int32)
    half = np.uint64(64 - DIMENSIONS.bit_length() + 2)
    blank = np.flatnonzero(a == 32)
    inside = np.arange(len(a) - 1) - np.repeat(blank[:-1], np.diff(blank)) - 1  # of each byte but the last blank
    product = np.where(inside >= 0, a[:-1] * _POWERS[np.clip(inside, 0, len(_POWERS) - 1)], np.uint64(0))
    words = (np.add.reduceat(product, blank[:-1]) * _MIX) >> half
    grams = ((a[:-3] * np.uint64(257) + a[1:-2]) * np.uint64(257) + a[2:-1]) * np.uint64(257) + a[3:]
    grams = grams[(a[1:-2] != 32) & (a[2:-1] != 32)]
    grams = ((grams + np.uint64(1 << 40)) * _MIX) >> half
    found = np.sort(np.concatenate((grams.astype(np.int32), words.astype(np.int32) + np.int32(DIMENSIONS // 2))))
    return found[np.append(True, found[1:] != found[:-1])]


def counted(hits: np.ndarray) -> np.ndarray:
    """Features of the lexicons: the logarithms of their hits, and the total up to three."""
    return COUNTED * np.array([*np.log1p(hits), min(3, total_of(hits))])


def features(text: str | None, voters: Voters) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the hashed features of a text, and after them those of the lexicons."""
    joined = joined_words(text)
    at, extra = hashed(joined), counted(voters.hits(joined))
    return np.append(at, DIMENSIONS + np.arange(len(extra))), np.append(np.full(len(at), weight_of(at)), extra)


def weight_of(found: np.ndarray) -> float:
    return min(1.0, math.sqrt(DISTINCT / max(1, len(found))))


def linear(rows: list[tuple[np.ndarray, np.ndarray]], p: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and constant of a logistic regression on probabilities as labels, by L-BFGS. Features of a single row are left out."""
    at, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])  # 4 bytes each
    if not len(at):
        return np.zeros(DIMENSIONS + LEXICON_FEATURES, np.float32), -3.0
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
    kept, at = np.unique(at, return_inverse=True)
    often = np.bincount(at) >= 2
    number = (np.cumsum(often) - 1).astype(np.int32)
    use = often[at]
    at, x, row, kept = number[at[use]], x[use], row[use], kept[often]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(row, x * w[at], len(rows)) + w[-1]
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        value = float(np.logaddexp(0, z).sum() - p @ z + RIDGE / 2 * (w[:-1] @ w[:-1]))
        return value, np.append(np.bincount(at, x * (q - p)[row], len(kept)) + RIDGE * w[:-1], (q - p).sum())

    w = np.zeros(len(kept) + 1)
    rate = float(np.clip(p.mean(), 1e-3, 1 - 1e-3))
    w[-1] = math.log(rate / (1 - rate))
    value, gradient = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        d, alphas = -gradient, []
        for s, y in reversed(past):
            alphas.append(a := (s @ d) / (s @ y))
            d = d - a * y
        if past:
            s, y = past[-1]
            d = d * ((s @ y) / (y @ y))
        else:
            d = d / max(1.0, float(np.linalg.norm(d)))
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        slope, step = float(gradient @ d), 1.0
        new, at_new = loss(w + d)
        while new > value + 1e-4 * step * slope and step > 1e-6:
            step /= 2
            new, at_new = loss(w + step * d)
        if value - new <= 1e-7 * max(1.0, abs(value)):
            break
        if (step * d) @ (at_new - gradient) > 1e-12:
            past = [*past[-7:], (step * d, at_new - gradient)]
        w, value, gradient = w + step * d, new, at_new
    weights = np.zeros(DIMENSIONS + LEXICON_FEATURES, np.float32)
    weights[kept] = w[:-1]
    return weights, float(w[-1])


def fit(train: DataFrame) -> tuple[np.ndarray, tuple[float, float], Voters] | None:
    """Weights of the classifier, the constants of its parts by words and by lexicon hits, and its voters; or None if no
    training text is toxic by the label model."""
    train = without_copies(train)
    voters = Voters(mined(train))

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        made = [features(t, voters) for t in texts]
        columns = [pa.array([voters(t) for t in texts], pa.list_(pa.int8())), pa.array([m[0].astype("<i4").tobytes() for m in made], pa.binary()), pa.array([m[1].astype("<f4").tobytes() for m in made], pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "votes", "at", "x"])

    share = min(1.0, FIT_ROWS / max(1, train.count()))
    some = train.where(F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    found = sorted(mapped(some.select("doc_id", "text"), of, "doc_id string, votes array<tinyint>, at binary, x binary").collect())  # bounded by FIT_ROWS and DIMENSIONS
    if not found:
        return None
    post = label_model(np.array([r["votes"] for r in found], np.int64))
    if post.max() < 0.5:
        return None
    rows = [(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["x"], "<f4")) for r in found]
    # two parts, as features of the lexicons in one would explain away what other words tell
    by_words = linear([(at[:-LEXICON_FEATURES], x[:-LEXICON_FEATURES]) for at, x in rows], post)
    by_hits = linear([(at[-LEXICON_FEATURES:], x[-LEXICON_FEATURES:]) for at, x in rows], post)
    return by_words[0] + by_hits[0], (by_words[1], by_hits[1]), voters


def scores(documents: DataFrame, train: DataFrame) -> DataFrame:
    """A row for each row of documents: doc_id, score. Null and empty texts have no words and the score of the constant. With
    nothing toxic to learn from, the lexicons alone decide: a text is toxic from two of their words on."""
    model = fit(train)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = []
        for text in batch.column(1).to_pylist():
            joined = joined_words(text)
            if model is None:
                total.append(-3.0 + 2.5 * min(3, total_of(Voters().hits(joined))))
                continue
            weights, (of_words, of_hits), voters = model
            at = hashed(joined)
            by_words = of_words + weight_of(at) * float(weights[at].sum())
            total.append(max(by_words, of_hits + float(counted(voters.hits(joined)) @ weights[DIMENSIONS:])))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(np.array(total, float), -30, 30))), pa.float64())], names=["doc_id", "score"])

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(docs, of, "doc_id bigint, score double")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """scores() of all documents, learned from labels.toxic: nulls, empty and long texts, repeated rows as there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    d = scores(docs, training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", TRAIN_ROWS))
    return d.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
