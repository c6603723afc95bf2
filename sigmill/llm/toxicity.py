"""Toxicity by weak supervision.

1. Learning reads a bounded sample of labelled training rows (TRAINING_ROWS, by hash of doc_id). Of near copies with one
   label among them (word-trigram Jaccard of about NEAR or more) the first by doc_id is read: the rare words of one text with many
   copies would otherwise look like a lexicon. Texts that only share passages are all read.
   Terms (words, and the first letters of words) are counted over these rows in Spark; those that toxic rows hold
   more often than chance allows become lexicons, one voter each: TIERS of like odds for words and for beginnings of
   each length, each dealt into HANDS by a hash of the term.
   Patterns over the text (shouting, second person with an insult's punctuation, symbol noise) vote too.
2. A generative model of the votes, fitted by expectation maximisation, estimates each voter's accuracy in either class and the correlation of each pair of voters within a class;
   a voter counts the less, the more others repeat it. The given label is one more voter, whose accuracy is estimated like the others', from a prior (LABEL_PRIOR); the model starts from it.
3. A logistic regression over term presence is trained on the model's posterior labels and scores every text.

Only rows whose crc32(doc_id as text) mod 4 is not HELD_OUT are read with labels. lang, source and doc_id are no
inputs of a score. Of rows that repeat a doc_id, the one with the smallest text is learned from. Null and empty texts get the score of a text without terms, which is low. Every row is
scored, repeated ones and those with null doc_id (never held out, never labelled) included. Without any toxic label, all scores are 0;
where no term is beyond chance, patterns and the intercept are fitted alone. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.llm.ngram_join import forget, shingles
from sigmill.llm.shared import give_back, slices, table, written

HELD_OUT = 2
THRESHOLD = 0.3
TIERS, HANDS = 6, 2
#: Terms that may enter the lexicons and the classifier.
MOST_TERMS = 6000
#: Labelled rows outside the held-out part, of either class, that are learned from: those whose hash of doc_id is smallest.
TRAINING_ROWS = 40000
#: Smallest evidence for a term, in nats (the log-likelihood ratio of its toxic share against that of all rows): with a million terms, chance
#: passes some thirty. Chosen on labelled rows of remainder 3, learned from 0 and 1.
LEAST_EVIDENCE = 8.0
#: Minimum hashes of a text's word trigrams, and how many of them form a band: rows are compared where they share a band.
SKETCHES, BAND = 64, 4
#: Share of equal sketches (which estimates the Jaccard of the trigrams) from which two rows with one label are near copies.
NEAR = 0.8
#: What the accuracy of given labels is taken for before the votes are seen, with the weight of half the rows.
LABEL_PRIOR = 0.97
#: Length of the word beginnings that count as terms.
STEMS = (4, 6)

WORD = re.compile(r"[^\W\d_]+")
# Patterns over the raw text, one voter each.
PATTERNS = (r"[A-ZÄÖÜÉÈÑ]{4,}[!?]", r"!{2,}|\?!", r"[@#$%&*]{3,}", r"\b(?:you|du|tu|vous|usted)\b[^.]{0,40}!", r"\b\w\*+\w\b")


@dataclass
class Model:
    """What scoring needs: a weight for each term, pattern weights, and the intercept; at most MOST_TERMS numbers."""

    terms: dict[str, float]
    patterns: list[float]
    intercept: float


def terms_of(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words.union(*({f"{w[:n]}~" for w in words if len(w) >= n} for n in STEMS))


_PATTERNS = [re.compile(p) for p in PATTERNS]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def _training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of up to TRAINING_ROWS labelled documents outside the held-out part; one label a document, the larger where several differ."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))  # repeated rows once: TRAINING_ROWS holds for rows too


_FACTORS = np.random.default_rng(8).integers(0, 2**63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sketches(texts: list[str]) -> np.ndarray:
    """SKETCHES minimum hashes of the word trigrams of each text, a row each; zeros for all texts without words."""
    flat, at = shingles(texts, 3)
    out = np.zeros((len(texts), SKETCHES), dtype=np.uint32)
    some = np.flatnonzero(at[1:] > at[:-1])
    if len(some):
        for k, f in enumerate(_FACTORS):
            h = flat * f
            h = (h ^ (h >> np.uint64(32))) * f
            out[some, k] = np.minimum.reduceat(h ^ (h >> np.uint64(29)), at[:-1][some]) & np.uint64(0xFFFFFFFF)
    return out


def _terms(training: DataFrame) -> DataFrame:
    """(doc_id, toxic, terms, hits, sketches): the distinct terms of each text, which patterns it has, and its sketches."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            texts = part.column(1).to_pylist()
            terms = pa.array([sorted(terms_of(t)) for t in texts], pa.list_(pa.string()))
            hits = pa.array([[bool(p.search(t)) for p in _PATTERNS] for t in texts], pa.list_(pa.bool_()))
            sketches = pa.array([x.tobytes() for x in _sketches(texts)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), terms, hits, sketches], ["doc_id", "toxic", "terms", "hits", "sketches"])
        forget()

    return training.select("doc_id", "text", "toxic").mapInArrow(batches, "doc_id long, toxic int, terms array<string>, hits array<boolean>, sketches binary")


def first_copies(ids: np.ndarray, toxic: np.ndarray, sketches: np.ndarray) -> set[int]:
    """The ids of rows that are no near copy of an earlier row that stays, by id, with the same label. Rows that share an id are no copies of each other."""
    kept: set[int] = set()
    bands: dict[tuple, list[int]] = {}
    for k in np.argsort(ids, kind="stable").tolist():
        keys = [(toxic[k], b, sketches[k, b : b + BAND].tobytes()) for b in range(0, SKETCHES, BAND)]
        like = np.array(sorted({x for key in keys for x in bands.get(key, ())}), dtype=np.int64)
        like = like[ids[like] != ids[k]]
        if len(like) and (sketches[like] == sketches[k]).mean(axis=1).max() >= NEAR:
            continue
        kept.add(int(ids[k]))
        for key in keys:
            bands.setdefault(key, []).append(k)
    return kept


def _originals(terms: DataFrame) -> DataFrame:
    """The rows of ``terms`` without near copies; TRAINING_ROWS documents of SKETCHES numbers at most come to the driver."""
    read = terms.select("doc_id", "toxic", "sketches").toArrow()
    sketches = np.frombuffer(b"".join(read.column(2).to_pylist()), dtype=np.uint32).reshape(-1, SKETCHES)
    kept = first_copies(read.column(0).to_numpy(), read.column(1).to_numpy(), sketches)
    ids = terms.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(sorted(kept), pa.int64())}))
    return terms.join(F.broadcast(ids), "doc_id")


def mine(terms: DataFrame) -> list[tuple[str, float]]:
    """Terms that toxic rows hold more often than chance allows, with their log odds, strongest evidence first; at most MOST_TERMS."""
    sizes = terms.agg(F.sum("toxic").alias("p"), F.count(F.lit(1)).alias("n")).first()
    if not sizes.p or sizes.p == sizes.n:
        return []
    share = float(sizes.p) / float(sizes.n)
    each = terms.select("toxic", F.explode("terms").alias("term"))
    counts = each.groupBy("term").agg(F.sum("toxic").alias("p"), F.count(F.lit(1)).alias("n")).where(F.col("p") > share * F.col("n"))
    clean = F.col("n") - F.col("p")
    evidence = F.col("p") * F.log(F.col("p") / (share * F.col("n"))) + F.when(clean > 0, clean * F.log(clean / ((1 - share) * F.col("n")))).otherwise(0.0)
    odds = F.log((F.col("p") + 0.5) / (clean + 0.5)) - F.lit(float(np.log(share / (1 - share))))
    strong = counts.select("term", odds.alias("odds"), evidence.alias("evidence")).where(F.col("evidence") >= LEAST_EVIDENCE)
    return [(r.term, r.odds) for r in strong.orderBy(F.desc("evidence"), "term").limit(MOST_TERMS).collect()]


def _rates(post: np.ndarray, votes: np.ndarray, prior: tuple[float, float] = (0.5, 1.0)) -> tuple[np.ndarray, np.ndarray]:
    """P(vote | class 1) and P(vote | class 0) of each voter; prior: pseudo votes and rows of each class."""
    hits, rows = prior
    one = ((post @ votes) + hits) / (post.sum() + rows)
    zero = (((1 - post) @ votes) + rows - hits) / ((1 - post).sum() + rows)
    return np.clip(one, 1e-4, 1 - 1e-4), np.clip(zero, 1e-4, 1 - 1e-4)


def label_model(votes: np.ndarray, known: np.ndarray, rounds: int = 20) -> np.ndarray:
    """The posterior of class 1 for each row of 0/1 votes, ``known`` among them.

    Fits P(vote | class) for each voter, the given label included, finds the correlation of
    votes within the classes, and divides each voter's evidence by its share of repeated evidence."""
    rows, voters = votes.shape
    known = known.astype(float)
    post = known * 0.96 + 0.02
    weight = np.ones(voters)
    for k in range(rounds):
        prior = np.clip(post.mean(), 1e-4, 1 - 1e-4)
        one, zero = _rates(post, votes)
        if k % 5 == 0:
            mean = np.outer(post, one) + np.outer(1 - post, zero)
            rest = votes - mean
            spread = np.sqrt((rest**2).mean(axis=0)) + 1e-9
            corr = np.abs(rest.T @ rest / rows / np.outer(spread, spread))
            np.fill_diagonal(corr, 0)
            weight = 1 / (1 + np.where(corr > 0.1, corr, 0).sum(axis=1))
        (hit,), (false,) = _rates(post, known[:, None], (LABEL_PRIOR * rows / 2, rows / 2))
        said = np.where(known > 0, np.log(hit / false), np.log((1 - hit) / (1 - false)))
        silence = np.log((1 - one) / (1 - zero))
        evidence = votes @ (weight * (np.log(one / zero) - silence)) + (weight * silence).sum() + said
        post = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + evidence, -30, 30)))
    return post


def _logistic(columns: list[np.ndarray], size: int, goal: np.ndarray, rounds: int = 150, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights of a logistic regression over sparse 0/1 rows, by Adam on the whole sample."""
    lengths = np.array([len(c) for c in columns])
    flat = np.concatenate(columns) if len(columns) else np.zeros(0, dtype=np.int64)
    row = np.repeat(np.arange(len(columns)), lengths)
    w, b = np.zeros(size), float(np.log(np.clip(goal.mean(), 1e-4, 1 - 1e-4) / np.clip(1 - goal.mean(), 1e-4, 1)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for k in range(1, rounds + 1):
        z = b + np.bincount(row, weights=w[flat], minlength=len(columns))
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - goal
        grad = np.append(np.bincount(flat, weights=gap[row], minlength=size) / len(columns) + l2 * w, gap.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Learns from the labelled training rows; None where no toxic one is among them."""
    read = written(_terms(_training(docs, labels)))  # TRAINING_ROWS rows at most
    if not read.where("toxic > 0").head(1):
        return None
    terms = _originals(read)
    found = mine(terms)
    index = {t: i for i, (t, _) in enumerate(found)}
    # rows come as indexes of mined terms only; their number is bounded
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def pick(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for whole in parts:
            for at in range(0, whole.num_rows, 400):
                part = whole.slice(at, 400)
                ids = [[of[t] for t in ts if t in of] for ts in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), part.column(2)], ["toxic", "ids", "hits"])
        give_back()

    rows = terms.select("toxic", "terms", "hits").mapInArrow(pick, "toxic int, ids array<int>, hits array<boolean>").collect()
    known = np.array([r.toxic for r in rows])
    ids = [np.array(r.ids, dtype=np.int64) for r in rows]
    hits = np.array([r.hits for r in rows], dtype=float)
    # terms of one kind and of like odds form a voter: a weak one isn't taken for as sure as a strong one
    kinds = np.array([(0, *STEMS).index(len(t) - 1 if t.endswith("~") else 0) for t, _ in found], dtype=np.int64)
    tier = np.empty(len(found), dtype=np.int64)
    tier[np.argsort([-o for _, o in found], kind="stable")] = np.arange(len(found)) * TIERS // max(1, len(found))
    hand = np.array([zlib.crc32(t.encode()) % HANDS for t, _ in found], dtype=np.int64)
    voter = (kinds * TIERS + tier) * HANDS + hand
    lexicon = np.zeros((len(rows), (1 + len(STEMS)) * TIERS * HANDS))
    for k, x in enumerate(ids):
        lexicon[k, np.unique(voter[x])] = 1
    post = label_model(np.hstack([lexicon, hits]), known)
    size = len(found) + len(PATTERNS)
    columns = [np.concatenate([x, len(found) + np.flatnonzero(h)]) for x, h in zip(ids, hits)]
    w, b = _logistic(columns, size, post)
    return Model({t: float(w[i]) for t, i in index.items()}, [float(x) for x in w[len(found) :]], b)


def scorer(model: Model | None):
    """A function from text to its score."""
    if model is None:
        return lambda text: 0.0
    weights, patterns, b = model.terms, model.patterns, model.intercept
    of_pattern = [(p, w) for p, w in zip(_PATTERNS, patterns) if w]
    keys = weights.keys()
    stems = {n: {t[:-1] for t in keys if t.endswith("~") and len(t) == n + 1} for n in STEMS}

    def score(text: str) -> float:
        words = set(WORD.findall(text.lower()))
        z = b + sum([weights[w] for w in words & keys])
        for n in STEMS:
            if stems[n]:
                z += sum([weights[f"{s}~"] for s in {w[:n] for w in words} & stems[n]])
        z += sum([w for p, w in of_pattern if p.search(text)])
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))

    return score


def scored(docs: DataFrame, model: Model | None, name: str = "toxic_score") -> DataFrame:
    """``docs`` with the column ``name`` (a column of that name is replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = scorer(shared.value)
        for part in parts:
            yield pa.array([score(c.as_py() or "") for c in part], pa.float64())
        give_back()

    # only texts go to Python, only numbers come back
    return docs.drop(name).withColumn(name, F.arrow_udf(batches, "double")(F.col("text")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = scored(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"),
        F.when(F.col("toxic_score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE: dict[str, str] = {}
