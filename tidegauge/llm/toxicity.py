"""Toxicity by weak supervision: many voters, a label model of their accuracies and correlations, a linear classifier."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidegauge.llm.common import mapped

WORDS = re.compile(r"[^\W\d_]+")
#: Hand-written lexicons, one voter each.
LEXICONS = {
    "mind": "idiot moron stupid dumb imbecile fool cretin halfwit dimwit brainless",
    "worth": "worthless trash garbage scum filth vermin rubbish waste parasite",
    "scorn": "loser pathetic clown disgusting coward freak creep disgrace ugly",
    "hate": "hate despise kill murder rape slaughter exterminate",
    "swear": "damn bastard bitch shit fuck fucking asshole crap bullshit",
    "order": "shut quit scram getlost",
}
#: Voters the terms mined from labelled rows are dealt to, by kind.
MINED = 6
#: Labelled rows of either class that lexicons and classifier are learned from, at most.
LABELLED = 12_000
#: A mined term stands in so large a share of the toxic rows at least, and in so many.
LEAST_SHARE, LEAST_ROWS = 0.003, 4
#: Standard errors by which a term's log odds must stay above ``log(3)``; many thousand terms are tried.
SURE = 3.0
#: Terms a task counts before it hands the counts on.
HELD = 400_000
#: Where no row is labelled, the classifier is trained on the posteriors of about so many documents, by a seeded hash.
SAMPLED = 24_000
#: Log odds that all voters together may reach; the correlations that were not found would overstate them.
MOST = 3.5
#: How often a label is taken to be right.
GOLD = 0.995
#: Prior of a toxic document where no row is labelled.
PRIOR = 0.1

SHOUT = re.compile(r"[A-Z]{4,}[!?]+")
SECOND = frozenset("you your yours yourself".split())
#: Numbers of distinct mined words from which a feature is on.
STEPS = (2, 3, 5)
PATTERNS = ("shout", "marks", "capitals", "second")


def words_of(text: str) -> set[str]:
    """Distinct lower-case words; repeats are dropped before the words are cut out."""
    return set(WORDS.findall(" ".join(set(text.lower().split()))))


def stems_of(words: set[str]) -> set[str]:
    """The first 4 and 5 letters of longer words."""
    long = [w for w in words if len(w) > 5]
    return {w[:4] for w in long} | {w[:5] for w in long if len(w) > 6}


def terms(text: str) -> set[str]:
    """Words, and stems with ``*`` at the end."""
    words = words_of(text)
    return words | {s + "*" for s in stems_of(words)}


@dataclass
class Voters:
    """``mined`` are the terms from labelled rows, best first; a term's voter follows from its kind and rank."""

    mined: list[str]
    names: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.place: dict[str, int] = {}
        self.names = [f"lexicon_{k}" for k in LEXICONS]
        for n, words in enumerate(LEXICONS.values()):
            self.place |= dict.fromkeys(words.split(), n)
        base, seen = len(self.names), [0, 0]
        self.names += [f"mined_{kind}_{k}" for kind in ("words", "stems") for k in range(MINED)]
        self.groups: dict[str, int] = {}
        for term in self.mined:
            kind = term.endswith("*")
            self.groups[term] = base + kind * MINED + seen[kind] % MINED
            seen[kind] += 1
        self.index = {t: n for n, t in enumerate(self.mined)}
        self.words = frozenset(t for t in self.mined if not t.endswith("*"))
        self.stems = frozenset(t[:-1] for t in self.mined if t.endswith("*"))
        self.lexicon = frozenset(self.place)
        self.patterns = len(self.names)
        self.names += [f"pattern_{p}" for p in PATTERNS] + ["no_lexicon", "no_mined_word", "no_mined_stem"]

    @property
    def width(self) -> int:
        """Classifier features: mined terms, lexicon and pattern votes, whether any voter of a kind spoke, how many terms hit."""
        return len(self.mined) + len(LEXICONS) + len(PATTERNS) + 3 + len(STEPS)

    def read(self, text: str | None) -> tuple[np.ndarray, list[int]]:
        """Votes (1 toxic, -1 clean, 0 none) and the features that are on."""
        text = text or ""
        words = words_of(text)
        votes = np.zeros(len(self.names))
        for term in words & self.lexicon:
            votes[self.place[term]] = 1
        hits = [*(words & self.words), *[t + "*" for t in stems_of(words) & self.stems]]
        for term in hits:
            votes[self.groups[term]] = 1
        base, last = self.patterns, len(self.names)
        votes[base:base + 4] = (bool(SHOUT.search(text)), text.count("!") * 50 > len(text), text.isupper(), bool(words & SECOND))
        first = len(LEXICONS)
        votes[last - 3] = -float(not votes[:first].any())
        votes[last - 2] = -float(not votes[first:first + MINED].any())
        votes[last - 1] = -float(not votes[first + MINED:first + 2 * MINED].any())
        on = [self.index[t] for t in hits]
        on += [len(self.mined) + int(k) for k in np.flatnonzero(votes[:first])]
        on += [len(self.mined) + first + int(k) for k in np.flatnonzero(votes[base:base + 4])]
        on += [len(self.mined) + first + 4 + int(k) for k in np.flatnonzero(votes[last - 3:] == 0)]
        several = sum(not t.endswith("*") for t in hits)
        on += [len(self.mined) + first + 7 + k for k, least in enumerate(STEPS) if several >= least]
        return votes, on


@dataclass
class LabelModel:
    """Chance that each voter speaks given the hidden label, its accuracy, and the pairs that are correlated beyond the label."""

    prior: float
    clean: np.ndarray
    toxic: np.ndarray
    accuracy: np.ndarray
    correlated: list[tuple[int, int]]
    weight: np.ndarray

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        """Evidence of the voters that speak; silence is none (the ``no_`` voters speak for the clean side)."""
        return np.clip(np.log(self.prior / (1 - self.prior)) + np.abs(votes) @ self.weight, -MOST, MOST)


def fit_labels(n: float, total: np.ndarray, products: np.ndarray, prior: float, rounds: int = 8, strong: float = 0.25) -> LabelModel:
    """The generative model from the moments of the votes over all documents; no label of any document goes in.

    Voters that are independent given the label have covariances c_i c_j / Var(Y), where c is a voter's covariance with
    the hidden label. That rank-one part starts from medians over triplets of voters, which a few correlated pairs do not
    move; pairs whose rest is a correlation of ``strong`` or more are held to be correlated and left out of a least squares
    fit, until that settles.
    """
    n, j = max(n, 1.0), len(total)
    mean = total / n
    cov = products / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = cov / np.outer(spread, spread)
    live = spread > 1e-5
    free = np.outer(live, live) & ~np.eye(j, dtype=bool)
    load = _triplets(corr, live)
    for number in range(rounds):
        for _ in range(60 if number else 0):  # least squares, one voter at a time
            for i in np.flatnonzero(live):
                others = free[i]
                square = float((load[others] ** 2).sum())
                if square > 1e-9:
                    load[i] = np.clip(float(corr[i, others] @ load[others]) / square, -0.98, 0.98)
        rest = np.abs(corr - np.outer(load, load))
        now = np.outer(live, live) & ~np.eye(j, dtype=bool) & (rest < strong)
        now |= (now.sum(axis=1, keepdims=True) < 3) & np.outer(live, live) & ~np.eye(j, dtype=bool)  # a voter keeps some partners
        now &= now.T
        if (now == free).all():
            break
        free = now
    if load.sum() < 0:
        load = -load
    load = np.maximum(load, 0.0)  # every voter is made to vote for its side
    gap = load * spread / np.sqrt(prior * (1 - prior))
    gap = np.minimum(gap, 1.0)
    toxic, clean = mean + (1 - prior) * gap, mean - prior * gap
    side = np.where(mean < 0, -1.0, 1.0)
    toxic, clean = np.clip(side * toxic, 0.002, 0.998), np.clip(side * clean, 0.002, 0.998)
    right, wrong = np.where(side < 0, ((1 - prior) * clean, prior * toxic), (prior * toxic, (1 - prior) * clean))
    accuracy = np.where(live, right / (right + wrong), 0.5)
    tied = np.where(np.outer(live, live) & ~free, np.abs(corr - np.outer(load, load)), 0.0)
    np.fill_diagonal(tied, 0.0)
    weight = np.where(live, np.log(toxic / clean) / (1 + tied.sum(axis=1)), 0.0)  # correlated voters share their evidence
    pairs = [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(tied, 1)))]
    return LabelModel(prior, clean, toxic, accuracy, pairs, weight)


def _triplets(corr: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Each voter's correlation with the label: the median of r_ij r_ik / r_jk over pairs of other voters."""
    load = np.zeros(len(corr))
    for i in np.flatnonzero(live):
        others = np.array([j for j in np.flatnonzero(live) if j != i], np.int64)
        j, k = (others[x] for x in np.triu_indices(len(others), 1))
        sure = np.abs(corr[j, k]) > 0.02
        found = (corr[i, j] * corr[i, k])[sure] / corr[j, k][sure]
        load[i] = np.sqrt(np.clip(np.median(found), 0.0, 0.96)) if len(found) else 0.0
    return load


def fit_linear(rows: list[list[int]], width: int, goal: np.ndarray, weight: np.ndarray, l2: float = 1e-5, steps: int = 800) -> np.ndarray:
    """Logistic regression on soft labels over sparse 0/1 features (Adam, full batch); the last weight is the intercept."""
    at = np.concatenate([np.asarray(r, np.int64) for r in rows] or [np.zeros(0, np.int64)])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w = np.zeros(width + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    weight = weight / max(weight.sum(), 1e-9)
    for step in range(1, steps + 1):
        z = np.bincount(row, w[at], len(rows)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - goal) * weight
        grad = np.append(np.bincount(at, error[row], width), error.sum())
        grad[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.95 * v + 0.05 * grad * grad
        w -= 0.1 / (1 + step / 100) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.95 ** step)) + 1e-7)
    return w


@dataclass
class Detector:
    voters: Voters
    labels: LabelModel
    weights: np.ndarray
    slope: float
    shift: float

    def score(self, text: str | None) -> float:
        z = self.weights[self.voters.read(text)[1]].sum() + self.weights[-1]
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30))))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[int]] = {}

    def flush():
        yield pa.RecordBatch.from_pydict({"term": pa.array(held.keys(), pa.string()), "toxic": pa.array([x[1] for x in held.values()], pa.int64()),
                                          "clean": pa.array([x[0] for x in held.values()], pa.int64())})
        held.clear()
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            for term in terms(text.as_py() or ""):
                held.setdefault(term, [0, 0])[toxic] += 1
            if len(held) > HELD:
                yield from flush()
    yield from flush()


def mine(labelled: DataFrame, toxic_rows: int, clean_rows: int) -> list[str]:
    """Terms that stand much oftener in toxic rows, surest first. ``labelled`` has ``text, toxic``.

    As a term must be in ``LEAST_SHARE`` of the toxic rows, their number is bounded by a text's length, not by the table.
    """
    least = max(LEAST_ROWS, LEAST_SHARE * toxic_rows)
    found = mapped(labelled.select("text", "toxic"), _term_counts, "term string, toxic bigint, clean bigint").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter(F.col("toxic") >= least).collect()
    chosen = []
    for term, toxic, clean in found:
        odds = np.log((toxic + 0.5) / (toxic_rows + 1)) - np.log((clean + 0.5) / (clean_rows + 1))
        sure = odds - SURE * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
        if sure > np.log(3):
            chosen.append((-sure, term))
    return [term for _, term in sorted(chosen)]


def _moments(voters: Voters):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = len(voters.names)
        sums = np.zeros(1 + j + j * j)
        for batch in batches:
            votes = np.array([voters.read(t.as_py())[0] for t in batch.column(0)]).reshape(-1, j)
            sums += np.concatenate([[len(votes)], votes.sum(axis=0), (votes.T @ votes).ravel()])
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(sums)), pa.int32()), "value": pa.array(sums, pa.float64())})
    return add


def _read_rows(voters: Voters):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [voters.read(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_pydict({
                "toxic": batch.column(1), "votes": pa.array([v.astype(np.int8).tolist() for v, _ in got], pa.list_(pa.int8())),
                "active": pa.array([on for _, on in got], pa.list_(pa.int32()))})
    return read


def fit(docs: DataFrame, labels: DataFrame, learn: Column, labelled: int = LABELLED, sampled: int = SAMPLED) -> Detector:
    """Learns from ``docs`` (texts only) and from ``labels(doc_id, toxic)`` of rows where ``learn`` holds.

    1. Up to ``labelled`` rows of either class, those with the smallest seeded hash, are the labelled sample; lexicon
       terms are mined from it. 2. All documents vote; the moments of the votes give the label model. 3. The linear
       classifier is trained on the posterior labels of the sample, where a row's own label counts as one more voter that is
       right with probability ``GOLD``; rows are weighted back to the share of their class. 4. Its score is set to probabilities on the same rows.
    Without labels 3. is done with the voters' posteriors of about ``sampled`` of all documents; if the voters tell nothing
    either, the hand-written lexicons stay as they are.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(learn)
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = [min(counts.get(k, 0), labelled) for k in (0, 1)]
    seeded = F.xxhash64(F.lit(11), "doc_id")
    # of many rows only a share by the same hash is sorted, some more than are wanted
    low = [F.lit(-(1 << 63) + min((1 << 64) - 1, (1 << 64) * 2 * labelled // max(1, counts.get(k, 0)))) for k in (0, 1)]
    picked = [known.filter((F.col("toxic") == k) & (seeded <= low[k])).orderBy(seeded, "doc_id").limit(labelled) for k in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("text", "toxic")
    voters = Voters(mine(sample, sizes[1], sizes[0]) if sizes[1] else [])
    prior = counts.get(1, 0) / sum(counts.values()) if counts.get(1) and counts.get(0) else PRIOR
    sums = np.zeros(1 + len(voters.names) * (len(voters.names) + 1))
    for r in mapped(docs.select(F.col("text").cast("string")), _moments(voters), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        sums[r["at"]] = r["value"]
    j = len(voters.names)
    model = fit_labels(sums[0], sums[1:1 + j], sums[1 + j:].reshape(j, j), prior)
    rows = mapped(sample, _read_rows(voters), "toxic int, votes array<tinyint>, active array<int>").collect()
    active = [r["active"] for r in rows]
    if not rows:
        some = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64(F.lit(13), "doc_id", F.col("text").cast("string")).alias("h")).filter(
            F.col("h") <= F.lit(-(1 << 63) + min((1 << 64) - 1, int((1 << 64) * sampled / max(1.0, sums[0])))))
        # equal rows are one with a count, so what is collected stays bounded however often a text is repeated
        found = mapped(some.select("text", F.lit(None).cast("int").alias("toxic")), _read_rows(voters), "toxic int, votes array<tinyint>, active array<int>")
        found = found.groupBy("votes", "active").agg(F.count(F.lit(1)).alias("n")).collect() if model.weight.any() else []
        if found:
            posterior = 1 / (1 + np.exp(-model.log_odds(np.array([r["votes"] for r in found], float))))
            weights = fit_linear([r["active"] for r in found], voters.width, posterior, np.array([r["n"] for r in found], float))
        else:  # nothing to train on: the hand-written lexicons as they are
            weights = np.zeros(voters.width + 1)
            weights[:-1], weights[-1] = 2.5, -3.0
        return Detector(voters, model, weights, 1.0, 0.0)
    gold = np.array([r["toxic"] for r in rows])
    share = np.where(gold == 1, prior / max(1, gold.sum()), (1 - prior) / max(1, (1 - gold).sum()))
    log_odds = model.log_odds(np.array([r["votes"] for r in rows], float)) + (2 * gold - 1) * np.log(GOLD / (1 - GOLD))
    posterior = 1 / (1 + np.exp(-log_odds))
    weights = fit_linear(active, voters.width, posterior, share)
    z = np.array([weights[a].sum() for a in active]) + weights[-1]
    slope, shift = _calibrate(z, gold, share)
    return Detector(voters, model, weights, slope, shift)


def _calibrate(z: np.ndarray, gold: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make ``z`` log odds of the label (Newton steps; a touch of prior keeps separable data finite)."""
    if gold.min() == gold.max():
        return 1.0, 0.0
    share = share / share.sum() * len(share)
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        error, curve = share * (p - gold), np.maximum(share * p * (1 - p), 1e-6)
        grad = np.array([error @ z + (a - 1), error.sum()])
        hess = np.array([[curve @ (z * z) + 1, curve @ z], [curve @ z, curve.sum()]])
        step = np.linalg.solve(hess + 1e-6 * np.eye(2), grad)
        step *= min(1.0, 2.0 / np.abs(step).max())
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return (float(a), float(b)) if a > 0.05 else (1.0, 0.0)


def score(docs: DataFrame, detector: Detector, name: str = "toxicity") -> DataFrame:
    """``docs`` plus the score (0 to 1) as ``name``; only the text is looked at, whole, null as empty. A column of that name is replaced.

    Equal texts get equal scores. Empty texts and tables without labels are scored by the same rule.
    """
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(detector)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [shared.value.score(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, name])
    return mapped(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
