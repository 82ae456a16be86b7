"""Toxicity by a support vector machine with a gapped subsequence string kernel and Nystroem landmarks.

Texts become units: words in lower case without signs and digits, common digit and sign disguises read as letters, and
letters spelt out one by one joined.  The kernel of two units sums, over common subsequences of three letters
within five, a decay for every letter skipped, over the units' norms; so gaps and inserted characters cost little.
Landmarks are units of the training texts; the machine is linear in the Nystroem features of the kernel to them.

Labels belong to whole documents: a toxic document is a bag of sentences of which one is toxic, so the
machine is fitted on the unit of each toxic document that it finds worst, against the worst and other units of clean
ones, and this is repeated with the machine so found.  A document's score is that of its worst unit, calibrated on documents not fitted on.

Subsequences of three letters are few, so a fitted machine, a sum over landmarks, is kept as one table of weights
by subsequence; it gives the same scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import bounded_sample, checkpointed, read, text_key
from lectern.llm.pu_quality import fold

#: At most so many toxic and clean labelled documents are fitted on.
MAX_TOXIC = 1200
MAX_CLEAN = 2400
#: Distinct units looked at of each document fitted on, at most; scoring looks at all.
MAX_UNITS = 20_000
LANDMARKS = 320
DECAY = 0.6
ROUNDS = 3
#: Characters looked at together; longer texts are cut at white space.
BLOCK = 400_000
#: Second and third letter's distance from the first, and the weight.
_PATTERNS = [(a, b, DECAY ** (b - 2)) for b in range(2, 5) for a in range(1, b)]
_TABLE_SIZE = 1 << 18
_SPACE = 255
# Characters that stand for letters in disguised words.
_DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def _letter_classes() -> np.ndarray:
    """Class of each character below U+0250: a-z 1 to 26, other letters 27 to 63 by their number, white space 255, the rest 0."""
    out = np.zeros(0x250, np.uint8)
    for i in range(0x250):
        c = chr(i)
        c = _DISGUISE.get(c, c)
        out[i] = _SPACE if c.isspace() else ord(c) - 96 if "a" <= c <= "z" else 27 + i % 37 if c.isalpha() else 0
    return out


_CLASSES = _letter_classes()


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    near = np.minimum(points, 0x24F)
    out = _CLASSES[near]
    if len(points) and points.max() > 0x24F:
        far = points > 0x24F
        out[far] = 27 + points[far] % 37
        out[np.isin(points, [0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]) | ((points >= 0x2000) & (points <= 0x200A))] = _SPACE
    return out


def _blocks(text: str) -> Iterator[str]:
    """The text in parts of about ``BLOCK`` characters, cut at spaces."""
    while len(text) > BLOCK:
        cut = max(text.rfind(" ", 0, BLOCK), text.rfind("\n", 0, BLOCK))
        cut = BLOCK if cut <= 0 else cut
        yield text[:cut]
        text = text[cut:]
    yield text


class Units:
    """The units of some texts: letters, where each unit begins, and the text it belongs to."""

    def __init__(self, texts: list[str]) -> None:
        codes = [_codes(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(c) + 1 for c in codes])
        flat = np.concatenate([np.append(c, np.uint8(_SPACE)) for c in codes]) if codes else np.zeros(0, np.uint8)
        held = flat > 0
        flat, owner = flat[held], owner[held]
        space = flat == _SPACE
        token = np.cumsum(space) - space
        letters = ~space
        self.letters = flat[letters].astype(np.int32)
        token, owner_of_letter = token[letters], owner[letters]
        n_tokens = int(space.sum())
        size = np.bincount(token, minlength=n_tokens)
        owner_of_token = owner[space]
        joined = np.zeros(n_tokens, bool)
        joined[1:] = (size[1:] <= 1) & (size[:-1] <= 1) & (owner_of_token[1:] == owner_of_token[:-1])
        unit = (np.cumsum(~joined) - 1)[token] if n_tokens else token
        first = np.r_[True, unit[1:] != unit[:-1]] if len(unit) else np.zeros(0, bool)
        self.start = np.flatnonzero(first)
        self.size = np.diff(np.r_[self.start, len(self.letters)])
        self.unit = np.cumsum(first) - 1
        self.text = owner_of_letter[self.start]
        self.n_texts = len(texts)

    def __len__(self) -> int:
        return len(self.start)

    def subsequences(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """(places of the first letter, subsequence ids, weight) for each pattern."""
        x, n = self.letters, len(self.letters)
        for a, b, w in _PATTERNS:
            if n > b:
                at = np.flatnonzero(self.unit[b:] == self.unit[:-b])
                yield at, (x[at] << 12) | (x[at + a] << 6) | x[at + b], w

    def norms(self) -> np.ndarray:
        """sqrt of the sum of squared weights of a unit's subsequences, 1 for units of fewer than three letters."""
        total = sum(np.maximum(self.size - b, 0) * w * w for _, b, w in _PATTERNS)
        return np.sqrt(np.where(total > 0, total, 1.0))

    def scores(self, table: np.ndarray) -> np.ndarray:
        """<phi(unit), table> / norm of each unit."""
        s = np.zeros(len(self.letters))
        for at, ids, w in self.subsequences():
            s[at] += w * table[ids]
        return (np.add.reduceat(s, self.start) if len(self.start) else s) / self.norms()

    def worst(self, scores: np.ndarray, floor: float) -> np.ndarray:
        """The highest unit score of each text, ``floor`` for texts without units."""
        out = np.full(self.n_texts, floor)
        np.maximum.at(out, self.text, scores)
        return out

    def spelt(self, i: int) -> bytes:
        return self.letters[self.start[i] : self.start[i] + self.size[i]].astype(np.uint8).tobytes()


class _Spelt(Units):
    """Units given by their letters."""

    def __init__(self, units: list[bytes]) -> None:
        self.letters = np.frombuffer(b"".join(units), np.uint8).astype(np.int32)
        self.size = np.array([len(u) for u in units], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.unit = np.repeat(np.arange(len(units)), self.size)
        self.text, self.n_texts = np.arange(len(units)), len(units)


def _phi(unit: bytes) -> np.ndarray:
    """The explicit features of one unit over its norm, as a table."""
    u, out = _Spelt([unit]), np.zeros(_TABLE_SIZE)
    for _, ids, w in u.subsequences():
        np.add.at(out, ids, w)
    return out / u.norms()[0]


def kernel(units: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """The subsequence kernel of every unit to every landmark."""
    u = _Spelt(units)
    parts = list(u.subsequences())
    at, ids, w = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([np.full(len(p[0]), p[2]) for p in parts])
    unit, norms = u.unit[at], u.norms()
    return np.stack([np.bincount(unit, w * _phi(z)[ids], minlength=len(units)) / norms for z in landmarks], axis=1)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 4.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps; y is 1 or -1."""
    z = np.c_[x, np.ones(len(x))]
    reg = np.r_[np.ones(x.shape[1]), 1e-3]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        inside = y * (z @ w) < 1
        c = cost * weight[inside]
        a = (z[inside] * c[:, None]).T @ z[inside] + np.diag(reg)
        new = np.linalg.solve(a, (z[inside] * c[:, None]).T @ y[inside])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


class Model:
    """Weights by subsequence, the bias, and a logistic curve over what a text's units score."""

    def __init__(self, table: np.ndarray, bias: float) -> None:
        self.table, self.bias = table.astype(np.float32), bias
        self.mean, self.scale, self.curve = np.zeros(4), np.ones(4), np.zeros(5)

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Of each text: the worst unit's score, how many units the machine calls toxic, their share, how many units there are."""
        pieces, owner = [], []
        for i, t in enumerate(texts):
            for p in _blocks(t):
                pieces.append(p)
                owner.append(i)
        worst, bad, n = np.full(len(texts), -3.0), np.zeros(len(texts)), np.zeros(len(texts))
        lo = 0
        while lo < len(pieces):
            hi, size = lo, 0
            while hi < len(pieces) and (hi == lo or size + len(pieces[hi]) <= BLOCK):
                size += len(pieces[hi])
                hi += 1
            u, whose = Units(pieces[lo:hi]), np.array(owner[lo:hi])
            s = u.scores(self.table) + self.bias
            np.maximum.at(worst, whose, u.worst(s, -3.0))
            np.add.at(bad, whose, np.bincount(u.text[s > 0], minlength=hi - lo))
            np.add.at(n, whose, np.bincount(u.text, minlength=hi - lo))
            lo = hi
        return np.stack([worst, np.log1p(bad), bad / np.maximum(n, 1), np.log1p(n)], axis=1)

    def calibrate(self, evidence: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression on the evidence, by Newton steps on smoothed targets."""
        self.mean, self.scale = evidence.mean(0), np.maximum(evidence.std(0), [0.25, 0.25, 0.01, 0.5])  # floors: training texts may all be alike
        z, w = np.c_[(evidence - self.mean) / self.scale, np.ones(len(y))], np.zeros(5)
        n1, n0 = (y > 0).sum(), (y <= 0).sum()
        t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        reg = np.r_[np.full(4, 0.05), 1e-6]
        for _ in range(100):
            q = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
            step = np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + np.diag(reg), z.T @ (q - t) + reg * w)
            w = w - np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-9:
                break
        self.curve = w

    def score(self, texts: list[str]) -> np.ndarray:
        z = np.clip((self.evidence(texts) - self.mean) / self.scale, -20, 20)
        return 1 / (1 + np.exp(-np.clip(z @ self.curve[:4] + self.curve[4], -40, 40)))


def _fit_units(toxic: list[bytes], clean: list[bytes]) -> tuple[np.ndarray, float]:
    """The machine for toxic against clean units, as a table and a bias."""
    rng = np.random.default_rng(11)
    pick = lambda xs, n: [xs[i] for i in sorted(rng.permutation(len(xs))[:n])]
    distinct_t, distinct_c = sorted(set(toxic)), sorted(set(clean) - set(toxic))
    near = distinct_c[: LANDMARKS // 3] if len(distinct_c) <= LANDMARKS // 3 else pick(distinct_c, LANDMARKS // 3)
    landmarks = pick(distinct_t, LANDMARKS - len(near)) + near
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    names = distinct_t + distinct_c
    counts = {u: n for xs in (toxic, clean) for u, n in zip(*np.unique(np.array(xs, object), return_counts=True), strict=True)}
    weight = np.minimum(np.array([counts[u] for u in names], float), 10)
    y = np.r_[np.ones(len(distinct_t)), -np.ones(len(distinct_c))]
    weight[y > 0] *= max(1.0, weight[y < 0].sum() / max(weight[y > 0].sum(), 1)) ** 0.5
    w, bias = _svm(kernel(names, landmarks) @ whiten, y, weight)
    alpha = whiten @ w
    return sum(a * _phi(z) for a, z in zip(alpha, landmarks, strict=True)), bias


def bag(text: str) -> list[bytes]:
    """The distinct units of three letters or more, in order; of more than MAX_UNITS those of the lowest checksums."""
    found = {v for p in _blocks(text) for u in [Units([p])] for v in map(u.spelt, np.flatnonzero(u.size >= 3).tolist())}
    return sorted(found if len(found) <= MAX_UNITS else sorted(found, key=lambda v: (zlib.crc32(v), v))[:MAX_UNITS])


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """Learns from whole texts and their labels (1 toxic, 0 clean)."""

    def evidence(models: list[Model], half: np.ndarray) -> np.ndarray:
        out = np.zeros((len(texts), 4))
        for k, model in enumerate(models):
            mine = np.flatnonzero(half == k)
            out[mine] = model.evidence([texts[i] for i in mine])
        return out

    return fit_bags([bag(t) for t in texts], toxic, evidence)


def fit_bags(units_of: list[list[bytes]], toxic: np.ndarray, evidence_of: Callable[[list[Model], np.ndarray], np.ndarray]) -> Model:
    """Learns from the units of texts and their labels; ``evidence_of`` gives each text's evidence by one of some models (-1: none)."""
    if toxic.all() or not toxic.any():
        raise ValueError("both toxic and clean documents are needed")
    bags = [(int(toxic[i]), units, i) for i, units in enumerate(units_of)]
    bags = [b for b in bags if b[1]]
    bags = [bags[i] for i in np.random.default_rng(17).permutation(len(bags))]  # so that halves don't follow the order of the documents
    bad, good = [b[1] for b in bags if b[0]], [b[1] for b in bags if not b[0]]
    numbers = [[b[2] for b in bags if b[0]], [b[2] for b in bags if not b[0]]]
    if not bad or not good:
        raise ValueError("both toxic and clean documents with words are needed")
    # The first guess at each toxic document's unit: subsequences that other toxic documents hold more often than clean ones.
    held_by = lambda units: np.unique(np.concatenate([ids for _, ids, _ in _Spelt(units).subsequences()]))
    seen = {0: np.zeros(_TABLE_SIZE), 1: np.zeros(_TABLE_SIZE)}
    for y, units, _ in bags:
        seen[y][held_by(units)] += 1

    def guess(units: list[bytes]) -> bytes:
        own = held_by(units)
        others = np.maximum(seen[1][own] - 1, 0)
        odds = np.zeros(_TABLE_SIZE)
        odds[own] = np.maximum(np.log((others + 0.5) / len(bad)) - np.log((seen[0][own] + 0.5) / (len(good) + 1)), 0) * others / (others + 2)
        return units[int(np.argmax(_Spelt(units).scores(odds)))]

    held = {u for units in good for u in units}
    witnesses = [guess(units) for units in bad]
    rng = np.random.default_rng(5)
    clean = [units[i] for units in good for i in rng.integers(len(units), size=4).tolist()]
    for _ in range(ROUNDS):
        # Each half's units are found by the machine of the other half, so a machine can't just confirm its own guesses.
        found, hard = list(witnesses), []
        for half in (0, 1):
            table, _ = _fit_units([u for i, u in enumerate(witnesses) if i % 2 != half and u not in held] or witnesses, clean)
            for i in range(half, len(bad), 2):
                found[i] = bad[i][int(np.argmax(_Spelt(bad[i]).scores(table)))]
            for units in good[half::2]:
                s = _Spelt(units).scores(table)
                hard += [units[i] for i in np.argsort(-s, kind="stable")[:3].tolist()] + [units[int(rng.integers(len(units)))]]
        witnesses, clean = found, hard
    own = lambda us: [u for u in us if u not in held] or us
    # The curve is fitted on what each half's machine finds in the documents of the other half.
    per = len(clean) // max(1, len(good))
    order = [*range(0, len(good), 2), *range(1, len(good), 2)]  # the order in which the rounds looked at clean documents
    models, half = [], np.full(len(toxic), -1)
    for k in (0, 1) if min(len(bad), len(good)) > 1 else ():
        theirs = [u for n, i in enumerate(order) if i % 2 != k for u in clean[per * n : per * (n + 1)]]
        models.append(Model(*_fit_units(own([u for i, u in enumerate(witnesses) if i % 2 != k]), theirs)))
        half[numbers[1][k::2] + numbers[0][k::2]] = k
    model = Model(*_fit_units(own(witnesses), clean))
    if not models:
        models, half = [model], np.zeros(len(toxic), int)
    model.calibrate(evidence_of(models, half)[half >= 0], toxic[half >= 0])
    return model


def train(docs: DataFrame, labels: DataFrame, learn: Column) -> Model | None:
    """Learns from labelled rows with ``learn`` (over doc_id), at most MAX_TOXIC and MAX_CLEAN of them; None if there are no words of toxic or none of clean documents."""
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = checkpointed(bounded_sample(known.where("toxic = 1"), "doc_id", MAX_TOXIC).union(bounded_sample(known.where("toxic = 0"), "doc_id", MAX_CLEAN)))
    # one row an id, so MAX_TOXIC + MAX_CLEAN at most: the text of the lowest hash where rows share an id
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", text_key(F.col("text"))).alias("text"))
    texts = checkpointed(texts)

    def units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["doc_id", "toxic"]].assign(units=[b"\0".join(bag(t)) for t in pdf["text"]])

    rows = texts.mapInPandas(units, "doc_id long, toxic int, units binary").toPandas().sort_values("doc_id")
    ids, toxic = rows["doc_id"].to_numpy(), rows["toxic"].to_numpy()
    if {0, 1} - set(rows["toxic"][rows["units"].map(len) > 0].tolist()):  # no words of one of the two kinds
        return None

    def evidence(models: list[Model], half: np.ndarray) -> np.ndarray:
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                which = half[np.searchsorted(ids, pdf["doc_id"].to_numpy())]
                for k, model in enumerate(models):
                    mine = pdf[which == k]
                    yield pd.DataFrame({"doc_id": mine["doc_id"], "x": list(model.evidence(mine["text"].tolist()))})

        found = texts.select("doc_id", "text").mapInPandas(work, "doc_id long, x array<double>").toPandas()
        out = np.zeros((len(ids), 4))
        out[np.searchsorted(ids, found["doc_id"].to_numpy())] = np.array(found["x"].tolist()).reshape(-1, 4)
        return out

    one: dict[bytes, bytes] = {}  # a unit of many documents is held once
    return fit_bags([[one.setdefault(v, v) for v in u.split(b"\0")] if u else [] for u in map(bytes, rows["units"])], toxic, evidence)


def score(docs: DataFrame, model: Model | None, columns: list[str], name: str = "score") -> DataFrame:
    """``columns`` of every row of ``docs`` and the score (0 to 1) from its whole ``text``, in column ``name``.

    Null and empty texts get the score of a text without a suspicious unit.  Without a model every score is 0.
    """
    if model is None:
        return docs.select(*columns, F.lit(0.0).alias(name))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one table of 2^18 weights

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[columns].assign(**{name: shared.value.score([t or "" for t in pdf["text"]])})

    kept = T.StructType([*(docs.schema[c] for c in columns), T.StructField(name, T.DoubleType())])
    return docs.mapInPandas(work, kept)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "toxic")
    out = score(docs, train(docs, labels, fold("doc_id", 5) != 0), ["doc_id"])
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
