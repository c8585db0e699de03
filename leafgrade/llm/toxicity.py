"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrade.llm.common import shared_table, slices

LETTERS = re.compile(r"[^\W\d_]+")
LOOKALIKE = str.maketrans("013457@$!", "oieastasi")
PREFIXES = (3, 4, 5, 6)
#: A term that stands so often in a text is another term, ``term*2``: chance words stand once, a document's tone repeats.
LEVELS = (2, 4)
#: How far a label is believed against all voters.
TRUST = 0.995
#: Bytes of remembered terms in a task, of text that it turns into rows at once, and terms that it counts before it sends them on.
CACHE, TOGETHER, COUNTED = 24 << 20, 1 << 20, 1 << 17


def terms_of(token: str) -> tuple[str, ...]:
    """Terms of a token: its lower-cased word, the word's first letters, and the word behind look-alike signs."""
    low = token.lower()
    words = {low} if low.isalpha() else set(LETTERS.findall(low))
    if not low.isalpha():
        words.add("".join(LETTERS.findall(low.translate(LOOKALIKE))))
    return tuple({t for w in words if w for t in (w, *(f"{w[:n]}~" for n in PREFIXES if len(w) > n))})


class Terms(dict):
    """Terms of tokens, remembered; with ``places``, the places of those that it knows.

    What is remembered is bounded by its bytes, ``CACHE`` of them; then it starts anew.
    """

    def __init__(self, places: dict[str, int] | None = None):
        self.places, self.bytes = places, 0

    def __missing__(self, token: str) -> tuple:
        if self.places is None:
            value: tuple = terms_of(token)
            size = 250 + 2 * len(token) + sum(80 + 2 * len(t) for t in value)
        else:
            value = tuple(self.places[t] for t in terms_of(token) if t in self.places)
            size = 200 + 2 * len(token) + 8 * len(value)
        self.bytes += size
        if self.bytes > CACHE:
            self.clear()
            self.bytes = size
        self[token] = value
        return value

    def counts(self, text: str | None) -> dict:
        """How often each term, or its place, stands in a text."""
        found: dict = {}
        for token, n in Counter((text or "").split()).items():
            for term in self[token]:
                found[term] = found.get(term, 0) + n
        return found

    def of(self, text: str | None) -> set[str]:
        """The terms of a text, with those of the levels that they reach."""
        found = self.counts(text)
        return found.keys() | {f"{t}*{k}" for t, n in found.items() if n > 1 for k in LEVELS if n >= k}


def patterns(text: str | None) -> list[int]:
    """Votes of the pattern voters: 1 toxic, 0 not, -1 none."""
    t = text or ""
    n = max(len(t), 1)
    shouts, cries = len(re.findall(r"\b[A-Z]{4,}\b", t)), t.count("!")
    return [1 if shouts > 5 and 60 * shouts > n else -1, 1 if cries > 3 and 100 * cries > n else -1,
            1 if re.search(r"([!?])\1{2,}", t) else -1, 0 if 200 < len(t) and not cries and not shouts else -1]


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Text and label of at most ``most`` labelled documents outside the held-out fold, one text of each.

    Blank texts are left out: they hold no term, so their labels would only say how to judge every text without known terms.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    once = docs.where(F.col("text").rlike(r"\S")).join(F.broadcast(marked), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))
    return once.select("text", F.col("toxic").cast("int"))


def term_counts(rows: DataFrame) -> DataFrame:
    """Documents that hold a term (n), and those of them marked toxic (pos); a task adds up before it sends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, n, pos = Terms(), Counter(), Counter()

        def settle() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array([pos[t] for t in n], pa.int64()), pa.array(n.values(), pa.int64())], names=["term", "pos", "n"])
            n.clear()
            pos.clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1)):
                found = terms.of(text.as_py())
                n.update(found)
                if toxic.as_py():
                    pos.update(found)
                if len(n) >= COUNTED:
                    yield settle()
        yield settle()

    return rows.select("text", "toxic").mapInArrow(run, "term string, pos long, n long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of label 1 per row, and each voter's accuracy, from votes of 1, 0 and -1 (none).

    A voter says 1 or 0 with a probability given the label; a voter that says
    none tells nothing, since most know one kind of toxic text only. ``start``, a belief per row, is where EM starts and each row's prior in
    every round: voters that miss a kind of toxic text can't talk its labels
    away. After a first fit, the correlations that voters
    keep given the label discount each voter's evidence by one over one plus
    its positive correlations, and EM goes on with them.
    """
    said = [(votes == v).astype(np.float32) for v in (1, 0)]
    p, prior = start, np.log(start) - np.log1p(-start)
    share = np.ones(votes.shape[1])
    for fit in range(2):
        for _ in range(rounds):
            given = [[(q @ x + 0.5) / (q.sum() + 1.5) for x in said] for q in (p, 1 - p)]  # silence is no evidence
            evidence = sum(x @ ((np.log(a) - np.log(b)) * share) for x, a, b in zip(said, *given))
            p = 1 / (1 + np.exp(-np.clip(evidence + prior, -30, 30)))
        if fit == 0:
            both, sign = np.zeros((votes.shape[1], votes.shape[1])), said[0] - said[1]
            for q in (p, 1 - p):
                x = sign - (q @ sign) / max(q.sum(), 1e-9)
                both += (x * q[:, None]).T @ x
            spread = np.sqrt(np.maximum(np.diag(both), 1e-9))
            rho = both / spread[:, None] / spread[None, :]
            np.fill_diagonal(rho, 0)
            share = 1 / (1 + np.where(rho > 0.2, rho, 0).sum(1))
    right = ((votes == 1) * p[:, None] + (votes == 0) * (1 - p)[:, None]).sum(0) / np.maximum((votes >= 0).sum(0), 1)
    return p, right


def fit_linear(r: np.ndarray, c: np.ndarray, p: np.ndarray, n: int, steps: int = 1500, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic weights of ``n`` term indicators and the bias, by accelerated gradient steps on soft labels of equal class weight.

    ``r`` and ``c`` name the row and the term of every term found.
    """
    weight = p / max(p.sum(), 1e-9) + (1 - p) / max((1 - p).sum(), 1e-9)
    weight = weight / weight.mean()
    w, b, vw, vb = np.zeros(n), 0.0, np.zeros(n), 0.0
    scale = np.sqrt(np.bincount(c, weight[r], minlength=n) / len(p) + 1e-4)
    for _ in range(steps):
        z = b + np.bincount(r, w[c], minlength=len(p))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - p) / len(p)
        vw = 0.9 * vw - (np.bincount(c, g[r], minlength=n) + penalty * w) / scale
        vb = 0.9 * vb - g.sum()
        w, b = w + 0.5 * vw, b + 0.5 * vb
    return w, b


def fit(docs: DataFrame, labels: DataFrame, most: int, vocabulary: int, voters: int) -> tuple[dict[str, float], float, dict[str, float]]:
    """Term weights, bias, and the voters' accuracies."""
    rows = shared_table(training_rows(docs, labels, most), "toxic-rows")
    total = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    n, toxic = total[0], total[1] or 0
    if not toxic or toxic == n:
        return {}, -30.0 if not toxic else 30.0, {}
    seen = term_counts(rows).where("n > 2")
    rate = F.col("n") * toxic / n
    chosen = seen.withColumn("z", (F.col("pos") - rate) / F.sqrt(rate + 1)).where(F.abs("z") > 3).orderBy(F.abs("z").desc(), "term").limit(vocabulary).collect()
    place = {r.term: i for i, r in enumerate(chosen)}
    lexicon = [i for i, r in enumerate(chosen) if r.z > 3 and r.pos >= 0.7 * r.n][:voters]
    levels = levels_of(place)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(levels)
        for batch in batches:  # terms become places in the vocabulary: numbers, not texts, reach the driver
            for part in slices(batch, 0, TOGETHER):
                texts = part.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([known.places(t) for t in texts], pa.list_(pa.int32())),
                                                  pa.array([patterns(t) for t in texts], pa.list_(pa.int32()))], names=["toxic", "places", "votes"])

    sample = rows.select("text", "toxic").mapInArrow(coded, "toxic int, places array<int>, votes array<int>").toArrow().combine_chunks()
    places, pattern = sample.column("places").combine_chunks(), sample.column("votes").combine_chunks()
    r, c = np.repeat(np.arange(len(sample)), places.value_lengths().to_numpy()), places.flatten().to_numpy().astype(np.int64)
    votes = np.full((len(sample), len(lexicon) + 1), -1, np.int8)
    column = np.full(len(chosen) + 1, -1)
    column[lexicon] = np.arange(len(lexicon))
    hit = column[c] >= 0
    votes[r[hit], column[c[hit]]] = 1
    votes[(votes[:, :-1] == 1).sum(1) == 0, -1] = 0
    votes = np.hstack([votes, pattern.flatten().to_numpy().reshape(len(sample), -1).astype(np.int8)])
    p, right = label_model(votes, np.where(sample.column("toxic").to_numpy() > 0, TRUST, 1 - TRUST))
    w, b = fit_linear(r, c, p, len(place))
    voters_named = [*(chosen[i].term for i in lexicon), "no lexicon term", "shouting", "many marks", "repeated marks", "calm"]
    return {t: float(w[i]) for t, i in place.items()}, float(b), dict(zip(voters_named, right.tolist()))


def levels_of(place: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """For each term without its level: how often it must stand in a text, and the place that this gives."""
    levels = defaultdict(list)
    for name, at in place.items():
        term, _, least = name.partition("*")
        levels[term].append((int(least or 1), at))
    return dict(levels)


class Known:
    """Places of the terms of a text in a vocabulary."""

    def __init__(self, levels: dict[str, list[tuple[int, int]]]):
        self.levels = list(levels.values())
        self.terms = Terms({t: i for i, t in enumerate(levels)})

    def places(self, text: str | None) -> list[int]:
        return sorted(at for i, n in self.terms.counts(text).items() for least, at in self.levels[i] if n >= least)


class Scorer:
    """Scores of texts by a linear classifier over terms."""

    def __init__(self, weights: dict[str, float], bias: float):
        names = sorted(weights)
        self.known, self.weights, self.bias = Known(levels_of({t: i for i, t in enumerate(names)})), [weights[t] for t in names], bias

    def of(self, texts: pa.Array) -> np.ndarray:
        z = np.array([self.bias + sum(self.weights[at] for at in self.known.places(text.as_py())) for text in texts], float)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = 20_000, vocabulary: int = 4000, voters: int = 96) -> DataFrame:
    """Toxicity of every text: doc_id, held_out, score, predicted.

    Voters are the terms (words and first letters of words, also as they stand
    twice or four times in a text) that labelled
    documents tie to toxicity, their absence, and patterns of shouting. A
    generative model estimates from their votes how accurate and correlated
    they are and, with its label as prior, gives each sampled document a posterior; a linear classifier
    over terms learns those and scores all documents, whole texts. Labels come
    only from rows whose crc32(doc_id as text) mod 5 is not 0, at most ``most``
    of them, those with the smallest hashes; the tables that reach the driver
    are bounded by ``most``, ``vocabulary`` and ``voters``. Scores see the text
    alone.

    Null and empty texts score as a text without terms and teach nothing. A null doc_id is held
    out. Rows of equal doc_id each give a row, several labels of one document
    count as the largest. Without labels, or with one class only, every score
    is that of the class seen, 0 if none. An empty table gives no rows. Other
    columns are not read.
    """
    weights, bias, _ = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), most, vocabulary, voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights, bias)
        for batch in batches:
            score = scorer.of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held.alias("held_out")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, most: int = 20_000, vocabulary: int = 4000, voters: int = 96) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns: row by row, whatever their doc_id."""
    weights, bias, _ = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), most, vocabulary, voters)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights, bias)
        for batch in batches:
            for part in slices(batch, place, 4 * TOGETHER):
                yield part.filter(pa.array(scorer.of(part.column(place)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
