"""Personal data: overlapping candidates, boosted trees over format and context, calibrated thresholds."""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrade.llm.common import bounded_sample

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# The parts of the base patterns.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
#: Every ip, card and phone (but its plus sign) lies in one such region.
REGION = re.compile(r"[0-9][\x20().0-9-]*")

LABEL = re.compile(r"[A-Za-z0-9-]+")
LOOSE_CARD = re.compile(r"[0-9](?:[\x20.-]?[0-9]){12,18}(?![0-9])")
AT_SIGN = r"\x20?[\[({<]\x20?(?:at|AT)\x20?[\])}>]\x20?"
DOT_SIGN = r"\x20?[\[({<]\x20?(?:dot|DOT)\x20?[\])}>]\x20?"
MASKED_AT = re.compile(AT_SIGN.removeprefix(r"\x20?"))
MASKED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{AT_SIGN}[A-Za-z0-9-]++(?:(?:\.|{DOT_SIGN})[A-Za-z0-9-]++)+")
DIGITS = re.compile(r"[0-9]+")

#: Context words before a candidate, by what they speak for; the last group speaks against.
CONTEXT = (
    ("mail", "write", "contact", "e-mail"), ("tel", "phone", "call", "fax", "mobile", "cell", "sms"),
    ("card", "visa", "credit", "debit", "iban", "pan"), ("ip", "host", "addr", "server", "client"),
    ("version", "order", "isbn", "ref", "build", "no", "id", "item", "page", "section", "total", "part"),
)
FEATURES = ("email", "ip", "card", "phone", "plus", "digits", "groups", "longest group", "shortest group", "blanks", "dashes", "dots",
            "brackets", "luhn", "octets", "length", "letters", "at", "masked at", "labels", "glued before", "glued after",
            *(f"context {i}" for i in range(len(CONTEXT))))


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def _octets(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in parts)


def scan(text: str, loose: bool = True) -> tuple[list[Span], list[Span]]:
    """Base spans and further candidates of a text, in one linear walk over its at signs and digit regions."""
    base: list[Span] = []
    more: list[Span] = []
    floor, at = 0, text.find("@")
    while at >= 0:
        local = text[floor:at]
        start = floor + len(local.rstrip(LOCAL))
        floor = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            base.append(("email", start, m.end()))
            floor = m.end()
        elif start < at and loose and (m := LABEL.match(text, at + 1)):
            more.append(("email", start, m.end()))
        at = text.find("@", floor)
    if loose and MASKED_AT.search(text):
        more += [("email", *m.span()) for m in MASKED.finditer(text)]
    for r in REGION.finditer(text):
        start, end = r.span()
        plus = start > 0 and text[start - 1] == "+"
        if end - start < 7 and not plus:
            continue
        region = r.group()
        last = len(region.rstrip(" ().-"))
        for m in IP.finditer(region):
            (base if _octets(m.group()) else more).append(("ip", start + m.start(), start + m.end()))
        for m in CARD.finditer(region):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    base.append(("card", start + m.start(), start + m.end()))
        n = sum(map(len, DIGITS.findall(region)))
        if plus and last >= 3 and 8 <= n <= 15:
            base.append(("phone", start - 1, start + last))
        elif loose and 7 <= n <= 15:
            more.append(("phone", start - (start > 0 and text[start - 1] in "+("), start + last))
        if loose and n >= 13:
            more += [("card", start + m.start(), start + m.end()) for m in LOOSE_CARD.finditer(region)]
    base.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
    known = set(base)
    return base, [s for s in more if s not in known]


def describe(text: str, span: Span) -> list[float]:
    """Format and context features of a candidate."""
    kind, start, end = span
    s = text[start:end]
    groups = DIGITS.findall(s)
    digits = "".join(groups)
    words = re.findall(r"[a-z-]+", text[max(0, start - 32):start].lower())
    return [*(float(kind == k) for k in KINDS), float(s[:1] == "+"), len(digits), len(groups), max(map(len, groups), default=0),
            min(map(len, groups), default=0), s.count(" "), s.count("-"), s.count("."), s.count("(") + s.count("["),
            float(len(digits) > 1 and luhn(digits)), float(_octets(s) if kind == "ip" else 0), len(s), sum(c.isalpha() for c in s), s.count("@"),
            float(bool(re.search(AT_SIGN, s))) if kind == "email" else 0.0, s.count(".") + len(re.findall(DOT_SIGN, s)) if kind == "email" else 0.0,
            float(start > 0 and text[start - 1].isalnum()), float(end < len(text) and text[end].isalnum()),
            *(float(any(w in c for w in words)) for c in CONTEXT)]


def _drill(rng: random.Random) -> Iterator[tuple[str, str, int]]:
    """Labelled examples by rule: (text with one candidate, kind, personal or not)."""
    digits = lambda n: "".join(rng.choices("0123456789", k=n))

    def card(valid: bool) -> str:
        body = "4" + digits(14)
        return next(body + d for d in "0123456789" if luhn(body + d) == valid)

    name = "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) + rng.choice(["", "." + digits(2)])
    site = "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8)))
    say = lambda i: rng.choice(["", *(w + rng.choice([" ", ": "]) for w in CONTEXT[i])])
    a, d = rng.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), ("(at)", ".")])
    yield f"{say(0)}{name}@mail.{site}.com", "email", 1
    yield f"{say(0)}{name}{a}{site}{d}org", "email", 1
    yield f"{say(4)}{name}@{site}", "email", 0
    sep = rng.choice([" ", "-", "."])
    yield f"{rng.choice(CONTEXT[1])} ({digits(3)}) {digits(3)}-{digits(4)}", "phone", 1
    yield f"{rng.choice(CONTEXT[1])} {digits(3)}{sep}{digits(3)}{sep}{digits(4)}", "phone", 1
    yield f"{say(1)}+{digits(2)} ({digits(3)}) {digits(3)}-{digits(4)}", "phone", 1
    yield f"{rng.choice(CONTEXT[4])} {digits(rng.randint(7, 15))}", "phone", 0
    yield f"{digits(rng.randint(7, 15))}", "phone", 0
    yield f"{rng.choice(['', 'on ', 'from '])}{digits(4)}-{digits(2)}-{digits(2)}", "phone", 0
    yield f"{say(4)}{digits(3)}.{digits(rng.randint(4, 6))} {digits(2)}", "phone", 0
    c = card(True)
    yield f"{say(2)}{sep.join(c[i:i + 4] for i in range(0, 16, 4))}", "card", 1
    yield f"{say(2)}{c}", "card", 1
    yield f"{say(4)}{card(False)}", "card", 0
    yield f"{say(2)}{card(False)}", "card", 0
    yield f"{say(3)}{'.'.join(str(rng.randint(0, 255)) for _ in range(4))}", "ip", 1
    yield f"{say(4)}{rng.randint(1, 9)}.{rng.randint(256, 999)}.{rng.randint(0, 99)}.{rng.randint(0, 9)}", "ip", 0


def training_set(docs: DataFrame, sample_docs: int, seed: int, rounds: int = 60) -> pd.DataFrame:
    """Labelled candidates: examples made by rule and those of a bounded sample of documents.

    In the sample, base spans are personal data; cards that fail their check
    digit, addresses with parts over 255 and other readings of a base span are
    not; further candidates stay unlabelled. At most 40 come from a document.
    """
    rng = random.Random(seed)
    rows = []
    for _ in range(rounds):
        for text, kind, label in _drill(rng):
            base, more = scan(text)
            rows += [(*describe(text, s), label) for s in base + more if s[0] == kind]

    def of_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                base, more = scan(text or "")
                no = [s for s in more if any(s[1] < e and b < s[2] for _, b, e in base)
                      or s[0] == "ip" or s[0] == "card" and not luhn("".join(DIGITS.findall(text[s[1]:s[2]])))]
                out += [(*describe(text, s), label) for label, spans in ((1, base), (0, no)) for s in spans[:20]]
            yield pa.RecordBatch.from_pydict({"x": [list(map(float, r)) for r in out]}, schema=pa.schema([("x", pa.list_(pa.float64()))]))

    sample = bounded_sample(docs.select("doc_id", "text"), "doc_id", sample_docs).select("text").mapInArrow(of_sample, "x array<double>")
    rows += [tuple(r[0]) for r in sample.orderBy(F.xxhash64("x"), "x").limit(4 * sample_docs).collect()]
    # in one order, whatever the layout of the documents
    return pd.DataFrame(sorted(rows), columns=[*FEATURES, "label"], dtype=float)


def fit_trees(spark: SparkSession, data: pd.DataFrame, precision: float, seed: int, trees: int = 16, depth: int = 3) -> dict:
    """Boosted trees as plain arrays, with a threshold per kind.

    A third of the candidates is held out; a kind's threshold is the lowest
    score from which on its held-out candidates are personal data at
    ``precision``, half a step above the next lower score. A kind that never
    gets there selects nothing.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    held = np.arange(len(data)) % 3 == 0
    x = data[list(FEATURES)].to_numpy()
    frame = spark.createDataFrame(list(zip(x[~held].tolist(), data["label"].to_numpy()[~held].tolist())), "x array<double>, label double")
    frame = frame.coalesce(1).select(array_to_vector("x").alias("features"), "label").cache()
    fitted = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=64, seed=seed).fit(frame)
    frame.unpersist()
    model: dict = {"trees": [], "weights": list(fitted.treeWeights)}
    for tree in fitted.trees:
        nodes: list[list[float]] = []

        def add(node) -> int:
            at = len(nodes)
            nodes.append([0, 0.0, at, at, node.prediction()])
            if node.subtreeDepth():
                split = node.split()
                nodes[at][:4] = [split.featureIndex(), split.threshold(), add(node.leftChild()), add(node.rightChild())]
            return at

        add(tree._call_java("rootNode"))
        model["trees"].append(np.array(nodes))
    score, label = predict(model, x[held]), data["label"].to_numpy()[held]
    model["cut"] = {}
    for k in KINDS:
        own = data[k].to_numpy()[held] == 1
        order = np.argsort(-score[own], kind="stable")
        s, good = score[own][order], label[own][order]
        exact = np.cumsum(good) / np.arange(1, len(good) + 1)
        last_of_score = np.append(s[1:] != s[:-1], True) if len(s) else np.zeros(0, bool)
        fit = np.flatnonzero((exact >= precision) & last_of_score)
        below = s[fit[-1] + 1] if len(fit) and fit[-1] + 1 < len(s) else 0.0
        model["cut"][k] = float((s[fit[-1]] + below) / 2) if len(fit) else 2.0
    return model


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of personal data per row of features."""
    raw = np.zeros(len(x))
    rows = np.arange(len(x))
    for tree, weight in zip(model["trees"], model["weights"]):
        at = np.zeros(len(x), int)
        for _ in range(8):
            n = tree[at]
            at = np.where(x[rows, n[:, 0].astype(int)] <= n[:, 1], n[:, 2], n[:, 3]).astype(int)
        raw += weight * tree[at, 4]
    return 1 / (1 + np.exp(-2 * raw))


def select(base: list[Span], scored: Iterable[tuple[float, Span]]) -> list[Span]:
    """The scored spans, best first (ties: by kind, then place), that overlap neither ``base`` nor one another."""
    starts: list[int] = []
    ends: list[int] = []
    for _, b, e in sorted(base, key=lambda s: s[1]):  # base spans of different kinds may overlap: their union counts
        if ends and b < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(b)
            ends.append(e)
    out = []
    for _, s in sorted(scored, key=lambda c: (-c[0], c[1])):
        i = bisect_left(starts, s[2])  # only the last span that starts before this one ends can reach into it
        if not i or ends[i - 1] <= s[1]:
            starts.insert(i, s[1])
            ends.insert(i, s[2])
            out.append(s)
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, sample_docs: int = 2000, precision: float = 0.99, seed: int = 5) -> DataFrame:
    """Personal data of every text: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Generators walk each whole text once and propose base matches and looser,
    overlapping readings (addresses without a dot or with a written-out at
    sign, numbers without a plus sign, cards in other spacing). Base matches
    stay. Boosted trees score the others from their format and the words
    before; those over their kind's calibrated threshold are added, best
    first, if they overlap no span so far. Counts and hash are of base spans;
    ``spans`` has all, by kind and start. The trees learn from examples made by
    rule and at most ``sample_docs`` documents, four candidates a document on average;
    only those reach the driver, and their order there does not depend on the layout.

    Null text counts as empty: no spans. Documents with repeated or null doc_id
    each give a row; an empty table gives none. Only doc_id and text are read.
    Work is linear in a text's length.
    """
    model = fit_trees(docs.sparkSession, training_set(docs, sample_docs, seed), precision, seed)
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            x: list[list[float]] = []
            for t in batch.column(1):
                text = t.as_py() or ""
                base, more = scan(text)
                found.append((base, more, len(x)))
                x += [describe(text, s) for s in more]
            score = predict(model, np.array(x, float)) if x else []
            counts, hashes, spans = {k: [] for k in KINDS}, [], []
            for base, more, at in found:
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in base))
                hashes.append(hashlib.sha256(written(base).encode()).hexdigest())
                able = ((score[at + i], s) for i, s in enumerate(more) if score[at + i] >= model["cut"][s[0]])
                spans.append(written(sorted(base + select(base, able), key=lambda s: (KINDS.index(s[0]), s[1]))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(hashes, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return own.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
