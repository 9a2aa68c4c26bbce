"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Their accuracies
are unknown; expectation-maximisation over the counts of vote patterns estimates
them with the share of good documents. The posterior labels of a bounded sample
then train a logistic scorer on hashed features, which scores every document.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.wordhash import word_hashes

#: Documents that the scorer is fitted on, at most about this many; the labellers' model covers all.
FIT_DOCS = 4000
BUCKETS, ROUNDS, RATE, DECAY = 1 << 12, 300, 0.5, 1e-4
EM_STEPS, PRIOR = 200, 0.5
BAD, GOOD, NONE = 0, 1, 2
_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    """Per code point: bit 1 letter, 2 upper case, 4 digit, 8 white space."""
    if not _classes:
        chars = [chr(c) for c in range(0x110000)]
        _classes.append(np.fromiter((c.isalpha() | c.isupper() << 1 | c.isdigit() << 2 | c.isspace() << 3 for c in chars), np.uint8, len(chars)))
    return _classes[0]


def measures(text: str) -> dict[str, float]:
    """What the labellers look at, over the whole text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _class_table()[points]
    space = (kind & 8) > 0
    edge = np.flatnonzero(np.diff(~space, prepend=False, append=False))
    lengths = edge[1::2] - edge[::2]
    shown = max(1, int((~space).sum()))
    letters = int((kind & 1).sum())
    words = word_hashes(text.encode("utf-8", "surrogatepass"))[1]
    _, times = np.unique(words, return_counts=True)
    lines = [x for x in text.split("\n") if x.strip()]
    return {
        "words": len(lengths),
        "upper": int(((kind & 2) > 0).sum()) / max(1, letters),
        "letters": letters / shown,
        "symbols": int((kind & 13 == 0).sum()) / shown,
        # A few words say nothing about the share of short ones.
        "short": float((lengths <= 3).mean()) if len(lengths) >= 20 else float("nan"),
        "length": float(lengths.mean()) if len(lengths) else 0.0,
        # A long text repeats common words anyway: distinct words are held against the square root law's share.
        "distinct": len(times) / max(1, len(words)) * max(1.0, len(words) / 200) ** 0.25,
        "top": float(times.max() / len(words)) if len(words) >= 20 else 0.0,
        "packed": len(zlib.compress(text.encode("utf-8", "surrogatepass"), 1)) / max(1, len(text)) if len(words) >= 20 else 1.0,
        "lines": len(set(lines)) / max(1, len(lines)),
        "ends": float(np.mean([x.rstrip()[-1] in ".!?…\"')" for x in lines])) if lines else 0.0,
        "marks": sum(text.count(x) for x in ("!!", "??", "***", "###", "$$$", " | ")) / max(1, len(lengths)),
    }


# Measure, bad below, good from, good to, bad above. Where from is above
# to, the labeller only ever finds documents bad: a text that shows no symbols may
# still be bad in another way.
LABELLERS = (
    ("symbols", -1, 1, 0, 0.10),
    ("upper", -1, 1, 0, 0.30),
    ("marks", -1, 1, 0, 0.10),
    ("distinct", 0.40, 1, 0, 99),
    ("top", -1, 1, 0, 0.35),
    ("packed", 0.25, 1, 0, 99),
    ("lines", 0.60, 1, 0, 2),
    ("letters", 0.70, 0.90, 1.0, 2),
    ("short", 0.08, 0.20, 0.48, 0.80),
    ("length", 2.5, 3.5, 7.0, 14),
    ("ends", -1, 0.5, 1.0, 2),
)
LEAST_WORDS = 5


def votes(text: str) -> list[int]:
    """Each labeller's vote; too few words give none."""
    m = measures(text)
    if m["words"] < LEAST_WORDS:
        return [NONE] * len(LABELLERS)
    return [BAD if m[k] < low or m[k] > high else GOOD if a <= m[k] <= b else NONE for k, low, a, b, high in LABELLERS]


def pattern(vote: list[int]) -> int:
    return sum(v * 3**i for i, v in enumerate(vote))


def label_model(patterns: dict[int, int], labellers: int = len(LABELLERS)) -> tuple[dict[int, float], np.ndarray, float]:
    """Posterior of good for each pattern, accuracies (labeller, truth, vote), share of good.

    Expectation-maximisation from the votes' majority; votes are smoothed by one
    in each cell. No vote at all gives the prior.
    """
    if not patterns:
        return {}, np.full((labellers, 2, 3), 1 / 3), PRIOR
    keys = sorted(patterns)
    v = np.array([[k // 3**i % 3 for i in range(labellers)] for k in keys])
    n = np.array([patterns[k] for k in keys], float)
    good, bad = (v == GOOD).sum(1), (v == BAD).sum(1)
    q = (good + 1) / (good + bad + 2.0)
    q = np.where(bad * 2 >= good, np.minimum(q, 0.4), q)
    one = np.eye(3)[v]
    for _ in range(EM_STEPS):
        prior = (n @ q + 1) / (n.sum() + 2)
        table = np.stack([np.einsum("p,pij->ij", n * w, one) + 1 for w in (1 - q, q)], 1)
        table /= table.sum(2, keepdims=True)
        logs = np.log(table)
        # An abstention tells nothing; only votes weigh.
        said = (v != NONE)[:, :, None]
        ratio = ((logs[None, :, 1, :] - logs[None, :, 0, :]) * one * said).sum((1, 2)) + np.log(prior / (1 - prior))
        new = 1 / (1 + np.exp(-np.clip(ratio, -50, 50)))
        moved, q = np.abs(new - q).max(), new
        if moved < 1e-9:
            break
    return dict(zip(keys, q.tolist())), table, float(prior)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values (unit length) of the hashed byte trigrams, word repeats and shapes."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    grams = (data[:-2] * np.uint32(65599) + data[1:-1] * np.uint32(257) + data[2:]) * np.uint32(2654435761) >> np.uint32(20) if len(data) > 2 else np.zeros(0, np.uint32)
    b, n = np.unique(grams.astype(np.int64), return_counts=True)
    x = np.zeros(BUCKETS)
    x[b] = np.sqrt(n)
    x /= max(1e-9, np.sqrt((x * x).sum()))
    _, times = np.unique(word_hashes(text.encode("utf-8", "surrogatepass"))[1], return_counts=True)
    if len(times):
        # The share of words by how often they come, on a log scale; and how many words there are.
        total = times.sum()
        for step in range(0, 12):
            part = times[(times >= 1 << step) & (times < 2 << step)].sum() / total
            x[(step * 2654435761 + 97) % BUCKETS] += part
        x[(int(np.log2(total)) * 40503 + 11) % BUCKETS] += 0.5
        x[(int(20 * len(times) / total) * 69621 + 7) % BUCKETS] += 0.5
    b = np.flatnonzero(x)
    return b, x[b]


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of the logistic scorer on soft labels, classes weighing alike."""
    weights, bias, speed, push = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS), 0.0
    if not rows:
        return weights, bias
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (b, value) in enumerate(rows):
        x[i, b] = value
    good, bad = max(target.sum(), 1e-6), max((1 - target).sum(), 1e-6)
    mass = target / good + (1 - target) / bad
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ weights.astype(np.float32) + bias, -30, 30)))
        error = (p - target) * mass
        speed = 0.9 * speed - RATE * (x.T @ error.astype(np.float32) + DECAY * weights)
        push = 0.9 * push - RATE * float(error.sum())
        weights, bias = weights + speed, bias + push
    return weights, bias


def _votes(batches):
    for batch in batches:
        found = [pattern(votes(x.as_py() or "")) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32())], names=["pattern"])


def _features(batches):
    for batch in batches:
        texts = [x.as_py() or "" for x in batch.column("text")]
        rows = [features(t) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array([pattern(votes(t)) for t in texts], pa.int32()), pa.array([b.astype(np.int16) for b, _ in rows], pa.list_(pa.int16())), pa.array([x.astype(np.float32) for _, x in rows], pa.list_(pa.float32()))], names=["pattern", "bucket", "value"])


def classify(docs: DataFrame, threshold: float = 0.5, fit_docs: int = FIT_DOCS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, pattern, posterior, score, kept.

    ``posterior`` is the label model's probability of good, ``score`` the scorer's;
    documents scoring ``threshold`` or more are kept. The label model's counts cover
    all documents: the driver gets one count for each vote pattern. The scorer is
    fitted on the documents whose hash of id and text falls into a share of about
    ``fit_docs``, copies with one id once, so null and repeated ids draw like others.
    Null and empty texts get no votes; too short to judge, they are kept only by
    their score. Repeated rows stay rows; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.select("text").mapInArrow(_votes, "pattern int").groupBy("pattern").agg(F.count("*").alias("n"))
    patterns = {r["pattern"]: r["n"] for r in counted.collect()}
    posterior, _, prior = label_model(patterns)
    share = min(1.0, fit_docs / max(1, sum(patterns.values())))
    drawn = rows.withColumn("_h", F.xxhash64(F.lit("quality"), "doc_id", "text")).where(F.pmod("_h", F.lit(1 << 30)) < int(share * (1 << 30)))
    # Copies with one id are drawn together; one of them is enough.
    part = drawn.groupBy("_h").agg(F.max("text").alias("text")).select("text")
    sample = part.mapInArrow(_features, "pattern int, bucket array<short>, value array<float>").collect()
    # Rows without votes teach nothing.
    sample = [r for r in sample if any(r["pattern"] // 3**i % 3 != NONE for i in range(len(LABELLERS)))]
    weights, bias = fit_scorer([(np.array(r["bucket"], np.int64), np.array(r["value"])) for r in sample], np.array([posterior.get(r["pattern"], prior) for r in sample]))
    model = docs.sparkSession.sparkContext.broadcast((weights, bias, posterior, prior))

    def run(batches):
        w, b0, known, unknown = model.value
        for batch in batches:
            out = []
            for x in batch.column("text"):
                text = x.as_py() or ""
                k = pattern(votes(text))
                b, value = features(text)
                score = float(1 / (1 + np.exp(-np.clip(value @ w[b] + b0, -30, 30))))
                out.append((k, known.get(k, unknown), score, score >= threshold))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.float64(), pa.float64(), pa.bool_()))]], names=["doc_id", "pattern", "posterior", "score", "kept"])

    return rows.mapInArrow(run, "doc_id long, pattern int, posterior double, score double, kept boolean")
