"""Language identification by multilingual mixture inference.

Languages are character n-gram distributions. A document is a mixture of them:
expectation-maximisation estimates the proportions of a set of languages from the
n-gram likelihoods, and the set grows from the best single language as long as
another one raises the log-likelihood by more than its penalty.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._session import text_batches

#: Documents of each language that the model is fitted on, at most about this many.
FIT_DOCS = 4000
BUCKETS, ORDER, SMOOTH = 1 << 15, 3, 0.05
#: Penalty in log-likelihood for each further language: a part of the n-grams and a fixed part.
PENALTY_SHARE, PENALTY = 0.01, 8.0
STEPS, CLOSE = 30, 1e-4
UNKNOWN = "und"


#: Code points of a text that are hashed at a time.
PART = 1 << 18


def _parts(text: str):
    """Letters of the lower-cased text as code points, other characters taken as one space, in parts.

    Each part but the first begins with the last ORDER - 1 points of the one before.
    """
    tail, at = np.full(1, 32, np.uint64), 0
    while at < len(text):
        points = np.frombuffer(text[at : at + PART].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters(points)
        before = np.concatenate([[tail[-1] != 32 or at == 0], letter[:-1]])
        at += PART
        part = np.concatenate([tail, np.where(letter, points, 32)[letter | before].astype(np.uint64)])
        yield part if at < len(text) else np.append(part, np.uint64(32))
        tail = part[-(ORDER - 1) :]
    if not text:
        yield np.full(2, 32, np.uint64)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams of the whole text and their counts."""
    total = np.zeros(BUCKETS, np.int64) if len(text) > PART else None
    for x in _parts(text):
        h = np.zeros(max(0, len(x) - ORDER + 1), np.uint64)
        for j in range(ORDER):
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (x[j : j + len(h)] * np.uint64(0xBF58476D1CE4E5B9))
            h ^= h >> np.uint64(29)
        h = (h >> np.uint64(7)) & np.uint64(BUCKETS - 1)
        if total is None:
            return np.unique(h, return_counts=True)
        total += np.bincount(h.astype(np.int64), minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found.astype(np.uint64), total[found]


_is_letter: list[np.ndarray] = []


def _letters(points: np.ndarray) -> np.ndarray:
    if not _is_letter:
        _is_letter.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _is_letter[0][points]


def mixture(buckets: np.ndarray, counts: np.ndarray, model: np.ndarray) -> tuple[dict[int, float], np.ndarray]:
    """Proportions of the selected languages, and each language's own log-likelihood.

    ``model`` holds each bucket's probability by language (buckets x languages).
    """
    p, n = model[buckets], counts.astype(float)
    single = n @ np.log(p)
    chosen, share, best = [int(single.argmax())], np.ones(1), float(single.max())
    total = n.sum()
    while len(chosen) < model.shape[1]:
        mixed = p[:, chosen] @ share
        gain = (n / mixed) @ p / total  # over 1: a little of that language would raise the likelihood
        gain[chosen] = 0
        new = int(gain.argmax())
        if gain[new] <= 1 + 1e-6:
            break
        q = p[:, [*chosen, new]]
        w = np.append(share * 0.8, 0.2)
        for _ in range(STEPS):
            v = w * ((n / (q @ w)) @ q) / total
            moved, w = np.abs(v - w).max(), v
            if moved < CLOSE:
                break
        value = float(n @ np.log(q @ w))
        if value - best <= PENALTY + PENALTY_SHARE * total:
            break
        chosen, share, best = [*chosen, new], w / w.sum(), value
    return dict(zip(chosen, share)), single


def predict(text: str | None, model: np.ndarray) -> tuple[int, float]:
    """Number of the main language, -1 for none, and its score from 0 to 1.

    The score is the language's share in the mixture times its probability among
    the single languages outside the mixture.
    """
    if not text or model.shape[1] == 0:
        return -1, 0.0
    buckets, counts = ngram_counts(text)
    if not len(buckets) or not any(c.isalpha() for c in text):
        return -1, 0.0
    shares, single = mixture(buckets, counts, model)
    top = max(shares, key=lambda k: (shares[k], -k))
    inside = max(single[k] for k in shares)
    others = sum(math.exp(min(0.0, single[k] - inside)) for k in range(len(single)) if k not in shares)
    return top, float(min(1.0, shares[top] / (1 + others)))


def _count(batches):
    for batch in batches:
        sums: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            b, n = ngram_counts(text.as_py())
            sums.setdefault(lang, np.zeros(BUCKETS, np.int64))[b] += n
        for lang, x in sums.items():
            b = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(b), pa.string()), pa.array(b.astype(np.int32)), pa.array(x[b])], names=["lang", "bucket", "n"])


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their n-gram distributions from labelled ``docs`` (doc_id, text, lang).

    Of a language with more than ``fit_docs`` documents a share fixed by the hash of
    id and text is used, so null and repeated ids draw like others. The driver gets at most BUCKETS counts for each language.
    """
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((BUCKETS, 0))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, fit_docs / n) * (1 << 30)))])
    part = docs.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id", "text"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")))
    counted = part.select("lang", "text").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = sorted(sizes)
    place = {k: i for i, k in enumerate(langs)}
    table = np.full((BUCKETS, len(langs)), SMOOTH)
    with text_batches(docs.sparkSession):
        found = counted.collect()
    for r in found:
        table[r["bucket"], place[r["lang"]]] += r["n"]
    return langs, table / table.sum(0)


def _model(rows: DataFrame, fit_docs: int):
    """Broadcast of the languages and the model learned from ``rows`` (doc_id, text, lang, held_out)."""
    known = ~F.col("held_out") & F.col("text").isNotNull() & F.col("lang").isNotNull()
    langs, model = fit(rows.where(known).select("doc_id", "text", "lang"), fit_docs)
    return rows.sparkSession.sparkContext.broadcast((langs, model.astype(np.float32)))


def _described(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))


def identify(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Documents whose crc32(doc_id) mod 4 is 2 are held out of the fit; null texts and
    null languages teach nothing; null ids have no remainder and are not held out. Only the text
    is looked at for a prediction. Null texts, texts without a letter, and all
    texts where nothing could be learned, get ``und`` with score 0. Repeated rows stay
    rows, other columns are ignored, and an empty table gives no rows.
    """
    rows = _described(docs)
    small = _model(rows, fit_docs)

    def run(batches):
        names, table = small.value
        for batch in batches:
            found = [predict(x.as_py(), table) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([names[k] if k >= 0 else UNKNOWN for k, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def explained(text: str | None, model: np.ndarray) -> bool:
    """Whether a mixture of the languages fits ``text`` better than trigrams drawn evenly."""
    if not text or model.shape[1] == 0 or not any(c.isalpha() for c in text):
        return False
    buckets, counts = ngram_counts(text)
    shares, _ = mixture(buckets, counts, model)
    mixed = model[buckets][:, list(shares)] @ np.array(list(shares.values()))
    return float(counts @ np.log(mixed)) > -float(counts.sum()) * math.log(BUCKETS)


def keep_identified(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """``docs`` without the rows that no mixture of the known languages explains.

    A row goes if its text is null, has no letter, or is likelier as evenly drawn
    trigrams than under the best set of languages; how a text's languages share it
    doesn't matter. Every row is judged by its own text in one pass, so nothing is
    shuffled; null and repeated ids stay, columns of any name keep their values, and an
    empty table gives no rows.
    """
    small = _model(_described(docs), fit_docs)

    @F.arrow_udf("boolean")
    def fits(texts: pa.Array) -> pa.Array:
        _, table = small.value
        return pa.array([explained(x.as_py(), table) for x in texts], pa.bool_())

    # Only the text goes to Python and only the verdict comes back.
    return docs.where(fits(F.col("text").cast("string")))
