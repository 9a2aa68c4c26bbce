"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content.
STOP_WORDS = ("the", "and", "for", "that", "with", "this", "was", "are", "but", "not", "you", "have", "they", "from", "what", "when", "which", "there", "their", "would", "about", "just", "like")


def tokens(text: Column) -> Column:
    """Runs of letters, digits and apostrophes, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0))


def content_tokens(text: Column) -> Column:
    """Distinct tokens of three or more characters that are no stop words."""
    return F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS)))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct tokens; 0 where one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def normalized(text: Column) -> Column:
    """Lower case, punctuation dropped, white space folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", ""), r"\s+", " "))


def slug(text: Column) -> Column:
    """Lower-case words joined by underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def hms(ms: Column) -> Column:
    """Milliseconds as H:MM:SS."""
    s = F.floor(ms / 1000)
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def timecode(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS.mmm."""
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, ms % 1000)


def session_parts(session_id: Column) -> Column:
    """struct(cohort, number, variant) of ids like c2s13a; (null, 1, '') for others."""
    pattern = r"(?i)^c([0-9]+)s([0-9]+)([a-z]?)$"
    ok = session_id.rlike(pattern)
    part = lambda i: F.regexp_extract(session_id, pattern, i)
    return F.struct(F.when(ok, part(1).try_cast("int")).alias("cohort"), F.when(ok, part(2).try_cast("int")).otherwise(1).alias("number"), F.when(ok, F.lower(part(3))).otherwise("").alias("variant"))


def scrubbed(text: Column, names: tuple[str, ...], mask: str = "[name]") -> Column:
    """Names replaced where they stand as words, longer ones first, in any case."""
    import re

    known = sorted((n for n in names if len(n) >= 3), key=lambda n: (-len(n), n))
    return F.regexp_replace(text, r"(?i)\b(?:" + "|".join(re.escape(n) for n in known) + r")\b", mask) if known else text


def quotes(text: Column) -> Column:
    """Passages in straight or curly double quotes, three or more characters long."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[\"“]([^\"“”]{3,})[\"”]"), F.lit(1))


def within_budget(items: Column, sizes: Column, budget: int) -> Column:
    """Group number of each item when packed in order under a word budget; items are never split."""
    start = F.struct(F.lit(0).alias("group"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(acc, n):
        full = (acc["used"] > 0) & (acc["used"] + n > budget)
        group = acc["group"] + F.when(full, 1).otherwise(0)
        return F.struct(group.alias("group"), F.when(full, n).otherwise(acc["used"] + n).cast("long").alias("used"), F.concat(acc["out"], F.array(group)).alias("out"))

    return F.arrays_zip(items.alias("item"), F.aggregate(sizes, start, step, lambda acc: acc["out"]).alias("group"))


def sentence_list(text: Column) -> Column:
    """Sentences of a text: cut at white space after a full stop, question or exclamation mark."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(s) != "")
