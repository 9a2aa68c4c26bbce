"""Secret scans: known shapes and sliding-window entropy, in Spark expressions only.

Three base shapes are found first. Then every candidate run of a character class
is walked with a window: the counts of the window's characters and the sum of
count * log2(count) change by the character that enters and the one that leaves,
which gives the window's Shannon entropy in bits. Windows at or above the class's
threshold are merged into spans; candidates that an allow-list pattern matches
give none, nor do spans inside a base span.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kind, pattern of the whole match, and the least length of the match
# (of its value, for assignments).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE_KINDS = ("assign", "access", "hex")
LEAST_VALUE = 6


@dataclass(frozen=True)
class CharacterClass:
    """One alphabet of the entropy scan. ``needs``: patterns a candidate must contain."""

    kind: str
    run: str
    alphabet: str
    window: int
    bits: float
    needs: tuple[str, ...]


CLASSES = (
    CharacterClass("entropy_hex", r"[0-9A-Fa-f]{16,}", "0123456789abcdefABCDEF", 16, 2.8, (r"[0-9]", r"[A-Fa-f]")),
    CharacterClass("entropy_base64", r"[A-Za-z0-9+/_-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 20, 3.6, (r"[0-9]", r"[a-z]", r"[A-Z]")),
)
#: Candidates that match one of these are no secrets: UUIDs, samples, runs of the alphabet.
ALLOW = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|x{6,}",
    r"(?i)0123456789|abcdefgh|qwerty",
    r"^sha(1|256|384|512)-",
)
#: The same for masking, where a run may be a whole path: patterns of a whole run, and
#: those that take only the run's part between / and _ that holds them.
ALLOW_RUN = (ALLOW[0], r"^sha(1-[A-Za-z0-9+/_-]{27}|256-[A-Za-z0-9+/_-]{43}|384-[A-Za-z0-9+/_-]{64}|512-[A-Za-z0-9+/_-]{86})$")
ALLOW_PART = ALLOW[1:3]
SPAN = "struct<s: int, k: int, e: int>"
#: Elements of an array that are walked one by one before blocks of them are joined.
BLOCK = 256


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(items: Column) -> Column:
    """An array cut into arrays of BLOCK elements."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))


def _matches(text: Column, pattern: str, values: bool = False) -> Column:
    """Array of struct(s, e, v, x) of the leftmost non-overlapping matches of ``pattern``.

    s and e count code points; v is the match, x its first group. The pieces
    between the matches give the places: first within blocks of BLOCK matches, then
    the blocks' own places, so many matches don't copy a growing array each time.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if values else found
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("p"), found.alias("v"), group.alias("x"))
    none = "array<struct<s: int, e: int, v: string, x: string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(none).alias("out"))

    def step(acc, z):
        s = acc["at"] + F.length(z["p"])
        e = s + F.length(z["v"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), z["v"].alias("v"), z["x"].alias("x")))).cast(none).alias("out"))

    def placed(parts):
        local = F.transform(_blocks(parts), lambda block: F.aggregate(block, start, step))
        return _bound(local, joined)

    def joined(local):
        ends = F.aggregate(local, F.array(F.lit(0)), lambda acc, z: F.concat(acc, F.array(F.element_at(acc, -1) + z["at"])))
        moved = F.zip_with(local, F.slice(ends, 1, F.size(local)), lambda z, at: F.transform(z["out"], lambda m: F.struct((m["s"] + at).alias("s"), (m["e"] + at).alias("e"), m["v"].alias("v"), m["x"].alias("x"))))
        return F.flatten(moved).cast(none)

    return F.when(text.rlike(pattern), _bound(F.filter(parts, lambda z: z["v"].isNotNull()), placed)).otherwise(F.array().cast(none))


def _hot_windows(word: Column, c: CharacterClass) -> Column:
    """Array of struct(s, e): merged windows of ``word`` with at least c.bits of entropy."""
    size, w = len(c.alphabet), c.window
    # count * log2(count) for counts 0 to the window's length
    weigh = F.array(F.lit(0.0), *[F.lit(float(i)) * F.log2(F.lit(float(i))) for i in range(1, w + 1)])
    codes = F.transform(F.split(word, ""), lambda x: F.instr(F.lit(c.alphabet), x))
    none = "array<struct<s: int, e: int>>"
    start = F.struct(F.array_repeat(F.lit(0), size).alias("n"), F.lit(0.0).alias("sum"), F.array().cast(none).alias("out"))

    def walk(code):
        def step(acc, i):
            new = F.element_at(code, i)
            old = F.when(i > w, F.element_at(code, F.greatest(i - w, F.lit(1)))).otherwise(0)
            had = F.when(old > 0, F.element_at(acc["n"], F.greatest(old, F.lit(1)))).otherwise(0)
            has = F.element_at(acc["n"], new) - F.when(new == old, 1).otherwise(0)
            less = F.when(old > 0, F.get(weigh, had) - F.get(weigh, had - 1)).otherwise(0.0)
            total = acc["sum"] - less + F.get(weigh, has + 1) - F.get(weigh, has)
            counts = F.transform(acc["n"], lambda x, k: x + F.when(k == new - 1, 1).otherwise(0) - F.when(k == old - 1, 1).otherwise(0))
            hot = (i >= w) & (F.lit(w).cast("double") * F.log2(F.lit(float(w))) - total >= F.lit(w * c.bits - 1e-9))
            last = F.element_at(F.when(F.size(acc["out"]) > 0, acc["out"]).otherwise(F.array(F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e")))), -1)
            grown = F.when(last["e"] >= i - w, F.concat(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.struct(last["s"].alias("s"), i.alias("e"))))).otherwise(F.concat(acc["out"], F.array(F.struct((i - w).alias("s"), i.alias("e")))))
            return F.struct(counts.alias("n"), total.alias("sum"), F.when(hot, grown).otherwise(acc["out"]).cast(none).alias("out"))

        return F.aggregate(F.sequence(F.lit(1), F.size(code)), start, step, lambda acc: acc["out"])

    return _bound(codes, walk)


def _between(run: Column, allow: tuple[str, ...]) -> Column:
    """Array of struct(s, v): what of a run (s, v) lies between the parts that ``allow`` names."""
    named = F.filter(_matches(run["v"], "[^/_]+"), lambda m: m["v"].rlike("|".join(f"(?:{p})" for p in allow)))
    starts = F.concat(F.array(F.lit(0)), F.transform(named, lambda m: m["e"]))
    ends = F.concat(F.transform(named, lambda m: m["s"]), F.array(F.length(run["v"])))
    return F.zip_with(starts, ends, lambda s, e: F.struct((run["s"] + s).alias("s"), F.substring(run["v"], s + 1, e - s).alias("v")))


def _entropy_spans(text: Column, c: CharacterClass, number: int, allow: tuple[str, ...], allow_part: tuple[str, ...]) -> Column:
    def candidate(m):
        ok = F.length(m["v"]) >= c.window
        for p in c.needs:
            ok = ok & m["v"].rlike(p)
        for p in allow:
            ok = ok & ~m["v"].rlike(p)
        return ok

    runs = F.filter(_matches(text, c.run), candidate)
    if allow_part:
        runs = F.filter(F.flatten(F.transform(runs, lambda m: _between(m, allow_part))), candidate)
    spans = F.transform(runs, lambda m: F.transform(_hot_windows(m["v"], c), lambda h: F.struct((m["s"] + h["s"]).alias("s"), F.lit(number).alias("k"), (m["s"] + h["e"]).alias("e"))))
    return F.flatten(spans).cast(f"array<{SPAN}>")


def _of_kind(matches: Column, k: int) -> Column:
    return F.transform(matches, lambda m: F.struct(m["s"].alias("s"), F.lit(k).alias("k"), m["e"].alias("e"))).cast(f"array<{SPAN}>")


def _inside(span: Column, blocks: Column) -> Column:
    """Whether one of the spans in blocks (lo, hi, items) holds ``span``."""
    return F.exists(blocks, lambda b: (b["lo"] <= span["s"]) & (b["hi"] >= span["e"]) & F.exists(b["items"], lambda x: (x["s"] <= span["s"]) & (x["e"] >= span["e"])))


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def scan(docs: DataFrame, classes: tuple[CharacterClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW, allow_part: tuple[str, ...] = (), base: str = "base", found: str = "found") -> DataFrame:
    """``docs`` with two arrays of struct(s, k, e) by start, then kind, named by ``base`` and ``found``.

    k is the place in BASE_KINDS, or after it the class's. A run that ``allow``
    matches gives no span; ``allow_part`` takes only the parts of a run that it
    matches, and what lies between them is scanned. Null texts count as
    empty. Nothing is shuffled and repeated rows stay rows. Columns of ``docs`` that
    have one of the two names are replaced; give other names to keep them.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    shapes = [F.filter(_matches(text, ASSIGN, values=True), lambda m: F.length(m["x"]) >= LEAST_VALUE), _matches(text, ACCESS), _matches(text, HEX)]
    shapes = [_of_kind(b, k) for k, b in enumerate(shapes)]
    out = docs.withColumn(base, F.array_sort(F.concat(*shapes)))
    extra = F.concat(*[_entropy_spans(text, c, len(BASE_KINDS) + i, allow, allow_part) for i, c in enumerate(classes)])
    blocks = F.transform(_blocks(F.col(base)), lambda b: F.struct(F.array_min(F.transform(b, lambda x: x["s"])).alias("lo"), F.array_max(F.transform(b, lambda x: x["e"])).alias("hi"), b.alias("items")))
    fresh = F.when(F.size(base) > 0, _bound(blocks, lambda held: F.filter(extra, lambda x: ~_inside(x, held)))).otherwise(extra)
    return out.withColumn(found, F.array_sort(F.concat(base, fresh)))


def span_text(spans: Column, classes: tuple[CharacterClass, ...] = CLASSES) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in (*BASE_KINDS, *[c.kind for c in classes])])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans."""
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{BASE_KINDS[k]}")
    return scan(docs.select("doc_id", "text")).select("doc_id", count(0), count(1), count(2), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("found")).alias("spans"))


def _merged(spans: Column) -> Column:
    """Spans (s, e) that overlap, sorted by start, as one each."""
    none = "array<struct<s: int, e: int>>"
    start = F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"), F.array().cast(none).alias("out"))

    def step(acc, x):
        done = F.when(acc["s"] < 0, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e")))))
        joins = (x["s"] < acc["e"]) & (acc["s"] >= 0)
        return F.struct(F.when(joins, acc["s"]).otherwise(x["s"]).alias("s"), F.when(joins, F.greatest(acc["e"], x["e"])).otherwise(x["e"]).alias("e"), F.when(joins, acc["out"]).otherwise(done).cast(none).alias("out"))

    whole = lambda acc: F.when(acc["s"] < 0, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e")))))
    by_block = F.transform(_blocks(spans), lambda block: F.aggregate(block, start, step, whole))
    # Blocks meet at their ends alone, where a last walk over their outer spans joins them.
    return F.aggregate(by_block, F.array().cast(none), lambda acc, block: F.when((F.size(acc) > 0) & (F.element_at(block, 1)["s"] < F.get(acc, F.size(acc) - 1)["e"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.aggregate(F.concat(F.slice(acc, F.size(acc), F.lit(1)), block), start, step, whole))).otherwise(F.concat(acc, block)).cast(none))


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mask``, overlapping ones by one.

    Sample words take only their part of a path (ALLOW_PART), so keys beside them are masked.
    n_chars, where present, follows the new text. Rows without spans, null and empty
    texts stay as they are, repeated rows are masked alike, and columns of any name
    keep their values. An empty table gives no rows.
    """
    base, found, spans, letters = (unused(docs, c) for c in ("_base", "_found", "_spans", "_letters"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = scan(docs, allow=ALLOW_RUN, allow_part=ALLOW_PART, base=base, found=found)
    rows = rows.withColumn(spans, F.when(F.size(found) > 0, _merged(F.col(found))))
    # Far places cost a walk from the text's start, so many spans take slices of its letters.
    rows = rows.withColumn(letters, F.when(F.size(spans) > BLOCK, F.split(text, "")))
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x["e"]))
    ends = F.concat(F.transform(spans, lambda x: x["s"]), F.array(F.length(text)))
    piece = lambda s, e: F.when(F.col(letters).isNotNull(), F.array_join(F.slice(letters, s + 1, e - s), "")).otherwise(F.substring(text, s + 1, e - s))
    clean = F.array_join(F.zip_with(starts, ends, piece), mask)
    hit = F.col(spans).isNotNull()
    new = {"text": F.when(hit, clean).otherwise(F.col("text")).alias("text")}
    if "n_chars" in docs.columns:
        shorter = F.length(text) - F.aggregate(spans, F.lit(0), lambda n, x: n + x["e"] - x["s"]) + F.size(spans) * len(mask)
        new["n_chars"] = F.when(hit, shorter.cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return rows.select(*[new.get(c, F.col(f"`{c}`")) for c in docs.columns])
