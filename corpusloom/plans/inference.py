"""Registered queries on effects, intervals, families of tests and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.functions import stats as S
from corpusloom.operators import inference as I
from corpusloom.operators import sensitivity as X
from corpusloom.operators import transitions as T
from corpusloom.operators import trends as R
from corpusloom.plans.transitions import BLOCKS
from corpusloom.sources.corpus import MOVES, STAGES, labelled, oracle, segments

Z = S.Z95


def _blocks(spark, sf_dir):
    b = T.cue_blocks(segments(spark, sf_dir))
    return b.withColumn("move", T.dominant_move(F.col("moves"), MOVES)).withColumn("delta", (F.col("to_stage") - F.col("from_stage")).cast("double"))


@register("forward_share_interval", oracle(f"""{BLOCKS}, c AS (SELECT move, count(*) AS n, count(*) FILTER (to_stage > from_stage) AS k FROM chosen WHERE move IS NOT NULL GROUP BY ALL),
w AS (SELECT *, (k / n + {Z * Z} / (2 * n)) / (1 + {Z * Z} / n) AS mid, {Z} * sqrt(k / n * (1 - k / n) / n + {Z * Z} / (4 * n * n)) / (1 + {Z * Z} / n) AS half FROM c)
SELECT move, n, k, round(greatest(0.0, mid - half), 6) AS low, round(least(1.0, mid + half), 6) AS high FROM w"""))
def forward_share_interval(spark, sf_dir):
    c = _blocks(spark, sf_dir).where("move is not null").groupBy("move").agg(F.count("*").alias("n"), F.sum((F.col("delta") > 0).cast("long")).alias("k"))
    return c.withColumn("w", S.wilson(F.col("k"), F.col("n"))).select("move", "n", "k", "w.low", "w.high")


@register("move_odds_ratio", oracle(f"""{BLOCKS}, t AS (SELECT count(*) FILTER (to_stage > from_stage) AS up, count(*) FILTER (to_stage <= from_stage) AS rest FROM chosen WHERE move IS NOT NULL),
c AS (SELECT move, count(*) FILTER (to_stage > from_stage) + 0.5::DOUBLE AS a, count(*) FILTER (to_stage <= from_stage) + 0.5::DOUBLE AS b FROM chosen WHERE move IS NOT NULL GROUP BY ALL),
f AS (SELECT move, a, b, up - a + 1 AS c, rest - b + 1 AS d FROM c, t),
l AS (SELECT move, ln(a * d / (b * c)) AS l, sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS se FROM f)
SELECT move, round(exp(l), 6) AS ratio, round(exp(l - {Z} * se), 6) AS low, round(exp(l + {Z} * se), 6) AS high FROM l"""))
def move_odds_ratio(spark, sf_dir):
    up = lambda x: F.sum(x.cast("long"))
    b = _blocks(spark, sf_dir).where("move is not null")
    total = b.agg(up(F.col("delta") > 0).alias("u"), up(F.col("delta") <= 0).alias("r"))
    c = b.groupBy("move").agg(up(F.col("delta") > 0).alias("a"), up(F.col("delta") <= 0).alias("b")).crossJoin(F.broadcast(total))
    c = c.withColumn("o", S.odds_ratio(F.col("a"), F.col("b"), F.col("u") - F.col("a"), F.col("r") - F.col("b")))
    return c.select("move", *[F.round(f"o.{x}", 6).alias(x) for x in ("ratio", "low", "high")])


@register("move_response_cramers_v", oracle(f"""{BLOCKS}, r AS (SELECT move AS a, to_stage AS b FROM chosen WHERE move IS NOT NULL), c AS (SELECT a, b, count(*) AS o FROM r GROUP BY ALL),
s AS (SELECT sum(o * o / ((SELECT count(*) FROM r x WHERE x.a = c.a) * (SELECT count(*) FROM r y WHERE y.b = c.b))) AS s FROM c), n AS (SELECT count(*) AS n, least(count(DISTINCT a), count(DISTINCT b)) - 1 AS k FROM r)
SELECT n, round(n * (s - 1), 6) AS chi2, round(sqrt((s - 1) / k), 6) AS v FROM s, n"""))
def move_response_cramers_v(spark, sf_dir):
    return I.cramers_v(_blocks(spark, sf_dir), "move", "to_stage")


@register("fdr_by_move", oracle(f"""{BLOCKS}, c AS (SELECT move, count(*) FILTER (to_stage > from_stage) AS up, count(*) FILTER (to_stage < from_stage) AS down FROM chosen WHERE move IS NOT NULL GROUP BY ALL),
p AS (SELECT move, up, down, round(least(1.0, CASE WHEN up + down = 0 THEN 1.0 ELSE 2 * list_sum(list_transform(range(greatest(up, down), up + down + 1), lambda j: exp(lgamma(up + down + 1) - lgamma(j + 1) - lgamma(up + down - j + 1) - (up + down) * ln(2)))) END), 6) AS p FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY p, move) AS i, count(*) OVER () AS m FROM p)
SELECT move, up, down, p, round(least(1.0, min(p * m / i) OVER (ORDER BY i DESC)), 6) AS q, round(least(1.0, min(p * m / i) OVER (ORDER BY i DESC)), 6) <= 0.05 AS rejected FROM r"""))
def fdr_by_move(spark, sf_dir):
    """Exact sign test of each move's changes, forward against backward, as one family."""
    count = lambda test: F.sum(test.cast("long"))
    c = _blocks(spark, sf_dir).where("move is not null").groupBy("move").agg(count(F.col("delta") > 0).alias("up"), count(F.col("delta") < 0).alias("down"))
    return I.benjamini_hochberg(c.withColumn("p", F.round(I.sign_probability(F.col("up"), F.col("down")), 6)), "p")


@register("move_effect_size", oracle(f"""{BLOCKS}, d AS (SELECT from_stage, move, (to_stage - from_stage)::DOUBLE AS delta FROM chosen WHERE move IS NOT NULL), m AS (SELECT DISTINCT move FROM d),
s AS (SELECT m.move, avg(delta) FILTER (d.move = m.move) - avg(delta) FILTER (d.move <> m.move) AS diff, count(*) FILTER (d.move = m.move) AS n1, count(*) FILTER (d.move <> m.move) AS n2, var_samp(delta) FILTER (d.move = m.move) AS v1, var_samp(delta) FILTER (d.move <> m.move) AS v2 FROM m, d GROUP BY m.move),
e AS (SELECT move, n1, diff / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS smd FROM s WHERE n1 >= 4 AND n2 >= 4),
r AS (SELECT *, exp(0.91 * smd) AS rr, CASE WHEN exp(0.91 * smd) < 1 THEN 1 / exp(0.91 * smd) ELSE exp(0.91 * smd) END AS up FROM e)
SELECT move, n1 AS n, round(smd, 6) AS smd, round(rr, 6) AS risk_ratio, round(up + sqrt(up * (up - 1)), 6) AS e_value FROM r"""))
def move_effect_size(spark, sf_dir):
    """Pooled difference of a move's changes from all others', from sums by move."""
    b = _blocks(spark, sf_dir).where("move is not null")
    own = b.groupBy("move").agg(F.count("*").alias("n"), F.sum("delta").alias("s"), F.sum(F.col("delta") * F.col("delta")).alias("q"))
    total = own.agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    r = own.crossJoin(F.broadcast(total)).withColumn("n2", F.col("tn") - F.col("n")).where("n >= 4 and n2 >= 4")
    spread = lambda q, s, n: q - s * s / n
    pooled = F.sqrt((spread(F.col("q"), F.col("s"), F.col("n")) + spread(F.col("tq") - F.col("q"), F.col("ts") - F.col("s"), F.col("n2"))) / (F.col("tn") - 2))
    smd = (F.col("s") / F.col("n") - (F.col("ts") - F.col("s")) / F.col("n2")) / pooled
    return r.withColumn("smd", smd).select("move", "n", F.round("smd", 6).alias("smd"), F.round(S.smd_to_ratio(F.col("smd")), 6).alias("risk_ratio"), F.round(S.e_value(S.smd_to_ratio(F.col("smd"))), 6).alias("e_value"))


@register("words_cliffs_delta", oracle("r AS (SELECT word_count AS x, label >= 2 AS g FROM labelled) SELECT count(*) FILTER (g) AS n_true, count(*) FILTER (NOT g) AS n_false, round((SELECT sum(sign(a.x - b.x)) FROM r a, r b WHERE a.g AND NOT b.g) / (count(*) FILTER (g) * count(*) FILTER (NOT g)), 6) AS delta FROM r"))
def words_cliffs_delta(spark, sf_dir):
    return I.cliffs_delta(labelled(spark, sf_dir).withColumn("g", F.col("label") >= 2), "word_count", "g")


@register("within_between_confidence", oracle('SELECT segment_id, round(avg(confidence) OVER (PARTITION BY participant_id), 6) AS "between", round(confidence - avg(confidence) OVER (PARTITION BY participant_id), 6) AS "within" FROM labelled'))
def within_between_confidence(spark, sf_dir):
    return I.within_between(labelled(spark, sf_dir), "confidence", "participant_id").select("segment_id", "between", "within")


@register("lagged_exposure", oracle("""e AS (SELECT participant_id, session_number, count(*) FILTER (speaker = 'therapist') AS turns, avg(label) AS m FROM segments GROUP BY ALL),
l AS (SELECT *, lag(turns) OVER (PARTITION BY participant_id ORDER BY session_number) AS before FROM e) SELECT participant_id, session_number, before, round(m, 6) AS mean_label FROM l WHERE before IS NOT NULL AND m IS NOT NULL"""))
def lagged_exposure(spark, sf_dir):
    from pyspark.sql import Window

    e = segments(spark, sf_dir).groupBy("participant_id", "session_number").agg(F.sum((F.col("speaker") == "therapist").cast("long")).alias("turns"), F.avg("label").alias("m"))
    l = e.withColumn("before", F.lag("turns").over(Window.partitionBy("participant_id").orderBy("session_number")))
    return l.where("before is not null and m is not null").select("participant_id", "session_number", "before", F.round("m", 6).alias("mean_label"))


def drawn_sql(cluster: str, draws: int, seed: int = 42) -> str:
    """SQL of the draws' numbers and of how often each takes a cluster."""
    u = f"('0x' || substr(md5('{seed}:' || draw || ':' || {cluster}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
    return f"CASE WHEN draw < 0 THEN 1 ELSE {' + '.join(f'(({u}) >= {c!r}::DOUBLE)::INTEGER' for c in I.POISSON)} END", f"(SELECT unnest(range(-1, {draws}))::INTEGER AS draw)"


def _bootstrap_sql(source: str, keys: str, value: str, draws: int = 1000) -> str:
    """The interval over ``source``, whose clusters are participants; begins after its WITH clause."""
    times, numbers = drawn_sql("participant_id", draws)
    return f"""cl AS (SELECT {keys}, participant_id, sum({value})::DOUBLE AS s, count(*) AS m FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL),
dr AS (SELECT {keys}, draw, s, m, {times} AS t FROM cl, {numbers}),
av AS (SELECT {keys}, draw, sum(s * t) / sum(m * t) AS mean, sum(m * t)::BIGINT AS n, count(*) AS clusters FROM dr WHERE t > 0 GROUP BY ALL)
SELECT {keys}, max(n) FILTER (draw < 0) AS n, max(clusters) FILTER (draw < 0) AS clusters, round(max(mean) FILTER (draw < 0), 6) AS mean,
CASE WHEN max(clusters) FILTER (draw < 0) > 1 THEN round(quantile_cont(mean, 0.025) FILTER (draw >= 0), 6) END AS low, CASE WHEN max(clusters) FILTER (draw < 0) > 1 THEN round(quantile_cont(mean, 0.975) FILTER (draw >= 0), 6) END AS high
FROM av GROUP BY {keys}"""


@register("cluster_bootstrap_by_session_number", oracle(_bootstrap_sql("labelled", "session_number", "label")))
def cluster_bootstrap_by_session_number(spark, sf_dir):
    """Mean label with a percentile interval over resampled participants."""
    return I.cluster_bootstrap(labelled(spark, sf_dir), ["session_number"], "participant_id", "label")


@register("delta_bootstrap_by_stage_move", oracle(f"{BLOCKS}, w AS (SELECT *, (to_stage - from_stage)::DOUBLE AS delta FROM chosen WHERE move IS NOT NULL), " + _bootstrap_sql("w", "from_stage, move", "delta")))
def delta_bootstrap_by_stage_move(spark, sf_dir):
    """Mean change with a percentile interval over resampled participants."""
    return I.cluster_bootstrap(_blocks(spark, sf_dir).where("move is not null"), ["from_stage", "move"], "participant_id", "delta")


@register("stage_move_permutation")
def stage_move_permutation(spark, sf_dir):
    """Probability that move 0 changes the label as the other moves do, by first label."""
    return I.permutation_test(_blocks(spark, sf_dir).where("move is not null").withColumn("own", F.col("move") == 0), "from_stage", "own", "delta")


@register("participant_mann_kendall", oracle("""per AS (SELECT participant_id, session_number, avg(label) AS m FROM labelled GROUP BY ALL), o AS (SELECT participant_id, m, row_number() OVER (PARTITION BY participant_id ORDER BY session_number, m) AS i FROM per),
pr AS (SELECT a.participant_id, sum(sign(b.m - a.m)) AS s, median((b.m - a.m) / (b.i - a.i)) AS sen FROM o a JOIN o b ON a.participant_id = b.participant_id AND a.i < b.i GROUP BY ALL),
tie AS (SELECT participant_id, sum(c)::DOUBLE AS n, sum(c * (c - 1) * (2 * c + 5))::DOUBLE AS t3, sum(c * (c - 1) / 2) AS tied FROM (SELECT participant_id, m, count(*) AS c FROM per GROUP BY ALL) GROUP BY ALL),
v AS (SELECT t.participant_id, n, coalesce(s, 0)::DOUBLE AS s, coalesce(sen, 0) AS sen, n * (n - 1) / 2 AS pairs, tied, (n * (n - 1) * (2 * n + 5) - t3) / 18 AS var FROM tie t LEFT JOIN pr USING (participant_id)),
z AS (SELECT *, CASE WHEN s = 0 OR var <= 0 THEN 0.0 ELSE abs((s - sign(s)) / sqrt(var)) END AS z FROM v)
SELECT participant_id, n::BIGINT AS n, s, round(CASE WHEN pairs > tied THEN s / sqrt(pairs * (pairs - tied)) ELSE 0.0 END, 6) AS tau,
  round(1 - 2 * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 80), lambda k: CASE WHEN z = 0 THEN 0.0 ELSE exp((2 * k + 1) * ln(z) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1)) END)), 6) AS p, round(sen, 6) AS sen FROM z"""))
def participant_mann_kendall(spark, sf_dir):
    """Monotone trend of each participant's session means."""
    per = labelled(spark, sf_dir).groupBy("participant_id", "session_number").agg(F.avg("label").alias("m"))
    return R.mann_kendall(per, "participant_id", "session_number", "m")


@register("cohort_power", oracle("""SELECT cohort_id, count(DISTINCT participant_id) AS participants, count(DISTINCT session_id) AS sessions, count(DISTINCT participant_id) < 10 OR count(DISTINCT session_id) < 4 AS underpowered FROM labelled GROUP BY cohort_id"""))
def cohort_power(spark, sf_dir):
    """Cohorts that are too small for a trend."""
    c = labelled(spark, sf_dir).groupBy("cohort_id").agg(F.countDistinct("participant_id").alias("participants"), F.countDistinct("session_id").alias("sessions"))
    return c.withColumn("underpowered", S.underpowered(F.col("participants"), F.col("sessions")))


@register("move_effect_limit", oracle(f"""{BLOCKS}, d AS (SELECT move, (to_stage - from_stage)::DOUBLE AS delta FROM chosen WHERE move IS NOT NULL), m AS (SELECT DISTINCT move FROM d),
s AS (SELECT m.move, avg(delta) FILTER (d.move = m.move) - avg(delta) FILTER (d.move <> m.move) AS diff, count(*) FILTER (d.move = m.move) AS n1, count(*) FILTER (d.move <> m.move) AS n2, var_samp(delta) FILTER (d.move = m.move) AS v1, var_samp(delta) FILTER (d.move <> m.move) AS v2 FROM m, d GROUP BY m.move),
e AS (SELECT move, n1, n2, diff / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS smd FROM s WHERE n1 >= 4 AND n2 >= 4),
i AS (SELECT move, smd - {Z} * sqrt((n1 + n2) / (n1 * n2) + smd * smd / (2 * (n1 + n2))) AS low, smd + {Z} * sqrt((n1 + n2) / (n1 * n2) + smd * smd / (2 * (n1 + n2))) AS high FROM e),
r AS (SELECT *, exp(0.91 * CASE WHEN low > 0 THEN low ELSE high END) AS rr FROM i), u AS (SELECT *, CASE WHEN rr < 1 THEN 1 / rr ELSE rr END AS up FROM r)
SELECT move, round(low, 6) AS low, round(high, 6) AS high, round(CASE WHEN low <= 0 AND high >= 0 THEN 1.0 ELSE up + sqrt(up * (up - 1)) END, 6) AS e_value_limit FROM u"""))
def move_effect_limit(spark, sf_dir):
    """Large-sample interval of each move's standardised difference and the E-value of its nearer end."""
    b = _blocks(spark, sf_dir).where("move is not null")
    own = b.groupBy("move").agg(F.count("*").alias("n"), F.sum("delta").alias("s"), F.sum(F.col("delta") * F.col("delta")).alias("q"))
    total = own.agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    r = own.crossJoin(F.broadcast(total)).withColumn("n2", F.col("tn") - F.col("n")).where("n >= 4 and n2 >= 4")
    spread = lambda q, s, n: q - s * s / n
    pooled = F.sqrt((spread(F.col("q"), F.col("s"), F.col("n")) + spread(F.col("tq") - F.col("q"), F.col("ts") - F.col("s"), F.col("n2"))) / (F.col("tn") - 2))
    r = r.withColumn("smd", (F.col("s") / F.col("n") - (F.col("ts") - F.col("s")) / F.col("n2")) / pooled)
    half = Z * F.sqrt(F.col("tn") / (F.col("n") * F.col("n2")) + F.col("smd") * F.col("smd") / (2 * F.col("tn")))
    r = r.withColumn("low", F.col("smd") - half).withColumn("high", F.col("smd") + half)
    return r.select("move", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round(S.e_value_limit(F.col("low"), F.col("high")), 6).alias("e_value_limit"))


@register("move_likelihood_ratio", oracle(f"""{BLOCKS}, c AS (SELECT from_stage, move, to_stage, count(*)::DOUBLE AS n FROM chosen WHERE move IS NOT NULL GROUP BY ALL),
f AS (SELECT sum(n * ln(n / t)) AS ll FROM (SELECT n, sum(n) OVER (PARTITION BY from_stage, move) AS t FROM c)),
g AS (SELECT sum(n * ln(n / t)) AS ll FROM (SELECT n, sum(n) OVER (PARTITION BY from_stage) AS t FROM (SELECT from_stage, to_stage, sum(n) AS n FROM c GROUP BY ALL))),
k AS (SELECT (count(DISTINCT (from_stage, move)) - count(DISTINCT from_stage)) * 4 AS df FROM c),
x AS (SELECT greatest(2 * (f.ll - g.ll), 0.0) AS x, df FROM f, g, k)
SELECT round(x, 6) AS statistic, df, round(CASE WHEN df > 0 THEN list_sum(list_transform(range(0, df // 2), lambda i: exp(CASE WHEN i = 0 THEN 0 ELSE i * ln(greatest(x / 2, 1e-300)) END - x / 2 - lgamma(i + 1)))) ELSE 1.0 END, 6) AS p FROM x"""))
def move_likelihood_ratio(spark, sf_dir):
    """Whether the next label depends on the move besides the label before: nested multinomial models from counts."""
    c = _blocks(spark, sf_dir).where("move is not null").groupBy("from_stage", "move", "to_stage").agg(F.count("*").cast("double").alias("n"))

    def likelihood(cells, given):
        rows = cells.groupBy(*given).agg(F.sum(F.col("n") * F.log("n")).alias("own"), F.sum("n").alias("t"))
        return rows.agg(F.sum(F.col("own") - F.col("t") * F.log("t")).alias("ll"), F.count("*").alias("groups"))

    full = likelihood(c, ["from_stage", "move"])
    less = likelihood(c.groupBy("from_stage", "to_stage").agg(F.sum("n").alias("n")), ["from_stage"]).toDF("ll0", "groups0")
    both = full.crossJoin(F.broadcast(less)).select(F.greatest(2 * (F.col("ll") - F.col("ll0")), F.lit(0.0)).alias("x"), ((F.col("groups") - F.col("groups0")) * (STAGES - 1)).alias("df"))
    return both.select(F.round("x", 6).alias("statistic"), "df", F.round(S.chi2_tail_even(F.col("x"), F.col("df")), 6).alias("p"))


_TIMES, _NUMBERS = drawn_sql("participant_id", 1000)
_WITHIN = "sqrt(greatest((q - s * s / n) + (rq - rs * rs / rn), 0.0) / (n + rn - 2))"
_UPPER = "list_sum(list_transform(range(greatest(above, below), above + below + 1), lambda j: exp(lgamma(above + below + 1) - lgamma(j + 1) - lgamma(above + below - j + 1) + j * ln(g) - (above + below) * ln(1 + g))))"


@register("sensitivity_by_cell", oracle(f"""{BLOCKS}, d AS (SELECT participant_id, from_stage, move, (to_stage - from_stage)::DOUBLE AS delta FROM chosen WHERE move IS NOT NULL),
cl AS (SELECT participant_id, from_stage, move, count(*) AS n, sum(delta) AS s, sum(delta * delta) AS q FROM d GROUP BY ALL),
dr AS (SELECT from_stage, draw, move, sum(n * t)::DOUBLE AS n, sum(s * t) AS s, sum(q * t) AS q FROM (SELECT *, {_TIMES} AS t FROM cl, {_NUMBERS}) WHERE t > 0 GROUP BY ALL),
wh AS (SELECT *, sum(n) OVER (PARTITION BY from_stage, draw) - n AS rn, sum(s) OVER (PARTITION BY from_stage, draw) - s AS rs, sum(q) OVER (PARTITION BY from_stage, draw) - q AS rq FROM dr),
sm AS (SELECT *, CASE WHEN rn >= 1 AND n + rn > 2 THEN CASE WHEN round({_WITHIN}, 9) > 0 THEN (s / n - rs / rn) / {_WITHIN} ELSE 0.0 END END AS smd FROM wh),
en AS (SELECT from_stage, move, count(*) AS valid, quantile_cont(smd, 0.025) AS lo, quantile_cont(smd, 0.975) AS hi FROM sm WHERE draw >= 0 AND smd IS NOT NULL GROUP BY ALL),
pe AS (SELECT from_stage, count(DISTINCT participant_id) AS people FROM d GROUP BY ALL),
re AS (SELECT r.*, CASE WHEN people >= 2 AND valid >= {X.LEAST_DRAWS} THEN lo END AS low, CASE WHEN people >= 2 AND valid >= {X.LEAST_DRAWS} THEN hi END AS high FROM sm r JOIN pe USING (from_stage) LEFT JOIN en e ON e.from_stage = r.from_stage AND e.move = r.move WHERE draw < 0 AND n >= 4 AND rn >= 2),
si AS (SELECT r.from_stage, r.move, count(*) FILTER (delta > round(rs / rn, 9)) AS above, count(*) FILTER (delta < round(rs / rn, 9)) AS below FROM re r JOIN d ON d.from_stage = r.from_stage AND d.move = r.move GROUP BY ALL),
ga AS (SELECT *, CASE WHEN above + below < 3 THEN NULL WHEN above = below THEN 1.0 ELSE coalesce(list_filter(list_transform(range(101), lambda i: round(1 + 0.05 * i, 2)::DOUBLE), lambda g: {_UPPER} >= 0.05)[1], 6.0) END AS gamma FROM si),
ev AS (SELECT r.*, exp(0.91 * smd) AS rr, exp(0.91 * CASE WHEN low > 0 THEN low ELSE high END) AS near FROM re r)
SELECT v.from_stage, v.move, n::BIGINT AS n, round(s / n, 6) AS mean_delta, round(smd, 6) AS smd, round(low, 6) AS smd_ci_lo, round(high, 6) AS smd_ci_hi, round(rr, 6) AS approx_rr,
  round(greatest(rr, 1 / rr) + sqrt(greatest(rr, 1 / rr) * (greatest(rr, 1 / rr) - 1)), 6) AS e_value,
  round(CASE WHEN low <= 0 AND high >= 0 THEN 1.0 ELSE greatest(near, 1 / near) + sqrt(greatest(near, 1 / near) * (greatest(near, 1 / near) - 1)) END, 6) AS e_value_ci_limit, gamma
FROM ev v JOIN ga ON ga.from_stage = v.from_stage AND ga.move = v.move"""))
def sensitivity_by_cell(spark, sf_dir):
    """Robustness of each stage and move's change to hidden bias."""
    return X.sensitivity_bounds(_blocks(spark, sf_dir))


@register("move_cohens_h", oracle(f"""{BLOCKS}, c AS (SELECT move, count(*)::DOUBLE AS n, count(*) FILTER (to_stage > from_stage)::DOUBLE AS k FROM chosen WHERE move IS NOT NULL GROUP BY ALL), t AS (SELECT sum(n) AS tn, sum(k) AS tk FROM c)
SELECT move, n::BIGINT AS n, round(2 * asin(sqrt(k / n)) - 2 * asin(sqrt((tk - k) / (tn - n))), 6) AS h FROM c, t WHERE tn > n"""))
def move_cohens_h(spark, sf_dir):
    """Distance of each move's forward share from that of all other moves."""
    c = _blocks(spark, sf_dir).where("move is not null").groupBy("move").agg(F.count("*").alias("n"), F.sum((F.col("delta") > 0).cast("long")).alias("k"))
    both = c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("tn"), F.sum("k").alias("tk")))).where("tn > n")
    return both.select("move", "n", F.round(S.cohens_h(F.col("k") / F.col("n"), (F.col("tk") - F.col("k")) / (F.col("tn") - F.col("n"))), 6).alias("h"))
