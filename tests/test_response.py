"""Responses to cues, components, kept probes, anchors and stores on small frames."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import components as K
from corpusloom.operators import graphs as N
from corpusloom.operators import motifs as Q
from corpusloom.operators import probes as P
from corpusloom.operators import response as R
from corpusloom.sources import master as M

ROWS = "from_id string, participant_id string, from_stage int, move int, delta double, start array<double>, target array<double>, vector array<double>, fold int"


def blocks(seed=1, n=240):
    """The cue's direction decides the next stage; moves 0 and 1 have cues of their own."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        move, stage, who = rng.randrange(2), rng.randrange(3), rng.randrange(8)
        cue = [1.0 if move == 0 else -1.0, rng.gauss(0, 0.1), rng.gauss(0, 0.1), 0.2]
        to = min(2, max(0, stage + (1 if move == 0 else -1)))
        mix = lambda k: [0.9 if j == k else 0.05 for j in range(3)]
        rows.append((f"b{i}", f"p{who}", stage, move, float(to - stage), mix(stage) + [float(j == stage) for j in range(3)], mix(to), cue, who % 3))
    return rows


def test_the_cue_earns_its_place(spark):
    got = {r.arm: r for r in R.crossval(spark.createDataFrame(blocks(), ROWS), k=2).collect()}
    assert got["with_cue"].n == got["from_only"].n == 240
    assert got["with_cue"].kl < got["from_only"].kl - 0.2 and got["with_cue"].argmax_acc > got["from_only"].argmax_acc and got["with_cue"].estage_mae < got["from_only"].estage_mae
    one = spark.createDataFrame([(*r[:-1], 0) for r in blocks()[:10]], ROWS)
    assert R.crossval(one, k=2).count() == 0 and R.crossval(one.limit(0), k=2).count() == 0


def test_counterfactuals_and_cells(spark):
    frame = spark.createDataFrame(blocks(2), ROWS)
    got = R.counterfactual(frame, 5, k=2).groupBy("move").avg("influence").collect()
    mean = {r[0]: r[1] for r in got}
    assert set(mean) == {0, 1} and mean[0] > 0.2 and mean[1] < -0.2
    cells = {(r.from_stage, r.move): r for r in R.confound_cells(frame, 5, k=2, draws=40).collect()}
    assert len(cells) == 6 and all(r.div_lo <= r.div_hi for r in cells.values()) and cells[1, 0].observed_delta == 1.0
    assert R.counterfactual(frame.limit(0), 5, k=2).count() == 0


def test_linked_difference_edges(spark):
    a = spark.createDataFrame([("x", "p1", 2.0), ("x", "p2", 4.0), ("y", "p1", 1.0), ("x", None, 9.0), ("x", "p1", None), ("only_a", "p1", 1.0)], "k string, c string, v double")
    b = spark.createDataFrame([("x", "p1", 1.0), ("x", "p3", 1.0), ("y", "p1", 3.0)], "k string, c string, v double")
    got = {r.k: r for r in R.linked_difference(a, b, ["k"], "c", "v", draws=60).collect()}
    assert set(got) == {"x", "y"}
    assert (got["x"].n_a, got["x"].n_b, got["x"].clusters, got["x"].difference) == (2, 2, 3, 2.0) and got["x"].low is not None
    assert (got["y"].difference, got["y"].low) == (-2.0, None)


def test_components_that_hold_the_label_are_found(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        y = i % 3
        # The label lies in the direction of least variance: few components miss it.
        x = [rng.normal(0, 5), rng.normal(0, 4), rng.normal(0, 3), y + rng.normal(0, 0.1)]
        rows.append((i % 4, y, [float(v) for v in x]))
    frame = spark.createDataFrame(rows + [(None, 1, [0.0] * 4), (1, None, [0.0] * 4)], "fold int, label int, embedding array<double>")
    got = {r.k: r for r in K.label_by_components(frame, [1, 3, 4, 9], ridge=1e-4).collect()}
    assert set(got) == {1, 3, 4, None}
    assert got[4].kappa > 0.9 and got[None].kappa > 0.9 and abs(got[3].kappa) < 0.2 and got[3].n == 300
    assert got[1].cum_var < got[3].cum_var < got[4].cum_var <= 1.000001 and got[None].cum_var is None and abs(got[1].modal_share - 1 / 3) < 1e-6
    assert K.label_by_components(frame.where("fold = 1"), [1]).count() == 0


def test_probes_are_kept_and_read_again(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, [float(v) for v in rng.normal(0, 0.3, 3) + np.eye(3)[i % 3]]) for i in range(150)]
    frame, layout = spark.createDataFrame(rows + [(900, None, None), (901, None, [1.0])], "vec_id long, label int, embedding array<double>"), P.layout_digest(["a", "b", "c"])
    model = P.fit_probe(frame, "v1", layout)
    path = f"{tmp_path}/probes"
    P.save_probe(model, path)
    P.save_probe(P.fit_probe(frame.where("vec_id < 60"), "v2", layout), path)
    with pytest.raises(ValueError):
        P.save_probe(model, path)
    there = spark.newSession()
    again = P.load_probe(there, path, "v1")
    here = {r.vec_id: (r.predicted, r.probability, r.abstained) for r in P.predict(frame, model, layout, floors={0: 0.99}).collect()}
    kept = {r.vec_id: (r.predicted, r.probability, r.abstained) for r in P.predict(frame, again, layout, floors={0: 0.99}).collect()}
    assert here == kept and here[900] == here[901] == (None, None, None)
    assert np.mean([here[i][0] == y for i, y, _ in rows]) > 0.9 and any(a for p, _, a in here.values() if p == 0) and not any(a for p, _, a in here.values() if p == 1)
    assert P.load_probe(there, path).first()["version"] == "v2"
    with pytest.raises(ValueError):
        P.predict(frame, again, P.layout_digest(["a", "c", "b"]))
    assert {r.predicted for r in P.classify(frame, model, layout, floors={0: 2.0, 1: 2.0, 2: 2.0}).collect()} == {None}


def test_anchors_and_stores(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 0.0]), ("d", None), ("e", [-1.0, 0.0])], "segment_id string, vector array<double>")
    got = [(r.anchor_id, r.segment_id, r.weight) for r in N.anchor_edges([("x", [2.0, 0.0]), ("zero", [0.0, 0.0])], rows, 2).orderBy("anchor_id", "weight", ascending=[True, False]).collect()]
    assert got == [("x", "a", 1.0), ("x", "b", round(math.sqrt(0.5), 6)), ("zero", "a", 0.0), ("zero", "b", 0.0)]
    motifs = Q.clusters(rows.withColumnRenamed("segment_id", "from_id"), 3).withColumn("to_id", F.lit("z"))
    M.write_block_motifs(motifs, f"{tmp_path}/m")
    assert M.read_block_motifs(spark, f"{tmp_path}/m").count() == 4
    rows.write.parquet(f"{tmp_path}/other")
    assert M.read_block_motifs(spark, f"{tmp_path}/other").count() == 0
    pred = "segment_id string, predicted int, confidence double"
    M.write_heldout(spark.createDataFrame([("a", 1, 0.98765), ("b", 2, None)], pred), spark.createDataFrame([("b", 4, 0.5), ("c", 0, 1.0)], pred), f"{tmp_path}/h")
    assert sorted(tuple(r) for r in M.read_heldout(spark, f"{tmp_path}/h").collect()) == [("a", 1, 0.9877, None, None), ("b", 2, None, 4, 0.5), ("c", None, None, 0, 1.0)]


def test_clusters_find_planted_ones(spark):
    rng = np.random.default_rng(7)
    rows = [(f"r{i}", [float(v) for v in rng.normal(0, 0.05, 2) + 4 * (i % 2)]) for i in range(40)]
    got = {r.from_id: r.motif for r in Q.clusters(spark.createDataFrame(rows, "from_id string, vector array<double>"), 2, 6).collect()}
    assert len({got[f"r{i}"] for i in range(0, 40, 2)}) == len({got[f"r{i}"] for i in range(1, 40, 2)}) == 1 and len(set(got.values())) <= 2
    assert Q.clusters(spark.createDataFrame([], "from_id string, vector array<double>"), 2).count() == 0
