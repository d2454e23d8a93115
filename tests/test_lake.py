"""Lake reading, collection, ingestion and streams on small directories."""

import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialsift.operators import idranges as I
from trialsift.operators.scorer import ScoreResult, class_matrix, per_trial, score_batches
from trialsift.plans.specs import PairSpec, PostSelectSpec, RankingSpec, run_specs, split_specs
from trialsift.sources import catalog as C
from trialsift.sources import collect as K
from trialsift.sources import ingest as N
from trialsift.sources import lake as L
from trialsift.streaming import collect as T

CIRCUIT = "code=surface_code_Z,d=5,rounds=5,noisemodel=si1000,p=0.001,xyz=False"


def put(spark, folder, stem, batch, rows, schema):
    path = f"{folder}/{stem}_batch={batch}.parquet"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("lake"))
    run = f"{base}/{CIRCUIT}/decoding_result"
    label = "shot_id long, is_logical_error boolean"
    fg, lin = f"{run}/decoder=BP-LSD,metric=forced_gap_ml", f"{run}/decoder=BP-LSD,metric=linearize_logicalgap"
    put(spark, fg, "metric=forced_gap_ml", 1, [(0, 0.2), (1, 0.8)], "shot_id long, forced_gap_ml double")
    put(spark, fg, "logicalerror", 1, [(0, False), (1, True)], label)
    # A batch without labels is skipped.
    put(spark, fg, "metric=forced_gap_ml", 2, [(0, 0.5)], "shot_id long, forced_gap_ml double")
    put(spark, lin, "metric=linearize_logicalgap", 1, [(0, 1.0), (1, 2.0)], "shot_id long, linearize_logicalgap double")
    put(spark, lin, "logicalerror", 1, [(0, True), (1, False)], label)
    detail = (
        "shot_id long, baseline_logical_error boolean, baseline_correction_weight double, "
        "forced_logical_error boolean, forced_correction_weight double"
    )
    ex = f"{run}/decoder=ILP,metric=logical_gap,get_detail_stat=True"
    put(spark, ex, "metric=logical_gap", 1, [(0, 0.5)], "shot_id long, logical_gap double")
    put(spark, ex, "logicalerror", 1, [(0, False)], label)
    put(spark, ex, "detailed_stats", 1, [(0, False, 1.0, True, 2.0)], detail)
    fd = f"{run}/decoder=BP-LSD,metric=forced_gap_ml,get_detail_stat=True,opts=[1, 2]"
    put(spark, fd, "metric=forced_gap_ml", 1, [(0, 0.75)], "shot_id long, forced_gap_ml double")
    put(spark, fd, "logicalerror", 1, [(0, True)], label)
    put(spark, fd, "detailed_stats", 1, [(0, False, 1.0, True, 2.0, False, 3.0)],
        detail + ", forced_2nd_best_logical_error boolean, forced_2nd_best_correction_weight double")
    os.makedirs(f"{base}/notes/decoding_result/x")
    return base


def test_catalog_and_filters(spark, root):
    cat = C.scan_catalog(spark, root).cache()
    assert cat.select("circuit_dir").distinct().count() == 1
    row = C.prune(cat, metrics=["logical_gap"]).first()
    assert row.circuit["p"] == "0.001" and row.decoder["get_detail_stat"] == "True"
    for circuit, found in [
        ({"d": 5}, True), ({"d": 6}, False), ({"p": 0.001}, True), ({"p": 0.0011}, False),
        ({"ibm_reproduce": False}, True), ({"ibm_reproduce": True}, False), ({"xyz": False}, True),
        ({"noisemodel": "si1000"}, True), ({"missing": 3}, False),
    ]:
        assert C.prune(cat, circuit).isEmpty() != found, circuit
    assert C.resolve_one(cat, {"d": 5, "p": 0.001}).circuit_dir == CIRCUIT
    with pytest.raises(FileNotFoundError):
        C.resolve_one(cat, {"d": 7})
    with pytest.raises(ValueError):
        C.resolve_one(cat, {"d": 5}, {"decoder": "BP-LSD"})
    assert [r.p for r in C.distinct_params(cat, "p").collect()] == [0.001]
    with pytest.raises(FileNotFoundError):
        C.scan_catalog(spark, root + "/nowhere")


def test_literals_and_names():
    assert [C.literal(x) for x in ("True", "'5'", "0.5", "'Ratio'")] == [True, 5, 0.5, "Ratio"]
    assert C.common_type([1, 2.5]) == "double" and C.common_type([1, "4*d"]) == "string"
    assert C.run_directory_name("A", "m", {"z": 1, "b": "x"}) == "decoder=A,metric=m,b='x',z=1"


def test_query_with_swapped_labels(spark, root):
    cat = C.prune(C.scan_catalog(spark, root), exclude=["get_detail_stat"])
    where = {"circuit": {"d": 5, "p": 0.001}}
    plain = L.read_lake(spark, cat, "forced_gap_ml", **where).orderBy("shot_id").collect()
    assert [(r.forced_gap_ml, r.is_logical_error, r.d, r.batch) for r in plain] == [
        (0.2, False, 5, 1), (0.8, True, 5, 1)]
    swapped = L.read_lake(
        spark, cat, "forced_gap_ml", labels_from="linearize_logicalgap", batches=[1], **where
    )
    with pytest.raises(FileNotFoundError):
        L.read_lake(spark, cat, "forced_gap_ml", labels_from="linearize_logicalgap", **where)
    assert [r.is_logical_error for r in swapped.orderBy("shot_id").collect()] == [True, False]
    with pytest.raises(FileNotFoundError):
        L.read_lake(spark, cat, "cluster_llr")
    with pytest.raises(FileNotFoundError):
        L.read_lake(spark, cat, "forced_gap_ml", extra={"decoder_stat": ["baseline_iteration"]}, **where)


def test_detail_pair(spark, root):
    r = L.read_detail_pair(spark, C.scan_catalog(spark, root)).first()
    assert (r.logical_stage1_weight, r.forced_stage2_2ndbest_weight) == (1.0, 3.0)
    assert r.forced_stage2_2ndbest_obs_flip is False and r.forced_decoder == "BP-LSD"
    spec = RankingSpec(case="all").trials(spark, C.scan_catalog(spark, root)).first()
    assert spec.margin == 0.25 and spec.score_anchored_gap == 1.0


def test_specs(spark, root):
    cat = C.scan_catalog(spark, root)
    spec = PostSelectSpec("forced_gap_ml", mode="unique")
    got = run_specs(spark, cat, [spec, PostSelectSpec("linearize_logicalgap", num_points=2)])
    rows = got.where("spec = 'forced_gap_ml'").orderBy("abort_rate").collect()
    assert [(r.accepted, r.errors) for r in rows] == [(2, 1), (1, 1)]
    assert got.where("spec = 'linearize_logicalgap'").count() == 2
    pair = PairSpec("forced_gap_ml", "linearize_logicalgap", allow_fanout=True).trials(spark, cat)
    assert {"is_logical_error_x", "is_logical_error_y"} <= set(pair.columns)
    assert [s.n_splits for s in split_specs(spec, [2, 3])] == [None, 2, 3]
    for bad in (
        dict(metric="logical_gap", random_split=True, n_splits=2),
        dict(metric="forced_gap_ml", n_splits=2),
        dict(metric="forced_gap_ml", random_split=True),
        dict(metric="forced_gap_ml", second_solution_threshold=-1.0),
        dict(metric="linearize_logicalgap", second_solution_threshold=1.0),
        dict(metric="forced_gap_ml", exact_decoders=["ILP"]),
    ):
        with pytest.raises(ValueError):
            PostSelectSpec(**bad)
    assert L.split_filters(None)["exclude"][-1] == "get_detail_stat"


WIDE = (
    "shot_id long, is_logical_error boolean, metric_forced_gap_ml double, "
    "detail_stat_stage1_obs_flip boolean, detail_stat_stage1_weight double, "
    "detail_stat_stage2_obs_flip boolean, detail_stat_stage2_weight double, "
    "detail_stat_stage2_2ndbest_obs_flip boolean, detail_stat_stage2_2ndbest_weight double, "
    "decoder_stat_baseline_iteration double"
)


def test_collect_and_convert(spark, tmp_path):
    chunks, out = f"{tmp_path}/chunks/batch=3", f"{tmp_path}/out"
    for i in range(2):
        rows = [(i, bool(i), 0.5 + i, True, 1.0, False, 2.0, True, 3.0, 4.0)]
        spark.createDataFrame(rows, WIDE).coalesce(1).write.parquet(f"{chunks}/chunk_{i}.parquet")
    assert K.open_batches(spark, str(tmp_path)) == [3]
    with pytest.raises(ValueError):
        K.collect_chunks(spark, chunks, out, 3, "other")
    assert K.collect_chunks(spark, chunks, out, 3, "forced_gap_ml") == ["forced_gap_ml"]
    detail = spark.read.parquet(f"{out}/detailed_stats_batch=3.parquet")
    assert detail.columns == [
        "shot_id", "baseline_logical_error", "baseline_correction_weight",
        "forced_2nd_best_logical_error", "forced_2nd_best_correction_weight",
        "forced_logical_error", "forced_correction_weight",
    ]
    assert spark.read.parquet(f"{out}/decoder_stat_batch=3.parquet").columns == ["shot_id", "baseline_iteration"]
    assert K.drop_chunks(spark, chunks) == 2
    with pytest.raises(FileNotFoundError):
        K.read_chunks(spark, chunks)
    old = f"{tmp_path}/old"
    put(spark, old, "metric=stage1_weight", 3, [(20, 7.0)], "shot_id long, stage1_weight double")
    put(spark, old, "metric=stage1_obs_flip", 3, [(20, True)], "shot_id long, stage1_obs_flip boolean")
    put(spark, old, "metric=stage2_weight", 3, [(20, 8.0)], "shot_id long, stage2_weight double")
    assert K.convert_legacy(spark, old) == [3] and K.convert_legacy(spark, old) == []
    r = spark.read.parquet(f"{old}/detailed_stats_batch=3.parquet").first()
    assert (r.baseline_correction_weight, r.baseline_logical_error, r.forced_correction_weight) == (7.0, True, 8.0)
    assert os.path.exists(f"{old}/metric=stage1_weight_batch=3.parquet")


def test_compaction(spark, tmp_path):
    for i in range(5):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.parquet(f"{tmp_path}/chunk_{i}.parquet")
    assert K.compact(spark, str(tmp_path), max_files=10) == []
    made = K.compact(spark, str(tmp_path), max_files=3, group=2)
    assert [os.path.basename(p) for p in made] == ["part_000001.parquet", "part_000002.parquet"]
    assert K.next_part_index(spark, str(tmp_path)) == 3
    assert sorted(r.id for r in K.read_chunks(spark, str(tmp_path)).collect()) == list(range(50))
    assert K.merge_group_size(1000, None) == 200 and K.merge_group_size(None, 5) is None


def test_degradation_collector(spark, tmp_path):
    schema = (
        "shot_id long, is_logical_error boolean, metric_baseline_weight double, metric_forced_weight double, "
        "metric_baseline_cluster_llr double, metric_forced_cluster_llr double"
    )
    rows = [(0, False, 1.0, 1.5, 0.1, 0.3), (1, True, 2.0, 3.0, 0.2, 0.4)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/c/chunk_0.parquet")
    names = K.collect_degradation(spark, f"{tmp_path}/c", f"{tmp_path}/out", 1)
    assert names == ["logicalerror", "baseline_weight", "forced_weight", "baseline_cluster_llr", "forced_cluster_llr"]
    bad = spark.createDataFrame(rows, schema).drop("metric_forced_weight")
    with pytest.raises(ValueError):
        K.degradation_table(bad)


def test_manifest(spark, tmp_path):
    doc = {
        "schema_version": 1,
        "ranges": [
            {"shot_id_start": 480000, "shot_id_end": 480512, "num_shots": 512, "batch_id": 1, "dets_path": "a", "reason": "timeout", "message": None},
            {"shot_id_start": 12000, "shot_id_end": 12064, "num_shots": 64, "batch_id": 2, "dets_path": "a", "reason": "error", "message": "x", "attempts": 3},
        ],
        "total_incomplete_shots": 576,
    }
    path = tmp_path / "incomplete_shots.json"
    path.write_text(json.dumps(doc, indent=2))
    ranges = K.read_manifest(spark, str(path), document=True)
    assert K.manifest_totals(ranges).first().total_incomplete_shots == 576
    assert sorted(r.attempts for r in ranges.collect()) == [1, 3]
    K.write_manifest(ranges, f"{tmp_path}/lines")
    again = K.read_manifest(spark, f"{tmp_path}/lines")
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, ranges.collect()), key=str)


def varint(v):
    out = bytearray()
    while True:
        out.append(v & 127 | (128 if v > 127 else 0))
        v >>= 7
        if not v:
            return bytes(out)


def blob(flips):
    flips = sorted(flips)
    steps = np.diff([0, *flips])
    return varint(len(flips)) + b"".join(varint(int(s)) for s in steps)


def test_flip_sets(spark, tmp_path):
    sets = [[], [0], [1, 3], [0, 1, 2, 3], [2], [127], [128], [300], [500, 100, 200]]
    data = struct.pack("<Q", len(sets)) + b"".join(blob(s) for s in sets)
    (tmp_path / "obs_flip_idx_batch=4.bin").write_bytes(data)
    got = N.read_flip_sets(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.flips for r in got] == [sorted(s) for s in sets] and {r.batch for r in got} == {4}
    labels = spark.createDataFrame(
        [(4, 10 * i, i % 2 == 0) for i in range(len(sets))], "batch int, shot_id long, is_logical_error boolean"
    )
    joined = N.join_flip_labels(N.read_flip_sets(spark, str(tmp_path)), labels).orderBy("shot_id").collect()
    assert [r.flips for r in joined] == [sorted(s) for s in sets]
    with pytest.raises(ValueError):
        N.join_flip_labels(N.read_flip_sets(spark, str(tmp_path)), labels.limit(3))
    for bad in (data[:-1], data + b"\x00", b"\x01", struct.pack("<Q", 1) + b"\x80"):
        with pytest.raises(ValueError):
            N.decode_flip_blob(bad)
    assert N.decode_flip_blob(struct.pack("<Q", 0)) == []


def test_flip_sets_are_written_by_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(3000):
        wide = rng.choice([3, 200, 40_000, 2_000_000_000])
        rows.append((int(i % 5) * 7, i, [int(v) for v in rng.integers(0, wide, rng.integers(0, 6))]))
    df = spark.createDataFrame(rows, "batch int, shot_id long, flips array<int>").repartition(6)
    assert N.write_flip_sets(df, f"{tmp_path}/sets") == len(rows)
    got = {(r.batch, r.pos): r.flips for r in N.read_flip_sets(spark, f"{tmp_path}/sets").collect()}
    want = {}
    for batch, _, flips in rows:
        want[batch, sum(b == batch for b, _ in want)] = sorted(set(flips))
    assert got == want
    assert not [f for f in (tmp_path / "sets").iterdir() if f.name.endswith(".part")]
    assert N.write_flip_sets(df.limit(0), f"{tmp_path}/none") == 0


def test_keys_stay_whole_when_a_join_turns_out_small(spark, tmp_path):
    rows = spark.range(4000, numPartitions=7).select(
        (F.col("id") % 5).alias("batch"), F.col("id").alias("shot_id"), F.array(F.col("id")).alias("flips")
    )
    rows.write.parquet(f"{tmp_path}/rows")
    rows, conf = spark.read.parquet(f"{tmp_path}/rows"), "spark.sql.adaptive."
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    spark.conf.set(f"{conf}autoBroadcastJoinThreshold", "10KB")
    spark.conf.set(f"{conf}coalescePartitions.enabled", "false")
    try:
        assert N.write_flip_sets(rows, f"{tmp_path}/sets") == 4000
    finally:
        spark.conf.set(threshold, before)
        spark.conf.unset(f"{conf}autoBroadcastJoinThreshold")
        spark.conf.unset(f"{conf}coalescePartitions.enabled")
    got = {(r.batch, r.pos): r.flips for r in N.read_flip_sets(spark, f"{tmp_path}/sets").collect()}
    assert got == {(i % 5, i // 5): [i] for i in range(4000)}


def test_bit_shots_of_many_files(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [
        (i // 300, i, [int(d) for d in np.flatnonzero(rng.random(17) < 0.3)], [bool(v) for v in rng.random(3) < 0.5])
        for i in range(2000)
    ]
    df = spark.createDataFrame(rows, "file long, shot_id long, detectors array<int>, observables array<boolean>")
    path = f"{tmp_path}/a,b [c]"
    assert N.write_bit_shots(df.repartition(5), path, 17, 3) == len(rows)
    found = N.read_bit_shots(spark, f"{tmp_path}/a,b \\[c\\]/part=*.b8", 17, 3).collect()
    got = {(int(r.file.rpartition("part=")[2][:-3]), r.shot_id): (r.detectors, r.observables) for r in found}
    assert got == {(f, i % 300): (d, o) for f, i, d, o in rows}
    bad = spark.createDataFrame([(0, 0, [17], [True] * 3)], df.schema)
    with pytest.raises(Exception, match="outside the record"):
        N.write_bit_shots(bad, f"{tmp_path}/bad", 17, 3)


def test_bit_shots(spark, tmp_path):
    rng = np.random.default_rng(0)
    bits = rng.random((1000, 13)) < 0.3
    (tmp_path / "shots.b8").write_bytes(np.packbits(bits, axis=1, bitorder="little").tobytes())
    df = N.read_bit_shots(spark, f"{tmp_path}/shots.b8", 11, 2, offset=5)
    got = df.orderBy("shot_id").collect()
    assert [r.shot_id for r in got] == list(range(5, 1005))
    for r, row in zip(got, bits):
        assert r.detectors == list(np.flatnonzero(row[:11])) and r.observables == list(row[11:])
    dense = df.select(N.dense_bits("detectors", 11).alias("d")).first().d
    assert dense == list(bits[0][:11]) or len(dense) == 11
    (tmp_path / "bad.b8").write_bytes(b"\x00" * 3)
    with pytest.raises(ValueError):
        N.read_bit_shots(spark, f"{tmp_path}/bad.b8", 11, 2)


def test_streams(spark, tmp_path):
    schema = "batch int, shot_id long, is_logical_error boolean, metric_m double"
    rows = [(b, i, i % 3 == 0, float(i)) for b in (1, 2) for i in range(30)]
    for k in range(3):
        part = rows[k * 20 : (k + 1) * 20 + 5]  # five trials arrive twice
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/chunk_{k}.parquet")

    def run():
        stream = T.read_chunk_stream(spark, f"{tmp_path}/in", schema, max_files=1)
        T.stream_collect(stream, f"{tmp_path}/out", f"{tmp_path}/cp", "m").awaitTermination(120)
        return T.read_collected(spark, f"{tmp_path}/out", "metric=m")

    assert run().count() == 60
    spark.createDataFrame([(3, 0, True, 1.0)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/chunk_9.parquet")
    assert run().count() == 61


def test_scorer(spark):
    class Model:
        def score(self, bits):
            return ScoreResult(
                bits[:, :1], {"m": bits.sum(axis=1), "__private": 1}, flips=[[1, 0]] * len(bits)
            )

    df = spark.createDataFrame(
        [(1, i, [bool(i % 2), True], [i % 3 == 0]) for i in range(12)],
        "batch int, shot_id long, detectors array<boolean>, observables array<boolean>",
    )
    out = score_batches(
        df, Model, "batch int, shot_id long, is_logical_error boolean, metric_m long, obs_flip_idx array<int>",
        model_key="test",
    ).orderBy("shot_id").collect()
    assert [r.is_logical_error for r in out] == [bool(i % 2) != (i % 3 == 0) for i in range(12)]
    assert out[1].metric_m == 2 and out[0].obs_flip_idx == [0, 1]
    assert per_trial({"a": 1.0, "__b": 2}, 3, "p_")["p_a"].tolist() == [1.0] * 3
    with pytest.raises(ValueError):
        per_trial({"a": [1, 2]}, 3, "p_")
    with pytest.raises(ValueError):
        class_matrix(np.zeros(3), 3, 2)
    assert class_matrix(True, 3, 1).shape == (3, 1)


def test_ranges_against_brute_force(spark):
    rng = np.random.default_rng(2)
    ids = np.unique(rng.integers(0, 400, 250)).tolist()
    df = spark.createDataFrame([(i,) for i in ids + ids[:50]], "i long")
    got = sorted(map(tuple, I.covered_ranges(df, "i", block=16).collect()))
    assert got == sorted(map(tuple, I.covered_ranges(df, "i", block=4, fan=1 << 12).collect()))
    shifted = df.select((F.col("i") * 1 - 230).alias("i"))
    assert [(a - 230, b - 230) for a, b in got] == sorted(
        map(tuple, I.covered_ranges(shifted, "i", block=2, fan=1 << 20).collect())
    )
    want, start = [], None
    for i in range(402):
        if i in ids and start is None:
            start = i
        if i not in ids and start is not None:
            want.append((start, i))
            start = None
    assert got == want
    ranges = I.covered_ranges(df, "i", block=16)
    free = sorted(map(tuple, I.uncovered_ranges(ranges, 20, 500, block=32).collect()))
    missing = sorted(set(range(20, 520)) - set(ids))
    assert [i for a, b in free for i in range(a, b)] == missing
    empty = I.uncovered_ranges(ranges.where("false"), 5, 10).collect()
    assert [tuple(r) for r in empty] == [(5, 15)]


def test_batches():
    assert I.batch_sizes(10, 4) == [3, 3, 2, 2]
    with pytest.raises(ValueError):
        I.batch_sizes(2, 3)


def test_older_detail_layout(spark, tmp_path):
    run = f"{tmp_path}/{CIRCUIT}/decoding_result/decoder=X,metric=forced_gap_ml,get_detail_stat=True"
    label = "shot_id long, is_logical_error boolean"
    for batch in (1, 2):
        put(spark, run, "metric=forced_gap_ml", batch, [(0, 0.5), (1, 1.5)], "shot_id long, forced_gap_ml double")
        put(spark, run, "logicalerror", batch, [(0, False), (1, True)], label)
    put(spark, run, "metric=stage1_weight", 1, [(0, 1.0), (1, 2.0)], "shot_id long, stage1_weight double")
    put(spark, run, "metric=stage1_obs_flip", 1, [(0, True), (1, False)], "shot_id long, stage1_obs_flip boolean")
    put(spark, run, "metric=stage2_weight", 1, [(0, 3.0), (1, 4.0)], "shot_id long, stage2_weight double")
    put(spark, run, "metric=stage2_obs_flip", 1, [(0, True), (1, True)], "shot_id long, stage2_obs_flip boolean")
    put(spark, run, "detailed_stats", 2, [(0, False, 5.0, True, 6.0), (1, True, 7.0, False, 8.0)],
        "shot_id long, baseline_logical_error boolean, baseline_correction_weight double, "
        "forced_logical_error boolean, forced_correction_weight double")
    df = L.read_detail(spark, C.scan_catalog(spark, str(tmp_path)), "forced_gap_ml", "forced")
    got = {(r.batch, r.shot_id): (r.forced_stage1_weight, r.forced_stage2_weight, r.forced_stage1_obs_flip)
           for r in df.collect()}
    assert got == {(1, 0): (1.0, 3.0, True), (1, 1): (2.0, 4.0, False),
                   (2, 0): (5.0, 6.0, False), (2, 1): (7.0, 8.0, True)}


def test_summaries(spark, tmp_path):
    rows = [(10, "ok", 2.0, None), (5, "skipped", 0.0, None), (7, "boom", 1.0, "timeout")]
    tasks = spark.createDataFrame(rows, "num_shots long, status string, duration_s double, reason string")
    r = K.run_summary(tasks).first()
    assert (r.executed_shots, r.skipped_shots, r.error_shots, r.timeouts, r.total_shots) == (10, 5, 7, 1, 22)
    assert r.avg_time_per_shot_s == 0.2
    K.write_summary(K.run_summary(tasks), K.summary_path(str(tmp_path), 3), {"filters": {"d": 5}})
    back = spark.read.json(K.summary_path(str(tmp_path), 3)).first()
    assert back.executed_shots == 10 and json.loads(back.filters) == {"d": 5}
    K.write_partitioned(spark.range(4).withColumn("d", F.col("id") % 2), f"{tmp_path}/p", ["d"])
    assert spark.read.parquet(f"{tmp_path}/p").where("d = 1").count() == 2
