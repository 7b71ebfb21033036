"""Repeated keys in batches, record hashes, table streams, training pairs."""

import random

import pytest
from pyspark.sql import functions as F

from linkwright.operators import changes, linkage, model, pairs
from linkwright.session import ensure_checkpoint_dir
from linkwright.streaming import streams

from .oracles import jaro_winkler


def test_replace_rows_takes_the_last_change_per_key(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    ch = spark.createDataFrame([(1, "x", 1), (1, "z", 3), (1, "y", 2), (9, "q", 1)], "id long, v string, s int")
    new, report = changes.replace_rows(base, ch, "id", seq_col="s")
    assert sorted(map(tuple, new.collect())) == [(1, "z"), (2, "b")]
    assert sorted(map(tuple, report.collect())) == [(1, True), (9, False)]
    again, _ = changes.replace_rows(base, ch.drop("s"), "id")
    assert sorted(map(tuple, again.collect())) == [(1, "z"), (2, "b")]


def test_patch_rows_needs_an_order_for_ties(spark):
    base = spark.createDataFrame([(1, "a")], "atom_id long, v string")
    ch = spark.createDataFrame([(1, {"v": "x"}), (1, {"v": "y"})], "atom_id long, change map<string,string>")
    with pytest.raises(ValueError, match="seq_col"):
        changes.patch_rows(base, ch)


def test_insert_rows_dense_keys_follow_the_order(spark):
    base = spark.createDataFrame([(7, "a")], "atom_id long, v string")
    new = spark.createDataFrame([(None, f"n{i:03d}", i) for i in range(200)][::-1], "atom_id long, v string, pos long")
    got = {r.v: r.atom_id for r in changes.insert_rows(base, new.repartition(7), order_col="pos").collect()}
    assert got["a"] == 7 and all(got[f"n{i:03d}"] == 8 + i for i in range(200))


def test_geocode_lookup_keeps_one_row_per_input(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id long, address string")
    p1 = spark.createDataFrame([("x", 5.0, 6.0), ("x", 1.0, 2.0), ("y", None, None)], "a string, latitude double, longitude double")
    p2 = spark.createDataFrame([("y", 3.0, 4.0)], "a string, latitude double, longitude double")
    got = sorted((r.id, r.latitude, r.longitude, r.geocoder) for r in linkage.geocode_lookup(df, [p1, p2]).collect())
    assert got == [(1, 1.0, 2.0, "provider_1"), (2, 3.0, 4.0, "provider_2")]


def test_record_hash_tells_names_and_addresses_apart(spark):
    rows = [(None, None, "1 A St", "OAK HOSP"), (None, None, "1 A St", "OTHER CLIN"), ("", "", "1 A St", "OAK HOSP"),
            ("7", None, "1 A St", "OAK HOSP"), ("7", None, "1 A St", "NEW NAME"), (None, "7", "1 A St", "OAK HOSP"),
            (None, None, None, "1 A St")]
    df = spark.createDataFrame(rows, "id string, auth_id string, address string, name string")
    h = [(r.record_hash, r.content_hash) for r in linkage.record_hash(df).collect()]
    assert h[0][0] != h[1][0] and h[0] == h[2] and h[3][0] == h[4][0] and h[3][1] != h[4][1]
    assert len({h[0][0], h[3][0], h[5][0], h[6][0]}) == 4


def test_table_stream_reads_folders_and_files(spark, tmp_path):
    df = spark.range(150).withColumn("v", F.col("id") * 2)
    df.repartition(3).write.parquet(str(tmp_path / "d" / "t.parquet"))
    one = df.coalesce(1)
    one.write.parquet(str(tmp_path / "tmp"))
    (tmp_path / "f").mkdir()
    next((tmp_path / "tmp").glob("part-*")).rename(tmp_path / "f" / "t.parquet")
    for where in ("d", "f"):
        out = tmp_path / f"out-{where}"
        q = (streams.read_table_stream(spark, str(tmp_path / where), "t.parquet", df.schema, 1).writeStream
             .format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / f"ck-{where}"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
        assert spark.read.parquet(str(out)).count() == 150


def test_checkpoint_folder_must_be_named_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_training_pairs_keep_both_classes(spark):
    bases = spark.createDataFrame([(f"A{i}", f"{i} Main Street, Apt {i}, Boston, MA 0{i:04d}") for i in range(1500)], "id string, address string")
    for n in (100, 3000):
        got = model.make_training_pairs(bases, n=n).collect()
        pos = [r for r in got if r.is_match == 1]
        assert len(got) == n and len(pos) == n // 4
        assert all(r.id2.startswith("V" + r.id1[1:] + "-") for r in pos)
        assert all(r.id1.lstrip("AV").split("-")[0] != r.id2.lstrip("AV") for r in got if r.is_match == 0)
    again = model.make_training_pairs(bases.repartition(5), n=100).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, model.make_training_pairs(bases, n=100).collect()))


def test_hot_key_is_dealt_into_a_grid(spark):
    left = spark.range(600).select("id", F.array(F.when(F.col("id") < 200, "hot").otherwise(F.col("id").cast("string"))).alias("keys"))
    right = spark.range(300).select("id", F.array(F.when(F.col("id") < 100, "hot").otherwise(F.col("id").cast("string"))).alias("keys"))
    out = pairs.keyed_pairs(left, right, key_rows=20)
    assert out.count() == 200 * 100 + 100
    assert out.select("l_id", "r_id").distinct().count() == out.count()


def test_exact_joins_below_the_blocking_thresholds(spark):
    rnd = random.Random(4)
    streets = ["Oak St", "Pine Rd", "Elm Ave", "Maple Ln"]
    mk = lambda k: [(i, f"{rnd.randint(1, 30)} {rnd.choice(streets)}, Boston, MA 0{rnd.randint(2100, 2104)}") for i in range(k)]
    L = spark.createDataFrame(mk(12), "id long, address string")
    R = spark.createDataFrame(mk(15), "id long, address string")
    both = L.withColumnRenamed("id", "l").withColumnRenamed("address", "a").join(
        R.withColumnRenamed("id", "r").withColumnRenamed("address", "b"), F.lit(True))
    from linkwright.functions import similarity as S
    scored = both.select("l", "r", S.address_similarity_v1(F.col("a"), F.col("b")).alias("s1"),
                         S.address_similarity_v2(F.col("a"), F.col("b")).alias("s2")).collect()
    for t, col, fn in ((0.4, "s1", pairs.best_match), (0.6, "s2", pairs.link_addresses)):
        want = {}
        for r in sorted(scored, key=lambda r: (-r[col], r.r)):
            if r[col] > t and r.l not in want:
                want[r.l] = r.r
        out = fn(L, R, t).collect()
        assert {r[0]: r[2] for r in out} == want
    assert jaro_winkler("a", "a") == 1.0


def test_nothing_stays_persisted(spark):
    from linkwright.plans import fixtures as X
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    sf = "/root/testdata/sf0.001"
    pairs.best_match(X.left_addresses(spark, sf), X.right_addresses(spark, sf)).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_record_positions_do_not_collide_across_files(spark, tmp_path):
    from linkwright.sources import records
    (tmp_path / "r.json").mkdir()
    (tmp_path / "r.json" / "a.json").write_text('[{"k": "a0"}, {"k": "a1"}]')
    (tmp_path / "r.json" / "b.json").write_text('[{"k": "b0"}]')
    got = [r.record["k"] for r in records.read_records_json(spark, str(tmp_path / "r.json")).orderBy("pos").collect()]
    assert got == ["a0", "a1", "b0"]
