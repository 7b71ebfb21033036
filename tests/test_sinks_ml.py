"""Sinks, flat normalization helpers and the MLlib utilities."""

import os

from pyspark.sql import functions as F

from linkwright.operators import fields
from linkwright.operators import model as M
from linkwright.sources import records as R

AUDIT_SCHEMA = "timestamp string, mapping_key string, n long"


def test_audit_append_and_read(spark, tmp_path):
    path = str(tmp_path / "audit")
    assert R.read_audit(spark, path, AUDIT_SCHEMA).count() == 0  # absent -> empty
    a = spark.createDataFrame([("t1", "default", 1)], AUDIT_SCHEMA)
    R.append_audit(a, path)
    R.append_audit(a, path)
    assert R.read_audit(spark, path, AUDIT_SCHEMA).count() == 2


def test_write_matches_and_valid(spark, tmp_path):
    m = spark.createDataFrame([("A1", "x", "B1", "y", 0.9)],
                              "address1_id string, address1 string, address2_id string, address2 string, similarity double")
    R.write_matches(m, str(tmp_path / "m"))
    back = spark.read.option("header", True).csv(str(tmp_path / "m"))
    assert back.columns == ["address1_id", "address1", "address2_id", "address2", "similarity"]
    v = spark.createDataFrame([(1, "2025-01-02", [])], "id long, d string, errors array<struct<field:string,error:string>>") \
        .withColumn("d", F.to_date("d"))
    assert R.write_valid(v, str(tmp_path / "v")) is True
    parts = [f for f in os.listdir(tmp_path / "v") if f.endswith(".json")]
    assert '"d":"2025-01-02"' in "".join(open(tmp_path / "v" / f).read() for f in parts)
    bad = v.withColumn("errors", F.array(F.struct(F.lit("f").alias("field"), F.lit("e").alias("error"))))
    assert R.write_valid(bad, str(tmp_path / "none")) is False
    assert not os.path.exists(tmp_path / "none")


def test_flat_helpers(spark):
    df = spark.createDataFrame([(" A@B.COM ", "(555) 123-4567", None, " x ")],
                               "email string, phone string, loyalty string, note string")
    v = fields.normalize_values(df, {"email": "email", "phone": "phone", "note": "strip"}).first()
    assert (v.email, v.phone, v.note) == ("a@b.com", "5551234567", "x")
    d = fields.apply_defaults(df, {"loyalty": "standard"}).first()
    assert d.loyalty == "standard" and [x.field for x in d.defaults_applied] == ["loyalty"]
    c = fields.check_required(df, ["email", "loyalty"]).first()
    assert [e.field for e in c.validation_errors] == ["loyalty"]


def test_audit_long(spark):
    recs = spark.createDataFrame([(0, [("first", "A"), ("x", "1")])],
                                 "pos long, e array<struct<key:string,value:string>>") \
        .select("pos", F.map_from_entries("e").alias("record"))
    rows = fields.audit_long(fields.normalize_fields(recs)).collect()
    assert {(r.source_field, r.action) for r in rows} == {("first", "mapped"), ("x", "unmatched")}


BASES = [("A1", "123 Main Street, Apt 4B, New York, NY 10001"),
         ("A2", "456 Oak Avenue, Suite 202, Los Angeles, CA 90001"),
         ("A3", "789 Pine Road, Chicago, IL 60601"),
         ("A4", "321 Cedar Boulevard, San Francisco, CA 94101"),
         ("A5", "555 Maple Lane, Boston, MA 02101"),
         ("A6", "987 Elm Street, Unit 3C, Miami, FL 33101"),
         ("A7", "654 Birch Drive, Seattle, WA 98101"),
         ("A8", "234 Walnut Court, Apt 7D, Philadelphia, PA 19101"),
         ("A9", "876 Cherry Place, Denver, CO 80201"),
         ("A10", "432 Spruce Way, Apartment 5A, Atlanta, GA 30301"),
         ("A11", "111 River Road, Unit 2B, Nashville, TN 37201"),
         ("A12", "222 Lake Drive, Portland, OR 97201"),
         ("A13", "333 Mountain Avenue, Suite 101, Phoenix, AZ 85001"),
         ("A14", "444 Forest Lane, Apt 9C, Austin, TX 78701"),
         ("A15", "555 Ocean Boulevard, San Diego, CA 92101")]


def test_training_pairs_model_cv_and_persist(spark, tmp_path):
    bases = spark.createDataFrame(BASES, "id string, address string")
    pairs = M.make_training_pairs(bases, n=1000, levels=3, seed=42).persist()
    assert pairs.where("is_match = 1").count() == 45  # every base x 3 levels
    assert pairs.where("is_match = 0").count() > 0
    feats = M.address_pair_features(pairs).persist()
    cols = M.PAIR_FEATURES_13

    def forest(d):
        return M.train_forest(d, cols, "is_match", num_trees=10)

    cv = M.cross_validate(feats, cols, ["id1", "id2"], "is_match", k=3, trainer=forest).collect()
    assert len(cv) == 3 and all(0.0 <= r.accuracy <= 1.0 for r in cv)
    path = str(tmp_path / "model")
    m1 = M.train_forest(feats, cols, "is_match", num_trees=10, path=path)
    m2 = M.train_forest(feats, cols, "is_match", num_trees=10, path=path)  # loaded, not retrained
    s1 = M.score_matches(feats, m1, features=cols).select("score").collect()
    s2 = M.score_matches(feats, M.load_model(path), features=cols).select("score").collect()
    assert s1 == s2 and type(m2).__name__ == "PipelineModel"
    rep = {r["class"]: r for r in M.classification_report(m1.transform(feats), "is_match").collect()}
    assert set(rep) >= {"0", "1", "accuracy", "macro avg", "weighted avg"}
    top = M.feature_importance(m1, cols, 5).collect()
    assert len(top) == 5 and top[0].importance >= top[-1].importance


def test_sinks_validate_once(spark, tmp_path, monkeypatch):
    """The rules run once a row, though three sinks read their result, and not in the scan's one task."""
    from linkwright.operators import validate
    from linkwright.plans import queries as Q

    spark.createDataFrame([(k, k % 25, f"Customer{k}", "BUILDING") for k in range(1, 60)],
                          "c_custkey long, c_nationkey int, c_name string, c_mktsegment string").coalesce(1) \
        .write.parquet(str(tmp_path / "customer.parquet"))
    rows = spark.sparkContext.accumulator(0)
    plain, parts = validate.validate_facilities, []

    @F.udf("boolean")
    def seen(_):
        rows.add(1)
        return True

    def counted(df):
        parts.append(df.rdd.getNumPartitions())
        out = plain(df)
        return out.withColumn("errors", F.when(seen("atom_id"), F.col("errors")))

    monkeypatch.setattr(validate, "validate_facilities", counted)
    out = Q.QUERIES["sink_roundtrips"](spark, str(tmp_path))
    assert rows.value == 59 and parts[0] > 1
    bad = {k for k in range(1, 60) if k % 11 == 0 or k % 13 == 0 or k % 17 == 0 or k % 19 == 0}
    got = {(r.sink, int(r.k)) for r in out.collect()}
    assert got == {("matches", k) for k in range(1, 60) if k % 5} | {
        ("audit" if k in bad else "valid", k) for k in range(1, 60)}
