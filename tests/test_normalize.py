"""Field normalization against the golden sample files (typed in here)."""

import json

from pyspark.sql import functions as F

from linkwright.operators import fields
from linkwright.sources import records as R

SAMPLE_JSON = [
    {"FName": "Alice", "Surname": "Smith", "Email_Address": "alice@example.com"},
    {"first": "Bob", "Last_Name": "Johnson", "e-mail": "bob@example.com",
     "Extra_Field": "should be ignored"},
    {"fname": "Charlie", "first": "ShouldNotOverride", "surname": "Brown",
     "email": "charlie@example.com"},
    {"username": "delta", "phone_number": "123-456-7890", "city": "New York"},
]
OUTPUT_JSON = [
    {"first_name": "Alice", "last_name": "Smith", "email": "alice@example.com"},
    {"first_name": "Bob", "last_name": "Johnson", "email": "bob@example.com"},
    {"first_name": "Charlie", "last_name": "Brown", "email": "charlie@example.com"},
    {"first_name": None, "last_name": None, "email": None},
]
SAMPLE_CSV = ("FName,Surname,Email_Address,Extra_Field\n"
              "Alice,Smith,alice@example.com,\n"
              "Bob,Johnson,bob@example.com,should be ignored\n"
              "Charlie,Brown,charlie@example.com,\n"
              'delta,,,"New York"\n')


def test_json_golden(spark, tmp_path):
    p = tmp_path / "records.json"
    p.write_text(json.dumps(SAMPLE_JSON, indent=2))
    recs = R.read_records(spark, str(p))
    out = fields.normalize_fields(recs).orderBy("pos").collect()
    assert [{k: r[k] for k in ("first_name", "last_name", "email")} for r in out] == OUTPUT_JSON
    audit = out[2].audit
    assert [(m.source_field, m.action) for m in audit.matched] == [
        ("fname", "mapped"), ("first", "skipped (already set)"), ("surname", "mapped"),
        ("email", "mapped")]
    assert [u.source_field for u in out[1].audit.unmatched] == ["Extra_Field"]
    keys = R.read_records(spark, str(p)).orderBy("pos").select(F.map_keys("record")).first()[0]
    assert keys == ["FName", "Surname", "Email_Address"]  # document order kept


def test_csv_golden(spark, tmp_path):
    p = tmp_path / "records.csv"
    p.write_text(SAMPLE_CSV)
    out = fields.normalize_fields(R.read_records(spark, str(p)), audit=False).orderBy("pos").collect()
    assert [(r.first_name, r.last_name, r.email) for r in out][3] == ("delta", "", "")
    assert [(r.first_name, r.last_name, r.email) for r in out][0] == ("Alice", "Smith", "alice@example.com")


def test_unknown_extension(spark):
    import pytest
    with pytest.raises(ValueError):
        R.read_records(spark, "/nowhere/file.xml")


def test_summary(spark, tmp_path):
    p = tmp_path / "records.json"
    p.write_text(json.dumps(SAMPLE_JSON))
    s = fields.audit_summary(fields.normalize_fields(R.read_records(spark, str(p)))).first()
    assert (s.total_records, s.total_mapped, s.total_skipped, s.total_unmatched) == (4, 9, 1, 4)


def _recs(spark, rows):
    return spark.createDataFrame([(i, list(r.items())) for i, r in enumerate(rows)],
                                 "pos long, e array<struct<key:string,value:string>>") \
        .select("pos", F.map_from_entries("e").alias("record"))


def test_full_normalizer(spark):
    test_records = [
        {"FName": "Alice", "Surname": "Smith", "Email_Address": "alice@EXAMPLE.com"},
        {"first": "Bob", "Last_Name": "Johnson", "e-mail": "bob@example.com",
         "Extra_Field": "should be ignored", "phone": "123-456-7890"},
        {"fname": "Charlie", "first": "ShouldNotOverride", "surname": "Brown",
         "email": "charlie@example.com"},
        {"username": "delta", "phone_number": "(555) 123-4567", "city": "New York"},
    ]
    out = fields.normalize_full(_recs(spark, test_records), "default").orderBy("pos").collect()
    assert out[0].normalized["email"] == "alice@example.com"
    assert out[1].normalized["phone"] == "1234567890"
    assert out[3].normalized == {"phone": "5551234567"}
    assert [e.field for e in out[3].audit.validation_errors] == ["email"]
    assert out[3].audit.defaults_applied == []
    cust = [{"first_name": "Emma", "last_name": "Davis", "email": "emma@example.com",
             "cust_id": "C12345", "tier": "gold"},
            {"first_name": "Frank", "last_name": "Wilson", "email": "frank@example.com",
             "customer_id": "C67890"}]
    c = fields.normalize_full(_recs(spark, cust), "customer").orderBy("pos").collect()
    assert c[0].normalized["customer_id"] == "C12345" and c[0].normalized["loyalty_level"] == "gold"
    assert c[1].normalized["loyalty_level"] == "standard"
    assert [(d.field, d.value) for d in c[1].audit.defaults_applied] == [("loyalty_level", "standard")]
    assert c[0].audit.validation_errors == [] and c[1].audit.validation_errors == []


def test_overwrite_rule(spark):
    rec = [{"email": "", "mail": "B@B.com", "e-mail": "c@c.com"}]
    r = fields.normalize_full(_recs(spark, rec), "default").first()
    acts = [(m.source_field, m.action) for m in r.audit.matched]
    assert acts == [("email", "mapped"), ("mail", "overwritten"), ("e-mail", "skipped (already set)")]
    assert r.normalized["email"] == "b@b.com"
    assert r.audit.matched[2].current_value == "b@b.com"


def test_fuzzy_and_model(spark):
    rec = [{"First Name": "John", "Last": "Doe", "Email Address": "j@d.com",
            "Mailing Address": "1 Main St", "id": "7"}]
    out = fields.normalize_fields_fuzzy(_recs(spark, rec), "default").first()
    # "mailing address" contains "mail" -> email (first target owning a contained alias)
    assert out.email == "1 Main St" and out.first_name == "John"
    m = fields.to_model(_recs(spark, [{"Customer ID": "C1", "Email": "x@y"}]), "customer",
                        required=["customer_id", "email"]).first()
    assert m.customer_id == "C1" and m.membership_level == "Basic" and m.errors == []


def test_json_duplicate_keys_and_nested(spark, tmp_path):
    p = tmp_path / "dup.json"
    p.write_text('[{"a": "1", "b": {"x": 2}, "a": "3", "c": 4.5, "e": null}]')
    r = R.read_records(spark, str(p)).first().record
    # Python's dict: first position, last value; nested values stay JSON text
    assert list(r.items()) == [("a", "3"), ("b", '{"x":2}'), ("c", "4.5"), ("e", None)]


def test_json_lines(spark, tmp_path):
    p = tmp_path / "recs.jsonl"
    p.write_text('{"fname": "A", "email": "a@x"}\n\n{"first": "B"}\n')
    out = fields.normalize_fields(R.read_records(spark, str(p)), audit=False).orderBy("pos").collect()
    assert [(r.first_name, r.email) for r in out] == [("A", "a@x"), ("B", None)]
