"""Change batches, lookups and searches."""

from pyspark.sql import functions as F

from linkwright.operators import changes as C
from linkwright.operators import filters as FL

BASE = [(1, "A", "SPRINGFIELD", "IL", "LICENSE", "2025-01-01"),
        (2, "Good Health Pharmacy", "METROPOLIS", "NY", "LICENSE", "2025-01-02"),
        (5, "Health Mart 50%", "SPRINGFIELD", "IL", "PERMIT", None)]
SCHEMA = "atom_id long, facility_name string, city string, state string, auth_type string, expire_date string"


def base(spark):
    return spark.createDataFrame(BASE, SCHEMA).withColumn("expire_date", F.to_date("expire_date"))


def test_insert_dense_keys(spark):
    new = spark.createDataFrame([(None, "N1", "X", "Y", "L", "2026-02-03", 3),
                                 (None, "N2", "X", "Y", "L", "bad", 1),
                                 (9, "N3", "X", "Y", "L", None, 2)],
                                SCHEMA + ", o long")
    out = C.insert_rows(base(spark), new, "atom_id", order_col="o").collect()
    got = {r.facility_name: (r.atom_id, r.expire_date) for r in out}
    assert got["N3"][0] == 9
    assert got["N2"][0] == 10 and got["N1"][0] == 11  # after max(9), in 'o' order
    assert str(got["N1"][1]) == "2026-02-03" and got["N2"][1] is None


def test_patch_replace_delete(spark):
    ch = spark.createDataFrame([(2, {"city": "GOTHAM"}, 1), (2, {"city": "METRO", "state": None}, 2),
                                (8, {"city": "NOWHERE"}, 1)], "atom_id long, change map<string,string>, seq int")
    new, rep = C.patch_rows(base(spark), ch, "atom_id", seq_col="seq")
    r2 = new.where("atom_id = 2").first()
    assert (r2.city, r2.state, r2.facility_name) == ("METRO", None, "Good Health Pharmacy")
    assert {(r.atom_id, r.found) for r in rep.collect()} == {(2, True), (8, False)}
    keys = spark.createDataFrame([(1,), (42,)], "k long")
    rem, rep = C.delete_rows(base(spark), keys, "atom_id")
    assert sorted(r.atom_id for r in rem.collect()) == [2, 5]
    assert {(r.atom_id, r.found) for r in rep.collect()} == {(1, True), (42, False)}
    rc = spark.createDataFrame([(5, "Renamed", "OTHER")], "atom_id long, facility_name string, city string")
    new, rep = C.replace_rows(base(spark), rc, "atom_id")
    r5 = new.where("atom_id = 5").first()
    assert (r5.facility_name, r5.city, r5.state) == ("Renamed", "OTHER", "IL")


def test_lookup_and_search(spark):
    b = base(spark)
    lk = {r.atom_id: r.found for r in FL.lookup_by_id(b, [1, 3]).collect()}
    assert lk == {1: True, 3: False}
    assert [r.atom_id for r in FL.search(b, facility_name="health").collect()] == [2, 5]
    assert [r.atom_id for r in FL.search(b, facility_name="", city="SPRINGFIELD", auth_type="PERMIT").collect()] == [5]
    assert FL.search(b).count() == 3
    # ORM-style LIKE lets '%' act as a wildcard; literal mode does not
    assert FL.search(b, facility_name="h%50").count() == 0
    assert FL.search(b, facility_name="h%50", like_wildcards=True).count() == 1
    req = spark.createDataFrame([("r1", "health", None, "IL", None), ("r2", "a", "SPRINGFIELD", None, None),
                                 ("r3", None, None, "NY", "")],
                                "request_id string, facility_name string, city string, state string, auth_type string")
    got = sorted((r.request_id, r.atom_id) for r in FL.search_batch(b, req).collect())
    exp = sorted((rid, x[0]) for rid, nm, city, st, at in
                 [("r1", "health", None, "IL", None), ("r2", "a", "SPRINGFIELD", None, None),
                  ("r3", None, None, "NY", "")]
                 for x in BASE
                 if (not nm or nm.lower() in x[1].lower()) and (not city or city == x[2])
                 and (not st or st == x[3]) and (not at or at == x[4]))
    assert got == exp
    proj = FL.project(b, ["atomId", "facilityName"])
    assert proj.columns == ["atom_id", "facility_name"]


def test_by_city_state(spark):
    b = base(spark)
    assert [r.atom_id for r in FL.by_city(b, "SPRINGFIELD").collect()] == [1, 5]
    assert [r.atom_id for r in FL.by_city(b, "springfield").collect()] == []  # case-sensitive
    assert [r.atom_id for r in FL.by_state(b, "NY").collect()] == [2]


def test_search_batch_term_lengths_vs_brute_force(spark):
    import pytest as _pytest
    b = base(spark)
    reqs = [("t1", "h", None, None, None), ("t2", "Al", None, None, None), ("t3", "mart", None, "IL", None),
            ("t4", "%", None, None, None), ("t5", "zz", None, None, None), ("t6", None, "METROPOLIS", None, None)]
    req = spark.createDataFrame(reqs, "request_id string, facility_name string, city string, state string, auth_type string")
    got = sorted((r.request_id, r.atom_id) for r in FL.search_batch(b, req).collect())
    exp = sorted((rid, x[0]) for rid, nm, city, st, at in reqs for x in BASE
                 if (not nm or nm.lower() in x[1].lower()) and (not city or city == x[2])
                 and (not st or st == x[3]) and (not at or at == x[4]))
    assert got == exp
    everything = spark.createDataFrame([("all", None, None, None, None)], req.schema)
    with _pytest.raises(ValueError):
        FL.search_batch(b, everything)
    assert FL.search_batch(b, everything, allow_match_all=True).count() == len(BASE)


def test_search_batch_of_a_hot_run(spark, monkeypatch):
    """A run of letters that a third of the names hold: dealt into parts, and a
    term is looked up by its rarest run."""
    from linkwright.operators import pairs as P

    monkeypatch.setattr(P, "KEY_ROWS", 10)
    monkeypatch.setattr(P.keyed_pairs, "__defaults__", (*P.keyed_pairs.__defaults__[:-1], 10))
    names = [f"Hospital {i}" if i % 3 == 0 else f"Clinic {i:03d}" for i in range(120)] + [None, "", "ab"]
    rows = [(i, n, "XY"[i % 2], "CT", None) for i, n in enumerate(names)]
    base = spark.createDataFrame(rows, "atom_id long, facility_name string, city string, state string, auth_type string")
    terms = [("q1", "hospital", None), ("q2", "OSP", "X"), ("q3", "c 0", None), ("q4", "b", None), ("q5", None, "Y"), ("q6", "zzz", None)]
    req = spark.createDataFrame([(q, t, c, None, None) for q, t, c in terms],
                                "request_id string, facility_name string, city string, state string, auth_type string")
    got = sorted((r.request_id, r.atom_id) for r in FL.search_batch(base, req).collect())
    want = sorted((q, i) for q, t, c in terms for i, n, city, _, _ in rows
                  if (t is None or n and t.lower() in n.lower()) and (c is None or c == city))
    assert got == want
    grams = {r.term: r.gram for r in FL.rarest_grams(
        spark.createDataFrame([("hospital 33",), ("ab",), ("clinic 1",)], "term string"),
        base.select(F.lower("facility_name").alias("name"))).collect()}
    assert grams["hospital 33"] == " 33" and grams["ab"] == "ab" and grams["clinic 1"] == "c 1"
