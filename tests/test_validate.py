"""Facility validation on the reference's 8-row fixture (typed in here)."""

from linkwright.operators import validate as V

COLS = ("atom_id long, source string, facility_name string, addr1 string, addr2 string, "
        "city string, state string, zip string, auth_type string, auth_id string, "
        "expire_date string, first_observed string, data_type string, class_of_trade string")
ROWS = [
    (1001, 'SYSTEM_A', 'GOOD HEALTH PHARMACY', '123 MAIN STREET', 'SUITE 100', 'ANYTOWN', 'CA', '12345', 'LICENSE', 'PHY12345', '2025-12-31', '2023-01-15', 'RETAIL', 'INDEPENDENT'),
    (1002, 'SYSTEM_B', 'CITY HOSPITAL PHARMACY', '456 OAK AVENUE', None, 'METROPOLIS', 'NY', '10001', 'LICENSE', 'PHY67890', '2026-06-30', '2023-02-20', 'HOSPITAL', 'IDN'),
    (1003, 'SYSTEM_A', 'CONFIDENTIAL PHARMACY', '789 ELM STREET', 'FLOOR 2', 'SMALLVILLE', 'TX', '77001', 'LICENSE', 'PHY24680', '2024-09-15', '2022-11-30', 'RETAIL', 'CHAIN'),
    (1004, 'SYSTEM_C', 'COMMUNITY HEALTH CENTER', 'PATIENT DELIVERY 101 PINE ROAD', None, 'RIVERSIDE', 'FL', '33101', 'LICENSE', 'PHY13579', '2025-03-22', '2023-03-10', 'CLINIC', 'COMMUNITY'),
    (1005, 'SYSTEM_B', 'DOWNTOWN PHARMACY', '202 MAPLE DRIVE', 'UNIT B', '', 'IL', '60601', 'LICENSE', 'PHY97531', '2024-12-05', '2023-01-05', 'RETAIL', 'INDEPENDENT'),
    (1006, 'SYSTEM_D', 'BLINDED MEDICAL SUPPLIES', '303 CEDAR LANE', None, 'MOUNTAIN VIEW', 'CA', '94043', 'LICENSE', 'SUP24680', '2026-08-15', '2023-04-22', 'DME', 'SUPPLIER'),
    (1007, 'SYSTEM_C', 'GENERAL HOSPITAL PHARMACY', '404 BIRCH STREET', 'ROOM 300', 'LAKESIDE', 'MI', '48001', 'LICENSE', 'PHY36925', '2025-05-30', '2023-02-14', 'HOSPITAL', 'HOSPITAL'),
    (1008, 'SYSTEM_A', 'WOUND CARE SPECIALTY', '505 WALNUT AVENUE', None, 'SEASIDE', 'OR', '97001', 'LICENSE', 'SPE81472', '2024-11-11', '2023-01-30', 'SPECIALTY', 'SPECIALTY'),
]


def test_fixture_outcome(spark):
    v = V.validate_facilities(spark.createDataFrame(ROWS, COLS)).persist()
    valid, invalid = V.split_valid(v)
    assert sorted(r.atom_id for r in valid.collect()) == [1001, 1002, 1007]
    errs = {r.record_index: r.error for r in invalid.collect()}
    assert "CONFIDENTIAL" in errs[1003]
    assert errs[1004].startswith("addr1")
    assert errs[1005] == "city: Field city cannot be empty"
    assert "BLIND" in errs[1006]
    assert "WOUND CARE" in errs[1008]
    s = V.validation_summary(v).first()
    assert (s.total, s.valid, s.invalid, s.errors_facility_name) == (8, 3, 5, 3)


def test_bad_date_and_xx(spark):
    rows = [r for r in ROWS[:1]]
    bad = list(rows[0])
    bad[0], bad[2], bad[11] = 2000, "EXXON STATION", "2023-02-30"
    v = V.validate_facilities(spark.createDataFrame([tuple(bad)], COLS)).first()
    fields = [e.field for e in v.errors]
    assert fields == ["facility_name", "first_observed"]
    assert v.errors[0].error.endswith("XX")


def test_rule_counts(spark):
    v = V.validate_facilities(spark.createDataFrame(ROWS, COLS))
    counts = {r.field: r.n for r in V.validation_rule_counts(v).collect()}
    assert counts == {"facility_name": 3, "addr1": 1, "city": 1}
