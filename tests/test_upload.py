from pyspark.sql import functions as F

from tallyloom.functions.tokens import token
from tallyloom.plans.upload import guess_mapping, match_rate, match_upload


def test_headers():
    got = guess_mapping(["Father Name", "Beneficiary Name", "DOB", "Aadhaar No", "Village", "Block"])
    assert got == {"name": "Beneficiary Name", "rel_name": "Father Name", "dob": "DOB", "aadhaar": "Aadhaar No", "panchayat": "Village", "block": "Block"}
    assert guess_mapping(["नाम", "पिता का नाम", "आयु", "खाता संख्या", "Village"]) == {"name": "नाम", "rel_name": "पिता का नाम", "age": "आयु", "account": "खाता संख्या", "panchayat": "Village"}
    assert guess_mapping(["x", ""]) == {}


def test_rows_match_by_number_then_by_name_and_place(spark):
    std = spark.createDataFrame([(5, "123412341234", "kml", "kanas", 1950), (3, None, "kml", "kanas", 1951), (4, None, "rm", "kanas", None)], "unique_id long, a string, skel_first string, panchayat_key string, birth_year long")
    std = std.withColumn("aadhaar_token", token(F.col("a"), b"k"))
    rows = [("Kamla Devi", "01-02-1953", "1234 1234 1234", "KANAS"), ("Kamla", "1953", "", "Kanas"), ("Kamla", "1990", None, "Kanas"), ("Ram", None, None, "kanas"), (None, None, None, None), ("Ram", "1976", None, "elsewhere")]
    up = spark.createDataFrame(rows, "`Member Name` string, DOB string, `Aadhaar No` string, Village string")
    got = match_upload(up, std, "unique_id", b"k")
    assert sorted((r["Member Name"] or "", r["DOB"] or "", r["matched"], r["via"]) for r in got.collect() if r["matched"]) == [
        ("Kamla", "1953", 3, "name and place"), ("Kamla Devi", "01-02-1953", 5, "aadhaar"), ("Ram", "", 4, "name and place"),
    ]
    assert tuple(match_rate(got).first()) == (6, 3, 0.5)
    assert match_upload(up.limit(0), std, "unique_id", b"k").count() == 0
