"""An uploaded file matched against standard records: headers guessed once, rows matched by two joins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.dates import parse_any
from tallyloom.functions.text import place_key, split_name
from tallyloom.functions.tokens import token
from tallyloom.session import TODAY, keep

# fixed values: words that begin a header of each field, in the order in which fields take their headers
SYNONYMS = {
    "name": ["name", "beneficiary", "applicant", "member", "worker", "farmer", "pensioner", "naam", "नाम"],
    "rel_name": ["father", "husband", "guardian", "पिता", "पति"],
    "dob": ["dob", "birth", "जन्म"],
    "age": ["age", "आयु", "उम्र"],
    "sex": ["gender", "sex", "लिंग"],
    "aadhaar": ["aadhaar", "aadhar", "uid", "आधार"],
    "panchayat": ["panchayat", "village", "gram", "ward", "ग्राम"],
    "block": ["block", "ब्लॉक", "विकासखंड"],
    "account": ["account", "bank", "खाता"],
}


def guess_mapping(headers: list[str]) -> dict[str, str]:
    """field -> header: the first header of which a whole word begins with one of the field's words. A header serves one field,
    and one with a relation's word is never the name."""
    begins = lambda h, field: any(w.startswith(tuple(SYNONYMS[field])) for w in re.findall("[a-z\u0900-\u097f]+", h.lower()))
    out: dict[str, str] = {}
    for field in SYNONYMS:
        free = (h for h in headers if h not in out.values() and begins(h, field) and not (field == "name" and begins(h, "rel_name")))
        if (h := next(free, None)) is not None:
            out[field] = h
    return out


def match_upload(rows: DataFrame, standard: DataFrame, key: str, secret: bytes, mapping: dict[str, str] | None = None) -> DataFrame:
    """rows with `matched` and `via`: the smallest `key` of a standard record with the row's Aadhaar token, else of one with its
    given name's skeleton and place and a birth year at most 2 apart (an unknown year passes); null where there is none.

    Two joins whatever the number of rows; rows keep their number. Headers that weren't found match nothing.
    """
    m = mapping or guess_mapping(rows.columns)
    col = lambda f: F.col(f"`{m[f]}`").cast("string") if f in m else F.lit(None).cast("string")
    born = F.coalesce(F.year(parse_any(col("dob"))), F.regexp_extract(col("dob"), "(\\d{4})", 1).try_cast("int"), F.lit(TODAY.year) - F.trim(col("age")).try_cast("int"))
    x = rows.withColumns({"_n": F.monotonically_increasing_id(), "_t": token(F.regexp_replace(col("aadhaar"), "\\s", ""), secret), "_p": F.nullif(place_key(col("panchayat")), F.lit("")), "_y": born})
    # written once, so that both joins see one numbering
    x = keep(x.withColumn("_s", F.nullif(split_name(F.coalesce(col("name"), F.lit("")))["skel_first"], F.lit(""))), "upload")
    ids = standard.filter("aadhaar_token IS NOT NULL").groupBy(F.col("aadhaar_token").alias("_t")).agg(F.min(key).alias("_a"))
    people = standard.filter("panchayat_key IS NOT NULL AND skel_first IS NOT NULL").groupBy(F.col("skel_first").alias("_s"), F.col("panchayat_key").alias("_p"), F.col("birth_year").alias("_b")).agg(F.min(key).alias("_k"))
    near = x.select("_n", "_s", "_p", "_y").join(people, ["_s", "_p"]).filter("_y IS NULL OR _b IS NULL OR abs(_y - _b) <= 2").groupBy("_n").agg(F.min("_k").alias("_k"))
    y = x.join(ids, "_t", "left").join(near, "_n", "left")
    via = F.when(F.col("_a").isNotNull(), "aadhaar").when(F.col("_k").isNotNull(), "name and place")
    return y.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce("_a", "_k").alias("matched"), via.alias("via"))


def match_rate(matched: DataFrame) -> DataFrame:
    """(rows, matched, rate) of an upload."""
    return matched.agg(F.count("*").alias("rows"), F.count("matched").alias("matched"), F.round(F.count("matched") / F.count("*"), 3).alias("rate"))
