"""Masking of names, numbers and texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BULLET = "•"
# fixed values: identifiers with the digits that stay visible, which are always masked; names and document numbers, which are
# masked until a record is opened
IDS = {"aadhaar": 4, "bank_account": 4, "account": 4, "mobile": 2}
NAMES = (
    "applicant_name", "father_husband_name", "member_name", "head_of_family", "worker_name", "farmer_name", "deceased_name", "name", "father_guardian_name", "pensioner_name",
    "beneficiary_name",
)
DOCUMENTS = ("card_no", "family_id", "job_card_no", "registration_no", "udid_no", "ppo_no", "beneficiary_id", "pension_id", "service_no")
DOCUMENT_KEEP = 3
NULLS = ("None", "nan", "NaN", "<NA>")


def mask_name(c: Column) -> Column:
    """Each word's first character, then bullets: one per further character, two at least."""
    w = F.filter(F.split(c, "\\s+"), lambda x: x != "")
    return F.array_join(F.transform(w, lambda x: F.concat(F.substring(x, 1, 1), F.repeat(F.lit(BULLET), F.greatest(F.lit(2), F.length(x) - 1)))), " ")


def mask_number(c: Column, keep: int = 4) -> Column:
    """Bullets and the last `keep` digits; only bullets where there are no more digits than that; null for null, 'None', 'nan'."""
    d = F.regexp_replace(c, "\\D", "")
    short = F.repeat(F.lit(BULLET), F.length(c))
    return F.when(~c.isin("None", "nan"), F.when(F.length(d) <= keep, short).otherwise(F.concat(F.repeat(F.lit(BULLET), F.length(d) - keep), F.right(d, F.lit(keep)))))


def mask_date(c: Column) -> Column:
    """Only the year of a dd-MM-yyyy date."""
    return F.when(c.isNotNull(), F.concat(F.lit(f"{BULLET * 2}-{BULLET * 2}-"), F.right(c, F.lit(4))))


def mask_digits(c: Column, least: int = 6, keep: int = 3) -> Column:
    """Every run of `least` digits or more in a text keeps its last `keep` ones."""
    part = F.regexp_extract_all(c, F.lit(f"(\\d{{{least},}}|\\d{{1,{least - 1}}}|\\D+)"), 1)
    hide = lambda x: F.when(x.rlike(f"^\\d{{{least},}}$"), F.concat(F.repeat(F.lit(BULLET), F.length(x) - keep), F.right(x, F.lit(keep)))).otherwise(x)
    return F.when(c.isNotNull(), F.array_join(F.transform(part, hide), ""))


def mask_fields(fields: Column, open_: Column) -> Column:
    """A map of field texts masked: identifiers always; names, document numbers and dates of birth unless `open_`. Texts that
    stand for nothing become null; a document number without a digit and an empty date stay as they are; other fields pass."""

    def one(k: Column, v: Column) -> Column:
        v = F.when(~v.isin(*NULLS), v)
        closed = F.when(k.isin(*NAMES), mask_name(v)).when(k.isin(*DOCUMENTS) & v.rlike("\\d"), mask_number(v, DOCUMENT_KEEP)).when((k == "dob") & (v != ""), mask_date(v)).otherwise(v)
        out = F.when(open_, v).otherwise(closed)
        for name, keep in IDS.items():
            out = F.when(k == name, mask_number(v, keep)).otherwise(out)
        return out

    return F.transform_values(fields, one)


def suppress(n: Column, least: int) -> Column:
    """Null for counts from 1 to least - 1."""
    return F.when(~n.between(1, least - 1), n) if least > 1 else n
