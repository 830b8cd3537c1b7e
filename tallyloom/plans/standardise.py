"""Registers of different layouts in one standard layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import dates
from tallyloom.functions.text import place_key, script, split_name
from tallyloom.functions.tokens import token
from tallyloom.session import ship

# fixed values: department and source columns of each register's common fields
REGISTERS = {
    "pension": ("Social Welfare", dict(name="applicant_name", rel="father_husband_name", sex="gender", dob="dob", aadhaar="aadhaar", account="bank_account", mobile="mobile", place="gram_panchayat", block="block")),
    "parivar": ("Panchayati Raj", dict(name="member_name", rel="father_husband_name", sex="gender", dob="dob", aadhaar="aadhaar", place="gram_panchayat", block="block", doc="family_id")),
    "ration": ("Food & Civil Supplies", dict(name="member_name", sex="gender", age="member_age", as_on="age_as_on", aadhaar="aadhaar", mobile="mobile", place="village", block="block", doc="card_no")),
    "mgnrega": ("Rural Development", dict(name="worker_name", rel="father_husband_name", sex="gender", age="age", as_on="registered", aadhaar="aadhaar", account="account", place="village", block="block", doc="job_card_no")),
    "kisan": ("Agriculture", dict(name="farmer_name", rel="father_husband_name", sex="gender", dob="dob", aadhaar="aadhaar", account="account", place="village", block="block")),
    "death": ("Health (Civil Registration)", dict(name="deceased_name", rel="father_husband_name", sex="gender", age="age_at_death", as_on="date_of_death", aadhaar="aadhaar", place="village", block="block")),
    "udid": ("Social Justice (UDID)", dict(name="name", rel="father_guardian_name", sex="gender", dob="dob", aadhaar="aadhaar", mobile="mobile", place="village", block="block")),
    "treasury": ("Finance (Treasury)", dict(name="pensioner_name", sex="gender", dob="dob", aadhaar="aadhaar", account="account")),
    "sainik": ("Sainik Kalyan", dict(name="name", sex="gender", dob="dob", aadhaar="aadhaar", account="account", place="village", block="block")),
    "pmay": ("Rural Development (Housing)", dict(name="beneficiary_name", rel="father_husband_name", sex="gender", aadhaar="aadhaar", account="account", place="village", block="block")),
}
SEX = {"M": "M", "F": "F", "पुरुष": "M", "महिला": "F", "पु": "M", "म": "F", "MALE": "M", "FEMALE": "F"}


def sex_code(c: Column) -> Column:
    """M or F for every known spelling, null for others."""
    up = F.upper(c)
    return F.when(up.isin(*[k for k, v in SEX.items() if v == "M"]), "M").when(up.isin(*[k for k, v in SEX.items() if v == "F"]), "F")


def standardise(df: DataFrame, register: str, secret: bytes) -> DataFrame:
    """A register in the standard layout, by one select: names parsed, identifiers replaced by keyed tokens, a field that the
    register doesn't have null."""
    department, cmap = REGISTERS[register]
    text = lambda k: F.col(cmap[k]).cast("string") if k in cmap else F.lit(None).cast("string")
    part = lambda s, k: F.nullif(s[k], F.lit(""))
    b = dates.birth(text("dob") if "dob" in cmap else None, F.col(cmap["age"]) if "age" in cmap else None, F.col(cmap["as_on"]) if "as_on" in cmap else None)
    x = df.withColumns({"_n": split_name(F.coalesce(text("name"), F.lit(""))), "_r": split_name(F.coalesce(text("rel"), F.lit(""))), "_b": b})
    n, r, b = F.col("_n"), F.col("_r"), F.col("_b")
    return x.select(
        "record_id", F.lit(register).alias("register"), F.lit(department).alias("department"), text("name").alias("name"),
        part(n, "first").alias("name_first"), part(n, "middle").alias("name_middle"), part(n, "last").alias("name_last"), part(n, "fold").alias("name_fold"),
        part(n, "skel_first").alias("skel_first"), part(n, "skel_last").alias("skel_last"), part(r, "first").alias("rel_first"), part(r, "skel_first").alias("rel_skel"),
        sex_code(text("sex")).alias("sex"), b["birth_date"].alias("birth_date"), b["birth_year"].alias("birth_year"), b["birth_exact"].alias("birth_exact"), b["age_only"].alias("age_only"),
        token(text("aadhaar"), secret).alias("aadhaar_token"), token(text("account"), secret).alias("account_token"), token(text("mobile"), secret).alias("mobile_token"),
        F.nullif(place_key(text("place")), F.lit("")).alias("panchayat_key"), text("block").alias("block"),
        F.when(text("doc").isNotNull(), F.concat(F.lit(register + ":"), text("doc"))).alias("doc_key"), script(F.coalesce(text("name"), F.lit(""))).alias("script"),
    )


def load_all(spark: SparkSession, folder: str, secret: bytes, registers: list[str] | None = None) -> DataFrame:
    """All registers of a folder in the standard layout; those that aren't there are left out."""
    ship(spark)
    out = None
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for reg in registers or REGISTERS:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{reg}.parquet")
        if path.getFileSystem(conf).exists(path):
            x = standardise(spark.read.parquet(f"{folder}/{reg}.parquet"), reg, secret)
            out = x if out is None else out.unionByName(x)
    if out is None:
        raise FileNotFoundError(f"no register in {folder}")
    return out
