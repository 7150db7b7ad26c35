"""Category dimensions, label maps, weights and patterns. All tables here are fixed values."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: categories with cumulative sampling weights, in canonical order of the weights
HIPAA_WEIGHTS = [
    ("DATE", 0.35), ("NAME", 0.55), ("GEO_SUBDIVISION", 0.70), ("MRN", 0.74), ("HEALTH_PLAN_ID", 0.77), ("ACCOUNT_NUMBER", 0.80),
    ("PHONE", 0.82), ("FAX", 0.84), ("EMAIL", 0.86), ("SSN", 0.88), ("LICENSE_NUMBER", 0.90), ("VEHICLE_ID", 0.92), ("DEVICE_ID", 0.94),
    ("URL", 0.955), ("IP_ADDRESS", 0.97), ("BIOMETRIC_ID", 0.98), ("FACE_PHOTO_REF", 0.99), ("OTHER_UNIQUE_ID", 1.0),
]
GLBA_WEIGHTS = [
    ("FULL_NAME", 0.18), ("RESIDENTIAL_ADDRESS", 0.33), ("BANK_ACCOUNT_NUMBER", 0.45), ("CREDIT_CARD_PAN", 0.55), ("SSN", 0.62), ("EMAIL", 0.68),
    ("PHONE", 0.74), ("DOB", 0.79), ("BANK_ROUTING_NUMBER", 0.83), ("ACCOUNT_BALANCE", 0.87), ("LOAN_ACCOUNT_ID", 0.90), ("TAX_ID", 0.93),
    ("DRIVER_LICENSE", 0.95), ("CREDIT_SCORE", 0.97), ("CARD_EXPIRATION", 0.985), ("CARD_CVV", 0.995), ("IBAN", 1.0),
]

# fixed values: the order in which reports list categories
HIPAA = "NAME GEO_SUBDIVISION DATE PHONE FAX EMAIL SSN MRN HEALTH_PLAN_ID ACCOUNT_NUMBER LICENSE_NUMBER VEHICLE_ID DEVICE_ID URL IP_ADDRESS BIOMETRIC_ID FACE_PHOTO_REF OTHER_UNIQUE_ID".split()
GLBA = "FULL_NAME RESIDENTIAL_ADDRESS SSN EMAIL PHONE DOB BANK_ACCOUNT_NUMBER BANK_ROUTING_NUMBER CREDIT_CARD_PAN CARD_CVV CARD_EXPIRATION IBAN TAX_ID DRIVER_LICENSE ACCOUNT_BALANCE CREDIT_SCORE LOAN_ACCOUNT_ID".split()

# fixed values: placeholder types to categories; ID and SECRET (for GLBA also URL) are unmapped on purpose
PLACEHOLDER_TO_HIPAA = {"PERSON": "NAME", "EMAIL": "EMAIL", "PHONE": "PHONE", "LOCATION": "GEO_SUBDIVISION", "IBAN": "ACCOUNT_NUMBER", "CC": "ACCOUNT_NUMBER", "SSN": "SSN", "URL": "URL", "DOB": "DATE"}
PLACEHOLDER_TO_GLBA = {"PERSON": "FULL_NAME", "EMAIL": "EMAIL", "PHONE": "PHONE", "LOCATION": "RESIDENTIAL_ADDRESS", "IBAN": "IBAN", "CC": "CREDIT_CARD_PAN", "SSN": "SSN", "DOB": "DOB"}
# fixed values: categories to the placeholder types that the stand-in detector writes; all others are ID
HIPAA_TO_PLACEHOLDER = {"NAME": "PERSON", "GEO_SUBDIVISION": "LOCATION", "DATE": "DOB", "PHONE": "PHONE", "FAX": "PHONE", "EMAIL": "EMAIL", "SSN": "SSN", "ACCOUNT_NUMBER": "IBAN", "URL": "URL"}
SPURIOUS_TYPES = ("PERSON", "LOCATION", "PHONE", "ID")
# fixed values: sensitivity tiers
TIERS = ("HIGH", "MED", "LOW")
TYPE_TO_TIER = {"DOB": "HIGH", "IBAN": "HIGH", "SSN": "HIGH", "CC": "HIGH", "SECRET": "HIGH", "PERSON": "MED", "EMAIL": "MED", "PHONE": "MED", "ADDRESS": "MED", "LOCATION": "LOW", "ID": "LOW", "URL": "LOW"}
# fixed values: labels of replayed training rows
REPLAY_LABELS = {"GIVENNAME": "PERSON", "SURNAME": "PERSON", "CITY": "LOCATION", "STREET": "LOCATION"}
# fixed values: categories that both dimensions have, by name
SHARED_CATEGORIES = [("NAME", "FULL_NAME"), ("EMAIL", "EMAIL"), ("PHONE", "PHONE"), ("SSN", "SSN"), ("DATE", "DOB"), ("GEO_SUBDIVISION", "RESIDENTIAL_ADDRESS")]

# fixed values: context words of the healthcare recognisers
_PLAN = ("plan", "insurance", "policy", "member", "health plan", "subscriber")
_DEVICE = ("device", "implant", "pacemaker", "serial")
_ACCOUNT = ("account", "billing", "patient account")
_LICENSE = ("license", "certification", "credential", "DEA")
_BIOMETRIC = ("biometric", "fingerprint", "iris", "retina", "voice print")
_STUDY = ("study", "trial", "protocol", "subject", "participant")

# fixed values: recogniser patterns as (category, pattern, score, context words)
HEALTH_PATTERNS = [
    ("HEALTH_PLAN_ID", r"\bHP-[A-Z0-9]{5,15}\b", 0.85, _PLAN),
    ("DEVICE_ID", r"\bDEV-[A-Z0-9]{8,20}\b", 0.85, _DEVICE),
    ("ACCOUNT_NUMBER", r"\bACCT-[A-Z0-9]{8,15}\b", 0.85, _ACCOUNT),
    ("LICENSE_NUMBER", r"\bLIC-[A-Z0-9]{6,12}\b", 0.85, _LICENSE),
    ("BIOMETRIC_ID", r"\bBIO-FINGERPRINT-[A-Z0-9]{12,32}\b", 0.90, _BIOMETRIC),
    ("BIOMETRIC_ID", r"\bBIO-[A-Z]+-[A-Z0-9]{8,32}\b", 0.80, _BIOMETRIC),
    ("OTHER_UNIQUE_ID", r"\bSTUDY-[A-Z0-9]{6,12}\b", 0.85, _STUDY),
    ("OTHER_UNIQUE_ID", r"\b[A-Z]{2,5}-[A-Z0-9]{6,16}\b", 0.45, _STUDY),
]
FINANCE_PATTERNS = [
    ("BANK_ROUTING_NUMBER", r"\b\d{9}\b", 0.6, "routing aba transit"),
    ("BANK_ACCOUNT_NUMBER", r"\b\d{8,12}\b", 0.55, "account checking savings"),
    ("CARD_CVV", r"\b\d{3,4}\b", 0.55, "cvv cvc security"),
    ("CARD_EXPIRATION", r"\b(?:0[1-9]|1[0-2])/\d{2}\b", 0.7, "expires expiration exp"),
    ("TAX_ID", r"\b\d{2}-\d{7}\b", 0.65, "tax ein employer"),
    ("TAX_ID", r"\b9\d{2}-\d{2}-\d{4}\b", 0.75, "itin tax"),
    ("DRIVER_LICENSE", r"\bDL-[A-Z0-9]{6,12}\b", 0.95, "license driver"),
    ("ACCOUNT_BALANCE", r"\$[0-9,]+\.\d{2}\b", 0.6, "balance owed amount"),
    ("CREDIT_SCORE", r"\b[3-8]\d{2}\b", 0.55, "score fico credit"),
    ("LOAN_ACCOUNT_ID", r"\bLN-[A-Z0-9]{6,15}\b", 0.95, "loan mortgage"),
]
# patterns of common identifiers in documents
COMMON_PATTERNS = [
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0.9),
    ("IP_ADDRESS", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", 0.8),
    ("CARD", r"\b[0-9]{16}\b", 0.7),
    ("PHONE", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", 0.8),
    ("SECRET", r'token = "[0-9a-f]{40}"', 0.9),
]


def dimension(spark: SparkSession, names: list[str]) -> DataFrame:
    """(category, ordinal) in report order."""
    rows = ", ".join(f"('{n}', {i})" for i, n in enumerate(names))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(category, ordinal)")


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The table's value for a key, null where it has none."""
    return F.create_map(*(F.lit(x) for x in chain(*table.items())))[key]
