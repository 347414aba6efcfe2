"""Schemas of the four tasks (explicit, never inferred) and their allowed
value sets."""

from __future__ import annotations

from pyspark.sql import types as T

# The 56 PII classes, one nullable string field each.
PII_FIELDS = """ACCOUNTNAME ACCOUNTNUMBER AGE AMOUNT BIC BITCOINADDRESS BUILDINGNUMBER CITY COMPANYNAME COUNTY
CREDITCARDCVV CREDITCARDISSUER CREDITCARDNUMBER CURRENCY CURRENCYCODE CURRENCYNAME CURRENCYSYMBOL DATE DOB EMAIL
ETHEREUMADDRESS EYECOLOR FIRSTNAME GENDER HEIGHT IBAN IP IPV4 IPV6 JOBAREA JOBTITLE JOBTYPE LASTNAME
LITECOINADDRESS MAC MASKEDNUMBER MIDDLENAME NEARBYGPSCOORDINATE ORDINALDIRECTION PASSWORD PHONEIMEI PHONENUMBER
PIN PREFIX SECONDARYADDRESS SEX SSN STATE STREET TIME URL USERAGENT USERNAME VEHICLEVIN VEHICLEVRM ZIPCODE""".split()

PII = T.StructType([T.StructField("record_id", T.LongType())] +
                   [T.StructField(f, T.StringType()) for f in PII_FIELDS])

# The seven entity lists of the financial task.
FINANCIAL_FIELDS = ["Company", "Date", "Location", "Money", "Person", "Product", "Quantity"]
FINANCIAL = T.StructType([T.StructField("record_id", T.LongType())] +
                         [T.StructField(f, T.ArrayType(T.StringType())) for f in FINANCIAL_FIELDS])

INSURANCE_DDL = (
    "record_id BIGINT, "
    "header STRUCT<claim_id: STRING, report_date: STRING, incident_date: STRING, reported_by: STRING, channel: STRING>, "
    "policy_details STRUCT<policy_number: STRING, policyholder_name: STRING, coverage_type: STRING, "
    "effective_date: STRING, expiration_date: STRING>, "
    "insured_objects ARRAY<STRUCT<object_id: STRING, object_type: STRING, make_model: STRING, year: BIGINT, "
    "location_address: STRING, estimated_value: BIGINT>>, "
    "incident_description STRUCT<incident_type: STRING, location_type: STRING, estimated_damage_amount: BIGINT, "
    "police_report_number: STRING>")

_NAME = "STRUCT<family: STRING, given: ARRAY<STRING>, prefix: STRING>"
_ADDR = "STRUCT<line: STRING, city: STRING, state: STRING, postalCode: STRING, country: STRING>"

PATIENT_GOLD_DDL = (
    f"record_id BIGINT, name {_NAME}, age BIGINT, gender STRING, birthDate STRING, phone STRING, email STRING, "
    f"maritalStatus STRING, primaryLanguage STRING, address {_ADDR}, "
    f"practitioner ARRAY<STRUCT<name: {_NAME}, phone: STRING, email: STRING, "
    f"address: STRUCT<line: ARRAY<STRING>, city: STRING, state: STRING, postalCode: STRING, country: STRING>, "
    f"encounter_period: STRUCT<start: STRING, end: STRING>>>, "
    f"allergy STRUCT<substance: ARRAY<STRUCT<category: STRING, name: STRING, manifestation: STRING>>>, "
    f"immunization ARRAY<STRUCT<traits: ARRAY<STRING>, status: STRING, occurrenceDate: STRING>>")

PATIENT_PRED_DDL = (
    f"patient STRUCT<record_id: BIGINT, name: {_NAME}, age: BIGINT, gender: STRING, birthDate: STRING, "
    f"address: {_ADDR}, phone: STRING, email: STRING, maritalStatus: STRING, primaryLanguage: STRING, "
    f"allergy: ARRAY<STRUCT<substance: ARRAY<STRUCT<category: STRING, name: STRING, manifestation: ARRAY<STRING>>>>>>, "
    f"practitioner ARRAY<STRUCT<name: {_NAME}, address: {_ADDR}, phone: STRING, email: STRING>>, "
    f"immunization ARRAY<STRUCT<traits: ARRAY<STRING>, substances: ARRAY<STRING>, status: STRING, "
    f"occurrenceDateTime: STRING>>")

# Allowed sets of the insurance output schema (gold spelling).
INSURANCE_ALLOWED = {
    "header.channel": ["Email", "Phone", "Portal", "In-Person"],
    "policy_details.coverage_type": ["Property", "Auto", "Liability", "Health", "Travel", "Other"],
    "insured_objects.object_type": ["Vehicle", "Building", "Person", "Other"],
    "incident_description.incident_type": [
        "rear_end_collision", "side_impact_collision", "head_on_collision", "parking_lot_collision",
        "house_fire", "kitchen_fire", "electrical_fire", "burst_pipe_flood", "storm_damage", "roof_leak",
        "slip_and_fall", "property_injury", "product_liability", "theft_burglary", "vandalism"],
    "incident_description.location_type": [
        "intersection", "highway", "parking_lot", "driveway", "residential_street", "residence_interior",
        "residence_exterior", "commercial_property", "public_property"],
}
# Identifier spellings named in the insurance field
# descriptions (checked as warnings only; gold holds nulls).
INSURANCE_ID_PATTERNS = {
    "header.claim_id": r"^CLM-[0-9]{6}$",
    "policy_details.policy_number": r"^POL-[0-9]{9}$",
    "insured_objects.object_id": r"^(VIN[0-9]{17}|(PROP|LIAB|OBJ)-[0-9]{6})$",
}
# Marital status codes of the patient schema.
MARITAL_STATUS = ["Married", "Divorced", "Widowed", "NeverMarried"]
