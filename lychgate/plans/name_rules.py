"""Column-name rules: what a column's name says of its content. The first rule that matches wins."""

from __future__ import annotations

from decimal import Decimal

# Synonyms, entity, category and weight, in order of priority.
NAME_RULES: tuple[tuple[tuple[str, ...], str | None, str, Decimal], ...] = (
    (("email", "e_mail", "mail_address"), "EMAIL_ADDRESS", "PII_DIRECT", Decimal("0.45")),
    (("nric", "fin_no", "uin"), "SG_NRIC", "PII_DIRECT", Decimal("0.45")),
    (("hkid",), "HK_HKID", "PII_DIRECT", Decimal("0.45")),
    (("mynumber", "my_number", "kojin_bango"), "JP_MY_NUMBER", "PII_DIRECT", Decimal("0.45")),
    (("tfn", "tax_file"), "AU_TFN", "PII_DIRECT", Decimal("0.45")),
    (("medicare",), "AU_MEDICARE", "PII_DIRECT", Decimal("0.45")),
    (("ssn", "social_security"), "US_SSN", "PII_DIRECT", Decimal("0.45")),
    (("passport",), "PASSPORT", "PII_DIRECT", Decimal("0.45")),
    (("credit_card", "card_number", "card_no", "pan"), "CREDIT_CARD", "PII_DIRECT", Decimal("0.45")),
    (("iban", "account_number", "account_no", "acct_no"), "IBAN", "PII_DIRECT", Decimal("0.4")),
    (("phone", "mobile", "msisdn", "telephone", "contact_no", "handphone"), "PHONE_NUMBER", "PII_DIRECT", Decimal("0.4")),
    (("name", "first_name", "last_name", "surname", "given_name", "full_name", "customer_name", "shimei"), "PERSON_NAME", "PII_DIRECT", Decimal("0.35")),
    (("address", "street", "addr", "jusho", "residential"), "ADDRESS", "PII_DIRECT", Decimal("0.35")),
    (("dob", "date_of_birth", "birth_date", "birthdate", "birthday", "seinengappi"), "DATE_OF_BIRTH", "PII_QUASI", Decimal("0.4")),
    (("customer_id", "user_id", "member_id", "cust_id", "client_id", "employee_id"), "GENERIC_ID", "PII_QUASI", Decimal("0.25")),
    (("postcode", "postal_code", "zip", "zipcode"), None, "PII_QUASI", Decimal("0.3")),
    (("gender", "sex"), None, "PII_QUASI", Decimal("0.3")),
    (("nationality", "citizenship", "country_of_birth"), None, "PII_QUASI", Decimal("0.3")),
    (("age", "birth_year"), None, "PII_QUASI", Decimal("0.25")),
    (("ip_address", "ip_addr", "client_ip"), "IP_ADDRESS", "PII_QUASI", Decimal("0.35")),
    (("salary", "income", "remuneration", "wage"), None, "SENSITIVE", Decimal("0.4")),
    (("health", "diagnosis", "medical", "disease", "icd", "health_condition", "medical_condition"), None, "SENSITIVE", Decimal("0.45")),
    (("religion", "religious"), None, "SENSITIVE", Decimal("0.45")),
    (("ethnicity", "race"), None, "SENSITIVE", Decimal("0.45")),
    (("union", "political"), None, "SENSITIVE", Decimal("0.35")),
    (("biometric", "fingerprint"), None, "SENSITIVE", Decimal("0.45")),
)

# What to do with a column of each category.
ACTIONS = {
    "PII_DIRECT": "tokenize or mask before any cloud egress",
    "PII_QUASI": "generalise/bucket (k-anonymity) before analytics egress",
    "SENSITIVE": "block by default; requires explicit DPO approval",
    "NON_PII": "allow",
}

# Labels that identify a person directly.
DIRECT_IDENTIFIERS = (
    "EMAIL_ADDRESS", "CREDIT_CARD", "IBAN", "SG_NRIC", "HK_HKID", "JP_MY_NUMBER",
    "AU_TFN", "AU_MEDICARE", "US_SSN", "PASSPORT", "PERSON_NAME",
)
