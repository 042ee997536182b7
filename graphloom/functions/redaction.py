"""Redaction of secrets in text and attributes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Attribute keys (searched, any case) whose values are hidden whole.
SENSITIVE_KEYS = [
    "^password$", "passwd", "^pwd$", "secret", "private[-_]?key", "token", "^jwt$", "api[-_]?key", "auth(?:orization)?", "bearer", "cookie", "session[-_]?(?:id|token)?$",
    "email", "phone", "mobile", "telephone", "cell", "customer[-_]?id", "client[-_]?id", "user[-_]?id", "account[-_]?(?:number|id)", "ssn", "social[-_]?security", "tax[-_]?id",
    "card[-_]?(?:number|no)", "credit[-_]?card", "debit[-_]?card", "cvv|cvc", "pan[-_]?number", "address", "street", "zip[-_]?code|postal[-_]?code", "billing[-_]?address", "dob|birth[-_]?date|date[-_]?of[-_]?birth",
]
#: Secrets inside text, in order: (pattern, any case, replacement).
SENSITIVE_VALUES = [
    (r"\beyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\b", False, "[REDACTED_JWT]"),
    (r"Bearer\s+[A-Za-z0-9\-._~+/]+=*", True, "Bearer [REDACTED_TOKEN]"),
    (r"((?:password|token|secret|api_key|access_token|refresh_token|auth)=)([^\s&]+)", True, "$1[REDACTED]"),
    (r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{36,}\b", False, "[REDACTED_GITHUB_TOKEN]"),
    (r"\bsk-[a-zA-Z0-9]{20,}\b", False, "[REDACTED_API_KEY]"),
    (r"\bAKIA[0-9A-Z]{16}\b", False, "[REDACTED_AWS_KEY]"),
    (r"\b(?:sk_live|pk_live)_[0-9a-zA-Z]{24,}\b", False, "[REDACTED_STRIPE_KEY]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,7}\b", False, "[REDACTED_EMAIL]"),
    (r"\b(?:\d{4}[ -]?){3}\d{4}\b", False, "[REDACTED_CARD]"),
    (r"\b\d{15,16}\b", False, "[REDACTED_CARD]"),
    (r"(?:\+\d{1,3}[-.\s]*)?(?:\(?\d{2,4}\)?[-.\s]*)?\d{3,4}[-.\s]*\d{4}\b", False, "[REDACTED_PHONE]"),
]
KEY_PATTERN = "(?i)" + "|".join(f"(?:{k})" for k in SENSITIVE_KEYS)


def redacted_text(text: Column) -> Column:
    """RUN-02: text with typed tags in place of secrets; null stays null."""
    for pattern, any_case, tag in SENSITIVE_VALUES:
        text = F.regexp_replace(text, F.lit(("(?i)" if any_case else "") + pattern), F.lit(tag))
    return text


def redacted_map(attributes: Column) -> Column:
    """RUN-01: values of sensitive keys hidden, secrets in other values tagged."""
    return F.transform_values(attributes, lambda k, v: F.when(k.rlike(KEY_PATTERN), F.lit("[REDACTED]")).otherwise(redacted_text(v)))
