"""Types by category, severity, regulation and preset. Fixed values, and look-ups as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = {
    "contact": "EMAIL PHONE PHONE_RU CHINA_MOBILE",
    "person": "PERSON ADDRESS POSTAL_CODE GEO_COORD",
    "government_id": (
        "INN SNILS PASSPORT_RU DRIVER_LICENSE_RU OGRN OGRNIP KPP US_SSN US_EIN UK_NINO US_ITIN US_PASSPORT AADHAAR PAN_IN CHINA_ID "
        "CODICE_FISCALE FR_NIR DNI_ES NIE_ES PESEL DE_TAX_ID CPF_BR CNPJ_BR SIN_CA TFN_AU MYNUMBER_JP RRN_KR CURP_MX VIN"
    ),
    "financial": "CREDIT_CARD IBAN BANK_ACCOUNT BIC ABA_ROUTING UK_SORT_CODE",
    "health": "OMS_POLICY NHS_UK",
    "crypto": "ETH_ADDRESS BTC_ADDRESS TRON_ADDRESS SOLANA_ADDRESS",
    "network": "IP MAC AWS_ARN",
    "secret": (
        "AWS_ACCESS_KEY AWS_SECRET_KEY ANTHROPIC_KEY OPENAI_KEY GITHUB_TOKEN GITLAB_TOKEN HF_TOKEN NPM_TOKEN GOOGLE_OAUTH_SECRET DO_TOKEN "
        "SHOPIFY_TOKEN SQUARE_TOKEN GOOGLE_API_KEY SLACK_TOKEN STRIPE_KEY SENDGRID_KEY TWILIO_SID MAILGUN_KEY TELEGRAM_BOT_TOKEN "
        "DISCORD_TOKEN SSH_PUBKEY JWT PRIVATE_KEY PASSWORD SECRET URL_CREDENTIALS STRIPE_WEBHOOK VAULT_TOKEN DOPPLER_TOKEN "
        "PLANETSCALE_TOKEN LINEAR_TOKEN"
    ),
}
CATEGORY_SEVERITY = {
    "contact": "medium", "person": "medium", "government_id": "high", "financial": "high",
    "health": "high", "crypto": "high", "network": "low", "secret": "critical",
}
TYPE_SEVERITY = {"CREDIT_CARD": "critical"}
SEVERITIES = ("low", "medium", "high", "critical")
REGULATIONS = {
    "GDPR": "contact person government_id financial health network crypto",
    "HIPAA": "health person contact government_id financial network",
    "PCI-DSS": "financial",
    "CCPA": "contact person government_id financial network",
}
PRESETS = {
    "pci-dss": {"categories": "financial secret"},
    "hipaa": {"categories": "health person government_id contact"},
    "gdpr": {"categories": "contact person government_id financial health crypto"},
    "secrets-only": {"categories": "secret"},
    "ru-gov": {"types": "INN SNILS PASSPORT_RU OGRN OGRNIP KPP BIC BANK_ACCOUNT OMS_POLICY DRIVER_LICENSE_RU"},
    "minimal": {"min_confidence": 0.9},
}

CATEGORY_OF = {t: c for c, ts in CATEGORIES.items() for t in ts.split()}


def category_of(type_: str) -> str:
    return CATEGORY_OF.get(type_, "other")


def severity_of(type_: str) -> str:
    return TYPE_SEVERITY.get(type_) or CATEGORY_SEVERITY.get(category_of(type_), "medium")


def severity_rank(severity: str) -> int:
    """Place from 0 up; -1 for a name that is none, which then filters nothing."""
    return SEVERITIES.index(severity) if severity in SEVERITIES else -1


def regulations_for(type_: str) -> list[str]:
    return sorted(r for r, cs in REGULATIONS.items() if category_of(type_) in cs.split())


def types_in(categories) -> set[str]:
    return {t for c in categories for t in CATEGORIES.get(c, "").split()}


def resolve_preset(name: str) -> tuple[set[str] | None, float | None]:
    """(types or None, least confidence or None); an unknown name is a ValueError."""
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; there are {', '.join(sorted(PRESETS))}")
    spec = PRESETS[name]
    types = types_in(spec.get("categories", "").split()) | set(spec.get("types", "").split())
    return types or None, spec.get("min_confidence")


def taxonomy_frame(spark: SparkSession) -> DataFrame:
    """type, category, severity, severity_rank: one row a known type, a few dozen in all."""
    rows = [(t, c, severity_of(t), severity_rank(severity_of(t))) for t, c in CATEGORY_OF.items()]
    return spark.createDataFrame(rows, "type string, category string, severity string, severity_rank int")


def regulations_frame(spark: SparkSession) -> DataFrame:
    """regulation, category."""
    return spark.createDataFrame([(r, c) for r, cs in REGULATIONS.items() for c in cs.split()], "regulation string, category string")


def with_taxonomy(findings: DataFrame) -> DataFrame:
    """Findings with category, severity and severity_rank; unknown types are other and medium."""
    out = findings.join(F.broadcast(taxonomy_frame(findings.sparkSession)), "type", "left")
    return out.withColumns({
        "category": F.coalesce("category", F.lit("other")),
        "severity": F.coalesce("severity", F.lit("medium")),
        "severity_rank": F.coalesce("severity_rank", F.lit(1)),
    })


def classify(findings: DataFrame, *keys: str) -> DataFrame:
    """Regulations that the findings touch, with their types sorted, by ``keys``."""
    rules = F.broadcast(regulations_frame(findings.sparkSession))
    rows = with_taxonomy(findings.select(*keys, "type").distinct()).join(rules, "category")
    return rows.groupBy(*keys, "regulation").agg(F.sort_array(F.collect_set("type")).alias("types"))
