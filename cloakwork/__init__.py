"""cloakwork: find, redact and audit personal data and secrets in text, on Spark."""

__version__ = "0.1.0"
