"""Removal of credentials from any log-derived text that leaves the engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logclinic.functions.text import lines

# --- fixed values -----------------------------------------------------------------------------------------
MARK = "[REDACTED]"
SECRET_KEYS = (
    "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|client[_-]?secret"
    "|shared[_-]?access[_-]?key|sas[_-]?key"
)
SECRET_PARAMS = "sig|signature|sv|se|sp|st|sas|token|access_token|key|api_key|apikey|auth"
#: (name, case-insensitive?, pattern, replacement); applied in this order, each to the result of the one before.
RULES: list[tuple[str, bool, str, str]] = [
    ("private key block", False, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", MARK),
    ("authorization header", True, r"\b(authorization|proxy-authorization)\s*:\s*\S+(?:\s+\S+)?", r"\1: " + MARK),
    ("cloud access key id", False, r"\bAKIA[0-9A-Z]{16}\b", MARK),
    ("workspace token", False, r"\bdapi[0-9a-fA-F]{16,}\b", MARK),
    ("bearer token", True, r"\b(bearer|token)\s+([A-Za-z0-9._~+/=-]{8,})", r"\1 " + MARK),
    ("secret assignment", True, rf"\b((?:{SECRET_KEYS})\s*[=:]\s*)(\"[^\"]*\"|'[^']*'|\S+)", r"\1" + MARK),
    ("credentials in address", True, r"\b([a-z][a-z0-9+.-]*://)[^/\s:@]+:[^/\s@]+@", r"\1" + MARK + "@"),
    ("secret query parameter", True, rf"([?&](?:{SECRET_PARAMS})=)[^&\s\"']+", r"\1" + MARK),
]
# ----------------------------------------------------------------------------------------------------------


def _java(pattern: str, ignore_case: bool) -> str:
    white = r"\s\x1c-\x1f"
    pattern = pattern.replace(r"[\s\S]", "\0")
    pattern = pattern.replace(r"\S", f"[^{white}]")
    pattern = pattern.replace(r"[^/\s", f"[^/{white}").replace(r"[^&\s", f"[^&{white}")
    pattern = pattern.replace(r"\s", "\1").replace("\1\\x1c-\\x1f", white).replace("\1", f"[{white}]")
    return ("(?iU)" if ignore_case else "(?U)") + pattern.replace("\0", r"[\s\S]")


def redact(text: Column) -> Column:
    """``text`` with every known kind of secret replaced."""

    def step(current: Column, rule: tuple[str, bool, str, str]) -> Column:
        _, ignore_case, pattern, replacement = rule
        java = replacement.replace(r"\1", "$1")
        return F.regexp_replace(current, _java(pattern, ignore_case), java)

    return reduce(step, RULES, text)


def redact_lines(text: Column, max_line: int = 200) -> Column:
    """Redact and cut line by line, keeping the line structure."""
    return F.array_join(F.transform(lines(text), lambda x: F.substring(redact(x), 1, max_line)), "\n")
