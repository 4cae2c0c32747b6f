"""The redaction patterns, in the form of Java's regular expressions, and their Python form."""

from __future__ import annotations

import re

# Labels and patterns that must find what users of the rules expect. `\s`, `\d`,
# `\b` are the Unicode ones: java() sets the flag for that, python() spells white space out.
PHASE1 = (
    ("PRIVATE_KEY", r"(?i)-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    ("AWS_KEY", r"AKIA[0-9A-Z]{16}"),
    ("DB_CONNECTION", r"(?i)(?:mysql|postgres|postgresql|mongodb|redis|amqp)://[^\s\"']+"),
    ("DELIVERY", r"(?:快递单号|运单号|取件码)[：:\s]*[A-Za-z0-9]{6,20}"),
    ("ACCESS_CODE", r"(?:门禁码|门禁密码|开门密码|门锁密码)[：:\s]*[A-Za-z0-9#*]{3,12}"),
)
#: Label, the switch in config.Rules, pattern.
PHASE2 = (
    ("PHONE", "chinese_phone", r"(?<!\d)1[3-9]\d{9}(?!\d)"),
    ("ID", "chinese_id", r"(?<!\d)\d{17}[\dXx](?!\d)"),
    ("EMAIL", "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("IP", "internal_ip", r"(?<!\d)(?:10|172\.(?:1[6-9]|2\d|3[01])|192\.168)(?:\.\d{1,3}){2}(?!\d)"),
    ("CARD", "credit_card", r"(?<!\d)(?:\d[ -]*?){13,19}(?!\d)"),
    ("SECRET", "env_var", r"(?i)(?:[A-Z_][A-Z0-9_]*_(?:KEY|TOKEN|SECRET|PASSWORD)|(?:KEY|TOKEN|SECRET|PASSWORD))[\s=:\"]+[A-Za-z0-9_./+=-]{6,}"),
    ("ADDRESS", "chinese_address", r"(?:北京市|上海市|天津市|重庆市|[一-龥]{2,}省|[一-龥]{2,}市|[一-龥]{2,}区|[一-龥]{2,}县)[一-龥A-Za-z0-9号弄栋单元室路街道巷-]{4,}"),
)
#: What a text must hold, one of these, for the rule to match: a test far cheaper than the pattern.
NEEDS = {
    "PRIVATE_KEY": ("-----",),
    "AWS_KEY": ("AKIA",),
    "DB_CONNECTION": ("://",),
    "DELIVERY": ("快递单号", "运单号", "取件码"),
    "ACCESS_CODE": ("门禁码", "门禁密码", "开门密码", "门锁密码"),
    "EMAIL": ("@",),
}
#: Where a rule begins with a run of signs, only the run's first place can begin a match (or the end of the
#: match before it): held to these, the rule takes time linear in the text. The matches are the same.
RUNS = {"EMAIL": "[A-Za-z0-9._%+-]"}
#: Group 1 is the keyword, group 2 the value.
CONTEXT = (
    ("CARD", r"(?i)(credit\s*card|card\s*(?:number|no\.?))\s+(?:is|are|was|were)(?:\s+(?:in|at|on|of|for))*\s*[\"']?([^\s\"']{4,})[\"']?"),
    ("SSN", r"(?i)(ssn|social\s*security(?:\s*(?:number|no\.?))?)\s+(?:is|are|was|were)\s*[\"']?([^\s\"']{4,})[\"']?"),
    ("PASSWORD", r"(?i)\b(password|passwd|pwd|passcode)\b(?:\s*[:=]\s*|\s+is\s+)[\"']?([^\s\"']{4,})[\"']?"),
    ("API_KEY", r"(?i)\b(api[_\s]?key|access[_\s]?key|secret[_\s]?key)\b\s*[:=]\s*[\"']?([^\s\"']{6,})[\"']?"),
    ("TOKEN", r"(?i)\b((?:auth[_\s]?)?token)\b\s*[:=]\s*[\"']?([^\s\"']{6,})[\"']?"),
    ("TOKEN", r"(?i)\b(bearer)\b\s+[\"']?([^\s\"']{8,})[\"']?"),
)
#: Of these, whatever the case, a text must hold one for a context rule to match.
CONTEXT_WORDS = (r"card\s", r"credit\s", "ssn", "social", "passw", "pwd", "passcode", "key", "token", "bearer")
#: Keyword, label, strict: whether a connector sign must follow.
KEYWORDS = (
    ("密码", "PASSWORD", False),
    ("私钥", "PRIVATE_KEY", True),
    ("取件码", "DELIVERY", False),
    ("验证码", "VERIFICATION", False),
    ("银行卡号", "CARD", True),
    ("身份证号", "ID", True),
)
CONNECTORS = "：:=是为"
DELIMITERS = "，,。;；、)）(（\"'“”‘’"
TAIL = ",;)]}"
NOISE = "`:、，。；：“”‘’"
FENCE = "```"
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def keyword(word: str, strict: bool) -> str:
    """Group 1 the keyword, 2 what connects it, 3 the value, which may be empty.

    Possessive throughout: what one group has read is never given to the next.
    """
    loose = "" if strict else r"|\s++(?=[\s\S])"
    return rf"({word})(\s*+[{CONNECTORS}]\s*+{loose})([^\s{DELIMITERS}]*+)"


def java(pattern: str, run: str | None = None) -> str:
    """The pattern for Java; run: the signs that it begins with, whose first place alone is tried."""
    return "(?U)" + (rf"(?:\G|(?<!{run}))" if run else "") + pattern


def python(pattern: str) -> re.Pattern:
    """The pattern for Python's re, whose `\\s` holds four control characters more."""
    inside, out, i = False, [], 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(_SPACE if inside else f"[{_SPACE}]")
            i += 2
        elif two == r"\S" and inside:
            out.append(r"\S\x1c-\x1f")
            i += 2
        elif two[0] == "\\":
            out.append(two)
            i += 2
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            i += 1
    return re.compile("".join(out))
