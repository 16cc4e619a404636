"""Type names, scores, column-name candidates and detection patterns.

The patterns use no look-around, ``\\b`` or possessive quantifiers, so the Java and
RE2 engines find the same matches.  Quantifiers over single classes are open; those over
groups have bounds beyond any real value, which keeps the Java engine away from deep
recursion.  A match that begins with a run of one class can only begin where that run does,
or right behind the match before; ``fast`` forms say so, and long runs cost one attempt.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values ---------------------------------------------------------------

STANDARD_TYPES = (
    "PERSON", "EMAIL", "PHONE", "IP", "DOMAIN", "URL", "ORG", "LOC", "COMPANY", "CREDIT_CARD",
)
REDACT_ONLY_TYPES = ("AMOUNT", "IBAN_CODE", "MAC_ADDRESS")

PROTECTED_STRICT = frozenset({"PERSON", "EMAIL", "COMPANY", "ORG", "CREDIT_CARD"})
PROTECTED_RELAXED = frozenset({"CREDIT_CARD"})

EMPTY_WORDS = ("nan", "none", "<na>")

ANCHOR_CANDIDATES = (
    "employee_id", "user_id", "userid", "employeeid", "username", "user_name",
    "full_name", "fullname", "name", "employee", "user",
)

SUBJECT_FIELDS = (
    "full_name", "first_name", "last_name", "email", "employee_id", "phone", "credit_card",
)

BATCH_SUFFIXES = (".txt", ".docx", ".pdf", ".eml", ".msg", ".csv", ".json", ".xlsx", ".xls")

MAIL_HEADERS = ("From", "To", "Cc", "Bcc", "Reply-To", "Subject")

CARD_MASK_DEFAULTS = {"keep_first": 6, "keep_last": 4, "fill_char": "X"}
MASK_DEFAULTS = {"PERSON": {}, "CREDIT_CARD": {}}

# ---- choices of this library ------------------------------------------------------

SCORES = {
    "EMAIL": "1.00", "CREDIT_CARD": "1.00", "IBAN_CODE": "1.00",
    "COMPANY": "0.99",
    "ROSTER": "0.95",
    "PERSON": "0.85", "ORG": "0.85", "LOC": "0.85", "AMOUNT": "0.85",
    "IP": "0.60", "URL": "0.60", "MAC_ADDRESS": "0.60",
    "DOMAIN": "0.50",
    "PHONE": "0.40",
}

# Endings a domain may have unless ``Settings.domain_suffixes`` names others.
TOP_LEVEL_DOMAINS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "co", "ai",
    "app", "dev", "eu", "uk", "us", "ca", "de", "fr", "es", "it", "nl", "ch", "at",
    "be", "jp", "cn", "in", "br", "au",
)

# ---- patterns -------------------------------------------------------------------



def run_start(letters: str) -> str:
    """Java only: the place is not inside a run of *letters*, or the last match ends here."""
    return rf"(?:\G|(?<![{letters}]))"


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = (
    r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"
    r"|\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}"
)
IP_RUN = r"[0-9]+(?:\.[0-9]+){1,300}"
IP_VALID = (
    r"^(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    r"(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
)
# A token with colons; what is an address is decided by its groups.  It must not end in a full stop
# or a single colon, which belong to the sentence.
IP6_RUN = r"[0-9A-Za-z_]*:[0-9A-Za-z_:.]*(?:::|[0-9A-Za-z_])"
IP6_GROUPS = r"^[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*$"
IP6_TAIL = r"^(?:[0-9A-Fa-f]{1,4}:)*" + IP_VALID[1:]
# A name has 127 labels at most.
DOMAIN_RUN = r"(?:[A-Za-z0-9-]+\.){1,126}[A-Za-z]{2,}"
DOMAIN_VALID = r"\.(?:" + "|".join(TOP_LEVEL_DOMAINS) + r")$"
URL = r"(?:https?|ftp)://[^ \t\r\n<>\"']*[A-Za-z0-9/_=&#%~-]"
CARD_RUN = (
    r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}"
    r"|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}"
)
IBAN_RUN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
MAC = r"[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}"
_NUMBER = r"[0-9]+(?:[.,][0-9]{2,3}){0,300}"
_AMOUNT_BEFORE = r"(?:[$€£¥]|(?:USD|EUR|GBP|JPY|CHF) ?)" + _NUMBER + r"(?: ?(?:thousand|million|billion))?"
_AMOUNT_BEHIND = _NUMBER + r" ?(?:€|USD|EUR|GBP|JPY|CHF|dollars|euros|pounds)"
AMOUNT = f"{_AMOUNT_BEFORE}|{_AMOUNT_BEHIND}"
# White space in the Unicode sense; the engines' own shorthand covers ASCII only.
SPACE = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
TOKEN = r"\[[^\[\]" + SPACE + r"]+\]"


# Two characters that hardly occur in plain prose.
PAIR = "[0-9.][0-9A-Za-z]"


@dataclass(frozen=True)
class PatternRule:
    """One pattern recogniser.

    ``hint`` is a literal and ``guard`` a cheap pattern that every match must contain:
    searching for them first spares the costly pattern on most texts.  ``check`` names a
    validator in :mod:`veilmark.functions.spans` applied to each candidate.  ``pair`` says
    that every match contains a match of :data:`PAIR`, so one search serves several rules.
    ``fast`` is a Java form of ``pattern`` with the same matches.
    """

    etype: str
    pattern: str
    score: str
    hint: str | None = None
    guard: str | None = None
    check: str | None = None
    pair: bool = False
    fast: str | None = None


_RULES = (
    PatternRule("EMAIL", EMAIL, SCORES["EMAIL"], hint="@", fast=run_start("A-Za-z0-9._%+-") + EMAIL),
    PatternRule("PHONE", PHONE, SCORES["PHONE"], guard="[+0-9][0-9]", pair=True),
    PatternRule("IP", IP_RUN, SCORES["IP"], guard=r"[0-9]\.[0-9]", check="is_ipv4", pair=True,
                fast=run_start("0-9") + IP_RUN),
    PatternRule("IP", IP6_RUN, SCORES["IP"], guard=":[0-9A-Fa-f]{0,4}:", check="is_ipv6",
                fast=run_start("0-9A-Za-z_") + IP6_RUN),
    PatternRule("DOMAIN", DOMAIN_RUN, SCORES["DOMAIN"], guard=r"\.[A-Za-z]{2}", check="is_domain", pair=True,
                fast=run_start("A-Za-z0-9-") + DOMAIN_RUN),
    PatternRule("URL", URL, SCORES["URL"], hint="://"),
    PatternRule("CREDIT_CARD", CARD_RUN, SCORES["CREDIT_CARD"], guard="[0-9]{4}", check="is_card", pair=True),
    PatternRule("IBAN_CODE", IBAN_RUN, SCORES["IBAN_CODE"], guard="[A-Z]{2}[0-9]{2}", check="is_iban", pair=True),
    PatternRule("MAC_ADDRESS", MAC, SCORES["MAC_ADDRESS"], guard="[:-][0-9A-Fa-f]{2}"),
    PatternRule("AMOUNT", AMOUNT, SCORES["AMOUNT"], guard="[0-9]",
                fast=f"{_AMOUNT_BEFORE}|{run_start('0-9')}{_AMOUNT_BEHIND}"),
)

# Not looked for unless asked for: Settings(rules=[SECRET_RULE]).  Keys and passwords made by machines
# spread their characters evenly, words do not.
SECRET_RUN = r"[A-Za-z0-9+/_=-]{20,}"
SECRET_BITS = 3.0
SECRET_RULE = PatternRule("SECRET", SECRET_RUN, "0.70", guard="[0-9][A-Za-z]|[A-Za-z][0-9]", check="is_secret",
                          fast=run_start("A-Za-z0-9+/_=-") + SECRET_RUN)

#: The first rule of each type.
PATTERN_RULES: dict[str, PatternRule] = {}
for _rule in _RULES:
    PATTERN_RULES.setdefault(_rule.etype, _rule)
IPV6_RULE = next(r for r in _RULES if r.check == "is_ipv6")


def rules_of(types) -> list[PatternRule]:
    """All rules that find one of *types*."""
    return [r for r in _RULES if r.etype in types]
