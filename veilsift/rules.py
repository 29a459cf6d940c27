"""The rule table: what credential formats look like, and rules of one's own."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from . import fixed as X

RULE_ID = re.compile(r"^[a-z0-9]+(?:[-_][a-z0-9]+)*$")


@dataclass(frozen=True)
class Rule:
    """One detection rule; pattern is a Java regular expression, value_group the group that holds the credential."""

    rule_id: str
    category: str
    severity: int
    priority: int
    pattern: str
    keywords: tuple[str, ...] = ()
    min_entropy: float | None = None
    exact: bool = True
    base_confidence: int | None = None
    value_group: int = 0
    max_length: int | None = None
    requires_context: bool = False
    suppress_placeholders: bool = True
    placeholders: tuple[str, ...] = ()
    reject_hashes: bool = False
    advice: str = ""
    keep_prefix: int = 0
    keep_suffix: int = 0

    def __post_init__(self) -> None:
        if not RULE_ID.match(self.rule_id):
            raise ValueError(f"not a rule id: {self.rule_id!r}")
        if self.severity not in X.SEVERITIES.values():
            raise ValueError(f"not a severity: {self.severity!r}")
        if self.requires_context and not self.keywords:
            raise ValueError(f"{self.rule_id} asks for context but names no keyword")
        if self.keep_prefix < 0 or self.keep_suffix < 0:
            raise ValueError(f"{self.rule_id} would reveal fewer than no characters")
        if not self.pattern:
            raise ValueError(f"{self.rule_id} has no pattern")

    @property
    def floor(self) -> int:
        return self.base_confidence or (3 if self.exact else 1)

    @property
    def name(self) -> str:
        return self.rule_id.replace("-", " ").capitalize()


# Ids, categories, severities, priorities, patterns, keywords and entropy floors.
_PRIVATE_KEY = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:[\s\S]{0,40000}?-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----)?"
RULES: tuple[Rule, ...] = (
    Rule("aws-access-key-id", "aws", 2, 10, r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", ("aws_access_key_id", "aws_access_key", "access_key_id"), 2.5, advice="Deactivate the key pair and issue a new one."),
    Rule("aws-secret-access-key", "aws", 4, 11, r"\b[A-Za-z0-9/+=]{40}\b", ("aws_secret_access_key", "aws_secret_key", "aws_secret", "secret_access_key"), 3.0, exact=False, requires_context=True, advice="Deactivate the key pair and issue a new one."),
    Rule("openai-api-key", "openai", 3, 20, r"\bsk-proj-[A-Za-z0-9_\-]{20,}|\bsk-svcacct-[A-Za-z0-9_\-]{20,}", ("openai_api_key", "openai_key", "openai", "api_key"), 3.0, advice="Delete the key in the account and create another."),
    Rule("openai-api-key-legacy", "openai", 3, 21, r"\bsk-[A-Za-z0-9]{48}\b", ("openai_api_key", "openai_key", "openai", "api_key"), 3.0, advice="Delete the key in the account and create another."),
    Rule("github-pat-classic", "github", 3, 30, r"\bgh[pou]_[A-Za-z0-9]{36}\b", ("github_token", "github_pat", "gh_token", "github"), 2.5, advice="Revoke the token and create one with fewer scopes."),
    Rule("github-pat-fine-grained", "github", 3, 31, r"\bgithub_pat_[A-Za-z0-9_]{22,}", ("github_token", "github_pat", "gh_token", "github"), 2.5, advice="Revoke the token and create one with fewer scopes."),
    Rule("github-app-token", "github", 2, 32, r"\bgh[sr]_[A-Za-z0-9]{36}\b", ("github_token", "github_app", "gh_token", "github"), 2.5, advice="Let it expire, and look for what wrote it down."),
    Rule("stripe-secret-key-live", "stripe", 4, 40, r"\bsk_live_[A-Za-z0-9]{16,}", ("stripe", "secret_key", "stripe_key"), 2.5, advice="Roll the key at once and read the payment log."),
    Rule("stripe-restricted-key-live", "stripe", 3, 41, r"\brk_live_[A-Za-z0-9]{16,}", ("stripe", "restricted_key", "stripe_key"), 2.5, advice="Roll the key and check what it may do."),
    Rule("stripe-test-key", "stripe", 2, 42, r"\b(?:sk|rk)_test_[A-Za-z0-9]{16,}", ("stripe", "stripe_key", "test_key"), 2.5, suppress_placeholders=False, advice="Roll the test key."),
    Rule("stripe-publishable-key", "stripe", 1, 43, r"\bpk_(?:live|test)_[A-Za-z0-9]{16,}", ("stripe", "publishable_key", "stripe_key"), 2.5, suppress_placeholders=False, advice="Public by design; see that no secret key is beside it."),
    Rule("slack-incoming-webhook", "slack", 2, 50, r"https://hooks\.slack\.com/services/T[A-Za-z0-9]{8,}/B[A-Za-z0-9]{8,}/[A-Za-z0-9]{20,}", ("slack", "webhook", "slack_webhook"), advice="Remove the webhook and add another."),
    Rule("private-key-block", "private_key", 4, 60, _PRIVATE_KEY, advice="Make a new key pair and withdraw the old public key."),
    Rule("database-uri-with-password", "database", 4, 70, r"\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis)://[^\s:/@\[\]]+:([^\s:/@]{4,})@[^\s:/@]+", ("database_url", "db_url", "dsn", "connection_string"), value_group=1, advice="Change the password and read it from the environment."),
)

# What every match of a pattern holds, one of several literals or a cheaper pattern; a text without has no match.
_RUN_OF_40 = r"\A[^\p{Alnum}/+=]*+(?:[\p{Alnum}/+=]{1,39}+[^\p{Alnum}/+=]++)*+[\p{Alnum}/+=]{40}"
_HELD: dict[str, tuple[str, ...] | str] = {
    "aws-access-key-id": ("AKIA", "ASIA"),
    "aws-secret-access-key": _RUN_OF_40,
    "openai-api-key": ("sk-proj-", "sk-svcacct-"),
    "openai-api-key-legacy": ("sk-",),
    "github-pat-classic": ("ghp_", "gho_", "ghu_"),
    "github-pat-fine-grained": ("github_pat_",),
    "github-app-token": ("ghs_", "ghr_"),
    "stripe-secret-key-live": ("sk_live_",),
    "stripe-restricted-key-live": ("rk_live_",),
    "stripe-test-key": ("k_test_",),
    "stripe-publishable-key": ("pk_live_", "pk_test_"),
    "slack-incoming-webhook": ("https://hooks.slack.com/services/T",),
    "private-key-block": ("PRIVATE KEY",),
    "database-uri-with-password": ("://",),
}
#: By pattern, so that a rule of one's own with a known id asks for nothing.
HELD = {r.pattern: _HELD[r.rule_id] for r in RULES}


def _by_table(pattern: str) -> str:
    """The same classes as names: Java asks a range after range for what stands in brackets."""
    for given, name in (("[A-Za-z0-9/+=]", r"[\p{Alnum}/+=]"), (r"[A-Za-z0-9_\-]", r"[\w\-]"), ("[A-Za-z0-9_]", r"\w"), ("[A-Za-z0-9]", r"\p{Alnum}")):
        pattern = pattern.replace(given, name)
    return pattern


#: What Java runs for the patterns above.
RUN = {r.pattern: _by_table(r.pattern) for r in RULES}

TABLE = (
    "rule_id string, category string, severity int, priority int, pattern string, keywords array<string>, min_entropy double, exact boolean, base_confidence int, value_group int, max_length int,"
    " requires_context boolean, suppress_placeholders boolean, placeholders array<string>, reject_hashes boolean, advice string, keep_prefix int, keep_suffix int"
)


def registry(rules: Iterable[Rule] = RULES, *, disabled: Iterable[str] = (), extra: Iterable[Rule] = ()) -> tuple[Rule, ...]:
    """Rules in order of (priority, rule_id). Ids given twice, and disabled ids that are not there, are errors."""
    out: dict[str, Rule] = {}
    for r in (*rules, *extra):
        if r.rule_id in out or r.rule_id == X.ENTROPY_RULE:
            raise ValueError(f"rule id given twice: {r.rule_id}")
        out[r.rule_id] = r
    unknown = sorted(set(disabled) - set(out) - {X.ENTROPY_RULE})
    if unknown:
        raise ValueError(f"no such rule: {', '.join(unknown)}")
    return tuple(sorted((r for r in out.values() if r.rule_id not in set(disabled)), key=lambda r: (r.priority, r.rule_id)))


def rule_table(spark: SparkSession, rules: Iterable[Rule] = RULES) -> DataFrame:
    return spark.createDataFrame([tuple(list(v) if isinstance(v, tuple) else v for v in asdict(r).values()) for r in rules], TABLE)
