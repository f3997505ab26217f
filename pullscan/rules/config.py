"""Rule sets: the shipped configuration, the built-in defaults, loading and validation on the driver.

A rule set holds a handful of rules. Their patterns and limits become literals inside column expressions, so
nothing has to be broadcast.
"""

from __future__ import annotations

import json
import logging
import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from pullscan.functions.pattern import Untranslatable, translate
from pullscan.model import CATEGORIES, SEVERITIES

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class RuleSpec:
    rule_id: str
    name: str
    category: str
    severity: str
    description: str = ""
    enabled: bool = True
    config: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.category not in CATEGORIES:
            raise ValueError(f"unknown category {self.category!r} in rule {self.rule_id}")
        if self.severity not in SEVERITIES:
            raise ValueError(f"unknown severity {self.severity!r} in rule {self.rule_id}")


@dataclass(frozen=True)
class Delegation:
    """Only these fields decide; other thresholds in a configuration are carried but read by nothing."""

    enabled: bool = True
    critical_violation_auto_delegate: bool = True
    violations_per_file_threshold: int = 3


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[RuleSpec, ...]
    delegation: Delegation = Delegation()
    warnings: tuple[str, ...] = ()

    def get(self, rule_id: str) -> RuleSpec:
        return next(r for r in self.rules if r.rule_id == rule_id)

    def only(self, *rule_ids: str) -> "RuleSet":
        return RuleSet(tuple(r for r in self.rules if r.rule_id in rule_ids), self.delegation)


# Limits and patterns of the built-in default rules.
DEFAULT_RULES = (
    RuleSpec("S001", "line_length", "style", "warning", config={"max_length": 120}),
    RuleSpec("S002", "naming_conventions", "style", "warning",
             config={"patterns": {"functions": "snake_case", "classes": "PascalCase"}}),
    RuleSpec("Q001", "function_complexity", "quality", "error", config={"max_cyclomatic_complexity": 10}),
    RuleSpec("Q002", "function_length", "quality", "warning", config={"max_lines": 50}),
    RuleSpec("SEC001", "hardcoded_secrets", "security", "critical",
             config={"patterns": [r"password\s*=", r"api_key\s*=", r"secret\s*="]}),
    RuleSpec("SEC002", "sql_injection", "security", "critical",
             config={"patterns": [r"f['\"]SELECT", r"\.format\(.*\).*SELECT"]}),
    RuleSpec("BP001", "error_handling", "best_practices", "warning",
             config={"checks": {"bare_except": True, "broad_except": True}}),
)
STANDARD_CONFIG = os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(__file__))), "config", "standards.json")


def default_rules() -> RuleSet:
    return RuleSet(DEFAULT_RULES)


def _read(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:  # pragma: no cover
        raise RuntimeError("YAML rule files need the yaml package; use a .json file instead") from e
    return yaml.safe_load(text)


def _bad_pattern(config: dict) -> str | None:
    """The first pattern that is none, or has no form the engine runs, and why. Nothing is run for that."""
    patterns = config.get("patterns", [])
    for p in [*(patterns if isinstance(patterns, list) else []), *config.get("exclude_patterns", [])]:
        try:
            translate(p, ignore_case=True)
        except (re.error, Untranslatable, RecursionError, OverflowError, TypeError) as e:
            return f"{p!r}: {type(e).__name__} {e}"
    return None


def rules_from_dict(config: dict) -> RuleSet:
    """Enabled rules with a known name; a rule with a pattern that does not compile is dropped with a warning."""
    from pullscan.rules.checks import CHECKS

    rules, warnings = [], []
    for r in config.get("rules", []):
        if not r.get("enabled", True):
            continue
        if r["name"] not in CHECKS:
            warnings.append(f"unknown rule {r['name']}")
            continue
        spec = RuleSpec(r["id"], r["name"], r["category"], r["severity"], r.get("description", ""),
                        True, r.get("config") or {})
        bad = _bad_pattern(spec.config)
        if bad:
            warnings.append(f"rule {spec.rule_id} dropped, bad pattern {bad}")
            continue
        rules.append(spec)
    d = config.get("delegation") or {}
    c = d.get("criteria") or {}
    delegation = Delegation(
        d.get("enabled", True),
        c.get("critical_violation_auto_delegate", True),
        c.get("violations_per_file_threshold", 3),
    )
    for w in warnings:
        log.warning(w)
    return RuleSet(tuple(rules), delegation, tuple(warnings))


def standard_config() -> dict:
    """The shipped rule file as it is."""
    return _read(STANDARD_CONFIG)


def load_rules(path: str | None = None) -> RuleSet:
    """Read a rule file (JSON or YAML); a missing file gives the defaults."""
    path = path or STANDARD_CONFIG
    if not os.path.exists(path):
        log.warning("rule file %s not found, using defaults", path)
        return default_rules()
    return rules_from_dict(_read(path))


RULES_SCHEMA = (
    "rule_ord INT, rule_id STRING, rule_name STRING, description STRING, category STRING, severity STRING, "
    "config STRING"
)


def rules_table(spark: SparkSession, rules: RuleSet) -> DataFrame:
    """The rule set as a table: one row per enabled rule, its configuration as JSON."""
    rows = [
        (i, r.rule_id, r.name, r.description, r.category, r.severity, json.dumps(r.config, sort_keys=True))
        for i, r in enumerate(rules.rules)
    ]
    return spark.createDataFrame(rows, RULES_SCHEMA)
