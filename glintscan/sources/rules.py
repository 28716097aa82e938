"""Rule sets: YAML or dict in, validated rules and a small rules table out."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from glintscan.sources.tables import inline_table

log = logging.getLogger(__name__)

RULE_SCHEMA = "kind string, category string, term string, weight double, ord int"


@dataclass
class RuleSet:
    threshold: float = 0.0
    marks: list[str] = field(default_factory=list)
    categories: dict[str, tuple[list[str], float]] = field(default_factory=dict)
    structured: dict[str, float] = field(default_factory=dict)
    numbers: list[str] = field(default_factory=list)
    regexes: dict[str, tuple[str, float]] = field(default_factory=dict)
    rejected: list[tuple[str, str, str]] = field(default_factory=list)

    @property
    def keywords(self) -> list[str]:
        """Marks, then category keywords, in config order with repeats."""
        words = list(self.marks)
        for terms, _ in self.categories.values():
            words.extend(terms)
        return words

    def rows(self) -> list[tuple]:
        out: list[tuple] = [("mark", None, t, None) for t in self.marks]
        for category, (terms, weight) in self.categories.items():
            out.extend(("keyword", category, t, weight) for t in terms)
        out.extend(("structured", None, p, w) for p, w in self.structured.items())
        out.extend(("number", None, p, None) for p in self.numbers)
        out.extend(("regex", name, p, w) for name, (p, w) in self.regexes.items())
        return [(*row, i) for i, row in enumerate(out)]

    def table(self, spark: SparkSession) -> DataFrame:
        return inline_table(spark, self.rows(), RULE_SCHEMA)


def java_pattern(pattern: str) -> str:
    """A rule pattern as a Java regex with Unicode character classes."""
    renamed = pattern.replace("(?P<", "(?<")
    renamed = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", renamed)
    return "(?U)" + renamed


def _usable(kind: str, pattern: str, rejected: list) -> bool:
    try:
        compiled = re.compile(pattern)
    except (re.error, TypeError) as problem:
        rejected.append((kind, str(pattern), str(problem)))
        log.error("rule dropped, bad pattern %r: %s", pattern, problem)
        return False
    if compiled.match("") is not None:
        rejected.append((kind, pattern, "matches empty text"))
        log.error("rule dropped, matches empty text: %r", pattern)
        return False
    return True


def rules_from_dict(config: dict) -> RuleSet:
    rejected: list[tuple[str, str, str]] = []
    categories = {
        name: ([str(k) for k in (body.get("keywords") or []) if str(k)], body.get("weight"))
        for name, body in (config.get("sensitive_patterns") or {}).items()
    }
    structured = config.get("structured_patterns") or {}
    regexes = config.get("regex_patterns") or {}
    return RuleSet(
        threshold=float(config.get("threshold") or 0.0),
        marks=[str(m) for m in (config.get("security_marks") or []) if str(m)],
        categories=categories,
        structured={p: w for p, w in structured.items() if _usable("structured", p, rejected)},
        numbers=[
            p for p in (config.get("number_patterns") or []) if _usable("number", p, rejected)
        ],
        regexes={
            name: (body["pattern"], body.get("weight"))
            for name, body in regexes.items()
            if _usable("regex", body["pattern"], rejected)
        },
        rejected=rejected,
    )


def without_bad_patterns(rules: RuleSet, spark: SparkSession) -> RuleSet:
    """Drop, with a log line, the patterns that Spark's regex functions cannot compile."""

    def usable(kind: str, pattern: str) -> bool:
        try:
            spark.sql("SELECT regexp_like('', :p)", {"p": java_pattern(pattern)}).collect()
        except Exception as problem:  # the error class differs with the place it is raised
            rules.rejected.append((kind, pattern, str(problem).splitlines()[0]))
            log.error("rule dropped, pattern does not compile in Java: %r", pattern)
            return False
        return True

    return replace(
        rules,
        structured={p: w for p, w in rules.structured.items() if usable("structured", p)},
        numbers=[p for p in rules.numbers if usable("number", p)],
        regexes={n: pw for n, pw in rules.regexes.items() if usable("regex", pw[0])},
    )


def load_rules(path: str, spark: SparkSession | None = None) -> RuleSet:
    """Read a YAML rule file. With a session, any URI Spark can read works."""
    import yaml

    if spark is None:
        with open(path, encoding="utf-8") as handle:
            text = handle.read()
    else:
        text = spark.read.text(path, wholetext=True).head()[0]
    rules = rules_from_dict(yaml.safe_load(text) or {})
    return without_bad_patterns(rules, spark) if spark else rules
