"""Include/exclude text rules, folded into one boolean Column."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One line of a filter: ``connector`` joins it to the rule before it."""

    text: str
    action: str = "include"
    connector: str = "and"
    field: str = ""
    case_sensitive: bool = False
    regex: bool = False
    enabled: bool = True
    highlight: bool = True
    color: str = ""


def rules_from_json(document: str) -> list[Rule]:
    """Read a saved rule set.  In the oldest form one case flag stood for all rules."""
    data = json.loads(document)
    shared_case = bool(data.get("caseSensitive", False))
    return [
        Rule(
            text=r.get("text", ""),
            action="exclude" if r.get("action") == "exclude" else "include",
            connector="or" if r.get("connector") == "or" else "and",
            field=r.get("field", ""),
            case_sensitive=shared_case or bool(r.get("caseSensitive", False)),
            regex=bool(r.get("regex", False)),
            enabled=bool(r.get("enabled", True)),
            highlight=bool(r.get("highlight", True)),
            color=r.get("color", ""),
        )
        for r in data.get("rules", [])
    ]


def java_regex(pattern: str, case_sensitive: bool = True) -> str:
    """``(?d)`` makes ``.`` stop at ``\\n`` only, as rule patterns expect."""
    return ("(?d)" if case_sensitive else "(?diu)") + pattern


def regex_is_valid(pattern: str) -> bool:
    """Whether the JVM accepts the pattern; checked before a job starts, not inside it."""
    spark = SparkSession.getActiveSession()
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:
        return False
    return True


def literal_regex(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def contains_literal(scope: Column, text: str, case_sensitive: bool) -> Column:
    if case_sensitive:
        return F.contains(scope, F.lit(text))
    return F.contains(F.lower(scope), F.lower(F.lit(text)))


def usable(rule: Rule) -> bool:
    """A switched-off, empty or unreadable rule is as if it were not in the list."""
    if not rule.enabled or not rule.text:
        return False
    return not rule.regex or regex_is_valid(java_regex(rule.text, rule.case_sensitive))


def rule_condition(rule: Rule, text: Column, fields: dict[str, Column] | None = None) -> Column:
    """Whether a line satisfies one rule.

    With ``fields`` the rule looks at its own field; a line without that field does not contain
    the text, so that an exclude rule lets it pass.
    """
    scope = (fields or {}).get(rule.field, text) if rule.field else text
    if rule.regex:
        found = scope.rlike(java_regex(rule.text, rule.case_sensitive))
    else:
        found = contains_literal(scope, rule.text, rule.case_sensitive)
    if scope is not text:
        found = F.coalesce(found, F.lit(False))
    return ~found if rule.action == "exclude" else found


def rules_to_column(
    rules: list[Rule], text: Column, fields: dict[str, Column] | None = None
) -> Column | None:
    """One condition for a list of rules: AND binds tighter than OR.  ``None`` if no rule is usable."""
    groups: list[list[Column]] = []
    for rule in filter(usable, rules):
        if not groups or rule.connector == "or":
            groups.append([])
        groups[-1].append(rule_condition(rule, text, fields))
    if not groups:
        return None
    return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, g) for g in groups))


def highlight_rules(rules: list[Rule]) -> list[Rule]:
    """The rules whose text is shown as a match: active includes with highlighting on."""
    return [
        replace(r, field="") for r in rules if r.enabled and r.text and r.action == "include" and r.highlight
    ]
