"""First-match routing of messages, and contact routing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as _ops
from re import _parser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from gleaner import config
from gleaner.functions import text as X

RULE_SCHEMA = "rule_id string, intent string, priority int, language string, pattern string"


_REPEATS = (_ops.MAX_REPEAT, _ops.MIN_REPEAT, _ops.POSSESSIVE_REPEAT)
#: What a rule may not use: all that looks around or back, or sets flags, since rules run on any visitor's text.
_REFUSED = {_ops.ASSERT: "lookaround", _ops.ASSERT_NOT: "lookaround", _ops.GROUPREF: "back reference", _ops.GROUPREF_EXISTS: "condition", _ops.ATOMIC_GROUP: "special group", _ops.POSSESSIVE_REPEAT: "special group"}


def _nodes(tree, repeated: bool = False) -> Iterator[tuple[object, object, bool, object]]:
    """(kind, value, whether within a repetition, what stands before) of all parts of a parsed pattern."""
    before = None
    for kind, value in tree:
        yield kind, value, repeated, before
        before = (kind, value)
        inner = repeated or kind in _REPEATS
        for part in value if isinstance(value, tuple) else ():
            for own in part if isinstance(part, list) else (part,):
                if isinstance(own, _parser.SubPattern):
                    yield from _nodes(own, inner)


def check_pattern(pattern: str) -> None:
    """ValueError for a pattern that doesn't parse or has what could make matching slow: looked up in its parse tree.

    Refused are lookarounds, back references, conditions, flags and special groups, a repetition within a repetition,
    and two unbounded repetitions of any character beside each other.
    """
    try:
        tree = _parser.parse(pattern)
    except re.error as e:
        raise ValueError(f"no pattern: {e}") from e
    if tree.state.flags & ~int(re.UNICODE) or "\0" in pattern:
        raise ValueError("flags and NUL are not allowed")
    anything = lambda node: node is not None and node[0] in _REPEATS and node[1][1] > 1 and [k for k, _ in node[1][2]] == [_ops.ANY]
    for kind, value, repeated, before in _nodes(tree):
        if kind in _REFUSED:
            raise ValueError(f"a {_REFUSED[kind]} is not allowed")
        if kind is _ops.SUBPATTERN and (value[1] or value[2]):
            raise ValueError("flags are not allowed")
        if kind in _REPEATS and value[1] == _ops.MAXREPEAT and (repeated or (anything((kind, value)) and anything(before))):
            raise ValueError("nested repetition is not allowed")


def route(messages: DataFrame, rules: tuple = config.ROUTING_RULES, text_col: str = "text", language: Column | None = None) -> DataFrame:
    """messages with rule_id and intent of the first enabled rule by (priority, rule_id) whose language and pattern fit.

    Rules are configuration, at most a hundred, so they become one expression and no join is needed.
    Without a match rule_id is null and intent OUT_OF_SCOPE.
    """
    text = X.trim_space(F.col(text_col))
    rule_id, intent = F.lit(None).cast("string"), F.lit("OUT_OF_SCOPE")
    for own_id, own_intent, _, own_language, pattern in sorted(rules, key=lambda r: (r[2], r[0]), reverse=True):
        check_pattern(pattern)
        fits = X.matches(text, pattern)
        if own_language != "all":
            fits = fits & (F.lit(False) if language is None else language == own_language)
        rule_id, intent = F.when(fits, own_id).otherwise(rule_id), F.when(fits, own_intent).otherwise(intent)
    return messages.withColumns({"rule_id": rule_id, "intent": intent})


def route_phrases(messages: DataFrame, rules: tuple = config.PHRASE_RULES, text_col: str = "text", language: Column | None = None) -> DataFrame:
    """Literal phrases between word boundaries; protected actions come before all rules."""
    text = X.collapse_space(F.lower(F.col(text_col)))
    rule_id, intent = F.lit(None).cast("string"), F.lit("information")
    for own_id, own_intent, _, own_language, phrases in sorted(rules, key=lambda r: (r[2], r[0]), reverse=True):
        fits = F.lit(False)
        for phrase in phrases:
            fits = fits | X.has_phrase(text, phrase)
        if own_language != "all":
            fits = fits & (F.lit(False) if language is None else language == own_language)
        rule_id, intent = F.when(fits, own_id).otherwise(rule_id), F.when(fits, own_intent).otherwise(intent)
    protected = X.matches(F.col(text_col), config.PROTECTED_ACTION)
    return messages.withColumns({"rule_id": F.when(protected, None).otherwise(rule_id), "intent": F.when(protected, "action_unavailable").otherwise(intent), "protected": protected})


def public_contacts(contacts: DataFrame) -> DataFrame:
    """Active contacts without what only routing needs."""
    return contacts.where("active").drop("active", "priority", "product_categories", "service_categories", "geographic_regions")


def contacts_without_source(contacts: DataFrame, records: DataFrame) -> DataFrame:
    """Active contacts whose official source isn't an active record's URL; a registry change that leaves one is refused."""
    approved = records.where("source_status = 'active'").select(F.col("canonical_url").alias("official_source_url"))
    return contacts.where("active").join(approved, "official_source_url", "left_anti").select(*contacts.columns)


def find_contact(needs: DataFrame, contacts: DataFrame, aliases: dict[str, tuple[str, ...]], home_region: str = "sweden") -> DataFrame:
    """(need_id, contact_id, alternative_id, ambiguous, reason) for each need (need_id, need, region).

    A category is needed if one of its aliases is in the text. Of active contacts that have a needed category and
    the region or the home region, the most overlap wins, then priority, then id; a tie of the first two is ambiguous.
    """
    low = F.lower("need")
    found = F.array_compact(F.array(*(F.when(_any_in(low, words), F.lit(c)) for c, words in sorted(aliases.items()))))
    asked = needs.select("need_id", found.alias("categories"), F.lower(F.trim(F.coalesce("region", F.lit(home_region)))).alias("region"))
    offered = contacts.where("active").select("contact_id", "priority", "geographic_regions", F.array_union("product_categories", "service_categories").alias("own"))
    keyed = offered.select("*", F.explode("own").alias("category"))
    met = asked.select("*", F.explode("categories").alias("category")).join(keyed, "category")
    met = met.where(F.array_contains("geographic_regions", F.col("region")) | F.array_contains("geographic_regions", home_region))
    counted = met.groupBy("need_id", "contact_id", "priority").agg(F.countDistinct("category").alias("overlap"))
    w = Window.partitionBy("need_id").orderBy(F.desc("overlap"), F.desc("priority"), "contact_id")
    top = counted.withColumns({"n": F.row_number().over(w), "tie": F.rank().over(Window.partitionBy("need_id").orderBy(F.desc("overlap"), F.desc("priority")))})
    tied = top.where("tie = 1").groupBy("need_id").agg(F.max(F.when(F.col("n") == 1, F.col("contact_id"))).alias("contact_id"), F.max(F.when(F.col("n") == 2, F.col("contact_id"))).alias("alternative_id"), (F.count("*") > 1).alias("ambiguous"))
    out = asked.select("need_id").join(tied, "need_id", "left")
    return out.select("need_id", "contact_id", "alternative_id", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), F.when(F.col("contact_id").isNull(), "no_exact_route").otherwise("matched").alias("reason"))


def _any_in(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def rule_faults(rules: DataFrame, most: int = 100) -> DataFrame:
    """(rule_id, fault) of a rule table (RULE_SCHEMA): repeated ids, priorities and languages out of range, patterns that check_pattern refuses, too many.

    Rules are configuration; a pandas function checks their patterns where they are.
    """

    @pandas_udf("string")
    def pattern_fault(patterns: pd.Series) -> pd.Series:
        def fault(p: str | None) -> str | None:
            try:
                check_pattern(p or "")
            except ValueError as e:
                return str(e)
            return None if p else "empty pattern"

        return patterns.map(fault)

    own = rules.select("rule_id", F.when(~F.col("priority").between(1, 1000), "priority out of range").when(~F.col("language").isin("all", "en", "sv"), "unknown language").otherwise(pattern_fault("pattern")).alias("fault"))
    twice = rules.groupBy("rule_id").agg(F.count("*").alias("n")).where("n > 1").select("rule_id", F.lit("repeated id").alias("fault"))
    many = rules.agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.lit(None).cast("string").alias("rule_id"), F.lit("too many rules").alias("fault"))
    return own.where("fault IS NOT NULL").unionByName(twice).unionByName(many)
