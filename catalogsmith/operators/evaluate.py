"""Scores of evaluation cases, a row each: what was decided against what the case expects, as columns between 0 and 1 (null: the
case does not ask for it). Mappings are arrays of structs (left, replace, required); of several with one key the last counts. A null
array counts as an empty one, and a null answer as a wrong one."""

from __future__ import annotations

import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIRS = "array<struct<left:string,replace:string>>"
NAMES = "array<string>"


def _list(c: Column, kind: str = NAMES) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _score(c: Column) -> Column:
    return _yes(c).cast("double")


def _last(items: Column, key: str, value: Column) -> Column:
    return F.try_element_at(F.filter(items, lambda m: F.trim(m[key]) == value), F.lit(-1))


def _bare(name: Column) -> Column:
    """A target's name without its language."""
    return F.trim(F.regexp_replace(name, r"\[[a-zA-Z]{2}\]$", ""))


def _holds(mappings: Column, pair: Column) -> Column:
    got = F.trim(_last(mappings, "left", pair["left"])["replace"])
    return _yes((got == pair["replace"]) | ((_bare(got) != "") & (_bare(got) == _bare(pair["replace"]))))


def pairs_kept(mappings: Column, expected: Column) -> Column:
    """The share of expected pairs (left, replace) that the mappings hold, in any language of the target."""
    wanted = _list(expected, PAIRS)
    return F.when(F.size(wanted) > 0, F.size(F.filter(wanted, lambda e: _holds(mappings, e))) / F.size(wanted))


def targets_covered(mappings: Column, critical: Column) -> Column:
    """The share of critical targets that some mapping has."""
    wanted, used = _list(critical), F.transform(mappings, lambda m: F.trim(m["replace"]))
    return F.when(F.size(wanted) > 0, F.size(F.filter(wanted, lambda f: _yes(F.array_contains(used, f)))) / F.size(wanted))


def pairs_avoided(mappings: Column, forbidden: Column, columns: Column) -> Column:
    """No forbidden pair, to the letter, and none of the columns that are not to be mapped."""
    pair = F.exists(_list(forbidden, PAIRS), lambda e: _yes(F.trim(_last(mappings, "left", e["left"])["replace"]) == e["replace"]))
    mapped = F.exists(_list(columns), lambda c: _last(mappings, "left", c).isNotNull())
    return _score(~pair & ~mapped)


def configuration_repaired(mappings: Column, repaired: Column, omitted: Column, forbidden: Column) -> Column:
    """Every pair to repair holds, every column to leave out is gone, and no forbidden pair is left."""
    asked = F.size(_list(repaired, PAIRS)) + F.size(_list(omitted)) > 0
    held = F.forall(_list(repaired, PAIRS), lambda e: _holds(mappings, e))
    return F.when(asked, _score(held) * pairs_avoided(mappings, forbidden, omitted))


def feedback_recovered(mappings: Column, present: Column, lefts: Column, bad_lefts: Column, bad_targets: Column, optional: Column) -> Column:
    """After a reported error: all targets of present are mapped, the pairs of lefts hold in any case of letters, nothing uses the
    bad lefts (in any case) and bad targets, and no mapping of an optional target is required."""
    at = lambda f: F.try_element_at(F.filter(mappings, lambda m: m["replace"] == f), F.lit(-1))
    used = F.transform(mappings, lambda m: F.lower(m["left"]))
    fine = [
        F.forall(_list(present), lambda f: at(f).isNotNull()),
        F.forall(_list(lefts, PAIRS), lambda e: _yes(F.lower(at(e["replace"])["left"]) == F.lower(e["left"]))),
        F.forall(_list(bad_lefts), lambda x: ~_yes(F.array_contains(used, F.lower(x)))),
        F.forall(_list(bad_targets), lambda f: at(f).isNull()),
        F.forall(_list(optional), lambda f: ~_yes(at(f)["required"])),
    ]
    asked = sum((F.size(_list(x)) for x in (present, bad_lefts, bad_targets, optional)), F.size(_list(lefts, PAIRS)))
    return F.when(asked > 0, _score(fine[0] & fine[1] & fine[2] & fine[3] & fine[4]))


# Patterns differ by case and may be wrong: they are tried in an Arrow function, where a wrong one is no error of the query.


def _compiled(pattern: str | None) -> re.Pattern | None:
    try:
        return re.compile(pattern) if pattern else None
    except re.error:
        return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def _found(patterns: pd.Series, groups: pd.Series, samples: pd.Series) -> pd.Series:
    """What the pattern finds in each sample: the group, the whole match if there is no such group, or nothing."""

    def row(pattern, group, values):
        rule, out = _compiled(pattern), []
        for value in values if values is not None else []:
            m = rule.search(value) if rule and value is not None else None
            out.append(((m[int(group)] if m.lastindex and 0 <= group <= m.lastindex else m[0]) or "").strip() if m else "")
        return out

    return pd.Series([row(*x) for x in zip(patterns, groups, samples, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _parted(patterns: pd.Series, samples: pd.Series) -> pd.Series:
    """The tokens of each sample, without white space and a full stop at their ends; null: no such pattern can be tried."""

    def row(pattern, values):
        rule = _compiled(pattern)
        if rule is None:
            return None
        parts = ([p.strip() for p in rule.split(v or "") if p and p.strip()] for v in (values if values is not None else []))
        return [[p.rstrip(".").strip() for p in one] for one in parts]

    return pd.Series([row(*x) for x in zip(patterns, samples, strict=True)], dtype=object)


def extraction_exact(pattern: Column, samples: Column, group: Column | None = None) -> Column:
    """The share of samples (array of structs value, expected) from which a pattern, group 1 if not said, extracts what is expected."""
    found = _found(pattern, F.coalesce(group if group is not None else F.lit(1), F.lit(1)).cast("int"), F.transform(samples, lambda s: s["value"]))
    right = F.size(F.filter(F.zip_with(found, samples, lambda a, s: a == s["expected"]), lambda x: x))
    return F.when(F.size(samples) > 0, right / F.size(samples))


def splitting_exact(pattern: Column, samples: Column, tokens: Column, least: Column, abstain: Column) -> Column:
    """How well a pattern parts the samples. Where the case is to abstain: whether it parts none (no pattern does). Else the share
    of samples with exactly the tokens (array of arrays; null: with two or more), which from least on counts as 1."""
    named = F.when(F.trim(pattern) != "SIN_PATRON", F.nullif(F.trim(pattern), F.lit("")))
    parted = _parted(named, samples)
    several = F.size(F.filter(parted, lambda p: F.size(p) > 1))
    exact = F.size(F.filter(F.zip_with(parted, tokens, lambda a, b: a == b), lambda x: x))
    share = F.when(F.size(tokens) == F.size(samples), exact).otherwise(several) / F.size(samples)
    tried = F.when(parted.isNull(), 0.0).when(F.size(samples) > 0, F.when(share >= least, 1.0).otherwise(share))
    return F.when(_yes(abstain), _score(named.isNull() | (several == 0))).otherwise(tried)


def rules_named(rules: Column, keys: Column, targets: Column) -> Column:
    """A value mapping (map) has one of the keys, and one of the targets (none asked: any) is part of its values, in any case."""
    have = F.transform(F.map_keys(rules), F.lower)
    values = F.lower(F.array_join(F.map_values(rules), " "))
    key = F.exists(_list(keys), lambda k: _yes(F.array_contains(have, F.lower(k))))
    target = (F.size(_list(targets)) == 0) | F.exists(_list(targets), lambda x: _yes(values.contains(F.lower(x))))
    return F.when(F.size(_list(keys)) > 0, _score(key & target))


def memory_effect(mode: Column, strategy_fits: Column, sure: Column, contaminated: Column) -> Column:
    """What remembered cases did: relevant ones are to be used with certainty, distractors (by their columns or keys, contaminated)
    not to be followed, mixed ones to be told apart; null without any."""
    plain = _yes(strategy_fits) & ~_yes(contaminated)
    both = plain & _yes(sure)
    pick = lambda on, good, bad: F.when(on, F.lit(good)).otherwise(F.lit(bad))
    return (
        F.when(mode == "relevant", pick(both, "transferred", "not_transferred"))
        .when(mode == "distractor", pick(plain, "ignored", "contaminated"))
        .when(mode == "mixed", pick(both, "told_apart", "confused"))
    )


def repair_done(automatic: Column, status: Column, changed: Column, valid: Column, cleaned: Column, allowed: Column) -> Column:
    """A repair that was to be made by itself went through, changed something, left a valid file, and each named row (allowed: array
    of structs id, values) has one of its values in cleaned (map)."""
    right = F.forall(F.coalesce(allowed, F.array().cast("array<struct<id:string,values:array<string>>>")), lambda a: _yes(F.array_contains(a["values"], F.try_element_at(cleaned, a["id"]))))
    return F.when(_yes(automatic), _score((status == "ok") & (changed > 0) & valid & right))


def action_right(repair: Column, review: Column, repaired: Column, reviewed: Column) -> Column:
    """A value to repair was repaired and not put aside; one to review was put aside and not made up; else something was done."""
    fixed, aside = _yes(repaired), _yes(reviewed)
    return F.when(_yes(repair), _score(fixed & ~aside)).when(_yes(review), _score(aside & ~fixed)).otherwise(_score(fixed | aside))


def has_notes(notes: Column) -> Column:
    return _score(F.trim(notes) != "")


def summary(cases: DataFrame, scores: Mapping[str, Column]) -> DataFrame:
    """metric, cases that it applies to, mean score (null: none) and how many are whole, in one pass without a shuffle of cases."""
    one = cases.select(*(c.alias(n) for n, c in scores.items())).agg(
        *(F.struct(F.count(n).alias("cases"), F.round(F.avg(n), 4).alias("mean"), F.count_if(F.col(n) >= 1).alias("whole")).alias(n) for n in scores)
    )
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("s")) for n in scores))).alias("x")).select("x.metric", "x.s.*")
