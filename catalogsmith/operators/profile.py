"""Profiling and repair of noisy records: length statistics, anomaly tags, scores, triage and programmatic fixes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..schema import col, is_blank

#: Anomaly tags and how much each weighs.
WEIGHTS = {"CHARS_DISPERSOS": 0.9, "REPETICION_CICLICA": 0.8, "CAMPO_VACIO": 0.6, "ARTEFACTO_CID": 0.5, "TEXTO_PEGADO": 0.4, "LONGITUD_ANOMALA": 0.35, "CHARS_CONTROL": 0.7}
OTHER_WEIGHT = 0.3
THRESHOLD = 0.3
REQUIRED = ("title", "author", "type")
#: Fields that have no spaces by nature.
UNSPACED = ("id", "doi", "rightsurl", "issn", "isbn", "url", "handle")


def length_stats(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row: mean_<f> and sd_<f> (sample deviation, 0 for one value) of the lengths of non-empty values, in one pass."""
    lengths = {f: F.when(F.coalesce(col(f).cast("string"), F.lit("")) != "", F.length(col(f).cast("string"))) for f in fields}
    means = [F.coalesce(F.avg(x), F.lit(0.0)).alias(f"mean_{f}") for f, x in lengths.items()]
    return df.agg(*means, *(F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias(f"sd_{f}") for f, x in lengths.items()))


def field_tags(f: str, stats: bool) -> Column:
    """The tags of one field, in their fixed order."""
    c = F.coalesce(col(f).cast("string"), F.lit(""))
    tag = lambda on, name: F.when(on, F.lit(name))
    tags = [tag(t.spaced_characters(c), "CHARS_DISPERSOS"), tag(t.cid_marks(c), "ARTEFACTO_CID"), tag(t.cyclic(c), "REPETICION_CICLICA")]
    if f not in UNSPACED:
        tags.append(tag(t.glued_words(c), "TEXTO_PEGADO"))
    tags.append(tag(t.control_characters(c), "CHARS_CONTROL"))
    if stats:
        tags.append(tag(t.length_outlier(F.length(c), F.col(f"mean_{f}"), F.col(f"sd_{f}")), "LONGITUD_ANOMALA"))
    full = F.array_compact(F.array(*tags))
    empty = F.array(F.lit("CAMPO_VACIO")) if f in REQUIRED else F.array().cast("array<string>")
    return F.when(is_blank(c), empty).otherwise(full)


def analyse(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """df with anomalies (map of field to tags, fields without any left out) and score. The statistics are one row, broadcast."""
    fields = [f for f in fields if f != "id"]
    joined = df.crossJoin(F.broadcast(length_stats(df, fields)))
    entries = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(field_tags(f, True) for f in fields)))
    tagged = joined.withColumn("anomalies", fence(F.map_filter(entries, lambda _, v: F.size(v) > 0)))
    return tagged.withColumn("score", score(F.col("anomalies"))).select(*(col(c) for c in df.columns), "anomalies", "score")


def score(anomalies: Column) -> Column:
    """The sum of the tags' weights, 1 at most."""
    weight = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))
    total = F.aggregate(F.flatten(F.map_values(anomalies)), F.lit(0.0), lambda acc, x: acc + F.coalesce(weight[x], F.lit(OTHER_WEIGHT)))
    return F.least(F.lit(1.0), F.coalesce(total, F.lit(0.0)))


def triage(analysed: DataFrame, fields: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """With a label: empty (all fields but the id are blank), suspicious or clean."""
    empty = reduce(lambda a, b: a & b, (is_blank(col(f)) for f in fields if f != "id"))
    return analysed.withColumn("triage", F.when(empty, "empty").when(F.col("score") >= threshold, "suspicious").otherwise("clean"))


def fence(c: Column) -> Column:
    """The same value, in a form that the optimizer does not copy: rules that use a field several times, one after the other,
    would otherwise be expanded into each other and grow with the product of their uses."""
    return F.when(F.rand(0) >= 0, c)


def fix_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Fields after the fixers that their tags (map anomalies) call for, in their order, a projection each; values of author
    lists then lose repetitions."""
    steps = [("ARTEFACTO_CID", t.replace_cid), ("REPETICION_CICLICA", t.cut_cycle), ("CHARS_DISPERSOS", t.join_spaced), ("TEXTO_PEGADO", t.split_glued)]
    for tag, fix in steps:
        on = [f for f in fields if f != "id" and (tag != "TEXTO_PEGADO" or f in ("description", "citation"))]
        has = {f: F.coalesce(F.array_contains(F.col("anomalies")[f], tag), F.lit(False)) for f in on}
        # The fixer's own null where the tag is absent: a function outside the JVM is called on every row.
        df = df.withColumns({f: fence(F.when(has[f], fix(F.when(has[f], col(f)))).otherwise(col(f))) for f in on})
    return df.withColumn("author", fence(t.distinct_values(col("author")))) if "author" in fields else df


def residual(f: str, tags: Column) -> Column:
    """The tags that the (fixed) field still has; tags that no detector checks always stay."""
    checks = {"CHARS_DISPERSOS": t.spaced_characters, "ARTEFACTO_CID": t.cid_marks, "REPETICION_CICLICA": t.cyclic, "TEXTO_PEGADO": t.glued_words, "CHARS_CONTROL": t.control_characters, "CAMPO_VACIO": is_blank}
    gone = F.array_compact(F.array(*(F.when(~check(col(f)), F.lit(name)) for name, check in checks.items())))
    return F.array_except(F.coalesce(tags, F.array().cast("array<string>")), gone)


def curate(df: DataFrame, fields: Sequence[str], decisions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Triage, fixes, and assembly into (curated, to review). Suspicious rows whose tags all go once fixed are curated; for the
    rest a decision table (id and corrected fields) may supply values; what no decision covers goes to review."""
    from .join import merge_decisions

    labelled = triage(analyse(df, fields), fields)
    # What is empty shows without an analysis.
    empty = df.where(reduce(lambda a, b: a & b, (is_blank(col(f)) for f in fields if f != "id")))
    # Both outputs branch on what is left after the fixes: these rows are computed once and kept (on disk where memory is short).
    repaired = fix_fields(labelled.where("triage = 'suspicious'"), fields).persist()
    left = reduce(lambda a, b: a + b, (F.size(residual(f, F.col("anomalies")[f])) for f in fields if f != "id"))
    repaired = repaired.withColumn("left", fence(left))
    clean = labelled.where("triage = 'clean'").select(*df.columns)
    fine, open_ = repaired.where("left = 0").select(*df.columns), repaired.where("left > 0").select(*df.columns)
    review = open_.unionByName(empty)
    if decisions is not None:
        decided = merge_decisions(open_, decisions, "id", [f for f in fields if f in decisions.columns and f != "id"])
        covered = decisions.select("id").distinct()
        clean, review = clean.unionByName(decided.join(covered, "id", "left_semi")), review.join(covered, "id", "left_anti")
    return clean.unionByName(fine), review


def curation_counts(labelled: DataFrame, fixed_count: Column, review: Column) -> DataFrame:
    """The counters of a curation run, in one pass."""
    label = F.col("triage")
    return labelled.agg(
        F.count("*").alias("total"), F.count_if(label == "clean").alias("clean"), F.count_if(label == "suspicious").alias("suspicious"), F.count_if(label == "empty").alias("empty"),
        F.count_if(fixed_count).alias("fixed"), F.count_if(review).alias("review"), F.count_if(F.size("anomalies") > 0).alias("with_anomalies"), F.count_if(F.col("score") >= 1.0).alias("worst"),
    )


def needs_curation(flags: Column) -> Column:
    """Any truthy flag named curation_needed or *_curation_needed in a map of strings."""
    return F.exists(F.map_entries(flags), lambda e: e["key"].rlike("(^|_)curation_needed$") & F.lower(e["value"]).isin("true", "1", "yes"))
