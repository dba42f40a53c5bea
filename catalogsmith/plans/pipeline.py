"""The whole flow from two record tables to reconciled, corrected, packaged records; it can stop after any step."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import correct, crosswalk, enrich, join, sanitize, transaction, validate
from ..schema import ENRICHABLE_FIELDS, GENERIC_FIELDS, ROW_ID, dense_numbers, with_row_id
from ..sources import writers

STEPS = ["validate", "map_source", "enrich", "map_repository", "sanitize", "deduplicate", "reconcile", "map_target", "correct", "package"]


@dataclass
class PipelineParams:
    """Thresholds and choices of a run; a step's own defaults are those of the functions it calls."""

    source_name: str = ""
    duplicate_threshold: float = 10.0
    review_threshold: float = 30.0
    anomaly_threshold: float = 0.3
    enrich: bool = True
    source_map: crosswalk.Crosswalk | None = None
    repository_map: crosswalk.Crosswalk | None = None
    target_map: crosswalk.Crosswalk | None = None
    providers: Sequence[enrich.Provider] = ()
    repairs: Sequence[tuple[str, str, dict]] = ()
    #: A folder that all executors reach. With it every step is written once, its rows counted in that pass, and what fails at run
    #: time fails in its step; without it steps only build plans.
    folder: str | None = None


@dataclass
class Run:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    versions: dict[str, transaction.Version] = field(default_factory=dict)


def run(source: DataFrame, repository: DataFrame, params: PipelineParams, until: str = STEPS[-1]) -> Run:
    """Each step adds its tables; a step that fails says so and ends the run. After a failed deduplication the given repairs
    (column, strategy, parameters) are applied, as transactions, and it is tried once more; a second failure is raised."""
    out = Run()
    t = out.tables
    for step in STEPS[: STEPS.index(until) + 1]:
        try:
            _settled(step, source, repository, params, out)
        except validate.InvalidInput as e:
            out.errors[step] = str(e)
            break
        except Exception as e:
            if step != "deduplicate" or not params.repairs:
                raise
            for column, strategy, parameters in params.repairs:
                _repair(out, params, column, strategy, parameters)
            out.warnings.append(f"deduplicate was tried again after {type(e).__name__}")
            _settled(step, source, repository, params, out)
    return out


def _settled(step: str, source: DataFrame, repository: DataFrame, params: PipelineParams, out: Run) -> None:
    """A step, and its tables written if there is a folder."""
    before = dict(out.tables)
    _step(step, source, repository, params, out)
    for name, df in list(out.tables.items()) if params.folder else ():
        if df is not before.get(name):
            out.versions[name] = transaction.write(df, f"{params.folder}/{name}", "id" if "id" in df.columns else None)
            out.tables[name] = out.versions[name].table


def _repair(out: Run, params: PipelineParams, column: str, strategy: str, parameters: dict) -> None:
    change = lambda df: df.withColumn(column, correct.strategy(strategy)(F.col(column), **parameters))
    if not params.folder:
        out.tables["records"] = correct.repair(out.tables["records"], "id", column, strategy, **parameters)
        return
    done = transaction.transact(out.versions["records"], [change], f"{params.folder}/records")
    out.versions["records"], out.tables["records"] = done.version, done.version.table
    out.warnings += [f"repair of {column}: {e}" for e in done.errors]


def _step(step: str, source: DataFrame, repository: DataFrame, params: PipelineParams, out: Run) -> None:
    t = out.tables
    if step == "validate":
        out.warnings += validate.check_source(source)
        validate.check_repository(repository)
        t["source"] = with_row_id(source) if ROW_ID not in source.columns else source
    elif step == "map_source":
        plan = params.source_map or crosswalk.fallback_mappings(t["source"].columns)
        t["generic"] = _complete(crosswalk.apply(t["source"], plan, keep=[ROW_ID]))
    elif step == "enrich":
        if params.enrich and params.providers:
            t["generic"] = enrich.chain(t["generic"], params.providers, ENRICHABLE_FIELDS).drop("provider")
    elif step == "map_repository":
        t["repository"] = _complete(crosswalk.apply(repository, params.repository_map or crosswalk.fallback_mappings(repository.columns)))
    elif step == "sanitize":
        done = sanitize.sanitize(t["generic"])
        t |= {"records": done.records, "quarantine": done.quarantine, "log": done.log}
    elif step == "deduplicate":
        t["edges"] = join.duplicate_edges(t["repository"], t["records"])
    elif step == "reconcile":
        t["reconciled"] = join.without_duplicates(t["records"], t["edges"], threshold=params.duplicate_threshold)
    elif step == "map_target":
        t["target"] = crosswalk.apply(t["reconciled"], params.target_map) if params.target_map else t["reconciled"].drop(ROW_ID)
    elif step == "correct":
        t["corrected"] = correct.get_corrector(params.source_name)(t["target"])
    elif step == "package":
        ordered = dense_numbers(correct.prepare_export(t["corrected"]).withColumn("__k", _key(t["corrected"])), "__k", "item_no").drop("__k")
        t["files"] = writers.package_files(ordered, "item_no")


def _key(df: DataFrame):
    return F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))


def _complete(df: DataFrame) -> DataFrame:
    return df.select("*", *(F.lit("").alias(f) for f in GENERIC_FIELDS if f not in df.columns))
