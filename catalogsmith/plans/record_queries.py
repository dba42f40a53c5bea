"""Queries of the scalar functions, routing, profiling, correction and enrichment operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import aggregate, correct, crosswalk, enrich, metrics, profile, sanitize
from ..schema import CURATION_FIELDS, GENERIC_FIELDS, is_blank, ws_trim
from ..sources import readers, writers
from .views import ctes, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, base: str, build: Callable[[DataFrame], DataFrame], sql: str | None = None, *more: str) -> None:
    """A query over a view, and the rest of its SQL after the views."""
    QUERIES[name] = lambda spark, sf_dir: build(view(spark, sf_dir, base))
    if sql:
        ORACLES[name] = f"{ctes(base, *more)}\n{sql}"


def scalar(name: str, base: str, value, sql: str | None, to: str = "value") -> None:
    add(name, base, lambda df: df.select("row_id", value().alias(to)), sql and f"select row_id, {sql} as {to} from {base}")


def blank(c: str) -> str:
    return f"(coalesce(lower(trim({c})), '') in ('', 'nan', 'none'))"


def empty_cell(c: str) -> str:
    return f"(coalesce({c}, '') in ('', 'nan', 'None'))"


def clean_date_sql(c: str) -> str:
    words = "|".join(sorted(t.MONTHS, key=len, reverse=True))
    listed = ", ".join(f"'{m}'" for m in t.MONTHS)
    number = " ".join(f"when '{m}' then '{n}'" for m, n in t.MONTHS.items())
    v, year = f"trim({c})", f"regexp_extract(trim({c}), '\\b((?:18|19|20)\\d\\d)\\b', 1)"
    month = f"case when regexp_matches(lower({v}), '[a-z]+\\s*[-/]\\s*[a-z]+') then null else case list_filter([{listed}], lambda m: list_contains(regexp_extract_all(lower({v}), '\\b({words})\\b', 1), m))[1] {number} end end"
    return f"case when regexp_matches({v}, '^\\d{{4}}(-\\d{{2}}(-\\d{{2}})?)?$') then {v} when {year} <> '' then concat_ws('-', {year}, {month}) else regexp_replace({v}, '^[^\\w]+|[^\\w]+$', '', 'g') end"


def infer_date_sql() -> str:
    y = lambda c: f"case when not {blank(c)} then nullif(regexp_extract({c}, '\\b((?:18|19|20)\\d\\d)\\b', 1), '') end"
    return f"case when not {blank('date')} then {clean_date_sql('date')} else coalesce({y('citation')}, {y('title')}, '') end"


def infer_type_sql() -> str:
    signs = " or ".join(f"contains(lower(citation), '{s}')" for s in t.JOURNAL_SIGNS)
    thesis = " or ".join(f"contains(lower(title), '{s}')" for s in t.THESIS_SIGNS)
    return f"case when not {blank('type')} then trim(type) when not {blank('issn')} or {signs} then 'Articulo' when not {blank('isbn')} then 'Libro' when {thesis} then 'Tesis' else '' end"


C = F.col

# 2.K scalar functions
scalar("k1_clean_date", "records", lambda: t.clean_date(C("date")), clean_date_sql("date"))
_trimmed = "trim(coalesce(date, ''))"
scalar(
    "k1_date_changed",
    "records",
    lambda: t.date_changed(C("date")),
    f"case when {_trimmed} = '' then false when regexp_matches({_trimmed}, '^\\d{{4}}(-\\d{{2}}(-\\d{{2}})?)?$') then {_trimmed} <> coalesce(date, '') else {clean_date_sql('date')} <> {_trimmed} end",
)
_year_of = lambda c: f"case when not {blank(c)} then nullif(regexp_extract({c}, '\\b((?:18|19|20)\\d\\d)\\b', 1), '') end"
scalar(
    "k2_infer_from_text",
    "records",
    lambda: t.infer_date(C("date"), C("citation"), C("title"), F.concat(F.lit("of "), (C("custkey") + 1750).cast("string"), F.lit("."))),
    f"case when not {blank('date')} then {clean_date_sql('date')} else coalesce({_year_of('citation')}, {_year_of('title')}, nullif(regexp_extract('of ' || (custkey + 1750) || '.', '\\b((?:18|19|20)\\d\\d)\\b', 1), ''), '') end",
)
scalar("k2_infer_date", "records", lambda: t.infer_date(C("date"), C("citation"), C("title")), infer_date_sql())
scalar("k3_infer_type", "records", lambda: t.infer_type(C("type"), C("issn"), C("isbn"), C("citation"), C("title")), infer_type_sql())
scalar("k4_default_author", "records", lambda: t.default_author(C("author")), f"case when {blank('author')} then 'Desconocido' else author end")
_tokens = "list_filter(string_split_regex(title, '\\s+'), lambda x: x <> '')"
SPACED = f"(length(title) >= 5 and len({_tokens}) >= 8 and len(list_filter({_tokens}, lambda x: length(x) = 1)) / greatest(len({_tokens}), 1) > 0.6)"
scalar("k5_spaced", "noisy", lambda: t.spaced_characters(C("title")), SPACED)
CID = "regexp_matches(title, '\\(cid:\\d+\\)')"
scalar("k6_cid", "noisy", lambda: t.cid_marks(C("title")), CID)
scalar("k7_cyclic", "noisy", lambda: t.cyclic(C("description")), None)
_glued = "list_filter(string_split_regex({c}, '[\\s\\-_/]+'), lambda x: x <> '')"


def glued_sql(c: str) -> str:
    g = _glued.replace("{c}", c)
    return f"(length({c}) >= 5 and len({g}) > 0 and len(list_filter({g}, lambda x: length(x) > 30)) / greatest(len({g}), 1) > 0.15)"


scalar("k8_glued", "noisy", lambda: t.glued_words(C("title")), glued_sql("title"))
CONTROL = "regexp_matches({c}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]')"
scalar("k9_control", "noisy", lambda: t.control_characters(C("title")), CONTROL.replace("{c}", "title"))
OUTLIER = "(length(description) >= 200 and case when s < 1 then length(description) > 500 else (length(description) - m) / s > 3 end)"
add(
    "k10_length_outlier",
    "noisy",
    lambda df: df.crossJoin(F.broadcast(profile.length_stats(df, ["description"]))).select("row_id", t.length_outlier(F.length("description"), C("mean_description"), C("sd_description")).alias("value")),
    f", st as (select avg(length(description)) as m, coalesce(stddev_samp(length(description)), 0) as s from noisy where description <> '') select row_id, {OUTLIER} as value from noisy, st",
)
scalar("k11_required_blank", "noisy", lambda: is_blank(C("author")), blank("author"))
_NOISY = ["title", "author", "type", "description"]
_tag = lambda on, name: f"case when {on} then '{name}' end"
add(
    "k12_row_analysis",
    "noisy",
    lambda df: profile.analyse(df, _NOISY).select("row_id", F.to_json("anomalies").alias("anomalies"), F.round("score", 4).alias("score")),
)  # no SQL: the cycles of descriptions need back-references, which DuckDB has not; tests hold it against plain Python
scalar("k13_join_spaced", "noisy", lambda: t.join_spaced(C("title")), None)
_cid = "title"
for _k, _v in t.CID_CODES.items():
    _cid = f"replace({_cid}, '(cid:{_k})', '{_v}')"
scalar("k14_replace_cid", "noisy", lambda: t.replace_cid(C("title")), f"case when {CID} then trim(regexp_replace(regexp_replace({_cid}, '\\(cid:\\d+\\)', '', 'g'), ' {{2,}}', ' ', 'g')) else title end")
scalar("k15_cut_cycle", "noisy", lambda: t.cut_cycle(C("description")), None)
scalar("k16_split_glued", "records", lambda: t.split_glued(C("title")), None)
scalar("k17_distinct_authors", "records", lambda: t.distinct_values(C("author")), "case when contains(author, '|') then array_to_string(list_transform(list_filter(list_transform(list_zip(string_split(author, '|'), range(1, 99)), lambda z: z), lambda z: z[1] is not null and list_position(list_transform(string_split(author, '|'), lambda q: lower(trim(q))), lower(trim(z[1]))) = z[2]), lambda z: trim(z[1])), '|') else author end")
add("k18_dispatch", "noisy", lambda df: profile.fix_fields(profile.analyse(df, _NOISY), _NOISY).select("row_id", *_NOISY))
scalar("k19_clean_doi", "records", lambda: t.clean_doi(C("doi")), "regexp_replace(doi, '^\\s*(https?://(dx\\.)?doi\\.org/|doi:\\s*)', '', 'i')")
scalar("k20_clean_isbn", "records", lambda: t.clean_isbn(C("isbn")), "upper(regexp_replace(isbn, '[^0-9Xx]', '', 'g'))")
scalar("k21_clean_issn", "records", lambda: t.clean_issn(C("issn")), "trim(replace(issn, '-', ''))")
_sim = "case percent % 6 when 0 then 'NO_DUPLICATE' when 1 then '' when 2 then cast(percent / 100.0 as double)::string when 3 then '1.0' when 4 then 'high' else cast(percent as string) end"
_RAW = ("case percent % 6 when 0 then 'NO_DUPLICATE' when 1 then '' when 2 then cast(percent / cast(100.0 as double) as string) when 3 then '1.0' when 4 then 'high' else cast(percent as string) end")
scalar("k22_similarity", "records", lambda: F.round(t.similarity(F.expr(_RAW)), 4), f"round(case when upper(trim({_sim})) in ('', 'NO_DUPLICATE', 'NONE') then 0.0 when try_cast(trim({_sim}) as double) is null then 100.0 when try_cast(trim({_sim}) as double) <= 1.0 and try_cast(trim({_sim}) as double) > 0 then try_cast(trim({_sim}) as double) * 100 else try_cast(trim({_sim}) as double) end, 4)")
QUERIES["k23_unescape"] = lambda spark, d: spark.read.parquet(f"{d}/pages.parquet").select("page_id", t.unescape_html(F.regexp_extract("html", "<title>(.*?)</title>", 1)).alias("title"))
scalar("k24_separators", "values_list", lambda: t.rewrite_separator(C("p_name"), " ", "; "), "replace(p_name, ' ', '; ')")
scalar("k25_detect_separator", "values_list", lambda: F.get(t.valid_separators(C("many")), F.lit(0)), "case when contains(many, '||') then '||' when contains(many, '|') then '|' end")
add(
    "k26_separator_shares",
    "values_list",
    lambda df: df.agg(*(F.round(F.avg(C("many").contains(s).cast("int")), 4).alias(n) for s, n in (("||", "two_bars"), ("|||", "three_bars"), (";", "semicolon")))),
    "select round(avg(contains(many, '||')::int), 4) as two_bars, round(avg(contains(many, '|||')::int), 4) as three_bars, round(avg(contains(many, ';')::int), 4) as semicolon from values_list",
)
scalar("k27_split_names", "records", lambda: F.array_join(t.split_names(F.regexp_replace("author", r"[|, ]", "")), ";"), None)
_two = "replace(coalesce(many, ''), '|||', '||')"
for _ in range(2):  # a bar beside the last match's end is met the second time
    _two = f"regexp_replace({_two}, '(^|[^|])\\|([^|]|$)', '\\1||\\2', 'g')"
_LONE_BARS = f"case when many = 'nan' then '' else {_two} end"
scalar("k28_canonical_separators", "values_list", lambda: t.canonical_separators(C("many")), _LONE_BARS)
_LANGUAGE_SQL = """coalesce(case when lower(trim(language)) in ('english', 'inglés', 'ingles', 'eng') then 'en' when lower(trim(language)) in ('spanish', 'español', 'espanol', 'spa') then 'es'
  when lower(trim(language)) in ('portuguese', 'portugués', 'portugues', 'por') then 'pt' when lower(trim(language)) in ('es', 'en', 'pt', 'fr', 'de', 'it', 'zh', 'ja', 'ar') then lower(trim(language)) end, language)"""
scalar("k29_language", "records", lambda: t.language_code(C("language")), _LANGUAGE_SQL)
add(
    "k30_titles",
    "records",
    lambda df: df.select("row_id", F.regexp_extract("citation", r"(\d{4})", 1).alias("year"), t.title_with_subtitle(C("title"), C("citation")).alias("full_title"), t.volume_issue(C("issn"), C("place")).alias("issue")),
    "select row_id, regexp_extract(citation, '(\\d{4})', 1) as year, concat_ws(': ', nullif(title, ''), nullif(citation, '')) as full_title, concat_ws(', ', case when issn <> '' then 'vol. ' || issn end, case when place <> '' then 'no. ' || place end) as issue from records",
)
scalar("k31_author_display", "records", lambda: t.author_display(C("place"), C("affiliation"), C("id")), "coalesce(nullif(concat_ws(', ', nullif(place, ''), nullif(affiliation, '')), ''), id)")
_months = " ".join(f"when '{k}' then '{v}'" for k, v in t.SPANISH_MONTHS.items())
_m = "case percent % 4 when 0 then 'Marzo' when 1 then cast(percent % 12 + 1 as string) when 2 then 'diciembre' else 'x' end"
scalar("k32_month", "records", lambda: t.month_number(F.expr(_m)), f"coalesce(case lower(trim({_m})) {_months} end, case when regexp_matches({_m}, '^\\d{{1,2}}$') then lpad({_m}, 2, '0') end, '')")
QUERIES["k33_ascii_fold"] = lambda spark, d: t.small_batches(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id", t.ascii_fold("text").alias("value"))
_msg = "'ValueError: could not convert ''' || place || ''' at ' || id"
add("k34_error_parts", "records", lambda df: df.select("row_id", t.error_parts(F.expr("concat('ValueError: could not convert ', chr(39), place, chr(39), ' at ', id)")).alias("x")).select("row_id", "x.error_class", F.array_join("x.literals", "|").alias("literals")), f"select row_id, regexp_extract({_msg}, '\\b([A-Z]\\w+Error)\\b', 1) as error_class, coalesce(array_to_string(regexp_extract_all({_msg}, '''([^'']{{1,49}})''', 1), '|'), '') as literals from records")
scalar("k35_query_text", "records", lambda: t.query_text(C("title"), C("author"), C("citation")), "concat_ws('. ', nullif(title, ''), nullif(author, ''), nullif(citation, ''))")
QUERIES["k36_json_rows"] = lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select("event_id", F.get(t.json_rows(F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```")), "struct<k:bigint>"), F.lit(0))["k"].alias("k"))
ORACLES["k36_json_rows"] = "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events"
scalar("k37_first_value", "records", lambda: t.first_value(F.array(F.struct(C("title").alias("value")), F.struct(C("id").alias("value")))), "title")
scalar("k38_trim", "records", lambda: ws_trim(F.concat(F.lit("\t "), C("title"), F.lit("\n"))), "trim(title)")
QUERIES["k39_chunks"] = lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.posexplode(t.chunks(C("text"))).alias("chunk", "part")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.length("part").cast("long").alias("n"), F.md5("part").alias("digest"))
ORACLES["k39_chunks"] = "select doc_id, i as chunk, length(substr(text, i * 700 + 1, 800)) as n, md5(substr(text, i * 700 + 1, 800)) as digest from (select doc_id, text, unnest(range(0, (greatest(length(text), 1) - 1) // 700 + 1)) as i from documents)"

# 2.E routing
_reason = f"case when {blank('date')} and {blank('type')} then 'missing date and type' when {blank('date')} then 'missing date' when {blank('type')} then 'missing type' end"
add("e1_quarantine", "records", lambda df: df.select("row_id", sanitize.quarantine_reason().alias("reason")).where("reason is not null"), f"select row_id, {_reason} as reason from records where {_reason} is not null")
add("e2_all_quarantined", "records", lambda df: df.agg((F.count_if(sanitize.quarantine_reason().isNull()) == 0).alias("all_quarantined")), f"select count(*) filter (where {_reason} is null) = 0 as all_quarantined from records")
add(
    "e3_triage",
    "noisy",
    lambda df: profile.triage(profile.analyse(df, _NOISY), _NOISY).select("row_id", "triage"),
)
add("e4_blank_families", "records", lambda df: df.agg(F.count_if(is_blank(C("citation"))).alias("blank"), F.count_if(C("citation").isin("", "nan", "None")).alias("empty_cell")), f"select count(*) filter (where {blank('citation')}) as blank, count(*) filter (where {empty_cell('citation')}) as empty_cell from records")
_dec = "case when percent < 10 then 'safe' when percent < 30 then 'review' else 'duplicate' end"


def _three_way(df: DataFrame) -> DataFrame:
    from ..operators.join import decision

    return df.groupBy(decision(C("percent")).alias("decision")).agg(F.count("*").alias("n"))


add("e6_three_way", "records", _three_way, f"select {_dec} as decision, count(*) as n from records group by 1")
QUERIES["e7_object_names"] = lambda spark, d: spark.read.parquet(f"{d}/pages.parquet").where(F.col("url").endswith("/") & F.col("url").startswith("https")).select("page_id")
ORACLES["e7_object_names"] = "select page_id from pages where url like '%/' and url like 'https%'"
add("e8_residual_tags", "noisy", lambda df: df.withColumn("title", t.replace_cid(C("title"))).select("row_id", F.array_join(profile.residual("title", F.array(F.lit("ARTEFACTO_CID"), F.lit("CAMPO_VACIO"), F.lit("OTHER"))), ",").alias("left")), f"select row_id, case when {blank('title')} then 'CAMPO_VACIO,OTHER' else 'OTHER' end as left from noisy".replace("as left", 'as "left"'))
add("e9_needs_curation", "records", lambda df: df.select("row_id", profile.needs_curation(F.create_map(F.lit("title_curation_needed"), F.when(C("percent") < 20, "True").otherwise("false"), F.lit("other"), F.lit("true"))).alias("value")), "select row_id, percent < 20 as value from records")
add("e10_auto_gate", "records", lambda df: df.select("row_id", correct.auto_repairable(F.when(C("percent") % 3 == 0, "High").otherwise("low"), C("percent") % 2 == 0, C("percent") < 50).alias("value")), "select row_id, percent % 3 = 0 and percent % 2 <> 0 and percent < 50 as value from records")

# 2.G aggregations
add("g1_length_stats", "noisy", lambda df: profile.length_stats(df, ["title", "description"]).select(*(F.round(c, 4).alias(c) for c in ("mean_title", "sd_title", "mean_description", "sd_description"))), "select round(avg(length(nullif(title, ''))), 4) as mean_title, round(stddev_samp(length(nullif(title, ''))), 4) as sd_title, round(avg(length(nullif(description, ''))), 4) as mean_description, round(stddev_samp(length(nullif(description, ''))), 4) as sd_description from noisy")
add("g2_anomaly_score", "noisy", lambda df: profile.analyse(df.select("row_id", "author", "type"), ["author", "type"]).groupBy(F.round("score", 4).alias("score")).agg(F.count("*").alias("n")), f"select round(least(1.0, 0.6 * {blank('author')}::int + 0.6 * {blank('type')}::int), 4)::double as score, count(*) as n from noisy group by 1")
add("g3_curation_counts", "noisy", lambda df: profile.curation_counts(profile.triage(profile.analyse(df.select("row_id", "author", "type"), ["author", "type"]), ["author", "type"]), F.lit(False), C("triage") == "empty"), f"select count(*) as total, count(*) filter (where b = 0) as clean, count(*) filter (where b = 1) as suspicious, count(*) filter (where b = 2) as empty, 0::bigint as fixed, count(*) filter (where b = 2) as review, count(*) filter (where b > 0) as with_anomalies, count(*) filter (where b = 2) as worst from (select {blank('author')}::int + {blank('type')}::int as b from noisy)")
add("g8_regex_coverage", "records", lambda df: df.agg(metrics.split_rate(C("author"), r"(?<=[a-z])\|(?=[A-Z])").alias("rate")))
add("g9_count", "records", lambda df: df.agg(F.count("*").alias("n")), "select count(*) as n from records")
add("g10_page_totals", "records", lambda df: aggregate.page_totals(df, 20), "select count(*) as total_elements, cast(ceil(count(*) / 20.0) as bigint) as total_pages from records")
add("g11_quality", "records", lambda df: aggregate.filled_ratios(df, ["title", "author", "type"]), "select " + ", ".join(f"round(avg((not {blank(c)})::int), 4) as filled_{c}" for c in ("title", "author", "type")) + " from records")
add("g11_precision_recall", "records", lambda df: aggregate.precision_recall(df, C("percent") < 40, C("percent") % 2 == 0), "select tp, fp, fn, round(tp / (tp + fp), 4) as precision, round(tp / (tp + fn), 4) as recall, round(2 * tp / (2 * tp + fp + fn), 4) as f1 from (select count(*) filter (where percent < 40 and percent % 2 = 0) as tp, count(*) filter (where percent < 40 and percent % 2 <> 0) as fp, count(*) filter (where percent >= 40 and percent % 2 = 0) as fn from records)")
scalar("g12_least_year", "records", lambda: t.least_year(F.concat(C("percent") + 1950, F.lit(", "), C("percent") % 7 + 1980, F.lit(",x"))), "least(percent + 1950, percent % 7 + 1980)")

# 2.L enrichment, 2.M corrections, 2.A/2.B/2.N sources and sinks
add("l2_first_filled", "records", lambda df: df.select("row_id", enrich.first_filled(C("citation"), C("place"), C("affiliation")).alias("value")), f"select row_id, coalesce(case when not {blank('citation')} then citation end, case when not {blank('place')} then place end, case when not {blank('affiliation')} then affiliation end) as value from records")
add("l9_tiers", "records", lambda df: df.groupBy(enrich.tier(df, ["title", "author", "date", "type", "doi"]).alias("tier")).agg(F.count("*").alias("n")), "select case when s >= 0.9 then 'gold' when s >= 0.6 then 'silver' else 'bronze' end as tier, count(*) as n from (select (" + " + ".join(f"(not {blank(c)})::int" for c in ("title", "author", "date", "type", "doi")) + ") / 5.0 as s from records) group by 1")
add("d14_provider_map", "records", lambda df: enrich.generic_payload(df.select("row_id", "title", F.col("author").alias("authors"), F.col("place").alias("abstract_es"), F.col("affiliation").alias("abstract_en"))), "select row_id, nullif(title, '') as title, nullif(author, '') as author, coalesce(nullif(affiliation, ''), nullif(place, '')) as description from records")
add("m1_sanitize", "records", lambda df: sanitize.sanitize(df, "row_id").records.select("row_id", "date", "type", "author"), f"select * from (select row_id, {infer_date_sql()} as date, {infer_type_sql()} as type, case when {blank('author')} then 'Desconocido' else author end as author from records) where not {blank('date')} and not {blank('type')}")
_cells = [("author", f"case when {blank('author')} then 'Desconocido' else author end"), ("date", infer_date_sql()), ("type", infer_type_sql())]
add("m1_sanitize_log", "records", lambda df: sanitize.sanitize(df, "row_id").log.groupBy("stage", "column").agg(F.count("*").alias("n"), F.count_distinct("cleaned").alias("cleaned")), " union all ".join(("" if i else "") + f"select 'sanitizer' as stage, '{c}' as \"column\", count(*) as n, count(distinct v) as cleaned from (select {c} as o, {s} as v from records) where o <> v" for i, (c, s) in enumerate(_cells)))
add("m3_place", "records", lambda df: correct.fill_place(df, "place", "affiliation").select("row_id", "place"), f"select row_id, case when {blank('place')} and not {blank('affiliation')} then affiliation else place end as place from records")
scalar("m4_author_cap", "records", lambda: correct.cap_authors(F.array_join(F.array_repeat(C("id"), (C("percent")).cast("int")), "||"), F.when(C("percent") % 2 == 0, "Own, A||Own, B").otherwise("")), "case when percent > 30 and percent % 2 = 0 then 'Own, A||Own, B' else coalesce(array_to_string(list_transform(range(0, percent), lambda x: id), '||'), '') end")
scalar("m6_value_map", "records", lambda: correct.map_values(C("date"), {"June": "06", "(Unknown!)": "", "July": "07"}), "case when date = '(Unknown!)' then '' else regexp_replace(regexp_replace(regexp_replace(date, 'june', '06', 'gi'), '\\(unknown!\\)', '', 'gi'), 'july', '07', 'gi') end")
scalar("m7_regex_extract", "records", lambda: correct.extract(C("date"), r"(\d{4})"), "case when regexp_matches(date, '\\d{4}') then regexp_extract(date, '(\\d{4})', 1) else date end")
scalar("m8_date_strategy", "records", lambda: correct.strategy("date_normalization")(C("date")), clean_date_sql("date"))
add("m10_transaction", "records", lambda df: correct.repair(df, "id", "date", "regex_extraction", pattern=r"(\d{4})").select("row_id", "date"), "select row_id, case when regexp_matches(date, '\\d{4}') then regexp_extract(date, '(\\d{4})', 1) else date end as date from records")
add("m12_curation", "noisy", lambda df: profile.curate(df.withColumn("id", C("row_id").cast("string")), ["id", *_NOISY])[1].select("row_id"))
add("i8_cap_list", "values_list", lambda df: df.select("row_id", correct.capped_list(C("many"), 2).alias("value")), "select row_id, p_brand || '|' || p_type as value from values_list")
add("h7_ordered_distinct", "values_list", lambda df: df.select("row_id", F.array_join(F.array_distinct(F.array("p_brand", "p_type", "p_brand")), "|").alias("value")), "select row_id, p_brand || '|' || p_type as value from values_list")
add("b2_canonical_columns", "records", lambda df: correct.canonical_columns(df.select("id", "title", "place", C("price").alias("_internal"))), "select id, title, '' as author, '' as description, '' as date, '' as type, '' as subject, '' as issn, '' as isbn, '' as doi, '' as citation, '' as rights, '' as rightsurl, place from records")
add("b3_union_keys", "records", lambda df: correct.union_of_keys([df.select("id", "title"), df.select("id", "place").where("percent < 5")]), "select id, title, '' as place from records union all select id, '', place from records where percent < 5")
add("b4_dedup_export", "records", lambda df: readers.dedup_export(df.select("title", C("doi"), C("id").alias("identifier"), C("author").alias("creators"), C("date").alias("publicationDate")), "press"), "select 'press' as source, title, coalesce(nullif(trim(doi), ''), id) as id, array_to_string(list_transform(list_filter(list_transform(string_split(author, '|'), lambda x: trim(x)), lambda x: x <> ''), lambda x: x || ';'), ' ') as author, substr(date, 1, 4) as date from records")
_LINE = """'"' || title || '",' || author || ',' || date || ',' || id"""
add(
    "a8_merge_surplus",
    "records",
    lambda df: df.select("row_id", readers.merge_surplus(F.expr(_LINE), 3).alias("cells")).select("row_id", F.size("cells").alias("fields"), F.get("cells", F.lit(0)).alias("head"), F.get("cells", F.lit(2)).alias("tail")),
    "select row_id, least(len(p) + 1, 3)::int as fields, title || ',' || array_to_string(p[1:len(p) - 2], ',') as head, id as tail from (select row_id, title, id, string_split(author || ',' || date || ',' || id, ',') as p from records)",
)
add(
    "b4_full_export",
    "records",
    lambda df: readers.full_export(
        df.select(C("id").alias("identifier"), "title", "doi", C("date").alias("publicationDate"), F.split("author", r"\|").alias("keyword"), F.transform(F.split("author", r"\|"), lambda a: F.struct(a.alias("creator"))).alias("creators"), F.array(F.struct(C("doi").alias("value"))).alias("url"))
    ),
    "select id as identifier, title, doi, date as \"publicationDate\", '' as \"publicationName\", '' as publisher, '' as \"publicationType\", '' as openaccess, '' as subject, array_to_string(string_split(author, '|'), ' | ') as keyword, '' as abstract, array_to_string(list_transform(list_filter(list_transform(string_split(author, '|'), lambda x: trim(x)), lambda x: x <> ''), lambda x: x || ';'), ' ') as creators, doi as url from records",
)
add(
    "c11_unsplit",
    "records",
    lambda df: crosswalk.unsplit(df.select("row_id", F.expr("author || case when percent < 30 then ' of a body with a rather long name' else '' end").alias("author"), C("title").alias("subject")), ["author", "subject"]).select("row_id", F.array_join("unsplit", ",").alias("unsplit")),
    "select row_id, case when len(p) < 3 and len(list_filter(p, lambda x: length(x) > 40)) > 0 then 'author' else '' end as unsplit from (select row_id, list_filter(list_transform(string_split(author || case when percent < 30 then ' of a body with a rather long name' else '' end, '|'), lambda x: trim(x)), lambda x: x <> '') as p from records)",
)
add("a5_biased_head", "noisy", lambda df: aggregate.biased_head(df.select("row_id", "title", "description"), "description", "row_id"), "select cast(row_id as varchar) as row_id, substr(title, 1, 100) as title, substr(description, 1, 100) as description from noisy order by case when length(description) >= 35 then 0 else 1 end, noisy.row_id limit 5")
add("a6_column_samples", "records", lambda df: aggregate.column_samples(df, "row_id", ["title", "doi"]), f"select * from (select 'title' as \"column\", row_number() over (order by row_id) as pos, substr(title, 1, 30) as value from records where not {blank('title')} union all select 'doi', row_number() over (order by row_id), substr(doi, 1, 30) from records where not {blank('doi')}) where pos <= 3")
add(
    "a9_json_harvest",
    "records",
    lambda df: readers.flatten_articles(
        df.select(
            F.from_json(
                F.to_json(F.struct(C("title"), F.lit("Marzo").alias("month"), F.array(F.struct(C("author").alias("name"))).alias("author"), F.array(F.struct(F.lit("doi").alias("type"), C("doi").alias("id"))).alias("identifier"), C("citation").alias("abstract"), F.lit("2011").alias("year"))),
                "title string, month string, year string, abstract string, author array<struct<name:string>>, identifier array<struct<type:string,id:string>>, link array<struct<type:string,url:string>>, journal struct<title:string>, keywords array<string>",
            ).alias("bib")
        )
    ).select("title", "author", "year", "month", "abstract", "doi"),
    "select title, author, '2011' as year, '03' as month, citation as abstract, doi from records",
)
add("d15_prepare_export", "records", lambda df: correct.prepare_export(df.select("id", "title", C("place").alias("Unnamed: 0"))), "select '' as files, id, title from records")
add("d16_compact_json", "records", lambda df: correct.compact_json(df.select("row_id", "title", "issn", "type"), "row_id").select("row_id", "json"), "select row_id, '{' || concat_ws(',', '\"row_id\":\"' || row_id || '\"', case when title <> '' then '\"title\":\"' || title || '\"' end, case when issn <> '' then '\"issn\":\"' || issn || '\"' end, case when type <> '' then '\"type\":\"' || type || '\"' end) || '}' as json from records")
_xml = lambda df: df.select("row_id", C("title").alias("dc.title[es]"), C("author").alias("dc.contributor.author"), C("place").alias("local.place"))
add("n2_item_xml", "records", lambda df: _xml(df).select("row_id", writers.item_xml(_xml(df).columns, "dc", "|").alias("xml")), "select row_id, '<dublin_core>' || chr(10) || coalesce(array_to_string(list_transform(list_filter(list_transform(string_split(title, '|'), lambda x: trim(x)), lambda x: x <> ''), lambda x: '  <dcvalue element=\"title\" language=\"es\">' || x || '</dcvalue>'), chr(10)) || case when title <> '' then chr(10) else '' end, '') || coalesce(array_to_string(list_transform(list_filter(list_transform(string_split(author, '|'), lambda x: trim(x)), lambda x: x <> ''), lambda x: '  <dcvalue element=\"contributor\" qualifier=\"author\">' || x || '</dcvalue>'), chr(10)) || case when author <> '' then chr(10) else '' end, '') || '</dublin_core>' as xml from records")
add("n3_manifest", "records", lambda df: df.select("row_id", writers.manifest(F.concat(F.lit("a/b/"), C("id"), F.lit(".pdf||c/"), C("id"), F.lit(".txt"))).alias("contents")), "select row_id, id || '.pdf' || chr(10) || id || '.txt' as contents from records")
add("n5_package_report", "records", lambda df: writers.validate_packages(writers.package_files(_xml(df).withColumn("files", F.lit("x/a.pdf")), "row_id")).groupBy("valid", "files").agg(F.count("*").alias("n")), "select true as valid, 3::bigint as files, count(*) as n from records")
#: Fields that the generic schema has and the view lacks are blank.
assert set(GENERIC_FIELDS) - {"description", "subject", "subtitle"} <= {"id", "title", "author", "date", "type", "issn", "doi", "isbn", "citation"}


# Whole columns: the separator of the first value, and the shares of all
add(
    "k25_column_separator",
    "records",
    lambda df: aggregate.detect_separator(df, "author", "row_id"),
    f"""select coalesce(case when s is null then 'unknown' else 'literal' end, 'unknown') as type, coalesce(s, '') as value from (select list_filter(['||', '|', ';;', ';', ',,', ',', '.'], lambda x: len(list_filter(string_split(author, x), lambda y: trim(y) <> '')) > 1)[1] as s from records where trim(author) <> '' order by row_id limit 1)""",
)
add(
    "k26_column_shares",
    "records",
    lambda df: aggregate.separator_shares(df, "author"),
    " union all ".join(f"select '{s}' as separator, 'literal' as type, round(avg(contains(author, '{s}')::int), 4) as share, coalesce(avg(contains(author, '{s}')::int) > 0.8, false) as chosen from records where trim(author) <> ''" for s in ("||", "|", ";;", ";", ",,", ",", ".")),
)
