"""Queries of validation, crosswalks, joins, windows, sets, search, retrieval and metrics, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import errors, providers
from ..operators import aggregate, crosswalk, enrich, evaluate, join, metrics, retrieve, sanitize, search, text_index, transaction, tree, validate, workflow
from ..schema import GENERIC_FIELDS, checkpoint_folder, dense_numbers, with_row_id, ws_trim
from .views import ctes, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
C = F.col


def add(name: str, views: str, build: Callable[..., DataFrame], sql: str | None = None) -> None:
    """A query over views or tables (apart by blanks), and its SQL after the views among them."""
    from .views import VIEWS

    names = views.split()

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(*(view(spark, sf_dir, n) if n in VIEWS else spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names))

    QUERIES[name] = query
    if sql:
        mine = [n for n in names if n in VIEWS]
        ORACLES[name] = f"{ctes(*mine)}{', ' if sql.startswith('+') else ' '}{sql.lstrip('+')}" if mine else sql


# 2.C validation
add(
    "c3_key_test",
    "records",
    lambda r: validate.key_test(r.select("id", "row_id", "issn", "title", "custkey"), ["id", "row_id", "issn", "title", "custkey"]).select("column", "rows", F.when(C("exact"), C("distinct_values")).alias("distinct_values"), "blanks", "is_key"),
    " union all ".join(
        f"""select '{c}' as "column", rows, case when blanks = 0 and distinct_values > 0.9 * rows then distinct_values end as distinct_values, blanks, rows > 0 and rows = distinct_values and blanks = 0 as is_key
from (select count(*) as rows, count(distinct trim({c}::varchar)) as distinct_values, count(*) filter (where lower(trim({c}::varchar)) in ('', 'nan', 'none')) as blanks from records)"""
        for c in ("id", "row_id", "issn", "title", "custkey")
    ),
)
add("c4_keyed_table", "records orders", lambda r, o: r.sparkSession.createDataFrame([(name, key, t.columns[0]) for name, (t, key) in (("records", validate.keyed_table(r, "row_id")), ("orders", validate.keyed_table(o.select(C("o_custkey").alias("custom_id"), "o_orderkey"), "o_orderkey")))], "name string, key string, first string"), "select 'records' as name, case when count(distinct row_id) = count(*) then 'row_id' when count(distinct id) = count(*) then 'id' end as key, 'row_id' as first from records union all select 'orders', case when count(distinct o_custkey) = count(*) then 'custom_id' else 'id' end, case when count(distinct o_custkey) = count(*) then 'custom_id' else 'id' end from orders")
add("c4_synthetic_key", "records", lambda r: validate.inject_key(r.select("title", "row_id"), "row_id").select("id", "row_id"), "select cast(row_number() over (order by row_id) as string) as id, row_id from records")
# Mappings by their parts, and the columns that these name, in SQL.
_parts = """+parts as (select pos, "left", "replace", trim(unnest(string_split("left", '+'))) as part from mappings),
met as (select pos, "column" from parts join header on "column" like replace(replace(part, '_', '\\_'), '*', '%') escape '\\' where part <> '')
"""
add("c9_drift", "mappings header", crosswalk.drift, _parts + """select 'missing' as kind, "left" as name from mappings where pos not in (select pos from met) union all select 'unmapped', "column" from header where "column" not in (select "column" from met)""")
add("c12_guard_base", "mappings header", lambda m, h: crosswalk.guard_base(m, h).select("pos"), _parts + """select pos from mappings where trim("left") <> '' and trim("replace") <> '' and pos not in (select pos from parts where part <> '' and part not like '%*%' and part not in (select "column" from header))""")
add("c13_guard_generic", "mappings", lambda m: crosswalk.guard_generic(m).select("pos", "replace"), """select pos, "replace" from mappings where lower(trim("replace")) in ('id', 'title', 'author', 'date', 'description', 'subject', 'type', 'subtitle', 'issn', 'doi', 'isbn', 'citation')""")
add(
    "c14_guard_target",
    "targets target_catalog",
    lambda m, c: crosswalk.guard_target(m, c).select("pos", C("replace").alias("target"), "action"),
    """select pos, case when field is not null and lang <> '' and not allow_lang then base when field is not null then r when regexp_matches(lower(base), 'identifier|id') then 'local.identifier.other' end as target,
  case when field is null then case when regexp_matches(lower(base), 'identifier|id') then 'fallback' else 'dropped' end when lang <> '' and not allow_lang then 'stripped' else 'kept' end as action
from (select pos, "replace" as r, regexp_extract("replace", '^([a-zA-Z0-9._-]+)(?:\\[([a-zA-Z]{2})\\])?$', 1) as base, regexp_extract("replace", '^([a-zA-Z0-9._-]+)(?:\\[([a-zA-Z]{2})\\])?$', 2) as lang from targets) left join target_catalog on base = field where base <> ''""",
)
add(
    "c15_compatibility",
    "targets header target_catalog",
    lambda m, h, c: crosswalk.compatibility(m, h, c).select("pos", "status"),
    """+bad as (select pos from (select pos, trim(unnest(string_split("left", '+'))) as part from targets) where part <> '' and part not like '%*%' and part not in (select "column" from header))
select pos, case when pos in (select pos from bad) then 'incompatible' when regexp_extract("replace", '^([^\\[]+)', 1) not in (select field from target_catalog) then 'invalid' else 'valid' end as status from targets""",
)
add("c16_integrity", "records", lambda r: validate.integrity(r, r.where("percent > 0").drop("place"), "id"), "select count(*) as rows_before, count(*) filter (where percent > 0) as rows_after, count(*) filter (where percent = 0) as lost_ids, 1::bigint as lost_columns, false as valid from records")


def _observed(r: DataFrame) -> DataFrame:
    folder = f"{checkpoint_folder(r.sparkSession)}/c16"
    before, after = transaction.write(r, folder, "id"), transaction.write(r.where("percent > 0").drop("place"), folder, "id")
    out = transaction.report(before, after)
    for v in (before, after):
        transaction.dropped(r.sparkSession, v.path)
    return out


add("c16_observed", "records", _observed, "select count(*) as rows_before, count(*) filter (where percent > 0) as rows_after, count(*) filter (where percent = 0) as lost_ids, 1::bigint as lost_columns, false as valid from records")
add("c17_catalog_facets", "target_catalog", validate.catalog_facets, "select 'field' as facet, field from target_catalog union select 'with_language', field from target_catalog where allow_lang union select 'base', split_part(field, '.', 1) || '.' || split_part(field, '.', 2) from target_catalog")

# 2.D crosswalk
_cw = crosswalk.Crosswalk.load([[{"left": "title", "replace": "name", "filter": "trim|lowercase"}, {"left": "author+place", "replace": "people"}, {"left": "is*", "replace": "numbers"}, {"left": "citation", "replace": "source", "default": "none", "required": False}, {"left": "title", "replace": "must", "required": True}, {"left": "absent", "replace": "gone"}], {"original_separator": "|", "replace_separator": ";"}])
_join = lambda *cs: "concat_ws(';', " + ", ".join(f"nullif(trim(replace(trim({c}), '|', ';'), ';'), '')" for c in cs) + ")"
add("d1_crosswalk", "records", lambda r: crosswalk.apply(r, _cw, keep=["row_id"]), f"select row_id, lower(trim(title)) as name, {_join('author', 'place')} as people, {_join('issn', 'isbn')} as numbers, coalesce(nullif({_join('citation')}, ''), 'none') as source, {_join('title')} as must, '' as gone from records where trim(title) <> ''")
add("d2_pruning", "records", lambda r: crosswalk.apply(r, crosswalk.Crosswalk((crosswalk.Mapping("id", "id"),))), "select id from records")
add("d3_rename", "records", lambda r: r.select("row_id", crosswalk.compile_mapping(crosswalk.Mapping("author", "value"), r.columns, crosswalk.Crosswalk((), crosswalk.Settings("|", ";")))), f"select row_id, {_join('author')} as value from records")
add("d4_combine", "records", lambda r: r.select("row_id", crosswalk.compile_mapping(crosswalk.Mapping("title+citation+place", "value"), r.columns, crosswalk.Crosswalk((), crosswalk.Settings("|", ";")))), f"select row_id, {_join('title', 'citation', 'place')} as value from records")
add("d5_wildcard", "records", lambda r: r.select("row_id", crosswalk.compile_mapping(crosswalk.Mapping("is*", "value"), r.columns, crosswalk.Crosswalk((), crosswalk.Settings("|", ";")))), f"select row_id, {_join('issn', 'isbn')} as value from records")
add("d6_wildcards", "records", lambda r: r.select("row_id", crosswalk.compile_mapping(crosswalk.Mapping("is*+pl*", "value"), r.columns, crosswalk.Crosswalk((), crosswalk.Settings("|", ";")))), f"select row_id, {_join('issn', 'isbn', 'place')} as value from records")
add("d7_filters", "records", lambda r: r.select("row_id", crosswalk.value_filters(F.concat(F.lit(" ,"), C("title"), F.lit(", ")), "trim|lowercase").alias("value")), "select row_id, lower(trim(trim(' ,' || title || ', ', ' '), ',')) as value from records")
add("d8_default_required", "records", lambda r: crosswalk.apply(r, crosswalk.Crosswalk((crosswalk.Mapping("title", "title", required=True), crosswalk.Mapping("citation", "citation", default="none"))), keep=["row_id"]), "select row_id, trim(title) as title, coalesce(nullif(trim(citation), ''), 'none') as citation from records where trim(title) <> ''")
add("d10_identity", "records", lambda r: r.select("row_id", *crosswalk.fallback_mappings(r.columns).used_columns(r.columns)).select("row_id", "id", "isbn"), "select row_id, id, isbn from records")
add("d11_compose", "mappings canonical", crosswalk.compose, """select pos, "left", target as "replace" from mappings join canonical on lower(trim("replace")) = field""")
add("d12_remnants", "mappings header", lambda m, h: crosswalk.remnant_columns(h, m), _parts + 'select "column" from header where "column" not in (select "column" from met)')
add("d13_merge", "mappings targets", lambda m, t: crosswalk.merged(t, m).select("left", "replace", "prio"), """select "left", "replace", prio from (select *, row_number() over (partition by "left" order by prio, pos) as rn from (select *, 0 as prio from targets union all select *, 1 from mappings)) where rn = 1""")
add("d17_drop_synthetic", "records", lambda r: r.drop("row_id").select("id"), "select id from records")

# 2.F joins. Folding of the views' titles is by letters of ASCII alone.
_fold = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
_like = lambda a, b: f"(1 - levenshtein({a}, {b})::double / greatest(length({a}), length({b})))"
_edges = f"""+
rr as (select distinct id, {_fold('title')} as t, {_fold('author')} as a, cast(date as int) as y from repository_records),
ss as (select distinct id, {_fold('title')} as t, {_fold('author')} as a, cast(date as int) as y from source_records),
rw as (select *, list_distinct(string_split(t, ' ')) as w from rr where t <> ''), sw as (select *, list_distinct(string_split(t, ' ')) as w from ss where t <> ''),
met as (select rw.id as i1, sw.id as i2, rw.t as t1, sw.t as t2, rw.a as a1, sw.a as a2, abs(rw.y - sw.y) as d, len(list_intersect(rw.w, sw.w)) as n, len(rw.w) + len(sw.w) as m from rw, sw),
edges as (select i1 as id_document1, i2 as id_document2,
    round(100 * (0.6::double * {_like('t1', 't2')} + coalesce(0.3::double * {_like("nullif(a1, '')", "nullif(a2, '')")}, 0) + 0.1::double * case when d = 0 then 1 when d <= 1 then 0.5 else 0 end) / (0.7::double + case when a1 <> '' and a2 <> '' then 0.3::double else 0 end), 4) as similarity
  from met where n >= 0.6 * (m - n) - 1e-9 or length(t1) <= 40 and length(t2) <= 40 and {_like('t1', 't2')} >= 0.9 - 1e-9)
"""
add("f1_dup_edges", "repository_records source_records", lambda r, s: join.duplicate_edges(r, s, digits=2), _edges + "select id_document1, id_document2, round(similarity, 2) as similarity from edges")
_whole = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
_surname, _initial = lambda c: f"trim(lower(split_part({c}, ',', 1)))", lambda c: f"substr(trim(lower(split_part({c}, ',', 2))), 1, 1)"
add(
    "f2_authority",
    "authored authors",
    lambda d, a: join.authority(d, a).select("id", F.array_join(F.transform("coincidences", lambda x: F.concat_ws(":", x["pos"], x["author_id"], join.rounded(x["score"], 2).cast("decimal(9,2)"), x["label"])), ";").alias("coincidences")),
    f"""+names as (select id, pos, name from (select id, unnest(string_split(author, '|')) as name, unnest(range(len(string_split(author, '|')))) as pos from authored)),
one as (select distinct name, {_surname('name')} as s, {_initial('name')} as i, {_whole('name')} as f from names where trim(name) <> ''),
variants as (select distinct author_id, {_surname('v')} as s, {_initial('v')} as i, {_whole('v')} as f from (select author_id, unnest(string_split(variants, '|||')) as v from authors)),
hits as (select name, author_id, max(round(100 * {_like('o.f', 'v.f')}, 4)) as score from one o join variants v on o.i = v.i and abs(length(o.s) - length(v.s)) <= 1 and levenshtein(o.s, v.s) <= 1 group by all),
good as (select *, case when score >= 100 then 'PERFECT' when score >= 90 then 'GOOD' when score >= 75 then 'REGULAR' else 'MMM' end as label from hits where score >= 60)
select n.id, coalesce(string_agg(pos || ':' || author_id || ':' || printf('%.2f', round(score, 2)) || ':' || label, ';' order by pos, score desc, author_id), '') as coincidences from names n left join good g on n.name = g.name group by n.id""",
)
add("f3_anti_reconcile", "source_records repository_records", lambda s, r: join.unmatched(s, r, threshold=60.0).select("id"), _edges + "select id from source_records where id not in (select id_document2 from edges where similarity >= 60)")
add("f4_semi_reconcile", "records", lambda r: join.below_threshold(r, r.select("id", F.when(C("percent") % 9 == 0, "bad").otherwise(C("percent").cast("string")).alias("total"))).select("id"), "select id from records where percent < 10 or percent % 9 = 0")
add("e5_below_threshold", "records", lambda r: join.below_threshold(r, r.select("id", C("percent").cast("string").alias("total")), threshold=30.0).agg(F.count("*").alias("n")), "select count(*) as n from records where percent < 30")
add("f5_fill_blank", "records", lambda r: join.fill_blank(r.select("row_id", "id", "author", "type", "place"), r.select(C("row_id").alias("_row_id"), "id", C("title").alias("author"), C("language").alias("type")), "id", ["author", "type"], {"type": "place"}).select("row_id", "author", "type", "place"), "select row_id, " + ", ".join(f"case when coalesce({c}, '') in ('', 'nan', 'None') and {g} not in ('', 'nan', 'None') then {g} else {c} end as {c}" for c, g in (("author", "title"), ("type", "language"), ("place", "language"))) + " from records")
add("f6_replay", "records", lambda r: join.replay(r.select("id", "title", "author"), r.where("percent < 20").select(C("row_id").alias("seq"), C("id").alias("row_id"), F.when(C("percent") % 2 == 0, "title").otherwise("author").alias("column"), F.upper("id").alias("cleaned")).unionByName(r.where("percent < 5").select((C("row_id") + 10**9).alias("seq"), C("id").alias("row_id"), F.lit("title").alias("column"), F.lit("last").alias("cleaned"))), "id", ["title", "author"]), "select id, case when percent < 5 then 'last' when percent < 20 and percent % 2 = 0 then upper(id) else title end as title, case when percent < 20 and percent % 2 = 1 then upper(id) else author end as author from records")
add(
    "e5_by_position",
    "records",
    lambda r: join.below_threshold(r.select("row_id", "title"), r.select("row_id", F.when(C("percent") % 9 > 0, C("percent")).cast("string").alias("score")), None, 30.0, "row_id").select("row_id"),
    "select row_id from records where percent < 30 or percent % 9 = 0",
)
add(
    "f7_samples",
    "records customer",
    lambda r, c: join.sample_values(
        join.lookup_join(r.select("row_id", C("custkey").cast("string").alias("k")), "k", c.select(C("c_custkey").cast("string").alias("k"), "c_name", "c_mktsegment"), ["c_name", "c_mktsegment"]),
        "row_id",
        ["inferred_c_name", "inferred_c_mktsegment"],
    ),
    """+found as (select row_id, unnest([{'f': 'inferred_c_name', 'v': c_name}, {'f': 'inferred_c_mktsegment', 'v': c_mktsegment}]) as x from records join customer on custkey = c_custkey)
select field, position, value from (select x.f as field, x.v as value, row_number() over (partition by x.f order by min(row_id), x.v) as position from found where x.v <> '' group by x.f, x.v) where position <= 5""",
)
add(
    "p3_seeded",
    "embeddings",
    lambda e: search.seeded(e.select("vec_id", "label"), e.select((-C("vec_id")).alias("vec_id"), "label")).unionByName(
        search.seeded(e.where("vec_id < 0").select("vec_id", "label"), e.select((-1 - C("vec_id")).alias("vec_id"), "label"))
    ),
    "select vec_id, label from embeddings union all select -1 - vec_id, label from embeddings",
)
add("f7_lookup", "records customer", lambda r, c: join.lookup_join(r.select("row_id", C("custkey").cast("string").alias("k")), "k", c.select(C("c_custkey").cast("string").alias("k"), "c_name"), ["c_name"]).select("row_id", "inferred_c_name"), "select row_id, c_name as inferred_c_name from records left join customer on custkey = c_custkey")
add("f8_restore_order", "records", lambda r: r.where("percent >= 50").unionByName(r.where("percent < 50")).orderBy("row_id").select("row_id"), "select row_id from records order by row_id")
add("f9_merge_decisions", "records", lambda r: join.merge_decisions(r.select("id", "title", "type"), r.where("percent < 10").select("id", F.lit("decided").alias("title"), F.lit("").alias("type")), "id", ["title", "type"]), "select id, case when percent < 10 then 'decided' else title end as title, type from records")
add("f10_row_sync", "records", lambda r: join.row_sync(r.select(C("row_id").alias("_row_id"), C("title").alias("Item Title")), r.where("percent < 50").select(C("row_id").alias("_row_id"), "id"), {"id": "Item Title"}), "select row_id as _row_id, case when percent < 50 then id else title end as \"Item Title\" from records")
add("f11_prefilter", "records", lambda r: join.exact_matches(r.where("percent < 50").select("id", "doi", "title", "date"), r.where("percent >= 50").select("doi", "title", "date"), [["doi"], ["title", "date"]]).select("id"), "select id from records a where percent < 50 and (lower(trim(doi)) not in ('', 'nan', 'none') and exists (select 1 from records b where b.percent >= 50 and b.doi = a.doi) or lower(trim(title)) not in ('', 'nan', 'none') and lower(trim(date)) not in ('', 'nan', 'none') and exists (select 1 from records b where b.percent >= 50 and b.title = a.title and b.date = a.date))")

# 2.G to 2.J
add("g4_provider_counts", "records", lambda r: enrich.counts(r.select(F.when(C("percent") < 30, "press").when(C("percent") < 40, "index").alias("provider"))), "select case when percent < 30 then 'press' when percent < 40 then 'index' else 'none' end as provider, count(*) as n from records group by 1")
add("g5_distinct_ids", "lineitem", lambda li: li.select(C("l_partkey").cast("long").alias("id")).distinct(), "select distinct cast(l_partkey as bigint) as id from lineitem")
add("g6_best_per_source", "documents", lambda d: aggregate.best_per_group(d, "source", "n_chars"), "select source, min(n_chars) as n_chars from documents group by source")
add("g7_merge_hits", "works", lambda w: aggregate.merge_hits([w.select(C("work_id").alias("chunk_id"), C("price").alias("score"), F.lit("a").alias("backend")), w.where("pages < 25").select(C("work_id").alias("chunk_id"), (C("price") + 1).alias("score"), F.lit("b").alias("backend"))]), "select work_id as chunk_id, case when pages < 25 then price + 1 else price end as score, case when pages < 25 then 'b' else 'a' end as backend from works")
add("h1_row_number", "records", lambda r: dense_numbers(r.select("row_id"), "row_id", "n"), "select row_id, row_number() over (order by row_id) as n from records")
add("h2_fill_id", "records", lambda r: sanitize.sanitize_columns(r.select(C("row_id").alias("_row_id"), F.when(C("percent") % 3 == 0, " nan ").otherwise(F.concat(F.lit(" "), C("id"))).alias("id"))).select(C("_row_id").alias("row_id"), "id"), "select row_id, case when percent % 3 = 0 then 'item_' || (row_id + 1) else id end as id from records")
add("h2_row_ids", "documents", lambda d: with_row_id(d.select("doc_id")).agg(F.count_distinct("_row_id").alias("n"), F.min("_row_id").alias("least"), F.max("_row_id").alias("most")), "select count(*) as n, 0::bigint as least, count(*) - 1 as most from documents")
add("h3_item_folder", "records", lambda r: dense_numbers(r.select("row_id"), "row_id", "n").select("row_id", F.format_string("item_%03d", "n").alias("folder")), "select row_id, printf('item_%03d', row_number() over (order by row_id)) as folder from records")
add("h4_first_per_key", "orders", lambda o: join.first_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey"), "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn from orders) where rn = 1")
add("h6_zscore", "works", lambda w: aggregate.z_scores(w.select("work_id", "price"), "price").select("work_id", "z"), "select work_id, round((price - avg(price) over ()) / stddev_samp(price) over (), 4) as z from works")
add("i1_original_order", "orders", lambda o: o.orderBy("o_orderkey").select("o_orderkey"), "select o_orderkey from orders order by 1")
add("i2_topk_threshold", "works", lambda w: aggregate.top_k(w, "price", "work_id", 2, limit=950.0).select("work_id", "price"), "select work_id, price from works where price <= 950 order by price, work_id limit 2")
add("i3_candidates", "works", lambda w: aggregate.top_k(w, "price", "work_id", 15).select("work_id"), "select work_id from works order by price, work_id limit 15")
add("i4_hits_desc", "works", lambda w: aggregate.top_k(w, "price", "work_id", 7, ascending=False).select("work_id", "price"), "select work_id, price from works order by price desc, work_id limit 7")
add("i5_first_rows", "records", lambda r: r.orderBy("row_id").limit(5).select("row_id", "id"), "select row_id, id from records order by row_id limit 5")
add("i6_offset_page", "works", lambda w: aggregate.page_of(w, ["title", "work_id"], 3, 20).select("work_id"), "select work_id from works order by title, work_id limit 20 offset 60")
add("i6_keyset_page", "works", lambda w: aggregate.keyset_page(w, "work_id", 100, 20).select("work_id"), "select work_id from works where work_id > 100 order by work_id limit 20")
add("i7_capped_page", "works", lambda w: aggregate.page_of(w, ["work_id"], 0, 5000, cap=1000).agg(F.count("*").alias("n")), "select least(count(*), 1000) as n from works")
add("j1_branch_union", "records", lambda r: r.where("percent < 50").select("id", "title").unionByName(r.where("percent >= 50").select("id"), allowMissingColumns=True), "select id, title from records where percent < 50 union all select id, null from records where percent >= 50")
add("j2_difference", "lineitem orders", lambda li, o: o.select(C("o_orderkey").alias("k")).exceptAll(li.select(C("l_orderkey").alias("k")).distinct()), "select o_orderkey as k from orders where o_orderkey not in (select l_orderkey from lineitem)")
add("j2_intersection", "customer orders", lambda c, o: c.select(C("c_custkey").alias("k")).intersect(o.select(C("o_custkey").alias("k"))), "select c_custkey as k from customer intersect select o_custkey from orders")
add("j3_key_union", "nation region", lambda n, r: n.select(C("n_name").alias("name"), C("n_regionkey").alias("parent")).unionByName(r.select(C("r_name").alias("name")), allowMissingColumns=True), "select n_name as name, n_regionkey as parent from nation union all select r_name, null from region")
add("j5_distinct_dois", "records", lambda r: r.select(F.lower("doi").alias("doi")).where("doi != ''").distinct(), "select distinct lower(doi) as doi from records where doi <> ''")


# 2.L enrichment chain
def _chain(r: DataFrame, w: DataFrame) -> DataFrame:
    press = enrich.Provider("press", "doi", r.where("percent < 40 and doi != ''").select("doi", F.lit("Press").alias("citation"), F.lit("").alias("type")))
    index = enrich.Provider("index", "issn", r.sparkSession.createDataFrame([("1234567X", "Index", "Revista")], "issn string, citation string, type string"))
    down = enrich.Provider("down", "isbn", w.select(C("doi").alias("isbn")), available=False)
    return enrich.chain(r.select("row_id", "doi", "issn", "isbn", "citation", "type"), [press, index, down], ["citation", "type"]).select("row_id", "citation", "type", "provider")


_k = "lower(regexp_replace(doi, '^\\s*(https?://(dx\\.)?doi\\.org/|doi:\\s*)', '', 'i'))"
_e = lambda c: f"coalesce({c}, '') in ('', 'nan', 'None')"
add("l1_chain", "records works", _chain, f"+p as (select distinct {_k} as k from records where percent < 40 and doi <> ''), h as (select r.*, case when p.k is not null then 'press' when issn <> '' then 'index' end as provider from records r left join p on {_k} = p.k) select row_id, case when {_e('citation')} and provider = 'press' then 'Press' when {_e('citation')} and provider = 'index' then 'Index' else citation end as citation, case when {_e('type')} and provider = 'index' then 'Revista' else type end as type, provider from h")

# 2.O search
_f = {"min-pages": "pages", "pages": "pages", "kind": "kind", "publisher": "publisher", "doi": "doi", "title": "title", "price": "price"}
add("o1_works_search", "works", lambda w: search.search(w, "work_id", "ring", ["title"], "from-pages:10,kind:ECONOMY,has-doi:true", _f, ["work_id", "title", "pages"], "pages:desc", rows=30, offset=2), "select work_id, title, pages from works where pages >= 10 and kind = 'ECONOMY' and doi is not null and contains(lower(title), 'ring') order by pages desc, work_id limit 30 offset 2")
add("o2_lookup", "works", lambda w: search.lookup(w, "doi", "10.28/1").select("work_id", "title"), "select work_id, title from works where doi = '10.28/1'")
for _name, _dim, _on, _sql in (("o3_journal_works", "part", "partkey", "p_brand = 'Brand#2'"), ("o4_funder_works", "part", "partkey", "p_size > 45"), ("o5_member_works", "supplier", "suppkey", "s_acctbal > 9000"), ("o8_institution_works", "supplier", "suppkey", "s_nationkey = 3"), ("o9_author_works", "supplier", "suppkey", "s_name like '%7'")):
    _p = _dim[0]
    add(_name, f"lineitem {_dim}", lambda li, d, on=_on, p=_p, w=_sql: search.works_of(li.withColumnRenamed(f"l_{on}", f"{p}_{on}"), d, f"{p}_{on}", F.expr(w)).select("l_orderkey", "l_linenumber"), f"select l_orderkey, l_linenumber from lineitem where l_{_on} in (select {_p}_{_on} from {_dim} where {_sql})")
add("o6_prefix", "works", lambda w: search.prefixed(w, "doi", "10.28/").select("work_id"), "select work_id from works where starts_with(doi, '10.28/')")
add("o7_types", "works", lambda w: search.distinct_values(w, "kind"), "select distinct kind from works")
add("o10_filter_sort", "works", lambda w: search.search(w, "work_id", where="publisher:Brand#2,until-price:1500", fields=_f, select=["work_id", "price"], sort="price:desc", rows=25), "select work_id, price from works where publisher = 'Brand#2' and price <= 1500 order by price desc, work_id limit 25")
add("o11_query_language", "works", lambda w: w.where(search.parse_query('title:ring AND (kind:economy OR "red widget") pages:[5 TO 40] NOT publisher:"brand#1"', _f, ["title"])).select("work_id"), "select work_id from works where contains(lower(title), 'ring') and (contains(lower(kind), 'economy') or contains(lower(title), 'red widget')) and pages >= 5 and pages <= 40 and not contains(lower(publisher), 'brand#1')")
add("o12_article_by_doi", "works", lambda w: search.lookup(w, "doi", "10.11/0").select("work_id"), "select work_id from works where doi = '10.11/0'")
add("o13_discovery", "works", lambda w: search.search(w.where(C("kind") == "ECONOMY"), "work_id", "red", ["title"], rows=20, offset=20, select=["work_id"]), "select work_id from works where kind = 'ECONOMY' and contains(lower(title), 'red') order by work_id limit 20 offset 20")
add("o14_collections", "nation", lambda n: n.orderBy("n_nationkey").limit(20).select("n_nationkey", "n_name"), "select n_nationkey, n_name from nation order by n_nationkey limit 20")
add("o15_tree", "nation region", lambda n, r: search.children(n, "n_regionkey", 1).join(r, C("n_regionkey") == C("r_regionkey")).select("r_name", "n_name"), "select r_name, n_name from nation join region on n_regionkey = r_regionkey where n_regionkey = 1")
add("o16_upsert", "nation", lambda n: search.upsert(n, n.where("n_nationkey < 3").withColumn("n_name", F.lower("n_name")), "n_nationkey"), "select n_nationkey, case when n_nationkey < 3 then lower(n_name) else n_name end as n_name, n_regionkey from nation")
add("o16_bundles", "orders lineitem", lambda o, li: search.bundles(o.select(C("o_orderkey").alias("k")), li.select(C("l_orderkey").alias("k"), "l_returnflag"), "k").groupBy("k", "l_returnflag").agg(F.count("*").alias("n")), "select l_orderkey as k, l_returnflag, count(*) as n from lineitem where l_orderkey in (select o_orderkey from orders) group by all")
add("o17_persons", "customer", lambda c: search.lookup(c, "c_name", "Customer#000000007").select("c_custkey"), "select c_custkey from customer where c_name = 'Customer#000000007'")
add("o18_workflow_status", "orders", lambda o: aggregate.page_of(o.where("o_orderstatus = 'P'"), ["o_orderdate", "o_orderkey"], 1, 20).select("o_orderkey"), "select o_orderkey from orders where o_orderstatus = 'P' order by o_orderdate, o_orderkey limit 20 offset 20")
add("o2_agency", "works", lambda w: search.agency(w, "doi", w.sparkSession.createDataFrame([("10.1", "Alpha"), ("10.28", "Beta"), ("10.28", "Gamma")], "prefix string, agency string")).select("work_id", "agency"), "select work_id, case split_part(doi, '/', 1) when '10.1' then 'Alpha' when '10.28' then 'Beta' end as agency from works")
add("o7_licenses", "works", lambda w: search.licenses(w, "kind"), "select kind as license, count(*) as works from works where kind is not null group by kind")
add("o3_journals_search", "supplier", lambda s: search.search(s, "s_suppkey", "supplier 1", ["s_name"], sort="s_name:desc", rows=10, select=["s_suppkey", "s_name"]), "select s_suppkey, s_name from supplier where contains(lower(s_name), 'supplier') and contains(lower(s_name), '1') order by s_name desc, s_suppkey limit 10")
add("o1_scoped_text", "works", lambda w: search.search(w, "work_id", scoped={"title": "a", "publisher": "brand#1"}, rows=50, select=["work_id"]), "select work_id from works where contains(lower(title), 'a') and contains(lower(publisher), 'brand#1') order by work_id limit 50")
add("o1_cursor", "works", lambda w: search.search(w, "work_id", sort="pages:desc", cursor=(25, 40), rows=20, select=["work_id", "pages"]), "select work_id, pages from works where pages < 25 or pages = 25 and work_id > 40 order by pages desc, work_id limit 20")
add("o16_update_archived", "nation", lambda n: search.replace_archived(n.withColumn("archived", C("n_regionkey") != 2), n.where("n_nationkey < 12").withColumn("n_name", F.lower("n_name")).withColumn("archived", F.lit(True)), "n_nationkey", "archived").select("n_nationkey", "n_name", "archived"), "select n_nationkey, case when n_nationkey < 12 and n_regionkey <> 2 then lower(n_name) else n_name end as n_name, n_regionkey <> 2 as archived from nation")


def _o18_transitions(orders: DataFrame) -> DataFrame:
    states, actions = F.array(*map(F.lit, ("workspace", "pool", "claimed"))), F.array(*map(F.lit, ("submit", "claim", "approve", "reject", "unclaim", "expunge", "return")))
    items = orders.select(C("o_orderkey").alias("id"), F.get(states, (C("o_orderkey") % 3).cast("int")).alias("state"), (C("o_custkey") % 2 == 0).alias("reviewed"))
    early = orders.select(C("o_orderkey").alias("id"), F.lit(1).alias("pos"), F.get(actions, (C("o_custkey") % 8).cast("int")).alias("action"))
    late = orders.select(C("o_orderkey").alias("id"), F.lit(2).alias("pos"), F.lit("claim").alias("action")).where("id % 5 > 0")
    return workflow.apply_actions(items, early.unionByName(late), reviewed="reviewed").drop("reviewed")


_O18_SQL = """
select id, case
  when action = 'submit' and state = 'workspace' then case when reviewed then 'pool' else 'archived' end
  when action = 'claim' and state = 'pool' then 'claimed'
  when action = 'approve' and state = 'claimed' then 'archived'
  when action = 'reject' and state = 'claimed' then 'workspace'
  when action = 'unclaim' and state = 'claimed' then 'pool'
  when action = 'expunge' and state <> 'workspace' then 'deleted'
  when action = 'return' and state <> 'workspace' then 'workspace'
  else state end as state,
  case when action = '' then null
  when action = 'submit' and state = 'workspace' or action = 'claim' and state = 'pool' then 'done'
  when action in ('approve', 'reject', 'unclaim') and state = 'claimed' or action in ('expunge', 'return') and state <> 'workspace' then 'done'
  else 'refused' end as outcome
from (
  select o_orderkey as id, case o_orderkey % 3 when 0 then 'workspace' when 1 then 'pool' else 'claimed' end as state, o_custkey % 2 = 0 as reviewed,
    case o_custkey % 8 when 0 then 'submit' when 1 then 'claim' when 2 then 'approve' when 3 then 'reject' when 4 then 'unclaim' when 5 then 'expunge' when 6 then 'return'
      else case when o_orderkey % 5 > 0 then 'claim' else '' end end as action
  from orders)"""

add("o18_transitions", "orders", _o18_transitions, _O18_SQL)

# 2.P retrieval: the query is a fixed vector, so that both engines start alike.
_q = [((i * 37) % 17 - 8) / 8.0 for i in range(64)]
_list = "[" + ", ".join(f"{x}" for x in _q) + "]::double[]"
_cos = f"round(greatest(0.0, least(1.0, list_cosine_similarity(embedding::double[], {_list}))), 6)"
add("p1_cosine_topk", "embeddings", lambda e: retrieve.cosine_top_k(e, "embedding", _q, "vec_id", 10, {"label": 3}).select("vec_id", "similarity"), f"select vec_id, {_cos} as similarity from embeddings where label = 3 order by similarity desc, vec_id limit 10")
add("p2_two_tier", "embeddings", lambda e: retrieve.two_tier(e, "embedding", _q, "vec_id", {"label": 3}, {}, 2, 0.9, 0.05).select("vec_id", "similarity", "tier"), f"with s as (select vec_id, label, {_cos} as similarity from embeddings), a as (select *, 1 as tier from s where label = 3 order by similarity desc, vec_id limit 2), b as (select *, 2 as tier from s order by similarity desc, vec_id limit 2), g as (select coalesce(max(similarity) >= 0.9, false) as good from a) select vec_id, similarity, tier from (select * from a union all select * from b), g where tier = case when good then 1 else 2 end and similarity >= 0.05")
add("p3_upsert", "embeddings", lambda e: search.upsert(e.select("vec_id", "label"), e.where("vec_id < 10").select("vec_id", F.lit(99).alias("label")), "vec_id"), "select vec_id, case when vec_id < 10 then 99 else label end as label from embeddings")
add("p4_l2_documents", "embeddings documents", lambda e, d: retrieve.l2_documents(e.select("vec_id", "embedding", C("vec_id").alias("doc_id")), "embedding", _q, "doc_id", d.select("doc_id", "source"), limit=9.0), f"with n as (select vec_id as doc_id, round(list_distance(embedding::double[], {_list}), 6) as distance from embeddings order by distance, vec_id limit 15), b as (select * from n where distance <= 9.0 order by distance, doc_id limit 2) select b.doc_id, distance, source from b join documents using (doc_id)")
add("p5_format_hits", "works", lambda w: retrieve.format_hits(aggregate.top_k(w, "price", "work_id", 5), "work_id", "price").select("line"), "select printf('[%d] %.3f', work_id, price) as line from works order by price, work_id limit 5")

# 2.T metrics
add("t1_mapping_metrics", "mappings expected header canonical", lambda m, e, h, c: metrics.mapping_metrics(m.select("left", "replace"), e.select("left", "replace"), h, c.select("field").distinct()), """+parts as (select trim(unnest(string_split("left", '+'))) as part from mappings)
select (select round(avg((part in (select "column" from header))::int), 4) from parts) as header_fidelity, (select round(avg((field in (select "replace" from mappings))::int), 4) from (select distinct field from canonical)) as critical_coverage,
  (select round(avg((("left", "replace") in (select "left", "replace" from mappings))::int), 4) from expected) as mapping_accuracy""")
add("t4_escalation_matrix", "records", lambda r: metrics.escalation_matrix(r, C("percent") < 50, C("percent") % 2 == 0), "select case when percent < 50 and percent % 2 = 0 then 'correct_escalation' when percent >= 50 and percent % 2 = 1 then 'correct_auto' when percent % 2 = 0 then 'over_caution' else 'missed_escalation' end as outcome, count(*) as n from records group by 1")
add("t6_never_grows", "records", lambda r: metrics.never_grows([("all", r), ("some", r.where("percent < 50")), ("more", r.where("percent < 60"))]), "select 0 as step, 'all' as name, count(*) as rows, true as ok from records union all select 1, 'some', count(*), true from records where percent < 50 union all select 2, 'more', count(*), false from records where percent < 60")
add("t1_schema_adherence", "mappings", lambda m: metrics.schema_adherence(m, m.sparkSession.createDataFrame([(f,) for f in GENERIC_FIELDS], "field string")), """select round(avg(("replace" in ('id', 'title', 'author', 'date', 'description', 'subject', 'type', 'subtitle', 'issn', 'doi', 'isbn', 'citation'))::int), 4) as schema_adherence from mappings where trim("replace") <> ''""")
add("t2_token_exactness", "values_list", lambda v: metrics.token_exactness(v.withColumn("wanted", F.array("p_brand", "p_type", "p_brand")), "many", r"\|+", "wanted"), "select round(avg((p_partkey % 4 <> 0)::int), 4) as token_exactness from part")
add("t3_target_conformance", "targets target_catalog", metrics.target_conformance, """select round(avg(coalesce(field is not null and (lang = '' or allow_lang), false)::int), 4) as target_conformance from (select regexp_extract("replace", '^([a-zA-Z0-9._-]+)(?:\\[([a-zA-Z]{2})\\])?$', 1) as base, regexp_extract("replace", '^([a-zA-Z0-9._-]+)(?:\\[([a-zA-Z]{2})\\])?$', 2) as lang from targets) left join target_catalog on base = field""")
add("t3_core_preservation", "mappings targets", metrics.core_preservation, """select round(avg(("left" in (select "left" from targets))::int), 4) as core_preservation from (select distinct "left" from mappings)""")
add("t3_forbidden_absence", "mappings canonical", lambda m, c: metrics.forbidden_absence(m, c.select("target").union(c.select("field")).distinct().withColumnRenamed("target", "field")), """select round(avg((f not in (select "replace" from mappings))::int), 4) as forbidden_absence from (select target as f from canonical union select field from canonical)""")
add("t4_agreement", "records", lambda r: metrics.agreement(r, F.when(C("percent") < 40, "merge").otherwise("keep"), F.when(C("percent") < 30, "merge").otherwise("keep")), "select round(avg((percent < 30 or percent >= 40)::int), 4) as agreement from records")
add("t4_calibration", "records", lambda r: metrics.calibration(r, C("percent") / 100, C("percent") % 3 == 0), "select cast(floor(percent / 10.0) as int) as bin, count(*) as n, round(avg(percent / 100.0), 4) as confidence, round(avg((percent % 3 = 0)::int), 4) as accuracy from records group by 1")
add("t5_cell_preservation", "records", lambda r: metrics.cell_preservation(r, r.where("percent > 0").withColumn("title", F.upper("title")), "row_id", ["title", "doi"]), """select round(avg((percent > 0 and (f = 'doi' or v = upper(v)))::int), 4) as cell_preservation from (select percent, 'title' as f, title as v from records union all select percent, 'doi', doi from records) where v <> ''""")


def _crossref(w: DataFrame) -> DataFrame:
    """Works written as a DOI registry would, and read back."""
    names = F.struct(C("publisher").alias("family"), C("kind").alias("given"))
    work = F.struct(
        F.array("title").alias("title"), F.array(names, names).alias("author"), F.struct(F.array(F.array("pages", F.lit(5))).alias("date-parts")).alias("published"), C("publisher"), C("kind").alias("type"), F.array("doi").alias("container-title")
    )
    return w.select("work_id", providers.crossref(F.to_json(work)).alias("x")).select("work_id", "x.*")


add(
    "l5_crossref",
    "works",
    _crossref,
    "select work_id, title, publisher || ', ' || kind || ' || ' || publisher || ', ' || kind as authors, cast(pages as string) as year, publisher, '' as issn, kind as type, '' as abstract_en, doi as journal from works",
)
add(
    "l5_openlibrary",
    "works",
    lambda w: w.select("work_id", providers.openlibrary(F.to_json(F.struct("title", C("kind").alias("subtitle"), F.array(F.struct(C("publisher").alias("name"))).alias("publishers"), F.concat(F.lit("May "), C("pages") + 1970).alias("publish_date"), C("pages").alias("number_of_pages")))).alias("x")).select("work_id", "x.title", "x.publisher", "x.year", "x.pages", "x.subjects", "x.type"),
    "select work_id, title || ': ' || kind as title, publisher, cast(1970 + pages as string) as year, nullif(cast(pages as string), '0') as pages, '' as subjects, 'Libro' as type from works",
)
_used = "case percent % 4 when 0 then array() when 1 then array('fix') when 2 then array('fix', 'look') else array('fix', 'look', 'drop') end"
add(
    "t5_tool_selection",
    "records",
    lambda r: r.select("row_id", metrics.tool_selection(F.expr("case when percent % 3 = 0 then array() else array('fix', 'look') end"), F.expr("array('drop')"), F.expr(_used)).alias("right")),
    "select row_id, case when percent % 3 = 0 then percent % 4 = 0 else percent % 4 = 2 end as \"right\" from records",
)

# Evaluation cases: eight rows of the views of mappings are a case
def _mapping_cases(m: DataFrame, e: DataFrame) -> DataFrame:
    """A row a case: its mappings in order, and what is expected of it, by the place in the case."""

    def listed(df: DataFrame, name: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct("pos", F.col("left"), F.col("replace"), (C("pos") % 3 == 0).alias("required"))))
        return df.groupBy(F.floor(C("pos") / 8).alias("case")).agg(rows.alias(name))

    return listed(m, "m").join(listed(e, "e"), "case")


def _expected(places: int, rest: int) -> Column:
    return F.transform(F.filter("e", lambda x: x["pos"] % places == rest), lambda x: F.struct(x["left"], x["replace"]))


add(
    "t3_configuration",
    "mappings expected",
    lambda m, e: _mapping_cases(m, e).select(
        "case",
        F.round(evaluate.pairs_kept(C("m"), _expected(2, 0)), 4).alias("kept"),
        evaluate.configuration_repaired(C("m"), _expected(8, 4), F.transform(_expected(4, 1), lambda x: F.concat(x["left"], F.lit("*"))), F.lit(None).cast(evaluate.PAIRS)).alias("repaired"),
    ),
    """+held as (select pos // 8 as k, trim("left") as l, max_by(trim("replace"), pos) as r from mappings group by 1, 2),
asked as (select e.pos // 8 as k, e.pos, "replace" as f, r from expected e left join held h on h.k = e.pos // 8 and h.l = e."left" || case when pos % 4 = 1 then '*' else '' end)
select k as "case", round(avg(coalesce(r = f, false)::int) filter (where pos % 2 = 0), 4) as kept,
  case when coalesce(bool_and(coalesce(r = f, false)) filter (where pos % 8 = 4), true) and coalesce(bool_and(r is null) filter (where pos % 4 = 1), true) then 1.0 else 0.0 end as repaired
from asked where pos % 2 = 0 or pos % 4 = 1 group by k""",
)
add(
    "t2_feedback_recovery",
    "mappings expected",
    lambda m, e: _mapping_cases(m, e).select(
        "case",
        evaluate.feedback_recovered(C("m"), _expected(8, 1)["replace"], _expected(8, 2), F.lit(None).cast(evaluate.NAMES), F.array(F.lit("weird")), _expected(8, 5)["replace"]).alias("recovered"),
    ),
    """+held as (select pos // 8 as k, "replace" as f, max_by("left", pos) as l, max_by(pos % 3 = 0, pos) as required from mappings group by 1, 2),
asked as (select e.pos // 8 as k, e.pos % 8 as place, e."left" as was, h.l, h.required from expected e left join held h on h.k = e.pos // 8 and h.f = e."replace"),
weird as (select distinct k from held where f = 'weird')
select k as "case", case when bool_and(case place when 1 then l is not null when 2 then coalesce(lower(l) = lower(was), false) when 5 then not coalesce(required, false) else true end)
  and k not in (select k from weird) then 1.0 else 0.0 end as recovered from asked group by k""",
)
add(
    "t2_splitting",
    "values_list",
    lambda v: v.select(
        "row_id",
        evaluate.splitting_exact(
            F.when(C("row_id") % 3 == 0, r"\|+").when(C("row_id") % 3 == 1, ";").otherwise("("),
            F.array("many"),
            F.array(F.array("p_brand", "p_type", "p_brand")),
            F.lit(0.5),
            C("row_id") % 5 == 0,
        ).alias("score"),
    ),
    """select row_id, case when row_id % 5 = 0 then (row_id % 3 = 1)::int else (row_id % 3 = 0 and row_id % 4 <> 0)::int end::double as score from values_list""",
)
_CASES = {
    "extraction": "percent % 2 = 1 or not regexp_matches(date, '\\d{4}')",
    "action": "case when percent < 30 then percent % 2 = 0 and percent % 3 <> 0 when percent < 60 then percent % 3 = 0 and percent % 2 <> 0 else percent % 2 = 0 or percent % 3 = 0 end",
    "repair": "case when percent < 50 then percent % 4 > 0 and percent % 5 <> 0 and place in ('La Plata', '') end",
    "rules": "case when percent % 3 > 0 then percent % 3 = 1 and contains(lower(title), 'work') end",
    "notes": "trim(place) <> ''",
}
add(
    "t4_recovery_scores",
    "records",
    lambda r: evaluate.summary(
        r,
        {
            "extraction": evaluate.extraction_exact(F.when(C("percent") % 2 == 1, r"(\d{4})").otherwise("("), F.array(F.struct(C("date").alias("value"), F.regexp_extract("date", r"\d{4}", 0).alias("expected")))),
            "action": evaluate.action_right(C("percent") < 30, C("percent") < 60, C("percent") % 2 == 0, C("percent") % 3 == 0),
            "repair": evaluate.repair_done(
                C("percent") < 50, F.lit("ok"), C("percent") % 4, C("percent") % 5 != 0, F.create_map("id", "place"), F.array(F.struct("id", F.array(F.lit("La Plata"), F.lit("")).alias("values")))
            ),
            "rules": evaluate.rules_named(
                F.create_map(F.lit("June"), C("title")), F.when(C("percent") % 3 == 1, F.array(F.lit("JUNE"))).when(C("percent") % 3 == 2, F.array(F.lit("may"))), F.array(F.lit("WORK"))
            ),
            "notes": evaluate.has_notes(C("place")),
        },
    ),
    "+scored as (" + " union all ".join(f"select '{n}' as metric, ({sql})::int as v from records" for n, sql in _CASES.items()) + ")\n"
    "select metric, count(v) as cases, round(avg(v), 4) as mean, count(*) filter (where v = 1) as whole from scored group by metric",
)
add(
    "t4_memory_effect",
    "records",
    lambda r: r.groupBy(
        evaluate.memory_effect(
            F.when(C("percent") % 4 == 1, "relevant").when(C("percent") % 4 == 2, "distractor").when(C("percent") % 4 == 3, "mixed").otherwise("none"), C("percent") < 80, C("percent") % 3 > 0, C("place") == "nan"
        ).alias("effect")
    ).agg(F.count("*").alias("n")),
    """select case percent % 4 when 1 then case when plain and sure then 'transferred' else 'not_transferred' end when 2 then case when plain then 'ignored' else 'contaminated' end
  when 3 then case when plain and sure then 'told_apart' else 'confused' end end as effect, count(*) as n from (select percent, percent < 80 and place <> 'nan' as plain, percent % 3 > 0 as sure from records) group by 1""",
)


# Search by relevance. Scores are rounded where they are compared, since sums of floats depend on their order.
_BM25 = """
with words as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') as w from documents),
postings as (select term, doc_id, count(*) as tf, any_value(n) as n from (select doc_id, len(w) as n, unnest(w) as term from words) group by term, doc_id),
totals as (select count(*) as rows, sum(len(w))::double / count(*) as mean from words),
asked as (select distinct query, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) as term from queries),
df as (select term, count(*) as df from postings where term in (select term from asked) group by term),
scored as (select query, doc_id, sum(ln(1 + (rows - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) as score
  from asked join postings using (term) join df using (term), totals group by query, doc_id)
"""
_ASKED = "the study of ouer, anat Vièle and reti"
add("o13_relevance", "documents", lambda d: text_index.ask(text_index.build(d, "doc_id", ["text"]), _ASKED).select(C("key").alias("doc_id"), F.round("score", 5).alias("score")), _BM25.replace("from queries", f"from (select 0 as query, '{_ASKED}' as text)") + "select doc_id, round(score, 5) as score from scored")
add(
    "o1_best_works",
    "documents benchmark",
    lambda d, b: text_index.best(text_index.scores(text_index.build(d, "doc_id", ["text"]), b.select(C("item_id").alias("query"), "text")).withColumn("score", F.round("score", 5)), 5, ["query"]).select(C("query").alias("item_id"), "place", C("key").alias("doc_id"), "score"),
    _BM25.replace("from queries", "from (select item_id as query, text from benchmark)") + "select query as item_id, place, doc_id, score from (select *, row_number() over (partition by query order by score desc, doc_id)::int as place from (select query, doc_id, round(score, 5) as score from scored)) where place <= 5",
)

# Trees: each part below the one of a third of its number, but for those that come round in a circle.
_nodes = "select cast(p_partkey as bigint) as id, cast(case when p_partkey % 211 = 150 then p_partkey + 1 when p_partkey % 211 = 151 then p_partkey - 1 when p_partkey < 4 then null else floor(p_partkey / 3) end as bigint) as parent from {part}"
_paths = f"""with recursive nodes as ({_nodes.format(part='part')}),
roots as (select id from nodes n where parent is null or parent not in (select id from nodes)),
walk as (select id, [id] as path from roots union all select n.id, list_append(w.path, n.id) from walk w join nodes n on n.parent = w.id)
"""


def _tree(p: DataFrame) -> DataFrame:
    return p.sparkSession.sql(_nodes.format(part="{p}"), p=p)


add("o15_paths", "part", lambda p: tree.paths(_tree(p), "id", "parent").select("id", F.array_join("path", "/").alias("path"), "depth", "cyclic"), _paths + "select id, array_to_string(path, '/') as path, len(path)::int - 1 as depth, false as cyclic from walk union all select id, null, null, true from nodes where id not in (select id from walk)")
add("o15_subtree_sizes", "part", lambda p: tree.subtree_sizes(_tree(p), "id", "parent"), _paths + "select id, count(*) as nodes from (select unnest(path) as id from walk) group by id")
add("o15_move", "part", lambda p: tree.paths(tree.move(_tree(p), "id", "parent", 12, 20), "id", "parent").where("not cyclic").select("id", "depth"), _paths.replace(_nodes.format(part="part"), f"select id, case when id = 12 then 20 else parent end as parent from ({_nodes.format(part='part')})") + "select id, len(path)::int - 1 as depth from walk")

# The context of errors: messages that quote titles, places and months of the records.
_message = """case row_id % 5 when 0 then 'ValueError: cannot read "' || title || '" here' when 1 then 'KeyError at ' || chr(39) || place || chr(39) || ' or "nothing"' when 2 then 'bad "Junio" found' when 3 then 'the AUTHOR is odd' else 'a Titulo of ' || id end"""
add(
    "k34_error_context",
    "records",
    lambda r: errors.error_context(r.select("row_id", F.expr(_message).alias("message")), "message", r.select(C("row_id").alias("_row_id"), "id", "title", "author", "place"), ["id", "title", "author", "place"]).select("row_id", "error_class", F.array_join("sample_tokens", "|").alias("tokens"), "affected_column"),
    f"""+m as (select row_id, {_message} as message from records),
x as (select row_id, message, coalesce(nullif(regexp_extract(message, '\\b([A-Z][a-zA-Z]+Error)\\b', 1), ''), 'UnknownError') as error_class, list_filter(list_transform(regexp_extract_all(message, '[''"]([^''"]+)[''"]', 1), lambda t: trim(t)), lambda t: t <> '' and length(t) < 50) as w from m),
head as (select row_number() over (order by row_id) as n, * from records order by row_id limit 49),
cells as (select n * 4 as pos, 'id' as c, lower(id) as v from head union all select n * 4 + 1, 'title', lower(title) from head union all select n * 4 + 2, 'author', lower(author) from head union all select n * 4 + 3, 'place', lower(place) from head),
hits as (select w, arg_min(c, pos) as c, min(pos) as pos from (select distinct unnest(w) as w from x) t join cells on v <> '' and contains(v, lower(w)) group by w),
best as (select row_id, arg_min(c, pos) as c from (select row_id, unnest(w) as w from x) join hits using (w) group by row_id)
select x.row_id, error_class, array_to_string(w, '|') as tokens,
  coalesce(c, case when regexp_matches(lower(message), 'fecha|date|year|año') or list_contains(w, 'Junio') then 'date' when regexp_matches(lower(message), 'autor|author|creator') then 'author' when regexp_matches(lower(message), 'titulo|title') then 'title' else '' end) as affected_column
from x left join best using (row_id)""",
)


def _default_chain(r: DataFrame, w: DataFrame) -> DataFrame:
    """Four services' stored JSON: a registry that knows the DOIs of some customers' records, one that negotiates others, a graph by
    journal, and books."""
    one = lambda *cs: F.to_json(F.struct(*cs)).alias("json")
    by_doi = r.where("doi != ''").select("doi", "custkey").distinct()
    responses = {
        "crossref": by_doi.where("custkey < 50").select("doi", one(F.array(F.concat(F.lit("Registry "), C("custkey"))).alias("container-title"), F.lit("journal-article").alias("type"))),
        "csl": by_doi.where("custkey between 40 and 90").select("doi", one(F.concat(F.lit("Negotiated "), C("custkey")).alias("container-title"), F.lit("chapter").alias("type"))),
        "openalex": w.where("pages = 7").select(F.lit("1234-567X").alias("issn"), one(F.struct(F.struct(C("publisher").alias("display_name")).alias("source")).alias("primary_location"), F.lit("article").alias("type"))),
        "openlibrary": w.where("pages = 3").select(F.lit("978-0-306-x3").alias("isbn"), one("title")),
    }
    return enrich.chain(r.select("row_id", "doi", "issn", "isbn", "citation", "type"), enrich.default_chain(responses), ["citation", "type"]).select("row_id", "citation", "type", "provider")


_known = """+h as (select *, case when doi <> '' and custkey < 50 then 'crossref' when doi <> '' and custkey between 40 and 90 then 'csl' when issn <> '' then 'openalex' when isbn <> '' then 'openlibrary' end as provider from records),
p as (select min(publisher) as pub from works where pages = 7)
"""
add(
    "l1_default_chain",
    "records works",
    _default_chain,
    _known + f"""select row_id, case when {_e('citation')} then coalesce(case provider when 'crossref' then 'Registry ' || custkey when 'csl' then 'Negotiated ' || custkey when 'openalex' then pub end, citation) else citation end as citation,
  case when {_e('type')} then coalesce(case provider when 'crossref' then 'journal-article' when 'csl' then 'chapter' when 'openalex' then 'article' when 'openlibrary' then 'Libro' end, type) else type end as type, provider from h, p""",
)
add(
    "d14_target_map",
    "records",
    lambda r: enrich.target_payload(r.select("row_id", "title", C("author").alias("authors"), C("date").alias("year"), "doi", "type", C("citation").alias("journal"), "issn", C("place").alias("abstract_es"), C("affiliation").alias("abstract_en"), C("custkey").alias("pages"), "language", F.lit("").alias("subjects"), C("id").alias("publisher"), C("price").cast("long").alias("volume_and_issue"), "isbn", F.lit(True).alias("open_access"))),
    """select row_id, nullif(title, '') as "dc.title", nullif(author, '') as "local.creator.person", nullif(date, '') as "dc.date.issued", nullif(doi, '') as "local.identifier.other", nullif(type, '') as "dc.type", nullif(citation, '') as "local.relation.journalTitle", nullif(issn, '') as "local.identifier.issn",
  nullif(place, '') as "dc.abstract[es]", nullif(affiliation, '') as "dc.abstract[en]", cast(custkey as varchar) as "dc.format.extent", nullif(language, '') as "dc.language", null::varchar as "local.subject.materias", id as "dc.publisher", cast(trunc(price)::bigint as varchar) as "local.relation.journalVolumeAndIssue", nullif(isbn, '') as "local.identifier.isbn" from records""",
)
