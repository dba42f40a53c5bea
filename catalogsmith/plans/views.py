"""Record-shaped views of the test tables, in SQL that Spark and DuckDB both read, so that a query and its check start alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

_MONTH = "case month(o_orderdate) " + " ".join(f"when {i} then '{m}'" for i, m in enumerate("January feb Marzo april MAYO June jul agosto Sept octubre November dic".split(), 1)) + " end"
_YEAR = "cast(year(o_orderdate) as string)"
_KEY = "cast(o_orderkey as string)"

_LETTERS = "regexp_replace(split_part(text, chr(10), 1), '[^A-Za-z ]', '')"
#: A first line of up to 200 characters is a title; a longer one is none.
_TITLE = f"case when length(split_part(text, chr(10), 1)) <= 200 then lower({_LETTERS}) else '' end"
#: Surnames made of numbers: eight letters of a digest.
_SURNAME = "translate(substr(md5(cast({0} as string)), 1, 8), '0123456789', 'ghijklmnop')"

#: The left side of a column mapping made of a part: one column, two, a pattern, none, or one that no file has.
_LEFT = "case p_partkey % 6 when 0 then '' when 1 then p_brand || ' + ' || p_type when 2 then substr(p_brand, 1, 7) || '*' when 3 then 'gone ' || p_name when 4 then p_type || '+nowhere' else p_brand end"
_FIELD = "case {0} " + " ".join(f"when {i} then '{f}'" for i, f in enumerate("weird title author date description subject type subtitle issn doi isbn citation id Title".split())) + " end"

VIEWS = {
    "authored": f"""
select cast(o_orderkey as bigint) as id, case o_orderkey % 11 when 0 then '' when 1 then 'zzz' || {_SURNAME.format('o_custkey')} || 'oz, Ana'
  when 2 then substr({_SURNAME.format('o_custkey')} || 'ez', 1, length({_SURNAME.format('o_custkey')}) + 1) || ', Eva'
  else {_SURNAME.format('o_custkey')} || 'ez, ' || case o_orderkey % 3 when 0 then 'Juan' when 1 then 'E.' else 'Eva' end || case when o_orderkey % 4 = 0 then '|' || {_SURNAME.format('o_orderkey')} || 'is, Luz' else '' end end as author
from {{orders}}""",
    "authors": f"""
select cast(c_custkey as string) as author_id, {_SURNAME.format('c_custkey')} || 'ez, ' || case when c_nationkey % 2 = 0 then 'Juan' else 'Eva' end || '|||' || {_SURNAME.format('c_custkey')} || 'ez, ' || case when c_nationkey % 2 = 0 then 'J.' else 'E.' end as variants
from {{customer}}""",
    "records": f"""
select cast(o_orderkey as bigint) as row_id, 'rec' || {_KEY} as id,
  case o_orderkey % 9 when 0 then '' when 1 then 'Master thesis on ' || o_orderpriority when 2 then 'Study of 1987 data' else 'Work ' || o_orderpriority || ' ' || o_orderstatus end as title,
  case o_orderkey % 7 when 0 then '' when 1 then 'nan' when 2 then 'Perez, Juan|Gomez, Ana|PEREZ, JUAN' when 3 then 'Solo Autor' when 4 then 'Diaz, Eva' else 'Perez, Juan|Lopez, Eva' end as author,
  case o_orderkey % 8 when 0 then '' when 1 then {_MONTH} || ' ' || {_YEAR} when 2 then {_YEAR} || ', ' || {_MONTH} when 3 then {_YEAR} || '.' when 4 then {_YEAR} || '-06-25' when 5 then 'June-July ' || {_YEAR} when 6 then ' 2001 ' else '(Unknown!)' end as date,
  case o_orderkey % 5 when 0 then 'Articulo' when 1 then 'nan' else '' end as type,
  case when o_orderkey % 6 = 0 then '1234-567X' else '' end as issn,
  case when o_orderkey % 10 = 3 then '978-0-306-x' || cast(o_orderkey % 10 as string) else '' end as isbn,
  case o_orderkey % 4 when 0 then 'https://doi.org/10.1/' || cast(o_custkey as string) when 1 then 'DOI: 10.2/A' || {_KEY} when 2 then '' else '10.3/' || {_KEY} end as doi,
  case o_orderkey % 12 when 0 then 'Revista X, vol. 3' when 1 then 'Proc. 2011 Conf.' when 2 then 'None' else '' end as citation,
  case o_orderkey % 6 when 0 then 'English' when 1 then 'spanish ' when 2 then 'POR' when 3 then 'FR' when 4 then 'Klingon' else case o_orderkey % 4 when 1 then 'ZH' when 3 then 'CA' else '' end end as language,
  case o_orderkey % 3 when 0 then '' when 1 then 'La Plata' else 'nan' end as place, case when o_orderkey % 2 = 0 then 'Quito' else '' end as affiliation,
  cast(o_custkey as bigint) as custkey, o_totalprice as price, cast(o_orderkey as bigint) % 100 as percent
from {{orders}}""",
    "noisy": """
select cast(doc_id as bigint) as row_id,
  case doc_id % 7 when 0 then 'E s t i m a r  T e x t u r a s e n' when 1 then 'di(cid:27)erent (cid:99) e(cid:14)cient (cid:32) text' when 2 then 'Pseudopseudohypoparathyroidismuslessness long' when 3 then 'bell' || chr(7) || ' rung' when 4 then '' else 'plain words in a row' end as title,
  case when doc_id % 5 = 0 then '' else 'Perez, Juan|Gomez, Ana' end as author, case when doc_id % 3 = 0 then '' else 'Articulo' end as type,
  text as description
from {documents}""",
    "source_records": f"""
select cast(doc_id as bigint) as row_id, 'd' || cast(doc_id as string) as id, {_TITLE} as title, lang || ', ' || source as author, cast(2000 + doc_id % 3 as string) as date, '' as doi
from {{documents}} where doc_id % 2 = 1""",
    "repository_records": f"""
select cast(doc_id as bigint) as row_id, 'd' || cast(doc_id as string) as id, {_TITLE} as title, lang || ', ' || source as author, cast(2000 + doc_id % 3 as string) as date, '' as doi
from {{documents}} where doc_id % 2 = 0""",
    "works": """
select cast(p_partkey as bigint) as work_id, p_name as title, p_brand as publisher, p_type as kind, cast(p_size as bigint) as pages, p_retailprice as price, '10.' || cast(p_size as string) || '/' || cast(p_partkey as string) as doi
from {part}""",
    "values_list": """
select cast(p_partkey as bigint) as row_id, p_brand || '|' || p_type || '||' || p_brand || case when p_partkey % 4 = 0 then '|||' || p_name else '' end as many, p_name, p_brand, p_type from {part}""",
    "mappings": f"""
select cast(p_partkey as bigint) as pos, {_LEFT} as "left", {_FIELD.format('p_size % 14')} as "replace" from {{part}}""",
    "expected": f"""
select cast(p_partkey as bigint) as pos, {_LEFT} as "left", {_FIELD.format('case when p_retailprice > 1200 then p_size + 1 else p_size end % 14')} as "replace" from {{part}}""",
    "targets": """
select cast(p_partkey as bigint) as pos, case p_partkey % 5 when 0 then p_brand || '+' || p_name when 1 then 'gone ' || p_name when 2 then p_type || '+' || p_brand else p_brand end as "left",
  case p_size % 7 when 0 then 'dc.' || lower(p_type) || '[es]' when 1 then 'dc.' || lower(p_type) || '.identifier' when 2 then 'not a name!' when 3 then 'x.' || lower(p_type) when 4 then 'dc.' || lower(p_brand) else 'dc.' || lower(p_type) end as "replace"
from {part}""",
    "header": """
select distinct p_brand as "column" from {part} where p_size < 25 union select distinct p_type from {part} union select distinct p_name from {part} where p_retailprice < 1500""",
    "canonical": f"""
select distinct {_FIELD.format('p_size % 14')} as field, 'dc.' || lower(p_type) || case when p_type < 'M' then '[es]' else '' end as target from {{part}} where p_brand = 'Brand#1' or p_brand = 'Brand#2'""",
    "target_catalog": """
select distinct 'dc.' || lower(p_type) as field, p_type < 'M' as allow_lang from {part} union select distinct 'local.' || lower(p_type) || '.' || lower(replace(p_brand, '#', '')), false from {part}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables of a folder."""
    sql = VIEWS[name].replace('"left"', "`left`").replace('"replace"', "`replace`").replace('"column"', "`column`")
    used = re.findall(r"\{(\w+)\}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}) if used else spark.sql(sql)


def ctes(*names: str) -> str:
    """The views as common table expressions for DuckDB."""
    plain = {n: re.sub(r"\{(\w+)\}", r"\1", VIEWS[n]).replace(_LETTERS, _LETTERS[:-1] + ", 'g')") for n in names}
    return "with " + ",\n".join(f"{n} as ({sql})" for n, sql in plain.items())
