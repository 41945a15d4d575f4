"""Domain tables as views on the generated test tables.

One SQL text serves both engines, so a query and its oracle start from the same
rows. ``{REVERSE}`` and ``{Q}`` (the quote of a reserved name) are the only
differences. Where a view needs keys without a partner, it renames them instead
of leaving rows out; all rows and whole texts are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_UUID = (
    "concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), "
    "cast(l_partkey as string), cast(l_suppkey as string))"
)

# name: (views it reads, SQL)
VIEWS: dict[str, tuple[list[str], str]] = {
    "obs_raw": ([], f"""
select {_UUID} as observation_uuid,
  o_custkey as observer_id,
  l_partkey as taxon_id,
  cast((l_suppkey*7919) % 16000 as double)/100.0 - 80.0 + cast(l_orderkey % 40 as double)*0.05 as latitude,
  cast((l_suppkey*6271) % 35000 as double)/100.0 - 180.0 + cast(l_partkey % 40 as double)*0.05 as longitude,
  case when l_linenumber = 7 then null else (l_orderkey*31 + l_partkey) % 12000 end as positional_accuracy,
  case when l_returnflag in ('A','R') then 'research' when l_linestatus = 'O' then 'needs_id' else 'casual' end as quality_grade,
  case when l_discount = 0.0 then null else cast(year(l_shipdate) as int) end as year,
  case when l_discount = 0.0 then null else cast(month(l_shipdate) as int) end as month,
  l_discount as anomaly_score
from lineitem join orders on l_orderkey = o_orderkey"""),
    # The dump as it comes: text for accuracy and date, both with bad values.
    "obs_dump": ([], f"""
select {_UUID} as observation_uuid,
  cast(o_custkey as int) as observer_id,
  cast((l_suppkey*7919) % 16000 as double)/100.0 - 80.0 + cast(l_orderkey % 40 as double)*0.05 as latitude,
  case when l_linenumber = 6 then null else cast((l_suppkey*6271) % 35000 as double)/100.0 - 180.0 + cast(l_partkey % 40 as double)*0.05 end as longitude,
  case when l_linenumber = 7 then null when l_linenumber = 5 then 'unknown' when l_linenumber = 4 then concat(cast((l_orderkey*31 + l_partkey) % 12000 as string), '.7') else cast((l_orderkey*31 + l_partkey) % 12000 as string) end as positional_accuracy,
  cast(l_partkey as int) as taxon_id,
  case when l_returnflag in ('A','R') then 'research' when l_linestatus = 'O' then 'needs_id' else 'casual' end as quality_grade,
  case when l_discount = 0.0 then 'no date' else substring(cast(l_shipdate as string), 1, 10) end as observed_on,
  cast(l_discount as float) as anomaly_score
from lineitem join orders on l_orderkey = o_orderkey"""),
    "obs": (["obs_raw"], """
select observation_uuid, observer_id, taxon_id, latitude, longitude, positional_accuracy, quality_grade, year, month, anomaly_score,
  concat(cast(r as string), '_', cast(c as string)) as h3_r3,
  concat(cast(r as string), '_', cast(c as string), '_', cast(fr as string), '_', cast(fc as string)) as h3_r5
from (select *, least(greatest(cast(floor((latitude + 90.0 - r)*7.0) as int), 0), 6) as fr,
        least(greatest(cast(floor((lonf - c)*7.0) as int), 0), 6) as fc
  from (select *, least(greatest(cast(floor(lonf) as int), 0), ncol - 1) as c
    from (select *, (longitude + 180.0)/360.0*ncol as lonf
      from (select *, greatest(1, cast(round(360.0*cos(radians(r - 89.5))) as int)) as ncol
        from (select *, least(greatest(cast(floor(latitude + 90.0) as int), 0), 179) as r
          from obs_raw
          where latitude is not null and longitude is not null and positional_accuracy < 10000) s1) s2) s3) s4) s5"""),
    "taxa_flat": ([], """
select p_partkey as taxon_id,
  concat(p_name, ' ', cast(p_partkey as string)) as name,
  case when p_size % 10 = 0 then 'genus' else 'species' end as {Q}rank{Q},
  p_type as kingdom, p_brand as phylum,
  case when p_size = 50 then null else split_part(p_name, ' ', 1) end as class,
  split_part(p_name, ' ', 2) as {Q}order{Q},
  concat('F', cast(p_size as string)) as family,
  concat('G', cast(p_partkey % 20 as string)) as genus,
  p_size <> 13 as active
from part"""),
    "taxa": (["taxa_flat"], """
select taxon_id, name, {Q}rank{Q}, kingdom, phylum, class, {Q}order{Q}, family, genus from taxa_flat where active"""),
    "taxa_raw": ([], """
select cast(1 + r_regionkey as bigint) as taxon_id, cast(null as string) as ancestry, cast(70.0 as float) as rank_level, 'kingdom' as {Q}rank{Q}, r_name as name, r_regionkey <> 4 as active from region
union all
select cast(100 + n_nationkey as bigint), cast(1 + n_regionkey as string), cast(60.0 as float), 'phylum', n_name, true from nation
union all
select 10000 + c_custkey, concat(cast(1 + n_regionkey as string), '/', cast(100 + n_nationkey as string), '/x'), cast(10.0 as float), 'species', c_name, c_custkey % 7 <> 0
from customer join nation on c_nationkey = n_nationkey"""),
    "photos_raw": ([], f"""
select l_orderkey*10 + l_linenumber as photo_id,
  {_UUID} as observation_uuid,
  case when l_linestatus = 'F' then 'jpg' when l_linenumber = 2 then null else 'png' end as extension,
  l_returnflag as license,
  case when l_linenumber <= 3 then 0 else 1 end as position
from lineitem"""),
    # Odd customers have no login under their own id.
    "observers": ([], """
select case when c_custkey % 2 = 0 then c_custkey else -c_custkey end as observer_id, c_name as login from customer"""),
    "checklist": ([], """
select 100000 + p_partkey as {Q}taxonID{Q}, concat('  ', upper(p_name), ' ', cast(p_partkey as string), ' ') as {Q}canonicalName{Q},
  case when p_partkey % 5 = 0 then 'synonym' else 'accepted' end as {Q}taxonomicStatus{Q}
from part"""),
    "vernacular_raw": ([], """
select 100000 + doc_id % 100 as {Q}taxonID{Q}, text as {Q}vernacularName{Q}, lang as language from documents"""),
    "description_raw": ([], """
select 100000 + doc_id % 100 as {Q}taxonID{Q},
  case when doc_id % 4 = 0 then 'Description' when doc_id % 4 = 1 then 'citation' when doc_id % 4 = 2 then null else 'biology' end as type,
  text as description, lang as language, source, source as license
from documents"""),
    "ecoregions": ([], """
select n_nationkey as eco_id, n_name as eco_name, n_regionkey as biome_num, r_name as biome_name, concat('R', cast(n_regionkey % 2 as string)) as realm
from nation join region on n_regionkey = r_regionkey"""),
    # One triangle per region as a closed ring.
    "eco_ring": ([], """
select n_nationkey as eco_id, 0 as seq, cast(-180.0 + n_nationkey*14.0 as double) as lon, -80.0 + cast((n_nationkey*37) % 130 as double) as lat from nation
union all
select n_nationkey, 1, cast(-166.3 + n_nationkey*14.0 as double), -80.0 + cast((n_nationkey*37) % 130 as double) from nation
union all
select n_nationkey, 2, cast(-173.2 + n_nationkey*14.0 as double), -50.0 + cast((n_nationkey*37) % 130 as double) from nation
union all
select n_nationkey, 3, cast(-180.0 + n_nationkey*14.0 as double), -80.0 + cast((n_nationkey*37) % 130 as double) from nation"""),
    "text_clip": ([], """
select concat('name_', cast(vec_id as string)) as id_str, embedding, concat('d', cast(vec_id as string)) as description from embeddings"""),
    # One id in ten is unknown to the first space.
    "text_bioclip": ([], """
select concat(case when vec_id % 10 = 9 then 'other_' else 'name_' end, cast(vec_id as string)) as id_str, {REVERSE}(embedding) as embedding from embeddings"""),
    "anchors": ([], """
select concat('name_', cast(vec_id % 250 as string)) as id_str, embedding from embeddings"""),
    "species_meta": ([], """
select -1 - vec_id as taxon_id, concat(case when vec_id % 17 = 0 then 'Other ' else 'Name ' end, cast(vec_id as string)) as name,
  case when vec_id % 11 = 0 then null else concat('F', cast(label as string)) end as family,
  concat('O', cast(label % 3 as string)) as {Q}order{Q},
  case when vec_id % 5 = 0 then null else concat('img/', cast(vec_id as string)) end as image_url,
  vec_id * 3 as dataset_records, vec_id % 13 = 0 as subrepresented
from embeddings"""),
    "query_vec": ([], """
select vec_id as query_id, embedding as q_clip, {REVERSE}(embedding) as q_bio, embedding as q_dino, concat('name ', cast(vec_id as string)) as known_species
from embeddings"""),
    # One JSON document per part, in the three shapes, some of them broken.
    "external_docs": ([], """
select concat('list-', lpad(cast(p_partkey as string), 12, '0'), '.json') as source_file,
  case p_partkey % 5
    when 0 then concat('{{"', p_name, ' ', cast(p_partkey as string), '": {{"id": 0, "species": "", "family": "', p_brand, '", "image_url": "", "image_urls": ["u', cast(p_size as string), '"], "dataset_records": ', cast(p_size as string), ', "subrepresented": ', case when p_size < 10 then 'true' else 'false' end, '}}, "', p_type, '": {{"species": "', p_type, ' ', cast(p_size as string), '"}}}}')
    when 1 then concat('{{"n": 2, "results": [{{"species": "', p_name, ' r', cast(p_size as string), '", "order": "', p_type, '"}}], "preview": [{{"name": "', p_name, ' p', cast(p_partkey as string), '", "image_url": "i', cast(p_size as string), '"}}, 7]}}')
    when 2 then concat('[{{"name": "", "species": "', p_name, '", "dataset_records": ', cast(p_size as string), '}}, ', cast(p_size as string), ', {{"name": "', p_brand, ' ', cast(p_partkey as string), '", "family": "', p_brand, '"}}]')
    when 3 then concat('{{"broken": "', p_name)
    else '{{}}' end as text
from part"""),
}

_BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def _needed(names: list[str]) -> list[str]:
    order: list[str] = []
    for name in names:
        for needed in [*_needed(VIEWS[name][0]), name]:
            if needed not in order:
                order.append(needed)
    return order


def with_views(names: list[str], query: str, engine: str = "duckdb") -> str:
    """``query`` preceded by the views it reads, in the words of the engine."""
    words = {"duckdb": {"REVERSE": "list_reverse", "Q": '"'}, "spark": {"REVERSE": "reverse", "Q": "`"}}[engine]
    parts = [f"{name} as ({VIEWS[name][1].format(**words)}\n)" for name in _needed(names)]
    return "with " + ",\n".join(parts) + "\n" + query


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The domain table ``name`` over the test tables in ``sf_dir``."""
    text = with_views([name], f"select * from {name}", "spark")
    words = set(text.replace("(", " ").replace(")", " ").split())
    for table in _BASE:
        if table in words:
            base_table(spark, sf_dir, table).createOrReplaceTempView(table)
    return spark.sql(text)
