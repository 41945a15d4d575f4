"""SQL that DuckDB runs on the test tables, one per registered query where SQL can say it."""

from __future__ import annotations

from wildgrid.checks.bindings import with_views

# ---- stored tables as SQL views -------------------------------------------------

_PHOTOS = """
photos as (
  select photo_id, observation_uuid, extension, license,
    'https://inaturalist-open-data.s3.amazonaws.com/photos/' || cast(photo_id as varchar) || '/medium.' || extension as photo_url
  from photos_raw where position = 0 and extension is not null)"""

_LINK = """
accepted as (
  select "taxonID" as gbif_id, "canonicalName", "taxonomicStatus" from checklist where "taxonomicStatus" = 'accepted'),
link as (
  select t.taxon_id, min(a.gbif_id) as gbif_id
  from taxa t left join accepted a on lower(trim(t.name)) is not distinct from lower(trim(a."canonicalName"))
  group by t.taxon_id)"""

_VERNACULAR = """
vernacular as (
  select "taxonID" as gbif_id, "vernacularName", language from vernacular_raw
  where language in ('es','en','ES','EN','spa','eng'))"""

_DESCRIPTION = """
description as (
  select "taxonID" as gbif_id, type, description, language, source, license from description_raw
  where lower(coalesce(type, '')) not in ('materials examined','materials_examined','citation','references')
    and lower(language) in ('en','eng','english'))"""

_JOINED = """
joined as (
  select o.*, t.name, t."rank", t.kingdom, t.phylum, t.class, t."order", t.family, t.genus
  from obs o join taxa t on o.taxon_id = t.taxon_id)"""

_HEX = _JOINED + """,
hex_density as (
  select h3_r3, h3_r5, kingdom, phylum, quality_grade, year, count(*) as n_obs,
    count(distinct taxon_id) as n_species, count(distinct observer_id) as n_observers
  from joined where h3_r3 is not null group by all)"""

_REGION_STATS = """
select h3_r3, kingdom, phylum, quality_grade, year, count(*) as n_obs, count(distinct taxon_id) as n_species,
  count(distinct observer_id) as n_observers from joined where h3_r3 is not null group by all"""

_TEMPORAL = _JOINED + """,
temporal as (
  select year, month, kingdom, phylum, quality_grade, count(*) as n_obs, count(distinct taxon_id) as n_species
  from joined where year is not null and month is not null group by all)"""

_TREE_BODY = """
taxon_tree as (
  select kingdom, phylum, class, "order", family, genus, quality_grade,
    count(distinct taxon_id) as n_species, count(*) as n_obs
  from joined group by all)"""
_TREE = _JOINED + "," + _TREE_BODY

_SPECIES = _JOINED + """,
species_counts as (
  select taxon_id, name, "rank", kingdom, phylum, class, "order", family, genus, quality_grade,
    count(*) as n_obs, count(distinct observer_id) as n_observers,
    min(year) as first_year, max(year) as last_year, count(distinct h3_r3) as n_cells
  from joined where "rank" = 'species' group by all)"""

_PHOTO_PICK = _PHOTOS + """,
photo_pick as (
  select taxon_id, photo_url, license as photo_license, login as photo_attribution
  from (select o.taxon_id, p.photo_url, p.license, ob.login,
      row_number() over (partition by o.taxon_id
        order by p.photo_id, p.photo_url, p.license nulls first, o.observer_id nulls first) as rn
    from obs o join photos p on p.observation_uuid = o.observation_uuid
    left join observers ob on ob.observer_id = o.observer_id
    where p.photo_url is not null) x
  where rn = 1)"""

_SPECIES_LIST = _SPECIES + "," + _PHOTO_PICK + "," + _LINK + "," + _VERNACULAR + """,
vernacular_pick as (
  select j.taxon_id, min(v."vernacularName") as vernacular_name
  from link j join vernacular v on v.gbif_id = j.gbif_id group by j.taxon_id),
species_list as (
  select s.*, ph.photo_url, ph.photo_license, ph.photo_attribution, vn.vernacular_name
  from species_counts s left join photo_pick ph on s.taxon_id = ph.taxon_id
  left join vernacular_pick vn on s.taxon_id = vn.taxon_id)"""

_SPECIES_LIST_VIEWS = ["obs", "taxa", "photos_raw", "observers", "checklist", "vernacular_raw"]

# Cover by testing every cell centre in the box of the outline.
_COVER = """
edges as (
  select eco_id, lon as x1, lat as y1,
    lead(lon) over (partition by eco_id order by seq) as x2, lead(lat) over (partition by eco_id order by seq) as y2
  from eco_ring where eco_id > 0),
real_edges as (select * from edges where x2 is not null),
box as (
  select eco_id, cast(floor(min(lat) + 90.0) as int) as r_lo, cast(floor(max(lat) + 90.0) as int) as r_hi
  from eco_ring where eco_id > 0 group by eco_id),
box_rows as (
  select eco_id, r, greatest(1, cast(round(360.0*cos(radians(r - 89.5))) as int)) as ncol
  from (select eco_id, unnest(range(r_lo, r_hi + 1)) as r from box) b),
centres as (
  select eco_id, r, c, r - 89.5 as y, -180.0 + (c + 0.5)/ncol*360.0 as x
  from (select eco_id, r, ncol, unnest(range(0, ncol)) as c from box_rows) b),
region_cells as (
  select s.eco_id, concat(cast(s.r as varchar), '_', cast(s.c as varchar)) as h3_r3
  from centres s join real_edges e on s.eco_id = e.eco_id
    and ((e.y1 <= s.y and s.y < e.y2) or (e.y2 <= s.y and s.y < e.y1))
    and e.x1 + (s.y - e.y1)*(e.x2 - e.x1)/(e.y2 - e.y1) < s.x
  group by s.eco_id, s.r, s.c having count(*) % 2 = 1)"""

_BIAS = """
totals as (select sum(n_obs) as total_obs, count(*) as total_species from scoped),
grouped as (
  select class, min(kingdom) as kingdom, count(*) as n_species, cast(sum(n_obs) as bigint) as n_obs,
    count(*) filter (where n_obs >= 1) as a1, count(*) filter (where n_obs >= 20) as a20,
    count(*) filter (where n_cells >= 20) as c20
  from scoped where class is not null and class <> '' group by class),
measured as (
  select g.*, cast(t.total_obs as double)*(cast(g.n_species as double)/t.total_species) as e
  from grouped g, totals t),
bias as (
  select class, kingdom, n_species, n_obs, (cast(printf('%.1f', cast(e as double)) as double) + cast(0 as double)) as ideal, (cast(printf('%.1f', cast(n_obs - e as double)) as double) + cast(0 as double)) as deviation,
    case when e > 0 then (cast(printf('%.1f', cast((n_obs - e)/e*100 as double)) as double) + cast(0 as double)) else 0 end as deviation_pct,
    (cast(printf('%.1f', cast(cast(a1 as double)/n_species*100 as double)) as double) + cast(0 as double)) as p1, (cast(printf('%.1f', cast(cast(a20 as double)/n_species*100 as double)) as double) + cast(0 as double)) as p20,
    (cast(printf('%.1f', cast(cast(c20 as double)/n_species*100 as double)) as double) + cast(0 as double)) as p20d
  from measured)"""

_SCORES = """
queries as (
  select query_id, known_species,
    list_transform(q_clip, lambda v: cast(v as double)/n) as clip,
    list_transform(q_bio, lambda v: cast(v as double)/n) as bio,
    list_transform(q_dino, lambda v: cast(v as double)/n) as dino
  from (select *, sqrt(list_sum(list_transform(q_clip, lambda v: cast(v as double)*v))) as n from query_vec) q),
corpus as (
  select c.id_str as slug, c.description, cast(c.embedding as double[]) as clip, cast(b.embedding as double[]) as bio
  from text_clip c join text_bioclip b on c.id_str = b.id_str),
scored as (
  select q.query_id, c.slug, c.description, list_dot_product(q.clip, c.clip) as s_clip, list_dot_product(q.bio, c.bio) as s_bio
  from queries q, corpus c),
ranked as (
  select *, row_number() over (partition by query_id order by round((s_clip + s_bio)/2, 10) desc, slug, description) as "rank"
  from scored),
info as (
  select *, lower(replace(name, ' ', '_')) as slug from species_meta),
stage1 as (
  select r.query_id, cast(r."rank" as int) as "rank", r.slug,
    coalesce(i.name, upper(left(replace(r.slug, '_', ' '), 1)) || lower(substring(replace(r.slug, '_', ' '), 2))) as name,
    i.family, i."order", i.image_url, i.dataset_records, coalesce(i.subrepresented, false) as subrepresented, r.description,
    (cast(printf('%.4f', cast(r.s_bio as double)) as double) + cast(0 as double)) as score_bioclip, (cast(printf('%.4f', cast(r.s_clip as double)) as double) + cast(0 as double)) as score_clip,
    (cast(printf('%.4f', cast((r.s_clip + r.s_bio)/2 as double)) as double) + cast(0 as double)) as score_ensemble
  from ranked r left join info i on r.slug = i.slug where r."rank" <= 30)"""

_STAGE2 = _SCORES + """,
nearest as (
  select s.query_id, s.slug, max(list_dot_product(q.dino, cast(a.embedding as double[]))) as best
  from stage1 s join queries q on s.query_id = q.query_id join anchors a on a.id_str = s.slug
  group by s.query_id, s.slug),
blended as (
  select s.*, (cast(printf('%.4f', cast(coalesce(n.best, 0.0) as double)) as double) + cast(0 as double)) as score_dino,
    (cast(printf('%.4f', cast(cast(0.7 as double)*s.score_ensemble + (1 - cast(0.7 as double))*coalesce(n.best, 0.0) as double)) as double) + cast(0 as double)) as score_final
  from stage1 s left join nearest n on s.query_id = n.query_id and s.slug = n.slug),
placed as (
  select *, cast(row_number() over (partition by query_id order by score_final desc, "rank") as int) as rank_final from blended),
stage2 as (
  select *, "rank" - rank_final as rank_delta from placed where rank_final <= 10)"""

_PREDICTIONS = _STAGE2 + """,
meta as (
  select lower(name) as k, arg_max(struct_pack(t := taxon_id, f := family, o := "order", i := image_url, d := dataset_records), taxon_id) as m
  from species_meta group by 1),
predictions as (
  select s.query_id, s."rank", s.slug, s.name, s.subrepresented, s.description, s.score_bioclip, s.score_clip,
    s.score_ensemble, s.score_dino, s.score_final, s.rank_final, s.rank_delta, m.t as taxon_id,
    coalesce(m.f, s.family) as family, coalesce(m.o, s."order") as "order", coalesce(m.i, s.image_url) as image_url,
    coalesce(m.d, s.dataset_records) as dataset_records
  from stage2 s left join meta on lower(s.name) = meta.k)"""

_RETRIEVAL_VIEWS = ["query_vec", "text_clip", "text_bioclip", "anchors", "species_meta"]

# The external list follows from the part table by the rules for each document shape.
_EXTERNAL = """
records as (
  select 'list-' || lpad(cast(p_partkey as varchar), 12, '0') || '.json' as source_file, r.*
  from part, lateral (
    select 0 as pos, p_name || ' ' || cast(p_partkey as varchar) as name, p_brand as family, cast(null as varchar) as "order",
      'u' || cast(p_size as varchar) as image_url, cast(p_size as bigint) as dataset_records, p_size < 10 as subrepresented
      where p_partkey % 5 = 0
    union all
    select 1, p_type || ' ' || cast(p_size as varchar), null, null, null, null, null where p_partkey % 5 = 0
    union all
    select 0, p_name || ' p' || cast(p_partkey as varchar), null, null, 'i' || cast(p_size as varchar), null, null where p_partkey % 5 = 1
    union all
    select 2, p_name || ' r' || cast(p_size as varchar), null, p_type, null, null, null where p_partkey % 5 = 1
    union all
    select 0, p_name, null, null, null, p_size, null where p_partkey % 5 = 2
    union all
    select 2, p_brand || ' ' || cast(p_partkey as varchar), p_brand, null, null, null, null where p_partkey % 5 = 2) r),
firsts as (
  select *, row_number() over (partition by name order by source_file, pos) as rn from records),
external_species as (
  select cast(-row_number() over (order by source_file, pos) as bigint) as taxon_id, name, family, "order", image_url,
    dataset_records, subrepresented, source_file
  from firsts where rn = 1)"""


def _sql(views: list[str], ctes: str, query: str) -> str:
    body = (",\n".join([""] + [ctes.strip()]) if views else "") if ctes else ""
    if views:
        return with_views(views, "@@", "duckdb").replace("\n@@", body + "\n" + query)
    return "with " + ctes.strip() + "\n" + query


_MAP = "select {cell} as h3, cast(sum({metric}) as bigint) as value from hex_density where {where} and {cell} is not null group by 1"
_GRADE_YEARS = "kingdom in ('STANDARD','PROMO') and quality_grade = 'research' and year >= 1996 and year <= 1999"
_BRANDS = "kingdom in ('STANDARD','SMALL','LARGE') and phylum in ('Brand#1','Brand#4','Brand#12','Brand#23') and quality_grade = 'research'"
_OBS_TAXA = ["obs", "taxa"]
_PROFILE_STATS = (
    "(cast(printf('%.6f', cast(avg(n) as double)) as double) + cast(0 as double)) as norm_mean, (cast(printf('%.6f', cast(stddev_pop(n) as double)) as double) + cast(0 as double)) as norm_std, "
    "(cast(printf('%.6f', cast(min(n) as double)) as double) + cast(0 as double)) as norm_min, (cast(printf('%.6f', cast(max(n) as double)) as double) + cast(0 as double)) as norm_max"
)
_NORMS = "select row_number() over (order by vec_id) as nth, len(embedding) as dim, sqrt(list_sum(list_transform(embedding, lambda v: cast(v as double)*v))) as n from embeddings"

ORACLES: dict[str, str] = {
    "obs_clean": _sql(["obs_dump"], "", """
select observation_uuid, observer_id, latitude, longitude, cast(round(try_cast(positional_accuracy as double)) as int) as positional_accuracy,
  taxon_id, quality_grade, anomaly_score, cast(year(try_cast(observed_on as date)) as smallint) as year,
  cast(month(try_cast(observed_on as date)) as tinyint) as month
from obs_dump where latitude is not null and longitude is not null and try_cast(round(try_cast(positional_accuracy as double)) as int) < 10000"""),
    "obs_cells": _sql(["obs"], "", "select * from obs"),
    "taxa_enriched": _sql(["taxa_raw"], """
live as (select * from taxa_raw where active),
steps as (
  select taxon_id, i as step, try_cast(string_split(ancestry, '/')[i] as bigint) as ancestor_id
  from (select taxon_id, ancestry, unnest(range(1, len(string_split(ancestry, '/')) + 1)) as i from live where ancestry is not null) p),
named as (
  select s.taxon_id, s.step, cast(trunc(a.rank_level) as int) as level, a.name from steps s join live a on s.ancestor_id = a.taxon_id),
ranks as (
  select taxon_id,
    arg_max(name, step) filter (where level = 70) as kingdom, arg_max(name, step) filter (where level = 60) as phylum,
    arg_max(name, step) filter (where level = 50) as class, arg_max(name, step) filter (where level = 40) as "order",
    arg_max(name, step) filter (where level = 30) as family, arg_max(name, step) filter (where level = 20) as genus
  from named group by taxon_id)""", """
select l.taxon_id, l.rank_level, l."rank", l.name, l.ancestry, r.kingdom, r.phylum, r.class, r."order", r.family, r.genus
from live l left join ranks r on l.taxon_id = r.taxon_id"""),
    "photos_main": _sql(["photos_raw"], _PHOTOS, "select * from photos"),
    "checklist_accepted": _sql(["taxa", "checklist"], _LINK, "select * from accepted"),
    "vernacular_filtered": _sql(["vernacular_raw"], _VERNACULAR, "select * from vernacular"),
    "description_filtered": _sql(["description_raw"], _DESCRIPTION, "select * from description"),
    "taxon_link": _sql(["taxa", "checklist"], _LINK, "select * from link"),
    "taxon_link_rate": _sql(["taxa", "checklist"], _LINK, """
select count(*) as n_taxa, count(gbif_id) as n_matched, (cast(printf('%.6f', cast(count(gbif_id)/cast(count(*) as double) as double)) as double) + cast(0 as double)) as match_rate from link"""),
    "hex_density": _sql(_OBS_TAXA, _HEX, "select * from hex_density"),
    "region_stats": _sql(_OBS_TAXA, _JOINED, _REGION_STATS),
    "temporal_table": _sql(_OBS_TAXA, _TEMPORAL, "select * from temporal"),
    "taxon_tree_table": _sql(_OBS_TAXA, _TREE, "select * from taxon_tree"),
    "species_list": _sql(_SPECIES_LIST_VIEWS, _SPECIES_LIST, "select * from species_list"),
    "folded_hex_density": _sql(_OBS_TAXA, _HEX, "select * from hex_density"),
    "folded_region_stats": _sql(_OBS_TAXA, _JOINED, _REGION_STATS),
    "folded_temporal": _sql(_OBS_TAXA, _TEMPORAL, "select * from temporal"),
    "folded_taxon_tree": _sql(_OBS_TAXA, _TREE, "select * from taxon_tree"),
    "folded_species_counts": _sql(_OBS_TAXA, _SPECIES, "select * from species_counts"),
    "map_hex_r3": _sql(_OBS_TAXA, _HEX, _MAP.format(cell="h3_r3", metric="n_obs", where=_GRADE_YEARS)),
    "map_hex_r5": _sql(_OBS_TAXA, _HEX, _MAP.format(cell="h3_r5", metric="n_species", where=_GRADE_YEARS)),
    "map_hex_observers": _sql(
        _OBS_TAXA, _HEX, _MAP.format(cell="h3_r3", metric="n_observers", where=_BRANDS + " and year between 1996 and 2000")
    ),
    "map_hex_bins": _sql(
        _OBS_TAXA, _HEX + ",\ncells as (" + _MAP.format(cell="h3_r3", metric="n_obs", where=_GRADE_YEARS) + ")", """
select h3, value, case when value <> 0 then cast(least(floor(pow(value/cast((select max(value) from cells) as double), 0.4)*5), 5) as int) end as bin from cells"""
    ),
    "map_hex_ecoregion": _sql(
        [*_OBS_TAXA, "eco_ring"], _HEX + "," + _COVER,
        _MAP.format(cell="h3_r3", metric="n_obs", where="quality_grade = 'research' and h3_r3 in (select h3_r3 from region_cells where eco_id in (3,5,8,13,21))"),
    ),
    "preset_scope_map": _sql(
        _OBS_TAXA, _HEX, _MAP.format(cell="h3_r3", metric="n_species", where=_BRANDS + " and year between 1997 and 2001")
    ),
    "temporal_monthly": _sql(_OBS_TAXA, _TEMPORAL, f"""
select cast(year as varchar) || '-' || lpad(cast(month as varchar), 2, '0') as date, cast(sum(n_obs) as bigint) as n_obs,
  cast(sum(n_species) as bigint) as n_species
from temporal where {_BRANDS} and year between 1996 and 2000 group by 1 order by 1"""),
    "temporal_yearly": _sql(_OBS_TAXA, _TEMPORAL, """
select cast(year as varchar) as date, cast(sum(n_obs) as bigint) as n_obs, cast(sum(n_species) as bigint) as n_species
from temporal where quality_grade = 'research' and year between 1990 and 2025 group by 1 order by 1"""),
    "taxon_nodes_depth3": _sql(_OBS_TAXA, _TREE, """
select concat_ws('/', kingdom, phylum, class) as path, cast(sum(n_species) as bigint) as n_species, cast(sum(n_obs) as bigint) as n_obs
from taxon_tree where quality_grade = 'research' and kingdom is not null and phylum is not null and class is not null group by kingdom, phylum, class"""),
    "taxon_nodes_depth6": _sql(_OBS_TAXA, _TREE, """
select concat_ws('/', kingdom, phylum, class, "order", family, genus) as path, cast(sum(n_species) as bigint) as n_species, cast(sum(n_obs) as bigint) as n_obs
from taxon_tree where class in ('red','hot') group by kingdom, phylum, class, "order", family, genus"""),
    "taxon_top40": _sql(_OBS_TAXA, _TREE, """
select "order" as label, concat_ws('/', kingdom, phylum, class, "order") as path, cast(sum(n_obs) as bigint) as n_obs, cast(sum(n_species) as bigint) as n_species
from taxon_tree where kingdom is not null and phylum is not null and class is not null and "order" is not null
group by kingdom, phylum, class, "order" order by n_obs desc, path limit 40"""),
    "taxon_options": _sql(_OBS_TAXA, _TREE + """,
graded as (select * from taxon_tree where quality_grade = 'research'),
options as (
  select 'kingdom' as level, kingdom as value, cast(sum(n_species) as bigint) as n from graded where kingdom <> '' group by 2
  union all
  select 'phylum', phylum, cast(sum(n_species) as bigint) from graded where kingdom in ('STANDARD','PROMO') and phylum <> '' group by 2
  union all
  select 'class', class, cast(sum(n_species) as bigint) from graded where kingdom in ('STANDARD','PROMO') and class <> '' group by 2
  union all
  select 'order', "order", cast(sum(n_species) as bigint) from graded where kingdom in ('STANDARD','PROMO') and class in ('red','blue','old') and "order" <> '' group by 2),
placed as (
  select *, cast(row_number() over (partition by level order by n desc, value) as int) as position, count(*) over (partition by level) as total from options)""",
        "select level, position, value, n, greatest(total - 30, 0) as more from placed where position <= 30"),
    "headline_stats": _sql([*_OBS_TAXA, "eco_ring"], _HEX + "," + _TREE_BODY + "," + _COVER, """
select cast(coalesce(sum(n_obs), 0) as bigint) as n_obs,
  (select cast(coalesce(sum(n_species), 0) as bigint) from taxon_tree where quality_grade = 'research' and kingdom in ('PROMO','SMALL')) as n_species,
  count(distinct h3_r3) as n_cells
from hex_density where quality_grade = 'research' and kingdom in ('PROMO','SMALL') and year >= 1997
  and h3_r3 in (select h3_r3 from region_cells where eco_id in (3,5,8,13,21))"""),
    "bias_by_class": _sql(
        _OBS_TAXA, _SPECIES + ",\nscoped as (select * from species_counts where kingdom in ('STANDARD','PROMO','LARGE'))," + _BIAS,
        "select * from bias"),
    "bias_totals": _sql(_OBS_TAXA, _SPECIES, """
select cast(sum(n_obs) as bigint) as total_obs, count(*) as total_species, count(distinct nullif(class, '')) as n_classes
from species_counts where quality_grade = 'research'"""),
    "bias_coverage_long": _sql(
        _OBS_TAXA, _SPECIES + ",\nscoped as (select * from species_counts)," + _BIAS + """,
firsts as (select * from bias order by deviation desc, class limit 30)""", """
select class, 'p1' as metric, p1 as value from firsts union all
select class, 'p20', p20 from firsts union all select class, 'p20d', p20d from firsts"""),
    "species_page": _sql(_SPECIES_LIST_VIEWS, _SPECIES_LIST + """,
scoped as (select * from species_list where quality_grade = 'research')""", """
select *, (select count(*) from scoped) as total, cast(greatest(ceil((select count(*) from scoped)/24.0), 1) as int) as pages
from scoped order by n_obs desc nulls last, taxon_id, quality_grade limit 24 offset 24"""),
    "species_search": _sql(_SPECIES_LIST_VIEWS, _SPECIES_LIST + """,
scoped as (select * from species_list where regexp_matches(name, '^(OLD|new) .*1', 'i'))""", """
select *, (select count(*) from scoped) as total, cast(greatest(ceil((select count(*) from scoped)/50.0), 1) as int) as pages
from scoped order by name nulls last, taxon_id, quality_grade limit 50"""),
    "species_profile": _sql(
        [*_SPECIES_LIST_VIEWS, "description_raw"],
        _PHOTO_PICK + "," + _LINK + "," + _VERNACULAR + "," + _DESCRIPTION + """,
counts as (
  select taxon_id, count(*) as n_obs, count(distinct observer_id) as n_observers, min(year) as first_year, max(year) as last_year
  from obs group by taxon_id),
names as (
  select * from (select j.taxon_id, v."vernacularName" as vernacular_name, v.language as vernac_lang,
      row_number() over (partition by j.taxon_id order by case when v.language in ('es','ES','spa') then 0 else 1 end, v.language, v."vernacularName") as rn
    from link j join vernacular v on v.gbif_id = j.gbif_id) x where rn = 1),
texts as (
  select * from (select j.taxon_id, d.description, d.source as desc_source, d.license as desc_license,
      row_number() over (partition by j.taxon_id order by case when lower(d.type) = 'description' then 0 else 1 end, d.description, d.source, d.license) as rn
    from link j join description d on d.gbif_id = j.gbif_id where d.type is not null) x where rn = 1)""", """
select t.taxon_id, t.name, t."rank", t.kingdom, t.phylum, t.class, t."order", t.family, t.genus,
  coalesce(c.n_obs, 0) as n_obs, coalesce(c.n_observers, 0) as n_observers, c.first_year, c.last_year,
  n.vernacular_name, n.vernac_lang, x.description, x.desc_source, x.desc_license,
  p.photo_url, p.photo_license, p.photo_attribution
from taxa t left join counts c on t.taxon_id = c.taxon_id left join names n on t.taxon_id = n.taxon_id
left join texts x on t.taxon_id = x.taxon_id left join photo_pick p on t.taxon_id = p.taxon_id where t.name is not null"""),
    "ecoregion_meta": _sql(["ecoregions"], "", "select * from ecoregions where eco_id > 0 order by biome_num, eco_name"),
    "ecoregion_counts": _sql(["ecoregions", "eco_ring"], _COVER, """
select count(*) as n_regions, count(distinct biome_num) as n_biomes, count(distinct realm) as n_realms,
  (select count(distinct h3_r3) from region_cells) as n_cells from ecoregions where eco_id > 0"""),
    "biome_groups": _sql(["ecoregions"], "", """
select biome_num, min(biome_name) as biome_name, string_agg(cast(eco_id as varchar), ',' order by eco_id) as eco_ids, count(*) as n_regions
from ecoregions where eco_id > 0 group by biome_num"""),
    "biome_toggle": _sql(["ecoregions"], """
selected as (select eco_id, biome_num from ecoregions where eco_id > 0 and (biome_num = 1 or (biome_num = 2 and eco_id > 10)))""", """
select eco_id, 1 as toggled from selected where biome_num <> 1
union all
select eco_id, 2 from ecoregions where eco_id > 0 and (biome_num = 2 or eco_id in (select eco_id from selected))"""),
    "ecoregion_cells": _sql(["eco_ring"], _COVER, "select * from region_cells"),
    "ecoregion_cell_sets": _sql(["eco_ring"], _COVER, """
select eco_id, string_agg(h3_r3, ',' order by h3_r3) as cells from region_cells group by eco_id"""),
    "ecoregion_features": _sql(["ecoregions", "eco_ring"], "", """
select e.eco_id, eco_name, biome_num, biome_name, realm, 1 as n_parts, cast(count(*) as int) as n_points,
  min(lon) as west, max(lon) as east, min(lat) as south, max(lat) as north
from ecoregions e join eco_ring r on e.eco_id = r.eco_id where e.eco_id > 0 group by all"""),
    "retrieval_stage1": _sql(_RETRIEVAL_VIEWS, _SCORES, 'select * from stage1 where "rank" <= 10'),
    "retrieval_stage1_pruned": _sql(_RETRIEVAL_VIEWS, _SCORES, 'select * from stage1 where "rank" <= 10'),
    "retrieval_stage2": _sql(_RETRIEVAL_VIEWS, _STAGE2, "select * from stage2"),
    "retrieval_stage3": _sql(_RETRIEVAL_VIEWS, _STAGE2 + """,
tops as (
  select query_id, count(*) as n, max(case when rank_final = 1 then name end) as predicted_species,
    max(case when rank_final = 1 then family end) as family, max(case when rank_final = 1 then "order" end) as "order",
    max(case when rank_final = 1 then score_final end) as s1, max(case when rank_final = 2 then score_final end) as s2,
    max(case when rank_final = 1 and subrepresented then 1 else 0 end) as rare
  from stage2 group by query_id),
votes as (
  select t.*, coalesce(s1 - s2, s1) as m,
    (select count(*) from stage2 s where s.query_id = t.query_id and s.family = t.family and s.family <> '')/cast(n as double) as fc,
    (select count(*) from stage2 s where s.query_id = t.query_id and s."order" = t."order" and s."order" <> '')/cast(n as double) as oc
  from tops t)""", """
select q.query_id, predicted_species, family, "order",
  case when s1 > 0.85 and m > 0.03 then 'alta' when s1 > 0.70 then 'media' else 'baja' end as confidence,
  (cast(printf('%.4f', cast(m as double)) as double) + cast(0 as double)) as margin, (cast(printf('%.2f', cast(fc as double)) as double) + cast(0 as double)) as family_consensus, (cast(printf('%.2f', cast(oc as double)) as double) + cast(0 as double)) as order_consensus,
  case when n is null then 'Sin candidatos.' else
    printf('Top-1 ''%s'' con score_final=%.4f; margen sobre #2 = %.4f; consenso de familia en top-%d = %d%%; consenso de orden = %d%%',
      predicted_species, s1, (cast(printf('%.4f', cast(m as double)) as double) + cast(0 as double)), n, cast((cast(printf('%.0f', cast(fc*100 as double)) as double) + cast(0 as double)) as int), cast((cast(printf('%.0f', cast(oc*100 as double)) as double) + cast(0 as double)) as int))
    || case when rare = 1 then '; especie subrepresentada en el dataset (pocos registros de referencia)' else '' end || '.' end as rationale
from query_vec q left join votes v on q.query_id = v.query_id"""),
    "retrieval_predictions": _sql(_RETRIEVAL_VIEWS, _PREDICTIONS, "select * from predictions"),
    "retrieval_known": _sql(_RETRIEVAL_VIEWS, _PREDICTIONS, """
select q.query_id, q.known_species, p.name as top1_name, coalesce(lower(p.name) = lower(q.known_species), false) as top1_is_known
from query_vec q join predictions p on q.query_id = p.query_id and p.rank_final = 1 where q.known_species <> ''"""),
    "embedding_profile": f"""
select 'embeddings.parquet' as file, count(*) as rows, count(n) as sample_count, cast(max(dim) as int) as dim, {_PROFILE_STATS} from ({_NORMS}) x""",
    "embedding_profile_sample": f"""
select 'embeddings.parquet' as file, (select count(*) from embeddings) as rows, count(n) as sample_count, cast(max(dim) as int) as dim, {_PROFILE_STATS}
from ({_NORMS}) x where nth <= 100""",
    "embedding_totals": "select count(*) as estimated_total_vectors from embeddings",
    "external_species": _sql([], _EXTERNAL, "select * from external_species"),
    "external_page": _sql([], _EXTERNAL + """,
scoped as (select * from external_species where regexp_matches(name, 'brand|ring', 'i'))""", """
select *, (select count(*) from scoped) as total, cast(greatest(ceil((select count(*) from scoped)/24.0), 1) as int) as pages
from scoped order by dataset_records desc nulls last, taxon_id limit 24 offset 24"""),
    "json_probe": """
select cast(event_id as varchar) as path, 'OBJECT' as kind, array_to_string(json_keys(props), ',') as keys_sample,
  cast(json(props) as varchar) as preview, cast(null as varchar) as error from events""",
    "catalog_status": _sql([*_OBS_TAXA, "ecoregions", "eco_ring"], _HEX + "," + _TREE_BODY + "," + _COVER, """
select 'hex_density' as item, count(*) as n from hex_density union all
select 'country_stats', count(*) from (select distinct h3_r3, kingdom, phylum, quality_grade, year from joined where h3_r3 is not null) x union all
select 'temporal', count(*) from (select distinct year, month, kingdom, phylum, quality_grade from joined where year is not null and month is not null) x union all
select 'taxon_tree', count(*) from taxon_tree union all
select 'species_list', count(*) from (select distinct taxon_id, quality_grade from joined where "rank" = 'species') x union all
select 'ecoregions', count(*) from ecoregions where eco_id > 0 union all
select 'ecoregion_h3_cells', count(*) from region_cells"""),
    "dump_observations": _sql(["obs_dump"], "", "select * from obs_dump"),
    "dump_taxa": _sql(["taxa_raw"], "", "select * replace (cast(taxon_id as integer) as taxon_id) from taxa_raw"),
    "dump_vernacular": _sql(["vernacular_raw"], "", "select * from vernacular_raw"),
    "dump_description": _sql(["description_raw"], "", "select * from description_raw"),
    "roundtrip_sink": _sql(
        ["obs_dump", "taxa_raw", "taxa", "photos_raw", "vernacular_raw", "description_raw", "ecoregions"],
        _PHOTOS + "," + _VERNACULAR + "," + _DESCRIPTION, """
select 'obs' as item, count(*) as n from obs_dump where latitude is not null and longitude is not null
  and try_cast(round(try_cast(positional_accuracy as double)) as int) < 10000 union all
select 'taxa_enriched', count(*) from taxa_raw where active union all
select 'photos', count(*) from photos union all
select 'taxon_join', count(*) from taxa union all
select 'gbif_vernac', count(*) from vernacular union all
select 'gbif_desc', count(*) from description union all
select 'ecoregions_meta', count(*) from ecoregions where eco_id > 0 union all
select 'ecoregion_shapes', count(*) from ecoregions where eco_id > 0"""),
}
