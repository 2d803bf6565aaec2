"""Queries over rosters, object keys, sidecars, sessions and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwitable.functions import paths as P
from dwitable.operators import directions as D
from dwitable.operators import manifest as MF
from dwitable.operators import roster as R
from dwitable.operators import sessions as S
from dwitable.operators.profile import DEEP_LEVEL, DEEP_SITE, MULTI_SITE
from dwitable.operators.report import REPORT_SCHEMA
from dwitable.plans import study
from dwitable.session import materialise, shared_dir
from dwitable.sinks import layout as L
from dwitable.sinks import text as K
from dwitable.sources import keys as KS
from dwitable.sources import listing as LS
from dwitable.sources import sidecars as SC
from dwitable.sources import stored as ST
from dwitable.sources import text as TX
from workload.registry import query

SITES = ("Site-CBIC", "Site-RU", "Site-SI")
ROLES_SQL = ", ".join(f"'{r}'" for r in MF.ROLES)
SESSION_SQL = "('dwi', 'bvec', 'bval', 'epi_ap', 'epi_pa')"

ROSTER_SQL = """both_lists AS (
  SELECT site, participant_id AS subject_id FROM roster WHERE rd = 'raw'
  INTERSECT SELECT site, participant_id FROM roster WHERE rd = 'deriv'),
study AS (SELECT subject_id, max(site) AS site FROM both_lists GROUP BY subject_id)"""

PEOPLE_SQL = "people AS (SELECT DISTINCT subject_id FROM object_keys)"
VALID_SQL = f"""{PEOPLE_SQL},
validity AS (SELECT p.subject_id, count(DISTINCT f.role) = 7 AS valid
             FROM people p LEFT JOIN files f ON p.subject_id = f.subject_id GROUP BY p.subject_id)"""


def _study(t):
    return R.study_roster(R.site_roster(t.roster), SITES)


def _people(t):
    return t.object_keys.select("subject_id").distinct()


def _files(t):
    return MF.classify(t.object_keys)


def _validity(t):
    return MF.subject_validity(_people(t), _files(t))


# ---------------------------------------------------------------- sources

@query("s1_matching_keys", "object_keys", """
SELECT key FROM object_keys
WHERE (starts_with(key, 'data/Projects/HBN/MRI/Site-RU/') OR starts_with(key, 'data/Projects/HBN/MRI/Site-SI/')) AND ends_with(key, '.json')""")
def s1(t):
    return KS.matching_keys(t.object_keys.select("key"), ("data/Projects/HBN/MRI/Site-RU/", "data/Projects/HBN/MRI/Site-SI/"), ".json")


@query("s1_prefix_table", "object_keys wanted_prefixes", """
SELECT o.key AS key, max_by(p.prefix, length(p.prefix)) AS prefix
FROM object_keys o JOIN wanted_prefixes p ON starts_with(o.key, p.prefix) GROUP BY o.key""")
def s1_table(t):
    return KS.key_prefixes(t.object_keys, t.wanted_prefixes)


@query("s1_stored_listing", "listing_pages", """
SELECT bucket, key, count(*) AS n FROM (
  SELECT bucket, unnest(regexp_extract_all(xml, '<Key>([^<]*)</Key>', 1)) AS key FROM (SELECT DISTINCT bucket, xml FROM listing_pages) AS p) AS k
WHERE starts_with(key, 'data/Projects/HBN/MRI/Site-RU/derivatives/') AND ends_with(key, '.json') AND bucket IN ('Site-RU', 'Site-SI') GROUP BY bucket, key""")
def s1_stored(t):
    path = shared_dir(t.spark, "listing")
    ST.write_listing(t.listing_pages.select("bucket", "xml"), path)
    listed = ST.read_listing(t.spark, path).filter(F.col("bucket").isin("Site-RU", "Site-SI"))
    wanted = KS.matching_keys(listed, "data/Projects/HBN/MRI/Site-RU/derivatives/", ".json")
    return wanted.groupBy("bucket", "key").agg(F.count(F.lit(1)).alias("n"))


@query("s2_subject_keys", "roster object_keys", f"""+ {ROSTER_SQL}
SELECT o.subject_id, o.site, o.rd, o.key FROM object_keys o
JOIN study s ON o.subject_id = s.subject_id AND o.site = s.site""")
def s2(t):
    return KS.subject_keys(_study(t), t.object_keys.select("key"))


@query("s3_read_participants", "roster", "SELECT DISTINCT site, rd, participant_id FROM roster")
def s3(t):
    path = shared_dir(t.spark, "participants")
    t.roster.write.partitionBy("site", "rd").option("header", "true").option("sep", "\t").csv(path)
    return TX.read_participants(t.spark, path)


@query("s4_read_sidecar", "sidecars", """
SELECT subject_id, key, json_extract_string(body, '$.PhaseEncodingDirection') AS direction,
       CAST(json_extract_string(body, '$.EchoTime') AS DOUBLE) AS echo_time FROM sidecars""")
def s4(t):
    return t.sidecars.select(
        "subject_id", "key", TX.json_field("body", "PhaseEncodingDirection").alias("direction"),
        TX.json_field("body", "EchoTime").cast("double").alias("echo_time"),
    )


@query("s4_sidecar_properties", "mixed_bodies", """
SELECT make, name, CASE WHEN body IS NOT NULL THEN json_valid(body) END AS is_json,
  CASE WHEN json_valid(body) THEN json_extract_string(body, '$.PhaseEncodingDirection') END AS direction,
  CASE WHEN json_valid(body) THEN TRY_CAST(json_extract_string(body, '$.EchoTime') AS DOUBLE) END AS echo_time,
  CASE WHEN json_valid(body) THEN TRY_CAST(json_extract_string(body, '$.Nested.EchoTime') AS DOUBLE) END AS nested_time,
  CASE WHEN json_valid(body) THEN TRY_CAST(json_extract_string(body, '$.eddy_quad.qc_mot_abs') AS BIGINT) END AS qc_mot_abs
FROM mixed_bodies""")
def s4_properties(t):
    types = {"PhaseEncodingDirection": "string", "EchoTime": "double", "Nested/EchoTime": "double", "eddy_quad/qc_mot_abs": "long"}
    names = {"PhaseEncodingDirection": "direction", "EchoTime": "echo_time", "Nested/EchoTime": "nested_time", "eddy_quad/qc_mot_abs": "qc_mot_abs"}
    return SC.with_properties(SC.parsed(t.mixed_bodies), types, names).drop(SC.DOCUMENT)


@query("s4_property_kinds", "mixed_bodies", """
SELECT make, property, kind, count(*) AS n FROM (
  SELECT make, property, CASE json_type(body, '$."' || property || '"') WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'array'
    WHEN 'OBJECT' THEN 'object' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind
  FROM (SELECT make, body, unnest(json_keys(body)) AS property FROM mixed_bodies WHERE json_valid(body) AND json_type(body) = 'OBJECT') AS k) AS p
GROUP BY make, property, kind""")
def s4_kinds(t):
    return SC.property_kinds(SC.parsed(t.mixed_bodies), "make")


@query("s5_read_matrix", "volumes", """
SELECT subject, vol, round(gx, 6) AS gx, round(gy, 6) AS gy, round(gz, 6) AS gz FROM volumes""")
def s5(t):
    path = shared_dir(t.spark, "bvecs")
    K.write_lines(K.vector_lines(t.volumes, width=16), path, "axis")  # three blocks a scan and a rest
    vectors = TX.b_vectors(TX.matrix_entries(TX.read_written_lines(t.spark, path)))
    return vectors.select("subject", F.col("vol").cast("long").alias("vol"), *[F.round(a, 6).alias(a) for a in ("gx", "gy", "gz")])


@query("s5_read_bvals", "volumes", "SELECT subject, vol, CAST(bval AS DOUBLE) AS bval FROM volumes")
def s5_bvals(t):
    path = shared_dir(t.spark, "bvals")
    K.write_lines(K.vector_lines(t.volumes, ("bval",), width=7), path, "axis")
    values = TX.b_values(TX.matrix_entries(TX.read_written_lines(t.spark, path)))
    return values.select("subject", F.col("vol").cast("long").alias("vol"), "bval")


@query("s6_read_table_lenient", "text_rows", """
SELECT subject, vol AS row, n AS col, try_cast(w AS DOUBLE) AS value, try_cast(w AS DOUBLE) IS NULL AS bad
FROM (SELECT subject, vol, unnest(words) AS w, CAST(generate_subscripts(words, 1) - 1 AS BIGINT) AS n
      FROM (SELECT subject, vol, regexp_split_to_array(trim(line), '\\s+') AS words FROM text_rows) AS a) AS b""")
def s6(t):
    path = shared_dir(t.spark, "rms")
    K.write_lines(t.text_rows, path, "vol", width=16)
    entries = TX.matrix_entries(TX.read_written_lines(t.spark, path), bad=float("nan"))
    return entries.select(
        "subject", F.col("row").cast("long").alias("row"),
        F.col("col").cast("long").alias("col"), F.when(~F.isnan("value"), F.col("value")).alias("value"),
        F.isnan("value").alias("bad"),
    )


@query("s7_read_lines", "", """
SELECT doc_id, line_no, line FROM (
  SELECT doc_id, unnest(parts) AS line, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS line_no
  FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS parts FROM documents) AS a) AS b""")
def s7(t):
    bodies = t.spark.read.parquet(f"{t.sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("body"))
    return TX.explode_lines(bodies).withColumn("line_no", F.col("line_no").cast("long"))


@query("s8_read_qc", "qc", """
SELECT bucket, subject, qc_mot_abs, qc_mot_rel FROM qc""")
def s8(t):
    path = shared_dir(t.spark, "qc")
    K.write_json(t.qc, path, ("bucket", "subject"))
    return TX.read_qc(t.spark, path, f"bucket string, subject long, {TX.QC_SCHEMA}", one_per_line=True)


@query("s9_listing_page", "listing_pages", """
SELECT subject_id, bucket, page_no, array_to_string(regexp_extract_all(xml, '<Key>([^<]*)</Key>', 1), '|') AS keys,
  regexp_extract(xml, '<IsTruncated>([^<]*)<', 1) = 'true' AS truncated,
  CASE WHEN contains(xml, '<IsTruncated>true') THEN url_encode(regexp_extract(xml, 'ContinuationToken>([^<]*)<', 1)) END AS token
FROM listing_pages""")
def s9(t):
    return LS.parse_pages(t.listing_pages).withColumn("keys", F.array_join("keys", "|"))


PAGES_SQL = """page AS (
  SELECT bucket, coalesce(requested, '') AS asked, count(*) AS copies, bool_or(contains(xml, '<IsTruncated>true')) AS truncated,
    min(CASE WHEN contains(xml, '<IsTruncated>true') THEN url_encode(regexp_extract(xml, 'ContinuationToken>([^<]*)<', 1)) END) AS onto
  FROM listing_responses GROUP BY ALL),
pages_of AS (SELECT bucket, count(*) AS n FROM page GROUP BY bucket),
walk AS (
  SELECT bucket, asked, onto, CAST(0 AS BIGINT) AS position FROM page WHERE asked = ''
  UNION ALL
  SELECT p.bucket, p.asked, p.onto, w.position + 1 FROM walk w JOIN pages_of s ON s.bucket = w.bucket
  JOIN page p ON p.bucket = w.bucket AND p.asked = w.onto WHERE w.position < s.n),
placed AS (SELECT bucket, asked, min(position) AS position FROM walk GROUP BY bucket, asked)"""


@query("s9_listing_chain", "listing_responses", f"""+ {PAGES_SQL}
SELECT r.bucket AS bucket, requested, position, md5(xml) AS page FROM listing_responses r
LEFT JOIN placed ON placed.bucket = r.bucket AND placed.asked = coalesce(requested, '')""", recursive=True)
def s9_chain(t):
    return LS.chained_pages(t.listing_responses).select("bucket", "requested", "position", F.md5("xml").alias("page"))


@query("s9_chain_report", "listing_responses", f"""+ {PAGES_SQL},
joined AS (
  SELECT page.*, position, max(position) OVER (PARTITION BY page.bucket) AS top FROM page LEFT JOIN placed USING (bucket, asked)),
tail AS (SELECT j.bucket, j.truncated, p.asked IS NOT NULL AS back FROM joined j LEFT JOIN placed p ON p.bucket = j.bucket AND p.asked = j.onto
  WHERE j.position = j.top)
SELECT j.bucket AS bucket, CASE WHEN count(position) = 0 THEN 'headless' WHEN bool_or(back) THEN 'cyclic'
    WHEN bool_or(tail.truncated) THEN CASE WHEN count(position) = count(*) THEN 'unfinished' ELSE 'broken' END
    WHEN count(position) = count(*) THEN 'complete' ELSE 'extra' END AS status,
  CAST(sum(copies) AS BIGINT) AS n_stored, count(*) AS n_pages, count(position) AS n_chained
FROM joined j LEFT JOIN tail ON tail.bucket = j.bucket GROUP BY j.bucket""", recursive=True)
def s9_report(t):
    return LS.chain_report(t.listing_responses)


@query("s10_reports_with_qc", "report_json", """
SELECT bucket, subject, CAST(json_extract_string(body, '$.eddy_quad.qc_mot_abs') AS DOUBLE) AS qc_mot_abs,
  CAST(json_extract_string(body, '$.eddy_quad.qc_mot_rel') AS DOUBLE) AS qc_mot_rel
FROM report_json WHERE json_extract_string(body, '$.eddy_quad') IS NOT NULL""")
def s10(t):
    reports = LS.reports_with_qc(t.report_json, REPORT_SCHEMA).filter("coalesce(report.part, 0) = 0")
    return reports.select("bucket", "subject", "report.eddy_quad.qc_mot_abs", "report.eddy_quad.qc_mot_rel")


@query("s11_bids_subjects", "object_keys", """
SELECT DISTINCT regexp_extract(key, '/sub-([^/]+)/', 1) AS subject FROM object_keys""")
def s11(t):
    return KS.bids_subjects(t.object_keys.select("key"))


OUTPUTS_SQL = """outs AS (SELECT '/data/out/' || subject_id || CASE WHEN rd = 'deriv' THEN '/dwitable/' ELSE '/other/' END ||
  'f' || CAST(tid AS STRING) || '.nii.gz' AS key FROM object_keys)"""


def _outputs(t):
    area = F.when(F.col("rd") == "deriv", F.lit("/dwitable/")).otherwise(F.lit("/other/"))
    return t.object_keys.select(
        F.concat(F.lit("/data/out/"), "subject_id", area, F.lit("f"), F.col("tid").cast("string"), F.lit(".nii.gz")).alias("key")
    )


@query("s12_output_files", "object_keys", f"""+ {OUTPUTS_SQL}
SELECT key, replace(key, '/data/out/', '') AS object_key FROM outs WHERE contains(key, '/dwitable/')""")
def s12(t):
    return KS.output_files(_outputs(t), "/data/out", L.PIPELINE)


# ---------------------------------------------------------------- sinks

@query("k1_output_layout", "volumes", """
SELECT subject AS subject_id, 'b' || CAST(bval AS STRING) AS category, vol, round(rms_abs, 6) AS rms_abs FROM volumes""")
def k1(t):
    path = shared_dir(t.spark, "layout")
    rows = t.volumes.select(F.col("subject").alias("subject_id"), F.concat(F.lit("b"), F.col("bval").cast("string")).alias("category"), "vol", F.round("rms_abs", 6).alias("rms_abs"))
    L.write_by_category(rows, path)
    return t.spark.read.parquet(path).select(F.col("subject_id").cast("long").alias("subject_id"), "category", "vol", "rms_abs")


@query("k1_added_subjects", "volumes", """
SELECT subject AS subject_id, 'b' || CAST(bval AS STRING) AS category, vol, CASE WHEN subject % 3 = 0 THEN 'second' ELSE 'first' END AS pass
FROM volumes WHERE NOT (subject % 3 = 0 AND vol >= 40)""")
def k1_added(t):
    path = shared_dir(t.spark, "layout")
    rows = t.volumes.select(F.col("subject").alias("subject_id"), F.concat(F.lit("b"), F.col("bval").cast("string")).alias("category"), "vol", F.lit("first").alias("pass"))
    L.write_by_category(rows, path)
    L.write_by_category(rows.where("subject_id % 3 = 0 and vol < 40").withColumn("pass", F.lit("second")), path)
    return t.spark.read.parquet(path).select(F.col("subject_id").cast("long").alias("subject_id"), "category", "vol", "pass")


@query("k3_added_lines", "volumes", """
SELECT subject, vol AS line_no, CASE WHEN subject % 4 = 1 THEN 'again ' ELSE '' END || CAST(vol AS STRING) AS line
FROM volumes WHERE dropped = 1 AND subject % 5 <> 2""")
def k3_added(t):
    path = shared_dir(t.spark, "dropped")
    dropped = t.volumes.filter("dropped = 1").select("subject", "vol", K.integer_line("vol").alias("line"))
    K.write_lines(dropped, path, "vol", buckets=8)
    again = dropped.where("subject % 4 = 1 and subject % 5 <> 2").withColumn("line", F.concat(F.lit("again "), "line"))
    none = t.volumes.where("subject % 5 = 2").select("subject").distinct()
    K.write_lines(again, path, "vol", subjects=none)
    return TX.read_written_lines(t.spark, path).select("subject", "line_no", "line")


@query("k1_output_path", "files", """
SELECT key, '/data/out/' || subject_id || '/dwitable/' || role || '/' || regexp_extract(key, '([^/]*)$', 1) AS path FROM files""")
def k1_path(t):
    return _files(t).select("key", L.output_path("/data/out", "subject_id", "role", P.last_segment("key")).alias("path"))


# Outputs of the tool chain, and the names they must get in the paired and in the single flow, written down one by one: ``BASE`` is
# the image's name, ``STEM`` that without its ``_dwi``. Names begin below the subject's folder.
TOOL_NAMES = (
    ("derivatives/dwitable/dwi/eddy_corrected.nii.gz", "dwitable/dwi/STEM_dwi.nii.gz", "dwitable/dwi/eddy_corrected.nii.gz"),
    ("derivatives/dwitable/dti/eddy_corrected_thinned_color_fa.nii.gz", "dwitable/dti/STEM_colorfa.nii.gz",
     "dwitable/dti/eddy_corrected_thinned_color_fa.nii.gz"),
    ("derivatives/dwitable/dwi/eddy_corrected_rotatedanat_space_thinned.bvec", "dwitable/dwi/STEM_dwi.bvec",
     "dwitable/dwi/eddy_corrected_rotatedanat_space_thinned.bvec"),
    ("derivatives/dwitable/anat/aparc+aseg_outbin.nii.gz", "dwitable/anat/STEM_mask.nii.gz", "dwitable/anat/aparc+aseg_outbin.nii.gz"),
    ("derivatives/dwitable/anat/orig_out.nii.gz", "dwitable/anat/STEM_T1w.nii.gz", "dwitable/anat/orig_out.nii.gz"),
    ("derivatives/dwitable/anat/aparc+asegbin_warped_thresh.nii.gz", "dwitable/anat/aparc+asegbin_thresh.nii.gz",
     "dwitable/anat/STEM_mask.nii.gz"),
    ("derivatives/dwitable/art/stats.vol0000_flirt_merged.txt", "dwitable/art/BASE.art.json", "dwitable/art/BASE.art.json"),
    ("derivatives/dwitable/art/motion_parameters.par", "dwitable/art/BASE.motion.txt", "dwitable/art/BASE.motion.txt"),
    ("derivatives/dwitable/qc/eddy_corrected.eddy_parameters", "dwitable/qc/BASE.eddy_parameters",
     "dwitable/qc/eddy_corrected.eddy_parameters"),
    ("derivatives/dwitable/qc/dropped_scans.txt", "dwitable/qc/STEM_dwi_dropped_scans.txt", "dwitable/qc/dropped_scans.txt"),
    ("derivatives/dwitable/report/report.json", "dwitable/report/STEM_dwi_report.json", "dwitable/report/report.json"),
    ("derivatives/dwitable/dti/eddy_corrected_warped_maths.nii.gz", "dwitable/dti/STEM_scaled.nii.gz",
     "dwitable/dti/eddy_corrected_warped_maths.nii.gz"),
)
TOOL_VALUES = ", ".join(str(names) for names in TOOL_NAMES)


def _named_sql(column: str) -> str:
    """An expected name with its place holders filled."""
    return f"'derivatives/' || subject_id || '/' || replace(replace({column}, 'BASE', base), 'STEM', replace(base, '_dwi', ''))"


@query("k2_final_names", "files", f"""+ bases AS (
  SELECT subject_id, replace(regexp_extract(key, '([^/]*)$', 1), '.nii.gz', '') AS base FROM files WHERE role = 'dwi'),
named AS (SELECT * FROM (VALUES {TOOL_VALUES}) AS t(path, paired, single))
SELECT subject_id, base, path, {_named_sql("paired")} AS final, {_named_sql("single")} AS final_single FROM bases CROSS JOIN named""")
def k2(t):
    outs = _files(t).filter("role = 'dwi'").select(
        "subject_id", P.image_basename("key").alias("base"), F.explode(F.array(*[F.lit(n[0]) for n in TOOL_NAMES])).alias("path")
    )
    return outs.select(
        "subject_id", "base", "path", L.named("path", "base", "subject_id").alias("final"),
        L.named("path", "base", "subject_id", L.SINGLE_NAMES).alias("final_single"),
    )


@query("k7_transfer_manifest", "files", """+ t AS (
  SELECT subject_id, key, '/tmp/study/' || string_split(key, '/' || site || '/')[-1] AS target, bal FROM files)
SELECT subject_id, key, target FROM t WHERE target NOT IN (SELECT target FROM t WHERE bal > 5000)""")
def k7(t):
    files = _files(t)
    target = P.target_path("key", "site", "/tmp/study").alias("target")
    existing = files.filter("bal > 5000").select(target)
    return L.transfer_manifest(files.select("subject_id", "key", target), existing)


@query("flow_upload", "object_keys", f"""+ {OUTPUTS_SQL}
SELECT key, replace(key, '/data/out/', '') AS object_key FROM outs WHERE contains(key, '/dwitable/')
AND replace(key, '/data/out/', '') NOT IN (SELECT 'sub-P' || lpad(CAST(c_custkey AS STRING), 8, '0') || '/dwitable/f11.nii.gz' FROM customer)""")
def flow_upload(t):
    there = t.spark.read.parquet(f"{t.sf_dir}/customer.parquet").select(F.concat(
        F.lit("sub-P"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.lit("/dwitable/f11.nii.gz")).alias("object_key"))
    return study.upload(_outputs(t), "/data/out", L.PIPELINE, there)


@query("k8_upload_key", "object_keys", f"""+ {OUTPUTS_SQL}
SELECT key AS path, replace(key, '/data/out/', '') AS object_key FROM outs""")
def k8(t):
    return L.upload_manifest(_outputs(t).select(F.col("key").alias("path")), "/data/out/")


# ---------------------------------------------------------------- paths

@query("p1_split_extensions", "object_keys", r"""
SELECT key, regexp_extract(key, '^((?:.*/)?\.*[^./]*)', 1) || coalesce('|' || nullif(array_to_string(regexp_extract_all(
  substr(key, length(regexp_extract(key, '^((?:.*/)?\.*[^./]*)', 1)) + 1), '(\.[^.]*)', 1), '|'), ''), '') AS parts
FROM object_keys""")
def p1(t):
    return t.object_keys.select("key", F.array_join(P.split_extensions("key"), "|").alias("parts"))


@query("p2_cumulative_paths", "object_keys", """+ s AS (
  SELECT key, regexp_extract(key, '([^/]*)$', 1) AS name, regexp_extract(key, '^(.*/)', 1) AS dir FROM object_keys),
w AS (SELECT key, dir, string_split(name, '.') AS parts FROM s)
SELECT key, array_to_string(list_transform(range(1, len(parts) + 1), lambda n: dir || array_to_string(parts[1:n], '.') || '.json'), '|') AS names
FROM w""")
def p2(t):
    return t.object_keys.select("key", F.array_join(P.cumulative_paths(P.split_extensions("key"), "json"), "|").alias("names"))


@query("p3_target_path", "object_keys", """
SELECT key, '/tmp/study/' || string_split(key, '/' || site || '/')[-1] AS target,
  '/tmp/study/' || site || '/' || string_split(key, '/' || site || '/')[-1] AS target_by_site FROM object_keys""")
def p3(t):
    return t.object_keys.select(
        "key", P.target_path("key", "site", "/tmp/study").alias("target"),
        P.target_path("key", "site", "/tmp/study/", include_site=True).alias("target_by_site"),
    )


@query("p4_session_id", "object_keys", """
SELECT key, coalesce(nullif(regexp_extract(key, '/(ses-[0-9a-zA-Z]*)/', 1), ''), 'null') AS session FROM object_keys""")
def p4(t):
    return t.object_keys.select("key", P.session_id("key").alias("session"))


@query("p5_basename", "files", """+ b AS (
  SELECT key, string_split(regexp_extract(key, '([^/]*)$', 1), '.nii.gz')[1] AS base FROM files)
SELECT key, base, CASE WHEN base LIKE 'sub-%' THEN string_split(base, '_')[1] END AS subject FROM b""")
def p5(t):
    return _files(t).select("key", P.image_basename("key").alias("base"), P.subject_token("key").alias("subject"))


@query("p6_eddy_base", "files", """
SELECT key, string_split(string_split(replace(key, '_dwi', '_dwi_fix'), '.nii.gz')[1], '_fix')[1] AS base,
  string_split(replace(key, '_dwi', '_dwi_fix'), '.nii.gz')[1] || '.qc' AS qc_dir FROM files WHERE role = 'dwi'""")
def p6(t):
    fixed = F.replace(F.col("key"), F.lit("_dwi"), F.lit("_dwi_fix"))
    return _files(t).filter("role = 'dwi'").select("key", P.eddy_base(fixed).alias("base"), P.qc_dir(fixed).alias("qc_dir"))


@query("p7_with_suffix", "object_keys", r"""+ s AS (
  SELECT key, regexp_extract(key, '^(.*/)', 1) AS dir, regexp_extract(key, '([^/]*)$', 1) AS name FROM object_keys),
e AS (SELECT *, CASE WHEN name LIKE '%.nii.gz' THEN '.nii.gz' ELSE regexp_extract(name, '(\.[^.]*)$', 1) END AS ext FROM s),
b AS (SELECT *, left(name, length(name) - length(ext)) AS stem FROM e)
SELECT key, dir || stem || '_thinned' || ext AS thinned, '/tmp/w/' || stem || 'bin.nii.gz' AS binary_path FROM b""")
def p7(t):
    return t.object_keys.select(
        "key", P.with_suffix("key", "_thinned").alias("thinned"),
        P.with_suffix("key", "bin.nii.gz", new_dir="/tmp/w", use_ext=False).alias("binary_path"),
    )


@query("p8_fixed_paths", "object_keys", """
SELECT DISTINCT subject_id, '/bids/derivatives/' || subject_id AS subjects_dir,
  '/bids/derivatives/' || subject_id || '/freesurfer/mri/aparc+aseg.mgz' AS aparc_aseg,
  '/bids/derivatives/' || subject_id || '/freesurfer/mri/orig.mgz' AS orig FROM object_keys""")
def p8(t):
    here = P.derivatives_dir(F.lit("/bids"), "subject_id")
    return _people(t).select(
        "subject_id", here.alias("subjects_dir"), P.aparc_aseg(here).alias("aparc_aseg"), P.orig(here).alias("orig")
    )


@query("p9_drop_level", "object_keys", """
SELECT key, CASE WHEN site = 'Site-CBIC' THEN replace(key, 'T1w_VNavNorm/', '') ELSE key END AS path FROM object_keys""")
def p9(t):
    return t.object_keys.select("key", P.drop_level("key", "site", DEEP_SITE, DEEP_LEVEL).alias("path"))


REPORT_KEYS_SQL = """found AS (
  SELECT bucket, unnest(regexp_extract_all(xml, '<Key>([^<]*)</Key>', 1)) AS key FROM listing_pages)"""


def _found(t):
    return t.listing_pages.select("bucket", F.explode(LS.page_keys("xml")).alias("key"))


@query("p10_report_subject", "listing_pages", f"""+ {REPORT_KEYS_SQL}
SELECT key, string_split(key, '/')[1] AS subject FROM found WHERE key LIKE '%\\_report.json' ESCAPE '\\'""")
def p10(t):
    return LS.report_keys(_found(t)).select("key", P.report_subject("key").alias("subject"))


@query("p11_report_url", "listing_pages", f"""+ {REPORT_KEYS_SQL}
SELECT bucket, key, 'https://s3-us-west-2.amazonaws.com/' || bucket || '/' || key AS url, key AS back FROM found""")
def p11(t):
    urls = _found(t).withColumn("url", P.report_url("bucket", "key"))
    return urls.withColumn("back", P.report_key("url", "bucket"))


@query("p12_encode_token", "object_keys", """
SELECT key, replace(replace(replace(replace(replace(url_encode(key || ' +/=()!'), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') AS token
FROM object_keys""")
def p12(t):
    return t.object_keys.select("key", P.encode_component(F.concat("key", F.lit(" +/=()!"))).alias("token"))


@query("p13_relabel_session", "sited", """
SELECT key, CASE WHEN session = 'null' THEN 'ses-01' ELSE session END AS labelled,
  CASE WHEN session = 'null' THEN NULL ELSE session END AS unlabelled FROM sited""")
def p13(t):
    return t.sited.select(
        "key", P.relabel_session("session").alias("labelled"), P.relabel_session("session", False).alias("unlabelled")
    )


# ---------------------------------------------------------------- filters and classification

@query("f1_classify", "files", "SELECT subject_id, site, rd, key, role FROM files")
def f1(t):
    return _files(t).select("subject_id", "site", "rd", "key", "role")


@query("f2_site_anatomy", "files", """
SELECT subject_id, role, key FROM files
WHERE NOT (site = 'Site-CBIC' AND role IN ('t1w', 'freesurfer')) OR contains(key, 'T1w_VNavNorm')""")
def f2(t):
    return MULTI_SITE.key_filter(_files(t)).select("subject_id", "role", "key")


ENTITIES_SQL = r"""ents AS (SELECT subject_id, key,
  nullif(regexp_extract(key, '/(anat|dwi|fmap|func)/[^/]*$', 1), '') AS datatype,
  nullif(regexp_extract(regexp_extract(key, '([^/]*)$', 1), '_([^_.]+)\.[^/]*$', 1), '') AS suffix,
  nullif(regexp_extract(regexp_extract(key, '([^/]*)$', 1), '_dir-([^_.]+)', 1), '') AS direction,
  nullif(regexp_extract(regexp_extract(key, '([^/]*)$', 1), '^[^.]*(\..*)$', 1), '') AS extension FROM object_keys),
inputs AS (SELECT * FROM (SELECT subject_id, key, CASE
  WHEN datatype = 'fmap' AND suffix = 'epi' AND extension IN ('.nii', '.nii.gz') AND direction = 'AP' THEN 'ap'
  WHEN datatype = 'fmap' AND suffix = 'epi' AND extension IN ('.nii', '.nii.gz') AND direction = 'PA' THEN 'pa'
  WHEN datatype = 'dwi' AND suffix = 'dwi' AND contains(key, '/' || subject_id || '/') AND key LIKE '%.nii.gz' AND NOT contains(key, 'TRACE') THEN 'dwi'
  WHEN datatype = 'dwi' AND suffix = 'dwi' AND key LIKE '%.bval' THEN 'bval'
  WHEN datatype = 'dwi' AND suffix = 'dwi' AND key LIKE '%.bvec' THEN 'bvec' END AS role FROM ents) AS c WHERE role IS NOT NULL)"""


def _inputs(t):
    return MF.workflow_roles(MF.bids_files(t.object_keys.select("subject_id", "key")))


@query("f3_entity_query", "object_keys", f"""+ {ENTITIES_SQL}
SELECT subject_id, datatype, suffix, direction, extension, key FROM ents
WHERE datatype = 'fmap' AND suffix = 'epi' AND direction = 'AP' AND extension IN ('.nii', '.nii.gz')""")
def f3(t):
    e = MF.bids_files(t.object_keys.select("subject_id", "key"))
    chosen = e.filter("e_datatype = 'fmap' AND e_suffix = 'epi' AND e_direction = 'AP' AND e_extension IN ('.nii', '.nii.gz')")
    return chosen.select("subject_id", *[F.col(f"e_{n}").alias(n) for n in ("datatype", "suffix", "direction", "extension")], "key")


@query("f4_own_images", "object_keys", """
SELECT subject_id, key FROM object_keys
WHERE contains(key, '/' || subject_id || '/') AND key LIKE '%.nii.gz' AND NOT contains(key, 'TRACE')""")
def f4(t):
    return MF.own_images(t.object_keys.select("subject_id", "key"))


@query("f5_filename_direction", "sidecars", """
SELECT key, CASE WHEN contains(key, 'dir-AP') THEN 'AP' WHEN contains(key, 'dir-PA') THEN 'PA' END AS direction FROM sidecars""")
def f5(t):
    return D.determine_directions(t.sidecars, "filename").select("key", "direction")


@query("f6_direction", "sited", "SELECT subject_id, key, direction FROM directed")
def f6(t):
    return D.determine_directions(t.sidecars).select("subject_id", "key", "direction")


@query("f6_direction_validity", "sited", """
SELECT subject_id, bool_and(direction IS NOT NULL) AS valid FROM directed GROUP BY subject_id""")
def f6_validity(t):
    return D.direction_validity(D.determine_directions(t.sidecars))


@query("f7_direction_warning", "sited", """
SELECT key, CASE WHEN v IS NULL THEN 'missing_key' WHEN v NOT IN ('j', 'j-') THEN 'unknown_value'
  WHEN (v = 'j-' AND contains(key, 'dir-PA')) OR (v = 'j' AND contains(key, 'dir-AP')) THEN 'mismatch' END AS warning FROM directed""")
def f7(t):
    return D.determine_directions(t.sidecars).select("key", "warning")


@query("f10_report_keys", "listing_pages", f"""+ {REPORT_KEYS_SQL}
SELECT bucket, key FROM found WHERE ends_with(key, '_report.json')""")
def f10(t):
    return LS.report_keys(_found(t))


COUNTS_SQL = f"""counts AS (
  SELECT subject_id, session, {", ".join(f"count(*) FILTER (role = '{r}') AS n_{r}" for r in S.SESSION_ROLES)}
  FROM sited WHERE role IN {SESSION_SQL} GROUP BY subject_id, session),
balance AS (SELECT subject_id, session, greatest({", ".join(f"n_{r}" for r in S.SESSION_ROLES)}) AS n_files,
  greatest({", ".join(f"n_{r}" for r in S.SESSION_ROLES)}) = least({", ".join(f"n_{r}" for r in S.SESSION_ROLES)}) AS balanced FROM counts),
agreement AS (SELECT subject_id, bool_and(least({", ".join(f"n_{r}" for r in S.SESSION_ROLES)}) > 0) AS consistent FROM counts GROUP BY subject_id)"""

REASONS_SQL = f"""{VALID_SQL}, {COUNTS_SQL},
faces AS (SELECT subject_id, bool_and(direction IS NOT NULL) AS ok FROM directed GROUP BY subject_id),
anysess AS (SELECT subject_id, bool_or(balanced) AS ok FROM balance GROUP BY subject_id),
reasons AS (SELECT v.subject_id, CASE WHEN NOT v.valid THEN 'missing_files'
  WHEN v.subject_id IN (SELECT subject_id FROM gapped) THEN 'incomplete_fieldmaps' WHEN NOT coalesce(f.ok, false) THEN 'no_direction'
  WHEN NOT coalesce(a.consistent, false) THEN 'session_mismatch' WHEN NOT coalesce(s.ok, false) THEN 'no_session' END AS skip_reason
  FROM validity v LEFT JOIN faces f ON v.subject_id = f.subject_id LEFT JOIN agreement a ON v.subject_id = a.subject_id
  LEFT JOIN anysess s ON v.subject_id = s.subject_id)"""


def _reasons(t):
    files = materialise(_files(t).select("subject_id", "role", "key"), "files")
    validity = MF.subject_validity(_people(t), files)
    return S.reasons_of(validity, S.subject_checks(files, D.determine_directions(t.sidecars)))


@query("f13_skip_reasons", "sited", f"+ {REASONS_SQL}\nSELECT subject_id, skip_reason FROM reasons")
def f13(t):
    return _reasons(t)


@query("f13_reasons_by_parts", "sited", f"+ {REASONS_SQL}\nSELECT subject_id, skip_reason FROM reasons")
def f13_parts(t):
    faced = D.direction_validity(D.determine_directions(t.sidecars))
    return S.skip_reasons(_validity(t), faced, S.session_role_counts(t.sited), MF.sidecar_completeness(_files(t)))


@query("f13_eligible_files", "sited", f"""+ {REASONS_SQL}
SELECT subject_id, role, key, session FROM sited WHERE subject_id IN (SELECT subject_id FROM reasons WHERE skip_reason IS NULL)""")
def f13_files(t):
    return S.eligible(t.sited, _reasons(t))


# ---------------------------------------------------------------- joins

@query("j1_sidecar_lookup", "files", """+ imgs AS (
  SELECT subject_id, regexp_extract(key, '^(.*/)', 1) AS dir, string_split(regexp_extract(key, '([^/]*)$', 1), '.') AS parts
  FROM files WHERE role IN ('dwi', 'bvec', 'bval', 'epi_nii', 't1w')),
names AS (SELECT subject_id, dir, parts, unnest(range(1, len(parts) + 1)) AS n FROM imgs),
wanted AS (SELECT subject_id, dir || array_to_string(parts[1:n], '.') || '.json' AS key FROM names)
SELECT w.subject_id, w.key FROM wanted w JOIN (SELECT subject_id, key FROM object_keys WHERE rd = 'raw' AND key LIKE '%.json') j
ON w.subject_id = j.subject_id AND w.key = j.key""")
def j1(t):
    return MF.sidecars_of(_files(t), t.object_keys)


@query("j2_unknown_subjects", "roster object_keys", f"""+ {ROSTER_SQL}
SELECT DISTINCT subject_id FROM object_keys WHERE subject_id NOT IN (SELECT subject_id FROM study)""")
def j2(t):
    return R.unknown_subjects(t.object_keys, _study(t))


@query("j3_sidecar_completeness", "files", """+ img AS (
  SELECT subject_id, replace(key, '.nii.gz', '.json') AS key FROM files WHERE role = 'epi_nii'),
js AS (SELECT subject_id, key FROM files WHERE role = 'epi_json')
SELECT coalesce(img.subject_id, js.subject_id) AS subject_id, coalesce(img.key, js.key) AS key,
  CASE WHEN js.key IS NULL THEN 'sidecar' ELSE 'image' END AS missing
FROM img FULL OUTER JOIN js ON img.subject_id = js.subject_id AND img.key = js.key WHERE img.key IS NULL OR js.key IS NULL""")
def j3(t):
    return MF.sidecar_completeness(_files(t))


@query("j4_freesurfer_required", "files", f"""+ {PEOPLE_SQL}
SELECT subject_id, subject_id IN (SELECT subject_id FROM object_keys WHERE contains(key, '/freesurfer/')) AS present FROM people""")
def j4(t):
    people = _people(t)
    have = MF.with_freesurfer(people, t.object_keys).withColumn("present", F.lit(True))
    lack = MF.with_freesurfer(people, t.object_keys, present=False).withColumn("present", F.lit(False))
    return have.unionByName(lack)


@query("j9_key_target_pairs", "files", """
SELECT subject_id, site, role, key, '/tmp/study/' || string_split(key, '/' || site || '/')[-1] AS target FROM files""")
def j9(t):
    return MF.positions_paired(_files(t), "/tmp/study")


@query("j9_zip_pairs", "listing_pages", """
SELECT subject_id, page_no, key, replace(key, 'data/', 'local/') AS target FROM (
  SELECT subject_id, page_no, unnest(regexp_extract_all(xml, '<Key>([^<]*)</Key>', 1)) AS key FROM listing_pages) AS k""")
def j9_zip(t):
    pages = t.listing_pages.select("subject_id", "page_no", LS.page_keys("xml").alias("keys"))
    targets = F.transform("keys", lambda k: F.replace(k, F.lit("data/"), F.lit("local/")))
    return MF.zip_pairs(pages.withColumn("targets", targets), "keys", "targets", ("key", "target"))


# ---------------------------------------------------------------- aggregations

@query("a1_subject_validity", "files", f"+ {VALID_SQL}\nSELECT subject_id, valid FROM validity")
def a1(t):
    return _validity(t)


@query("a1_valid_after_filter", "files", f"""+ {VALID_SQL},
kept AS (SELECT * FROM files WHERE NOT (site = 'Site-CBIC' AND role IN ('t1w', 'freesurfer')) OR contains(key, 'T1w_VNavNorm')),
after AS (SELECT p.subject_id, count(DISTINCT f.role) = 7 AS valid FROM people p LEFT JOIN kept f ON p.subject_id = f.subject_id GROUP BY p.subject_id)
SELECT v.subject_id, v.valid, a.valid AS valid_after_filter FROM validity v JOIN after a ON v.subject_id = a.subject_id""")
def a1_after(t):
    files = _files(t)
    return MF.validity_after_filter(_people(t), files, MULTI_SITE.key_filter(files))


@query("a2_register", "files", """
SELECT subject_id, role, row_number() OVER (PARTITION BY subject_id, role ORDER BY key) - 1 AS position, key FROM files""")
def a2(t):
    return MF.register(_files(t))


@query("a3_session_agreement", "sited", f"+ {COUNTS_SQL}\nSELECT subject_id, consistent FROM agreement")
def a3(t):
    return S.session_agreement(S.session_role_counts(t.sited))


@query("a4_session_balance", "sited", f"+ {COUNTS_SQL}\nSELECT subject_id, session, n_files, balanced FROM balance")
def a4(t):
    return S.session_balance(S.session_role_counts(t.sited))


@query("a4_output_register", "sited", f"""+ {COUNTS_SQL}
SELECT s.subject_id, CASE WHEN s.session = 'null' THEN 'ses-01' ELSE s.session END AS output_session, s.role, s.key
FROM sited s JOIN balance b ON s.subject_id = b.subject_id AND s.session = b.session WHERE b.balanced AND s.role IN {SESSION_SQL}""")
def a4_register(t):
    return S.output_register(t.sited)


@query("a5_files_by_session", "sited", f"""
SELECT subject_id, session, role, row_number() OVER (PARTITION BY subject_id, session, role ORDER BY key) - 1 AS position, key
FROM sited WHERE role IN {SESSION_SQL}""")
def a5(t):
    return S.files_by_session(t.sited)


MULTIPLES_SQL = f"""own AS (
  SELECT subject_id, session, role, key, regexp_extract(key, '_run-([0-9a-zA-Z]+)', 1) AS run FROM sited WHERE role IN {SESSION_SQL}),
sets AS (SELECT subject_id, session, run, row_number() OVER (PARTITION BY subject_id, session ORDER BY run) AS set_no,
  count(*) OVER (PARTITION BY subject_id, session) AS n FROM (SELECT DISTINCT subject_id, session, run FROM own) AS d)"""


@query("a6_split_multiples", "sited", f"""+ {MULTIPLES_SQL}
SELECT o.subject_id, o.session, CASE WHEN s.n > 1 THEN o.session || '-' || lpad(CAST(s.set_no AS STRING), 2, '0') ELSE o.session END AS output_session,
  CAST(s.set_no AS INT) AS set_no, o.role, o.key FROM own o JOIN sets s ON o.subject_id = s.subject_id AND o.session = s.session AND o.run = s.run""")
def a6(t):
    return S.split_multiples(t.sited)


@query("a6_concatenate_multiples", "sited", f"""+ {MULTIPLES_SQL}
SELECT o.subject_id, o.session, o.session AS output_session, CAST(s.set_no AS INT) AS set_no, o.role, o.key
FROM own o JOIN sets s ON o.subject_id = s.subject_id AND o.session = s.session AND o.run = s.run""")
def a6_concatenate(t):
    return S.split_multiples(t.sited, "concatenate")


@query("a7_single_file_violations", "object_keys", f"""+ {PEOPLE_SQL}, {ENTITIES_SQL},
expected AS (SELECT subject_id, unnest(['ap', 'pa', 'dwi', 'bval', 'bvec']) AS role FROM people)
SELECT e.subject_id, e.role, count(i.key) AS n FROM expected e
LEFT JOIN inputs i ON e.subject_id = i.subject_id AND e.role = i.role GROUP BY e.subject_id, e.role HAVING count(i.key) <> 1""")
def a7(t):
    return MF.single_file_violations(_people(t), _inputs(t))


@query("a8_workflow_inputs", "object_keys", f"""+ {ENTITIES_SQL},
c AS (SELECT subject_id, {", ".join(f"count(*) FILTER (role = '{r}') AS n_{r}, min(key) FILTER (role = '{r}') AS k_{r}" for r in MF.SINGLE_ROLES)}
      FROM inputs GROUP BY subject_id)
SELECT subject_id, k_dwi AS dwi_file, k_ap AS dwi_file_ap, k_pa AS dwi_file_pa, k_bvec AS bvec_file, k_bval AS bval_file,
  '/bids/derivatives/' || subject_id AS subjects_dir, '/out' AS out_dir, CAST(5 AS INT) AS eddy_niter, CAST(0.02 AS DOUBLE) AS slice_outlier_threshold
FROM c WHERE {" AND ".join(f"n_{r} = 1" for r in MF.SINGLE_ROLES)}""")
def a8(t):
    return MF.workflow_inputs(_inputs(t), "/bids", "/out")


@query("a15_selection_counts", "files", f"""+ {VALID_SQL}
SELECT count(*) AS n_requested, count(*) FILTER (valid) AS n_valid, count(*) FILTER (NOT valid) AS n_discarded FROM validity""")
def a15(t):
    return R.selection_counts(_validity(t))


# ---------------------------------------------------------------- selections, sets, positions

@query("t1_first_subjects", "roster", f"+ {ROSTER_SQL}\nSELECT subject_id, site FROM study ORDER BY subject_id LIMIT 25")
def t1(t):
    return R.select_subjects(_study(t), 25)


@query("t1_all_subjects", "roster", f"+ {ROSTER_SQL}\nSELECT subject_id, site FROM study")
def t1_all(t):
    return R.select_subjects(_study(t), "all")


@query("t2_first_valid", "files", f"+ {VALID_SQL}\nSELECT subject_id, valid FROM validity WHERE valid ORDER BY subject_id LIMIT 40")
def t2(t):
    return R.first_valid(_validity(t), 40)


@query("t2_first_valid_of", "files", f"+ {VALID_SQL}\nSELECT subject_id, valid FROM validity WHERE valid ORDER BY subject_id LIMIT 40")
def t2_of(t):
    return R.first_valid_of(_people(t), lambda batch: MF.subject_validity(batch, _files(t).join(batch, "subject_id", "left_semi")), 40, 16)


@query("t3_one_freesurfer", "files", """+ fs AS (
  SELECT subject_id, key, string_split(key, '/freesurfer/')[1] AS fs_dir FROM files WHERE role = 'freesurfer'),
c AS (SELECT subject_id, min(fs_dir) AS fs_dir FROM fs GROUP BY subject_id)
SELECT fs.subject_id, fs.fs_dir, fs.key FROM fs JOIN c ON fs.subject_id = c.subject_id AND fs.fs_dir = c.fs_dir""")
def t3(t):
    return S.one_freesurfer(_files(t)).select("subject_id", "fs_dir", "key")


@query("t4_first_t1w", "files", "SELECT subject_id, min(key) AS key FROM files WHERE role = 't1w' GROUP BY subject_id")
def t4(t):
    return S.first_t1w(_files(t))


@query("t5_first_per_pattern", "object_keys", r"""+ m AS (
  SELECT subject_id, key, CASE WHEN regexp_matches(key, '/dwi/.*\.nii\.gz$') THEN 'dwi' WHEN regexp_matches(key, '/dwi/.*\.bvec$') THEN 'bvec'
    WHEN regexp_matches(key, '/dwi/.*\.bval$') THEN 'bval' END AS kind FROM object_keys)
SELECT subject_id, kind, min(key) AS key FROM m WHERE kind IS NOT NULL GROUP BY subject_id, kind""")
def t5(t):
    return MF.first_per_pattern(
        t.object_keys, {"dwi": r"/dwi/.*\.nii\.gz$", "bvec": r"/dwi/.*\.bvec$", "bval": r"/dwi/.*\.bval$"}
    )


@query("u1_site_roster", "roster", f"+ {ROSTER_SQL}\nSELECT site, subject_id FROM both_lists")
def u1(t):
    return R.site_roster(t.roster)


@query("u2_study_roster", "roster", f"+ {ROSTER_SQL}\nSELECT subject_id, site FROM study")
def u2(t):
    return _study(t)


@query("u3_manifest_in_order", "listing_responses", f"""+ {PAGES_SQL},
named AS (
  SELECT bucket, position, unnest(keys) AS key, generate_subscripts(keys, 1) AS place FROM (
    SELECT r.bucket AS bucket, position, regexp_extract_all(xml, '<Key>([^<]*)</Key>', 1) AS keys FROM listing_responses r
    JOIN placed ON placed.bucket = r.bucket AND placed.asked = coalesce(requested, '')) AS k),
firsts AS (SELECT bucket, key, min((position, place)) AS spot FROM named WHERE ends_with(key, '_report.json') GROUP BY bucket, key)
SELECT bucket, key, row_number() OVER (PARTITION BY bucket ORDER BY spot) - 1 AS index FROM firsts""", recursive=True)
def u3_order(t):
    return LS.manifest_in_order(t.listing_responses)


@query("u3_merged_listings", "listing_pages", f"""+ {REPORT_KEYS_SQL}
SELECT bucket, key FROM found UNION SELECT bucket, key FROM found WHERE ends_with(key, '_report.json')""")
def u3(t):
    return MF.merge_listings(_found(t), LS.report_keys(_found(t)))


@query("u4_missing_required", "files", """
SELECT subject_id, replace(key, '.nii.gz', '.json') AS key FROM files WHERE role = 'epi_nii'
EXCEPT SELECT subject_id, key FROM files WHERE role = 'epi_json'""")
def u4(t):
    files = _files(t)
    required = files.filter("role = 'epi_nii'").select("subject_id", F.replace("key", F.lit(".nii.gz"), F.lit(".json")).alias("key"))
    return MF.missing_required(required, files.filter("role = 'epi_json'").select("subject_id", "key"))


@query("w5_manifest_position", "listing_pages", f"""+ {REPORT_KEYS_SQL},
listed AS (SELECT DISTINCT bucket, key FROM found WHERE ends_with(key, '_report.json')),
ranked AS (SELECT bucket, key, row_number() OVER (PARTITION BY bucket ORDER BY key) - 1 AS position FROM listed),
opened AS (SELECT bucket, max(subject_id) || '/out/report/' || max(subject_id) || '_dwi_report.json' AS path FROM listing_pages GROUP BY bucket)
SELECT o.bucket, o.path, r.position FROM opened o JOIN ranked r ON o.bucket = r.bucket AND o.path = r.key""")
def w5(t):
    last = t.listing_pages.groupBy("bucket").agg(F.max("subject_id").alias("s"))
    opened = last.select("bucket", F.concat("s", F.lit("/out/report/"), "s", F.lit("_dwi_report.json")).alias("path"))
    return MF.manifest_position(LS.report_keys(_found(t)), opened)


# ---------------------------------------------------------------- JSON and maps

@query("n1_json_property", "sidecars", """
SELECT key, json_extract_string(body, '$.PhaseEncodingDirection') AS direction FROM sidecars""")
def n1(t):
    return t.sidecars.select("key", D.json_property("body").alias("direction"))


@query("n2_relabelled_roles", "sited", "SELECT subject_id, role, key FROM relabelled")
def n2(t):
    return D.relabel_roles(_files(t), D.determine_directions(t.sidecars))


@query("n2_keys_without_object", "sited", """
SELECT count(*) FILTER (o.key IS NULL) AS n_unknown, count(*) AS n FROM relabelled r LEFT JOIN object_keys o ON r.key = o.key""")
def n2_unknown(t):
    relabelled = D.relabel_roles(_files(t), D.determine_directions(t.sidecars))
    known = t.object_keys.select("key", F.lit(True).alias("there"))
    return relabelled.join(known, "key", "left").agg(F.count_if(F.col("there").isNull()).alias("n_unknown"), F.count(F.lit(1)).alias("n"))


@query("n2_relabelled_by_name", "files", """+ named AS (
  SELECT subject_id, CASE WHEN role <> 'epi_nii' THEN role WHEN contains(key, 'dir-AP') THEN 'epi_ap' WHEN contains(key, 'dir-PA') THEN 'epi_pa' END AS role, key
  FROM files WHERE role <> 'epi_json')
SELECT subject_id, role, key FROM named WHERE role IS NOT NULL""")
def n2_by_name(t):
    return D.relabel_by_name(_files(t))
