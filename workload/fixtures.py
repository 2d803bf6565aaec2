"""Study-shaped tables derived from the given tables, in SQL that both engines run.

Every derivation reads its whole tables: no row is left out to make a check cheap. ``{table}`` is a given table; the
other placeholders are spelled per engine below. A fixture may use the tables of the fixtures it names.
"""

from __future__ import annotations

import math
import re
import uuid

from pyspark.sql import functions as F

from dwitable.operators.indexing import ordered_position
from dwitable.session import materialise, settled

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

SITE = "CASE {0} WHEN 0 THEN 'Site-CBIC' WHEN 1 THEN 'Site-RU' ELSE 'Site-SI' END"

# name -> (needed fixtures, SQL of the common table expressions; the last one has the fixture's name)
FIXTURES: dict[str, tuple[tuple[str, ...], str]] = {}


def fixture(name: str, needs: tuple[str, ...], sql: str) -> None:
    FIXTURES[name] = (needs, sql.strip())


fixture("roster", (), f"""
placed AS (
  SELECT 'sub-P' || lpad(CAST(c_custkey AS STRING), 8, '0') AS participant_id, CAST(c_nationkey % 3 AS INT) AS sx, c_acctbal
  FROM {{customer}}
  UNION ALL
  SELECT 'sub-P' || lpad(CAST(c_custkey AS STRING), 8, '0'), CAST((c_nationkey + 1) % 3 AS INT), c_acctbal
  FROM {{customer}} WHERE c_acctbal > 9000),
roster AS (
  SELECT {SITE.format('sx')} AS site, 'raw' AS rd, participant_id FROM placed
  UNION ALL
  SELECT {SITE.format('sx')}, 'deriv', participant_id FROM placed WHERE c_acctbal > 0)
""")

# One subject per customer. The market segment says how sessions are labelled, balance bands say which files are
# missing, duplicated or named without a direction.
fixture("object_keys", (), f"""
participants AS (
  SELECT 'sub-P' || lpad(CAST(c_custkey AS STRING), 8, '0') AS subject_id, {SITE.format('c_nationkey % 3')} AS site,
         c_acctbal AS bal, c_mktsegment AS seg
  FROM {{customer}}),
sess AS (
  SELECT subject_id, site, bal, seg, {{explode}}(CASE seg WHEN 'AUTOMOBILE' THEN {{array}}(0)
         WHEN 'BUILDING' THEN {{array}}(1, 2) ELSE {{array}}(1) END) AS sidx
  FROM participants),
slots AS (
  SELECT subject_id, site, bal, sidx, CASE sidx WHEN 0 THEN '' WHEN 1 THEN '/ses-01' ELSE '/ses-02' END AS ses,
         {{explode}}({{sequence}}(1, 25)) AS tid
  FROM sess),
tmpl AS (SELECT * FROM (VALUES
  (1,'raw','/dwi/','_acq-64dir_dwi.nii.gz'), (2,'raw','/dwi/','_acq-64dir_dwi.bvec'), (3,'raw','/dwi/','_acq-64dir_dwi.bval'),
  (4,'raw','/dwi/','_acq-64dir_dwi.json'), (5,'raw','/fmap/','_dir-AP_acq-dwi_epi.nii.gz'), (6,'raw','/fmap/','_dir-AP_acq-dwi_epi.json'),
  (7,'raw','/fmap/','_dir-PA_acq-dwi_epi.nii.gz'), (8,'raw','/fmap/','_dir-PA_acq-dwi_epi.json'),
  (9,'raw','/fmap/','_dir-AP_acq-fMRI_epi.nii.gz'), (10,'raw','/dwi/','_acq-64dir_TRACEW.nii.gz'),
  (11,'deriv','/','T1w.nii.gz'), (12,'deriv','/freesurfer/mri/','aparc+aseg.mgz'), (13,'deriv','/freesurfer/mri/','orig.mgz'),
  (14,'deriv','/T1w_VNavNorm/','T1w.nii.gz'), (15,'deriv','/T1w_VNavNorm/freesurfer/mri/','orig.mgz'),
  (16,'raw','/fmap/','_acq-dwi_run-01_epi.nii.gz'), (17,'raw','/fmap/','_acq-dwi_run-01_epi.json'),
  (18,'raw','/dwi/','_acq-64dir_run-02_dwi.nii.gz'), (19,'raw','/dwi/','_acq-64dir_run-02_dwi.bvec'), (20,'raw','/dwi/','_acq-64dir_run-02_dwi.bval'),
  (21,'raw','/fmap/','_dir-AP_acq-dwi_run-02_epi.nii.gz'), (22,'raw','/fmap/','_dir-AP_acq-dwi_run-02_epi.json'),
  (23,'raw','/fmap/','_dir-PA_acq-dwi_run-02_epi.nii.gz'), (24,'raw','/fmap/','_dir-PA_acq-dwi_run-02_epi.json'),
  (25,'deriv','/report/','_dwi_report.json')
  ) AS t(tid, rd, dir, tail)),
object_keys AS (
  SELECT subject_id, site, rd, CAST(slots.tid AS INT) AS tid, bal,
    CASE WHEN rd = 'raw' THEN 'data/Projects/HBN/MRI/' || site || '/' || subject_id || ses || dir || subject_id || tail
         ELSE 'data/Projects/HBN/MRI/' || site || '/derivatives/' || subject_id || dir || tail END AS key
  FROM slots JOIN tmpl ON slots.tid = tmpl.tid
  WHERE NOT (bal >= slots.tid * 350 + sidx * 90 AND bal < slots.tid * 350 + sidx * 90 + 80)
    AND (rd = 'raw' OR sidx <= 1)
    AND (slots.tid NOT IN (14, 15) OR site = 'Site-CBIC')
    AND (slots.tid NOT IN (16, 17) OR bal < -700)
    AND (slots.tid NOT BETWEEN 18 AND 24 OR bal > 9500))
""")

fixture("files", ("object_keys",), """
files AS (
  SELECT * FROM (
    SELECT subject_id, site, rd, tid, bal, key, CASE
      WHEN rd = 'raw' AND contains(key, '/dwi/') AND key LIKE '%.nii.gz' AND NOT contains(key, 'TRACEW') THEN 'dwi'
      WHEN rd = 'raw' AND contains(key, '/dwi/') AND key LIKE '%.bvec' THEN 'bvec'
      WHEN rd = 'raw' AND contains(key, '/dwi/') AND key LIKE '%.bval' THEN 'bval'
      WHEN rd = 'raw' AND contains(key, '/fmap/') AND key LIKE '%epi.nii.gz' AND NOT contains(key, 'fMRI') THEN 'epi_nii'
      WHEN rd = 'raw' AND contains(key, '/fmap/') AND key LIKE '%epi.json' AND NOT contains(key, 'fMRI') THEN 'epi_json'
      WHEN rd = 'deriv' AND key LIKE '%/T1w.nii.gz' THEN 't1w'
      WHEN rd = 'deriv' AND contains(key, '/freesurfer/') THEN 'freesurfer' END AS role
    FROM object_keys) AS c
  WHERE role IS NOT NULL)
""")

fixture("sidecars", ("object_keys",), """
sidecars AS (
  SELECT subject_id, key, CASE
    WHEN (bal BETWEEN 1000 AND 1500) OR bal < -900 THEN '{"EchoTime": 0.1}'
    WHEN bal BETWEEN 2000 AND 2300 THEN '{"PhaseEncodingDirection": "i"}'
    WHEN (bal BETWEEN 3000 AND 3250) AND tid IN (6, 22) THEN '{"PhaseEncodingDirection": "j"}'
    WHEN bal BETWEEN 3000 AND 3250 THEN '{"PhaseEncodingDirection": "j-"}'
    WHEN tid IN (6, 22) THEN '{"PhaseEncodingDirection": "j-"}'
    ELSE '{"PhaseEncodingDirection": "j"}' END AS body
  FROM object_keys WHERE key LIKE '%epi.json')
""")

# Files with field-map images sorted by direction and with their session: the table the session operators read.
fixture("sited", ("files", "sidecars"), """
faced AS (
  SELECT subject_id, key, body, {json_value}(body, '$.PhaseEncodingDirection') AS v,
    CASE WHEN contains(key, 'dir-AP') THEN 'AP' WHEN contains(key, 'dir-PA') THEN 'PA' END AS named
  FROM sidecars),
directed AS (
  SELECT subject_id, key, v, named, CASE v WHEN 'j-' THEN 'AP' WHEN 'j' THEN 'PA' ELSE named END AS direction FROM faced),
fmap_pairs AS (
  SELECT subject_id, replace(replace(key, '.nii.gz', ''), '.json', '') AS stem, count(DISTINCT role) AS n_roles
  FROM files WHERE role IN ('epi_nii', 'epi_json') GROUP BY subject_id, replace(replace(key, '.nii.gz', ''), '.json', '')),
gapped AS (SELECT DISTINCT subject_id FROM fmap_pairs WHERE n_roles = 1),
relabelled AS (
  SELECT f.subject_id, f.role, f.key FROM files f LEFT JOIN gapped g ON f.subject_id = g.subject_id
  WHERE f.role NOT IN ('epi_nii', 'epi_json') OR g.subject_id IS NOT NULL
  UNION ALL
  SELECT f.subject_id, 'epi_' || lower(d.direction), f.key
  FROM files f JOIN directed d ON f.subject_id = d.subject_id AND f.key = replace(d.key, '.json', '.nii.gz')
  LEFT JOIN gapped g ON f.subject_id = g.subject_id
  WHERE f.role = 'epi_nii' AND d.direction IS NOT NULL AND g.subject_id IS NULL),
sited AS (
  SELECT subject_id, role, key, CASE WHEN regexp_extract(key, '/(ses-[0-9a-zA-Z]*)/', 1) = '' THEN 'null'
    ELSE regexp_extract(key, '/(ses-[0-9a-zA-Z]*)/', 1) END AS session
  FROM relabelled)
""")

fixture("listing_pages", ("object_keys",), """
listing_pages AS (
  SELECT subject_id, site AS bucket, tid AS page_no,
    '<ListBucketResult><IsTruncated>' || CASE WHEN tid = 25 THEN 'false' ELSE 'true' END || '</IsTruncated><NextContinuationToken>t' ||
    CAST(tid AS STRING) || '+/=</NextContinuationToken><Contents><Key>' || key || '</Key></Contents><Contents><Key>' ||
    subject_id || '/out/report/' || subject_id || '_dwi_report.json</Key></Contents></ListBucketResult>' AS xml
  FROM object_keys)
""")

# Listings of 25 buckets as stored responses, each with the token it was asked for. Of five buckets one has all its pages, one
# has lost a page, one leads back to its middle, one was stopped before its end, and one has pages twice; one lacks its first page.
fixture("listing_responses", ("object_keys",), """
{listed},
linked AS (
  SELECT *, CASE WHEN seq = n - 1 AND b % 5 = 2 THEN CAST(floor(n / CAST(2 AS DOUBLE)) AS BIGINT) ELSE seq + 1 END AS onto,
    seq = n - 1 AND b % 5 NOT IN (2, 3) AS final FROM listed),
responded AS (
  SELECT b, seq, 'bucket-' || CAST(b AS STRING) AS bucket, CASE WHEN seq > 0 THEN 'q' || CAST(seq * 7919 + b AS STRING) || '%2B%2F%3D' END AS requested,
    '<ListBucketResult><IsTruncated>' || CASE WHEN final THEN 'false</IsTruncated>' ELSE 'true</IsTruncated><NextContinuationToken>q' ||
      CAST(onto * 7919 + b AS STRING) || '+/=</NextContinuationToken>' END || '<Contents><Key>' || key || '</Key></Contents><Contents><Key>' ||
      subject_id || '/out/report/' || subject_id || '_dwi_report.json</Key></Contents></ListBucketResult>' AS xml
  FROM linked WHERE NOT (b % 5 = 1 AND seq = 40) AND NOT (b = 23 AND seq = 0)),
listing_responses AS (
  SELECT bucket, requested, xml FROM responded UNION ALL SELECT bucket, requested, xml FROM responded WHERE b % 5 = 4 AND seq % 3 = 0)
""")

# What a person asks for: subjects' folders, folders of one kind in them, whole sites, and some that do not exist.
fixture("wanted_prefixes", ("roster",), """
wanted_prefixes AS (
  SELECT DISTINCT prefix FROM (
    SELECT 'data/Projects/HBN/MRI/' || site || '/' || participant_id || '/' AS prefix FROM roster WHERE rd = 'raw'
    UNION ALL SELECT 'data/Projects/HBN/MRI/' || site || '/' || participant_id || '/ses-01/fm' FROM roster WHERE rd = 'raw'
    UNION ALL SELECT 'data/Projects/HBN/MRI/' || site || '/' || participant_id || '/dwi/' FROM roster WHERE rd = 'deriv'
    UNION ALL SELECT 'data/Projects/HBN/MRI/Site-RU/' FROM roster) AS p)
""")

# One outlier sentence per line item: the supplier is the subject, the part number gives the scan.
fixture("outlier_lines", (), """
outlier_lines AS (
  SELECT l_suppkey AS subject, 'Slice ' || CAST(l_linenumber AS STRING) || ' in scan ' || CAST(l_partkey % 400 AS STRING) ||
    ' is an outlier with mean -' || CAST(CAST(l_quantity AS INT) AS STRING) || '.' || lpad(CAST(l_partkey % 1000 AS STRING), 3, '0') ||
    ' standard deviations off, and mean squared ' || CAST(CAST(l_quantity AS INT) % 7 AS STRING) || '.5 standard deviations off.' AS line
  FROM {lineitem})
""")

fixture("outliers", ("outlier_lines",), r"""
outliers AS (
  SELECT subject, CAST(regexp_extract(line, '^Slice (\d+) in scan', 1) AS INT) AS slice,
    CAST(regexp_extract(line, 'in scan (\d+) is', 1) AS INT) AS scan,
    CAST(regexp_extract(line, 'mean (-?\d+\.\d+) standard', 1) AS DOUBLE) AS mean_sd,
    CAST(regexp_extract(line, 'squared (-?\d+\.\d+) standard', 1) AS DOUBLE) AS mean_sq_sd
  FROM outlier_lines)
""")

fixture("vecs", (), """
rawvec AS (
  SELECT vec_id, label, CAST({e1} AS DOUBLE) AS x, CAST({e2} AS DOUBLE) AS y,
         CASE WHEN label % 2 = 0 THEN abs(CAST({e3} AS DOUBLE)) ELSE CAST({e3} AS DOUBLE) END AS z,
         abs(CAST({e4} AS DOUBLE)) AS m1, abs(CAST({e5} AS DOUBLE)) AS m2 FROM {embeddings}),
vecs AS (
  SELECT vec_id, label, x / sqrt(x*x + y*y + z*z) AS x, y / sqrt(x*x + y*y + z*z) AS y, z / sqrt(x*x + y*y + z*z) AS z, m1, m2 FROM rawvec)
""")

# Fifty vectors make the gradient table of one scan, so the number of scans grows with the vectors.
fixture("volumes", ("vecs",), """
numbered AS (SELECT CAST(floor(vec_id / CAST(50 AS DOUBLE)) AS BIGINT) AS subject, vec_id % 50 AS vol, x, y, z, m1, m2 FROM vecs),
volumes AS (
  SELECT subject, vol, CASE WHEN vol % 10 = 0 THEN 0 WHEN vol % 2 = 0 THEN 1000 ELSE 2000 END AS bval,
         CASE WHEN vol % 10 = 0 THEN CAST(0 AS DOUBLE) ELSE x END AS gx, CASE WHEN vol % 10 = 0 THEN CAST(0 AS DOUBLE) ELSE y END AS gy,
         CASE WHEN vol % 10 = 0 THEN CAST(0 AS DOUBLE) ELSE z END AS gz, m1 AS rms_abs, m2 AS rms_rel,
         CASE WHEN (vol * 7 + subject) % 11 = 0 THEN 1 ELSE 0 END AS dropped FROM numbered)
""")

# The gradient table of every supplier: the scans its line items name; the directions of the vectors go round over all of
# them, so that every vector is used as soon as there are enough scans.
fixture("scan_volumes", ("vecs",), """
taken AS (SELECT DISTINCT l_suppkey AS subject, l_partkey % 400 AS vol FROM {lineitem}),
ring AS (SELECT count(*) AS n FROM vecs),
scan_volumes AS (
  SELECT subject, vol, CASE WHEN vol % 10 = 0 THEN 0 WHEN vol % 2 = 0 THEN 1000 ELSE 2000 END AS bval,
         x AS gx, y AS gy, z AS gz
  FROM taken CROSS JOIN ring JOIN vecs ON vec_id = (subject * 397 + vol) % n)
""")

fixture("affines", ("volumes",), """
affines AS (
  SELECT DISTINCT subject, 1 + subject * CAST(0.01 AS DOUBLE) AS a00, CAST(0.1 AS DOUBLE) AS a01, CAST(0.0 AS DOUBLE) AS a02, CAST(5.0 AS DOUBLE) AS a03, CAST(-0.1 AS DOUBLE) AS a10, CAST(1.0 AS DOUBLE) AS a11, CAST(0.02 AS DOUBLE) * subject AS a12, CAST(-3.0 AS DOUBLE) AS a13,
         CAST(0.0 AS DOUBLE) AS a20, CAST(-0.02 AS DOUBLE) * subject AS a21, CAST(0.9 AS DOUBLE) AS a22, CAST(2.0 AS DOUBLE) AS a23, CAST(0.0 AS DOUBLE) AS a30, CAST(0.0 AS DOUBLE) AS a31, CAST(0.0 AS DOUBLE) AS a32, CAST(1.0 AS DOUBLE) AS a33 FROM volumes)
""")

fixture("motion_mats", ("vecs",), """
ang AS (
  SELECT CAST(floor(vec_id / CAST(50 AS DOUBLE)) AS BIGINT) AS subject, vec_id % 50 AS vol,
         x AS rx, CASE WHEN vec_id % 50 = 0 THEN pi() / 2 ELSE y END AS ry, m1 AS rz, x * 2 AS tx, y * 2 AS ty, z * 2 AS tz FROM vecs),
motion_mats AS (
  SELECT subject, vol, rx, ry, rz, tx AS a03, ty AS a13, tz AS a23,
    cos(ry)*cos(rz) AS a00, cos(ry)*sin(rz) AS a01, sin(ry) AS a02,
    -sin(rx)*sin(ry)*cos(rz)-cos(rx)*sin(rz) AS a10, -sin(rx)*sin(ry)*sin(rz)+cos(rx)*cos(rz) AS a11, sin(rx)*cos(ry) AS a12,
    -cos(rx)*sin(ry)*cos(rz)+sin(rx)*sin(rz) AS a20, -cos(rx)*sin(ry)*sin(rz)-sin(rx)*cos(rz) AS a21, cos(rx)*cos(ry) AS a22 FROM ang)
""")

# Four suppliers share an image, so the number of images grows with the suppliers.
fixture("voxels4d", (), """
voxels4d AS (
  SELECT CAST(floor(l_suppkey / CAST(4 AS DOUBLE)) AS BIGINT) AS subject, CAST(l_quantity AS INT) % 5 AS t,
         CAST(l_partkey % 12 AS INT) AS i, CAST(l_orderkey % 10 AS INT) AS j, l_linenumber - 1 AS k, max(l_extendedprice) AS value
  FROM {lineitem} GROUP BY 1, 2, 3, 4, 5)
""")

fixture("seg", ("voxels4d",), """
seg AS (SELECT DISTINCT subject, i, j, k, (i * j + k * 7 + subject) % 5 AS label FROM voxels4d)
""")

fixture("dims", ("voxels4d",), """
dims AS (SELECT subject, CAST(max(i) + 1 AS INT) AS ni, CAST(max(j) + 1 AS INT) AS nj, CAST(max(k) + 1 AS INT) AS nk,
                CAST(max(t) + 1 AS INT) AS nt FROM voxels4d GROUP BY subject)
""")

# Axis-aligned affines of several kinds, one per image.
fixture("image_affines", ("dims",), """
image_affines AS (
  SELECT subject, CASE WHEN subject % 3 = 1 THEN 0 ELSE (CASE WHEN subject % 2 = 0 THEN -2 ELSE 2 END) * CAST(1 AS DOUBLE) END AS a00,
    CASE WHEN subject % 3 = 1 THEN 2 ELSE 0 END * CAST(1 AS DOUBLE) AS a01, CAST(0 AS DOUBLE) AS a02, CAST(-10 AS DOUBLE) AS a03,
    CASE WHEN subject % 3 = 1 THEN -2 ELSE 0 END * CAST(1 AS DOUBLE) AS a10,
    CASE WHEN subject % 3 = 1 THEN 0 ELSE 2 END * CAST(1 AS DOUBLE) AS a11, CAST(0 AS DOUBLE) AS a12, CAST(4 AS DOUBLE) AS a13,
    CAST(0 AS DOUBLE) AS a20, CAST(0 AS DOUBLE) AS a21, CAST(3 AS DOUBLE) AS a22, CAST(1 AS DOUBLE) AS a23,
    CAST(0 AS DOUBLE) AS a30, CAST(0 AS DOUBLE) AS a31, CAST(0 AS DOUBLE) AS a32, CAST(1 AS DOUBLE) AS a33 FROM dims)
""")

# An affine of any shape for each vector, shears and reflections among them.
fixture("sheared_affines", ("vecs",), """
sheared_affines AS (
  SELECT vec_id AS subject, 2 * x AS a00, y + m1 AS a01, 3 * z - m2 AS a02, m1 AS a10, 2 * z AS a11, x - y AS a12,
         m2 - x AS a20, x + z AS a21, 2 * y AS a22 FROM vecs)
""")

fixture("cmap", (), """
cmap AS (SELECT p_partkey AS idx, CAST((p_partkey * 7) % 256 AS INT) AS r, CAST((p_partkey * 5) % 256 AS INT) AS g,
                CAST((p_partkey * 3) % 256 AS INT) AS b FROM {part})
""")

fixture("colours", ("voxels4d",), """
colours AS (
  SELECT subject, t, i, j, k, CAST(floor(value) AS BIGINT) % 256 AS r, (CAST(floor(value) AS BIGINT) * 3 + i) % 256 AS g,
         (CAST(floor(value) AS BIGINT) * 5 + j) % 256 AS b FROM voxels4d)
""")

# Noise-free signals of known tensors: each line item says that a voxel was measured in a volume. All scans of the vectors are
# subjects, and with more of them a voxel spans more orders, so that its number of measurements stays the same.
fixture("dti_signal", ("volumes",), """
scans AS (SELECT CAST(count(DISTINCT subject) AS BIGINT) AS n FROM volumes),
measured AS (
  SELECT DISTINCT l_suppkey % n AS subject, CAST(floor(l_orderkey / (CAST(15 AS DOUBLE) * n)) AS BIGINT) AS voxel, l_partkey % 50 AS vol
  FROM {lineitem} CROSS JOIN scans),
truth AS (
  SELECT subject, voxel, vol, CAST(0.0010 AS DOUBLE) + (voxel % 20) * CAST(0.00002 AS DOUBLE) AS dxx, CAST(0.0006 AS DOUBLE) AS dyy,
         CAST(0.0003 AS DOUBLE) + (voxel % 7) * CAST(0.00001 AS DOUBLE) AS dzz, CAST(0.0001 AS DOUBLE) AS dxy,
         CAST(0.00002 AS DOUBLE) * (voxel % 3) AS dxz, CAST(-0.00005 AS DOUBLE) AS dyz FROM measured),
dti_signal AS (
  SELECT truth.subject AS subject, voxel, truth.vol AS vol, dxx, dyy, dzz, dxy, dxz, dyz,
    CAST(1000.0 AS DOUBLE) * exp(-bval * (gx*gx*dxx + gy*gy*dyy + gz*gz*dzz + 2*gx*gy*dxy + 2*gx*gz*dxz + 2*gy*gz*dyz)) AS signal
  FROM truth JOIN volumes ON truth.subject = volumes.subject AND truth.vol = volumes.vol)
""")

# The mean is taken over whole hundredths, so that both engines get the same double.
fixture("qc", (), """
qc AS (
  SELECT CASE CAST(user_id % 3 AS INT) WHEN 0 THEN 'bucket-a' WHEN 1 THEN 'bucket-b' ELSE 'bucket-c' END AS bucket, user_id AS subject,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (100 * count(*)) AS qc_mot_abs, min(value) AS qc_mot_rel
  FROM {events} GROUP BY user_id)
""")

fixture("report_json", ("qc",), """
report_json AS (
  SELECT bucket, subject, CASE WHEN subject % 10 = 0 THEN '{"outlier_volumes":[1,2],"b0":{"num_slices":9}}'
    ELSE '{"outlier_volumes":[' || CAST(subject % 5 AS STRING) || '],"b0":{"num_slices":' || CAST(subject % 20 + 1 AS STRING) || '},"eddy_params":[[1,2],[' ||
      CAST(subject % 7 AS STRING) || ',4]],"eddy_quad":{"qc_mot_abs":' || CAST(CAST(round(qc_mot_abs * 1000) AS BIGINT) AS STRING) ||
      ',"qc_mot_rel":' || CAST(CAST(round(qc_mot_rel * 1000) AS BIGINT) AS STRING) || '}}' END AS body FROM qc)
""")

# JSON of different makes in one table: sidecars, reports, and notes by hand, some of which are of other types or no JSON.
fixture("mixed_bodies", ("sidecars", "report_json"), """
mixed_bodies AS (
  SELECT 'sidecar' AS make, key AS name, body FROM sidecars
  UNION ALL SELECT 'report', bucket || '/' || CAST(subject AS STRING), body FROM report_json
  UNION ALL SELECT 'note', 'n' || CAST(c_custkey AS STRING), CASE c_custkey % 7 WHEN 0 THEN '{"EchoTime": ' WHEN 1 THEN '{"EchoTime": "0.08"}'
    WHEN 2 THEN '{"EchoTime": 3, "Tags": ["a", "b"], "a/b": 1}' WHEN 3 THEN '{"EchoTime": null, "PhaseEncodingDirection": true}' WHEN 4 THEN '[1, 2]'
    WHEN 5 THEN CAST(NULL AS STRING) ELSE '{"Nested": {"EchoTime": ' || CAST(c_custkey % 1000 AS STRING) || '.25}, "PhaseEncodingDirection": 2}' END FROM {customer})
""")

# One text file per subject: whitespace numbers, some of them bad.
fixture("text_rows", ("volumes",), """
text_rows AS (
  SELECT subject, vol, CAST(CAST(round(gx * 1000) AS INT) AS STRING) || '  ' || CASE WHEN vol % 17 = 3 THEN 'n/a' ELSE CAST(CAST(round(gy * 1000) AS INT) AS STRING) END
    || ' ' || CAST(CAST(round(gz * 1000) AS INT) AS STRING) AS line FROM volumes)
""")

# The numbered keys of each bucket. A window sorts a bucket in one task, and counts rows with 32 bits in Spark, which are too few for the
# tokens of long listings; ``_listed`` makes the same rows there.
LISTED = """listed AS (
  SELECT CAST(right(subject_id, 8) AS INT) % 25 AS b, subject_id, key,
    row_number() OVER (PARTITION BY CAST(right(subject_id, 8) AS INT) % 25 ORDER BY key) - 1 AS seq,
    count(*) OVER (PARTITION BY CAST(right(subject_id, 8) AS INT) % 25) AS n
  FROM object_keys)"""

SPARK = {
    "explode": "explode", "array": "array", "sequence": "sequence", "json_value": "get_json_object",
    **{f"e{n}": f"embedding[{n - 1}]" for n in range(1, 6)},
}
DUCKDB = {
    "explode": "unnest", "array": "list_value", "sequence": "generate_series", "json_value": "json_extract_string", "listed": LISTED,
    **{f"e{n}": f"embedding[{n}]" for n in range(1, 6)},
    **{t: t for t in TABLES},
}


def _order(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for n in names:
        _order(FIXTURES[n][0], seen)
        if n not in seen:
            seen.append(n)
    return seen


def _spell(sql: str, words: dict[str, str]) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: words.get(m.group(1), m.group(0)), sql)


def prologue(*names: str) -> str:
    """The WITH clause of some fixtures for the check engine, to be followed by further tables or a SELECT."""
    return "WITH " + ",\n".join(_spell(FIXTURES[n][1], DUCKDB) for n in _order(names, []))


#: Customers that one task makes into object keys; each has up to fifty.
SPREAD_ROWS = 10_000


def _given(spark, path: str, spread: bool) -> str:
    """A given table in Spark's SQL; with ``spread`` its rows are dealt out, as many to a task whatever the files are like."""
    parts = math.ceil(spark.read.parquet(path).count() / SPREAD_ROWS) if spread else 1
    return f"(SELECT /*+ REPARTITION({parts}) */ * FROM parquet.`{path}`)" if parts > 1 else f"parquet.`{path}`"


def _listed(spark, keys: str) -> str:
    """``LISTED`` for buckets of any size: keys are numbered by ranges."""
    bucket = F.expr("CAST(right(subject_id, 8) AS INT) % 25").alias("b")
    keys = spark.sql(f"WITH {keys} SELECT * FROM object_keys").select(bucket, "subject_id", "key")
    sizes = settled(keys.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "sizes").alias("_s")
    placed = ordered_position(keys, ["b"], "key", "seq").alias("_k")
    sized = placed.join(sizes, F.col("_k.b").eqNullSafe(F.col("_s.b"))).select("_k.*", "_s.n")
    view = f"listed_{uuid.uuid4().hex}"
    materialise(sized, "listed").createOrReplaceTempView(view)
    return f"listed AS (SELECT * FROM {view})"


def _keys(spark, sf_dir: str) -> str:
    """The object keys, written once: a query that looks at a key many times would else put it together anew each time."""
    view = f"object_keys_{uuid.uuid4().hex}"
    materialise(_load(spark, sf_dir, "object_keys"), "object_keys").createOrReplaceTempView(view)
    return f"object_keys AS (SELECT * FROM {view})"


def load(spark, sf_dir: str, name: str):
    """A fixture as a Spark DataFrame over the tables of a directory."""
    if name == "wanted_prefixes":  # each of its parts would put the roster together anew
        view = f"roster_{uuid.uuid4().hex}"
        materialise(_load(spark, sf_dir, "roster"), "roster").createOrReplaceTempView(view)
        return _load(spark, sf_dir, name, {"roster": f"roster AS (SELECT * FROM {view})"})
    if "object_keys" not in _order((name,), []):
        return _load(spark, sf_dir, name)
    return _load(spark, sf_dir, name, {"object_keys": _keys(spark, sf_dir)})


def _load(spark, sf_dir: str, name: str, made: dict[str, str] | None = None):
    """The same; ``made`` are fixtures that lie ready, by the SQL that reads them."""
    made = made or {}
    texts = [made.get(n) or FIXTURES[n][1].replace("\\", "\\\\") for n in _order((name,), [])]
    words = dict(SPARK)
    for t in TABLES:
        if any(f"{{{t}}}" in x for x in texts):
            words[t] = _given(spark, f"{sf_dir}/{t}.parquet", t == "customer")
    if any("{listed}" in x for x in texts):
        words["listed"] = _listed(spark, made["object_keys"])
    parts = ",\n".join(_spell(x, words) for x in texts)
    return spark.sql(f"WITH {parts}\nSELECT * FROM {name}")
