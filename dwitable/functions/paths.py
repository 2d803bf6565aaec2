"""Path and key functions."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

from dwitable.functions.columns import ColumnLike, before, col, last_segment

# File formats and names the rest of the imaging tool chain expects.
IMAGE_SUFFIX = ".nii.gz"
SESSION_PATTERN = "/(ses-[0-9a-zA-Z]*)/"
STEM_PATTERN = r"^((?:.*/)?\.*[^./]*)"
EXTENSION_PATTERN = r"(\.[^.]*)"
NAME_PATTERN = r"^(.*/)?(\.*[^/]*?)(\.nii\.gz|\.tar\.gz|\.niml\.dset|\.[^./]*)?$"
FREESURFER_DIR = "freesurfer"
APARC_ASEG = "mri/aparc+aseg.mgz"
ORIG = "mri/orig.mgz"
DEFAULT_ENDPOINT = "https://s3-us-west-2.amazonaws.com"


def split_extensions(path: ColumnLike) -> Column:
    """``a/b.nii.gz`` -> ``[a/b, .nii, .gz]``; only dots of the last segment count."""
    p = col(path)
    stem = F.regexp_extract(p, STEM_PATTERN, 1)
    rest = F.substr(p, F.length(stem) + 1)
    return F.concat(F.array(stem), F.regexp_extract_all(rest, F.lit(EXTENSION_PATTERN), F.lit(1)))


def cumulative_paths(parts: ColumnLike, add_ext: str = "") -> Column:
    """``[a, .b, .c]`` -> ``[a, a.b, a.b.c]``, each followed by ``add_ext``."""
    ext = add_ext if not add_ext or add_ext.startswith(".") else f".{add_ext}"

    def names(p: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(p)),
            lambda n: F.concat(F.array_join(F.slice(p, F.lit(1), n), ""), F.lit(ext)),
        )

    # ``parts`` is bound to a variable: named inside the inner function, it would be computed again for every element
    return F.element_at(F.transform(F.array(col(parts)), names), 1)


def target_path(key: ColumnLike, site: ColumnLike, directory: str, include_site: bool = False) -> Column:
    """Local path of an object: directory, the site if asked for, and what follows the site in the key."""
    key, site = col(key), col(site)
    tail = F.call_function("substring_index", key, F.concat(F.lit("/"), site, F.lit("/")), F.lit(-1))
    head = [F.lit(posixpath.normpath(directory))] + ([site] if include_site else [])
    return F.concat_ws("/", *head, tail)


def session_id(path: ColumnLike, fallback: str = "null") -> Column:
    """The first ``ses-<label>`` directory of a path, or ``fallback`` where there is none."""
    found = F.regexp_extract(col(path), SESSION_PATTERN, 1)
    return F.when(found == "", F.lit(fallback)).otherwise(found)


def relabel_session(session: ColumnLike, assign_empty: bool = True, fallback: str = "null") -> Column:
    """The output label of a session: files without one get ``ses-01`` or NULL."""
    s = col(session)
    return F.when(s == fallback, F.lit("ses-01") if assign_empty else F.lit(None).cast("string")).otherwise(s)


def image_basename(path: ColumnLike) -> Column:
    """File name without directory and image suffix."""
    return before(last_segment(path), IMAGE_SUFFIX)


def subject_token(path: ColumnLike) -> Column:
    """The subject id in a file name; NULL where the name does not start with ``sub-``."""
    token = before(image_basename(path), "_")
    return F.when(token.startswith("sub-"), token)


def eddy_base(path: ColumnLike) -> Column:
    """Base name of a corrected image: cut at the image suffix, then at ``_fix``."""
    return before(before(path, IMAGE_SUFFIX), "_fix")


def qc_dir(path: ColumnLike) -> Column:
    """Quality-control directory of a corrected image."""
    return F.concat(before(path, IMAGE_SUFFIX), F.lit(".qc"))


def with_suffix(path: ColumnLike, suffix: str, new_dir: str | None = None, use_ext: bool = True) -> Column:
    """Insert a suffix before the extension, or replace the extension with ``use_ext=False``."""
    p = col(path)
    head = F.lit(new_dir.rstrip("/") + "/") if new_dir is not None else F.regexp_extract(p, NAME_PATTERN, 1)
    tail = F.regexp_extract(p, NAME_PATTERN, 3) if use_ext else F.lit("")
    return F.concat(head, F.regexp_extract(p, NAME_PATTERN, 2), F.lit(suffix), tail)


def derivatives_dir(bids_dir: ColumnLike, subject: ColumnLike) -> Column:
    """The derivatives directory of one subject."""
    return F.concat_ws("/", col(bids_dir), F.lit("derivatives"), col(subject))


def aparc_aseg(subjects_dir: ColumnLike, sub: str = FREESURFER_DIR) -> Column:
    """Path of the segmentation volume."""
    return F.concat_ws("/", col(subjects_dir), F.lit(sub), F.lit(APARC_ASEG))


def orig(subjects_dir: ColumnLike, sub: str = FREESURFER_DIR) -> Column:
    """Path of the anatomical volume."""
    return F.concat_ws("/", col(subjects_dir), F.lit(sub), F.lit(ORIG))


def drop_level(path: ColumnLike, site: ColumnLike, at_site: str, level: str) -> Column:
    """Remove one directory level from the paths of one site."""
    p = col(path)
    return F.when(col(site) == at_site, F.replace(p, F.lit(f"{level}/"), F.lit(""))).otherwise(p)


def report_subject(key: ColumnLike) -> Column:
    """Subject label of a report key: its first segment."""
    return before(key, "/")


def report_url(bucket: ColumnLike, key: ColumnLike, endpoint: str = DEFAULT_ENDPOINT) -> Column:
    """Address of a report."""
    return F.concat_ws("/", F.lit(endpoint), col(bucket), col(key))


def report_key(url: ColumnLike, bucket: ColumnLike, endpoint: str = DEFAULT_ENDPOINT) -> Column:
    """The key inside a report address; NULL where the address is not of this bucket."""
    prefix = F.concat(F.lit(f"{endpoint}/"), col(bucket), F.lit("/"))
    return F.when(F.startswith(col(url), prefix), F.substr(col(url), F.length(prefix) + 1))


def encode_component(text: ColumnLike) -> Column:
    """Percent-encoding of one query component, leaving ``! ' ( ) ~`` bare as browsers do."""
    out = F.replace(F.url_encode(col(text)), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def upload_key(path: ColumnLike, output_dir: str) -> Column:
    """Object key of an output file: its path relative to the output directory."""
    return F.replace(col(path), F.lit(output_dir.rstrip("/") + "/"), F.lit(""))


def bids_entities(path: ColumnLike) -> dict[str, Column]:
    """The naming entities of a file as columns."""
    p = col(path)
    name = last_segment(p)

    def entity(pattern: str, source: Column) -> Column:
        return F.nullif(F.regexp_extract(source, pattern, 1), F.lit(""))

    return {
        "subject": entity(r"(?:^|/)sub-([^/_]+)", p),
        "session": entity(r"(?:^|/)ses-([^/_]+)", p),
        "datatype": entity(r"(?:^|/)(anat|dwi|fmap|func)/[^/]*$", p),
        "suffix": entity(r"_([^_.]+)\.[^/]*$", name),
        "direction": entity(r"(?:^|_)dir-([^_.]+)", name),
        "extension": entity(r"^[^.]*(\..*)$", name),
    }
