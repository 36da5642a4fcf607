"""Identifiers, URLs and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The placeholder for a missing label, and the catalogue's web addresses.
PLACEHOLDER_LABEL = "Not On Label"
RELEASE_URL = "https://www.discogs.com/release/"
DEFAULT_STORE = ".bandcamp.com"


def clean_id(value: Column) -> Column:
    """An id as a long; empty, zero and non-numeric ids are null."""
    number = value.try_cast("bigint")
    return F.when(number != 0, number)


def clean_label_name(name: Column) -> Column:
    """A label name; empty names and the placeholder are null."""
    return F.when((name != "") & (name != PLACEHOLDER_LABEL), name)


def url_kind(url: Column) -> Column:
    """"release" or "artist", by the first that the URL names with a number; else null."""
    return F.when(url.rlike(r"/release/\d+"), "release").when(url.rlike(r"/artist/\d+"), "artist")


def url_id(url: Column) -> Column:
    """The number after /release/, else the one after /artist/, else null."""
    release = F.regexp_extract(url, r"/release/(\d+)", 1)
    artist = F.regexp_extract(url, r"/artist/(\d+)", 1)
    return F.when(release != "", release).when(artist != "", artist).try_cast("bigint")


def release_web_url(release_id: Column) -> Column:
    return F.concat(F.lit(RELEASE_URL), release_id.cast("string"))


def url_host(url: Column) -> Column:
    """The part between // and the next slash."""
    return F.regexp_extract(url, r"//([^/]*)", 1)


def path_stub(path: Column) -> Column:
    """label/release: the two folders that hold the file at ``path``."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, -3, 2), "/"))


def path_part(path: Column, position: int) -> Column:
    """A component of the path, counted from 1, or from the end when negative; null if absent."""
    return F.try_element_at(F.split(path, "/"), F.lit(position))


def store_url(label: Column, release: Column, release_url: Column, label_domain: Column) -> Column:
    """The page of a release: its own recorded URL, else one made of the label's domain."""
    domain = F.coalesce(label_domain, F.concat(label, F.lit(DEFAULT_STORE)))
    return F.coalesce(release_url, F.concat(F.lit("https://"), domain, F.lit("/album/"), release))
