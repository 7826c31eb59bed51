"""Document ids, file paths and media types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Content types that may be registered, by file extension.
CONTENT_TYPES = {
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "webp": "image/webp",
    "mp4": "video/mp4",
    "mov": "video/quicktime",
    "webm": "video/webm",
    "mp3": "audio/mpeg",
    "wav": "audio/wav",
    "ogg": "audio/ogg",
    "m4a": "audio/m4a",
}

# Content types accepted for links in uploaded tables, by file extension.
LINK_TYPES = {
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "svg": "image/svg+xml",
    "webp": "image/webp",
    "tiff": "image/tiff",
    "mp4": "video/mp4",
    "webm": "video/webm",
    "ogg": "video/ogg",
    "mp3": "audio/mpeg",
    "aac": "audio/aac",
    "wav": "audio/wav",
    "flac": "audio/flac",
}


def doc_hash(identifiers: Sequence[str]) -> Column:
    """Document id from the identifier values that are present."""
    if not identifiers:
        raise ValueError("an id can only be made from identifier fields")
    present = F.struct(*[F.col(name) for name in sorted(identifiers)])
    return F.sha2(F.to_json(present, {"ignoreNullFields": "true"}), 224)


def path_folder(filepath: Column) -> Column:
    return F.regexp_extract(filepath, r"(?s)^(.*)/[^/]*$", 1)


def path_file(filepath: Column) -> Column:
    return F.substring_index(filepath, "/", -1)


def path_extension(filepath: Column) -> Column:
    """Lower-case extension of the file, empty if it has none."""
    return F.lower(F.regexp_extract(path_file(filepath), r"(?s)\.([^.]*)$", 1))


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)


def mime_from_extension(extension: Column) -> Column:
    """Content type, null for an unknown extension."""
    return _lookup(CONTENT_TYPES, extension)


def link_type(extension: Column) -> Column:
    return _lookup(LINK_TYPES, extension)
