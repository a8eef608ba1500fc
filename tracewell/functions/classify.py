"""Kinds of resources and links, labels and text measures as built-in expressions (inventory rows F8-F17, F22-F27, F29-F33)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kind of each file extension.
EXTENSIONS = {
    "image": "avif bmp gif ico jpeg jpg png svg tif tiff webp",
    "document": "csv doc docx odf odp ods odt pdf ppt pptx rtf txt xls xlsx",
    "stylesheet": "css",
    "script": "cjs js mjs",
    "font": "eot otf ttf woff woff2",
    "video": "avi m4v mkv mov mp4 webm",
    "audio": "aac flac m4a mp3 oga ogg wav",
    "archive": "7z apk bz2 gz jar rar tar tgz zip",
    "feed": "atom rss",
    "manifest": "webmanifest",
    "structured_data": "json jsonld xml",
    "html_page": "htm html xhtml",
}
#: The narrower list that inventory queries use, by the end of the path.
PATH_EXTENSIONS = {
    "image": "avif gif ico jpeg jpg png svg webp",
    "document": "csv doc docx ods odt pdf ppt pptx rtf txt xls xlsx",
    "stylesheet": "css",
    "script": "cjs js mjs",
    "font": "eot otf ttf woff woff2",
    "video": "avi mkv mov mp4 webm",
    "audio": "flac m4a mp3 ogg wav",
    "archive": "7z gz jar rar tar zip",
    "feed": "atom rss",
    "manifest": "webmanifest",
    "structured_data": "json jsonld xml",
}
#: Kind of each media type, with the rule's name; prefixes end with a slash.
MEDIA = [
    ("html_page", "mime_text_html", "text/html application/xhtml+xml"),
    ("image", "mime_image", "image/"),
    ("document", "mime_pdf", "application/pdf"),
    ("document", "mime_document", "application/msword application/rtf application/vnd.ms-excel application/vnd.ms-powerpoint application/vnd.oasis.opendocument.presentation application/vnd.oasis.opendocument.spreadsheet application/vnd.oasis.opendocument.text application/vnd.openxmlformats-officedocument.presentationml.presentation application/vnd.openxmlformats-officedocument.spreadsheetml.sheet application/vnd.openxmlformats-officedocument.wordprocessingml.document text/plain text/csv"),
    ("stylesheet", "mime_stylesheet", "text/css"),
    ("script", "mime_javascript", "application/ecmascript application/javascript application/x-ecmascript application/x-javascript text/ecmascript text/javascript"),
    ("font", "mime_font", "application/font-sfnt application/font-woff application/vnd.ms-fontobject application/x-font-opentype application/x-font-ttf font/"),
    ("video", "mime_video", "video/"),
    ("audio", "mime_audio", "audio/"),
    ("archive", "mime_archive", "application/gzip application/java-archive application/vnd.android.package-archive application/x-7z-compressed application/x-bzip2 application/x-rar-compressed application/x-tar application/zip"),
    ("feed", "mime_feed", "application/atom+xml application/rss+xml"),
    ("manifest", "mime_manifest", "application/manifest+json application/x-web-app-manifest+json"),
    ("structured_data", "mime_structured_data", "application/json application/ld+json application/xml text/xml"),
]
#: First bytes of files, as hex.
SIGNATURES = [("document", "signature_pdf", "255044462D"), ("image", "signature_image", "89504E470D0A1A0A FFD8FF 474946383761 474946383961"), ("archive", "signature_archive", "504B0304 504B0506 504B0708 1F8B")]


def media_type(content_type: Column) -> Column:
    """The type before parameters, trimmed and in lower case; null if empty."""
    return F.nullif(F.lower(F.trim(F.substring_index(content_type, ";", 1))), F.lit(""))


def extension(path: Column) -> Column:
    """Extension of the last path segment in lower case, at most 32 characters; null if it has none or odd characters."""
    return F.nullif(F.substring(F.regexp_extract(F.lower(path), r"\.([a-z0-9][a-z0-9+_-]*)$", 1), 1, 32), F.lit(""))


def _lookup(value: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for kind, names in table.items():
        out = F.when(value.isin(*names.split()), kind).otherwise(out)
    return out


def extension_kind(ext: Column) -> Column:
    return _lookup(ext, EXTENSIONS)


def path_extension(path: Column) -> Column:
    """The extension of a path if it is on the inventory list."""
    every = "|".join(x for v in PATH_EXTENSIONS.values() for x in v.split())
    return F.nullif(F.regexp_extract(F.lower(path), rf"\.({every})$", 1), F.lit(""))


def path_kind(path: Column) -> Column:
    return _lookup(path_extension(path), PATH_EXTENSIONS)


def _by_media(mime: Column, column: int) -> Column:
    out = F.when(F.endswith(mime, F.lit("+json")), MEDIA[-1][column]).otherwise(F.lit(None).cast("string"))
    for row in reversed(MEDIA):
        names = row[2].split()
        hit = reduce(lambda a, b: a | b, [F.startswith(mime, F.lit(n)) if n.endswith("/") else mime == n for n in names])
        out = F.when(hit, row[column]).otherwise(out)
    return out


def media_kind(mime: Column) -> Column:
    return _by_media(mime, 0)


def disposition_filename(value: Column) -> Column:
    """File name of a Content-Disposition value: the encoded, the quoted or the plain form, without control characters."""
    encoded = F.nullif(F.regexp_extract(value, r"(?i)filename\*\s*=\s*[^']*''([^;]+)", 1), F.lit(""))
    quoted = F.nullif(F.regexp_extract(value, r'(?i)filename\s*=\s*"([^"\r\n]+)"', 1), F.lit(""))
    plain = F.nullif(F.regexp_extract(value, r"(?i)filename\s*=\s*([^;\r\n]+)", 1), F.lit(""))
    raw = F.coalesce(encoded, quoted, plain)
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(raw, r"\+", "%2B")), raw)
    return F.nullif(F.substring(F.trim(F.regexp_replace(decoded, r"[\x00-\x1f\x7f]", "")), 1, 255), F.lit(""))


def _signature(prefix: Column, column: int) -> Column:
    head, out = F.hex(F.substring(prefix, 1, 16)), F.lit(None).cast("string")
    for row in reversed(SIGNATURES):
        out = F.when(reduce(lambda a, b: a | b, [F.startswith(head, F.lit(x)) for x in row[2].split()]), row[column]).otherwise(out)
    out = F.when(head.rlike("^52494646.{8}57454250"), ("image", "signature_image")[column]).otherwise(out)
    return F.when(F.decode(F.substring(prefix, 1, 512), "ISO-8859-1").rlike(r"(?i)^\s*<(?:!doctype html|html|head|body)"), ("html_page", "signature_html")[column]).otherwise(out)


def response_kind(path: Column, content_type: Column, disposition: Column | None = None, prefix: Column | None = None) -> Column:
    """kind and rule of a response: by media type, file name, first bytes, extension; else other or unknown."""
    mime, ext = media_type(content_type), extension(path)
    name = F.lit(None).cast("string") if disposition is None else extension_kind(extension(disposition_filename(disposition)))
    sig = [F.lit(None).cast("string")] * 2 if prefix is None else [_signature(prefix, 0), _signature(prefix, 1)]
    kind = F.coalesce(_by_media(mime, 0), name, sig[0], extension_kind(ext), F.when(mime.isNotNull(), "other").otherwise("unknown"))
    rule = F.coalesce(_by_media(mime, 1), F.when(name.isNotNull(), "content_disposition_filename"), sig[1], F.when(extension_kind(ext).isNotNull(), "extension"), F.lit("fallback_unknown"))
    return F.struct(kind.alias("kind"), rule.alias("rule"))


def reference_kind(ext: Column, tag: Column, attribute: Column, rel: Column, hint: Column) -> Column:
    """kind and rule of a resource that a page refers to, by its element first."""
    tag, attribute, hint = F.lower(tag), F.lower(attribute), F.lower(F.coalesce(hint, F.lit("")))
    rels = F.split(F.lower(F.trim(F.coalesce(rel, F.lit("")))), r"\s+")
    link, by_ext = tag == "link", F.coalesce(extension_kind(ext), F.lit("other"))
    hinted = F.when(hint == "style", "stylesheet").otherwise(hint)
    cases = [
        (tag.isin("img", "picture", "input") | (attribute == "poster"), F.lit("image"), F.lit("element_img")),
        (tag == "script", F.lit("script"), F.lit("element_script")),
        (F.array_contains(rels, "stylesheet"), F.lit("stylesheet"), F.lit("element_stylesheet")),
        (link & F.array_contains(rels, "manifest"), F.lit("manifest"), F.lit("element_manifest")),
        (link & (hint == "font"), F.lit("font"), F.lit("element_font_preload")),
        (link & hint.isin("image", "script", "style", "video", "audio"), hinted, F.concat(F.lit("element_"), hint)),
        (tag.isin("video", "track"), F.lit("video"), F.lit("element_video")),
        (tag == "audio", F.lit("audio"), F.lit("element_audio")),
        (tag == "source", by_ext, F.lit("element_source")),
        (tag.isin("object", "embed"), by_ext, F.lit("element_embed")),
        (link & F.arrays_overlap(rels, F.array(F.lit("icon"), F.lit("apple-touch-icon"), F.lit("mask-icon"))), F.lit("image"), F.lit("element_img")),
        (extension_kind(ext).isNotNull(), extension_kind(ext), F.lit("extension")),
    ]
    out = F.struct(F.lit("unknown").alias("kind"), F.lit("fallback_unknown").alias("rule"))
    for condition, kind, rule in reversed(cases):
        out = F.when(condition, F.struct(kind.alias("kind"), rule.alias("rule"))).otherwise(out)
    return out


def ai_document_kind(relation: Column, filename: Column, mime: Column, head: Column, parent_hint: Column) -> Column:
    """Kind of a document for language-model readers: by relation, well-known name, media type, first line, extension, parent."""
    name = F.lower(filename)
    return F.coalesce(
        F.when(relation.isin("ai_index", "ai_full", "ai_document"), relation),
        F.when(name == "llms.txt", "ai_index").when(name == "llms-full.txt", "ai_full"),
        F.when(media_type(mime).isin("text/markdown", "text/x-markdown"), "markdown").when(media_type(mime) == "text/plain", "text"),
        F.when(head.rlike(r"^\s*#\s+\S"), "markdown"),
        F.when(name.rlike(r"\.(md|markdown|mdx)$"), "markdown").when(name.rlike(r"\.txt$"), "text"),
        parent_hint, F.lit("unknown"),
    )


def normal_text(text: Column) -> Column:
    """Runs of blanks become one space (tabs and newlines stay), at most two newlines in a row, ends trimmed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[^\S\t\r\n]+", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(t, " "))).cast("long")


def category_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def json_hash(columns: dict[str, Column]) -> Column:
    """SHA-256 of a JSON object with sorted keys and no spaces; nulls are written."""
    return F.sha2(F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


#: Request headers that a stored representation may vary on.
VARIANT_HEADERS = ("accept", "accept-encoding", "accept-language", "user-agent")


def reusable(vary: Column, cache_control: Column) -> Column:
    """Whether a response may be used again: not no-store, and varying on known headers only."""
    names = F.transform(F.split(F.lower(F.coalesce(vary, F.lit(""))), ","), lambda x: F.trim(x))
    known = F.forall(names, lambda x: x.isin("", *VARIANT_HEADERS))
    return known & ~F.coalesce(F.lower(cache_control), F.lit("")).contains("no-store")


def variant_fingerprint(headers: Column) -> Column:
    """SHA-256 over the request headers a representation depends on, from a map with lower-case keys."""
    kept = F.map_filter(headers, lambda k, _: k.isin(*VARIANT_HEADERS))
    return F.sha2(F.to_json(F.array_sort(F.map_entries(kept))), 256)
