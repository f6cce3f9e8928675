"""Attachment names, MIME types, size rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import strip

# --- fixed values: attachment tables and limits ------------------------------------------------
MIME_BY_EXTENSION = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "txt": "text/plain",
    "csv": "text/csv",
    "xml": "text/xml",
    "msg": "application/vnd.ms-outlook",
    "eml": "message/rfc822",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "bmp": "image/bmp",
    "tiff": "image/tiff",
    "tif": "image/tiff",
}
OCTET_STREAM = "application/octet-stream"
DOCX = MIME_BY_EXTENSION["docx"]
SUPPORTED_TYPES = [
    "application/pdf", DOCX, "text/plain", "text/csv", "text/xml", "message/rfc822",
    "application/vnd.ms-outlook", "image/jpeg", "image/png", "image/gif", "image/bmp", "image/tiff",
]
ARCHIVE_TYPES = ["application/zip", "application/x-rar-compressed", "application/x-7z-compressed"]
MESSAGE_TYPES = ["message/rfc822", "application/vnd.ms-outlook"]
# Leading bytes in hex -> MIME type.
SIGNATURES = {
    "25504446": "application/pdf",
    "89504E470D0A1A0A": "image/png",
    "FFD8FF": "image/jpeg",
    "474946383761": "image/gif",
    "474946383961": "image/gif",
    "424D": "image/bmp",
    "49492A00": "image/tiff",
    "4D4D002A": "image/tiff",
    "504B0304": "application/zip",
    "526172211A07": "application/x-rar-compressed",
    "377ABCAF271C": "application/x-7z-compressed",
    "D0CF11E0A1B11AE1": "application/vnd.ms-outlook",
}
# Signatures of containers: many formats start with them, so a name that tells the format decides.
CONTAINERS = {"504B0304": ["docx", "xlsx", "pptx", "odt", "ods", "odp", "epub", "jar", "apk"],
              "D0CF11E0A1B11AE1": ["doc", "xls", "ppt", "msi", "vsd"]}
KIND_BY_EXTENSION = {
    "pdf": "PDF", "doc": "DOC", "docx": "DOCX", "xls": "XLS", "xlsx": "XLSX", "ppt": "PPT",
    "pptx": "PPTX", "txt": "TXT", "jpg": "IMG", "jpeg": "IMG", "png": "IMG", "gif": "IMG",
    "zip": "ZIP", "rar": "RAR", "exe": "EXE",
}
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]
MAX_ATTACHMENT_BYTES = 100 * 1024 * 1024
MAX_CONTENT_MB = 50
MAX_NAME_LENGTH = 255
# ----------------------------------------------------------------------------------------------


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def first_name(*names: Column, index: Column) -> Column:
    """First non-empty of the given names, else ``attachment_{index}``."""
    tried = [F.nullif(n, F.lit("")) for n in names]
    return F.coalesce(*tried, F.concat(F.lit("attachment_"), index.cast("string")))


def safe_name(name: Column, fallback: Column) -> Column:
    """File name reduced to ``A-Za-z0-9._-``, without ``.`` or ``_`` at the ends.

    Written without repeating any part, so filters on the result stay small when pushed down.
    """
    candidate = F.regexp_replace(strip(F.coalesce(name, F.lit(""))), "^$", fallback)
    # A blank becomes one underscore each, any other run becomes one.
    ascii_only = F.regexp_replace(F.replace(candidate, F.lit(" "), F.lit("_")), r"[^A-Za-z0-9._-]+", "_")
    inner = F.regexp_replace(ascii_only, r"^[._]+|[._]+$", "")
    return F.substring(F.regexp_replace(inner, "^$", fallback), 1, MAX_NAME_LENGTH)


def name_stem(name: Column) -> Column:
    """Part before the last dot; a leading dot does not count."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def name_suffix(name: Column) -> Column:
    """Last dot and what follows, '' if there is none."""
    return F.regexp_extract(name, r".(\.[^.]+)$", 1)


def extension(name: Column) -> Column:
    lowered = F.lower(F.coalesce(name, F.lit("")))
    return F.when(F.contains(lowered, F.lit(".")), F.substring_index(lowered, ".", -1)).otherwise("")


def mime_from_extension(name: Column) -> Column:
    return _lookup(MIME_BY_EXTENSION, extension(name), OCTET_STREAM)


def mime_from_content(content: Column, name: Column) -> Column:
    """Type by leading bytes if they are known, else by extension.

    A container's signature gives way to an extension of a format that is kept in such containers. ``BM`` alone is no
    bitmap: the header's reserved bytes must be zero.
    """
    head = F.hex(F.substring(content, 1, 16))

    def fits(signature: str) -> Column:
        hit = F.startswith(head, F.lit(signature))
        if signature in CONTAINERS:
            return hit & ~extension(name).isin(CONTAINERS[signature])
        return hit & (F.substring(head, 13, 8) == "00000000") if signature == "424D" else hit

    (first, mime), *others = SIGNATURES.items()
    by_head = reduce(lambda acc, s: acc.when(fits(s[0]), s[1]), others, F.when(fits(first), mime))
    return F.coalesce(by_head, mime_from_extension(name))


def content_category(mime: Column) -> Column:
    return (F.when(F.startswith(mime, F.lit("text/")), "text")
            .when(F.startswith(mime, F.lit("image/")), "image")
            .when(mime.isin("application/pdf", DOCX), "document")
            .when(mime.isin(ARCHIVE_TYPES), "archive")
            .when(mime.isin(MESSAGE_TYPES), "embedded_message")
            .otherwise("binary"))


def is_supported(mime: Column, supported: list[str] | None = None) -> Column:
    return mime.isin(supported or SUPPORTED_TYPES)


def size_rejection(size: Column, actual: Column) -> Column:
    """Why an attachment is not stored; null if it is. ``size`` is text, as stated by the message."""
    stated = size.try_cast("double")
    return (F.when(size.isNotNull() & stated.isNull(), "size is not a number")
            .when(stated > MAX_ATTACHMENT_BYTES, "stated size over limit")
            .when(stated < 0, "negative size")
            .when(actual > MAX_ATTACHMENT_BYTES, "content over limit")
            .when(F.coalesce(actual, F.lit(0)) == 0, "no content"))


def content_limit_error(size: Column, max_mb: int = MAX_CONTENT_MB) -> Column:
    """Error text (a fixed value) for content too large to be read for text; null otherwise."""
    return F.when(size > max_mb * 1024 * 1024, F.concat(
        F.lit("Attachment too large ("), size.cast("string"), F.lit(f" bytes > {max_mb}MB)")))


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8, bad sequences replaced by U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def extraction_method(mime: Column, supported: list[str] | None = None, ocr: bool = True,
                      embedded: bool = True) -> Column:
    """Which reader an attachment is routed to. Only ``direct`` yields text here."""
    category = content_category(mime)
    by_type = (F.when(~is_supported(mime, supported), "fallback")
               .when(category == "text", "direct")
               .when(mime == "application/pdf", "pdf_text_layer")
               .when(mime == DOCX, "docx_native")
               .when((category == "image") & F.lit(ocr), "ocr")
               .when(category == "embedded_message", "msg_eml")
               .otherwise("fallback"))
    # With embedded reading on, message attachments never reach the supported-type test.
    return F.when((category == "embedded_message") & F.lit(embedded), "msg_eml").otherwise(by_type)


def format_size(size: Column) -> Column:
    """``1.5 KB`` and so on; half rounds to even."""
    out = None
    for power, unit in enumerate(SIZE_UNITS):
        scaled = F.bround(size.cast("double") / float(1024 ** power), 1)
        text = F.format_string(f"%.1f {unit}", scaled)
        if power == len(SIZE_UNITS) - 1:
            return F.when(size == 0, "0 B").otherwise(out.otherwise(text))
        bound = size < 1024 ** (power + 1)
        out = F.when(bound, text) if out is None else out.when(bound, text)


def file_kind(name: Column) -> Column:
    return _lookup(KIND_BY_EXTENSION, extension(name), "FILE")
