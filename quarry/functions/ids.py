"""Column functions on addresses, names and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import collapse_space, strip, txt


def basename(c: Column) -> Column:
    """The last path segment, lower-cased; query and fragment don't count."""
    return F.lower(F.regexp_extract(F.regexp_replace(txt(c), r"[?#].*$", F.lit("")), r"([^/\\]*)$", 1))


def extension(c: Column) -> Column:
    return F.regexp_extract(basename(c), r"\.([a-z0-9]+)$", 1)


def document_id(url: Column, file: Column, ordinal: Column, prefix: str = "doc_") -> Column:
    """Prefix and twelve hex digits of the SHA-256 of the url, else the file, else doc_{ordinal}."""
    key = F.coalesce(F.nullif(url, F.lit("")), F.nullif(file, F.lit("")), F.concat(F.lit("doc_"), ordinal.cast("string")))
    return F.concat(F.lit(prefix), F.substring(F.sha2(strip(key).cast("binary"), 256), 1, 12))


def _resolved(path: Column) -> Column:
    """Without '.' and '..' segments."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).when(p == ".", a).otherwise(F.concat(a, F.array(p))),
    )
    return F.array_join(kept, "/")


def absolute_url(c: Column, base: str) -> Column:
    root = F.regexp_extract(F.lit(base), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(F.lit(base), r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    folder = F.regexp_extract(F.regexp_replace(F.lit(base), r"[?#].*$", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(/.*/|/)?", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    path, rest = F.regexp_extract(c, r"^([^?#]*)", 1), F.regexp_extract(c, r"^[^?#]*(.*)$", 1)
    return (
        F.when(c.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), c)
        .when(c.startswith("//"), F.concat(scheme, c))
        .when(c.startswith("/"), F.concat(root, _resolved(path), rest))
        .otherwise(F.concat(root, _resolved(F.concat(folder, path)), rest))
    )


#: Names of the parameter that holds a viewed file's address, in order.
VIEWER_PARAMETERS = ("filePath", "filepath", "file", "path", "url")


def _slashes(c: Column) -> Column:
    return F.replace(F.replace(strip(c), F.lit("\\\\"), F.lit("/")), F.lit("\\"), F.lit("/"))


def normalize_url(c: Column, base: str) -> Column:
    """An attachment's address: viewer links are unwrapped, relative ones made absolute, slashes collapsed, fragments
    dropped; a query stays unless the address is still a viewer's."""
    url = _slashes(txt(c))
    path = lambda u: F.lower(F.regexp_extract(F.regexp_replace(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", F.lit("")), r"^([^?#]*)", 1))
    viewer = lambda u: path(u).contains("viewfile") | path(u).contains("filemanager")
    value = lambda p: F.nullif(F.regexp_extract(url, rf"[?&]{p}=([^&#]*)", 1), F.lit(""))
    inner = F.coalesce(*[value(p) for p in VIEWER_PARAMETERS])
    inner = _slashes(F.try_url_decode(inner))
    target = F.when(viewer(url) & inner.isNotNull(), inner).otherwise(url)
    full = F.when(target.rlike("^https?://"), target).when(viewer(url) & inner.isNull(), url).otherwise(absolute_url(target, base))
    scheme, host = F.regexp_extract(full, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1), F.regexp_extract(full, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    clean = F.regexp_replace(F.regexp_extract(F.regexp_replace(full, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", F.lit("")), r"^([^?#]*)", 1), "/+", F.lit("/"))
    query = F.regexp_extract(full, r"^[^?#]*\?([^#]*)", 1)
    out = F.concat(F.lower(scheme), F.lit("://"), host, clean, F.when((query != "") & ~viewer(full), F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(txt(c) == "", "").otherwise(out)


def slug(c: Column) -> Column:
    """The stem of an address's last path segment, lower-cased."""
    path = F.regexp_extract(F.regexp_replace(txt(c), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", F.lit("")), r"^([^?#]*)", 1)
    name = F.regexp_extract(F.regexp_replace(path, "/+$", F.lit("")), r"([^/]*)$", 1)
    return F.lower(strip(F.regexp_replace(name, r"(?<=.)\.[^.]*$", F.lit(""))))


def normalize_title(c: Column) -> Column:
    """For exact comparison: entities, a date at the end and trailing punctuation dropped, spaces collapsed, lower case."""
    t = F.regexp_replace(txt(c), "&nbsp;?", F.lit(" "))
    t = F.regexp_replace(t, r"(?U)[-–—\s]*\b\d{1,2}/\d{1,2}/\d{4}\b[^\n]*$", F.lit(""))
    return F.lower(collapse_space(F.regexp_replace(t, r"(?U)[.\s\-_–—]+$", F.lit(""))))


def document_year(url: Column, date: Column) -> Column:
    """Year of a date, else of a dated folder in the address; empty if neither shows one."""
    return F.coalesce(F.nullif(F.regexp_extract(txt(date), r"(?U)\b(20\d{2})\b", 1), F.lit("")), F.regexp_extract(txt(url), r"/(20\d{2})(?:\d{2})?/", 1))


def title_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(txt(c), r"(?U)\b(20\d{2})\b", 1), F.lit(""))


#: Formats by MIME type and by leading bytes.
MIME_FORMATS = {
    "application/pdf": "pdf",
    "application/msword": "doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "text/html": "html",
    "text/plain": "txt",
}
MAGIC = (("25504446", "pdf"), ("D0CF11E0", "ole2"), ("504B0304", "zip"))


def file_format(name: Column, mime: Column) -> Column:
    """By extension, else by MIME type, else 'unknown'."""
    kind = F.lower(strip(F.substring_index(txt(mime), ";", 1)))
    by_mime = F.create_map(*[F.lit(x) for kv in MIME_FORMATS.items() for x in kv])[kind]
    return F.coalesce(F.nullif(extension(name), F.lit("")), by_mime, F.lit("unknown"))


def magic_format(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 4))
    out = F.lit(None).cast("string")
    for magic, kind in MAGIC:
        out = F.when(head == magic, kind).otherwise(out)
    return out


def binary_mime(c: Column) -> Column:
    """Application types other than HTML, JSON and XML."""
    mime = F.lower(strip(F.substring_index(txt(c), ";", 1)))
    return mime.startswith("application/") & ~mime.contains("html") & ~mime.contains("json") & ~mime.contains("xml")


def checksum(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def sharded_path(sha: Column, ext: Column) -> Column:
    """aa/<sha>.ext, by the first two digits."""
    return F.concat(F.substring(sha, 1, 2), F.lit("/"), sha, F.when(F.length(ext) > 0, F.concat(F.lit("."), ext)).otherwise(""))
