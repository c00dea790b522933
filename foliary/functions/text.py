"""Text, path and file-name expressions. All are native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SUPPORTED_SUFFIXES = (".pdf", ".txt", ".text", ".md", ".rtf")
FILENAME_LENGTH = 60
FILENAME_FALLBACK = "document"
FILENAME_PATTERN = r"\A[0-9a-zA-Z_]{1,60}\z"
FILENAME_REPLACED = r"[^0-9a-zA-Z_-]+"
PATH_SEPARATOR = " -> "
KEY_SEPARATOR = "||"

# All Unicode white space: as a pattern that reads the same in Java and RE2, and as characters.
SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
SPACE_CHARS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACE_CHARS))


def is_blank(c: Column) -> Column:
    return c.rlike(rf"\A{SPACE}*\z")


def blank_to_null(c: Column) -> Column:
    return F.when(~is_blank(c), c)


def is_empty(c: Column, kind: str = "string") -> Column:
    """Null, blank text, or an array or map without items (``kind``: string, collection, other)."""
    if kind == "string":
        return c.isNull() | is_blank(c)
    if kind == "collection":
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


# -- paths ------------------------------------------------------------------


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """Lower-case suffix with its dot; a leading dot alone is not a suffix."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def has_supported_suffix(path: Column) -> Column:
    return suffix(path).isin(*SUPPORTED_SUFFIXES)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(.)\.[^.]+$", "$1")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def relative_to(path: Column, root: str) -> Column:
    """The part of ``path`` below ``root``; null when the path lies elsewhere."""
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 2147483647))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


# -- file names -------------------------------------------------------------


def clean_file_stem(name: Column, date: Column | None = None) -> Column:
    """A lower-case stem of letters, digits, ``_`` and ``-``; dated when a date is known."""
    dated = name
    if date is not None:
        dated = F.concat(F.coalesce(F.concat(date, F.lit("_")), F.lit("")), name)
    cleaned = F.lower(F.regexp_replace(dated, FILENAME_REPLACED, "_"))
    cut = F.substring(F.regexp_replace(cleaned, r"\A_+|_+\z", ""), 1, FILENAME_LENGTH)
    return F.when(F.length(cut) > 0, cut).otherwise(F.lit(FILENAME_FALLBACK))


def is_valid_file_stem(c: Column) -> Column:
    return c.rlike(FILENAME_PATTERN)


def plural(c: Column) -> Column:
    return F.when(F.endswith(c, F.lit("s")), c).otherwise(F.concat(c, F.lit("s")))


def folder_path(ancestry: Column) -> Column:
    """Folder for a root-to-leaf array of type names, each part in the plural."""
    return F.array_join(F.transform(ancestry, plural), "/")


def join_path(path: Column) -> Column:
    return F.array_join(path, PATH_SEPARATOR)


def split_path(text: Column) -> Column:
    return F.split(text, PATH_SEPARATOR)


def sorted_list(names: Column) -> Column:
    """Names in code-point order, as they stand in messages."""
    return F.array_join(F.array_sort(names), ", ")


# -- hashing and bytes ------------------------------------------------------


def parts_key(*parts: Column) -> Column:
    """md5 of all parts joined by a double bar; a null part counts as empty text."""
    return F.md5(F.concat_ws(KEY_SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def is_pdf(content: Column) -> Column:
    return F.substring(content, 1, 4) == F.lit("%PDF").cast("binary")


# Characters that no text may hold, so they can stand for another one for a while.
_ASIDE = "\ufffe\ufdd0\ufffe"


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text with undecodable bytes left out; replacement characters of the text itself stay.

    Those are put aside while the undecodable bytes become such characters and go.
    """
    text = content.cast("string")
    aside = F.replace(text, F.lit("\ufffd"), F.lit(_ASIDE))
    mended = F.replace(F.replace(F.make_valid_utf8(aside), F.lit("\ufffd"), F.lit("")), F.lit(_ASIDE), F.lit("\ufffd"))
    return F.when(F.is_valid_utf8(text), text).otherwise(mended)


# -- audit text -------------------------------------------------------------


def indented(c: Column, by: str = "  ") -> Column:
    """Indent every line that is not blank."""
    return F.regexp_replace(c, r"(?m)^([^\S\n]*\S)", by + "$1")


def audit_text(parts: Column) -> Column:
    """Readable multi-line text of an array of struct<type,text>, numbered from 0."""
    return F.array_join(
        F.transform(
            parts,
            lambda p, i: F.concat(
                F.lit("content["), i.cast("string"), F.lit("] ("), F.coalesce(p["type"], F.lit("text")),
                F.lit("):\n"), indented(rstrip(p["text"])),
            ),
        ),
        "\n",
    )
