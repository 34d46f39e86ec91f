"""What a file's bytes and name say about it, as Columns of a binary column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beginnings of binary files, in hexadecimal (ELF, PE, PDF, PNG, ZIP, GZIP, BZ2, XZ, Mach-O).
MAGICS = ("7F454C46", "4D5A", "25504446", "89504E47", "504B0304", "1F8B", "425A", "FD377A585A", "FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE")
#: Extensions of text and of binary files.
TEXT_EXTENSIONS = (
    ".txt .md .rst .adoc .go .rs .py .js .ts .jsx .tsx .java .c .h .cpp .hpp .cs .rb .php .pl .pm .swift .kt .sh .bash .zsh .fish "
    ".yaml .yml .json .xml .toml .ini .cfg .conf .html .htm .css .scss .sass .less .sql .graphql .env .editorconfig .gitignore "
    ".dockerignore .makefile Makefile Dockerfile .mod .sum .lock"
).split()
BINARY_EXTENSIONS = (
    ".png .jpg .jpeg .gif .ico .svg .webp .bmp .tiff .mp3 .mp4 .wav .ogg .flac .avi .mov .mkv .pdf .doc .docx .xls .xlsx .ppt .pptx "
    ".zip .tar .gz .bz2 .xz .zst .7z .rar .exe .dll .so .dylib .bin .o .a .lib .class .pyc .pyo .wasm .ttf .otf .woff .woff2 .eot .db .sqlite .sqlite3"
).split()
CONTROL_SHARE = 0.10


def _latin(content: Column) -> Column:
    """One character for each byte."""
    return F.decode(content, "ISO-8859-1")


def is_binary(content: Column) -> Column:
    text = _latin(content)
    size = F.length(content)
    head = F.hex(F.substring(content, 1, 5))
    magic = reduce(lambda a, b: a | b, (head.startswith(m) for m in MAGICS))
    controls = size - F.length(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    return F.when(F.coalesce(size, F.lit(0)) == 0, F.lit(False)).otherwise(magic | F.contains(text, F.lit("\0")) | (controls / size > CONTROL_SHARE))


def has_nul(content: Column) -> Column:
    return F.contains(_latin(content), F.lit("\0"))


def looks_utf8(content: Column) -> Column:
    """Whether lead bytes have their continuation bytes; overlong forms and surrogates pass."""
    return _latin(content).rlike(r"\A(?:[\x00-\x7F]|[\xC0-\xDF][\x80-\xBF]|[\xE0-\xEF][\x80-\xBF]{2}|[\xF0-\xF7][\x80-\xBF]{3})*+\z")


def byte_order_mark(content: Column) -> Column:
    """utf-8, utf-16-le, utf-16-be or an empty string."""
    head = F.hex(F.substring(content, 1, 3))
    return F.when(head == "EFBBBF", "utf-8").when(head.startswith("FFFE"), "utf-16-le").when(head.startswith("FEFF"), "utf-16-be").otherwise("")


def _among(extension: Column, known: list[str]) -> Column:
    return extension.isin(known) | F.regexp_replace(extension, r"\A\.", "").isin(known)


def is_text_extension(extension: Column) -> Column:
    return _among(extension, TEXT_EXTENSIONS)


def is_binary_extension(extension: Column) -> Column:
    return _among(extension, BINARY_EXTENSIONS)


def is_executable(mode: Column) -> Column:
    return F.coalesce(mode.bitwiseAND(0o111) != 0, F.lit(False))
