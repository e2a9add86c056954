"""Bytes to text: binary sniff, lenient and strict decoding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SNIFFED_BYTES = 1024
_NUL = bytearray(b"\x00")


def _is_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def looks_binary(content: Column, strict_sniff: bool = False) -> Column:
    """NUL or invalid UTF-8 in the first KiB.

    A character cut by the KiB boundary is completed before judging it, unless
    ``strict_sniff`` asks for the byte-exact test that calls such a file binary.
    """
    head = F.substring(content, 1, SNIFFED_BYTES)
    valid = _is_utf8(head)
    if not strict_sniff:
        for extra in (1, 2, 3):
            valid = valid | _is_utf8(F.substring(content, 1, SNIFFED_BYTES + extra))
    return F.contains(head, F.lit(_NUL)) | ~valid


def decode_text(content: Column) -> Column:
    """UTF-8 with invalid bytes dropped and newlines translated to ``\\n``."""
    text = F.make_valid_utf8(content.cast("string"))
    text = F.replace(text, F.lit("�"), F.lit(""))
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def decode_strict(content: Column) -> Column:
    """Text as it stands, or NULL when it holds a NUL or is not UTF-8."""
    clean = ~F.contains(content, F.lit(_NUL)) & _is_utf8(content)
    return F.when(clean, content.cast("string"))
