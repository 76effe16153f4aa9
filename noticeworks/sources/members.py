"""Texts of packed archive members."""

from __future__ import annotations

import re
import zipfile
import zlib

_DECLARED = re.compile(rb"""\A(?:\xef\xbb\xbf)?\s*<\?xml[^>]*?encoding=["']([A-Za-z0-9._-]+)["']""")


def unpacked(packed: bytes, method: int, crc: int) -> str:
    """The text of a member, by its declared encoding; raises a ValueError that says what is wrong."""
    if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError("member packed in an unknown way")
    try:
        content = packed if method == zipfile.ZIP_STORED else zlib.decompress(packed, -15)
    except zlib.error as fault:
        raise ValueError("member damaged") from fault
    if zlib.crc32(content) != crc:
        raise ValueError("member damaged")
    declared = _DECLARED.match(content)
    encoding = declared.group(1).decode("ascii") if declared else "utf-8"
    try:
        return content.decode("utf-8-sig" if encoding.lower() == "utf-8" else encoding)
    except (UnicodeDecodeError, LookupError) as fault:
        raise ValueError(f"member not readable as {encoding}") from fault
