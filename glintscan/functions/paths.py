"""Path and file-name expressions (SQL text)."""

from __future__ import annotations

from glintscan.functions import fixed
from glintscan.functions.cols import lit, lookup


def base_name(path: str) -> str:
    return f"substring_index({path}, '/', -1)"


def suffix(path: str) -> str:
    """Lower-case suffix with its dot; none for dot-files or a trailing dot."""
    pattern = lit(r"(?s)^.+(\.[^.]+)$")
    return f"lower(regexp_extract({base_name(path)}, {pattern}, 1))"


def is_hidden(path: str) -> str:
    name = base_name(path)
    return f"(startswith({name}, '.') OR startswith({name}, '~$'))"


def in_hidden_dir(path: str) -> str:
    """A directory of the path starts with a dot."""
    pattern = lit(r"/\.[^/]*/")
    return f"({path} RLIKE {pattern})"


def is_internal_stream(path: str) -> str:
    return f"({base_name(path)} RLIKE {lit(fixed.INTERNAL_STREAM_PATTERN)})"


def expected_mime(ext: str) -> str:
    """MIME type by extension, with or without its dot, any case."""
    dotted = f"lower(if(startswith({ext}, '.'), {ext}, concat('.', {ext})))"
    return f"coalesce({lookup(dotted, fixed.EXTENSION_MIME)}, {lit(fixed.OCTET)})"


def mime_extension(mime: str) -> str:
    """Extension for a MIME type: the last one listed, else ``.bin``."""
    reverse = {m: e for e, m in fixed.EXTENSION_MIME.items()}
    return f"coalesce({lookup(mime, reverse)}, '.bin')"
