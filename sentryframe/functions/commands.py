"""Column functions over command lines and decoded payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab as V

_PREFIXES = [V.ENCODED_COMMAND_WORD[:n] for n in range(len(V.ENCODED_COMMAND_WORD), 0, -1)]
# First "-flag blob" whose flag abbreviates -EncodedCommand.  The blob class includes the
# base64 alphabet only; the flag must be whole, so an alternation of its prefixes is exact.
ENCODED_FLAG = (
    r"(?:^|\s)[-/](?i:" + "|".join(_PREFIXES) + r")[\s:]+([A-Za-z0-9+/=]{20,})"
)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def encoded_command(command_line: Column) -> Column:
    """The base64 blob of a PowerShell -EncodedCommand call, or null."""
    return F.nullif(F.regexp_extract(_text(command_line), ENCODED_FLAG, 1), F.lit(""))


def _printable(decoded: Column) -> Column:
    """Decoded text whose printable share exceeds 85 %, else null.

    Printable means: not a control, format, surrogate, private or unassigned character and
    not a separator other than the plain space, with CR, LF and TAB also counted.
    """
    odd = F.regexp_replace(decoded, r"[\P{C}&&[\P{Z} ]]|[\r\n\t]", "")
    share = 1 - F.length(odd) / F.length(decoded)
    return F.when((F.length(decoded) > 0) & (share > 0.85), decoded)


def decode_encoded_command(blob: Column) -> Column:
    """Strict base64, then UTF-16LE, then UTF-8; null unless the text is mostly printable."""
    # try_to_binary accepts whitespace and missing padding; strict decoding does not.
    strict = blob.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    raw = F.when(strict, F.try_to_binary(blob, F.lit("base64")))
    # An odd byte count cannot be UTF-16; an unpaired surrogate decodes to U+FFFD.
    wide = F.when(F.length(raw) % 2 == 0, F.decode(raw, "UTF-16LE"))
    utf16 = F.when(~wide.contains("\ufffd"), _printable(wide))
    utf8 = _printable(F.try_validate_utf8(raw.cast("string")))
    return F.coalesce(utf16, utf8)


def evasion_flags(command_line: Column) -> Column:
    lowered = F.lower(_text(command_line))
    return F.array_compact(
        F.array(*[F.when(lowered.rlike(p), F.lit(n)) for n, p in V.EVASION_FLAGS])
    )


def download_indicators(decoded: Column) -> Column:
    lowered = F.lower(_text(decoded))
    return F.array_compact(
        F.array(*[F.when(lowered.contains(i), F.lit(i)) for i in V.DOWNLOAD_INDICATORS])
    )


def arguments_of(command_line: Column, file_path: Column, process_name: Column) -> Column:
    """The command line without argv[0]: by quote, image path, image name, first token."""
    text = F.trim(_text(command_line))
    folded = F.lower(text)
    unquote = lambda c: F.lower(F.trim(F.regexp_replace(F.trim(_text(c)), '^"+|"+$', "")))
    path, name = unquote(file_path), unquote(process_name)
    closing = F.position(F.lit('"'), text, F.lit(2))
    at = F.position(name, folded)  # 1-based, 0 when absent
    after = lambda start: F.trim(F.substring(text, start, F.length(text)))
    return (
        F.when(text == "", F.lit(""))
        .when(
            F.startswith(text, F.lit('"')),
            F.when(closing > 0, after(closing + 1)).otherwise(F.lit("")),
        )
        .when((path != "") & F.startswith(folded, path), after(F.length(path) + 1))
        .when((name != "") & (at > 0), after(at + F.length(name)))
        .otherwise(F.trim(F.regexp_replace(text, r"^\S+\s*", "")))
    )


def matching_names(c: Column, table) -> Column:
    """Names of every ``(name, regex, ...)`` entry that matches the lower-cased text."""
    lowered = F.lower(_text(c))
    return F.array_compact(
        F.array(*[F.when(lowered.rlike(entry[1]), F.lit(entry[0])) for entry in table])
    )


def descriptions_of(names: Column, table) -> Column:
    """Description texts for pattern names found by :func:`matching_names`."""
    return F.array_compact(
        F.array(*[F.when(F.array_contains(names, e[0]), F.lit(e[2])) for e in table])
    )


def any_of(c: Column, table) -> Column:
    """Cheap prefilter: does any pattern of the table match."""
    return F.lower(_text(c)).rlike("|".join(f"(?:{entry[1]})" for entry in table))


def lsass_indicators(command_line: Column, file_path: Column, process_name: Column) -> Column:
    """LSASS access indicators; the bare reference is looked for in the arguments only."""
    lowered = F.lower(_text(command_line))
    arguments = arguments_of(lowered, file_path, process_name)
    return F.array_compact(
        F.array(
            *[
                F.when(
                    (arguments if name == V.LSASS_ARGUMENT_PATTERN[0] else lowered).rlike(p),
                    F.lit(name),
                )
                for name, p in V.LSASS_PATTERNS
            ]
        )
    )


def truncate(c: Column, limit: int = 120) -> Column:
    text = F.trim(_text(c))
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit - 3), F.lit("..."))
    )
