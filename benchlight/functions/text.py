"""Text built only at the end: significant digits, logfmt, display units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def significant(x: str, digits: int = 4) -> str:
    """SQL for ``x`` at a number of significant digits, as C's ``%.<digits>g`` prints it.

    The JVM's own ``%g`` keeps trailing zeros and switches to an exponent elsewhere,
    so the two spellings are put together here. A decimal tie is rounded up.
    """
    scientific = f"format_string('%.{digits - 1}e', {x})"
    exponent = f"CAST(split_part({scientific}, 'e', 2) AS INT)"
    spelled = " ".join(
        f"WHEN {power} THEN format_string('%.{digits - 1 - power}f', {x})"
        for power in range(-4, digits)
    )
    fixed = _without_zeros(f"CASE {exponent} {spelled} END")
    mantissa = _without_zeros(f"split_part({scientific}, 'e', 1)")
    return f"""(CASE
        WHEN isnan({x}) THEN 'nan'
        WHEN {x} = double('inf') THEN 'inf'
        WHEN {x} = double('-inf') THEN '-inf'
        WHEN {exponent} BETWEEN -4 AND {digits - 1} THEN {fixed}
        ELSE concat({mantissa}, 'e', split_part({scientific}, 'e', 2)) END)"""


def _without_zeros(text: str) -> str:
    return f"regexp_replace({text}, '(?<=\\\\.[0-9]{{0,20}})0+$|\\\\.0*$', '')"


def quantity_text(magnitude: str, unit: str, digits: int | None = None) -> str:
    """SQL for ``1 mW``, ``2.5 V``: a quantity as it is read in a log line.

    Without ``digits`` the number is spelled as it was written, less a bare ``.0``.
    """
    number = (
        f"regexp_replace(lower(CAST({magnitude} AS STRING)), '[.]0(?=e|$)', '')"
        if digits is None
        else significant(magnitude, digits)
    )
    return f"rtrim(concat_ws(' ', {number}, {unit}))"


# --- logfmt -----------------------------------------------------------------

# One pair: a key, then either a quoted value or a bare one. The quantifiers are
# possessive, so a long quoted value costs no stack. A key starts the line or
# follows white space; matching goes on after a value, so a pair inside one is not
# taken for a pair of the line.
_PAIR = r'(?<![^\s])([^\s="]+)=("[^"\\]*+(?:\\.[^"\\]*+)*+"|[^\s"]*+)(?!\S)'
_HEX = r"x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}"
_PIECE = r"(?s)(\\(?:" + _HEX + r"|.)|[^\\]++)"


def logfmt_fields(line: Column) -> Column:
    """``key=value`` pairs of a line as a map; the first of a repeated key wins.

    Plain text without pairs gives an empty map.
    """
    keys = F.regexp_extract_all(line, F.lit(_PAIR), F.lit(1)).alias("keys")
    values = F.regexp_extract_all(line, F.lit(_PAIR), F.lit(2)).alias("values")

    def as_map(found: Column) -> Column:
        keys, values = found["keys"], found["values"]
        pairs = F.arrays_zip(keys.alias("key"), values.alias("value"))
        first = F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1)
        return F.when(
            F.size(F.array_distinct(keys)) == F.size(keys),
            F.map_from_arrays(keys, F.transform(values, unquote)),
        ).otherwise(
            F.map_from_entries(
                F.transform(first, lambda p: F.struct(p["key"], unquote(p["value"])))
            )
        )

    # Through a list of one, so that the matches are found once and then named.
    return F.get(F.transform(F.array(F.struct(keys, values)), as_map), F.lit(0))


def unquote(token: Column) -> Column:
    """The value a logfmt token stands for."""
    inner = F.substring(token, F.lit(2), F.length(token) - 2)
    # Most escapes are of quotes alone; taking those out is one pass.
    simple = F.replace(inner, F.lit('\\"'), F.lit('"'))
    return (
        F.when(~token.startswith('"'), token)
        .when(~inner.contains("\\"), inner)
        .when(~inner.contains("\\\\") & ~simple.contains("\\"), simple)
        .otherwise(_unescape(inner))
    )


def _unescape(text: Column) -> Column:
    def piece(p: Column) -> Column:
        kind = F.substring(p, 2, 1)
        # Behind a byte order mark, as decoding swallows one at the beginning.
        code = F.concat(
            F.lit("0000FEFF"), F.lpad(F.substring(p, F.lit(3), F.length(p)), 8, "0")
        )
        return (
            F.when(~p.startswith("\\"), p)
            .when(p.rlike(r"^\\(?:" + _HEX + ")$"), F.decode(F.unhex(code), "UTF-32"))
            .when(kind == "n", "\n")
            .when(kind == "r", "\r")
            .when(kind == "t", "\t")
            .otherwise(kind)
        )

    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(1))
    return F.array_join(F.transform(pieces, piece), "")


# What a terminal would act on rather than print: control, format, surrogate,
# private and unassigned characters, and every separator but the plain space.
_UNPRINTABLE = r"[\p{C}\p{Z}&&[^ ]]"
_MUST_QUOTE = r'[ "=]|' + _UNPRINTABLE


def logfmt_token(value: Column) -> Column:
    """A value as a logfmt token, quoted and escaped only when it must be."""

    def escaped(c: Column) -> Column:
        # The code point, as eight hex digits.
        code = F.lower(F.hex(F.encode(c, "UTF-32")))
        return (
            F.when(c == "\\", "\\\\")
            .when(c == '"', '\\"')
            .when(c == "\n", "\\n")
            .when(c == "\r", "\\r")
            .when(c == "\t", "\\t")
            .when(~c.rlike(f"^{_UNPRINTABLE}$"), c)
            .when(code < "00000100", F.concat(F.lit("\\x"), F.right(code, F.lit(2))))
            .when(code < "00010000", F.concat(F.lit("\\u"), F.right(code, F.lit(4))))
            .otherwise(F.concat(F.lit("\\U"), code))
        )

    characters = F.regexp_extract_all(value, F.lit("(?s)(.)"), F.lit(1))
    return (
        F.when(value == "", '""')
        .when(~value.rlike(_MUST_QUOTE), value)
        .otherwise(
            F.concat(F.lit('"'), F.array_join(F.transform(characters, escaped), ""), F.lit('"'))
        )
    )


def to_logfmt(head: dict[str, Column], extras: dict[str, Column]) -> Column:
    """One line: the head in its order, then the extras sorted by key.

    A NULL extra is left out.
    """
    pairs = [*head.items(), *sorted(extras.items())]
    return F.concat_ws(
        " ", *[F.concat(F.lit(f"{k}="), logfmt_token(v.cast("string"))) for k, v in pairs]
    )


# --- display ----------------------------------------------------------------

# --- fixed values: display unit ids -----------------------------------------
PANEL_UNITS = {
    "K": "kelvin",
    "V": "volt",
    "mV": "mvolt",
    "W": "watt",
    "mW": "mwatt",
    "Hz": "hertz",
    "mbar": "pressurembar",
    "Pa": "pressurepa",
    "s": "s",
    "m": "lengthm",
    "mm": "lengthmm",
}


def panel_unit(unit: Column) -> Column:
    """The display id of a unit; an unknown one still renders, as a suffix."""
    known = F.create_map(*[F.lit(x) for pair in PANEL_UNITS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, unit), F.concat(F.lit("suffix:"), unit))


def format_reading(measurement: Column, value: Column) -> Column:
    """Each measurement at its own precision, for a column that mixes them."""
    return (
        F.when(measurement == "frequency", F.format_string("%.6f THz", value / 1e12))
        .when(measurement == "pressure", F.format_string("%.2e", value))
        .otherwise(F.format_string("%.4f", value))
    )
