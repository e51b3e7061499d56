"""Stored attribute values: typed JSON texts, paths into them, canonical forms, and what is shown of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Properties that may be shown, and how long texts may be.
SHOWN = ("GlobalId", "ExpressId", "Name", "TypeName", "Level", "ObjectType", "Materials")
CUT, REDACTED = 160, "[REDACTED_COMPLEX]"


def encoded(c: Column) -> Column:
    """A text as a typed value: json: and its JSON; null stays null JSON."""
    inner = F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', 1)
    return F.concat(F.lit("json:"), F.when(c.isNull(), F.lit("null")).otherwise(inner))


def payload(c: Column) -> Column:
    """The JSON of a stored value as a variant: typed ones as they are, old plain ones as booleans, null, numbers or texts."""
    old = (
        F.when(c.isin("True", "true"), F.lit("true")).when(c.isin("False", "false"), F.lit("false")).when(c.isin("None", "null"), F.lit("null"))
        .when(c.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), c).otherwise(F.substring(encoded(c), 6, 1 << 30))
    )
    return F.try_parse_json(F.when(c.startswith("json:"), F.substring(c, 6, 1 << 30)).otherwise(old))


def at_path(c: Column, path: str) -> Column:
    """The JSON text at a dotted path of a stored value; null where the path is missing or the value there is null."""
    steps = "".join(f"['{p}']" for p in path.split("."))
    return F.to_json(F.try_variant_get(payload(c), "$" + steps, "variant"))


def canonical(c: Column) -> Column:
    """Compact JSON with sorted keys, so that equal values are equal texts."""
    return F.to_json(payload(c))


def shown(c: Column) -> Column:
    """What may be displayed of a stored value: complex ones are redacted, long texts cut."""
    text = canonical(c)
    plain = F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")
    cut = F.when(F.length(plain) > CUT, F.concat(F.substring(plain, 1, CUT), F.lit("..."))).otherwise(plain)
    return F.when(text.startswith("{") | text.startswith("["), F.lit(REDACTED)).otherwise(cut)


def digest(c: Column) -> Column:
    """SHA-256 of a text or of bytes, in hexadecimal digits."""
    return F.sha2(c.cast("binary"), 256)


def joined_label(*parts: Column) -> Column:
    """Source:Identification:Name, without the parts that are blank; null if all are."""
    kept = [F.when(F.trim(p) != "", F.trim(p)) for p in parts]
    text = F.concat_ws(":", *kept)
    return F.when(text != "", text)


def file_stem(c: Column) -> Column:
    """A data set's name that is safe as a file's: other characters than letters, digits, dots and dashes as underscores."""
    return F.regexp_replace(F.trim(c), r"[^A-Za-z0-9._-]+", "_")
