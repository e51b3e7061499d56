"""String functions as Column expressions, all JVM-side."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words for levels.
LEVELS = ("level", "storey", "story", "floor")
_DIGITS = "0123456789"


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(c, _UPPER, _LOWER)


def schema_family(c: Column) -> Column:
    """The family of a schema's identifier, by its start; null for others."""
    name = F.upper(F.trim(c))
    return F.when(name.startswith("IFC4X3"), "IFC4X3").when(name.startswith("IFC4"), "IFC4").when(name.startswith("IFC2X3"), "IFC2X3")


def blank_to_null(c: Column) -> Column:
    t = F.trim(c.cast("string"))
    return F.when(t != "", t)


def level_text(c: Column) -> Column:
    """Lower case, separators and punctuation as single spaces; null for blank."""
    t = F.regexp_replace(F.lower(F.trim(c)), r"[_./-]+", " ")
    t = F.regexp_replace(t, r"[^a-z0-9\s]", " ")
    return blank_to_null(F.regexp_replace(t, r"\s+", " "))


def _numbers(words: Column, kinds: tuple[str, ...]) -> Column:
    """The number behind the first word of some kinds, in the same word or the next, without leading zeros; null if there is none."""
    pairs = F.arrays_zip(words.alias("own"), F.concat(F.slice(words, 2, F.size(words)), F.array(F.lit(""))).alias("next"))

    def number(pair: Column) -> Column:
        kind = F.rtrim(pair["own"], F.lit(_DIGITS))
        rest = F.substring(pair["own"], F.length(kind) + 1, F.length(pair["own"]))
        # what digits are left of, nothing is left of but digits
        digits = F.when(rest != "", rest).when((pair["next"] != "") & (F.rtrim(pair["next"], F.lit(_DIGITS)) == ""), pair["next"])
        return F.when(kind.isin(*kinds), digits)

    first = F.get(F.filter(F.transform(pairs, number), lambda n: n.isNotNull()), F.lit(0))
    return F.when(first.isNotNull(), F.coalesce(F.nullif(F.ltrim(first, F.lit("0")), F.lit("")), F.lit("0")))


def level_key(c: Column) -> Column:
    """Canonical level, from the words of the normalised text: ground floor, basement, basement N or level N, else that text."""
    t = level_text(c)
    words, around = F.split(t, " "), F.concat(F.lit(" "), t, F.lit(" "))
    ground = reduce(or_, [around.contains(f" ground{gap}{kind} ") for gap in ("", " ") for kind in ("floor", "level")])
    deep, high = _numbers(words, ("basement",)), _numbers(words, LEVELS)
    return (
        F.when(ground, F.lit("ground floor"))
        .when(deep.isNotNull(), F.concat(F.lit("basement "), deep))
        .when(around.contains(" basement "), F.lit("basement"))
        .when(high.isNotNull(), F.concat(F.lit("level "), high))
        .otherwise(t)
    )


def level_key_of(text: str | None) -> str | None:
    """The same for one text on the driver."""
    words = re.findall("[a-z0-9]+", re.sub(r"[^a-z0-9\s]", " ", (text or "").lower()))
    pairs = list(zip(words, [*words, ""][1:], strict=True))

    def number(kinds):
        for own, following in pairs:
            kind = own.rstrip(_DIGITS)
            digits = own[len(kind) :] or (following if following.isdigit() else "")
            if kind in kinds and digits:
                return str(int(digits))
        return None

    if any(own in ("groundfloor", "groundlevel") or (own == "ground" and following in ("floor", "level")) for own, following in pairs):
        return "ground floor"
    if n := number(("basement",)):
        return f"basement {n}"
    if "basement" in words:
        return "basement"
    if n := number(LEVELS):
        return f"level {n}"
    return " ".join(words) or None


def tokens(c: Column) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-cased text, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def terms(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall("[a-z0-9]+", text.lower())))


def combined(*columns: Column) -> Column:
    """Fields in one text; null, empty and the text None count as absent."""
    return F.concat_ws(" ", *[F.when((c != "") & (c != "None"), c) for c in columns])


def has_all_terms(query: str, *columns: Column) -> Column:
    """Whether each token of the query is a token of the columns taken together; false for a query without tokens."""
    wanted = terms(query)
    if not wanted:
        return F.lit(False)
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), tokens(combined(*columns)))) == 0


def plain(c: Column) -> Column:
    """Lower case with other characters than a-z and 0-9 as single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def plain_of(text: str) -> str:
    """The same for one text on the driver."""
    return " ".join(re.findall("[a-z0-9]+", text.lower()))


def numeric_prefix(c: Column) -> Column:
    """The longest numeric prefix as double, 0.0 without one, null for null."""
    digits = F.regexp_extract(F.ltrim(c.cast("string")), r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", 0)
    return F.when(c.isNotNull(), F.coalesce(digits.try_cast("double"), F.lit(0.0)))


def like(c: Column, pattern: str) -> Column:
    """LIKE without case for A-Z and without an escape character."""
    return ascii_lower(c.cast("string")).like(pattern.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\"))


def class_name(text: str) -> str:
    """An element class as written in schemas: Ifc and a capital."""
    t = text.strip()
    if not t:
        return t
    core = t[3:] if t.lower().startswith("ifc") else t
    known = {k.lower(): k for k in (*SUBTYPES, *CLASS_NOUNS.values())}
    return known.get(f"ifc{core.lower()}", "Ifc" + core[:1].upper() + core[1:])


def with_subtypes(name: str) -> list[str]:
    name = class_name(name)
    return [name, *SUBTYPES.get(name, ())]


def context_label(c: Column) -> Column:
    """White space collapsed; null for blank."""
    return blank_to_null(F.regexp_replace(c, r"\s+", " "))


def field_key(text: str) -> str:
    """A field as typed in a question to an attribute name: Net Volume to NetVolume; dotted parts one by one."""
    words = [re.findall("[A-Za-z0-9_]+", p) for p in text.split(".")]
    return ".".join(p[0] if len(p) == 1 else "".join(w[:1].upper() + w[1:] for w in p) for p in words if p)


# Subtypes that a class filter includes.
SUBTYPES = {
    "IfcWall": ("IfcWallStandardCase", "IfcWallElementedCase"),
    "IfcSlab": ("IfcSlabElementedCase",),
    "IfcDoor": ("IfcDoorStandardCase",),
    "IfcWindow": ("IfcWindowStandardCase",),
    "IfcBeam": ("IfcBeamStandardCase",),
    "IfcColumn": ("IfcColumnStandardCase",),
    "IfcStair": ("IfcStairFlight",),
}
# Nouns for classes; plurals are derived below.
_NOUNS = {
    "wall": "IfcWall",
    "curtain wall": "IfcCurtainWall",
    "door": "IfcDoor",
    "window": "IfcWindow",
    "slab": "IfcSlab",
    "column": "IfcColumn",
    "beam": "IfcBeam",
    "stair": "IfcStair",
    "stairwell": "IfcStair",
    "space": "IfcSpace",
    "room": "IfcSpace",
    "roof": "IfcRoof",
    "storey": "IfcBuildingStorey",
    "pipe": "IfcPipeSegment",
    "duct": "IfcDuctSegment",
    "railing": "IfcRailing",
    "ramp": "IfcRamp",
    "chimney": "IfcChimney",
    "covering": "IfcCovering",
    "floor": "IfcSlab",
    "member": "IfcMember",
    "plate": "IfcPlate",
    "footing": "IfcFooting",
}
CLASS_NOUNS = {noun + end: name for noun, name in _NOUNS.items() for end in ("", "s")} | {
    "story": "IfcBuildingStorey",
    "stories": "IfcBuildingStorey",
    "furniture": "IfcFurniture",
    "furnishing": "IfcFurniture",
    "sink": "IfcFlowTerminal",
    "toilet": "IfcFlowTerminal",
    "lamp": "IfcFlowTerminal",
    "site": "IfcSite",
    "project": "IfcProject",
    "building": "IfcBuilding",
    "foundation": "IfcFooting",
}
