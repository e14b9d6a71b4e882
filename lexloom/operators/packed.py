"""Several values packed in one field: one row per value, with its position.

Quoted spans are replaced by indexed placeholders that cannot occur in the text,
the remaining delimiters are split, the spans come back by array lookup, and the
values are exploded with their positions. Everything is a JVM expression, so the
operator is one narrow stage: no shuffle, no Python.

Defined results: a null, empty or blank field gives no rows; repeated values keep
their own positions; an unclosed quote is ordinary text; private-use characters
in the input survive; the other columns of the input are passed on, and an
existing column named like an output column must be renamed by the caller
(``ValueError`` otherwise).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MARK, _STOP, _RAW = "\ue000", "\ue001", "\ue002"
_SPACE = r"[\s\p{Z}\x{200B}\x{FEFF}]"
#: Marks that part values wherever they stand.
_MARKS = r",;|\t\r\n、，；"
_JOIN_WORDS = "and|und|et|y|и|和|与|及"
_BODY = r'"[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+"'
_QUOTED_BODY = "(?:" + "|".join((_BODY, _BODY.replace('"', "'"), "“[^”]*+”", "„[^“”]*+[“”]", "«[^»]*+»", "「[^」]*+」")) + ")"


def _quoted(names: bool) -> str:
    between = rf"[{_MARKS}]|{_SPACE}[/&+]{_SPACE}" + (rf"|{_SPACE}(?:{_JOIN_WORDS}){_SPACE}" if names else "")
    after = rf"[{_MARKS}]|{_SPACE}[/&+]{_SPACE}" + (rf"|{_SPACE}+(?:{_JOIN_WORDS}){_SPACE}" if names else "")
    return rf"(?s)((?:^|{between}){_SPACE}*)({_QUOTED_BODY})(?={_SPACE}*(?:$|{after}))"


#: The comma of a name written surname first is settled later, so it isn't among these.
_NAME_DELIMITER = rf"[;|\t\r\n、，；]|[,;]?{_SPACE}+(?:{_JOIN_WORDS}){_SPACE}+|^{_SPACE}*(?:{_JOIN_WORDS}){_SPACE}+|{_SPACE}+[/&+]{_SPACE}+"
_TAG_DELIMITER = rf"[{_MARKS}]|{_SPACE}+/{_SPACE}+"
#: A surname alone (particles before it allowed), and what may follow it after a comma.
_SURNAME = r"^(?:\p{Ll}[\p{L}'’]*[\s\p{Z}]+)*\p{L}[\p{L}\p{M}'’\-]+$"
_GIVEN = r"^\p{L}[\p{L}\p{M}'’\-]*\.?(?:[\s\p{Z}]*\p{Lu}\.(?:-?\p{Lu}\.)*)*$"
_SUFFIX = r"^(?:[JS]r\.?|I{2,3}|IV)$"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_SPACE}+|{_SPACE}+$", "")


def _unquote(span: Column) -> Column:
    quote = F.substring(span, 1, 1)
    inner = F.substring(span, F.lit(2), F.length(span) - 2)
    undoubled = F.when(quote.isin('"', "'"), F.replace(inner, F.concat(quote, quote), quote)).otherwise(inner)
    return F.regexp_replace(undoubled, r"\\(.)", "$1")


def _join_names(parts: Column) -> Column:
    """Put "Surname, Given" together again; ``parts`` are pieces between commas."""
    none = F.lit(None).cast("string")
    start = F.struct(F.array().cast("array<string>").alias("out"), none.alias("open"))

    def step(acc: Column, x: Column) -> Column:
        held = acc["open"].isNotNull()
        closed = F.when(held, F.array_append(acc["out"], acc["open"])).otherwise(acc["out"])
        last = F.element_at(F.concat(F.array(F.lit("")), acc["out"]), -1)
        return (
            F.when(x == "", acc)
            .when(held & x.rlike(_GIVEN), F.struct(F.array_append(acc["out"], F.concat(acc["open"], F.lit(", "), x)).alias("out"), none.alias("open")))
            .when(
                ~held & (F.size(acc["out"]) > 0) & x.rlike(_SUFFIX),
                F.struct(F.array_append(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.concat(last, F.lit(", "), x)).alias("out"), none.alias("open")),
            )
            .when(x.rlike(_SURNAME), F.struct(closed.alias("out"), x.alias("open")))
            .otherwise(F.struct(F.array_append(closed, x).alias("out"), none.alias("open")))
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["open"].isNotNull(), F.array_append(acc["out"], acc["open"])).otherwise(acc["out"]))


def unpack_values(packed: Column, names: bool = False) -> Column:
    """``packed`` as an array of its values; ``names``: person names, where "and",
    "&" part values and a comma may belong to a name written surname first."""
    quoted = _quoted(names)
    text = F.replace(_trim(packed), F.lit(_MARK), F.lit(_MARK + _RAW))
    text = _trim(F.regexp_replace(text, r"(?s)^\[(.*)\]$", "$1"))
    spans = F.regexp_extract_all(text, F.lit(quoted), F.lit(2))
    holes = F.split(F.regexp_replace(text, quoted, "$1" + _MARK + _STOP), _MARK + _STOP, -1)
    masked = F.array_join(F.transform(holes, lambda p, i: F.when(i < F.size(holes) - 1, F.concat(p, F.lit(_MARK), i.cast("string"), F.lit(_STOP))).otherwise(p)), "")
    if names:
        pieces = F.split(masked, _NAME_DELIMITER, -1)
        values = F.flatten(F.transform(pieces, lambda p: _join_names(F.transform(F.split(p, ",", -1), _trim))))
    else:
        values = F.transform(F.split(masked, _TAG_DELIMITER, -1), _trim)
    hole = rf"^{_MARK}(\d+){_STOP}$"
    restored = F.transform(values, lambda v: F.when(v.rlike(hole), _trim(_unquote(F.get(spans, F.regexp_extract(v, hole, 1).cast("int"))))).otherwise(v))
    return F.filter(F.transform(restored, lambda v: F.replace(v, F.lit(_MARK + _RAW), F.lit(_MARK))), lambda v: v != "")


def unpack_field(df: DataFrame, field: str, names: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, field, pos, value): a row for each value of column ``field``."""
    if clash := {"field", "pos", "value"} & set(keep):
        raise ValueError(f"rename the kept columns {sorted(clash)} first")
    values = F.posexplode(unpack_values(F.col(field), names)).alias("pos", "value")
    exploded = df.select(*keep, F.lit(field).alias("field"), values)
    return exploded.withColumn("pos", F.col("pos") + 1)


def unpack_fields(df: DataFrame, keep: tuple[str, ...], name_fields: tuple[str, ...], tag_fields: tuple[str, ...]) -> DataFrame:
    """All fields in one pass over ``df``."""
    packed = [F.struct(F.lit(f).alias("field"), unpack_values(F.col(f), names).alias("values")) for fs, names in ((name_fields, True), (tag_fields, False)) for f in fs]
    by_field = df.select(*keep, F.explode(F.array(*packed)).alias("x"))
    return by_field.select(*keep, F.col("x.field").alias("field"), F.posexplode("x.values").alias("pos", "value")).withColumn("pos", F.col("pos") + 1)
