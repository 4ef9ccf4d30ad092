"""Scalar functions on terms and names: columns in, columns out."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.functions.prefixes import XSD

TRIPLE = "s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string"
COLUMNS = ["s", "s_kind", "p", "o", "o_kind", "o_datatype", "o_lang"]
REFERENCE = re.compile(r"\$\(([^)]+)\)")


def uri_tail(u: Column) -> Column:
    """What follows the last ``#``, and of that what follows the last ``/``."""
    return F.substring_index(F.substring_index(u, "#", -1), "/", -1)


def row_id(u: Column) -> Column:
    """The tail, or its part behind the last ``_`` if that begins with a digit."""
    t = uri_tail(u)
    part = F.regexp_extract(t, r"_([0-9][^_]*)$", 1)
    return F.when(part != "", part).otherwise(t)


def last_segment(u: Column) -> Column:
    """What follows the last ``/`` once slashes at the end are gone."""
    return F.substring_index(F.regexp_replace(u, r"/+$", ""), "/", -1)


def column_refs(t: Column) -> Column:
    """Distinct names in ``$(name)``."""
    return F.array_distinct(F.regexp_extract_all(t, F.lit(r"\$\(([^)]+)\)"), 1))


def column_refs_braces(t: Column) -> Column:
    """Distinct names in ``$(name)`` and ``{name}``; names joined by other signs come apart."""
    both = F.concat(F.regexp_extract_all(t, F.lit(r"\$\(([^)]+)\)"), 1), F.flatten(F.transform(F.regexp_extract_all(t, F.lit(r"\{([^{}$]+)\}"), 1), lambda x: F.split(x, r"[^\w]+"))))
    return F.array_distinct(F.array_remove(both, ""))


def camel_case(c: Column) -> Column:
    """``a_b_c`` to ``aBC``: the first part stays, the others get a capital and lower case."""
    parts = F.split(c, "_")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 20))))
    return F.concat(parts[0], F.array_join(rest, ""))


def sanitized(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-zA-Z0-9_]", "_")


def iri_safe(c: Column) -> Column:
    """Percent-encoding of all but unreserved characters, as templates ask for."""
    e = F.url_encode(c)
    return F.replace(F.replace(F.replace(e, F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def lexical(c: Column, kind: T.DataType) -> Column:
    """The term form of a value, null for an empty one: ISO 8601 times, plain decimals, ``true`` and ``false``."""
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(kind, T.DoubleType | T.FloatType | T.DecimalType):
        return F.regexp_replace(F.regexp_replace(c.try_cast("decimal(38,12)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.nullif(c.cast("string"), F.lit(""))


def subject_base(t: Column) -> Column:
    """A subject template without references, ``~iri``, prefix, doubled and closing separators."""
    t = F.regexp_replace(F.regexp_replace(t, r"\$\([^)]*\)", ""), r"~iri$", "")
    t = F.regexp_replace(t, r"^[A-Za-z_][\w-]*:(?!//)", "")
    return F.regexp_replace(F.regexp_replace(t, r"(?<!:)/{2,}", "/"), r"[_/]+$", "")


def source_name(c: Column) -> Column:
    """A source's file name, lower-cased, without folder and ``~format``."""
    return F.lower(F.substring_index(F.substring_index(c, "~", 1), "/", -1))


def host_label(u: Column) -> Column:
    """The namespace prefix that a host suggests; see ``prefixes.host_prefix``."""
    u = F.when(u.contains("://"), u).otherwise(F.concat(F.lit("http://"), u))
    host = F.regexp_replace(F.try_parse_url(u, F.lit("HOST")), r"^www\.", "")
    kept = F.filter(F.split(host, r"\."), lambda x: ~x.isin("com", "org", "net", "io", "eu"))
    name = F.regexp_replace(F.try_element_at(kept, F.lit(1)), r"[-_]", "")
    return F.when(name.rlike(r"^[A-Za-z_]\w*$"), name).otherwise("base")


#: Pattern of a lower-cased column name, predicate (None: ``ex:`` and the name in camel case), datatype; in order, the first that fits counts.
FALLBACKS = (
    (r"^unnamed:\s*\d+$", "ex:rowIndex", "xsd:integer"),
    (r"^index$", "ex:rowIndex", "xsd:integer"),
    (r"(lat|latitude)$", "geo:lat", "xsd:decimal"),
    (r"(lon|long|longitude)$", "geo:long", "xsd:decimal"),
    (r"date.*time|datetime|timestamp|trans_date", "ex:dateTime", "xsd:dateTime"),
    (r"_date_.*|.*_time_.*", "ex:dateTime", "xsd:dateTime"),
    (r"(^date$|_date$)", "ex:date", "xsd:date"),
    (r"(^time$|_time$)", "ex:time", "xsd:dateTime"),
    (r"created_at|updated_at", "schema:dateModified", "xsd:dateTime"),
    (r"(amt|amount|price|cost|fee|salary|revenue|total|balance)$", None, "xsd:decimal"),
    (r"(pop|population|count|num|age|year|qty|quantity|rank|score)$", None, "xsd:integer"),
    (r"^is_|^has_|_flag$|_bool$", None, "xsd:boolean"),
    (r"^id$|_id$", "ex:identifier", "xsd:string"),
    (r"^uuid$|^guid$", "ex:uuid", "xsd:string"),
)
#: The same for columns that are added to a document because nothing uses them; ``None`` as above, and for names that no pattern fits.
INJECTED = (
    (r"(lat|latitude)$", "geo:lat", "xsd:decimal"),
    (r"(lon|long|longitude)$", "geo:long", "xsd:decimal"),
    (r"(date|time|datetime|timestamp)$", None, "xsd:dateTime"),
    (r"(amt|amount|price|cost|fee|salary|revenue|total|balance)$", None, "xsd:decimal"),
    (r"(pop|population|count|num|age|year|qty|quantity|rank|score)$", None, "xsd:integer"),
    (r"^(is_|has_)|(_flag|_bool)$", None, "xsd:boolean"),
    (r"", None, "xsd:string"),
)


def camel(name: str) -> str:
    parts = name.split("_")
    return parts[0] + "".join(p.capitalize() for p in parts[1:])


def fallback(column: str, rules: tuple = FALLBACKS) -> tuple[str, str] | None:
    """Predicate and datatype that a column's name suggests; None if no rule fits."""
    for pattern, predicate, datatype in rules:
        if re.search(pattern, column.lower().strip()):
            return predicate or f"ex:{camel(column)}", datatype
    return None


def fallback_columns(c: Column) -> tuple[Column, Column]:
    """``fallback`` of a column of names: predicate and datatype, null if no rule fits."""
    name = F.lower(F.trim(c))
    predicate, datatype = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, p, d in reversed(FALLBACKS):
        predicate = F.when(name.rlike(pattern), F.concat(F.lit("ex:"), camel_case(c)) if p is None else F.lit(p)).otherwise(predicate)
        datatype = F.when(name.rlike(pattern), F.lit(d)).otherwise(datatype)
    return predicate, datatype


def key_name(c: Column) -> Column:
    """Whether a name looks like a key's."""
    return F.lower(c).rlike(r"(_id|_no|_num|_code|_key|_number|_uuid|_hash)$|^(id|idx|index|row_id|rowid)$")


def key_suffix(c: Column) -> Column:
    """A looser form: the bare letters end like a key's name."""
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]", "").rlike(r"(id|no|num|code|key)$")


def boolean(c: Column) -> Column:
    """Value of a boolean's lexical form; null for anything else."""
    return F.when(c.isin("true", "1"), True).when(c.isin("false", "0"), False)


def similarity(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio, regardless of case."""
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def similarity_column(a: Column, b: Column) -> Column:
    """``similarity`` of two columns, in Arrow batches: Spark has no such function."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p.lower(), q.lower()).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)


def datatype_name(d: str | None) -> str | None:
    """Null for xsd:string: it is what a plain literal has."""
    return None if d in (None, "", XSD + "string") else d
