"""Structured values read out of free-text replies."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from textrec.functions.columns import as_column

STRICT_JSON = {"allowSingleQuotes": "false"}

# The fields of a finding and of a theme in a reply.
FINDING = {"question_num": "int", "quote": "string", "source": "string", "page": "int", "summary": "string"}
CLUSTER = {"theme": "string", "summary": "string", "finding_indices": "array<int>", "key_quotes": "array<string>"}


def one_document(text: Column, element: str) -> Column:
    """Parse a text that must be exactly one JSON value; null otherwise.

    The parser stops after the first value, so the text is read as the content
    of an array: anything after the first value then counts as an error or as a
    second element.
    """
    wrapped = F.concat(F.lit("["), text, F.lit("]"))
    parsed = F.from_json(wrapped, f"array<{element}>", STRICT_JSON)
    # Bound to a name, so that a text is parsed once and not once per use.
    single = F.transform(F.array(parsed), lambda p: F.when(F.size(p) == 1, F.get(p, F.lit(0))))
    return F.get(single, F.lit(0))


def is_json(col: Column | str) -> Column:
    return F.coalesce(one_document(as_column(col), "string").isNotNull(), F.lit(False))


def json_span(col: Column | str) -> Column:
    """From the first ``{`` to the last ``}``; null when there is no such span."""
    return F.regexp_substr(as_column(col), F.lit(r"(?s)\{.*\}"))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# Comes after the document in the list that is parsed. A parser stops where its first value ends, so only a text that
# is one document as a whole has this as the second element.
END = "end of the reply's document"


def reply_document(col: Column | str) -> Column:
    """The JSON document in a reply as a VARIANT; null when the reply holds none, or more than one.

    Parsed once: all that is read out of it later is looked up in binary form. A
    document that names a key twice in one object is read as text, its last
    values counting, as VARIANT has no such objects.
    """

    def first(listed: Column) -> Column:
        whole = F.try_variant_get(listed, "$[1]", "string") == END
        return F.when(whole, F.try_variant_get(listed, "$[0]", "variant"))

    return bound(F.try_parse_json(F.concat(F.lit("["), json_span(col), F.lit(f', "{END}"]'))), first)


def _twice_named(col: Column | str, field: str) -> Column:
    """``reply_items`` of a document that VARIANT refused: elements one by one, those refused too with their last values."""
    known = {**FINDING, **CLUSTER}
    fields = ", ".join(f"{n} {'array<string>' if t.startswith('array') else 'string'}" for n, t in known.items())

    def element(text: Column) -> Column:
        plain = F.to_json(F.from_json(text, fields, STRICT_JSON))
        return F.coalesce(F.try_parse_json(text), F.try_parse_json(plain))

    listed = F.from_json(F.concat(F.lit("["), json_span(col), F.lit(f', "{END}"]')), "array<string>", STRICT_JSON)
    single = bound(listed, lambda texts: F.when(F.get(texts, F.lit(1)) == END, F.get(texts, F.lit(0))))
    document = F.from_json(single, f"{field} array<string>", STRICT_JSON)
    none = F.array().cast("array<string>")
    return bound(F.when(single.isNotNull(), document), lambda d: F.when(d.isNotNull(), F.transform(F.coalesce(d[field], none), element)))


def reply_items(col: Column | str, field: str) -> Column:
    """The elements of the array ``field`` of the JSON object in a reply, as ``array<variant>``.

    Empty when the object has no such array; null when the reply holds no JSON object.
    """
    none = F.array().cast("array<variant>")

    def listed(document: Column) -> Column:
        elements = F.coalesce(F.try_variant_get(document, f"$.{field}", "array<variant>"), none)
        return F.when(document.isNotNull(), elements).otherwise(_twice_named(col, field))

    return bound(reply_document(col), listed)


def whole_number(text: Column) -> Column:
    """A number written as such, as text or with decimals that are zero; null otherwise."""
    return bound(text.try_cast("double"), lambda value: F.when(value == F.floor(value), value.try_cast("int")))


def item_fields(item: Column, fields: Mapping[str, str]) -> Column:
    """The ``fields`` (name: type) of one JSON element as a struct, null where they are absent or of another kind."""
    loose = {"int": "string", "array<int>": "array<variant>", "array<string>": "array<variant>"}
    numbers = lambda value: F.filter(F.transform(value, lambda v: whole_number(_text(v))), lambda n: n.isNotNull())
    made = {"int": whole_number, "array<int>": numbers, "array<string>": lambda value: F.transform(value, _text)}
    read = lambda n, t: F.try_variant_get(item, f"$.{n}", loose.get(t, t))
    return F.struct(*[made.get(t, lambda value: value)(read(n, t)).alias(n) for n, t in fields.items()])


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def reply_findings(col: Column | str) -> Column:
    """The findings in a reply: their fields, and ``raw``, their JSON with keys in order of name."""
    return F.transform(
        reply_items(col, "findings"), lambda item: F.struct(F.to_json(item).alias("raw"), item_fields(item, FINDING).alias("f"))
    )


def reply_clusters(col: Column | str) -> Column:
    """The themes in a reply; null when it holds no JSON object."""
    return F.transform(reply_items(col, "clusters"), lambda item: item_fields(item, CLUSTER))
