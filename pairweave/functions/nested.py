"""Look-ups in nested JSON documents where the path is not known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _entries(document: Column) -> Column:
    """(member (key, value), kind) of an object's members in the order of the document; none where it is no object.

    Members are parsed twice: as text, which keeps the order of what is nested
    in them, and as VARIANT, which tells an object from a string that looks like
    one.
    """
    texts, kinds = F.from_json(document, "map<string,string>"), F.from_json(document, "map<string,variant>")
    members = F.arrays_zip(F.map_entries(texts).alias("member"), F.transform(F.map_values(kinds), F.schema_of_variant).alias("kind"))
    return F.coalesce(members, F.array().cast("array<struct<member:struct<key:string,value:string>,kind:string>>"))


def _objects(text: Column, kind: Column) -> Column:
    """The objects directly in a value: itself, or the elements of a list that are objects."""
    in_list = F.arrays_zip(F.from_json(text, "array<string>").alias("text"), F.transform(F.from_json(text, "array<variant>"), F.schema_of_variant).alias("kind"))
    objects = F.transform(F.filter(in_list, lambda x: x["kind"].startswith("OBJECT")), lambda x: x["text"])
    return F.when(kind.startswith("OBJECT"), F.array(text)).when(kind.startswith("ARRAY"), objects).otherwise(F.array().cast("array<string>"))


def json_first(document: Column, key: str, depth: int = 6) -> Column:
    """The value, as text, of the first member named ``key`` anywhere in a JSON object, depth first in the order of the document.

    Objects are searched, and the objects in lists, down to ``depth`` levels. A
    member named ``key`` ends the search of its object: if its value is null,
    the search goes on behind the object. Null where nothing is found, and for
    what isn't a JSON object.
    """

    def found(doc: Column, left: int) -> Column:
        """An array of the value, or an empty one."""

        def of(entry: Column) -> Column:
            own = F.array(entry["member"]["value"])
            if left == 1:
                nested = F.array().cast("array<string>")
            else:
                inner = F.flatten(F.transform(_objects(entry["member"]["value"], entry["kind"]), lambda d: found(d, left - 1)))
                nested = F.slice(F.filter(inner, lambda x: x.isNotNull()), 1, 1)
            return F.when(entry["member"]["key"] == key, own).otherwise(nested)

        return F.slice(F.flatten(F.transform(_entries(doc), of)), 1, 1)

    return F.get(found(document, depth), F.lit(0))
