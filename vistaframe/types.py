"""Logical types and declared schemas of datasets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from vistaframe.errors import FieldNotFound, JsonRequestError, QueryParsingError

NULLS = ("isNull", "isNotNull")
ORDERED = ("=", "!=", "<=", ">=", "<", ">", "inRange")
#: The relations that a filter may apply to each type.
RELATIONS: dict[str, tuple[str, ...]] = {
    "Number": (*ORDERED, "in", *NULLS),
    "Time": (*ORDERED, *NULLS),
    "Point": ("inRange", *NULLS),
    "Boolean": ("true", "false", *NULLS),
    "String": ("=", "!=", "in", "contains", "startsWith", "endsWith", "matches", "~=", *NULLS),
    "Text": ("contains", *NULLS),
    "Bag": ("contains",),
    "Hierarchy": (),
    "Record": (),
}
ALL_RELATIONS = {r for rs in RELATIONS.values() for r in rs}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    optional: bool = False
    inner: str | None = None
    levels: tuple[tuple[str, str], ...] = ()

    @staticmethod
    def from_json(j: dict) -> Field:
        try:
            name, kind = j["name"], j["datatype"]
        except (KeyError, TypeError) as e:
            raise JsonRequestError(f"a field needs a name and a datatype: {j}") from e
        if kind not in RELATIONS:
            raise JsonRequestError(f"unknown data type: {kind}")
        if kind in ("Bag", "Hierarchy") and j.get("innerType") not in RELATIONS:
            raise JsonRequestError(f"{kind} {name} needs an innerType")
        levels = tuple((x["level"], x["field"]) for x in j.get("levels", ()))
        return Field(name, kind, bool(j.get("isOptional", False)), j.get("innerType"), levels)

    def to_json(self) -> dict:
        out: dict = {"name": self.name, "datatype": self.kind, "isOptional": self.optional}
        if self.inner:
            out["innerType"] = self.inner
        if self.levels:
            out["levels"] = [{"level": a, "field": b} for a, b in self.levels]
        return out

    def spark_type(self) -> T.DataType:
        simple = {"Number": T.DoubleType(), "Time": T.TimestampType(), "Boolean": T.BooleanType(), "String": T.StringType(), "Text": T.StringType()}
        if self.kind == "Point":
            return T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
        if self.kind == "Bag":
            return T.ArrayType(Field("", self.inner or "String").spark_type())
        return simple[self.kind]


@dataclass(frozen=True)
class Schema:
    """A dataset with a time field is temporal; one without is a lookup dataset."""

    type_name: str
    dimension: tuple[Field, ...]
    measurement: tuple[Field, ...]
    primary_key: tuple[str, ...]
    time_field: str | None = None
    fields: dict[str, Field] = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        for f in (*self.dimension, *self.measurement):
            self.fields[f.name] = f
        for k in (*self.primary_key, *([self.time_field] if self.time_field else [])):
            if k not in self.fields:
                raise FieldNotFound(k)
        if self.time_field and self.fields[self.time_field].kind != "Time":
            raise QueryParsingError(f"time field {self.time_field} is not of type Time")

    @staticmethod
    def from_json(j: dict) -> Schema:
        try:
            return Schema(j["typeName"], tuple(map(Field.from_json, j["dimension"])), tuple(map(Field.from_json, j["measurement"])), tuple(j["primaryKey"]), j.get("timeField") or None)
        except KeyError as e:
            raise JsonRequestError(f"a schema needs {e}") from e

    def to_json(self) -> dict:
        out = {"typeName": self.type_name, "dimension": [f.to_json() for f in self.dimension], "measurement": [f.to_json() for f in self.measurement], "primaryKey": list(self.primary_key)}
        return out | ({"timeField": self.time_field} if self.time_field else {})

    def struct(self) -> T.StructType:
        """The table that holds such a dataset: dotted names nest, hierarchies aren't stored."""
        tree: dict = {}
        for f in self.fields.values():
            if f.kind in ("Hierarchy", "Record"):
                continue
            at, *path = tree, *f.name.split(".")
            for p in path[:-1]:
                at = at.setdefault(p, {})
            at[path[-1]] = f

        def build(node: dict) -> T.StructType:
            return T.StructType([T.StructField(k, build(v) if isinstance(v, dict) else v.spark_type(), isinstance(v, dict) or v.optional) for k, v in node.items()])

        return build(tree)

    def ddl(self, table: str, form: str = "parquet") -> str:
        """A statement that creates the table: what isn't optional is not null, and the primary key is kept as a property."""
        cols = [f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable and f.name not in self.primary_key else ' NOT NULL'}" for f in self.struct().fields]
        return f"CREATE TABLE {table} ({', '.join(cols)}) USING {form} TBLPROPERTIES ('primaryKey' = '{','.join(self.primary_key)}', 'timeField' = '{self.time_field or ''}')"
