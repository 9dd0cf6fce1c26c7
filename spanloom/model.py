"""The annotation tables: one long DataFrame per annotation kind, keyed by (doc_id, ann_id)."""

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int>>"
ARGS = "array<struct<role:string,arg:string>>"

# Columns of each table; doc_id may be any type, line_no gives the order of appearance.
TABLE_COLUMNS = {
    "textbounds": ["doc_id", "ann_id", "line_no", "type", "spans", "start", "end", "text"],
    "relations": ["doc_id", "ann_id", "line_no", "type", "arg1_role", "arg1", "arg2_role", "arg2"],
    "events": ["doc_id", "ann_id", "line_no", "type", "trigger", "args"],
    "attributes": ["doc_id", "ann_id", "line_no", "type", "target", "value"],
    "normalizations": ["doc_id", "ann_id", "line_no", "type", "target", "refdb", "refid", "reftext"],
    "equivs": ["doc_id", "ann_id", "line_no", "type", "members"],
    "notes": ["doc_id", "ann_id", "line_no", "type", "target", "note"],
}

# The letters that open the ids of each table.
ID_PREFIX = {
    "textbounds": "T",
    "relations": "R",
    "events": "E",
    "attributes": "A",
    "normalizations": "N",
    "notes": "#",
}


@dataclass(frozen=True)
class Standoff:
    """A corpus of annotations; every field is a DataFrame."""

    textbounds: DataFrame
    relations: DataFrame
    events: DataFrame
    attributes: DataFrame
    normalizations: DataFrame
    equivs: DataFrame
    notes: DataFrame

    def tables(self):
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def with_tables(self, **changed) -> "Standoff":
        return replace(self, **changed)

    def map(self, fn) -> "Standoff":
        """Apply ``fn(kind, df)`` to each table."""
        return Standoff(**{kind: fn(kind, df) for kind, df in self.tables().items()})

    def typed_ids(self) -> DataFrame:
        """(doc_id, ann_id, kind, type) of every annotation that has an id."""
        parts = [
            df.select("doc_id", "ann_id", F.lit(kind).alias("kind"), "type")
            for kind, df in self.tables().items()
            if kind != "equivs"
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def textbound(doc_id, ann_id, line_no, type_, start, end, text):
    """Columns of a one-span text-bound row, in table order."""
    return [
        doc_id.alias("doc_id"),
        ann_id.alias("ann_id"),
        line_no.cast("long").alias("line_no"),
        type_.alias("type"),
        F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))).alias("spans"),
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        text.alias("text"),
    ]
