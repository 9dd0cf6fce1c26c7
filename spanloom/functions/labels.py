"""Label sets and their columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels in id order. UNKNOWN has an id among services only.
RELEVANCE_LABELS = ["IRRELEVANTE", "PROBLEMA DEL SERVICIO"]
SERVICE_LABELS = [
    "AGUA",
    "ASEO URBANO",
    "COMBINACIÓN",
    "ELECTRICIDAD",
    "GAS DOMÉSTICO",
    "TELECOMUNICACIONES",
    "NO ES SERVICIO",
    "UNKNOWN",
]
SOURCES = ["UNKNOWN", "SCRAPING", "CLIENT"]
UNKNOWN = "UNKNOWN"
IRRELEVANT = "IRRELEVANTE"
PROBLEM = "PROBLEMA DEL SERVICIO"
NOT_A_SERVICE = "NO ES SERVICIO"


# F09
def normalize_label(col: Column, labels, strict=False) -> Column:
    """A label outside the set becomes UNKNOWN (or an error when strict); null stays null."""
    known = col.isin([*labels, UNKNOWN])
    other = (
        F.raise_error(F.concat(F.lit("unknown label: "), col)).cast("string") if strict else F.lit(UNKNOWN)
    )
    return F.when(col.isNull() | known, col).otherwise(other)


def normalize_labels(df, strict=False):
    return df.withColumns(
        {
            "label_relevance": normalize_label(F.col("label_relevance"), RELEVANCE_LABELS, strict),
            "label_service": normalize_label(F.col("label_service"), SERVICE_LABELS, strict),
            "source": normalize_label(F.col("source"), SOURCES, strict),
        }
    )


# F10
def encode_label(col: Column, labels) -> Column:
    """Label to id; a label without id is an error, null stays null."""
    found = F.array_position(F.array(*[F.lit(x) for x in labels]), col) - 1
    bad = F.raise_error(F.concat(F.lit("label without id: "), col)).cast("long")
    return F.when(col.isNull(), F.lit(None).cast("long")).when(found >= 0, found).otherwise(bad)


def decode_label(col: Column, labels) -> Column:
    """Id to label; an id outside the set is an error, null stays null."""
    bad = F.raise_error(F.concat(F.lit("id without label: "), col.cast("string"))).cast("string")
    inside = (col >= 0) & (col < len(labels))
    label = F.get(F.array(*[F.lit(x) for x in labels]), col.cast("int"))
    return F.when(col.isNull(), F.lit(None).cast("string")).when(inside, label).otherwise(bad)


def num_labels(labels) -> int:
    return len(labels)
