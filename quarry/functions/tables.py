"""Table functions for SQL: texts into pieces, measured values and organisations, row by row with LATERAL.

    register(spark)
    spark.sql("SELECT d.doc_id, v.* FROM documents d, LATERAL measured_values(d.text) v")

They give the rows of the DataFrame operators.  Arrow would make tables of each call's rows, which costs more than the
few values of a short text; so `measured_values` does without.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quarry.operators import chunking, experts, extraction


@udtf(returnType="number int, piece string", useArrow=True)
class TextPieces:
    """text_pieces(text, target, overlap): the chunks of a text, from 0.  Null texts have none."""

    def eval(self, text: str | None, target: int, overlap: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(chunking.pieces(text, target, overlap))


@udtf(returnType=extraction.VALUE, useArrow=False)
class MeasuredValues:
    """measured_values(text): values with units, as `extraction.numeric_values` finds them.  Null texts have none."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        for found in extraction.measurements(text or ""):
            yield tuple(found[c] for c in extraction.COLUMNS)


@udtf(returnType="key string, name string, kind string, char_start int, char_end int", useArrow=True)
class Organisations:
    """organisations(text): plausible organisations and where they stand.  Null texts have none."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        for found in experts.mentions(text or ""):
            yield experts.entity_key(found.name), found.name, found.kind, found.start, found.end


FUNCTIONS = {"text_pieces": TextPieces, "measured_values": MeasuredValues, "organisations": Organisations}


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session's SQL."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
