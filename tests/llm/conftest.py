import random

import pytest
from texts import prose
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Names that operators use for their own columns.
CLASHING = ("block", "key", "row", "kept", "n_words", "fingerprint", "spans", "blob", "rate", "h", "path_", "p_clean", "code", "q", "clean",
            "digest", "salt", "sha", "hot", "n", "m", "length", "bucket", "score", "rank", "weight", "id")


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table of (doc_id, text) rows, with columns whose names clash."""
    fields = [StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
              StructField("source", StringType()), StructField("n_chars", LongType())]
    schema = StructType(fields + [StructField(c, StringType()) for c in CLASHING])

    def build(rows, parts=3, lang=None):
        data = [(i, t, lang(i, t) if lang else None, None, len(t) if t is not None else None, *["?"] * len(CLASHING)) for i, t in rows]
        return spark.createDataFrame(data, schema).repartition(parts)

    return build


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    passage = prose(rng, 60)
    return [
        (1, None), (2, ""), (3, " \n\t\n "), (4, long), (5, "One line only, of nine words or so."),
        (6, passage + " end."), (7, "Begin. " + passage), (7, "Begin. " + passage), (8, passage), (None, passage), (None, None),
        (9, "été 🙂 " * 40), (10, "same words again " * 30), (11, prose(rng, 200)), (12, prose(rng, 36) + "\n" + prose(rng, 3)),
    ]
