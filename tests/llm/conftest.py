import pytest
from pyspark.sql import types as T

#: Columns that operators add, and names that they use inside.
CLASHES = ["n_lines", "n_dropped", "lang_pred", "score", "matches", "ids", "decoded", "fingerprint", "base", "found", "n_shingles", "component_id", "class", "row", "doc", "text_hash", "sample", "node"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHES]
)
LONG = " ".join(f"word{i % 997}x{i}" for i in range(30_000))


def rows():
    texts = [
        (1, "The cat sat on the mat and looked at the moon all night.", "en"),
        (2, "The cat sat on the mat and looked at the moon all night.", "en"),
        (2, "The cat sat on the mat and looked at the moon all night.", "en"),
        (3, None, "en"),
        (4, "", None),
        (5, "  \n\t\n ", "fr"),
        (6, "1234 5678", "de"),
        (7, LONG, "en"),
        (8, "a" * 100_000, None),
        (None, "Une ligne sans identifiant, mais avec des mots.", "fr"),
        (None, None, None),
        (9, "Der Hund \U0001f600 läuft ÜBER die Straße, öfter\nals man denkt.", "de"),
        (9, "same id, another text here", "en"),
        (10, "ABC def", "en"),
    ]
    return [(i, t, lang, None if t is None else len(t), *CLASHES) for i, t, lang in texts]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
