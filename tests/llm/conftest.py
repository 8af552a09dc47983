import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """DataFrame of documents from (doc_id, text) or (doc_id, text, source); extra columns clash with operators' own names."""
    from pyspark.sql import functions as F

    def make(rows, clash=True):
        rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(rows, SCHEMA)
        if clash:
            names = ("score", "word", "shard", "fp", "component_id", "n_words", "held_out", "size", "spans", "h", "start", "kept", "id", "base", "rank", "target", "__w")
            df = df.withColumns({c: F.lit("clash") for c in names})
        return df

    return make


@pytest.fixture(scope="session")
def awkward():
    """Null, empty, blank, tied, repeated and very long rows."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 9))) for _ in range(300)]
    long = " ".join(r.choice(words) for _ in range(60_000))
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "Two words"), (6, long), (6, long), (7, "a" * 50_000), (None, "no id here"), (8, " ".join(words)), (9, " ".join(words)), (10, "ÀÉ ßtraße İx ſ")]
