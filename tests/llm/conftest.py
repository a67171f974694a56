import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from texts import prose  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, rid string, name string, keep_id string, shard string, h string, mix_hash string, lang_pred string, taken string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and extra columns with clashing names."""
    extra = (1, "r", "n", "k", "s", "h", "m", "l", "t")
    rows = [
        (0, "The quick brown fox. It jumps", "en", "a"), (1, "The  quick\tbrown fox. It jumps", "en", "b"), (2, None, None, None), (3, "", "de", "a"), (None, "The quick brown fox. It jumps", "en", "c"), (None, None, None, None),
        (4, "   \t\n", "fr", None), (5, prose(60_000), "en", "a"), (5, prose(60_000), "en", "a"), (6, "42 !!! 17", "en", "b"), (7, "Straße É 日本語   ok", "de", "b"), (8, prose(300, 3), "en", "a"), (9, prose(300, 3) + " tail", "en", "a"),
    ]
    return spark.createDataFrame([(*r, 1, *extra) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
