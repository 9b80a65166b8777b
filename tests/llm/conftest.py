import os
import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(["the", "and", "of"]) if r.random() < 0.3 else "".join(r.choice("ab cdefghiéñ".replace(" ", "")) for _ in range(r.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls in every column, empty and very long texts, ties, exact and near copies, repeated rows."""
    r = random.Random(5)
    base = [prose(r, n) for n in (3, 9, 30, 60, 120, 400)]
    near = base[5].split(" ")
    near[100] = "changed"
    texts = [*base, base[4], base[4], " ".join(near), "", None, " \t\n ", "x" * 3000, prose(r, 20000), "<|endoftext|> A<s>b ▁ 日本 🙂\x00", "\n".join([base[2]] * 4)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base[3], None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(documents):
    """The same with extra columns that are named like results and like common temporary names."""
    from pyspark.sql import functions as F

    names = "n_words n_hit n_items score kept predicted n_tokens fp component_id fingerprint value type col at _k _t _id _n item_id start n win toxic label count n_entities fail_bits text_out".split()
    return documents.withColumns({n: F.lit("z") for n in names})
