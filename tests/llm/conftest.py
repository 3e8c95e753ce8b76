import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, stock="the of and to in a is that for it as was with be by on not he his but at are this have from or had an they".split()):
    return " ".join(rng.choice(stock) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows():
    """Texts with nulls, blanks, short and long ones, copies, near copies, repeated rows, null ids and sources."""
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(20, 120)) for _ in range(24)]
    out = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    words = base[3].split()
    out += [(100, base[3], "en", "s0", 1), (101, base[3], None, None, None), (102, " ".join([*words[:-1], "changed"]), "en", "s1", 1)]
    out += [(103, None, "en", "s0", None), (104, "", "en", "s1", 0), (105, " \n\t ", None, "s2", 4), (106, "one two", "en", None, 7), (107, "One TWO", "en", "s0", 7)]
    out += [(108, sentence(rng, 6000), "en", "s0", None), (None, base[5], "en", "s0", 1), (None, "lone text without an id here", None, "s9", 1)]
    out += [(9, base[9], "en", "s0", len(base[9]))] * 2
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).withColumn("extra", F.lit(1))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def all_rows():
    return rows()


@pytest.fixture(scope="session")
def vocabularies():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return {k: public_tokenizers.path(k) for k in ("byte_bpe_50k.json", "word_bpe_49k.json")}


assert T
