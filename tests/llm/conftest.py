import random

import pytest


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioubcdfgl") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in each column, empty and long texts, ties, rows repeated in full, copies, and columns with clashing names."""
    rng = random.Random(11)
    base, shared = prose(rng, 300), prose(rng, 80)
    words = base.split()
    texts = [
        None, "", " \n\t ", base, base, base.upper(), " ".join(words[:150] + ["other"] + words[151:]), prose(rng, 60) + " " + shared + " " + prose(rng, 60), shared + " " + prose(rng, 90),
        prose(rng, 2500), "a", "é😀 ñ", "x " * 400, 'token = "0123456789abcdef0123456789abcdef" ' + prose(rng, 70), base, " ".join(words[:299] + ["last"]),
    ]
    rows = [(i, t, "en", None if i % 5 == 4 else f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[8], (None, prose(rng, 55), None, "src0", None), (None, None, None, None, None)]
    clash = ("digest", "row", "n", "key", "kept", "size", "hot", "anchor", "bucket", "position", "features", "doc", "node", "tie", "salt", "__salt", "target")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *[f"'x' AS `{c}`" for c in clash]).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i not in (12, 10, 2)), 0) for i in range(16)] + [(3, 1, 0), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
