import pytest

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 3000


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra names."""
    prose = [" ".join(f"w{(7 * i * j + j * j) % 97}x{j % 13}" for j in range(60 + i)) for i in range(12)]
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None)[i % 3], len(t)) for i, t in enumerate(prose)]
    rows += [(20, None, "en", "a", None), (21, "", "en", None, 0), (22, " \n\t ", None, "b", 4), (23, LONG, "en", "a", len(LONG)), (None, prose[0], "en", "a", None), (None, None, None, None, None)]
    rows += [(30, prose[3], "en", "b", 1), (30, prose[3], "en", "b", 1), (30, "other text under the same id " * 9, "en", "b", 1), (31, prose[4][:-9] + " changed", "en", "a", 1), (32, "é" * 120 + " ß one", "fr", "c", 1), (32, "A b\x0bC\x0cd", "fr", "c", 1)]
    rows += [(-(1 << 63), prose[5], "en", "a", None)]
    extra = [(*r, 1, 2.0, "x", 3, b"k", *range(9)) for r in rows]
    names = ("toxicity", "copies", "__id", "__hit", "__C", "Mark", "root", "chunk", "row")
    return spark.createDataFrame(extra, "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, fp double, key string, part int, kept binary, " + ", ".join(f"{n} int" for n in names))


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)
