import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use inside themselves
CLASHES = "id long, row_key long, fingerprint string, spans int, ids string, score double, slot int, kinds int, features int, component long, _whole int"

LONG = "\n".join(" ".join(f"w{(i * 7 + j * j) % 911}" for j in range(12)) + "." for i in range(2500))
SHARED = " ".join(f"shared{i}" for i in range(60))
ODD_TEXTS = [
    None,
    "",
    " \n\t\x0b\x0c\r ",
    "word",
    "zwei Wörter",
    LONG,
    "exactly the same text that stands here twice, with a password: hunter2hunter2.",
    "exactly the same text that stands here twice, with a password: hunter2hunter2.",
    f"first words before {SHARED} and after.",
    f"other words in front {SHARED} and behind.",
    "éß\U0001f600 中文 x y \x00 nul",
    "All rights reserved.\nReleased under the MIT License.",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls in all columns, odd texts, a repeated row and columns with clashing names."""
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "a text without an id", None, None, None), rows[6], rows[4]]
    extra = [x.split()[0] for x in CLASHES.split(", ")]
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.selectExpr("*", *[f"cast(null as {k}) as {n}" for n, k in (x.split() for x in CLASHES.split(", "))]).select(*extra, *[c.split()[0] for c in SCHEMA.split(", ")])


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)
