import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHING = ["row", "doc", "spans", "n_words", "kept", "_m", "_measures", "_kept", "_row", "_key", "component_id", "piece",
            "length", "offset", "epoch", "taken", "_domain", "_n_words", "n_tokens", "n_replaced", "h", "s", "part", "full", "end_at",
            "end_id", "end_tokens", "end_taken", "_e", "budget", "_spans", "_epoch", "_taken", "_task", "_place", "_end_full"]


def rows():
    prose = " ".join(f"word{i % 97} of{i % 13}" for i in range(400))
    other = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu. " * 3
    long = " ".join(f"tok{(i * 7919) % 5003}" for i in range(30_000))
    return [
        (1, prose, "en", "src0", 1), (2, prose, "en", "src0", 1), (2, prose, "en", "src0", 1),
        (3, prose + " and then some more words at its end", "en", "src1", 2), (4, None, "de", "src2", None),
        (5, "", "de", None, 0), (6, " \n\t ", None, "src2", 4), (7, "a", "fr", "src3", 1), (8, other, "fr", "src3", 9),
        (9, "ONE " + other.upper() + " two", "fr", "src3", 9), (None, other, "fr", "src3", 9), (None, None, None, None, None),
        (10, long, "es", "src12", 7), (11, long[5000:], "es", "src12", 7), (12, "x" * 90_000, "en", "src0", 3),
        (13, "one two three four", "en", "src0", 3), (14, "one two three four", "en", "src0", 3),
        (15, "line\nline\nline\n" * 30, "en", "src0", 3), (-3, "é" * 70 + " çà ß İ " + "ñ" * 70, "es", "src4", 5),
        (16, "mail me: Jo.Doe@mail.example.com or +1 (222) 555-0199, 10.20.30.40, JO.DOE@mail.example.com", "en", "src5", 5),
        (17, "<|endoftext|> " * 40 + "* # $ % & | < >" * 40, "en", "src6", 5),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows(), DOCS).repartition(3)
    return docs.select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def words_file():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def bytes_file():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
