"""Small tables with the awkward cases that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(k: int, n: int = 40) -> str:
    """n words, a different run for each k."""
    out, state = [], k * 7919 + 13
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[state >> 16 & 15] + str(state >> 8 & 7))
    return " ".join(out)


def awkward(spark):
    """Nulls everywhere, empty, blank and very long texts, repeated rows and ids, ties."""
    rows = [
        (1, sentence(1), "en", "a", 1), (2, sentence(1), "en", "a", 1), (2, sentence(1), "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \n\t ", "fr", "b", 3),
        (None, sentence(2), "fr", None, 5), (None, None, None, None, None), (6, sentence(3, 30_000), "de", "c", 9), (7, "one two", "en", "a", 7), (8, "one two", "en", "b", 7), (9, "é漢字🎉 ünï", "fr", "c", 3), (10, sentence(2), "fr", None, 5),
    ]
    return spark.createDataFrame(rows, DOCS)


def nothing(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """Extra columns under names that operators use inside."""
    from pyspark.sql import functions as F

    for name in ("size", "rank", "slot", "token", "a", "b", "copies", "target", "component", "score"):
        df = df.withColumn(name, F.lit("x"))
    return df
