"""Small tables with the cases every operator must take."""

AWKWARD = [
    (1, "a plain text of some words that are read", "en", "s", 40, "x"),
    (2, None, None, None, None, None),
    (3, "", "en", "s", 0, "x"),
    (4, "   \n\t ", "en", "s", 5, "x"),
    (5, "long " * 40_000, "en", "s", 200_000, "x"),
    (6, "a plain text of some words that are read", "en", "s", 40, "x"),
    (6, "a plain text of some words that are read", "en", "s", 40, "x"),
    (None, "no id here", None, "s", 10, "x"),
    (8, "ÀÉÎ çà <|endoftext|> 日本語   İıſK 👩‍💻 tail", "fr", "s", 9, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
