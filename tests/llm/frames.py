"""Small frames with every odd case at once."""

LONG = "lorem ipsum dolor sit amet, " * 8000
PROSE = ("The river ran past the old mill and the miller kept his books by candle light while the children of the village "
         "played near the water until the evening bell called them home to supper and to sleep under heavy blankets of wool")

TEXTS = [None, "", " \n\t ", "é", "one", PROSE, PROSE, PROSE + " and so on", LONG, "ａ ß \U0001f600    ",
         "token = \"0123456789abcdef0123456789abcdef\" mail x.y@z.org +1 (743) 555-3824 10.0.0.255"]

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ["node", "band", "hash", "kept", "rows", "start", "text_key", "_id", "_key", "n_words", "centre", "_row", "spans",
           "copies", "hashes", "window", "ids", "_spans", "_doc_id", "_text_key", "distance", "group"]


def odd_documents(spark, clashes=False):
    rows = [(i, t, ["en", "de", None][i % 3], [None, "s"][i % 2], None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[0], (None, PROSE, None, None, None), (None, None, None, None, None), (4, "other text", "en", "s", 10)]
    df = spark.createDataFrame(rows, DOCS)
    if clashes:
        from pyspark.sql import functions as F
        df = df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])
    return df


def no_documents(spark):
    return spark.createDataFrame([], DOCS)


def listed(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def wide_documents(spark, n=1500):
    """One partition of 6 MB, which are one Arrow batch by the count of rows."""
    from pyspark.sql import functions as F
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(500)), lambda i: F.concat(F.lit("w"), F.col("id") * 1000 + i)))
    return spark.range(n).select(F.col("id").alias("doc_id"), words.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"),
                                 F.length(words).cast("long").alias("n_chars")).coalesce(1)


def bounded(with_python, most=2_000_000):
    """``with_python`` whose function raises on a batch of more characters."""
    def checked(df, inputs, outputs, function, keep=None):
        def run(*columns):
            n = sum(len(x) for c in columns for x in c if isinstance(x, str))
            if n > most:
                raise ValueError(f"{n} characters in a batch")
            return function(*columns)

        return with_python(df, inputs, outputs, run, keep)

    return checked
