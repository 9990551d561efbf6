import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows, with columns whose names clash with results."""

    def make(*rows, clash=True):
        full = [(r[0], r[1], *(r[2:] if len(r) > 2 else ("en", "s")), len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOC)
        if clash:
            from pyspark.sql import functions as F

            for name in ("component_id", "n", "text_hash", "base", "uid", "near", "start", "ids", "row", "leaked", "dropped", "p.q"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make


#: Null, empty, blank, very long, repeated and tied texts.
@pytest.fixture
def odd(docs):
    long = " ".join(f"w{i % 997}x" for i in range(60_000))
    return docs((1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, long), (5, long), (None, "null id here it is"), (6, "Größe naïve 日本語 \U0001f600 end."), (7, "one"), (8, "x" * 300_000))
