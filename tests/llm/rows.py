"""Small tables with the cases every operator must take."""

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("node", "key", "size", "taken", "target", "copies", "block", "tile", "spans", "start", "ids",
            "lang_pred", "score", "component", "n", "sketch", "tuple", "copy", "html2")
PROSE = ("the house on the hill was old and the people of the town went there every summer to see the lights "
         "over the bay while the children played under the trees and sang the songs of their parents ")
GERMAN = ("das haus auf dem berg war alt und die leute aus der stadt gingen jeden sommer dorthin um die lichter "
          "zu sehen und die kinder spielten unter den bäumen und sangen die lieder ihrer eltern ")


def rows() -> list[tuple]:
    """Null, empty, blank and very long texts, copies, repeated rows, null fields and ids."""
    found = [
        (1, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (3, PROSE + "more", "en", None, 1),
        (4, GERMAN, "de", "b", 1), (5, GERMAN.upper(), "de", "b", 1), (6, None, None, "b", None),
        (7, "", "en", "c", 0), (8, " \t\n ", None, "c", 3), (9, "word", "en", "c", 4), (10, "12345 !!", None, None, 8),
        (11, PROSE * 300, "en", "a", 1), (12, "x" * 100_000, "en", "a", 100_000), (13, "a b", "en", "a", 3),
        (14, "same " * 500, "en", "d", 2500), (14, "same " * 500, "en", "d", 2500), (15, "other id text", "en", "d", 9),
        (15, "another text of one id", "en", "d", 9), (None, PROSE, "en", "a", 1), (None, None, None, None, None),
        (-7, GERMAN + PROSE, "de", "a", 1), (1 << 60, "é" * 50 + " ü", "de", "a", 52)]
    return found


def documents(spark, more=(), clash=True):
    frame = spark.createDataFrame(rows() + list(more), DOCUMENTS)
    if clash:
        from pyspark.sql import functions as F

        frame = frame.withColumns({c: F.lit("clash") for c in CLASHING})
    return frame.repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
