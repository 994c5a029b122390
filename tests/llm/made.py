"""Documents with the cases that every operator must stand."""

from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000 + "x" * 40_000


def docs(spark, rows):
    return spark.createDataFrame([(*r, *(None,) * (5 - len(r))) for r in rows], DOC)


def hard(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns with clashing names."""
    rows = [
        (1, "Plain words here, and some more of them.", "en", "src1", 40), (2, None, "en", "src2", None), (3, "", None, None, 0), (None, "no id at all, only text to read", "fr", "src3", 31),
        (4, LONG, "de", "src0", len(LONG)), (5, "the same text twice over and over again", "en", "src0", 39), (5, "the same text twice over and over again", "en", "src0", 39),
        (6, "the same text twice over and over again", "es", "src4", 39), (7, "\x00\x1c odd   chars \U0001f600　 é \xa0", None, "src5", 20), (8, "   \n\t ", "en", "src1", 6),
    ]
    clash = {c: F.lit("x") for c in ("score", "predicted", "shard", "slot", "size", "n_tokens", "spans", "vertex", "keys", "sig", "key", "tokens", "epochs", "budget", "part", "same", "n_shingles", "root", "node", "kept", "_text_to_scan", "domain")}
    return docs(spark, rows).withColumns(clash)


def empty(spark):
    return docs(spark, [(1, "x")]).limit(0)
