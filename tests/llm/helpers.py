"""Small tables with every edge case, and brute-force versions of the operators."""

import random

SF = "/root/testdata/sf0.001"
VOCAB = None

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


def edge_rows(ids=True):
    """(doc_id, text, lang, source): nulls in every column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(7)
    base, passage = sentence(rng, 60), sentence(rng, 20)
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, base + " one more", "de", "b"),
        (3, base + " one more", "de", "b"),
        (4, None, "en", "a"),
        (5, "", None, None),
        (6, " \n\t ", "fr", "b"),
        (7, "word", "fr", None),
        (8, sentence(rng, 20000), "en", "c"),
        (9, sentence(rng, 30) + " " + passage + " " + sentence(rng, 5), "en", "c"),
        (10, passage + " " + sentence(rng, 30), None, "c"),
        (11, "É à 日本 🙂 " * 30 + "\x00<|endoftext|> Á", "xx", "d"),
        (12, "In. " * 400, "en", "d"),
        (13, "a\u0085b c </s>[INST] x [/INST]", "en", "d"),
    ]
    return rows + [(None, sentence(rng, 10), "en", "a")] if ids else rows


SCHEMA = "doc_id long, text string, lang string, source string"


def edge_docs(spark, ids=True):
    """With extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows(ids), SCHEMA)
    clash = ["ids", "n_tokens", "fp", "node", "key", "value", "size", "target", "copy", "carried", "_o", "shard", "p_text", "n", "host", "path", "component_id", "part", "kept", "n_bytes", "n_removed", "n_spans", "carried", "row", "_id", "_copies", "_copy", "taken"]
    return df.withColumns({c: F.lit(c) for c in clash}).withColumn("n_chars", F.length("text").cast("long"))


def odd_docs(spark):
    """With columns of other types under the operators' own names."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(edge_rows(), SCHEMA).withColumns({"n_bytes": F.lit(7).cast("long"), "kept": F.lit("kept"), "_id": F.lit(1.5), "row": F.array(F.lit(1)), "carried": F.lit(True)})


def empty_docs(spark):
    return edge_docs(spark).limit(0)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
