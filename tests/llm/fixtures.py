"""Small inputs with every awkward case, and plain reference versions of the operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def vocabulary(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n)]


def awkward_docs(seed=5, n=40):
    """(doc_id, text) rows: nulls, empty, white space, odd code points, copies, near copies, a long text."""
    r = random.Random(seed)
    words = vocabulary(300, seed)
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    rows = [(i, text(r.randint(1, 150))) for i in range(n)]
    passage = text(50)
    rows += [(100 + i, text(20) + "\n" + passage + "\t" + text(20)) for i in range(6)]
    rows += [(200 + i, rows[3][1]) for i in range(5)]           # exact copies
    rows += [(300 + i, rows[5][1] + " " + words[i]) for i in range(4)]  # near copies
    rows += [(400, None), (401, ""), (402, " \t\r\n\x0b\x0c "), (403, None), (404, "one"), (405, "one two"),
             (406, "Ünï cödé x\x1cy\x85z 𝒳 " + text(5)), (407, "A" * 5000 + " " + text(3)),
             (408, text(9000))]
    rows += [rows[7], rows[7], (rows[8][0], text(60)), (None, text(45)), (None, rows[3][1]), (None, None)]
    r.shuffle(rows)
    return rows


def frame(spark, rows, schema="doc_id long, text string", extra=("key", "fp", "root", "ids", "spans", "id0", "bucket",
                                                                 "score", "severity", "leaked", "start", "id")):
    """The rows with further columns whose names operators use inside."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, schema).repartition(3)
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in extra if c not in df.columns])
