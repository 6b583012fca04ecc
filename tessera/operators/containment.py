"""Which texts hold which short texts whole: candidates by a join on words, then an exact comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters and digits of a held text that a candidate must have in a row.
KEY, REST = "[a-z0-9]+", "[^a-z0-9]+"


#: Rows and bytes up to which the few side is sent to every task.
MOST_ROWS, MOST_BYTES = 200_000, 32 << 20


def _sent(few: DataFrame, size) -> DataFrame:
    """few to be broadcast if its rows and the sum of their sizes are within the bounds, else itself."""
    n, total = few.agg(F.count(F.lit(1)), F.sum(size)).first()
    return F.broadcast(few) if n <= MOST_ROWS and (total or 0) <= MOST_BYTES else few


def containing(texts: DataFrame, held: DataFrame) -> DataFrame:
    """texts (title, text) and held (qid, held), the few side, to qid, title of the texts that contain a held text whole.

    A text that contains another has its inner words, all but the first and the last, which may be parts of longer
    ones. So the rarest inner word, by how many texts have it, is the key of an equi-join, and only what shares it is
    compared: where they are, if the held texts are within MOST_ROWS and MOST_BYTES, else by shuffled pairs. Held texts
    without inner words are compared with all texts. Null texts hold nothing, and null held texts
    are held by none; an empty one by all. Repeated rows give repeated pairs.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(f"({KEY})"), F.lit(1))
    h = held.filter("held is not null").withColumn("w", words(F.col("held")))
    h = h.withColumn("inner", F.array_distinct(F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0)))))
    t = texts.filter("text is not null")
    wanted = _sent(h.select(F.explode("inner").alias("t")).distinct(), F.lit(16))
    # split gives an empty word more at either end, which is no key
    rows = t.select("title", "text", F.array_distinct(F.split(F.lower("text"), REST)).alias("w"))
    df = rows.select(F.explode("w").alias("t")).join(wanted, "t", "left_semi").groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    rarest = h.select("qid", "held", F.explode("inner").alias("t")).join(df, "t").groupBy("qid", "held").agg(F.min_by("t", F.struct("n", "t")).alias("t"), F.count(F.lit(1)).alias("m"))
    # repeated held rows count their words each time, so m is at least the number of different ones if all are known
    complete = h.select("qid", "held", F.size("inner").alias("k")).distinct().join(rarest, ["qid", "held"]).filter("m >= k")
    copies = held.groupBy("qid", "held").agg(F.count(F.lit(1)).alias("copies"))
    keyed = complete.join(copies, ["qid", "held"]).select("qid", "held", "t", "copies").persist()
    sent = _sent(keyed, F.octet_length("held"))
    if sent is not keyed:
        found = rows.select("title", "text", F.explode("w").alias("t")).join(sent, "t").filter(F.contains("text", "held"))
    else:  # only pairs meet by word, and texts are fetched for them
        pairs = rows.select("title", F.explode("w").alias("t")).join(keyed.select("qid", "t"), "t").select("qid", "title").distinct()
        found = pairs.join(t, "title").join(keyed, "qid").filter(F.contains("text", "held"))
    rest = h.filter(F.size("inner") == 0).select("qid", "held")
    short = t.join(rest, F.contains("text", "held")).select("qid", "title")
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("qid", "title").unionByName(short)
