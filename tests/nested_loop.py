"""The plainest plan for occurrence counts, to hold the library's against."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def occurrence_counts_naive(corpus: DataFrame, queries: DataFrame, *, query_col: str = "query",
                            doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Reference plan: broadcast nested loop + lookahead regex. Small data only."""
    q = (queries.select(F.col(query_col).alias("query"))
         .where(F.col("query").isNotNull() & (F.length("query") > 0)).distinct())
    pat = F.concat(F.lit("(?=\\Q"), F.replace(F.col("query"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")),
                   F.lit("\\E)"))
    docs = corpus.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text"))
    hit = (docs.join(F.broadcast(q), F.col("text").contains(F.col("query")))
           .select("query", F.regexp_count("text", pat).alias("n")))
    found = hit.groupBy("query").agg(F.sum("n").alias("n"))
    return (q.join(found, "query", "left")
            .select("query", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))
