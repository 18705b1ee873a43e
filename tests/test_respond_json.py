"""Messages that do not come back cross into Python as JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.operators.respond import respond


def test_messages_cross_as_json(spark):
    class Kinds:
        """Answers with the types it was sent and the texts."""

        input_columns = ()

        def respond(self, requests):
            def one(m):
                kinds = {type(m).__name__, type(m[0]).__name__, type(m[0]["content"]).__name__}
                return f"{sorted(kinds)} {m[0]['content'][0]['text']} {m[0]['content'][0]['image']}"
            return [one(r["messages"]) for r in requests]

    part = F.struct(F.lit("text").alias("type"), F.col("t").alias("text"), F.lit(None).cast("string").alias("image"))
    df = spark.createDataFrame([(1, 'a "\u3042\n\U0001f600'), (2, None)], "id long, t string").withColumn(
        "messages", F.array(F.struct(F.lit("user").alias("role"), F.array(part).alias("content"))))
    out = respond(df, Kinds, messages_col="messages", pass_columns=["id"], partitions=1, returned=["id"])
    assert out.columns == ["id", "raw_response", "attempts", "waited_s", "error"]
    got = {r["id"]: r["raw_response"] for r in out.collect()}
    assert got == {1: "['dict', 'list'] a \"\u3042\n\U0001f600 None", 2: "['dict', 'list'] None None"}
    assert respond(df, Kinds, messages_col="messages", pass_columns=["id"]).columns[:3] == df.columns
