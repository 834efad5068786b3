"""From the turns of conversations to series of what they are like, taking only new files.

    python -m jobs.conversation_series --source conversations --target series

Each run takes the files that came since the last one (a file stream with a checkpoint) and ends. ``turns`` has every turn's measures, by
batch and folder; ``series``, by folder, has each conversation in order: lengths, rolling means, changes, sums so far, and the next turn's
words as the target. Only folders that a batch touches are worked out again, from ``turns`` and not from what they held: a batch that broke off
is repeated with the same result. Texts are read once and not kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import fills
from chronoloom.operators.frame import before, over, whole

from . import common

NAME = "conversation_series"
WORD = r"[^\x20\x09-\x0D]+"


def measures(turns: DataFrame, width: int) -> DataFrame:
    """A row for each turn with its lengths, without its text. Null text is empty; turns without a conversation or number go."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = turns.where("conv_id is not null and turn is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.char_length(text).cast("long").alias("n_chars"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
        F.regexp_count(text, F.lit(r"\?")).cast("long").alias("n_questions"),
    )
    return out.withColumn("part", F.floor(F.col("conv_id") / F.lit(width)).cast("long"))


def series(turns: DataFrame, window: int) -> DataFrame:
    """Each conversation's turns in order. Of a turn that came more than once the longest stays, whichever came first."""
    size = [F.col(c) for c in ("n_chars", "n_words", "n_questions", "role")]
    one = turns.groupBy("part", "conv_id", "turn").agg(F.max(F.struct(*size)).alias("m")).select("part", "conv_id", "turn", "m.*")
    w, every = over("conv_id", "turn"), whole("conv_id")
    past: Column = F.lag("n_words", 1).over(w)
    return one.select(
        "conv_id", "turn", "role", "n_chars", "n_words", "n_questions",
        (F.row_number().over(w) - 1).cast("long").alias("position"),
        F.count("*").over(every).alias("n_turns"),
        F.round(fills.rolling_mean("n_words", w, window), 6).alias("words_mean"),
        (F.col("n_words") - past).alias("words_change"),
        F.sum("n_words").over(before(w)).alias("words_so_far"),
        F.sum((F.col("role") == "user").cast("long")).over(before(w)).alias("user_turns"),
        F.lead("n_words", 1).over(w).alias("next_words"),
        "part",
    )


def run(spark: SparkSession, source: str, target: str, *, width: int, window: int, files: int) -> dict:
    """Takes what is new and ends. The rows read and written, and how many folders were worked out again."""
    done = {"read": 0, "written": 0, "batches": 0}

    def take(batch: DataFrame, number: int) -> None:
        new = measures(batch, width).withColumn("batch", F.lit(number).cast("long"))
        # A batch that is repeated replaces what it wrote.
        done["read"] += common.write(new.repartition("part"), f"{target}/turns", ["batch", "part"], "turns", dynamic=True)
        held = spark.read.schema(new.schema).parquet(f"{target}/turns")
        touched = held.where(F.col("batch") == number).select("part").distinct()
        again = series(held.join(touched, "part", "left_semi"), window)
        done["written"] += common.write(again.repartition("part"), f"{target}/series", ["part"], "the series", dynamic=True)
        done["batches"] += 1

    schema = spark.read.parquet(source).schema
    # As a pattern that only the path itself matches, as a stream's path may be one file only then. No age is too old: files are known
    # by the checkpoint alone.
    source = source.rstrip("/")
    exact = f"{source[:-1]}[{source[-1]}]"
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("maxFileAge", "36500d").parquet(exact)
    stream = new.select("conv_id", "turn", "role", "text").writeStream.foreachBatch(take).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    common.log.info("read %d turns of %s in %d batches", done["read"], source, done["batches"])
    return done


def output(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/series").drop("part")


def job2_conversation_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of all conversations, as they stand after a second run that finds nothing new."""
    target = common.folder(spark, "job2")
    for _ in range(2):
        run(spark, f"{sf_dir}/conversations.parquet", target, **common.settings(NAME))
    return output(spark, target)


def _sql(window: int, **_) -> str:
    return rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
m AS (SELECT conv_id, turn, role, length(text) AS n_chars, len(regexp_extract_all(text, '{WORD}')) AS n_words, length(text) - length(replace(text, '?', '')) AS n_questions FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n_chars DESC, n_words DESC, n_questions DESC, role DESC) AS r FROM m),
d AS (SELECT conv_id, turn, role, n_chars, n_words, n_questions FROM o WHERE r = 1)
SELECT *, row_number() OVER w - 1 AS position, count(*) OVER (PARTITION BY conv_id) AS n_turns,
    round(avg(n_words) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW), 6) AS words_mean, n_words - lag(n_words) OVER w AS words_change,
    CAST(sum(n_words) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS words_so_far,
    CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS user_turns, lead(n_words) OVER w AS next_words
FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""


JOB2_SQL = _sql(**common.settings(NAME))

if __name__ == "__main__":
    common.main(NAME, run, __doc__.splitlines()[0])
