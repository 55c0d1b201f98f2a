"""Registered queries that run a stream over the conversations to its end and return what it wrote."""
from __future__ import annotations

from pyspark.sql import functions as F

from evidloom.plans import fixtures as fx
from evidloom.plans.intake_queries import DIALOGUE, DIALOGUE_LOG, TRIAGE_LOG
from evidloom.session import work_folder
from evidloom.sources.tables import table
from evidloom.streaming import feeds


def _turns(spark, folder):
    schema = table(spark, folder, "conversations").schema
    # A glob, since a stream takes a single file only through one.
    return spark.readStream.schema(schema).parquet(f"{folder}/conversations.parque[t]")


def triage_stream(spark, folder):
    def log_rows(batch):
        return fx.log_rows(fx.triaged_messages(spark, fx.with_final_check(batch)))

    work = work_folder(spark, "triage-stream")
    feeds.start_triage_stream(_turns(spark, folder), log_rows, f"{work}/log", f"{work}/checkpoint",
                              once=True).awaitTermination()
    return spark.read.parquet(f"{work}/log").drop("batch")


def _user_turns(spark, folder):
    return _turns(spark, folder).where(F.col("role") == "user").select("conv_id", "turn", "text")


def dialogue_stream(spark, folder):
    work = work_folder(spark, "dialogue-stream")
    query = (
        feeds.dialogue_stream(_user_turns(spark, folder)).writeStream.format("parquet").option("path", f"{work}/out")
        .option("checkpointLocation", f"{work}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{work}/out").where("not late").drop("late")


def dialogue_triage_stream(spark, folder):
    """The running text of every turn, triaged and logged as it arrives."""
    def log_rows(batch):
        return fx.log_rows(fx.triaged_messages(spark, fx.dialogue_messages(batch.where("not late"))))

    work = work_folder(spark, "dialogue-triage")
    dialogues = feeds.dialogue_stream(_user_turns(spark, folder))
    feeds.start_triage_stream(dialogues, log_rows, f"{work}/log", f"{work}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{work}/log").drop("batch")


QUERIES = {"triage_stream": triage_stream, "dialogue_stream": dialogue_stream, "dialogue_triage_stream": dialogue_triage_stream}
ORACLE = {"triage_stream": TRIAGE_LOG, "dialogue_stream": DIALOGUE, "dialogue_triage_stream": DIALOGUE_LOG}
