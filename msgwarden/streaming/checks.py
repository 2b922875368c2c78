"""The checks over arriving messages.

Checks and scores are projections without state, so the batch operators run unchanged on a
stream. The sink's checkpoint makes a restart resume without gaps or repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.guardrails import CheckSettings, check_cases


def check_stream(
    messages: DataFrame,
    out: str,
    checkpoint: str,
    text: str = "expected_output",
    settings: CheckSettings = CheckSettings(),
    once: bool = False,
) -> StreamingQuery:
    """Checks a stream of messages (id, phase, text) into parquet files.

    ``checkpoint`` belongs in storage that all machines share. With ``once`` the stream ends
    when the messages present at its start are checked.
    """
    writer = (
        check_cases(messages, text=text, settings=settings)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
