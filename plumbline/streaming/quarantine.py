"""Row rules on a stream: good rows pass on, broken rows are set aside with the rules they break."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.rules import Rule, split_rows


def good_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return split_rows(df, rules).filter(F.size("broken") == 0).drop("broken")


def broken_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return split_rows(df, rules).filter(F.size("broken") > 0)


def quarantine(
    stream: DataFrame, rules: Sequence[Rule], good: str, broken: str, checkpoint: str, **trigger
) -> list[StreamingQuery]:
    """Two stateless queries with a file sink each; the file sink commits every row once."""
    trigger = trigger or {"availableNow": True}
    return [
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", f"{checkpoint}/{name}")
        .trigger(**trigger)
        .start()
        for name, df, path in (
            ("good", good_rows(stream, rules), good),
            ("broken", broken_rows(stream, rules), broken),
        )
    ]
