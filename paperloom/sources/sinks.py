"""Notes, exports and reports written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def notes(df: DataFrame, path: str, name: str = "note_name", content: str = "full_content") -> None:
    """Each note as a row of text under its name; names repeat safely."""
    df.select(F.col(name).alias("note"), F.col(content).alias("value")).write.mode("overwrite").partitionBy("note").option("lineSep", "\n").text(path)


def note_files(df: DataFrame, folder: str, name: str = "note_name", content: str = "full_content") -> int:
    """Each note as a file of its own in a shared folder, written where it is made. The number written."""
    import os
    from collections.abc import Iterator

    import pandas as pd

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for n, c in zip(b[name], b[content]):
                part = os.path.join(folder, f".{n}.part")
                with open(part, "w", encoding="utf-8") as f:
                    f.write(c or "")
                os.replace(part, os.path.join(folder, f"{n}.md"))
            yield pd.DataFrame({"n": [len(b)]})

    return df.select(name, content).mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


def csv(df: DataFrame, path: str) -> None:
    """With a header and quotes where they are needed, doubled inside."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', quoteAll=False)


def json_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def templates_json(df: DataFrame) -> DataFrame:
    """Templates as JSON texts, without what is null."""
    return df.select("name", F.to_json(F.struct(*df.columns)).alias("json"))


def history_appended(history: DataFrame, new: DataFrame, time: str, most: int = 1000) -> DataFrame:
    """A history with new events, newest first, as long as it is kept."""
    return history.unionByName(new).orderBy(F.col(time).desc()).limit(most)


def csv_line(columns: list) -> F.Column:
    """A row as a line of CSV."""
    quote = lambda c: F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.concat_ws(",", *(F.coalesce(quote(c.cast("string")), F.lit("")) for c in columns))
