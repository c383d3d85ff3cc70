"""Writing the viewer's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.viewer import viewer_tables


def export_viewer(df: DataFrame, out: str, folder: str, prefix: str, mode: str = "errorifexists") -> None:
    """Each table as Parquet in a folder of its name below `out`; the view is left to the reader's session."""
    for name, table in viewer_tables(df, folder, prefix).items():
        if not name.endswith("View"):
            table.write.mode(mode).parquet(f"{out}/{name}")


def export_viewer_jdbc(df: DataFrame, url: str, folder: str, prefix: str, properties: dict[str, str] | None = None) -> None:
    """The same tables through JDBC; the driver's jar is the user's to supply."""
    for name, table in viewer_tables(df, folder, prefix).items():
        if not name.endswith("View"):
            table.write.jdbc(url, name, mode="errorifexists", properties=properties or {})
