"""Saving a view as text."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumberline.operators.extract import project_view
from lumberline.operators.order import order_columns


def _plain(path: str) -> str:
    return unquote(urlparse(path).path).rstrip("/")


def save_view(view: DataFrame, path: str, fields: list[str] | None = None, column: str = "fields") -> None:
    """Write the lines of a view in document order, as they are or as their chosen fields.

    The parts of the output follow each other in order.  A path that is, or holds, an input of the
    view is refused, and so is one that exists.
    """
    target = _plain(path)
    # Tested where the rows are; one hit is enough.  A plus sign in a path is no space.
    bare = F.regexp_replace("file_path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    source = F.rtrim(F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare), F.lit("/"))
    if not view.where((source == target) | source.startswith(target + "/")).isEmpty():
        raise ValueError(f"{path} is an input of the view")
    shown = project_view(view, fields, column) if fields is not None else view.withColumn("shown", F.col("text"))
    shown.orderBy(*order_columns()).select("shown").write.mode("errorifexists").text(path)
