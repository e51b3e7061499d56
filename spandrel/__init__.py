"""Building-model analytics expressed as Spark DataFrames."""

from __future__ import annotations

import os
import tempfile
import zipfile


def ship(spark) -> None:
    """Sends this package to the session's Python workers, once per application, so that they can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_spandrel_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spandrel"), "spandrel.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("spandrel", os.path.relpath(full, home)))
    context.addPyFile(path)
    context._spandrel_shipped = True
