"""Turning collections of raw documents into knowledge bases and training data, as Spark jobs."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

_SHIPPED: set[str] = set()


def ship(spark) -> None:
    """Sends this package to the executors' Python workers, once an application, so that nothing has to be installed there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quillmill-")) / "quillmill.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"quillmill/{p.relative_to(root)}")
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
