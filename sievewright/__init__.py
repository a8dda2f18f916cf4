"""Spark-native candidate ranking, order validation and filing-event scoring."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

_shipped: set[str] = set()


def ship(spark) -> None:
    """Send this package to the executors of a session, once, so that Python workers
    find it wherever the driver was started. A session that has it already on its
    workers' path (PYTHONPATH, --py-files) loses nothing."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="sievewright-")) / f"{here.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
