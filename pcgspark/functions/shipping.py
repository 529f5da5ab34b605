"""Makes the package importable in Python workers, wherever the session runs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import pcgspark

#: Bytes of an Arrow batch sent to a worker, where the session sets no bound of its own. One bound for all operators, in
#: bytes, so that neither whole recordings nor very long texts crowd a worker, whichever operator ran last.
ARROW_BYTES = 4 << 20
_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session once; workers import them from there unless they have them already.
    Arrow batches get their bound in bytes unless the session has one."""
    sc = spark.sparkContext
    if spark.conf.get(_BOUND, None) is None:
        spark.conf.set(_BOUND, str(ARROW_BYTES))
    if sc.applicationId in _shipped:
        return
    root = Path(pcgspark.__file__).parent
    folder = Path(tempfile.mkdtemp(prefix="pcgspark-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = folder / "pcgspark.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
