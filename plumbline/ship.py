"""Getting the package to Python workers that don't find it on their path."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def send(spark) -> None:
    """Add the package to the session's files, once; a worker in the repository or with it on PYTHONPATH needs nothing."""
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    application = spark.sparkContext.applicationId
    if str(ROOT) in on_path or application in _sent:
        return
    archive = Path(tempfile.mkdtemp(prefix="plumbline-")) / "plumbline.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in [*sorted(ROOT.glob("plumbline/**/*.py")), *ROOT.glob("corpus_pipeline.py")]:
            z.write(path, path.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(archive))
    _sent.add(application)


def shipped(f):
    """``f``, which takes a session first, with the package sent ahead."""

    @functools.wraps(f)
    def run(spark, *args):
        send(spark)
        return f(spark, *args)

    return run
