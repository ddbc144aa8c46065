"""Session settings the operators rely on, and the shared folder for written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache, wraps

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def build_session(app: str = "goldseam", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; ``conf`` overrides them.

    The method limit is HotSpot's own: generated methods above it are never compiled, and wide
    proofs would run interpreted. Spark then generates smaller methods instead.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="goldseam-")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for one run, below the shared folder the cluster names.

    Only where no folder is configured and the session is local (a laptop) is a temporary one
    used: on a cluster executors could not see it. The session's settings are not touched.
    """
    root = spark.conf.get(CHECKPOINT_SETTING, None)
    if root is None:
        root = spark.sparkContext.getConf().get(CHECKPOINT_SETTING)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(
                f"Set {CHECKPOINT_SETTING} to a folder that every executor can reach."
            )
        root = _local_folder()
    return f"{root.rstrip('/')}/goldseam/{purpose}/{uuid.uuid4().hex}"


@contextmanager
def case_sensitive(spark: SparkSession) -> Iterator[None]:
    """Column names differ by case here; the caller's setting is restored afterwards."""
    key = "spark.sql.caseSensitive"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def exact_names(operator: Callable) -> Callable:
    """For operators that name columns of user data: ``Id`` and ``id`` are two columns there.

    Names are resolved when an operator builds its plan, so the setting matters only inside.
    """

    @wraps(operator)
    def run(df: DataFrame, *args, **kwargs):
        with case_sensitive(df.sparkSession):
            return operator(df, *args, **kwargs)

    return run
