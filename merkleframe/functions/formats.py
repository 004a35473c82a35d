"""Object formats: how each namespace's payloads are verified, and which links they hold."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merkleframe.functions.identity import NAMESPACE


@dataclass(frozen=True)
class ObjectFormat:
    """``identity``: payload column -> the native id it must have. ``links``: payload column -> array of keys, or none."""

    namespace: str
    identity: Callable[[Column], Column]
    links: Callable[[Column], Column] | None = None


class FormatRegistry:
    """One format for each namespace; others are unsupported, which is neither valid nor corrupt."""

    def __init__(self, *formats: ObjectFormat):
        self.formats: dict[str, ObjectFormat] = {}
        for f in formats:
            self.add(f)

    def add(self, f: ObjectFormat) -> None:
        import re

        if not re.fullmatch(NAMESPACE.strip("^$"), f.namespace) or len(f.namespace) > 64:
            raise ValueError(f"not a namespace: {f.namespace}")
        if f.namespace in self.formats:
            raise ValueError(f"two formats of {f.namespace}")
        self.formats[f.namespace] = f

    def verify(self, objects: DataFrame) -> DataFrame:
        """Objects (namespace, native_id, payload, links) with ``verdict``: valid, missing payload, wrong identity, wrong links or unsupported."""
        verdict = F.lit("unsupported")
        for ns, f in self.formats.items():
            here = F.when(F.col("payload").isNull(), "missing payload").when(f.identity(F.col("payload")) != F.col("native_id"), "wrong identity")
            if f.links is not None:
                want = F.array_sort(F.array_distinct(f.links(F.col("payload"))))
                here = here.when(~want.eqNullSafe(F.col("links")), "wrong links")
            verdict = F.when(F.col("namespace") == ns, here.otherwise("valid")).otherwise(verdict)
        return objects.withColumn("verdict", verdict)


def builtin() -> FormatRegistry:
    return FormatRegistry(ObjectFormat("graph.blob.v1", lambda p: F.sha2(p, 256)), ObjectFormat("graph.lines.v1", lambda p: F.sha2(p, 256), lambda p: F.transform(F.split(p, "\n"), lambda x: F.sha2(x, 256))))
