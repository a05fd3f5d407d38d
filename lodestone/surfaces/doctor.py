"""What is set up and what is missing."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..config import EngineConfig
from ..sources import indexes
from .models import Model


def findings(spark: SparkSession, config: EngineConfig) -> list[tuple[str, str]]:
    """(state, text) lines; the state is ok, MISS (nothing works without it) or note."""
    out = []
    for n, path in enumerate(config.indexes()):
        name = "extra index" if n else "index"
        try:
            chunks, m = indexes.read(spark, path)
            out.append(("ok", f"{name}: {path}, {m.get('n_chunks', '?')} chunks, model {m.get('model', '?')}, scope {m.get('version_label', '?')}, channel {m.get('channel', '?')}, built {m.get('built_at', '?')}"))
        except (FileNotFoundError, ValueError) as e:
            out.append(("MISS", f"{name}: {e}"))
    out.append(("ok", f"digest: {config.digest}") if config.digest and indexes.exists(spark, config.digest) else ("note", "no digest is set"))
    out.append(("ok", f"product: {config.product}") if config.product else ("note", "no product is named; only general words and patterns apply"))
    try:
        model = Model.of(config)
        out.append(("ok", f"answers come from {model.provider}/{model.name}"))
    except ValueError as e:
        out.append(("note", f"answers are not set up: {e}"))
    return out


def report(spark: SparkSession, config: EngineConfig) -> tuple[str, bool]:
    found = findings(spark, config)
    ready = all(state != "MISS" for state, _ in found)
    return "\n".join([*(f"[{state:4}] {text}" for state, text in found), "result: " + ("ready" if ready else "needs attention")]), ready
