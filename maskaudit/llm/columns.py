"""Which columns of a table an operator carries along."""

from __future__ import annotations

from pyspark.sql import DataFrame


def carried(docs: DataFrame, made: tuple[str, ...], keep: list[str] | None = None) -> list[str]:
    """Return ``keep`` (default: all columns of ``docs`` but ``text``) without names that the operator makes itself.

    Where an incoming column has the name of a made one, in any case, or begins with an underscore, the made one is
    meant and the incoming one is left out.
    """
    own = {name.lower() for name in made}
    names = [c for c in docs.columns if c != "text"] if keep is None else keep
    return [c for c in names if c.lower() not in own and not c.startswith("_")]
