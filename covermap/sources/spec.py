"""What a source is, before and after it is read."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from covermap.plans.checkpointing import keep


@dataclass(frozen=True)
class Source:
    """A table that can be read, with the labels that follow it through every result.

    ``computed`` names columns that are not stored as they are, so that no file's statistics speak of them.
    """

    name: str
    source_type: str
    table_name: str
    df: DataFrame
    is_synthetic: bool = False
    computed: tuple[str, ...] = ()

    def sample_rows(self, count: int, order_by: list[str]) -> Source:
        """Keep the first ``count`` rows in the given order only, which must tell rows apart to be repeatable.

        Follow it with ``staged`` where several steps read the sample, so that the order is made once.
        """
        return replace(self, df=self.df.orderBy(*order_by).limit(count))

    def staged(self) -> Source:
        """Read the source once, into the session's shared folder.

        Profiling scans a table several times. For a database, or a table that changes
        meanwhile, staging makes that one read.
        """
        return replace(self, df=keep(self.df))


@dataclass(frozen=True)
class SourceSpec:
    """How to read one table: a reader format, its options, and what to read with it.

    Exactly one of ``table``, ``query`` and ``path`` is set. ``password_env`` names the
    environment variable that holds the password; it is looked up when the reader is built, so
    the password is in no spec and no log. ``predicates`` are conditions that divide the rows, one for each parallel read.
    """

    source_type: str
    table_name: str
    format: str
    options: dict[str, str] = field(default_factory=dict)
    table: str | None = None
    query: str | None = None
    path: str | None = None
    password_env: str | None = None
    enabled: bool = True
    predicates: tuple[str, ...] = ()
