"""Specs for the systems a catalog can come from, set up from the environment."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from covermap import fixed_values as fixed
from covermap.sources.spec import SourceSpec

_Settings = dict[str, str]

#: Rows that a database driver fetches at a time.
FETCH_ROWS = 10_000


def settings_of(system: str, environment: Mapping[str, str]) -> _Settings:
    """The system's settings with defaults filled in; the password is left out."""
    names = fixed.SYSTEM_SETTINGS[system]
    return {key: environment.get(name) or fixed.SETTING_DEFAULTS.get(name, "")
            for key, name in names.items() if key != "password"}


def is_enabled(system: str, environment: Mapping[str, str]) -> bool:
    """Whether the environment says enough to try the system at all."""
    settings = settings_of(system, environment)
    if system == "onelake":
        runtime = environment.get(fixed.RUNTIME_SETTING, fixed.RUNTIME_DEFAULT)
        return runtime == fixed.LAKEHOUSE_RUNTIME and bool(settings["path"])
    return bool(settings["host"] or settings.get("userkey"))


def _postgres(s: _Settings) -> dict[str, str]:
    return {"url": f"jdbc:postgresql://{s['host']}:{s['port']}/{s['database']}",
            "driver": "org.postgresql.Driver", "user": s["user"],
            "loginTimeout": str(fixed.CONNECT_TIMEOUT_SECONDS)}


def _mysql(s: _Settings) -> dict[str, str]:
    return {"url": f"jdbc:mysql://{s['host']}:{s['port']}/{s['database']}",
            "driver": "com.mysql.cj.jdbc.Driver", "user": s["user"],
            "connectTimeout": str(fixed.CONNECT_TIMEOUT_SECONDS * 1000)}


def _mssql(s: _Settings) -> dict[str, str]:
    return {"url": f"jdbc:sqlserver://{s['host']}:{s['port']};databaseName={s['database']}",
            "driver": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "user": s["user"],
            "encrypt": "true", "loginTimeout": str(fixed.CONNECT_TIMEOUT_SECONDS)}


def _hana(s: _Settings) -> dict[str, str]:
    common = {"driver": "com.sap.db.jdbc.Driver", "encrypt": "true", "validateCertificate": "true"}
    if s["userkey"]:
        return {"url": "jdbc:sap://", "key": s["userkey"], **common}
    return {"url": f"jdbc:sap://{s['host']}:{s['port']}", "user": s["user"], **common}


def _databricks(s: _Settings) -> dict[str, str]:
    return {"url": f"jdbc:databricks://{s['host']}:443", "driver": "com.databricks.client.jdbc.Driver",
            "httpPath": s["http_path"], "transportMode": "http", "ssl": "1", "AuthMech": "3", "user": "token"}


_JDBC: dict[str, Callable[[_Settings], dict[str, str]]] = {
    "postgres": _postgres, "mysql": _mysql, "mssql": _mssql, "hana": _hana, "databricks": _databricks,
}


@dataclass(frozen=True)
class Split:
    """How a database table is read in parallel: ranges of a numeric, date or timestamp column."""

    column: str
    lower: str
    upper: str
    parts: int

    def options(self) -> dict[str, str]:
        return {"partitionColumn": self.column, "lowerBound": self.lower, "upperBound": self.upper,
                "numPartitions": str(self.parts)}


def _streaming(system: str, rows: int) -> dict[str, str]:
    """Options with which the driver fetches rows in portions instead of holding the whole result."""
    portions = {"fetchsize": str(rows)}
    if system == "mysql":
        portions["useCursorFetch"] = "true"
    return portions


def system_spec(system: str, table: str, environment: Mapping[str, str] = os.environ,
                table_name: str | None = None, split: Split | None = None, fetch_rows: int = FETCH_ROWS,
                query: str | None = None, predicates: tuple[str, ...] = ()) -> SourceSpec:
    """The spec that reads ``table``, or ``query`` under its name, from ``system``: in portions, and in parallel ranges.

    ``split`` gives even ranges of a column, ``predicates`` a condition for each range, such as ``range_predicates`` of equal
    depth for keys that lie unevenly.
    """
    if split and predicates:
        raise ValueError("give either split or predicates")
    settings = settings_of(system, environment)
    spec = SourceSpec(system, table_name or table, "jdbc", enabled=is_enabled(system, environment))
    if system == "onelake":
        if query is not None:
            raise ValueError("a lakehouse table is read by its path, not by a query")
        return replace(spec, format="delta", path=f"{settings['path']}/Tables/{table}")
    # A user key carries its own login, so no password goes with it.
    password_env = None if settings.get("userkey") else fixed.SYSTEM_SETTINGS[system]["password"]
    options = _JDBC[system](settings) | _streaming(system, fetch_rows) | (split.options() if split else {})
    return replace(spec, options=options, table=table if query is None else None, query=query, password_env=password_env, predicates=predicates)


def default_candidates(environment: Mapping[str, str] = os.environ,
                       splits: Mapping[str, Split] | None = None) -> dict[str, list[SourceSpec]]:
    """For each built-in logical table, the systems to try in order; ``splits`` by logical table. Tables are read whole."""
    splits = splits or {}
    return {name: [system_spec(system, table, environment, table_name=name, split=splits.get(name))
                   for system, table in priority]
            for name, priority in fixed.SOURCE_PRIORITY.items()}
