"""DuckDB SQL that computes each query of the catalog independently."""

from oracles import audit, business, cells, studies

ORACLES: dict[str, str] = {**audit.ORACLES, **studies.ORACLES, **business.ORACLES, **cells.ORACLES}
