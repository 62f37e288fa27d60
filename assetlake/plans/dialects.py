"""The few spots where the two SQL dialects of the input bindings differ."""

from __future__ import annotations


class SparkText:
    """Bindings for Spark: tables are read straight from their parquet files."""

    def __init__(self, sf_dir: str):
        self.sf_dir = sf_dir.rstrip("/")

    def t(self, name: str) -> str:
        return f"parquet.`{self.sf_dir}/{name}.parquet`"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def div(self, a: str, b: int | str) -> str:
        return f"({a} div {b})"

    def nbytes(self, x: str) -> str:
        return f"cast(octet_length({x}) as bigint)"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def instant(self, x: str) -> str:
        return f"cast({x} as timestamp)"

    def plus_seconds(self, x: str, n: str) -> str:
        return f"({x} + make_dt_interval(0, 0, 0, {n}))"


class DuckText:
    """Bindings for DuckDB: tables are registered views."""

    def t(self, name: str) -> str:
        return name

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def div(self, a: str, b: int | str) -> str:
        return f"({a} // {b})"

    def nbytes(self, x: str) -> str:
        return f"cast(strlen({x}) as bigint)"

    def array(self, *xs: str) -> str:
        return f"[{', '.join(xs)}]"

    def instant(self, x: str) -> str:
        return f"cast({x} as timestamp)"

    def plus_seconds(self, x: str, n: str) -> str:
        return f"({x} + to_seconds({n}))"
