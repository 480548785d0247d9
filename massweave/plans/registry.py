"""Where query modules register what they define."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register the decorated function, with its SQL where SQL can express it."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn

    return add


#: Moves values off the ties of rounding, on which engines differ.
NUDGE = 1.00000000001


def seconds(column: str = "ts"):
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    from pyspark.sql import functions as F

    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} as timestamp_ntz)) / 1000000D")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def sig(column, name: str):
    """A double to seven significant digits: sums in another order give the same."""
    from pyspark.sql import functions as F

    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.isNotNull(), F.format_string("%.6e", c.cast("double") * NUDGE).cast("double")).alias(name)


def sig_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``sig`` of columns of doubles, by arithmetic where that gives the same digits: for tables of very many rows.

    A value is brought to seven digits before the point and rounded; a whole number times or over an exact power of ten is the double that
    text of these digits gives. Text decides near the middle between two such numbers, near powers of ten and for very large and small values.
    """
    from pyspark.sql import functions as F

    value, place, scaled, whole = ({n: f"_{k}{i}" for i, n in enumerate(names)} for k in "vpsw")
    out = df.withColumns({value[n]: F.col(n).cast("double") * NUDGE for n in names})
    out = out.withColumns({place[n]: 6 - F.floor(F.log10(F.abs(F.col(value[n])))) for n in names})
    ten = lambda n: F.pow(F.lit(10.0), F.abs(F.col(place[n])).cast("double"))
    times = lambda n, c, up: F.when(up, c * ten(n)).otherwise(c / ten(n))
    out = out.withColumns({scaled[n]: times(n, F.abs(F.col(value[n])), F.col(place[n]) >= 0) for n in names})
    out = out.withColumns({whole[n]: F.floor(F.col(scaled[n]) + 0.5).cast("double") for n in names})

    def rounded(n: str):
        v, s, w = F.col(value[n]), F.col(scaled[n]), F.col(whole[n])
        plain = F.abs(F.col(place[n])).between(0, 22) & w.between(1000001, 9999999) & (F.abs(s - w) < 0.499999)
        short = F.signum(v) * times(n, w, F.col(place[n]) < 0)
        return F.when(v == 0, F.lit(0.0)).when(plain, short).when(v.isNotNull(), F.format_string("%.6e", v).cast("double"))

    return out.select(*[rounded(c).alias(c) if c in names else F.col(c) for c in df.columns])


def sig_sql(expression: str, name: str) -> str:
    """The same in SQL."""
    return f"CASE WHEN ({expression}) IS NOT NULL THEN CAST(printf('%.6e', CAST(({expression}) AS DOUBLE) * {NUDGE}) AS DOUBLE) END AS {name}"
