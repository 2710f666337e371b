"""Units in a relational database: read by Spark's JDBC source, written through DB-API connections of the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, Row, SparkSession

Connect = Callable[[], object]
BATCH = 1000


def scan(spark: SparkSession, url: str, table: str, columns: Sequence[str] = ("*",), limit: int | None = None, options: Mapping[str, str] | None = None) -> DataFrame:
    """Columns of a table; what is selected and filtered goes to the database. ``options`` such as partitionColumn, lowerBound, upperBound and numPartitions spread the read."""
    df = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(options or {})).load().select(*columns)
    return df if limit is None else df.limit(limit)


def _name(x: str) -> str:
    if not x.replace("_", "").replace(".", "").isalnum():
        raise ValueError(f"{x!r} is no plain name")
    return x


def upsert(rows: DataFrame, connect: Connect, table: str, key: str = "eu_id", mark: str = "%s") -> None:
    """Rows by ``INSERT ... ON CONFLICT DO UPDATE``, a transaction a partition: a partition that is written twice, or again after it was lost, leaves the same rows. ``mark`` is the driver's sign for a parameter."""
    columns = [_name(c) for c in rows.columns]
    rest = [c for c in columns if c != key]
    says = f"DO UPDATE SET {', '.join(f'{c} = excluded.{c}' for c in rest)}" if rest else "DO NOTHING"
    sql = f"INSERT INTO {_name(table)} ({', '.join(columns)}) VALUES ({', '.join([mark] * len(columns))}) ON CONFLICT ({_name(key)}) {says}"

    def write(it: Iterator[Row]) -> None:
        link = connect()
        try:
            held: list[tuple] = []
            for r in it:
                held.append(tuple(r))
                if len(held) == BATCH:
                    link.cursor().executemany(sql, held)
                    held = []
            if held:
                link.cursor().executemany(sql, held)
            link.commit()
        finally:
            link.close()

    rows.foreachPartition(write)


def delete(documents: DataFrame, connect: Connect, table: str, column: str = "document_id", mark: str = "%s") -> None:
    """All rows of the documents (first column); those that have none change nothing."""
    sql = f"DELETE FROM {_name(table)} WHERE {_name(column)} = {mark}"

    def write(it: Iterator[Row]) -> None:
        link = connect()
        try:
            link.cursor().executemany(sql, [(r[0],) for r in it])
            link.commit()
        finally:
            link.close()

    documents.distinct().foreachPartition(write)
