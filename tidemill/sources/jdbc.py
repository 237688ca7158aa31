"""Small dimension tables in a database: set-up, reading and writing over JDBC."""

from __future__ import annotations

import os
import random
import shutil
import tempfile
import threading
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import closing, contextmanager, suppress

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
#: Rows that the driver holds at once while it reads a database of its own.
PART_ROWS = 50_000


def memory_url(name: str) -> str:
    return f"jdbc:derby:memory:{name};create=true"


@contextmanager
def own_database(spark: SparkSession) -> Iterator[str]:
    """The address of a database in a temporary folder of the driver, which goes afterwards."""
    folder = tempfile.mkdtemp(prefix="tidemill-derby-")
    path = f"{folder}/db"
    try:
        yield f"jdbc:derby:{path};create=true"
    finally:
        with suppress(Py4JJavaError):  # a shutdown is told by an error
            _connection(spark, f"jdbc:derby:{path};shutdown=true")
        shutil.rmtree(folder, ignore_errors=True)


def in_driver(url: str) -> bool:
    """Whether the database runs in the process that opens it first, so that executors would each open another."""
    return url.startswith("jdbc:derby:") and not url.startswith("jdbc:derby://")


def _connection(spark: SparkSession, url: str):
    spark._jvm.java.lang.Class.forName(DERBY)
    return spark._jvm.java.sql.DriverManager.getConnection(url)


def execute(spark: SparkSession, url: str, *statements: str) -> int:
    """Run statements in one transaction; returns the last one's update count."""
    with closing(_connection(spark, url)) as c:
        c.setAutoCommit(False)
        count = 0
        with closing(c.createStatement()) as s:
            for x in statements:
                count = s.executeUpdate(x)
        c.commit()
        return count


def insert(spark: SparkSession, url: str, statement: str, rows: Sequence[Sequence]) -> None:
    """A prepared statement over all ``rows``, in one batch."""
    with closing(_connection(spark, url)) as c:
        c.setAutoCommit(False)
        with closing(c.prepareStatement(statement)) as s:
            for row in rows:
                for k, x in enumerate(row, 1):
                    s.setObject(k, x)
                s.addBatch()
            s.executeBatch()
        c.commit()


def _field(x) -> str:
    return "" if x is None else '"' + str(x).replace('"', '""') + '"'


def load(spark: SparkSession, url: str, table: str, rows: Iterable[Sequence]) -> None:
    """All ``rows`` by the driver into a Derby table, in place of what it held."""
    at, path = tempfile.mkstemp(prefix="tidemill-", suffix=".csv")
    try:
        with open(at, "w", encoding="utf-8", newline="") as f:
            f.writelines(",".join(map(_field, row)) + "\n" for row in rows)
        execute(spark, url, f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{table.upper()}', '{path}', ',', '\"', 'UTF-8', 1)")
    finally:
        os.unlink(path)


def has_table(spark: SparkSession, url: str, table: str) -> bool:
    with closing(_connection(spark, url)) as c:
        return c.getMetaData().getTables(None, None, table.upper(), None).next()


def read(spark: SparkSession, url: str, table: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, driver=DERBY).load()


def read_through(spark: SparkSession, url: str, table: str, folder: str) -> DataFrame:
    """A table as ``read`` has it, from any process: one that only the driver can open goes through files below ``folder``."""
    df = read(spark, url, table)
    if not in_driver(url):
        return df
    jvm, shape = spark._jvm, df._jdf.schema()
    df.limit(0).write.parquet(folder)
    with closing(_connection(spark, url)) as c, closing(c.createStatement()) as s, closing(s.executeQuery(f"SELECT * FROM {table}")) as found:
        parts = jvm.org.apache.spark.sql.execution.datasources.jdbc.JdbcUtils.resultSetToRows(found, shape).grouped(PART_ROWS)
        while parts.hasNext():
            rows = jvm.scala.jdk.javaapi.CollectionConverters.asJava(parts.next())
            DataFrame(spark._jsparkSession.createDataFrame(rows, shape), spark).write.mode("append").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def lines(df: DataFrame) -> list[str]:
    """Rows of a small result for printing."""
    return [", ".join(str(x) for x in row) for row in df.collect()]


class Periodically(threading.Thread):
    """Run ``action`` every ``interval_s`` until stopped: polling readers, mutating writers."""

    def __init__(self, action: Callable[[], None], interval_s: float):
        super().__init__(daemon=True)
        self.action, self.interval_s, self.over = action, interval_s, threading.Event()

    def run(self) -> None:
        while not self.over.wait(self.interval_s):
            self.action()

    def stop(self) -> None:
        self.over.set()
        self.join()


def updater(spark: SparkSession, url: str, statement: str, params: Callable[[random.Random], Sequence], interval_s: float) -> Periodically:
    """A thread that updates with repeatable random parameters."""
    rng = random.Random(1234)
    return Periodically(lambda: insert(spark, url, statement, [params(rng)]), interval_s)
