"""Access databases, through a JDBC driver that the caller supplies or the export tools of the system, and the relationships that they declare."""

from __future__ import annotations

import shutil
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.links import Link
from ..operators.review import declared_link
from ..store import new_path

DRIVER = "net.ucanaccess.jdbc.UcanaccessDriver"
#: The programs that list an Access file's tables and write one of them as CSV.
LISTER, EXPORTER = "mdb-tables", "mdb-export"
HIDDEN = ("MSys", "USys", "~")


def read_access(spark: SparkSession, path: str, driver: str = DRIVER, **_) -> tuple[dict[str, DataFrame], list[Link], list[str]]:
    """All user tables and declared relationships. A table that can't be read is said and left out.

    Without the JDBC driver the tables come through the system's export programs, if it has these.
    """
    url = f"jdbc:ucanaccess://{path.removeprefix('file://')};showSchema=true;sysSchema=true"
    source = spark.read.format("jdbc").option("url", url).option("driver", driver)
    try:
        names = [r[0] for r in source.option("query", "SELECT TABLE_NAME FROM INFORMATION_SCHEMA.TABLES WHERE TABLE_TYPE = 'BASE TABLE'").load().collect()]
        table = lambda n: source.option("dbtable", f"[{n}]").load()
        relations = lambda: source.option("dbtable", "[sys].[MSysRelationships]").load()
    except Exception:
        if not (shutil.which(LISTER) and shutil.which(EXPORTER)):
            raise
        place = path.removeprefix("file://")
        names = _ask(LISTER, "-1", place).decode().splitlines()
        table = lambda n: _exported(spark, place, n)
        relations = lambda: _exported(spark, place, "MSysRelationships")
    tables, notices, links = {}, [], []
    for n in names:
        if not n or n.startswith(HIDDEN):
            continue
        try:
            tables[n] = table(n)
        except Exception as e:
            notices.append(f"table {n}: {str(e).splitlines()[0][:200]}")
    try:
        links = access_links(relations())
    except Exception:
        notices.append("no relationships were read from the file itself; links come from the data alone")
    return tables, links, notices


def _ask(*command: str) -> bytes:
    return subprocess.run(command, capture_output=True, check=True, timeout=600).stdout


def _exported(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table as the export program writes it, by way of a file in the shared folder."""
    from .files import read_delimited

    place = new_path(spark, "access") + ".csv"
    file = spark._jvm.org.apache.hadoop.fs.Path(place)
    out = file.getFileSystem(spark._jsc.hadoopConfiguration()).create(file)
    out.write(_ask(EXPORTER, "-D", "%Y-%m-%d", "-T", "%Y-%m-%d %H:%M:%S", path, name))
    out.close()
    return read_delimited(spark, place)


def access_links(rows: DataFrame) -> list[Link]:
    """Links from rows of MSysRelationships: bit 1 of grbit is one to one, bit 2 not enforced."""
    bits = F.coalesce(F.col("grbit").cast("int"), F.lit(0))
    some = rows.where(~F.col("szObject").startswith("MSys") & ~F.col("szReferencedObject").startswith("MSys"))
    some = some.select("szObject", "szColumn", "szReferencedObject", "szReferencedColumn", (bits.bitwiseAND(1) != 0).alias("one"), (bits.bitwiseAND(2) == 0).alias("enforced"))
    why = {True: "Access relationship with referential integrity", False: "Access relationship without referential integrity"}
    return [declared_link(*r[:4], origin="access", reason=why[r.enforced], one_to_one=r.one) for r in some.collect()]
