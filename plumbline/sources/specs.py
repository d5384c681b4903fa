"""Source specs: where tables live and how Spark reads them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

FILE_KINDS = ("parquet", "orc", "csv", "json")
# Default ports of the network dialects.
DEFAULT_PORTS = {"postgresql": 5432, "mysql": 3306}


@dataclass(frozen=True)
class Source:
    """A named source: a folder of files, the session catalog or a database over JDBC."""

    name: str
    kind: str = "parquet"
    path: str | None = None
    url: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)
    tables: tuple[str, ...] = ()
    partitioning: Mapping[str, Mapping[str, object]] = field(default_factory=dict)
    description: str = ""


def jdbc_url(dialect: str, spec: Mapping[str, object]) -> str:
    """JDBC URL of a dialect; anything but sqlite, postgresql and mysql passes ``url`` through."""
    if dialect == "sqlite":
        return f"jdbc:sqlite:{spec['path']}"
    if dialect in DEFAULT_PORTS:
        port = spec.get("port") or DEFAULT_PORTS[dialect]
        return f"jdbc:{dialect}://{spec['host']}:{port}/{spec['database']}"
    if spec.get("url"):
        return str(spec["url"])
    raise ValueError(f"dialect {dialect!r} needs a url")


def from_mapping(spec: Mapping[str, object]) -> Source:
    """Source from one entry of a sources file."""
    kind = str(spec.get("dialect", spec.get("kind", "parquet")))
    common = {
        "name": str(spec["name"]),
        "description": str(spec.get("description", "")),
        "tables": tuple(spec.get("tables", ())),
    }
    if kind in FILE_KINDS or kind == "catalog":
        return Source(kind=kind, path=spec.get("path"), options=dict(spec.get("options", {})), **common)
    options = {k: str(spec[k]) for k in ("user", "password", "driver", "fetchsize") if k in spec}
    return Source(
        kind="jdbc",
        url=jdbc_url(kind, spec),
        options=options,
        partitioning=dict(spec.get("partitioning", {})),
        **common,
    )


def load_sources(path: str) -> list[Source]:
    """Sources listed under ``sources:`` of a YAML file."""
    import yaml

    with open(path) as f:
        return [from_mapping(s) for s in (yaml.safe_load(f) or {}).get("sources", [])]


def jdbc_options(source: Source, table: str) -> dict[str, str]:
    """Reader options; a partitioned table is read by ``numPartitions`` tasks over key ranges."""
    split = source.partitioning.get(table, {})
    needed = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")
    if split and any(k not in split for k in needed):
        raise ValueError(f"partitioning of {table} needs {', '.join(needed)}")
    return {
        "url": source.url,
        "dbtable": table,
        **source.options,
        **{k: str(v) for k, v in split.items()},
    }


# The schema whose tables need no qualified name.
DEFAULT_SCHEMAS = {"postgresql": "public"}


def _jdbc_catalogue(url: str) -> tuple[str, str, str]:
    """Where a database lists its tables: catalogue table, name expression, row condition.

    Names carry their schema, but for the default one, so equal names of two schemas stay two tables. A
    MySQL schema is the database of the URL, others are not listed.
    """
    if url.startswith("jdbc:sqlite:"):
        return "sqlite_master", "name", "type = 'table' AND NOT startswith(name, 'sqlite_')"
    if url.startswith("jdbc:mysql:"):
        database = url.split("?")[0].rstrip("/").rsplit("/", 1)[-1]
        return "information_schema.tables", "table_name", f"table_schema = '{database}'"
    default = DEFAULT_SCHEMAS.get(url.split(":")[1], "")
    name = f"CASE WHEN table_schema = '{default}' THEN table_name ELSE concat(table_schema, '.', table_name) END"
    return "information_schema.tables", name, "lower(table_schema) NOT IN ('information_schema', 'pg_catalog', 'sys')"


def list_tables(spark: SparkSession, source: Source) -> list[str]:
    """Table names of a source: the catalog, the entries of its folder or the names it lists."""
    if source.tables:
        return sorted(source.tables)
    if source.kind == "catalog":
        return sorted(t.name for t in spark.catalog.listTables(source.path))
    if source.kind == "jdbc":
        table, name, condition = _jdbc_catalogue(source.url)
        rows = spark.read.format("jdbc").options(**jdbc_options(source, table)).load().filter(condition)
        return sorted(r[0] for r in rows.selectExpr(name).distinct().collect())  # names only
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(source.path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    entries = [s.getPath().getName() for s in fs.listStatus(jvm_path)]
    suffix = f".{source.kind}"
    # names with _ or . in front are markers and logs of writers, not tables
    return sorted(e.removesuffix(suffix) for e in entries if e[0] not in "_." and (e.endswith(suffix) or "." not in e))


def read_table(spark: SparkSession, source: Source, table: str) -> DataFrame:
    if source.kind == "catalog":
        return spark.table(f"{source.path}.{table}" if source.path else table)
    if source.kind == "jdbc":
        return spark.read.format("jdbc").options(**jdbc_options(source, table)).load()
    if source.kind not in FILE_KINDS:
        raise ValueError(f"unknown source kind {source.kind!r}")
    reader = spark.read.options(**source.options)
    if source.kind == "csv" and "header" not in source.options:
        reader = reader.option("header", True)
    base = source.path.rstrip("/")
    try:
        return reader.format(source.kind).load(f"{base}/{table}.{source.kind}")
    except PySparkException:
        return reader.format(source.kind).load(f"{base}/{table}")


def columns_of(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


@dataclass
class Scan:
    """Tables that could be opened, and what went wrong with the others."""

    tables: list[tuple[str, str, DataFrame]]
    errors: list[tuple[str, str | None, str]]


def scan_sources(spark: SparkSession, sources: Iterable[Source]) -> Scan:
    """Open every table of every source; one that fails does not stop the rest."""
    scan = Scan([], [])
    for source in sources:
        try:
            names = list_tables(spark, source)
        except Exception as e:  # a driver may raise anything; the source is reported and skipped
            scan.errors.append((source.name, None, str(e).splitlines()[0]))
            continue
        for name in names:
            try:
                scan.tables.append((source.name, name, read_table(spark, source, name)))
            except Exception as e:
                scan.errors.append((source.name, name, str(e).splitlines()[0]))
    return scan

