"""Loading the six tables into a database: typed tables with keys and references, all or nothing.

Partitions are written side by side, in batches, into staging tables that have types and no constraints.  When all are in, one transaction drops the old tables, children first, gives the
staging tables their names, parents first, and adds keys and references; rows that break one of them leave everything as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.promptdb import LOAD_ORDER

#: Keys of the tables, and what they refer to: column -> (table, column).
KEYS = {
    "prompt_templates": ("template_hash",),
    "label_taxonomy": ("raw_label",),
    "situations": ("situation_id",),
    "situation_positions": ("situation_id", "position"),
    "situation_actions": ("situation_id", "seq_index"),
    "situation_available_moves": ("situation_id", "move"),
}
REFERENCES = {
    "situations": {"template_hash": ("prompt_templates", "template_hash")},
    "situation_positions": {"situation_id": ("situations", "situation_id")},
    "situation_actions": {"situation_id": ("situations", "situation_id")},
    "situation_available_moves": {"situation_id": ("situations", "situation_id")},
}
#: Characters of a text column that is part of a key.
KEY_TEXT = 512
STAGING = "_staging"

#: How databases differ: types, and the statements that rename a table and say that its figures are to be gathered.
DIALECTS = {
    "postgresql": {"string": "TEXT", "double": "DOUBLE PRECISION", "rename": 'ALTER TABLE "{old}" RENAME TO "{new}"', "analyze": 'ANALYZE "{name}"'},
    "derby": {"string": "CLOB", "double": "DOUBLE", "rename": 'RENAME TABLE "{old}" TO "{new}"', "analyze": None},
}


def _type(field: T.StructField, key: bool, dialect: dict) -> str:
    kinds = {T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.ShortType: "SMALLINT", T.ByteType: "SMALLINT", T.BooleanType: "BOOLEAN", T.FloatType: "REAL", T.DoubleType: dialect["double"]}
    if isinstance(field.dataType, T.StringType):
        return f"VARCHAR({KEY_TEXT})" if key else dialect["string"]
    if type(field.dataType) not in kinds:
        raise ValueError(f"column {field.name}: no type for {field.dataType.simpleString()}")
    return kinds[type(field.dataType)]


def create(name: str, schema: T.StructType, dialect: str = "postgresql", to: str | None = None) -> str:
    """CREATE TABLE of a table's schema, without its constraints; key columns are not null."""
    keys, short = KEYS.get(name, ()), {*KEYS.get(name, ()), *REFERENCES.get(name, {})}
    columns = ", ".join(f'"{f.name}" {_type(f, f.name in short, DIALECTS[dialect])}{" NOT NULL" if f.name in keys else ""}' for f in schema)
    return f'CREATE TABLE "{to or name}" ({columns})'


def constraints(name: str) -> list[str]:
    """Statements that add the key and the references of a table."""
    quoted = lambda cs: ", ".join(f'"{c}"' for c in cs)
    out = [f'ALTER TABLE "{name}" ADD PRIMARY KEY ({quoted(KEYS[name])})']
    return out + [f'ALTER TABLE "{name}" ADD FOREIGN KEY ("{c}") REFERENCES "{table}" ("{of}")' for c, (table, of) in REFERENCES.get(name, {}).items()]


def ddl(tables: dict[str, DataFrame], dialect: str = "postgresql") -> str:
    """The whole schema: tables, keys and references, in loading order."""
    made = [s for name in LOAD_ORDER for s in (create(name, loadable(tables[name]).schema, dialect), *constraints(name))]
    return "\n".join(f"{s};" for s in made)


def loadable(df: DataFrame) -> DataFrame:
    """Flags, kept as 0 and 1, as booleans."""
    flags = [f.name for f in df.schema if f.name.startswith(("hero_is_", "is_")) and not isinstance(f.dataType, T.BooleanType)]
    return df.withColumns({c: F.col(c) == 1 for c in flags})


class _Connection:
    """A JDBC connection of the driver, for statements."""

    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str]):
        about = spark._jvm.java.util.Properties()
        for k, v in properties.items():
            about.setProperty(k, v)
        self.java = spark._jvm.java.sql.DriverManager.getConnection(url, about)
        self.java.setAutoCommit(False)

    def __enter__(self):
        return self

    def __exit__(self, kind, value, trace):
        try:
            (self.java.commit if kind is None else self.java.rollback)()
        finally:
            self.java.close()

    def run(self, *statements: str) -> None:
        for text in statements:
            statement = self.java.createStatement()
            try:
                statement.execute(text)
            finally:
                statement.close()

    def names(self) -> set[str]:
        found = self.java.getMetaData().getTables(None, None, "%", None)
        out = set()
        while found.next():
            out.add(found.getString("TABLE_NAME"))
        found.close()
        return out


def load(tables: dict[str, DataFrame], url: str, properties: dict[str, str] | None = None, dialect: str | None = None, batch: int = 10_000) -> dict[str, int]:
    """Replace the six tables in a database and return the rows of each; on any failure what was there before stays."""
    properties = properties or {}
    dialect = dialect or url.split(":")[1]
    if dialect not in DIALECTS:
        raise ValueError(f"no dialect {dialect!r}; one of {sorted(DIALECTS)}")
    if missing := [n for n in LOAD_ORDER if n not in tables]:
        raise ValueError(f"missing tables: {missing}")
    rows = {name: loadable(tables[name]) for name in LOAD_ORDER}
    spark = rows[LOAD_ORDER[0]].sparkSession
    how = DIALECTS[dialect]
    with _Connection(spark, url, properties) as db:
        there = db.names()
        db.run(*[f'DROP TABLE "{n}{STAGING}"' for n in LOAD_ORDER if f"{n}{STAGING}" in there])
        db.run(*[create(n, rows[n].schema, dialect, f"{n}{STAGING}") for n in LOAD_ORDER])
    for name, df in rows.items():
        df.write.mode("append").option("batchsize", batch).jdbc(url, f'"{name}{STAGING}"', properties=properties)
    counts = {name: spark.read.jdbc(url, f'"{name}{STAGING}"', properties=properties).count() for name in LOAD_ORDER}
    with _Connection(spark, url, properties) as db:
        there = db.names()
        db.run(*[f'DROP TABLE "{n}"' for n in reversed(LOAD_ORDER) if n in there])
        for name in LOAD_ORDER:
            db.run(how["rename"].format(old=f"{name}{STAGING}", new=name), *constraints(name))
        if how["analyze"]:
            db.run(*[how["analyze"].format(name=n) for n in LOAD_ORDER])
    return counts
