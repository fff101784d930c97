"""Small tables and plan access for the tests."""

from datetime import datetime

from reelbook.schemas import ENTITIES


def table(spark, entity, rows):
    """A catalogue table from dicts; absent columns are null."""
    schema = ENTITIES[entity]
    return spark.createDataFrame([tuple(r.get(c) for c in schema.fieldNames()) for r in rows], schema)


def ts(text):
    return datetime.fromisoformat(text)


def rows(df, *columns):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def plan(df):
    """Physical plan before execution."""
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    """Physical plan after execution."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
