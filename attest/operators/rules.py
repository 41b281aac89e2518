"""Rules of tables, declared as data and checked in one pass a table and one join or sum a key.

A rule is (table, name, kind, how). Kinds on a row: ``check`` (an SQL condition that must not be false; null passes, as
in databases), ``among`` (column, values), ``before`` (a column that must be less than another), ``implies`` (two
conditions), ``both`` (two conditions that hold together or not at all), ``one_of`` (columns of which exactly one is
given) and ``between`` (column, least, most). Kinds on a table: ``unique`` (columns) and ``refers`` (column, table,
column). Compiled: all row rules of a table are one projection, each unique key one sum, each reference one anti join.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW_KINDS = ("check", "among", "before", "implies", "both", "one_of", "between")


def _holds(kind: str, how: tuple) -> Column:
    """Whether a row keeps a rule; null where that can't be said."""
    if kind == "check":
        return F.expr(how[0])
    if kind == "among":
        return F.col(how[0]).isin(list(how[1]))
    if kind == "before":
        return F.col(how[0]) < F.col(how[1])
    if kind == "implies":
        return ~F.coalesce(F.expr(how[0]), F.lit(False)) | F.coalesce(F.expr(how[1]), F.lit(False))
    if kind == "both":
        return F.coalesce(F.expr(how[0]), F.lit(False)) == F.coalesce(F.expr(how[1]), F.lit(False))
    if kind == "one_of":
        return sum((F.col(c).isNotNull().cast("int") for c in how), F.lit(0)) == 1
    if kind == "between":
        return F.col(how[0]).between(how[1], how[2])
    raise ValueError(f"no such kind of rule: {kind}")


def broken(tables: dict[str, DataFrame], keys: dict[str, str], rules: list[tuple]) -> DataFrame:
    """(table_name, rule, row_key): a row for each rule that a row breaks, each key that is not unique, each reference without a target.

    tables: by name; keys: the column of each that names a row. Rules of tables that are not there are left out.
    """
    out = []
    for name, df in tables.items():
        own = [r for r in rules if r[0] == name and r[2] in ROW_KINDS]
        if own:
            found = F.array_compact(F.array(*(F.when(~_holds(kind, how), F.lit(rule)) for _, rule, kind, how in own)))
            out.append(df.select(F.lit(name).alias("table_name"), F.explode(found).alias("rule"), F.col(keys[name]).cast("string").alias("row_key")))
    for name, rule, kind, how in rules:
        if name not in tables or kind in ROW_KINDS:
            continue
        df = tables[name]
        if kind == "unique":
            again = df.dropna(subset=list(how)).groupBy(*how).count().filter("count > 1")
            out.append(again.select(F.lit(name).alias("table_name"), F.lit(rule).alias("rule"), F.concat_ws("|", *(F.col(c).cast("string") for c in how)).alias("row_key")))
        elif kind == "refers" and how[1] in tables:
            column, to, target = how
            lost = df.filter(F.col(column).isNotNull()).join(tables[to].select(F.col(target).alias(column)).distinct(), column, "left_anti")
            out.append(lost.select(F.lit(name).alias("table_name"), F.lit(rule).alias("rule"), F.col(keys[name]).cast("string").alias("row_key")))
    return reduce(DataFrame.unionByName, out)


def audit(tables: dict[str, DataFrame], keys: dict[str, str], rules: list[tuple]) -> DataFrame:
    """(table_name, rule, n_broken) of every rule, zeros too."""
    spark = next(iter(tables.values())).sparkSession
    every = spark.createDataFrame([(r[0], r[1]) for r in rules if r[0] in tables and (r[2] != "refers" or r[3][1] in tables)], "table_name string, rule string")
    n = broken(tables, keys, rules).groupBy("table_name", "rule").agg(F.count("*").alias("n_broken"))
    return every.join(n, ["table_name", "rule"], "left").select("table_name", "rule", F.coalesce("n_broken", F.lit(0)).alias("n_broken"))
