"""Wide population sheets -> long (departamento, anio, total, hombres, mujeres)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regstat import config as cfg
from regstat.functions import columns as C

# Region code of a department: two digits then four zeros; 000000 is the
# national total.
DEPARTMENT_CODE = "^[0-9]{2}0000$"
NATIONAL_CODE = "000000"


def read_population(sheets: dict, params: cfg.Params = cfg.SOURCE) -> DataFrame:
    """Unpivot every sheet and union them.

    ``sheets`` maps a sheet name to ``(df, (y1, y2, y3))`` where ``df`` has
    positional columns ``c0`` (code), ``c1`` (name) and ``c2..c10`` holding
    total / men / women for each of the three years (base column 2 + 3i).
    Cells are read leniently (non-numbers count as 0); rows of years outside
    the range or with total <= 0 are dropped.
    """
    parts = []
    for _, (df, years) in sheets.items():
        code = F.trim(F.col("c0").cast("string"))
        args = []
        for i, y in enumerate(years):
            base = 2 + 3 * i
            args += [F.lit(int(y))] + [C.lenient_number(F.col(f"c{base + j}")) for j in range(3)]
        long = (df.where(code.rlike(DEPARTMENT_CODE) & (code != NATIONAL_CODE))
                .select(F.upper(C.js_trim(F.col("c1").cast("string"))).alias("departamento"),
                        F.inline(F.array(*[
                            F.struct(args[4 * i].alias("anio"), args[4 * i + 1].alias("total"),
                                     args[4 * i + 2].alias("hombres"), args[4 * i + 3].alias("mujeres"))
                            for i in range(len(years))]))))
        parts.append(long)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return (out.where(F.col("anio").between(params.first_year, params.last_year)
                      & (F.col("total") > 0))
            .select("departamento", F.col("anio").cast("int").alias("anio"),
                    F.col("total").cast("bigint").alias("total"),
                    F.col("hombres").cast("bigint").alias("hombres"),
                    F.col("mujeres").cast("bigint").alias("mujeres")))


def population_for_code(sheets: dict, code: str) -> DataFrame:
    """C12 point lookup: every (year, total, men, women) of one region code
    (the regional report's form; absent years stay absent)."""
    parts = []
    for _, (df, years) in sheets.items():
        args = []
        for i, y in enumerate(years):
            base = 2 + 3 * i
            args.append(F.struct(F.lit(int(y)).alias("anio"),
                                 *[C.lenient_number(F.col(f"c{base + j}")).cast("bigint").alias(n)
                                   for j, n in enumerate(("total", "hombres", "mujeres"))]))
        parts.append(df.where(F.trim(F.col("c0").cast("string")) == code)
                     .select(F.inline(F.array(*args))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
