"""Hand-written edge rows for the registry cleaning in both modes."""

from pyspark.sql import functions as F

from regstat import config as cfg
from regstat.functions import columns as C
from regstat.operators import clean as CL
from regstat.sources.registry import REGISTRY_COLUMNS, read_registry


def raw_rows(spark, rows):
    """rows: dicts with some registry columns; the rest are empty strings."""
    full = [tuple(r.get(c, "") for c in REGISTRY_COLUMNS) for r in rows]
    return spark.createDataFrame(full, ", ".join(f"{c} string" for c in REGISTRY_COLUMNS))


def one(df, col):
    return [r[col] for r in df.collect()]


def test_period_guard_both_modes(spark):
    dates = ["20221", "20221301", "20211201", "ABCDEFGH", "20230415", ' "20240105"']
    raw = raw_rows(spark, [{"FEC_FILIACION": d, "HISTORIA": str(i)} for i, d in enumerate(dates)])
    nat = CL.limpiar_nacional(raw, cfg.SOURCE).orderBy(F.col("fecha")).collect()
    by_date = {r["fecha"]: r for r in nat}
    assert not by_date["20221"]["valido"]
    assert not by_date["20221301"]["valido"]
    assert not by_date["20211201"]["valido"]
    assert not by_date["ABCDEFGH"]["valido"]
    assert by_date["20230415"]["valido"] and by_date["20230415"]["mes"] == 4
    assert by_date["20240105"]["valido"]
    reg = {r["HISTORIA"]: r for r in CL.comparar_modos(raw, [], ["incluido", "mes"], cfg.SOURCE)
           .withColumnRenamed("historia", "HISTORIA").collect()}
    assert reg["1"]["incluido_regional"] and reg["1"]["mes_regional"] == 13   # month not validated
    assert not reg["2"]["incluido_regional"]                                 # 2021 not in list
    assert not reg["0"]["incluido_regional"] and not reg["3"]["incluido_regional"]


def test_sex_cleaning(spark):
    raw = raw_rows(spark, [{"SEXO": ' "femenino" '}, {"SEXO": '" femenino "'}, {"SEXO": "X"},
                           {"SEXO": "masculino"}])
    out = CL.comparar_modos(raw, ["sexo"], ["sexo"], cfg.SOURCE).collect()
    assert [r["sexo"] for r in out] == ["FEMENINO", cfg.UNKNOWN, cfg.UNKNOWN, "MASCULINO"]
    assert [r["sexo_regional"] for r in out] == ["FEMENINO", None, None, "MASCULINO"]


def test_ages_and_bands(spark):
    ages = ["20", "21", "80", "81", "-1", "45.7", "12abc", "", "　 33", "0x1A"]
    raw = raw_rows(spark, [{"EDAD": a} for a in ages])
    out = CL.comparar_modos(raw, ["edad", "grupo_etario"], ["grupo_etario"], cfg.SOURCE).collect()
    assert [r["edad"] for r in out] == [20, 21, 80, 81, -1, 45, 12, None, 33, 0]
    assert [r["grupo_etario"] for r in out] == [
        "0-20", "21-30", "71-80", "81+", "0-20", "41-50", "0-20", cfg.UNKNOWN, "31-40", "0-20"]
    assert out[7]["grupo_etario_regional"] == cfg.UNKNOWN_BAND_REGIONAL


def test_place_split(spark):
    places = ["AYACUCHO", "AYACUCHO--X", "LIMA-LIMA-AYACUCHO", " ayacucho-huamanga-ayna ",
              "AYACUCHO-  -X", ""]
    raw = raw_rows(spark, [{"LUGAR_RESIDENCIA": p} for p in places])
    out = CL.comparar_modos(raw, ["departamento", "provincia", "distrito"], ["provincia"],
                            cfg.SOURCE).collect()
    assert [(r["departamento"], r["provincia"], r["distrito"]) for r in out] == [
        ("AYACUCHO", cfg.UNKNOWN, ""), ("AYACUCHO", cfg.UNKNOWN, "X"), ("LIMA", "LIMA", "AYACUCHO"),
        ("AYACUCHO", "HUAMANGA", "AYNA"), ("AYACUCHO", "", "X"), (cfg.UNKNOWN, cfg.UNKNOWN, "")]
    assert [r["provincia_regional"] for r in out] == [
        cfg.UNKNOWN_PROVINCE_REGIONAL, "", "LIMA", "huamanga", "", cfg.UNKNOWN_PROVINCE_REGIONAL]


def test_contains_filter_any_level(spark):
    raw = raw_rows(spark, [{"LUGAR_RESIDENCIA": "LIMA-LIMA-AYACUCHO", "FEC_FILIACION": "20230101"},
                           {"LUGAR_RESIDENCIA": "lima-lima-lima", "FEC_FILIACION": "20230101"},
                           {"FEC_FILIACION": "20230101"}])
    gaz = spark.createDataFrame([("AYACUCHO", 0), ("LIMA", 1)], "nombre string, orden int")
    hits = CL.asignar_regiones(CL.limpiar_regional(raw, cfg.SOURCE), gaz)
    got = sorted(r["departamento"] for r in hits.collect())
    assert got == ["AYACUCHO", "LIMA", "LIMA"]  # null place matches nothing


def test_js_trim_and_lenient_numbers(spark):
    df = spark.createDataFrame([("\t a  ",), ('"x"',), (None,)], "s string")
    out = df.select(C.clean_text("s").alias("c"), C.lenient_int(F.lit(" +7 ")).alias("i")).collect()
    assert [r["c"] for r in out] == ["a", "x", ""]
    assert out[0]["i"] == 7
    nums = spark.createDataFrame([("12",), ("x",), ("1.5e3",), ("",)], "s string")
    assert [r[0] for r in nums.select(C.lenient_number("s")).collect()] == [12.0, 0.0, 1500.0, 0.0]


def test_latin1_csv_reader(spark, scratch_dir):
    import os
    path = os.path.join(scratch_dir, "reg.csv")
    header = ",".join(f'"{c}"' if c == "SEXO" else f" {c}" for c in REGISTRY_COLUMNS)
    line = ",".join(["u1", "h", "20230105", "FEMENINO", "44", "020101", "ÁNCASH-HUARAZ-Ñ", "3", "x"])
    with open(path, "wb") as fh:
        fh.write((header + "\n\n" + line + "\n\n").encode("latin-1"))
    df = read_registry(spark, path)
    assert df.columns == list(REGISTRY_COLUMNS)
    rows = df.collect()
    assert len(rows) == 1
    assert rows[0]["LUGAR_RESIDENCIA"] == "ÁNCASH-HUARAZ-Ñ"
    nat = CL.limpiar_nacional(df, cfg.SOURCE).collect()[0]
    assert (nat["departamento"], nat["provincia"], nat["distrito"]) == ("ÁNCASH", "HUARAZ", "Ñ")


def test_numbers_by_grammar(spark):
    from regstat.functions.columns import lenient_number
    cells = ["12", " 3.5 ", "1e3", "-2", ".5", "7.", "NaN", "Infinity", "-inf", "1d", "2f", "0x10", "", None, "1 2", "-", "1e400"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = [r["v"] for r in df.select("i", lenient_number("c").alias("v")).orderBy("i").collect()]
    assert got == [12.0, 3.5, 1000.0, -2.0, 0.5, 7.0] + [0.0] * 11


def test_registry_by_header_name_and_quotes(spark, scratch_dir):
    from regstat.sources.registry import read_registry
    path = f"{scratch_dir}/r.csv"
    with open(path, "w", encoding="latin-1") as f:
        f.write('B, "A" ,C\n2,"x ""y"", z",ñ\n4,end\\,5\n\n')
    rows = read_registry(spark, path, header_names=["A", "B"]).collect()
    assert [tuple(r) for r in rows] == [('x "y", z', "2"), ("end\\", "4")]
    with open(f"{scratch_dir}/m.csv", "w", encoding="latin-1") as f:
        f.write('A,B\n"l1\nl2",3\n')
    assert read_registry(spark, f"{scratch_dir}/m.csv", multi_line=True).collect()[0]["A"] == "l1\nl2"


def test_texts_that_need_no_trim_skip_the_searches(spark):
    """The searches of the white-space set and of the quote are the last
    branches of a choice, and the choice changes no text."""
    ends = ["", *C.JS_SPACE_CHARS, *"!~a9\"-", "\x00", "\x1f", "\x7f", "\x85", "\xa1", "\xff", " x　", "é", "\U0001f600"]
    texts = [None, *dict.fromkeys(a + m + b for a in ends for m in ("", "5", 'a "b" c', "-12") for b in ends)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    spaces = F.lit(C.JS_SPACE_CHARS)
    trimmed = F.btrim("t", spaces)
    cleaned = F.replace(F.btrim(F.coalesce("t", F.lit("")), spaces), F.lit('"'), F.lit(""))
    number = F.coalesce(
        F.when((F.ascii("t") > 32) & (F.ascii(F.right("t", F.lit(1))) > 32), F.col("t").try_cast("int")),
        F.regexp_extract("t", C.INT_PREFIX_PATTERN, 1).try_cast("int"))
    pairs = [(C.js_trim("t"), trimmed), (C.clean_text("t"), cleaned), (C.clean_text("t", upper=True), F.upper(cleaned)),
             (C.lenient_int("t"), number)]
    for got, want in pairs:
        assert df.where(~got.eqNullSafe(want)).collect() == []
    plan = df.select(C.clean_text("t").alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "ELSE trim(" in plan and 'THEN replace(' in plan and 'Contains(' in plan
