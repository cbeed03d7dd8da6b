"""Registry cleaning in the two modes of the source.

*National* mode feeds the star schema: year range and month are validated,
unknown sex and band become ``DESCONOCIDO``, the department is the first
part of the place text. *Regional* mode feeds the regional report: only a
fixed list of year strings is kept, the month is not validated, unknown
sex is dropped from the sex counts, the band is ``desconocido`` and the
province is kept as written. Both are projections (no shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regstat import config as cfg
from regstat.functions import columns as C


def _parts(text=None):
    return F.split(C.clean_text("LUGAR_RESIDENCIA") if text is None else text, "-", -1)


_TEXTOS = ("UUID", "FEC_FILIACION", "SEXO", "EDAD", "UBIGEO_LUGAR_RESIDENCIA", "LUGAR_RESIDENCIA", "CANT_ATENCIONES_CEX")


def _textos() -> dict:
    """The cleaned text of every column of the raw row that is used."""
    return {c: C.clean_text(c) for c in _TEXTOS}


def _piezas(t: dict) -> dict:
    """Parts of the cleaned texts that are read several times."""
    return {"_anio_txt": F.substring(t["FEC_FILIACION"], 1, 4), "_mes_txt": F.substring(t["FEC_FILIACION"], 5, 2),
            "_sexo": F.upper(t["SEXO"]), "_partes": _parts(t["LUGAR_RESIDENCIA"])}


def _numeros(t: dict) -> dict:
    """Numbers from the texts and their parts."""
    return {"_anio": C.lenient_int(t["_anio_txt"]), "_mes": C.lenient_int(t["_mes_txt"]), "_edad": C.lenient_int(t["EDAD"])}


def _nacional(t: dict, params: cfg.Params, hash_id: bool) -> dict:
    fec, uuid, anio, mes, sexo, edad = (t[c] for c in ("FEC_FILIACION", "UUID", "_anio", "_mes", "_sexo", "_edad"))
    uuid_out = F.sha2(uuid, 256) if hash_id else F.substring(uuid, 1, 16)
    valido = F.coalesce((F.length(fec) >= 6) & anio.between(params.first_year, params.last_year)
                        & mes.between(1, 12), F.lit(False))

    def part(i, default):
        return F.upper(C.js_trim(F.coalesce(F.nullif(F.get(t["_partes"], i), F.lit("")), F.lit(default))))
    return {
        "uuid_hash": uuid_out,
        "fecha": fec, "anio": anio, "mes": mes, "valido": valido,
        "sexo": F.when(sexo.isin(*cfg.SEXES), sexo).otherwise(F.lit(cfg.UNKNOWN)),
        "edad": edad, "grupo_etario": C.age_band(edad, cfg.UNKNOWN),
        "departamento": part(0, cfg.UNKNOWN),
        "provincia": part(1, cfg.UNKNOWN),
        "distrito": part(2, ""),
        "ubigeo": t["UBIGEO_LUGAR_RESIDENCIA"],
        "cant_atenciones": C.lenient_int(t["CANT_ATENCIONES_CEX"]),
    }


def exprs_nacional(params: cfg.Params = cfg.SOURCE, hash_id: bool = False) -> dict:
    """National-mode cleaned columns (name -> expression over the raw row).

    A row is accepted (``valido``) when the cleaned date has at least 6
    characters, its leading year is within the range and its month within
    1..12; a date whose year or month is not a number is a discard.
    ``uuid_hash`` is the identifier truncated to 16 characters, as in the
    source (not a hash); ``hash_id=True`` stores SHA-256 of the whole
    identifier instead.
    """
    t = _textos()
    for step in (_piezas, _numeros):
        t |= step(t)
    return _nacional(t, params, hash_id)


def limpiar_nacional(raw: DataFrame, params: cfg.Params = cfg.SOURCE,
                     hash_id: bool = False) -> DataFrame:
    """National-mode cleaning; the reader's ``_orden`` and ``_corrupto``, if it
    gave them, go along. The projections stand one on the other: in one alone
    the text behind a year or an age could be cleaned anew in every column and
    condition that uses it."""
    own = [c for c in ("_orden", "_corrupto") if c in raw.columns]
    df = raw.select(*[e.alias(n) for n, e in _textos().items()], *own)
    t = {n: F.col(n) for n in _TEXTOS}
    for step in (_piezas, _numeros):
        new = step(t)
        df = df.select("*", *[e.alias(n) for n, e in new.items()])
        t |= {n: F.col(n) for n in new}
    return df.select(*[e.alias(n) for n, e in _nacional(t, params, hash_id).items()], *own)


def exprs_regional(params: cfg.Params = cfg.SOURCE) -> dict:
    """Regional-mode cleaned columns. ``incluido`` is the source's period
    guard (length >= 6 and the year text among the report years); ``mes``
    is null when the month text is not a number (the source files such rows
    under "NaN")."""
    fec = C.clean_text("FEC_FILIACION")
    year_txt = F.substring(fec, 1, 4)
    sexo = C.clean_text("SEXO", upper=True)
    edad = C.lenient_int(C.clean_text("EDAD"))
    parts = _parts()
    incluido = (F.length(fec) >= 6) & year_txt.isin(*[str(y) for y in params.report_years])
    return {
        "lugar_crudo": F.col("LUGAR_RESIDENCIA"),
        "incluido": incluido,
        "anio": F.when(incluido, year_txt.cast("int")),
        "mes": C.lenient_int(F.substring(fec, 5, 2)),
        "sexo": F.when(sexo.isin(*cfg.SEXES), sexo),
        "edad": edad,
        "grupo_etario": C.age_band(edad, cfg.UNKNOWN_BAND_REGIONAL),
        "provincia": F.when(F.size(parts) >= 2, C.js_trim(F.get(parts, 1)))
                      .otherwise(F.lit(cfg.UNKNOWN_PROVINCE_REGIONAL)),
        "cant_atenciones": C.lenient_int(C.clean_text("CANT_ATENCIONES_CEX")),
    }


def limpiar_regional(raw: DataFrame, params: cfg.Params = cfg.SOURCE) -> DataFrame:
    """Regional-mode cleaning (one projection)."""
    return raw.select(*[e.alias(n) for n, e in exprs_regional(params).items()])


def comparar_modos(raw: DataFrame, national: list, regional: list,
                   params: cfg.Params = cfg.SOURCE) -> DataFrame:
    """Selected columns of both modes side by side in one projection
    (regional columns get a ``_regional`` suffix); keeps ``HISTORIA``."""
    n, r = exprs_nacional(params), exprs_regional(params)
    return raw.select(F.col("HISTORIA").alias("historia"),
                      *[n[c].alias(c) for c in national],
                      *[r[c].alias(f"{c}_regional") for c in regional])


def asignar_regiones(regional: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """F3 for every place at once: a row belongs to each gazetteer name its
    raw place text contains (case-insensitive; a null text matches none).

    Each distinct place text is matched once: a name can only be contained
    in a text that has the name's first characters (at most three) somewhere,
    which is an equi-join, whatever the number of names or texts; ``contains``
    then decides, and the matches are joined back on the text.
    """
    names = gazetteer.select(F.col("nombre").alias("departamento")).where("nombre is not null").distinct()
    text = F.upper("lugar_crudo")

    def grams(n):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - F.lit(n - 1), F.lit(1))),
                           lambda i: F.substr(text, i, F.lit(n)))

    places = regional.select("lugar_crudo").where("lugar_crudo is not null").distinct()
    keys = F.array_distinct(F.concat(F.array(F.lit("")), grams(1), grams(2), grams(3)))
    found = (places.select("lugar_crudo", F.explode(keys).alias("_k"))
             .join(names.withColumn("_k", F.left("departamento", F.lit(3))), "_k")
             .where(text.contains(F.col("departamento"))).select("lugar_crudo", "departamento"))
    return regional.join(found, "lugar_crudo")
