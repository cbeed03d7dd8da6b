"""Independent SQL (DuckDB dialect) for every key of the catalog.

Each statement reads the raw test tables (pre-registered views) and
recomputes the key from scratch, so it checks the Spark plan end to end.
Shared pieces are common-table expressions assembled by ``with_``.
"""

from __future__ import annotations

from regstat import config as cfg

P = cfg.STANDIN
# White space of a JavaScript trim, stated here on its own (the engine has its own list).
_SPACE = [9, 10, 11, 12, 13, 32, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288, 65279]


def _band(e: str, unknown: str = cfg.UNKNOWN) -> str:
    parts = [f"when {e} is null then '{unknown}'"]
    for b, label in zip(cfg.AGE_BAND_UPPER_BOUNDS, cfg.AGE_BANDS):
        parts.append(f"when {e} <= {b} then '{label}'")
    return "case " + " ".join(parts) + f" else '{cfg.AGE_BANDS[-1]}' end"


def r2(x: str, d: int) -> str:
    """C13 in SQL: floor(x * 10^d + 0.5) / 10^d (bigint when d == 0)."""
    if d == 0:
        return f"cast(floor(({x}) + 0.5::double) as bigint)"
    return f"(floor(({x}) * {10 ** d} + 0.5::double) / {10 ** d})"


def rate(cases: str, pop: str) -> str:
    return f"coalesce({r2(f'{cases} / nullif({pop}, 0) * {cfg.RATE_SCALE}', 2)}, 0::double)"


def share(part: str, total: str) -> str:
    return f"coalesce({r2(f'{part} / nullif({total}, 0) * 100', 0)}, 0::bigint)"


def js_num(x: str, d: int) -> str:
    return f"regexp_replace(printf('%.{d}f', {x}), '\\.?0+$', '')"


CTE = {}
CTE["visits"] = """visits as (
  select l_orderkey, cast(count(*) as int) cant_atenciones from lineitem group by l_orderkey)"""
_JS_CHARS = " || ".join(f"chr({c})" for c in _SPACE)


def jt(x: str) -> str:
    return f"trim({x}, {_JS_CHARS})"


def ct(x: str, upper: bool = False) -> str:
    out = f"replace({jt(f'coalesce({x}, {chr(39)}{chr(39)})')}, '\"', '')"
    return f"upper({out})" if upper else out


def li(x: str) -> str:
    d = f"regexp_extract(ltrim({x}, {_JS_CHARS}), '^([+-]?[0-9]+)', 1)"
    return f"case when {d} = '' then null else try_cast({d} as integer) end"


CTE["rawbase"] = """rawbase as (
  select o_orderkey, o_orderstatus, o_orderdate, o_orderpriority p, c_acctbal, c_mktsegment,
         n_nationkey, n_name, r_regionkey, r_name, v.cant_atenciones cant,
         day(o_orderdate) d, strftime(o_orderdate, '%Y%m%d') ymd,
         case o_orderstatus when 'F' then 'FEMENINO' when 'O' then 'MASCULINO' else 'X' end sb,
         cast(cast(floor(abs(c_acctbal) / 100) as int) as varchar) et,
         ' ' || r_name || '-' || n_name || '-' || c_mktsegment lb
  from orders join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  left join visits v on v.l_orderkey = o_orderkey)"""
CTE["raw"] = """raw as (select
  lpad(cast(o_orderkey as varchar), 12, '0') || '-' || p || '-' || lower(c_mktsegment) "UUID",
  cast(o_orderkey as varchar) "HISTORIA",
  case when d = 31 then substring(ymd, 1, 5)
       when d = 30 and p = '1-URGENT' then substring(ymd, 1, 4) || '13' || substring(ymd, 7, 2)
       when d = 29 and p = '1-URGENT' then 'ABCDEFGH'
       when d = 28 and p = '1-URGENT' then cast(year(o_orderdate) - 10 as varchar) || substring(ymd, 5, 4)
       when d = 27 and p = '1-URGENT' then ' "' || ymd || '"'
       else ymd end "FEC_FILIACION",
  case when p = '2-HIGH' then ' "' || lower(sb) || '" '
       when p = '3-MEDIUM' and d <= 3 then '" ' || lower(sb) || ' "' else sb end "SEXO",
  case when d = 1 then et || '.7' when d = 2 then et || 'abc'
       when d = 3 and p = '5-LOW' then '' when d = 4 and p = '5-LOW' then '-1'
       when d = 5 and p = '5-LOW' then ' ' || et else et end "EDAD",
  lpad(cast(r_regionkey + 1 as varchar), 2, '0') || lpad(cast(n_nationkey + 1 as varchar), 2, '0') || '01'
    "UBIGEO_LUGAR_RESIDENCIA",
  case when p = '4-NOT SPECIFIED' and d = 5 then ' ' || r_name
       when p = '4-NOT SPECIFIED' and d = 6 then r_name || '--' || c_mktsegment
       when p = '4-NOT SPECIFIED' and d = 7 then r_name || '-  -' || c_mktsegment
       when p = '4-NOT SPECIFIED' and d = 8 then n_name || '-' || n_name || '-' || r_name
       when p = '5-LOW' and d = 9 then lower(lb)
       when p = '3-MEDIUM' and d = 10 then chr(9) || lb || chr(160)
       when p = '2-HIGH' and d = 11 then '"' || lb || '"'
       else lb end "LUGAR_RESIDENCIA",
  case when p = '5-LOW' and d = 12 then ' ' || cast(cant as varchar) || 'x'
       else coalesce(cast(cant as varchar), '') end "CANT_ATENCIONES_CEX", d, p
  from rawbase)"""
_fec = ct('"FEC_FILIACION"')
_sx = ct('"SEXO"', True)
_ed = li(ct('"EDAD"'))
_parts = f"string_split({ct('"LUGAR_RESIDENCIA"')}, '-')"
_years_txt = ", ".join(f"'{y}'" for y in P.report_years)
CTE["nac"] = f"""nac0 as (select "HISTORIA" historia, {_fec} fecha, {_sx} sx, {_ed} edad,
    {_parts} parts, {ct('"UBIGEO_LUGAR_RESIDENCIA"')} ubigeo,
    {li(ct('"CANT_ATENCIONES_CEX"'))} cant_atenciones, substring({ct('"UUID"')}, 1, 16) uuid_hash,
    "LUGAR_RESIDENCIA" lugar_crudo
  from raw),
nac as (select *, {li('substring(fecha, 1, 4)')} anio, {li('substring(fecha, 5, 2)')} mes,
    coalesce(length(fecha) >= 6 and {li('substring(fecha, 1, 4)')} between {P.first_year} and {P.last_year}
      and {li('substring(fecha, 5, 2)')} between 1 and 12, false) valido,
    case when sx in ('FEMENINO', 'MASCULINO') then sx else '{cfg.UNKNOWN}' end sexo,
    case when sx in ('FEMENINO', 'MASCULINO') then sx end sexo_regional,
    {_band('edad')} grupo_etario,
    {_band('edad', cfg.UNKNOWN_BAND_REGIONAL)} grupo_etario_regional,
    upper({jt(f"coalesce(nullif(parts[1], ''), '{cfg.UNKNOWN}')")}) departamento,
    upper({jt(f"coalesce(nullif(parts[2], ''), '{cfg.UNKNOWN}')")}) provincia,
    upper({jt("coalesce(nullif(parts[3], ''), '')")}) distrito,
    case when len(parts) >= 2 then {jt('parts[2]')} else '{cfg.UNKNOWN_PROVINCE_REGIONAL}' end provincia_regional,
    length(fecha) >= 6 and substring(fecha, 1, 4) in ({_years_txt}) incluido_regional
  from nac0)"""
CTE["fact"] = """fact as (
  select departamento, provincia, distrito, anio, mes, sexo, edad, grupo_etario, cant_atenciones
  from nac where valido)"""
_base_year = min(min(ys) for ys in P.sheet_years.values())
CTE["poblacion"] = f"""pob_nation as (
  select c_nationkey, count(*) n, count_if(c_acctbal >= 0) h from customer group by c_nationkey),
pob_region as (
  select r_name, sum(n) n, sum(h) h from pob_nation
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  group by r_name),
pob_years as (select unnest(range({P.first_year}, {P.last_year + 1})) y),
poblacion as (
  select r_name departamento, cast(y as int) anio,
         cast(n * 1000 + n * (7 * (y - {_base_year})) as bigint) total,
         cast(h * 1000 + h * (7 * (y - {_base_year})) as bigint) hombres,
         cast(n * 1000 + n * (7 * (y - {_base_year})) - (h * 1000 + h * (7 * (y - {_base_year}))) as bigint) mujeres
  from pob_region, pob_years where r_name <> 'MIDDLE EAST')"""
CTE["cpa"] = """cpa as (select departamento, anio, count(*) casos from fact group by departamento, anio)"""
CTE["tasa"] = f"""tasa as (
  select c.departamento, c.anio, c.casos, coalesce(p.total, 0) poblacion,
         {rate('c.casos', 'p.total')} tasa,
         cast(floor(c.casos / nullif(p.total, 0) * {cfg.RATE_SCALE} * 100 + 0.5::double) as bigint) y100
  from cpa c left join poblacion p on p.departamento = c.departamento and p.anio = c.anio)"""

DEPS = {"rawbase": ["visits"], "raw": ["rawbase"], "nac": ["raw"], "fact": ["nac"], "cpa": ["fact"], "tasa": ["cpa", "poblacion"]}


def with_(*names: str) -> str:
    order: list = []

    def add(n):
        for d in DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)
    for n in names:
        add(n)
    return "with " + ",\n".join(CTE[n] for n in order) + "\n"


SQL: dict = {}

SQL["casos_por_anio"] = with_("cpa") + "select departamento, anio, casos from cpa"

SQL["tasa_incidencia"] = with_("tasa") + \
    "select departamento, anio, casos, poblacion, tasa from tasa"


# ---------------------------------------------------------------------------
# Aggregations
# ---------------------------------------------------------------------------
_F = with_("fact")
SQL["distribucion_sexo"] = _F + "select departamento, sexo, count(*) casos from fact group by departamento, sexo"
SQL["distribucion_edad"] = _F + f"""select departamento, grupo_etario, count(*) casos from fact
  where grupo_etario <> '{cfg.UNKNOWN}' group by departamento, grupo_etario"""
SQL["edad_por_depto"] = SQL["distribucion_edad"]
SQL["ranking_departamentos"] = _F + "select departamento, count(*) casos from fact group by departamento"
_MONTHS = "[" + ", ".join(f"'{m}'" for m in cfg.MONTH_LABELS) + "]"
SQL["tendencia_mensual"] = _F + f"""select departamento, anio, mes, count(*) casos,
  coalesce({_MONTHS}[mes], 'M' || cast(mes as varchar)) etiqueta
  from fact group by departamento, anio, mes"""
SQL["provincias"] = _F + "select departamento, provincia, count(*) casos from fact group by departamento, provincia"
SQL["mensual_detalle"] = _F + "select departamento, anio, mes, count(*) casos from fact group by departamento, anio, mes"
SQL["resumen_depto_total"] = _F + f"""select departamento, count(*) casos,
  cast(count_if(sexo = 'FEMENINO') as bigint) femenino, {r2('avg(edad)', 1)} edad_promedio
  from fact group by departamento"""
SQL["resumen_depto_anio"] = with_("fact", "poblacion") + f"""
, a as (select departamento, anio, count(*) casos, cast(count_if(sexo = 'FEMENINO') as bigint) femenino,
         cast(count_if(sexo = 'MASCULINO') as bigint) masculino, {r2('avg(edad)', 1)} edad_promedio
       from fact group by departamento, anio)
select a.*, p.total is not null con_poblacion, {rate('a.casos', 'p.total')} tasa
from a left join poblacion p on p.departamento = a.departamento and p.anio = a.anio"""
SQL["atenciones"] = _F + f"""select departamento, anio,
  coalesce({r2('avg(cant_atenciones)', 2)}, 0::double) promedio,
  coalesce(cast(median(cant_atenciones) as double), 0::double) mediana,
  coalesce(cast(max(cant_atenciones) as bigint), 0::bigint) maximo,
  count(cant_atenciones) n_valores
  from fact group by departamento, anio"""

# ---------------------------------------------------------------------------
# Windows, top-k, KPIs
# ---------------------------------------------------------------------------
_RK = with_("fact") + ", rk as (select departamento, count(*) casos from fact group by departamento)\n"
_PV = with_("fact") + ", pv as (select departamento, provincia, count(*) casos from fact group by departamento, provincia)\n"
SQL["top5_departamentos"] = _RK + """select departamento, casos,
  cast(row_number() over (order by casos desc, departamento) as int) posicion
  from rk qualify posicion <= 5"""
SQL["top_provincia"] = _PV + """select departamento, provincia, casos from pv
  qualify row_number() over (partition by departamento order by casos desc, provincia) = 1"""
SQL["top_provincias"] = _PV + f"""select departamento, posicion, provincia, casos, pct from (
  select departamento, provincia, casos,
    cast(row_number() over (partition by departamento order by casos desc, provincia) as int) posicion,
    count(*) over (partition by departamento) n_provincias,
    {share('casos', 'sum(casos) over (partition by departamento)')} pct
  from pv) where posicion <= {cfg.TOP_PROVINCES} and n_provincias >= {cfg.MIN_PROVINCES_FOR_CHUNK}"""
SQL["ranking_anual"] = with_("cpa") + f"""select departamento, anio, casos,
  cast(sum(casos) over (partition by anio) as bigint) total_nacional,
  cast(row_number() over (partition by anio order by casos desc, departamento) as int) posicion
  from cpa qualify posicion <= {cfg.TOP_RANKING_CHUNK}"""
SQL["participacion"] = with_("fact") + f"""
, s as (select departamento, 'sexo' seccion, sexo clave, count(*) casos from fact group by 1, 2, 3
  union all select departamento, 'edad', grupo_etario, count(*) from fact
    where grupo_etario <> '{cfg.UNKNOWN}' group by 1, 2, 3
  union all select departamento, 'provincia', provincia, count(*) from fact group by 1, 2, 3)
select departamento, seccion, clave, casos,
  {share('casos', 'sum(casos) over (partition by departamento, seccion)')} pct from s"""
SQL["intensidad"] = with_("fact") + """
, s as (select departamento, 'provincia' seccion, cast(null as int) anio, provincia clave, count(*) casos
        from fact group by departamento, provincia
  union all select departamento, 'mes', anio, cast(mes as varchar), count(*) from fact
        group by departamento, anio, mes)
select departamento, seccion, anio, clave, casos,
  cast(casos as double) / cast(greatest(max(casos) over (partition by departamento, seccion, anio), 1) as double) relativo
from s"""
SQL["pico_mensual"] = with_("fact") + """
, m as (select departamento, anio, mes, count(*) casos from fact group by departamento, anio, mes)
select departamento, anio, first(mes order by casos desc, mes) mes_pico, max(casos) casos_pico
from m group by departamento, anio"""
SQL["kpi_departamento"] = with_("fact") + f"""
, y as (select departamento, anio, count(*) casos from fact group by departamento, anio)
, a as (select departamento, cast(sum(casos) as bigint) total_casos, max(anio) ultimo_anio,
          arg_max(casos, anio) casos_ultimo_anio from y group by departamento)
, s as (select departamento, cast(count_if(sexo = 'FEMENINO') as bigint) femenino, count(*) total_sexo
        from fact group by departamento)
, pv as (select departamento, provincia, count(*) casos from fact group by departamento, provincia)
, t as (select departamento, provincia top_provincia, casos casos_top_provincia from pv
        qualify row_number() over (partition by departamento order by casos desc, provincia) = 1)
select a.*, s.femenino, t.top_provincia, t.casos_top_provincia,
  {share('s.femenino', 's.total_sexo')} pct_femenino
from a join s using (departamento) left join t using (departamento)"""
SQL["kpi_nacional"] = _RK + """, o as (select departamento, casos,
    row_number() over (order by casos desc, departamento) pos from rk)
select cast(sum(casos) as bigint) total_casos, count(*) departamentos,
  max(case when pos = 1 then departamento end) primero, max(case when pos = 1 then casos end) casos_primero,
  max(case when pos = 2 then departamento end) segundo, max(case when pos = 2 then casos end) casos_segundo
from o"""
_ZONES = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in cfg.ZONE_COLORS.items()) + "}"


def _channel(bs):
    base, slope = bs
    return f"cast({r2(f'{base} + i * {slope}', 0)} as varchar)"


SQL["escala_mapa"] = _RK + f"""select departamento, casos, {r2('i', 4)} intensidad,
  'rgb(' || {_channel(cfg.MAP_RED)} || ',' || {_channel(cfg.MAP_GREEN)} || ',' || {_channel(cfg.MAP_BLUE)} || ')' color,
  coalesce({_ZONES}[departamento], '{cfg.MAP_DEFAULT_FILL}') color_zona
from (select *, cast(casos as double) / cast(max(casos) over () as double) i from rk)"""

# ---------------------------------------------------------------------------
# Trend
# ---------------------------------------------------------------------------
CTE["coef"] = f"""pts as (select departamento, anio, y100, coalesce(y100 <> 0, false) pt from tasa),
sums as (
  select departamento, cast(count_if(pt) as bigint) n,
    cast(sum(case when pt then cast(anio as bigint) end) as bigint) sx,
    cast(sum(case when pt then y100 end) as bigint) sy,
    cast(sum(case when pt then cast(anio as bigint) * y100 end) as bigint) sxy,
    cast(sum(case when pt then cast(anio as bigint) * cast(anio as bigint) end) as bigint) sxx,
    cast(sum(case when pt then y100 * y100 end) as bigint) syy
  from pts group by departamento),
coef as (
  select departamento, n n_puntos,
    case when n >= {cfg.MIN_TREND_POINTS} then cast(n * sxy - sx * sy as double) / cast(n * sxx - sx * sx as double) / 100 end m,
    case when n >= {cfg.MIN_TREND_POINTS} then cast(sy * sxx - sx * sxy as double) / cast(n * sxx - sx * sx as double) / 100 end b,
    case when n >= {cfg.MIN_TREND_POINTS} and n * syy - sy * sy <> 0 then
      cast(n * sxy - sx * sy as double) * cast(n * sxy - sx * sy as double)
      / (cast(n * sxx - sx * sx as double) * cast(n * syy - sy * sy as double)) end r2,
    case when n >= {cfg.MIN_TREND_POINTS} then cast(sy as double) / n end media100,
    case when n >= {cfg.MIN_TREND_POINTS} then sqrt(cast(n * syy - sy * sy as double)) / n end sd100
  from sums)"""
DEPS["coef"] = ["tasa"]
SQL["tendencia_regresion"] = with_("coef") + f"""select departamento, n_puntos,
  {r2('m', 2)} pendiente, {r2('b', 2)} intercepto, {r2('r2', 3)} r_cuadrado,
  floor(media100 + 0.5::double) / 100 media_tasa, floor(sd100 + 0.5::double) / 100 desviacion from coef"""
_UP, _DOWN, _FLAT = cfg.TREND_LABELS
SQL["tendencia_clase"] = with_("coef") + f"""select departamento, {r2('m', 2)} pendiente,
  case when m > {cfg.TREND_THRESHOLD} then '{_UP}' when m < -{cfg.TREND_THRESHOLD} then '{_DOWN}'
       when m is not null then '{_FLAT}' end tendencia from coef"""
SQL["tendencia_proyeccion"] = with_("coef") + f"""select t.departamento, t.anio, t.casos, t.tasa,
  {r2('c.m * t.anio + c.b', 2)} tasa_proyectada
from tasa t left join coef c using (departamento)"""


# ---------------------------------------------------------------------------
# Keys over the raw registry
# ---------------------------------------------------------------------------
_N = with_("nac")
SQL["limpiar_texto"] = _N + "select historia, uuid_hash, sexo, sexo_regional from nac"
SQL["entero_tolerante"] = _N + "select historia, edad, cant_atenciones from nac"
SQL["periodo_valido"] = _N + "select historia, fecha, anio, mes, valido, incluido_regional from nac"
SQL["grupo_etario"] = _N + "select historia, edad, grupo_etario, grupo_etario_regional from nac"
SQL["separar_lugar"] = _N + "select historia, departamento, provincia, distrito, provincia_regional from nac"
SQL["filtro_contiene"] = _N + """select r_name departamento, count(*) filas, cast(count_if(incluido_regional) as bigint) filas_incluidas
  from nac join region on contains(upper(lugar_crudo), r_name) group by r_name"""
SQL["dim_tiempo"] = _N + f"""select distinct anio, mes, cast(ceil(mes / 3) as int) trimestre,
  anio <> {P.partial_year} completo from nac where valido"""
SQL["dim_geografia"] = _N + """select departamento, provincia, distrito,
  arg_min(ubigeo, cast(historia as bigint)) ubigeo
  from nac where valido group by departamento, provincia, distrito"""
SQL["dim_paciente"] = _N + "select distinct sexo, grupo_etario from nac where valido"
SQL["auditoria_carga"] = with_("nac", "poblacion") + """
select 'insertados' metrica, cast(count_if(valido) as bigint) valor from nac
union all select 'descartados', cast(count_if(not valido) as bigint) from nac
union all select 'leidos', count(*) from nac
union all select 'corruptos', 0
union all select 'fecha_corta', cast(count_if(length(fecha) < 6) as bigint) from nac
union all select 'fecha_ilegible', cast(count_if(length(fecha) >= 6 and (anio is null or mes is null)) as bigint) from nac
union all select 'anio_fuera', cast(count_if(length(fecha) >= 6 and anio is not null and mes is not null
  and anio not between @F and @L) as bigint) from nac
union all select 'mes_fuera', cast(count_if(length(fecha) >= 6 and anio between @F and @L
  and mes not between 1 and 12) as bigint) from nac
union all select 'departamentos', count(*) from (select distinct departamento from nac where valido)
union all select 'geografias', count(*) from (select distinct departamento, provincia, distrito from nac where valido)
union all select 'periodos', count(*) from (select distinct anio, mes from nac where valido)
union all select 'grupos_paciente', count(*) from (select distinct sexo, grupo_etario from nac where valido)
union all select 'regiones_poblacion', count(distinct departamento) from poblacion""" \
    .replace("@F", str(P.first_year)).replace("@L", str(P.last_year))
SQL["registro_validado"] = with_("raw") + r"""
, v as (select d = 15 and p = '5-LOW' few, d = 16 and p = '5-LOW' many, d = 17 and p = '5-LOW' anon,
    "EDAD" <> '' and not regexp_full_match("EDAD", '\s*[+-]?[0-9]+\s*') edad,
    coalesce("CANT_ATENCIONES_CEX", '') <> '' and not (d = 15 and p = '5-LOW')
      and not regexp_full_match("CANT_ATENCIONES_CEX", '\s*[+-]?[0-9]+\s*') cant
  from raw)
, r as (select *, few or many or anon or edad or cant bad from v)
select 'aceptada' estado, '' motivo, cast(count_if(not bad) as bigint) n from r
union all select 'rechazada', '', cast(count_if(bad) as bigint) from r
union all select * from (
  select 'rechazada', 'corrupto', cast(count_if(few or many) as bigint) n from r
  union all select 'rechazada', 'nulo:UUID', cast(count_if(anon) as bigint) from r
  union all select 'rechazada', 'tipo:EDAD', cast(count_if(edad) as bigint) from r
  union all select 'rechazada', 'tipo:CANT_ATENCIONES_CEX', cast(count_if(cant) as bigint) from r) where n > 0"""
SQL["conteo_tablas"] = with_("nac", "poblacion") + """
select 'fact_casos' tabla, count(*) filas from nac where valido
union all select 'dim_tiempo', count(*) from (select distinct anio, mes from nac where valido)
union all select 'dim_geografia', count(*) from (select distinct departamento, provincia, distrito from nac where valido)
union all select 'dim_paciente', count(*) from (select distinct sexo, grupo_etario from nac where valido)
union all select 'dim_fuente', 1
union all select 'bocetos', count(*) from (select distinct departamento, anio from nac where valido)
union all select 'poblacion', count(*) from poblacion"""
_checks = []
for _k in ("tiempo_id", "geografia_id", "paciente_id", "fuente_id"):
    _checks.append(f"select 'fk_huerfana' chequeo, '{_k}' detalle, 0::bigint n")
for _k in ("uuid_hash", "tiempo_id", "geografia_id", "paciente_id", "fuente_id"):
    _expr = "count_if(uuid_hash is null)" if _k == "uuid_hash" else "count_if(false)"
    _checks.append(f"select 'nulo', '{_k}', cast((select {_expr} from nac where valido) as bigint)")
for _k in ("tiempo_id", "geografia_id", "paciente_id"):
    _checks.append(f"select 'colision_id', '{_k}', 0::bigint")
_checks.append("""select 'sin_poblacion', departamento, count(*) from nac
  where valido and departamento not in (select departamento from poblacion) group by departamento""")
SQL["integridad_referencial"] = with_("nac", "poblacion") + "\nunion all ".join(_checks)


# ---------------------------------------------------------------------------
# Text chunks
# ---------------------------------------------------------------------------
def jstr(x: str) -> str:
    return f"""'"' || replace(replace({x}, '\\', '\\\\'), '"', '\\"') || '"'"""


def mlabel(m: str) -> str:
    return f"coalesce({_MONTHS}[{m}], 'M' || cast({m} as varchar))"


def thou(x: str) -> str:
    return f"format('{{:,}}', cast({x} as bigint))"


def vc(x: str) -> str:
    return f"cast({x} as varchar)"


def tsql(tpl: str, **exprs) -> str:
    """Render a ``{name}`` template of ``config`` as a SQL ``||`` chain;
    plain Python strings are literals, other values SQL expressions."""
    import string
    parts = []
    for literal, field, _, _ in string.Formatter().parse(tpl):
        if literal:
            parts.append("'" + literal.replace("'", "''") + "'")
        if field is not None:
            v = exprs[field]
            parts.append("'" + v.replace("'", "''") + "'" if isinstance(v, Lit) else f"cast({v} as varchar)")
    return "(" + " || ".join(parts) + ")"


class Lit(str):
    """A literal string value for ``tsql``."""


_SEP = "'" + cfg.TPL_LIST_SEPARATOR + "'"
_FUENTE = Lit(cfg.SOURCE_NAME)
_DESDE, _HASTA = Lit(str(P.first_year)), Lit(str(P.last_year))

SQL["chunk_depto_anio"] = with_("fact", "poblacion") + f"""
, a as (select departamento, anio, count(*) casos, count_if(sexo = 'FEMENINO') femenino,
         {r2('avg(edad)', 1)} edad_promedio from fact group by departamento, anio)
, b as (select a.*, p.total is not null con_poblacion, {rate('a.casos', 'p.total')} tasa,
         {share('a.femenino', 'a.casos')} pct
       from a left join poblacion p on p.departamento = a.departamento and p.anio = a.anio)
select '{cfg.CHUNK_DEPTO_ANIO}' chunk_type, departamento || '_' || {vc('anio')} chunk_key,
  {tsql(cfg.TPL_DEPTO_ANIO, anio='anio',
        parcial=f"(case when anio = {P.partial_year} then '{cfg.PARTIAL_NOTE_LONG}' else '' end)",
        departamento='departamento', casos='casos', fuente=_FUENTE,
        tasa=f"(case when con_poblacion then {tsql(cfg.TPL_DEPTO_ANIO_TASA, tasa=js_num('tasa', 2))} else '' end)",
        pct_femenino='pct', pct_masculino='100 - pct',
        edad=f"coalesce({js_num('edad_promedio', 1)}, 'null')")} content,
  '{{"departamento":' || {jstr('departamento')} || ',"año":' || {vc('anio')} || ',"casos":' || {vc('casos')}
  || ',"tasa":' || {js_num('tasa', 2)} || '}}' metadata_json
from b"""
SQL["chunk_depto_total"] = with_("fact") + f"""
, a as (select departamento, count(*) casos, count_if(sexo = 'FEMENINO') femenino,
         {r2('avg(edad)', 1)} edad_promedio from fact group by departamento)
, pv as (select departamento, provincia, count(*) casos from fact group by departamento, provincia)
, t as (select departamento, provincia top_prov, casos top_casos from pv
        qualify row_number() over (partition by departamento order by casos desc, provincia) = 1)
select '{cfg.CHUNK_DEPTO_TOTAL}' chunk_type, departamento || '_total' chunk_key,
  {tsql(cfg.TPL_DEPTO_TOTAL, departamento='departamento', casos=thou('casos'), desde=_DESDE, hasta=_HASTA,
        fuente=_FUENTE, pct_femenino=share('femenino', 'casos'),
        edad=f"coalesce({js_num('edad_promedio', 1)}, 'null')",
        provincia=f"(case when top_prov is not null then "
                  f"{tsql(cfg.TPL_DEPTO_TOTAL_PROV, provincia='top_prov', casos='top_casos', pct=share('top_casos', 'casos'))}"
                  f" else '' end)")} content,
  '{{"departamento":' || {jstr('departamento')} || ',"casos":' || {vc('casos')} || '}}' metadata_json
from a left join t using (departamento)"""
SQL["chunk_mensual"] = with_("fact") + f"""
, m as (select departamento, anio, mes, count(*) casos from fact group by departamento, anio, mes)
, g as (select departamento, anio,
    string_agg({tsql(cfg.TPL_MENSUAL_ITEM, mes=mlabel('mes'), casos='casos')}, {_SEP} order by mes) serie,
    first(mes order by casos desc, mes) mes_pico, max(casos) casos_pico, sum(casos) suma, count(*) n_meses
  from m group by departamento, anio having count(*) >= {cfg.MIN_MONTHS_FOR_CHUNK})
select '{cfg.CHUNK_MENSUAL}' chunk_type, departamento || '_' || {vc('anio')} chunk_key,
  {tsql(cfg.TPL_MENSUAL, departamento='departamento', anio='anio', serie='serie', mes_pico=mlabel('mes_pico'),
        casos_pico='casos_pico', promedio=r2('suma / n_meses', 0))} content,
  '{{"departamento":' || {jstr('departamento')} || ',"año":' || {vc('anio')} || '}}' metadata_json
from g"""
SQL["chunk_ranking"] = with_("cpa") + f"""
, years as (select cast(unnest(range({P.first_year}, {P.last_year + 1})) as int) anio)
, rk as (select *, row_number() over (partition by anio order by casos desc, departamento) pos,
           sum(casos) over (partition by anio) total from cpa)
, t as (select anio, string_agg({tsql(cfg.TPL_RANKING_ITEM, posicion='pos', departamento='departamento', casos='casos')},
           {_SEP} order by pos) filter (where pos <= {cfg.TOP_RANKING_CHUNK}) rnk, max(total) total
        from rk group by anio)
select '{cfg.CHUNK_RANKING}' chunk_type, 'ranking_' || {vc('y.anio')} chunk_key,
  {tsql(cfg.TPL_RANKING, fuente=_FUENTE, anio='y.anio',
        parcial=f"(case when y.anio = {P.partial_year} then '{cfg.PARTIAL_NOTE_SHORT}' else '' end)",
        ranking="coalesce(rnk, '')", total=thou('coalesce(total, 0)'))} content,
  '{{"año":' || {vc('y.anio')} || '}}' metadata_json
from years y left join t on t.anio = y.anio"""
SQL["chunk_edad"] = with_("fact") + f"""
, e as (select departamento, grupo_etario, count(*) casos from fact
        where grupo_etario <> '{cfg.UNKNOWN}' group by departamento, grupo_etario)
, e2 as (select *, sum(casos) over (partition by departamento) total from e)
, g as (select departamento,
    string_agg({tsql(cfg.TPL_EDAD_ITEM, grupo='grupo_etario', casos='casos', pct=share('casos', 'total'))},
               {_SEP} order by grupo_etario) grupos,
    first(grupo_etario order by casos desc, grupo_etario) g_max, max(casos) c_max, max(total) total
  from e2 group by departamento)
select '{cfg.CHUNK_EDAD}' chunk_type, departamento || '_edad' chunk_key,
  {tsql(cfg.TPL_EDAD, departamento='departamento', desde=_DESDE, hasta=_HASTA, grupos='grupos', grupo='g_max',
        casos='c_max', pct=share('c_max', 'total'))} content,
  '{{"departamento":' || {jstr('departamento')} || '}}' metadata_json
from g"""
_TOPP = SQL["top_provincias"][len(_PV):]
SQL["chunk_provincias"] = _PV + f""", tp as ({_TOPP})
select '{cfg.CHUNK_PROVINCIAS}' chunk_type, departamento || '_provincias' chunk_key,
  {tsql(cfg.TPL_PROVINCIAS, departamento='departamento', desde=_DESDE, hasta=_HASTA,
        provincias=f"string_agg({tsql(cfg.TPL_PROVINCIAS_ITEM, provincia='provincia', casos='casos', pct='pct')}, {_SEP} order by posicion)")} content,
  '{{"departamento":' || {jstr('departamento')} || '}}' metadata_json
from tp group by departamento"""


CHUNK_KEYS = ("chunk_depto_anio", "chunk_depto_total", "chunk_mensual", "chunk_ranking",
              "chunk_edad", "chunk_provincias")
SQL["chunks_todos"] = "\nunion all\n".join(f"select * from ({SQL[k]})" for k in CHUNK_KEYS)


# ---------------------------------------------------------------------------
# Vectors
# ---------------------------------------------------------------------------
CTE["scan"] = f"""scan0 as (
  select vec_id, label, embedding,
    case when label <= 1 then '{cfg.CHUNK_DEPTO_ANIO}' when label <= 3 then '{cfg.CHUNK_DEPTO_TOTAL}'
         when label <= 5 then '{cfg.CHUNK_MENSUAL}' when label = 6 then '{cfg.CHUNK_RANKING}'
         when label = 7 then '{cfg.CHUNK_EDAD}' else '{cfg.CHUNK_PROVINCIAS}' end chunk_type,
    'NATION_' || cast(label * 2 + case when embedding[1] >= 0 then 1 else 0 end as varchar) dep,
    cast(1995 + cast(floor(label / 2) as int) + case when embedding[2] >= 0 then 1 else 0 end as varchar) yr
  from embeddings),
scan as (
  select vec_id, label, embedding, chunk_type,
    case when json_type(coalesce(m, '{{}}'), '$.departamento') = 'VARCHAR'
         then json_extract_string(coalesce(m, '{{}}'), '$.departamento') end meta_departamento,
    case when json_type(coalesce(m, '{{}}'), '$."año"') in ('UBIGINT', 'BIGINT', 'DOUBLE')
          and cast(json_extract(coalesce(m, '{{}}'), '$."año"') as double)
              = floor(cast(json_extract(coalesce(m, '{{}}'), '$."año"') as double))
         then cast(cast(json_extract(coalesce(m, '{{}}'), '$."año"') as double) as int) end meta_anio
  from (select *, case when label = 9 then null when label = 6 then '{{"año":' || yr || '}}'
        else '{{"departamento":"' || dep || '","año":' || yr || '}}' end m from scan0)
  where embedding is not null),
reps as (
  select label, arg_min_null(embedding, vec_id) q_embedding, arg_min_null(meta_departamento, vec_id) q_departamento,
    arg_min_null(meta_anio, vec_id) q_anio from scan group by label)"""


def dot(a: str, b: str) -> str:
    return (f"list_reduce(list_transform(range(1, len({a}) + 1), lambda i: cast({a}[i] as double) * cast({b}[i] as double)),"
            f" lambda x, y: x + y, 0::double)")


def cos(a: str, b: str) -> str:
    return f"({dot(a, b)} / nullif(sqrt({dot(a, a)}) * sqrt({dot(b, b)}), 0::double))"


def boosted(a, b, cd, cy, qd, qy) -> str:
    s1 = f"(case when {qd} is not null and {cd} = {qd} then {cos(a, b)} * {cfg.REGION_BOOST}::double else {cos(a, b)} end)"
    return f"(case when {qy} is not null and {cy} = {qy} then {s1} * {cfg.YEAR_BOOST}::double else {s1} end)"


SQL["chunks_scan"] = with_("scan") + f"""select vec_id, chunk_type, meta_departamento, meta_anio,
  cast(len(embedding) as int) dim, {r2('sqrt(' + dot('embedding', 'embedding') + ')', 6)} norma from scan"""
SQL["chunks_guardados"] = with_("scan") + f"""select cast(vec_id as varchar) chunk_key, 'fragmento ' || vec_id content,
  chunk_type, meta_departamento, meta_anio, {r2('sqrt(' + dot('embedding', 'embedding') + ')', 6)} norma from scan"""
SQL["vectores_blob"] = with_("scan") + f"""select cast(vec_id as varchar) chunk_key, cast(4 * len(embedding) as int) bytes,
  cast(len(embedding) as int) dim, {r2('sqrt(' + dot('embedding', 'embedding') + ')', 6)} norma from scan"""
SQL["vector_coseno"] = with_("scan") + f"""select vec_id, label, {r2(cos('embedding', 'q_embedding'), 6)} coseno
  from scan join reps using (label)"""
SQL["vector_boost"] = with_("scan") + f"""select vec_id, label,
  {r2(boosted('embedding', 'q_embedding', 'meta_departamento', 'meta_anio', 'q_departamento', 'q_anio'), 6)} puntaje
  from scan join reps using (label)"""


def _topk_sql(types=None) -> str:
    where = "where r.vec_id % 100 = 0"
    if types:
        where += " and c.chunk_type in (" + ", ".join(f"'{t}'" for t in types) + ")"
    return with_("scan") + f"""
, s as (select r.vec_id query_id, c.vec_id,
     {boosted('c.embedding', 'r.embedding', 'c.meta_departamento', 'c.meta_anio', 'r.meta_departamento', 'r.meta_anio')} score
   from scan c cross join scan r {where})
select query_id, vec_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) posicion,
  {r2('score', 6)} puntaje
from s where score is not null qualify posicion <= {cfg.TOP_K}"""


SQL["vector_topk"] = _topk_sql()
SQL["vector_topk_tipo"] = _topk_sql([cfg.CHUNK_MENSUAL, cfg.CHUNK_PROVINCIAS])


# ---------------------------------------------------------------------------
# Questions and answers
# ---------------------------------------------------------------------------

CTE["preguntas"] = """preguntas as (
  select c_custkey pregunta_id, case c_mktsegment
    when 'AUTOMOBILE' then '¿Cuántos casos hubo en ' || lower(r_name) || ' durante ' || y || '?'
    when 'BUILDING' then 'Casos en ' || lower(n_name) || ' (' || lower(r_name) || ') en el año ' || y
    when 'FURNITURE' then 'Resumen general sin filtros, año' || y
    when 'HOUSEHOLD' then 'Compare eurasia con ' || lower(r_name) || ' en ' || y || 'x'
    else '¿qué significa ' || y || ' para ' || lower(n_name) || '?' end texto
  from (select *, cast(1995 + c_custkey % 8 as varchar) y from customer) c
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
_YEARS = "(^|[^A-Za-z0-9_])(" + "|".join(str(y) for y in P.years) + ")([^A-Za-z0-9_]|$)"
SQL["detectar_filtros"] = with_("preguntas") + f"""select pregunta_id, texto,
  try_cast(nullif(regexp_extract(texto, '{_YEARS}', 2), '') as int) anio,
  list_filter((select list(r_name order by r_regionkey) from region), lambda d: contains(upper(texto), d))[1] departamento
from preguntas"""
CTE["respuestas"] = """resp0 as (
  select conv_id, turn, text,
    case conv_id % 4 when 0 then 'bar' when 1 then 'pie' when 2 then 'scatter' else 'line' end tipo,
    case when turn % 5 = 4 then '[]' else '[{"nombre":"a","valor":' || cast(length(text) as varchar)
      || '},{"nombre":"b","valor":' || cast(turn + 1 as varchar) || '},{"nombre":"c","valor":'
      || cast(conv_id as varchar) || '}]' end datos
  from conversations where role = 'assistant'),
respuestas as (
  select conv_id, turn, case (conv_id + turn) % 6
    when 0 then '```json' || chr(10) || obj || chr(10) || '```' when 1 then obj when 2 then text
    when 3 then 'null' when 4 then '[1]' else '{"texto":5}' end respuesta
  from (select *, '{"texto":"respuesta ' || cast(conv_id as varchar) || '-' || cast(turn as varchar)
    || '","grafica":{"tipo":"' || tipo || '","titulo":"t","datos":' || datos || ',"ejeX":"x","ejeY":"y"}}' obj
    from resp0))"""
_c1 = f"regexp_replace({jt('respuesta')}, '^```(?:json)?\\s*', '', 'i')"
_c2 = jt(f"regexp_replace({_c1}, '(?s)^(.*?)\\s*```(?m:$)', '\\1')")
CTE["parsed"] = f"""parsed00 as (select *, {_c2} c0 from respuestas),
parsed0 as (select *, case when json_valid(c0) then c0 end c from parsed00),
parsed1 as (select *, coalesce(json_type(c) = 'OBJECT', false) is_obj from parsed0),
parsed as (select conv_id, turn, respuesta, c,
    case when is_obj and json_type(c, '$.texto') = 'VARCHAR' then json_extract_string(c, '$.texto') else respuesta end texto,
    is_obj and coalesce(json_type(c, '$.grafica') <> 'NULL', false) tiene_grafica
  from parsed1),
parsed2 as (select *,
    case when tiene_grafica and json_type(c, '$.grafica.tipo') = 'VARCHAR' then json_extract_string(c, '$.grafica.tipo') end grafica_tipo,
    case when tiene_grafica and json_type(c, '$.grafica.datos') = 'ARRAY' then cast(json_array_length(c, '$.grafica.datos') as int) end n_datos
  from parsed)"""
DEPS.update({"parsed": ["respuestas"]})
SQL["parsear_respuestas"] = with_("parsed") + "select conv_id, turn, texto, tiene_grafica, grafica_tipo, n_datos from parsed2"
_types = ", ".join(f"'{t}'" for t in cfg.CHART_TYPES)
SQL["grafica_valida"] = with_("parsed") + f"""
, g as (select conv_id, turn, grafica_tipo tipo,
    from_json(json_extract(c, '$.grafica.datos'), '[{{"nombre":"VARCHAR","valor":"DOUBLE"}}]') d
  from parsed2 where grafica_tipo in ({_types}) and n_datos > 0)
, e as (select conv_id, turn, tipo,
    list_reduce(list_transform(d, lambda x: coalesce(x.valor, 0::double)), lambda a, b: a + b, 0::double) total,
    unnest(range(1, len(d) + 1)) posicion, unnest(d) item from g)
select conv_id, turn, tipo, cast(posicion as int) posicion, item.nombre nombre, item.valor valor,
  {share('item.valor', 'total')} pct,
  case when tipo = 'pie' then coalesce(item.nombre, '') || ' ' || cast({share('item.valor', 'total')} as varchar) || '%' end etiqueta
from e"""
SQL["historial_listas"] = """select conv_id, cast(0 as bigint) pieza, cast(count(*) as int) n_turnos,
  cast(to_json(list({'role': case when role = 'assistant' then 'model' else 'user' end,
                     'parts': [{'text': text}]} order by turn nulls first)) as varchar) historial
from conversations group by conv_id"""
SQL["historial"] = """select conv_id, turn, case when role = 'assistant' then 'model' else 'user' end rol, text texto
from conversations"""


# ---------------------------------------------------------------------------
# Report bundles and population sheets
# ---------------------------------------------------------------------------
SQL["poblacion_unpivot"] = with_("poblacion") + "select departamento, anio, total, hombres, mujeres from poblacion"

_stats = [("pendiente", r2("m", 2)), ("intercepto", r2("b", 2)), ("r_cuadrado", r2("r2", 3)),
          ("media_tasa", "floor(media100 + 0.5::double) / 100"), ("desviacion", "floor(sd100 + 0.5::double) / 100")]
SQL["resumen_departamento"] = with_("fact", "coef") + "\nunion all ".join([
    "select departamento, 'total' seccion, 'casos' clave, cast(count(*) as double) valor from fact group by departamento",
    f"select departamento, 'total', 'edad_promedio', coalesce({r2('avg(edad)', 1)}, 0::double) from fact group by departamento",
    "select departamento, 'por_anio', cast(anio as varchar), cast(casos as double) from cpa",
    "select departamento, 'sexo', sexo, cast(count(*) as double) from fact group by departamento, sexo",
    f"select departamento, 'edad', grupo_etario, cast(count(*) as double) from fact where grupo_etario <> '{cfg.UNKNOWN}' group by departamento, grupo_etario",
    "select departamento, 'provincias', provincia, cast(count(*) as double) from fact group by departamento, provincia",
    *[f"select departamento, 'tendencia', '{n}', cast({e} as double) from coef" for n, e in _stats],
    f"""select departamento, 'tendencia_clase', case when m > {cfg.TREND_THRESHOLD} then '{_UP}'
        when m < -{cfg.TREND_THRESHOLD} then '{_DOWN}' else '{_FLAT}' end, {r2('m', 2)} from coef where m is not null""",
    f"select t.departamento, 'tasa_proyectada', cast(t.anio as varchar), {r2('c.m * t.anio + c.b', 2)} from tasa t join coef c using (departamento) where c.m is not null",
    "select departamento, 'tasa', cast(anio as varchar), tasa from tasa",
])
SQL["panel_departamento"] = with_("fact") + "\nunion all ".join([
    "select departamento, 'por_anio' seccion, cast(anio as varchar) clave, count(*) casos from fact group by departamento, anio",
    "select departamento, 'sexo', sexo, count(*) from fact group by departamento, sexo",
    f"select departamento, 'edad', grupo_etario, count(*) from fact where grupo_etario <> '{cfg.UNKNOWN}' group by departamento, grupo_etario",
    "select departamento, 'provincias', provincia, count(*) from fact group by departamento, provincia",
    f"select departamento, 'mensual', cast(mes as varchar), count(*) from fact where anio = {P.default_trend_year} group by departamento, mes",
])
SQL["panel_nacional"] = with_("fact") + """select 'ranking' seccion, departamento clave, count(*) casos, 'todos' anio
from fact group by departamento
union all select 'total', 'PERU', count(*), 'todos' from fact"""
_yl = "[" + ", ".join(f"'{y}'" for y in P.report_years) + "]"
_yl_t = "[" + ", ".join(f"'{y}'" for y in P.report_years) + ", 'total']"
CTE["reg"] = f"""reg as (select r.r_name departamento, substring(n.fecha, 1, 4) anio_t,
    coalesce(cast(n.mes as varchar), 'NaN') mes_t, n.sexo_regional sexo, n.grupo_etario_regional grupo_etario,
    n.provincia_regional provincia, n.cant_atenciones
  from nac n join region r on contains(upper(n.lugar_crudo), r.r_name) where n.incluido_regional),
rframe as (select r_name departamento, unnest({_yl}) anio_t from region),
rcnt as (select departamento, anio_t, count(*) n from reg group by departamento, anio_t),
rvis as (select departamento, anio_t, avg(cant_atenciones) a, cast(median(cant_atenciones) as double) md,
    max(cant_atenciones) mx from reg group by departamento, anio_t),
rvist as (select departamento, avg(cant_atenciones) a from reg group by departamento),
rpy as (select f.departamento, f.anio_t, coalesce(c.n, 0) casos, coalesce(p.total, 0) pob,
    coalesce(p.hombres, 0) h, coalesce(p.mujeres, 0) mu, v.a, v.md, v.mx
  from rframe f left join rcnt c using (departamento, anio_t)
  left join poblacion p on p.departamento = f.departamento and cast(p.anio as varchar) = f.anio_t
  left join rvis v using (departamento, anio_t))"""
DEPS["reg"] = ["nac", "poblacion"]
_py = [("por_anio", "casos", "casos"), ("por_anio", "poblacion", "pob"),
       ("por_anio", "tasa_por_100k", rate("casos", "nullif(pob, 0)")),
       ("por_anio", "completo", f"case when anio_t <> '{P.partial_year}' then 1.0 else 0.0 end"),
       ("atenciones", "promedio", f"coalesce({r2('a', 2)}, 0::double)"),
       ("atenciones", "mediana", "coalesce(md, 0::double)"), ("atenciones", "max", "coalesce(mx, 0)"),
       ("poblacion_inei", "total", "pob"), ("poblacion_inei", "hombres", "h"), ("poblacion_inei", "mujeres", "mu")]
_sexes = "[" + ", ".join(f"'{x}'" for x in cfg.SEXES) + "]"
SQL["reporte_regional"] = with_("reg") + "\nunion all ".join([
    *[f"select departamento, '{sec}' seccion, anio_t anio, '{k}' clave, cast({e} as double) valor from rpy"
      for sec, k, e in _py],
    f"""select f.departamento, 'por_sexo', f.anio, f.clave, cast(coalesce(c.n, 0) as double) from
      (select departamento, anio, unnest({_sexes}) clave from
         (select r_name departamento, unnest({_yl_t}) anio from region)) f
      left join (select departamento, anio_t anio, sexo clave, count(*) n from reg where sexo is not null
                 group by departamento, anio_t, sexo
                 union all select departamento, 'total', sexo, count(*) from reg where sexo is not null
                 group by departamento, sexo) c using (departamento, anio, clave)""",
    f"""select r_name, 'atenciones', 'total', 'promedio_total', coalesce({r2('v.a', 2)}, 0::double)
      from region left join rvist v on v.departamento = r_name""",
    "select departamento, 'por_mes', anio_t, mes_t, cast(count(*) as double) from reg group by departamento, anio_t, mes_t",
    "select departamento, 'por_grupo_etario', anio_t, grupo_etario, cast(count(*) as double) from reg group by departamento, anio_t, grupo_etario",
    "select departamento, 'por_grupo_etario', 'total', grupo_etario, cast(count(*) as double) from reg group by departamento, grupo_etario",
    "select departamento, 'por_provincia', anio_t, provincia, cast(count(*) as double) from reg group by departamento, anio_t, provincia",
    "select departamento, 'por_provincia', 'total', provincia, cast(count(*) as double) from reg group by departamento, provincia",
])


# the files hold every figure of the long form
SQL["reporte_documentos"] = SQL["reporte_regional"]
SQL["atenciones_bocetos"] = with_("fact") + """select departamento, count(cant_atenciones) n_valores,
  true mediana_en_cota, true geografias_en_cota from fact group by departamento"""


# ---------------------------------------------------------------------------
# By request: region EUROPE, year 1997
# ---------------------------------------------------------------------------
_D, _Y = "departamento = 'EUROPE'", "anio = 1997"
for _k in ("distribucion_sexo", "distribucion_edad", "tendencia_mensual", "provincias"):
    SQL[_k + "_filtro"] = SQL[_k].replace("from fact", f"from (select * from fact where {_D} and {_Y})")
SQL["casos_por_anio_filtro"] = SQL["casos_por_anio"] + f" where {_D} and {_Y}"
SQL["casos_por_anio_sql"] = SQL["casos_por_anio_filtro"]
SQL["panel_departamento_anio"] = with_("fact") + ", d as (select * from fact where " + _D + ")\n" + "\nunion all ".join([
    "select departamento, 'por_anio' seccion, cast(anio as varchar) clave, count(*) casos from d group by departamento, anio",
    f"select departamento, 'sexo', sexo, count(*) from d where {_Y} group by departamento, sexo",
    f"""select departamento, 'edad', grupo_etario, count(*) from d where {_Y} and grupo_etario <> '{cfg.UNKNOWN}'
    group by departamento, grupo_etario""",
    f"select departamento, 'provincias', provincia, count(*) from d where {_Y} group by departamento, provincia",
    f"select departamento, 'mensual', cast(mes as varchar), count(*) from d where {_Y} group by departamento, mes",
])
SQL["panel_nacional_anio"] = with_("fact") + f"""select 'ranking' seccion, departamento clave, count(*) casos, '1997' anio
from fact where {_Y} group by departamento
union all select 'total', 'PERU', count(*), '1997' from fact where {_Y}"""
SQL["estadistica_ranking"] = _F + f"select departamento, count(*) casos from fact where {_Y} group by departamento"
SQL["estadistica_tasa"] = SQL["tasa_incidencia"] + f" where {_D}"
SQL["estadistica_tendencia"] = SQL["tendencia_regresion"] + f" where {_D}"
_code_years = sorted(y for ys in P.sheet_years.values() for y in ys)
SQL["poblacion_codigo"] = with_("poblacion") + f"""select cast(y as int) anio,
  cast(n * (1000 + 7 * (y - {_base_year})) as bigint) total, cast(h * (1000 + 7 * (y - {_base_year})) as bigint) hombres,
  cast((n - h) * (1000 + 7 * (y - {_base_year})) as bigint) mujeres
from pob_region join region using (r_name), (select unnest({_code_years}) y) where r_regionkey = 3"""


# ---------------------------------------------------------------------------
# Embedded chunks and the context of every question
# ---------------------------------------------------------------------------
_DIM = 64


def emb(src: str, out: str) -> str:
    """CTEs giving ``out`` (id, v, norm) for ``src`` (id, text): signed MD5 buckets of the tokens, normed."""
    return f"""{out}_h as (select id, cast('0x' || substr(h, 1, 7) as bigint) % {_DIM} b,
    case when substr(h, 8, 1) < '8' then 1 else -1 end s
  from (select id, md5(unnest(regexp_extract_all(lower(text), '[0-9a-zà-ÿ]+'))) h from {src})),
{out}_c as (select id, b, cast(sum(s) as double) c from {out}_h group by id, b),
{out}_q as (select id, sqrt(sum(c * c)) q from {out}_c group by id),
{out}_v as (select t.id, list(cast(coalesce(c / nullif(q, 0), 0) as float) order by d.b) v
  from {src} t cross join (select unnest(range({_DIM})) b) d
  left join {out}_c x on x.id = t.id and x.b = d.b left join {out}_q n on n.id = t.id group by t.id),
{out} as materialized (select id, v, sqrt({dot('v', 'v')}) norm from {out}_v)"""


_CHUNKS = f"ch as materialized (select row_number() over () id, content as text, * from ({SQL['chunks_todos']}))"
SQL["embeber_chunks"] = f"""with {_CHUNKS}, {emb('ch', 'e')}
select chunk_type, chunk_key, cast(len(v) as int) dim, {r2('norm', 6)} norma,
  cast(len(list_filter(v, lambda x: x <> 0)) as int) no_cero,
  {r2("list_reduce(list_transform(v, lambda x: cast(x as double)), lambda x, y: x + y, 0::double)", 4)} suma
from ch join e using (id)"""


_NL = "chr(10)"


def jlist(level: int, item: str, order: str) -> str:
    """A JSON list printed with an indent of two per level, as JSON.stringify(x, null, 2) does."""
    inner, outer = "  " * (level + 1), "  " * level
    return (f"('[' || {_NL} || '{inner}' || string_agg({item}, ',' || {_NL} || '{inner}' order by {order})"
            f" || {_NL} || '{outer}]')")


def jobj(level: int, **fields) -> str:
    inner, outer = "  " * (level + 1), "  " * level
    body = f" || ',' || {_NL} || ".join(f"""'{inner}"{k}": ' || {v}""" for k, v in fields.items())
    return f"('{{' || {_NL} || {body} || {_NL} || '{outer}}}')"


_CASOS = vc("casos")
_RESUMEN = with_("fact", "coef") + f"""
, l1 as (select departamento, {jlist(1, jobj(2, **{'año': vc('anio'), 'casos': _CASOS}), 'anio')} j from cpa group by 1)
, l2 as (select departamento, {jlist(1, jobj(2, sexo=jstr('sexo'), casos=_CASOS), 'sexo')} j
    from (select departamento, sexo, count(*) casos from fact group by 1, 2) group by 1)
, l3 as (select departamento, {jlist(1, jobj(2, grupo_etario=jstr('grupo_etario'), casos=_CASOS), 'grupo_etario')} j
    from (select departamento, grupo_etario, count(*) casos from fact where grupo_etario <> '{cfg.UNKNOWN}' group by 1, 2)
    group by 1)
, l4 as (select departamento, {jlist(1, jobj(2, provincia=jstr('provincia'), casos=_CASOS), 'casos desc, provincia')} j
    from (select departamento, provincia, count(*) casos from fact group by 1, 2) group by 1)
, l5 as (select departamento, {jlist(2, jobj(3, **{
        'año': vc('anio'), 'casos': _CASOS, 'tasa': js_num('tasa', 2),
        'tasa_proyectada': js_num(r2('c.m * t.anio + c.b', 2), 2)}), 'anio')} j
    from tasa t join coef c using (departamento) where c.m is not null group by 1)
, b as (select r.r_name departamento, count(f.departamento) casos, coalesce({r2('avg(edad)', 1)}, 0::double) edad
    from region r left join fact f on f.departamento = r.r_name group by 1)
select b.departamento, {jobj(0, **{
    'departamento': jstr('b.departamento'), 'total_casos': vc('b.casos'), 'edad_promedio': js_num('b.edad', 1),
    'por_año': "coalesce(l1.j, '[]')", 'sexo': "coalesce(l2.j, '[]')", 'edad': "coalesce(l3.j, '[]')",
    'provincias': "coalesce(l4.j, '[]')",
    'tendencia': "case when k.m is null then 'null' else " + jobj(
        1, pendiente=js_num(r2('k.m', 2), 2), intercepto=js_num(r2('k.b', 2), 2),
        r_cuadrado=f"coalesce({js_num(r2('k.r2', 3), 3)}, 'null')",
        tendencia=jstr(f"(case when k.m > {cfg.TREND_THRESHOLD} then '{_UP}' when k.m < -{cfg.TREND_THRESHOLD} "
                       f"then '{_DOWN}' else '{_FLAT}' end)"),
        media_tasa=js_num("floor(media100 + 0.5::double) / 100", 2),
        desviacion=js_num("floor(sd100 + 0.5::double) / 100", 2), datos="l5.j") + " end"})} j
from b left join l1 using (departamento) left join l2 using (departamento) left join l3 using (departamento)
  left join l4 using (departamento) left join l5 using (departamento) left join coef k using (departamento)"""
_RANKING = with_("cpa") + f"""
, r as (select anio, departamento, casos from cpa
  union all select 0, departamento, cast(sum(casos) as bigint) from cpa group by departamento)
select anio, {jobj(0, ranking=jlist(1, jobj(2, departamento=jstr('departamento'), casos=_CASOS),
                                    'casos desc, departamento'))} j
from (select * from r qualify row_number() over (partition by anio order by casos desc, departamento) <= {cfg.TOP_RANKING_CONTEXT})
group by anio"""
SQL["contexto_preguntas"] = f"""with {_CHUNKS}, {emb('ch', 'e')}
, qs as materialized (select pregunta_id id, texto as text, * from ({SQL['detectar_filtros']})), {emb('qs', 'qe')}
, cm as (select id, content, e.v, e.norm, json_extract_string(metadata_json, '$.departamento') dep,
    cast(json_extract_string(metadata_json, '$."año"') as int) yr from ch join e using (id))
, s0 as (select qs.id, cm.content, {dot('cm.v', 'qe.v')} / nullif(cm.norm * qe.norm, 0::double) s,
    coalesce(cm.dep = qs.departamento, false) same_dep, coalesce(cm.yr = qs.anio, false) same_year
  from cm, qs join qe using (id))
, s1 as (select id, content, case when same_dep then s * {cfg.REGION_BOOST}::double else s end s, same_year from s0)
, s2 as (select id, content, case when same_year then s * {cfg.YEAR_BOOST}::double else s end s from s1 where s is not null)
, top as (select id, content, row_number() over (partition by id order by s desc, content) pos from s2
    qualify pos <= {cfg.TOP_K})
, ctx as (select id, count(*) n, string_agg(content, chr(10) || chr(10) order by pos) c from top group by id)
, rs as ({_RESUMEN}), rk as ({_RANKING})
select q.pregunta_id, q.departamento, q.anio, cast(coalesce(ctx.n, 0) as int) n_chunks,
  replace(replace('{cfg.PROMPT_TEMPLATE}', '{cfg.CONTEXT_PLACEHOLDER}', coalesce(nullif(ctx.c, ''), '{cfg.NO_CONTEXT}')),
    '{cfg.SQL_PLACEHOLDER}', case when q.departamento is not null then rs.j
      else coalesce(rk.j, {jobj(0, ranking="'[]'")}) end) prompt
from qs q left join ctx on ctx.id = q.id left join rs on rs.departamento = q.departamento
  left join rk on rk.anio = coalesce(q.anio, 0)"""


def oracle_sql() -> dict:
    return dict(SQL)
