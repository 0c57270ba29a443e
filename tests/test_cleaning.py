"""Functions, source cleaning, reference dimensions and quality."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from atalaya import functions as A
from atalaya.operators import panel as P, quality
from atalaya.sources import events as E, readers as R
from atalaya.sources.catalog import CATALOG, SourceSpec, response_categories

SPEC_A = SourceSpec("homicidios", "A", "HOMICIDIO")
SPEC_B = SourceSpec("hurto_modalidades", "B", "HURTO_OTRAS_MODALIDADES", "dmy")


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def frame(spark, rows):
    names = sorted({k for r in rows for k in r})
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} string" for n in names))


@pytest.mark.parametrize("text,want", [
    ("Manizales (CT)", "MANIZALES"), ("BOGOTÁ D.C.", "BOGOTA D.C."), (None, "NO REPORTADO"), ("", "NO REPORTADO"),
    ("nan", "NO REPORTADO"), ("  san   josé ", "SAN JOSE"), ("ﬁn ½", "FIN 12"), ("(CT)", "NO REPORTADO"),
    ("\tBogotá\n", "BOGOTA"), ("\u00a0Bogotá\u00a0", "BOGOTA"), ("\n \t", "NO REPORTADO"), ("x\U0001f130\U0001fbf1", "XA1")])
def test_norm_text(spark, text, want):
    assert one(spark, A.norm_text(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("text,fmt,want", [
    ("10/03/2026", "dmy", datetime(2026, 3, 10)), ("2003-01-01T00:00:00.000", "iso", datetime(2003, 1, 1)),
    ("2003-01-01", "dmy", datetime(2003, 1, 1)), ("fecha-mala", "dmy", None), ("fecha-mala", "iso", None)])
def test_parse_dates(spark, text, fmt, want):
    assert one(spark, A.parse_dates(F.lit(text), fmt)) == want


def test_strip_marks_of_composed_kana(spark):
    assert one(spark, A.strip_marks(F.lit("ガぎ Ñandú"))) == "カき nandu"


@pytest.mark.parametrize("text,want", [
    ("4,649251", 4.649251), ("-74,106992", -74.106992), ("-75,581,775", -75.581775), ("6,246,631", 6.246631),
    (None, None), ("", None), ("nan", None), ("4,5f", None), ("181,5", None)])
def test_parse_coord(spark, text, want):
    assert one(spark, A.parse_coord(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("text,family,want", [
    ("17001000", "B", "17001"), ("5001", "A", "05001"), ("00000", "A", None), ("123456", "A", None), ("", "A", None)])
def test_territory_code(spark, text, family, want):
    assert one(spark, A.territory_code(F.lit(text), family)) == want


def test_small_functions(spark):
    assert one(spark, A.fmt_thousands(F.lit(23029390))) == "23.029.390"
    assert one(spark, A.fmt_pct(F.lit(8.51))) == "8,51 %"
    assert one(spark, A.category_canon(F.lit("ARTICULO 239. HURTO MOTOCICLETAS"))) == "HURTO_MOTOCICLETAS"
    assert [one(spark, A.parse_quantity(F.lit(t))) for t in ("2.7", "x", "-3", "4", "2d", " 5\t", "1e2", "nan")] == [2, 1, 0, 4, 1, 5, 100, 1]
    stages = ["Indagación", "Investigación", "Juicio", "Ejecución De Penas", "Sin Información"]
    assert [one(spark, A.stage_class(F.lit(s))) for s in stages] == [
        "indagacion", "judicializado", "judicializado", "judicializado", "desconocido"]
    assert [one(spark, A.stage_order(F.lit(s))) for s in stages] == [0, 1, 2, 3, 4]
    assert one(spark, A.region_name(F.lit("05"))) == "Antioquia"
    assert one(spark, A.region_name(F.lit("02"))) is None


def test_family_a(spark):
    raw = frame(spark, [dict(fecha_hecho="2003-01-01T00:00:00.000", cod_depto="11", departamento="BOGOTA D.C.",
                             cod_muni="11001", municipio="BOGOTA D.C.", zona="URBANA", sexo="MASCULINO", cantidad="1")])
    row = E.normalize_events(raw, SPEC_A).first()
    assert (row.cod_municipio, row.anio, row.mes, row.categoria, row.cantidad) == ("11001", 2003, 1, "HOMICIDIO", 1)
    assert (row.cod_departamento, row.arma_medio) == ("11", "NO REPORTADO")


def test_family_b(spark):
    raw = frame(spark, [dict(departamento="CALDAS", municipio="Manizales (CT)", codigo_dane="17001000", genero="FEMENINO",
                             armas_medios="SIN EMPLEO DE ARMAS", fecha_hecho="10/03/2026", cantidad="2"),
                        dict(departamento="CALDAS", municipio="Manizales", codigo_dane="17001000", fecha_hecho="fecha-mala")])
    rows = E.normalize_events(raw, SPEC_B).collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row.cod_municipio, row.cod_departamento, row.municipio) == ("17001", "17", "MANIZALES")
    assert (row.anio, row.mes, row.sexo, row.cantidad, row.categoria) == (2026, 3, "FEMENINO", 2, "HURTO_OTRAS_MODALIDADES")


def test_synonyms_and_types(spark):
    raw = frame(spark, [dict(municipio_hecho="Soacha", codigo_dane="25754000", fecha_hecho="01/02/2020", tipo_de_hurto="HURTO ABIGEATO")])
    row = E.normalize_events(raw, SPEC_B).first()
    assert (row.municipio, row.cod_municipio, row.categoria) == ("SOACHA", "25754", "HURTO_ABIGEATO")


def test_repeated_rows_are_facts(spark):
    same = dict(fecha_hecho="2020-01-01", cod_muni="11001", municipio="BOGOTÁ", cantidad="1")
    raw = frame(spark, [same, same, {**same, "municipio": "OTRA"}])
    events = E.build_events({"homicidios": raw}, CATALOG)
    assert events.count() == 3 and events.agg(F.sum("cantidad")).first()[0] == 3
    assert quality.provenance(quality.raw_counts({"homicidios": raw}), events).first().descartadas_pct == 0.0
    dup = quality.duplicate_share(events).first()
    assert dup.filas_repetidas_pct == 33.3
    assert "CAPTURAS" in response_categories()


def test_missing_catalog_sources(spark):
    with pytest.raises(ValueError):
        E.build_events({}, CATALOG)


def test_population_sheet(spark):
    rows = [(0, ["x"]), (1, ["", "y"]), (2, ["DP", "DPNOM", "DPMP", "MPIO", "AÑO", "ÁREA GEOGRÁFICA", "Población"]),
            (3, ["05", "A", "M", "5001", "2020", "Total", "150"]), (4, ["05", "A", "M", "5001", "2020", "Cabecera", "100"]),
            (5, ["05", "A", "M", "5001", "2021", "Total", "160"]), (6, ["00", "A", "M", "00000", "2020", "Total", "9"])]
    cells = spark.createDataFrame(rows, "row_id bigint, cells array<string>")
    got = sorted(tuple(r) for r in R.parse_population(cells).collect())
    assert got == [("05001", 2020, 150), ("05001", 2021, 160)]


def test_population_clip(spark):
    panel = spark.createDataFrame([("05001", 2003), ("05001", 2005), ("05001", 2030)], "cod_municipio string, anio bigint")
    people = spark.createDataFrame([("05001", 2005, 100), ("05001", 2006, 110)], "cod_municipio string, anio bigint, poblacion bigint")
    got = sorted((r.anio, r.poblacion) for r in P.attach_population(panel, people).collect())
    assert got == [(2003, 100.0), (2005, 100.0), (2030, 110.0)]


def test_reference_prefers_head_town(spark):
    raw = spark.createDataFrame(
        [("05001", "5", "AAA", "ANT", "1,0", "-2,0", "CP"), ("05001", "5", "MEDELLÍN", "ANT", "6,246,631", "-75,581,775", "CM")],
        "codigo_municipio string, codigo_departamento string, nombre_municipio string, nombre_departamento string, "
        "latitud string, longitud string, tipo_centro_poblado string")
    row = R.territory_reference(raw).first()
    assert (row.municipio, row.lat, row.lon, row.cod_departamento) == ("MEDELLÍN", 6.246631, -75.581775, "05")


def test_quality(spark):
    df = spark.createDataFrame([("11001", "NO REPORTADO"), ("11001", "NO REPORTADO"), ("05001", "M"), ("05001", "F")],
                               "cod_municipio string, sexo string").withColumn("zona", F.lit("URBANA"))
    assert {r.columna: r.completitud_pct for r in quality.completeness(df).collect()}["sexo"] == 100.0
    assert [(r.columna, r.placeholder_pct) for r in quality.placeholder_share(df).collect()] == [("sexo", 50.0)]


def test_fingerprint_ignores_order_and_counts_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "a int, b string")
    c = a.unionByName(a)
    h = [R.lineage(d, "s").first().content_hash for d in (a, b, c)]
    assert h[0] == h[1] and h[2] != h[0] and h[2] != "0"


def test_nature_and_summary(spark):
    rows = [("11001", "B", "D", c, q, 2020, datetime(2020, 1, 5)) for c, q in (
        ("HOMICIDIO", 3), ("HURTO_PERSONAS", 5), ("CAPTURAS", 7), ("INCAUTACION_ARMAS", 2))]
    events = spark.createDataFrame(rows, "cod_municipio string, municipio string, departamento string, categoria string, "
                                         "cantidad bigint, anio bigint, fecha timestamp").withColumn("cod_departamento", F.lit("11"))
    row = P.territory_summary(events, response_categories()).first()
    assert (row.categorias, row.total_delitos, row.total_respuestas, row.total_hechos) == (2, 8, 9, 17)
    panel = P.monthly_series(events, response_categories())
    assert {r.categoria: r.naturaleza for r in panel.collect()}["CAPTURAS"] == "respuesta"


def test_fill_months_inside_own_range(spark):
    rows = [("a", datetime(2020, 1, 9), 2), ("a", datetime(2020, 4, 1), 1), ("b", datetime(2021, 6, 1), 5), (None, datetime(2020, 1, 1), 1),
            (None, datetime(2020, 3, 1), 1)]
    events = spark.createDataFrame(rows, "k string, fecha timestamp, cantidad bigint")
    cells = P.monthly_counts(events, ["k"])
    got = sorted((r.k or "", str(r.periodo), r.cantidad) for r in P.fill_months(cells, ["k"]).collect())
    assert got == [("", "2020-01-01", 1), ("", "2020-02-01", 0), ("", "2020-03-01", 1), ("a", "2020-01-01", 2), ("a", "2020-02-01", 0),
                   ("a", "2020-03-01", 0), ("a", "2020-04-01", 1), ("b", "2021-06-01", 5)]
