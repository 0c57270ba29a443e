"""Declarative catalog of sources: add a source by adding an entry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from atalaya.constants import CRIME, RESPONSE


@dataclass(frozen=True)
class SourceSpec:
    """`family` A carries a five-digit code, B an eight-digit one."""

    id: str
    family: str
    category: str
    date_format: str = "iso"
    nature: str = CRIME
    is_event: bool = True


@dataclass(frozen=True)
class GroupedSpec:
    """A source too large to keep raw: only counts per group are stored."""

    id: str
    group_cols: tuple[str, ...]
    count_as: str


# ---- Fixed values: event sources ------------------------------------------------------------
CATALOG = [
    SourceSpec("homicidios", "A", "HOMICIDIO"),
    SourceSpec("hurto_vehiculos", "A", "HURTO_VEHICULOS"),
    SourceSpec("violencia_intrafamiliar", "B", "VIOLENCIA_INTRAFAMILIAR", "dmy"),
    SourceSpec("amenazas", "B", "AMENAZAS", "dmy"),
    SourceSpec("reporte_capturas", "B", "CAPTURAS", "dmy", RESPONSE),
    SourceSpec("incautacion_armas", "B", "INCAUTACION_ARMAS", "dmy", RESPONSE),
    SourceSpec("recuperacion_vehiculos", "B", "RECUPERACION_VEHICULOS", "dmy", RESPONSE),
    SourceSpec("hurto_modalidades", "B", "HURTO_OTRAS_MODALIDADES", "dmy"),
    SourceSpec("hurto_personas", "A", "HURTO_PERSONAS"),
    SourceSpec("hurto_residencias", "A", "HURTO_RESIDENCIAS"),
    SourceSpec("delitos_sexuales", "A", "DELITOS_SEXUALES"),
    SourceSpec("extorsion", "A", "EXTORSION"),
    SourceSpec("secuestro", "A", "SECUESTRO"),
    SourceSpec("delitos_informaticos", "A", "DELITOS_INFORMATICOS"),
    SourceSpec("terrorismo", "A", "TERRORISMO"),
    SourceSpec("trata_personas", "A", "TRATA_DE_PERSONAS"),
]

# ---- Fixed values: administrative and reference sources -------------------------------------
ADMIN_CATALOG = [
    SourceSpec("auditorias", "admin", "AUDITORIAS", is_event=False),
    SourceSpec("demandas_notificadas", "admin", "DEMANDAS", is_event=False),
]
REFERENCE = SourceSpec("divipola", "reference", "REFERENCIA", is_event=False)

# ---- Fixed values: the grouped process source -----------------------------------------------
PROCESSES = GroupedSpec("justicia_procesos",
                        ("cod_dane_hecho", "etapa", "a_o_hecho", "titulo_delito"), "n_procesos")


def response_categories(catalog: list[SourceSpec] = CATALOG) -> list[str]:
    return sorted({s.category for s in catalog if s.nature == RESPONSE})


def catalog_frame(spark: SparkSession, catalog: list[SourceSpec]) -> DataFrame:
    """The catalog as a table; its size is the number of entries in the code."""
    rows = [(s.id, s.family, s.date_format, s.category, s.nature) for s in catalog]
    return spark.createDataFrame(
        rows, "fuente string, familia string, formato_fecha string, categoria string, "
              "naturaleza string")


@dataclass(frozen=True)
class AdminRecipe:
    """How a source without events is summed up: its date column and (column, label, how many values)."""

    about: str
    date: str
    dims: tuple[tuple[str, str, int], ...]


# Columns and labels of the breakdowns.
ADMIN_RECIPES = {
    "auditorias": AdminRecipe("Auditorías internas y de control de gestión; no es una serie de delitos.", "fecha_inicial", (
        ("tipo", "origen", 5), ("tipo_auditoria", "modalidad", 6), ("unidad", "unidad auditada", 5))),
    "demandas_notificadas": AdminRecipe("Litigios notificados contra la entidad; no es una serie de delitos.", "fecha_de_admisi_n", (
        ("tipo_de_demanda", "tipo de demanda", 3), ("unidad_de_defensa_judical", "unidad de defensa judicial", 5),
        ("despacho_judicial", "despacho judicial", 5))),
}
