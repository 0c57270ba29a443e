"""Labels, thresholds, word lists and lookup tables that results depend on."""

from __future__ import annotations

# ---- Fixed values: schema -------------------------------------------------------------------
UNIFIED_COLUMNS = [
    "fecha", "anio", "mes", "cod_departamento", "departamento", "cod_municipio", "municipio",
    "zona", "categoria", "arma_medio", "sexo", "grupo_etario", "cantidad", "fuente", "ingested_at",
]
SERIES_KEY = ["cod_municipio", "categoria"]
PANEL_KEY = ["cod_departamento", "departamento", "cod_municipio", "municipio", "categoria"]

# ---- Fixed values: labels -------------------------------------------------------------------
PLACEHOLDER = "NO REPORTADO"
CRIME, RESPONSE = "delito", "respuesta"
ADVANCED, INQUIRY, UNKNOWN_STAGE = "judicializado", "indagacion", "desconocido"
NO_TITLE = "Sin información"
HIGH, MEDIUM = "ALTA", "MEDIA"
GREEN, YELLOW, RED = "verde", "amarillo", "rojo"

# ---- Fixed values: stage stems, in chain order ----------------------------------------------
STAGE_CHAIN = ["indagaci", "investigaci", "juicio", "ejecuci"]

# ---- Fixed values: thresholds ---------------------------------------------------------------
MIN_YEAR_EVENTS = 1990
FUNNEL_YEARS = (2003, 2026)
MIN_KNOWN_TITLE = 10_000
MIN_KNOWN_TERRITORY = 5_000
LAGS = [1, 2, 3, 6, 12]
ROLL_WINDOWS = [3, 6, 12]
HIST_WINDOW = 60
MIN_HISTORY = 18
MIN_NONZERO = 12
Z_THRESHOLD = 3.5
Z_HIGH = 5.0
CONTAMINATION = 0.03
MAD_TO_SIGMA = 0.6745
MEANAD_TO_SIGMA = 0.7979
FALLBACK_SIGMA_FLOOR = 1.0
RATE_SCALE = 100_000.0
BLEND = 0.7
BAND_LEVEL = 0.8
PSI_MODERATE, PSI_SIGNIFICANT, PSI_EPS = 0.1, 0.25, 1e-6
LAG_WARN, LAG_BAD, LAG_STALE = 3, 6, 6
MIN_POPULATION_COVERAGE = 95.0
CHUNK_SIZE, CHUNK_OVERLAP = 800, 150
TOP_K, MIN_SCORE = 5, 0.25
FUZZY_MIN_LEN, FUZZY_CUTOFF, FUZZY_MARGIN = 5, 0.82, 0.03
TOKEN_MIN_LEN = 4
YEAR_RANGE = (1990, 2040)

# ---- Fixed values: forecast intent stems ----------------------------------------------------
FORECAST_STEMS = [
    "pronostic", "predic", "proyec", "futuro", "proxim", "próxim", "tendenc", "espera",
]

# ---- Fixed values: ordered keyword -> category fragment -------------------------------------
CATEGORY_HINTS = [
    ("homicid", "HOMICIDIO"),
    ("hurto", "HURTO"),
    ("amenaz", "AMENAZAS"),
    ("intrafamiliar", "VIOLENCIA_INTRAFAMILIAR"),
    ("violencia", "VIOLENCIA_INTRAFAMILIAR"),
    ("captur", "CAPTURAS"),
    ("arma", "INCAUTACION_ARMAS"),
    ("recuper", "RECUPERACION_VEHICULOS"),
    ("moto", "HURTO MOTOCICLETAS"),
    ("vehic", "HURTO AUTOMOTORES"),
    ("carro", "HURTO AUTOMOTORES"),
]

# ---- Fixed values: refusal phrases (unaccented, lower case) ---------------------------------
REFUSAL_PHRASES = [
    "no encontre informacion",
    "no he encontrado informacion",
    "no encontre datos",
    "no puedo",
    "no pude encontrar",
    "no dispongo",
    "no tengo informacion",
    "no cuento con",
    "fuera del alcance",
    "fuera de mi alcance",
    "solo puedo responder",
    "no esta en los datos",
    "no reconoci el municipio",
    "no reconozco el municipio",
    "no se reconoc",
    "no logre identificar",
    "no se pudo obtener",
    "no puede ser proporcionad",
    "no puede ser respondid",
    "no se puede proporcionar",
    "no esta dentro del ambito",
    "no incluye",
    "no contiene",
    "no menciona",
    "mi funcion",
    "seguridad y justicia en colombia",
    "seguridad ciudadana y justicia",
]

# ---- Fixed values: pattern of whole numbers with optional thousands separators --------------
INTEGER_PATTERN = r"\b\d{1,3}(?:[.,\s]\d{3})+\b|\b\d+\b"

# ---- Fixed values: searchable region names by two-digit code --------------------------------
REGION_NAMES = {
    "05": "Antioquia", "08": "Atlántico", "11": "Bogotá", "13": "Bolívar", "15": "Boyacá",
    "17": "Caldas", "18": "Caquetá", "19": "Cauca", "20": "Cesar", "23": "Córdoba",
    "25": "Cundinamarca", "27": "Chocó", "41": "Huila", "44": "La Guajira", "47": "Magdalena",
    "50": "Meta", "52": "Nariño", "54": "Norte de Santander", "63": "Quindío",
    "66": "Risaralda", "68": "Santander", "70": "Sucre", "73": "Tolima",
    "76": "Valle del Cauca", "81": "Arauca", "85": "Casanare", "86": "Putumayo",
    "88": "San Andrés y Providencia", "91": "Amazonas", "94": "Guainía", "95": "Guaviare",
    "97": "Vaupés", "99": "Vichada",
}

# ---- Fixed values: out-of-scope probe questions ---------------------------------------------
OUT_OF_SCOPE = [
    ("fuera_capital", "¿Cuál es la capital de Francia?"),
    ("fuera_receta", "Dame una receta de sancocho de gallina."),
    ("fuera_elecciones", "¿Quién va a ganar las próximas elecciones presidenciales?"),
    ("fuera_dolar", "¿A cuánto está el dólar hoy?"),
    ("fuera_poema", "Escríbeme un poema sobre el mar."),
    ("fuera_futbol", "¿Cómo quedó el partido de la selección Colombia?"),
    ("fuzzy_inexistente", "¿Cuántos homicidios hay en San Quimero del Sur?"),
]
