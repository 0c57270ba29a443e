"""Named queries with declared arguments, for callers that send a name and a dictionary.

A call never raises for what the caller sent: an unknown name, a wrong or missing argument or an
absent table comes back as a message. What is returned otherwise is a lazy table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from atalaya.operators import anomaly, features, funnel, matching, retrieval

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Argument:
    kind: type
    required: bool = True
    low: int | None = None
    high: int | None = None

    def schema(self) -> dict[str, Any]:
        out: dict[str, Any] = {"type": {str: "string", int: "integer", list: "array"}[self.kind]}
        return out | {k: v for k, v in (("minimum", self.low), ("maximum", self.high)) if v is not None}

    def read(self, value: Any) -> Any:
        """The value in its kind, numbers clipped to their range; raises ValueError if it has another kind."""
        if self.kind is int:
            number = int(value)
            return max(self.low or number, min(self.high or number, number))
        if not isinstance(value, self.kind):
            raise ValueError(f"expected {self.schema()['type']}")
        return value


@dataclass(frozen=True)
class NamedQuery:
    about: str
    arguments: dict[str, Argument]
    tables: tuple[str, ...]
    build: Callable[..., DataFrame]

    def schema(self) -> dict[str, Any]:
        """The arguments as a JSON schema."""
        return {"type": "object", "properties": {n: a.schema() for n, a in self.arguments.items()},
                "required": [n for n, a in self.arguments.items() if a.required]}


@dataclass(frozen=True)
class Answer:
    rows: DataFrame | None = None
    error: str | None = None


def _resolve(tables: Tables, text: str) -> DataFrame:
    asked = tables["names"].sparkSession.createDataFrame([(1, text)], "id int, texto string")
    return matching.resolve(asked, tables["names"], tables["panel"]).drop("id")


def _forecast(tables: Tables, code: str, category: str, months: int = 6) -> DataFrame:
    rows = tables["forecasts"].where((F.col("cod_municipio") == code) & (F.col("categoria") == category))
    return rows.where(F.col("paso") <= months).orderBy("paso")


def _recent(tables: Tables, code: str, category: str, months: int = 12) -> DataFrame:
    return features.latest_n(tables["panel"], code, category, months)


def _alerts(tables: Tables, code: str) -> DataFrame:
    return anomaly.latest_anomalies(tables["anomalies"].where(F.col("cod_municipio") == code))


def _funnel(tables: Tables, code: str | None = None) -> DataFrame:
    return funnel.funnel_lookup(tables["rates"], code, None if code else tables["titles"])


def _passages(tables: Tables, vector: list) -> DataFrame:
    asked = tables["corpus"].sparkSession.createDataFrame([(1, [float(x) for x in vector])], "query_id int, embedding array<double>")
    hits = retrieval.vector_topk(asked, tables["corpus"])
    return retrieval.threshold(asked, hits).drop("query_id")


CODE, CATEGORY = Argument(str), Argument(str)
NAMED: dict[str, NamedQuery] = {
    "resolve_territory": NamedQuery("Code of the territory that a text names, with its categories.", {"text": Argument(str)},
                                    ("names", "panel"), _resolve),
    "forecast": NamedQuery("Next months of one series with their band.",
                           {"code": CODE, "category": CATEGORY, "months": Argument(int, False, 1, 12)}, ("forecasts",), _forecast),
    "recent_months": NamedQuery("Last months of one series.", {"code": CODE, "category": CATEGORY, "months": Argument(int, False, 1, 60)},
                                ("panel",), _recent),
    "alerts": NamedQuery("Newest alerts of one territory.", {"code": CODE}, ("anomalies",), _alerts),
    "funnel": NamedQuery("Stage rates of one territory, or of the country with its extreme titles.", {"code": Argument(str, False)},
                         ("rates", "titles"), _funnel),
    "passages": NamedQuery("Passages nearest to a vector, or an abstaining row.", {"vector": Argument(list)}, ("corpus",), _passages),
}


def call(tables: Tables, name: str, arguments: Mapping[str, Any] | None = None) -> Answer:
    query = NAMED.get(name)
    if query is None:
        return Answer(error=f"unknown query: {name}")
    arguments = dict(arguments or {})
    extra = sorted(set(arguments) - set(query.arguments))
    missing = sorted(n for n, a in query.arguments.items() if a.required and arguments.get(n) is None)
    absent = sorted(t for t in query.tables if t not in tables)
    for problem, found in (("unexpected arguments", extra), ("missing arguments", missing), ("absent tables", absent)):
        if found:
            return Answer(error=f"{problem} for {name}: {', '.join(found)}")
    try:
        read = {n: query.arguments[n].read(v) for n, v in arguments.items() if v is not None}
        return Answer(rows=query.build(tables, **read))
    except (TypeError, ValueError, PySparkException) as problem:
        return Answer(error=f"{name} could not be answered: {problem}")
