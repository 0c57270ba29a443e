"""Funnel, corpus, matching, retrieval and answers."""

import difflib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from atalaya.operators import answers as ANS, corpus, funnel, matching as MT, retrieval

NAMES = [("11001", "BOGOTÁ, D.C.", "BOGOTÁ"), ("05001", "MEDELLÍN", "ANTIOQUIA"), ("76001", "SANTIAGO DE CALI", "VALLE"),
         ("54001", "SAN JOSÉ DE CÚCUTA", "NORTE")]
EXTRA = [("86568", "SANTIAGO", "PUTUMAYO"), ("70820", "SANTIAGO DE TOLÚ", "SUCRE")]
CUBE = [("11001", "2024", "Indagación", "100", "T1"), ("11001", "2024", "Juicio", "25", "T1"), ("11001", "2024", "Ejecución De Penas", "25", ""),
        ("05001", "2024", "Indagación", "80", "T2"), ("05001", "2024", "Investigación", "20", "T2"),
        ("11001", "Sin Información", "Juicio", "999", "T2"), ("00000", "2024", "Indagación", "999", "T2")]


def names(spark, extra=()):
    return spark.createDataFrame(NAMES + list(extra), "cod_municipio string, municipio string, departamento string")


def ask(spark, text, extra=()):
    q = spark.createDataFrame([(1, text)], "id int, texto string")
    row = MT.resolve(q, names(spark, extra)).first()
    return row and row.cod_municipio


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(CUBE, "cod_dane_hecho string, a_o_hecho string, etapa string, n_procesos string, titulo_delito string")


def test_funnel(raw):
    cube = funnel.funnel_cube(raw)
    d = funnel.funnel_discards(raw).first()
    assert (d.procesos_bronze, d.procesos_gold, d.sin_municipio_valido, d.anio_invalido_o_fuera_de_rango, d.descartados_pct) == (
        2248, 250, 999, 999, 88.88)
    assert [r.n_procesos for r in funnel.funnel_stage(cube).collect()] == [180, 20, 25, 25]
    year = funnel.funnel_rate(cube, "year").first()
    assert (year.anio, year.procesos_etapa_conocida, year.tasa_judicializacion_pct) == (2024, 250, 28.0)
    titles = {r.titulo_delito: r.total_procesos for r in funnel.funnel_rate(cube, "title").collect()}
    assert titles == {"T1": 125, "Sin información": 25, "T2": 100}
    assert funnel.funnel_cube(raw.drop("titulo_delito")).count() == 5


@pytest.mark.parametrize("text,want", [
    ("¿Cuántos hurtos en medellin?", "05001"), ("homicidios en Cali", "76001"), ("Cúcuta", "54001"), ("en todo el país", None),
    ("¿Qué pasa en Medallin?", "05001"), ("Bogata", "11001"), ("Wakanda", None), ("Springfield", None)])
def test_resolution(spark, text, want):
    assert ask(spark, text) == want


def test_phrase_beats_ambiguous_token(spark):
    assert ask(spark, "hurtos en Santiago de Cali", EXTRA) == "76001"
    assert ask(spark, "hurtos en Santiago", EXTRA) == "86568"
    assert ask(spark, "el valle de tolu", EXTRA) == "70820"


@pytest.mark.parametrize("text,want", [("homicidios en x", "HOMICIDIO"), ("robo de carros", "HURTO AUTOMOTORES"), ("el clima", None),
                                       ("asaltos", None)])
def test_category_hint(spark, text, want):
    cats = F.array(*[F.lit(c) for c in ("AMENAZAS", "HOMICIDIO", "HURTO AUTOMOTORES")])
    assert spark.range(1).select(MT.match_category(F.lit(text), cats).alias("c")).first().c == want


@pytest.mark.parametrize("kind", ["gestalt", "levenshtein"])
@pytest.mark.parametrize("cutoff", [0.82, 0.7])
def test_similar_tokens_equals_all_pairs(spark, kind, cutoff):
    rnd = random.Random(7)
    base = ["".join(rnd.choice("ABCDE") for _ in range(rnd.randint(5, 12))) for _ in range(40)]

    def mutate(t):
        t = list(t)
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(t))
            rnd.choice([lambda: t.pop(i), lambda: t.insert(i, rnd.choice("ABCDE")), lambda: t.__setitem__(i, "F")])()
            if not t:
                t.append("A")
        return "".join(t)

    asked = sorted({m for b in base for m in (mutate(b), mutate(b)) if len(m) >= 5})
    known = sorted(set(base))

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return 1 - row[-1] / max(len(a), len(b))

    ratio = (lambda q, n: difflib.SequenceMatcher(None, n, q).ratio()) if kind == "gestalt" else lev
    want = {(q, n) for q, n in itertools.product(asked, known) if ratio(q, n) >= cutoff}
    q = spark.createDataFrame([(a,) for a in asked], "q_token string")
    n = spark.createDataFrame([(a,) for a in known], "n_token string")
    got = {(r.q_token, r.n_token) for r in MT.similar_tokens(q, n, cutoff, kind).collect()}
    assert got == want and len(want) > 20


@pytest.mark.parametrize("kind", ["gestalt", "levenshtein"])
def test_candidates_grow_with_the_tokens(spark, kind):
    """Of two vocabularies of unrelated tokens few pairs are candidates, however long the tokens' lists are."""
    rnd = random.Random(3)
    known = {"".join(rnd.choices("ABCDEFGHIJKLMNOP", k=8)) for _ in range(2000)}
    asked = {"".join(rnd.choices("ABCDEFGHIJKLMNOP", k=rnd.choice([7, 8]))) for _ in range(2000)} | {n[:3] + n[4:] for n in known}
    q, n = (spark.createDataFrame([(t,) for t in sorted(x)], f"{name} string") for x, name in ((asked, "q_token"), (known, "n_token")))
    pairs = MT.candidate_tokens(q, n, kind=kind)
    assert len(known) <= pairs.count() < 1.1 * len(known)
    assert MT.similar_tokens(q, n, kind=kind).count() >= len(known)


def test_long_tokens_equal_all_pairs(spark):
    """Tokens of 20 to 60 characters, with too many variants for most pairs."""
    rnd = random.Random(9)
    known = ["".join(rnd.choices("ABCDE", k=n)) for n in (20, 21, 24, 30, 41, 60)]
    asked = known + ["".join(rnd.choice("ABCDE") if rnd.random() < 0.12 else c for c in t if rnd.random() > 0.05) for t in known for _ in range(8)]
    want = {(q, n) for q, n in itertools.product(asked, known) if difflib.SequenceMatcher(None, n, q).ratio() >= 0.82}
    q, n = (spark.createDataFrame([(t,) for t in x], f"{name} string") for x, name in ((asked, "q_token"), (known, "n_token")))
    assert {(r.q_token, r.n_token) for r in MT.similar_tokens(q, n).collect()} == want and len(want) > 12


def test_chunks(spark):
    df = spark.createDataFrame([(1, ""), (2, "hola   \n\n  mundo\t y  más"), (3, "palabra " * 400), (4, "x y"), (5, "a" * 800)], "id int, text string")
    rows = corpus.chunk(df).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.id, r.n)):
        by.setdefault(r.id, []).append(r.content)
    assert 1 not in by and by[2] == ["hola mundo y más"] and by[4] == ["x y"] and by[5] == ["a" * 800]
    flat = " ".join(("palabra " * 400).split())
    assert len(by[3]) > 1 and all(len(c) <= 800 for c in by[3]) and flat.endswith(by[3][-1])
    want, start = [], 0
    while True:
        want.append(flat[start:start + 800].strip())
        if start + 800 >= len(flat):
            break
        start += 650
    assert by[3] == want


def test_answers(spark):
    def ev(c):
        return spark.range(1).select(c.alias("x")).first().x

    assert ev(ANS.extract_integers(F.lit("23\u00a0029\u00a0390; " + "9" * 45 + " y ٣٤"))) == ["23029390", "9" * 45, "34"]
    assert not ev(ANS.invents_figures(F.lit("1\u00a0999 y 2024"))) and ev(ANS.invents_figures(F.lit("9" * 45)))
    ints = {int(x) for x in ev(ANS.extract_integers(F.lit("De 23.029.390 procesos, 13,555 casos y 97 en 2024; 8,51 %")))}
    assert {23029390, 13555, 97, 2024} <= ints and 851 not in ints
    assert ev(ANS.contains_decimal(F.lit("es 8,51 %"), F.lit(8.51))) and not ev(ANS.contains_decimal(F.lit("es 851"), F.lit(8.51)))
    assert ev(ANS.is_abstention(F.lit("No encontré información")))
    assert not ev(ANS.is_abstention(F.lit("En Bogotá se registraron 97 homicidios en mayo.")))
    assert ev(ANS.invents_figures(F.lit("hubo 4500"))) and not ev(ANS.invents_figures(F.lit("datos a 2026, 97")))


def test_integers_of_odd_documents_equal_sql(spark, tmp_path):
    """Accents and other scripts beside digits, control characters, numbers around 128 bits, null and long texts."""
    import __spark_entry__ as entry
    import duckdb

    rng = random.Random(5)
    texts = ["".join(rng.choices("1234506 .,_aé\u00a0\x0b\x85\u0663\u2028\n\t$", k=rng.randrange(40))) for _ in range(500)]
    texts += [None, "", "é5 5é 1\u00a0234", "1\x0b234", "٣٤", str((1 << 127) - 1) + " 7", str(1 << 127) + " 7", "0" * 45 + "5", "1" + " 234" * 100000 + "x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in entry.queries()["extract_integers_documents"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = set(con.execute(entry.oracle_sql()["extract_integers_documents"]).fetchall())
    assert got == want


def test_topk_in_blocks_equals_numpy(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(60, 8)).astype("float32")
    vectors[5] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")
    queries = df.withColumnRenamed("vec_id", "query_id")
    odd = spark.createDataFrame([(900, None), (901, [1.0, None]), (902, [1.0] * 3), (None, [1.0] * 8)], df.schema)
    # No query vector may pass through the driver.
    monkeypatch.setattr(type(df), "toArrow", None)
    hits = retrieval.vector_topk(queries, df.unionByName(odd).repartition(5), 3, query_block=16, lanes=4)
    got = {(r.query_id, r.puesto): r.vec_id for r in hits.collect()}
    norm = np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    unit = np.divide(vectors.astype(float), norm, out=np.zeros(vectors.shape), where=norm > 0)
    sims = unit @ unit.T
    for q in range(60):
        order = sorted(range(60), key=lambda c: (-round(sims[q, c], 12), c))[:3]
        assert [got[(q, k + 1)] for k in range(3)] == order


def test_threshold_abstains(spark):
    hits = spark.createDataFrame([(1, 1, 9, 0.25), (2, 1, 9, 0.249)], "query_id int, puesto int, vec_id int, score double")
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    got = {r.query_id: r.abstiene for r in retrieval.threshold(q, hits).collect()}
    assert got == {1: False, 2: True}
