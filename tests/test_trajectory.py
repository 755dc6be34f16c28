import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from evidara import schemas

from evidara.operators import quality, skew
from evidara.operators.trajectory import event_summary, features
from evidara.sources.config import load_groups

GROUPS = load_groups({"version": "1", "groups": [{"id": "extincao", "label": "x", "codes": [196, 456]}, {"id": "emenda", "label": "y", "name_contains": ["emenda", "d'água"]}]})


def at(m, d, h=0):
    return dt.datetime(2024, m, d, h)


def case(number, grau, filed, organ):
    return ("tjx", number, None, grau, f"{number}-{grau}", filed, 0, "7", "c", organ, None, 1, None, None, "1;2", None, 0, None, None, None)


def move(number, ordem, code, name, stamp, organ="o1"):
    return ("tjx", number, "G1", f"{number}-G1", ordem, code, name, stamp, organ, None)


def test_features(spark):
    cases = spark.createDataFrame([case("1", "G1", at(1, 10), "o1"), case("1", "G2", at(1, 10), "o2"), case("2", "G1", dt.datetime(2571, 1, 1), "o1"), case("9", "G1", None, "o1")], schemas.CASES)
    moves = [move("1", 1, 26, "Distribuição", at(1, 10, 9)), move("1", 2, 196, "Extinção", at(2, 1), "o2"), move("1", 3, 11, "EMENDA à inicial", at(3, 11)), move("2", 1, 26, "Distribuição", at(1, 5))]
    moves += [move("9", i, c, "Extinção", at(1, d), o) for i, (c, d, o) in enumerate([(196, 1, "o1"), (196, 1, "o1"), (456, 2, "o2"), (456, 2, "o2"), (5, 3, "o1")], 1)]
    targets = spark.createDataFrame([(n, "tjx", "candidato", "2024", True, 1) for n in "1239"], schemas.TARGETS)
    rows = {r.numero_processo: r for r in features(cases, spark.createDataFrame(moves, schemas.MOVEMENTS), targets, GROUPS).collect()}
    assert len(rows) == 4
    a = rows["1"]
    assert (a.n_documentos, a.graus, a.n_orgaos_caso, a.n_movimentos, a.n_codigos_distintos, a.n_orgaos_movimento) == (2, "G1;G2", 2, 3, 3, 2)
    assert (a.dias_entre_movimentos, a.dias_desde_ajuizamento, a.n_extincao, a.n_emenda, a.nao_encontrado) == (61, 61, 1, 1, False)
    assert a.primeiro_extincao == at(2, 1)
    b, c, d = rows["2"], rows["3"], rows["9"]
    assert (b.dias_desde_ajuizamento, b.dias_entre_movimentos, b.n_movimentos) == (None, 0, 1)
    assert c.nao_encontrado and c.n_movimentos == 0 and c.data_ajuizamento is None
    assert (d.n_movimentos, d.n_codigos_distintos, d.n_orgaos_movimento, d.n_extincao) == (3, 3, 2, 2)


def test_integrity(spark):
    cases = spark.createDataFrame([case("1", "G1", None, "o")], schemas.CASES)
    moves = spark.createDataFrame([move("1", 1, 1, "a", at(2, 1)), move("1", 2, 1, "b", at(1, 1)), move("8", 1, 1, "c", at(1, 1))], schemas.MOVEMENTS)
    targets = spark.createDataFrame([("2", "tjx", "g", "2024", True, 1)], schemas.TARGETS)
    f = features(cases, moves, targets, GROUPS)
    found = {r.check: r.violations for r in quality.trajectory_integrity(targets, cases, moves, f).collect()}
    assert found == {"cases without a target": 1, "events without a case": 1, "duplicate feature rows": 0, "duplicate event numbers": 0, "events out of order": 1, "targets without a feature row": 0}


@pytest.mark.parametrize("least", [1 << 20, 30, 0])
def test_summary_of_hot_cases(spark, monkeypatch, least):
    """Nulls in every column, repeated events and a case that holds half of them give the same rows on each way."""
    r = random.Random(1)
    pick = lambda *x: r.choice([None, *x])
    rows = [(r.choice(["1", "1", "2", "3", None]), pick("a"), pick(196, 456, 5), pick("Emenda", "x"), pick(at(1, 1), at(2, 2), at(3, 3)), pick("o1", "o2")) for _ in range(160)]
    monkeypatch.setattr(skew, "LEAST", least)
    events = spark.createDataFrame(rows, "numero_processo string, alias string, codigo int, nome string, data_hora timestamp_ntz, orgao_codigo string")
    want = {}
    for key in {x[:2] for x in rows}:
        own = {}
        for x in (x for x in rows if x[:2] == key):
            own.setdefault((x[2], x[4], x[5]), []).append(x[3])
        named = [(*k, min((n for n in v if n is not None), default=None)) for k, v in own.items()]
        times = [t for _, t, _, _ in named if t]
        first = [t for c, t, _, _ in named if c in (196, 456) and t]
        want[key] = (len(named), min(times, default=None), max(times, default=None), sum(c in (196, 456) for c, *_ in named), min(first, default=None), sum(n == "Emenda" for *_, n in named), len({c for c, *_ in named if c}), len({o for _, _, o, _ in named if o}))
    found = event_summary(events, GROUPS)
    columns = ["n_movimentos", "primeiro_movimento", "ultimo_movimento", "n_extincao", "primeiro_extincao", "n_emenda", "n_codigos_distintos", "n_orgaos_movimento"]
    got = {(x[0], x[1]): tuple(x)[2:] for x in found.select("numero_processo", "alias", *columns).collect()}
    assert got == want


def test_events_are_dealt_once(spark, capsys):
    """The plan of the summary has one exchange of events."""
    events = spark.range(1000).select(F.col("id").cast("string").alias("numero_processo"), (F.col("id") % 3).cast("string").alias("alias"), F.col("id").cast("int").alias("codigo"), F.lit("n").alias("nome"), F.lit(None).cast("timestamp_ntz").alias("data_hora"), F.lit("o").alias("orgao_codigo"))
    event_summary(events, GROUPS).explain()
    assert capsys.readouterr().out.count("Exchange") == 1


@pytest.mark.parametrize("hot", [None, 5])
def test_backward_steps_of_hot_units(spark, hot):
    r = random.Random(2)
    rows = [(r.choice(["a", "a", "a", "b", None]), i if r.random() < 0.95 else None, r.choice([None, *range(50)]), i) for i in range(600)]
    rows = list({(u, o): x for x in rows for u, o in [(x[0], x[1])]}.values())  # no ties
    want = []
    for unit in ("a", "b", None):
        own = sorted((x for x in rows if x[0] == unit), key=lambda x: (x[1] is not None, x[1] or 0))
        want += [y[3] for x, y in zip(own, own[1:]) if x[2] is not None and y[2] is not None and y[2] < x[2]]
    df = spark.createDataFrame(rows, "unit string, place int, at int, id int")
    out = quality.backward_steps(df, ["unit"], ["place"], "at", hot)
    assert out.columns == df.columns and sorted(x.id for x in out.collect()) == sorted(want)
