import random

import pytest

from lexloom.operators.packed import unpack_field, unpack_fields


def values(spark, text, names=False):
    df = spark.createDataFrame([(1, text)], "id int, f string")
    return [(r.pos, r.value) for r in unpack_field(df, "f", names, ("id",)).orderBy("pos").collect()]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Velgovan, Zilda; Drogosk, Koxa; Sitto Mirteldt", ["Velgovan, Zilda", "Drogosk, Koxa", "Sitto Mirteldt"]),
        ("Dulda Jorpuzo; O. Urbmamund,Halda da Brestox,Mubel Quokezo", ["Dulda Jorpuzo", "O. Urbmamund", "Halda da Brestox", "Mubel Quokezo"]),
        ('"Hawen T. Pratelq-Fellinpe", "Quokendel, Bolda"', ["Hawen T. Pratelq-Fellinpe", "Quokendel, Bolda"]),
        ("Oklda Tholmar, Mumen da Feldrovan; and V. Targoth", ["Oklda Tholmar", "Mumen da Feldrovan", "V. Targoth"]),
        ("Hatto Drostoka & Luru Sandvix and K. Tarstosk", ["Hatto Drostoka", "Luru Sandvix", "K. Tarstosk"]),
        ("Jorlinlo M., Taxa Nubmavan / Rulnur H.", ["Jorlinlo M.", "Taxa Nubmavan", "Rulnur H."]),
        ("Yststozo, Jr. ;", ["Yststozo, Jr."]),
        ('["Mirdrozo, Riwen","Muwen Jormaka"]', ["Mirdrozo, Riwen", "Muwen Jormaka"]),
        ("Brandnuq;;Brandnuq", ["Brandnuq", "Brandnuq"]),
    ],
)
def test_names(spark, text, expected):
    assert values(spark, text, names=True) == list(enumerate(expected, 1))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("node/edge, R&D,A/B design", ["node/edge", "R&D", "A/B design"]),
        (' "the ""sequence"" effect" , cited', ['the "sequence" effect', "cited"]),
        ('["the \\"ledger\\" effect", "water level, rural"]', ['the "ledger" effect', "water level, rural"]),
        ("'no. 7 group', 'long-term, urban'", ["no. 7 group", "long-term, urban"]),
        ("taux d'erreur、niveau d'eau", ["taux d'erreur", "niveau d'eau"]),
        ("a | b | a", ["a", "b", "a"]),
        ("one / two", ["one", "two"]),
        ("rock and roll, salt & pepper", ["rock and roll", "salt & pepper"]),
        ('un"closed, b', ['un"closed', "b"]),
        ("x0y, ", ["x0y", ""]),
        ("  ", []),
        ("", []),
        (",;，", []),
        (None, []),
    ],
)
def test_tags(spark, text, expected):
    assert values(spark, text) == list(enumerate(expected, 1))


def test_round_trip_of_quoted_lists(spark):
    rng = random.Random(3)
    alphabet = ["a", "B", " ", ",", ";", "'", '"', "\\", "é", "中", "|", "/"]
    rows = []
    for i in range(200):
        items = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 5))]
        items = [x for x in items if x.strip()]
        packed = "[" + ", ".join('"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"' for x in items) + "]"
        rows.append((i, packed, [x.strip() for x in items]))
    df = spark.createDataFrame([(i, p) for i, p, _ in rows], "id int, f string")
    got: dict[int, list] = {}
    for r in unpack_field(df, "f", keep=("id",)).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.value)
    assert all(got.get(i, []) == items for i, _, items in rows)


def test_long_text_empty_table_and_clashes(spark):
    long = ", ".join(f"tag{i}" for i in range(20_000))
    df = spark.createDataFrame([(1, long, '"' + "x" * 100_000 + '"')], "value int, tags string, authors string")
    with pytest.raises(ValueError):
        unpack_field(df, "tags", keep=("value",))
    renamed = df.withColumnRenamed("value", "id")
    out = unpack_fields(renamed, ("id",), ("authors",), ("tags",))
    assert out.filter("field = 'tags'").count() == 20_000
    assert out.filter("field = 'authors'").first().value == "x" * 100_000
    assert unpack_fields(renamed.limit(0), ("id",), ("authors",), ("tags",)).count() == 0
